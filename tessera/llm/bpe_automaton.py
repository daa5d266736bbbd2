"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts as one state with an arc to itself for each of the 256 bytes and accepts every byte
string. The merges (a, b) are compiled in their order. The gadget of a merge takes the one state q in which all arcs
labelled a end, gives these arcs a copy of q without the arc b as their new end, and gives every state that has an arc a
an arc ab to the end of b. What remains accepts exactly the token sequences that the merges produce, one for each byte
string; see Berglund, Martens and van der Merwe, "Constructing a BPE Tokenization DFA" (2024).

A copy shares the arcs of its original, so the tables hold for each state its parent and the one arc taken away, and when.
A state lacks the arc ab if a had been taken from it, or from an ancestor, before ab was made, or if ab itself was. Every
state accepts, so each prefix of a word is reached by one path only: a word is encoded by following arcs, trying the
longest label first and never reaching an offset twice, which takes at most one visit of each offset.

Decoding writes the labels of the arcs. Words already met are found by a hash, and their tokens taken over. Two words of one
hash would differ in length or in their bytes; both are compared, the bytes by decoding the whole text, and a text in which
any differ is encoded word by word without hashes.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import char_classes as cc
from tessera.llm.common import map_batches, slices

#: Characters handled at once by one Python worker, and distinct words that it remembers.
CHARS, WORDS = 500_000, 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """States, arcs and labels compiled from the merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.labels = [b""] * self.size
        for text, i in vocab.items():
            if text not in self.special:
                self.labels[i] = bytes(letters[c] for c in text)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self._compile([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        for text, i in self.special.items():
            self.labels[i] = text.encode()
        self.arcs: dict[int, bool] = {}

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        never = len(merges) + 1
        self.left, self.born = [-1] * self.size, [never] * self.size
        self.ends = [-1] * self.size  # the state in which all arcs of a label end
        parent, taken = [-1], [(-1, 0)]
        for i, label in enumerate(self.labels):
            if len(label) == 1:
                self.ends[i], self.born[i] = 0, 0
        for time, (a, b, ab) in enumerate(merges, 1):
            if self.ends[a] < 0 or self.ends[b] < 0 or self.ends[ab] >= 0:
                raise ValueError(f"merge {time} takes a token that no merge before makes, or makes one again")
            parent.append(self.ends[a])
            taken.append((b, time))
            self.ends[ab], self.left[ab], self.born[ab] = self.ends[b], a, time
            self.ends[a] = len(parent) - 1
        # an arc taken from a state is missing in the whole subtree of its copies, an interval in depth-first order
        children: list[list[int]] = [[] for _ in parent]
        for state, p in enumerate(parent):
            if p >= 0:
                children[p].append(state)
        self.first, last = [0] * len(parent), [0] * len(parent)
        clock, stack = 0, [(0, False)]
        while stack:
            state, left = stack.pop()
            if left:
                last[state] = clock
                continue
            self.first[state] = clock = clock + 1
            stack.append((state, True))
            stack.extend((x, False) for x in children[state])
        gone: dict[int, list[tuple[int, int, int]]] = {}
        for state in range(1, len(parent)):
            label, time = taken[state]
            gone.setdefault(label, []).append((self.first[state], last[state], time))
        self.gone = {}
        for label, spans in gone.items():
            kept: list[tuple[int, int, int]] = []
            for span in sorted(spans):  # an arc taken twice on one path is gone since the first time
                if not kept or span[0] > kept[-1][1]:
                    kept.append(span)
            self.gone[label] = ([x[0] for x in kept], [x[1] for x in kept], [x[2] for x in kept])
        self.never = never
        self.prefixes: dict[bytes, int] = {}
        for i, label in enumerate(self.labels):
            if self.ends[i] >= 0:
                for n in range(1, len(label)):
                    self.prefixes.setdefault(label[:n], -1)
                self.prefixes[label] = i
        self.states = len(parent)

    def has_arc(self, state: int, token: int) -> bool:
        """Whether a state has an arc labelled token."""
        at, until, x, gone = self.first[state], self.never, token, self.gone
        while x >= 0:
            if found := gone.get(x):
                k = bisect_right(found[0], at) - 1
                if k >= 0 and found[1][k] >= at and found[2][k] <= until:
                    return False
            until, x = self.born[x], self.left[x]
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word: the only accepted path with its bytes."""
        prefixes, arcs, ends, n = self.prefixes, self.arcs, self.ends, len(word)
        if (whole := prefixes.get(word, -1)) >= 0 and self._arc(0, whole):
            return [whole]
        came: dict[int, tuple[int, int]] = {0: (-1, -1)}
        stack = [(0, 0)]
        while stack:
            start, state = stack.pop()
            if start == n:
                break
            end = start + 1
            while end <= n:
                token = prefixes.get(word[start:end])
                if token is None:
                    break
                if token >= 0 and end not in came:
                    found = arcs.get(state << 20 | token)
                    if found is None:
                        found = self._arc(state, token)
                    if found:
                        came[end] = (start, token)
                        stack.append((end, ends[token]))
                end += 1
        out, at = [], n
        while at > 0:
            at, token = came[at]
            out.append(token)
        return out[::-1]

    def _arc(self, state: int, token: int) -> bool:
        if len(self.arcs) > 300_000:
            self.arcs.clear()
        self.arcs[state << 20 | token] = found = self.has_arc(state, token)
        return found


def word_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Offsets at which the byte-level pre-tokenizer starts a word, in code points of joined non-empty documents."""
    n = len(points)
    kind = cc.table()[points]
    white = kind >= cc.WHITE
    kind = np.where(white, cc.WHITE, kind)
    new_doc = np.zeros(n + 1, bool)
    new_doc[doc_starts] = True
    new_doc[n] = True
    run = np.empty(n, bool)
    run[0] = True
    run[1:] = kind[1:] != kind[:-1]
    run |= new_doc[:n]
    starts = run.copy()
    # the last white character before a word starts a token; a space takes the word along
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~new_doc[1:n]
    starts |= last
    space = last & (points == 32)
    starts[1:] &= ~space[:-1]
    for i in np.flatnonzero((points == 39) & run & starts):  # 's 't 'm 'd 're 've 'll
        if i + 1 < n and not new_doc[i + 1]:
            one = points[i + 1]
            two = points[i + 2] if i + 2 < n and not new_doc[i + 2] else 0
            size = 2 if one in (115, 116, 109, 100) else 3 if (one, two) in ((114, 101), (118, 101), (108, 108)) else 0
            if size:
                starts[i + 1] = False
                if i + size < n and not new_doc[i + size]:
                    starts[i + size] = True
    return np.flatnonzero(starts)


class Codec:
    """Encodes and decodes whole texts; remembers the tokens of the words it has seen, by hash."""

    def __init__(self, path: str, words: int = WORDS):
        self.automaton, self.words = Automaton(path), words
        self.powers = self.inverses = np.ones(1, np.uint64)
        self._forget()
        decimal = [f"{i}," for i in range(self.automaton.size)]
        self.decimal = np.zeros((self.automaton.size, max(map(len, decimal))), np.uint8)
        for i, x in enumerate(decimal):
            self.decimal[i, : len(x)] = np.frombuffer(x.encode(), np.uint8)

    def _forget(self) -> None:
        slots = 1 << (2 * self.words - 1).bit_length()
        self.keys, self.values, self.mask = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.uint64(slots - 1)
        self.offsets, self.counts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.pool, self.used, self.known = np.zeros(4096, np.int32), 0, 0

    def _hashes(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(points)
        if len(self.powers) <= n:
            size = 1 << (n + 1).bit_length()
            self.powers = np.full(size, _BASE, np.uint64)
            self.inverses = np.full(size, _BASE_INVERSE, np.uint64)
            self.powers[0] = self.inverses[0] = 1
            np.multiply.accumulate(self.powers, out=self.powers)
            np.multiply.accumulate(self.inverses, out=self.inverses)
        mixed = (points.astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= self.powers[:n]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed, out=sums[1:])
        out = (sums[ends] - sums[starts]) * self.inverses[starts]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(30)
        out[out == 0] = 1
        return out

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word, or -1."""
        slot = (hashes & self.mask).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == hashes, self.values[slot], -1)
        left = np.flatnonzero((held != hashes) & (held != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & int(self.mask)
            held, want = self.keys[slot], hashes[left]
            hit = held == want
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (held != 0)
            left, slot = left[go], slot[go]
        return out

    def _learn(self, key: int, size: int, tokens: list[int]) -> int:
        if self.known == len(self.counts):
            self.offsets, self.counts, self.sizes = (np.resize(x, 2 * self.known) for x in (self.offsets, self.counts, self.sizes))
        if self.used + len(tokens) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(tokens)))
        self.pool[self.used : self.used + len(tokens)] = tokens
        self.offsets[self.known], self.counts[self.known], self.sizes[self.known] = self.used, len(tokens), size
        slot, mask, keys = key & int(self.mask), int(self.mask), self.keys
        while keys[slot]:
            slot = (slot + 1) & mask
        keys[slot], self.values[slot] = key, self.known
        self.used += len(tokens)
        self.known += 1
        return self.known - 1

    def _encode_plain(self, texts: list[str], hashed: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """ids and, for each text, the number of its tokens; no text is empty or holds a special token. Hashed words of one
        length are not told apart."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(x) for x in texts], np.int64)
        doc_starts = np.cumsum(sizes) - sizes
        starts = word_starts(points, doc_starts)
        ends = np.append(starts[1:], len(points))
        if not hashed:
            return self._encode_words(joined, starts, ends, np.searchsorted(starts, doc_starts))
        hashes = self._hashes(points, starts, ends)
        found = self._find(hashes)
        if len(missing := np.flatnonzero(found < 0)):
            fresh, first, where = np.unique(hashes[missing], return_index=True, return_inverse=True)
            if self.known + len(fresh) > self.words:
                self._forget()
                if len(fresh) > self.words:
                    self.words = len(fresh)
                    self._forget()
                missing = np.arange(len(hashes))
                fresh, first, where = np.unique(hashes, return_index=True, return_inverse=True)
                if len(fresh) > self.words:
                    self.words = len(fresh)
                    self._forget()
            encode, learn, numbers = self.automaton.encode_word, self._learn, np.empty(len(fresh), np.int64)
            for k, (key, at) in enumerate(zip(fresh.tolist(), missing[first].tolist(), strict=True)):
                numbers[k] = learn(key, int(ends[at] - starts[at]), encode(joined[starts[at] : ends[at]].encode()))
            found[missing] = numbers[where]
        if (self.sizes[found] != ends - starts).any():
            return self._encode_words(joined, starts, ends, np.searchsorted(starts, doc_starts))
        counts = self.counts[found].astype(np.int64)
        before = np.cumsum(counts) - counts
        ids = self.pool[np.repeat(self.offsets[found] - before, counts) + np.arange(int(counts.sum()))]
        return ids, np.add.reduceat(counts, np.searchsorted(starts, doc_starts)) if len(texts) else counts

    def _encode_words(self, joined: str, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, word by word; firsts: the number of each text's first word."""
        met: dict[str, list[int]] = {}
        found = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            word = joined[a:b]
            if (tokens := met.get(word)) is None:
                tokens = met[word] = self.automaton.encode_word(word.encode())
            found.append(tokens)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(counts.sum()))
        return ids, np.add.reduceat(counts, firsts)

    def encode(self, texts: list[str], special: bool = True, hashed: bool = True) -> list[np.ndarray]:
        """ids of each text. Strings of special tokens become their ids, as in the tokenizers library, or else are text."""
        marks, pieces, plan = self.automaton.special if special else {}, [], []
        for text in texts:
            parts: list[int] = []  # index of a piece, or minus an id less one
            rest = [text]
            for word in marks:
                if word in text:
                    rest = [y for x in rest for y in ([x] if isinstance(x, int) else _split(x, word, -marks[word] - 1))]
            for x in rest:
                if isinstance(x, int):
                    parts.append(x)
                elif x:
                    parts.append(len(pieces))
                    pieces.append(x)
            plan.append(parts)
        done: list[np.ndarray] = []
        for a, b in slices([len(x) for x in pieces], CHARS):
            ids, counts = self._encode_plain(pieces[a:b], hashed)
            done += np.split(ids, np.cumsum(counts)[:-1])
        out = []
        for text, parts in zip(texts, plan, strict=True):
            found = [done[k] if k >= 0 else np.array([-k - 1], np.int32) for k in parts]
            ids = found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, np.int32)
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Labels of the arcs, special tokens included."""
        return b"".join(map(self.automaton.labels.__getitem__, ids.tolist()))

    def encode_checked(self, texts: list[str], special: bool = True) -> list[tuple[np.ndarray, bytes]]:
        """ids and decoded bytes."""
        out = []
        for text, ids in zip(texts, self.encode(texts, special), strict=True):
            own, decoded = text.encode(), self.decode(ids)
            if decoded != own:  # words of one hash and length
                ids = self.encode([text], special, hashed=False)[0]
                decoded = self.decode(ids)
                if decoded != own:
                    raise ValueError("the automaton's labels do not spell the text")
            out.append((ids, decoded))
        return out

    def digits(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        grid = self.decimal[ids]
        return grid[grid != 0].tobytes()[:-1]


def _split(text: str, word: str, mark: int) -> list[str | int]:
    out: list[str | int] = []
    for k, part in enumerate(text.split(word)):
        out += [mark, part] if k else [part]
    return out


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each Python worker."""
    return Codec(path)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key long, ids array<int>, decoded string) of every row. Null text counts as empty; rows repeat as they come."""

    def make():
        own = codec(path)

        def apply(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in slices([len(x) for x in texts], 4 * CHARS):
                found = own.encode_checked(texts[a:b])
                ids = [x for x, _ in found]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                decoded = pa.array([x.decode("utf-8", "replace") for _, x in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists, decoded], ["id", "ids", "decoded"])

        return apply

    return map_batches(df.selectExpr(f"cast(`{key}` as long) id", f"`{text}` t"), "id long, ids array<int>, decoded string", make).withColumnRenamed("id", key)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of what encode() returns, without sending it to the JVM."""

    def make():
        own = codec(path)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n, first, second = [], [], []
            for a, b in slices([len(x) for x in texts], CHARS):
                for ids, decoded in own.encode_checked(texts[a:b]):
                    n.append(len(ids))
                    first.append(hashlib.sha256(own.digits(ids)).hexdigest())
                    second.append(hashlib.sha256(decoded).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return apply

    return map_batches(df.selectExpr(f"cast(`{key}` as long) id", f"`{text}` t"), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make).withColumnRenamed("id", key)
