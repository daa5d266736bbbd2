"""Personal data in texts: fixed patterns, and spans that a character-level BiLSTM-CRF adds.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers as commonly written. The tagger is trained in
numpy on labelled spans and looks for the same kinds in other forms: addresses spelled with at and dot, numbers without a
plus sign or with other separators. It reads the whole of every text in overlapping windows; the best path of each window
gives spans with the margin of their score over no span; spans that a window cuts are left to the next window; among those of
all windows of a text the set of spans without overlap with the highest sum stays. What stays must hold the digits or the
address that its kind has, and must not meet a span of the patterns.

Every added span of up to LENGTH - STRIDE characters lies whole in some window; a longer one may be cut by all of them.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, slices
from tessera.llm.tagger import Decoder, Tagger

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_card(text: str) -> bool:
    found = digits_of(text)
    return 14 <= len(found) <= 19 and luhn(found)


def _emails(text: str) -> Iterator[Span]:
    """The leftmost matches of local@domain, found from the at signs so that long words cost no more than their length."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            end = found.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and kind."""
    if not _SIGN.search(text):
        return []
    out = list(_emails(text)) if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if is_card(m[0])]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


# Symbols of the tagger: letters without case, one digit, each ASCII sign, white space, other letters, the rest, padding.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \n"
PAD = 0
_TABLE = np.full(256, 3, np.uint8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _TABLE[ord(_c)] = _TABLE[ord(_c.upper())] = 4 + _i
for _c in "0123456789":
    _TABLE[ord(_c)] = 1
for _i, _c in enumerate(_SIGNS):
    _TABLE[ord(_c)] = 30 + _i
_TABLE[[9, 11, 12, 13, 160]] = 30 + _SIGNS.index(" ")
_TABLE[192:256] = 2
SYMBOLS = 30 + len(_SIGNS)
TAGS = 1 + 2 * len(KINDS)  # none; for each kind its first character and others


def symbols_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 256, _TABLE[np.minimum(points, 255)], np.uint8(2))


_SYLLABLES = "an ar at be ca com de dot ed el en er es eau fo ga he ho in ing io is it jo ka la ly ma na nd nt on or ou pe qui ra re sa st ta te th ti tion un vi wo é ü ñ ß ght".split()


def _word(r: random.Random) -> str:
    if r.random() < 0.5:
        word = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    else:
        word = "".join(r.choice("aaabcdeeeefghiiijklmnnoooprrssttuvwxyz") for _ in range(r.randint(1, 11)))
    return word.capitalize() if r.random() < 0.15 else word.upper() if r.random() < 0.05 else word


def _name(r: random.Random) -> str:
    return re.sub(r"[^a-z]", "", _word(r).lower()) or "ana"


def _number(r: random.Random, size: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(size))


def _entity(r: random.Random, kind: str) -> str:
    if kind == "email":
        user = r.choice([_name(r), f"{_name(r)}.{_name(r)}", f"{_name(r)}.{r.randint(1, 99)}", f"{_name(r)}{r.randint(1, 999)}", f"{_name(r)}_{_name(r)}"])
        host = r.choice([_name(r), f"mail{r.randint(1, 9)}", f"{_name(r)}-{_name(r)}"])
        parts = [host, *([_name(r)] if r.random() < 0.4 else []), r.choice(["com", "org", "net", "de", "fr", "es", "example.com", "io"])]
        at, dot = r.choice([("@", "."), ("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), ("(at)", "(dot)"), (" @ ", "."), (" AT ", " DOT "), (" at ", "."), ("{at}", "{dot}")])
        return user + at + dot.join(parts)
    if kind == "ip":
        dot = r.choice([".", ".", "[.]", "(.)", " . ", " dot ", "[dot]"])
        return dot.join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        size = r.choice([15, 16, 16, 16])
        body = r.choice("3456") + _number(r, size - 2)
        body += next(c for c in "0123456789" if luhn(body + c))
        gap = r.choice(["", " ", "-", ".", "/", "  ", "_", " - "])
        return gap.join(body[i : i + 4] for i in range(0, size, 4))
    a, b, c = _number(r, 3), _number(r, 3), _number(r, 4)
    return r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"00{r.randint(30, 49)} {a} {b}{c}", f"0{r.randint(20, 99)}/{b}{c}1", f"{a} {b} {c}", f"+{r.randint(1, 99)}/{a}/{b}{c}", f"001 {a} {b} {c}"])


def _other(r: random.Random) -> str:
    """Things with digits, at signs or dots that are none of the kinds."""
    return r.choice([f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", f"{r.randint(1, 9999)}.{r.randint(0, 99):02}", f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"#{_number(r, r.randint(3, 9))}", "".join(r.choice("0123456789abcdef") for _ in range(r.randint(8, 40))), f"AKIA{''.join(r.choice('ABCDEFGHJKLMNPQRSTUVWXYZ0123456789') for _ in range(16))}", f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1950, 2030)}", f"@{_name(r)}", f"{r.randint(1, 999)},{_number(r, 3)}", f"{r.randint(1, 99)}%", str(r.randint(0, 10**r.randint(1, 8))), f"{r.randint(1, 99)} {r.randint(1, 99)} {r.randint(1, 99)}", f"at {_word(r)} dot {_word(r)}", f"{_word(r)} dot", f"version {r.randint(1, 9)} point {r.randint(1, 9)}", f"{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 99)}", f"{_number(r, 4)}-{_number(r, 2)}", f"ISBN 978-{_number(r, 1)}-{_number(r, 4)}-{_number(r, 4)}-{_number(r, 1)}"])


def examples(n: int, seed: int = 0, share: float = 0.2) -> list[tuple[str, list[Span]]]:
    """Made-up texts with labelled spans, which are a share of their parts."""
    r, out = random.Random(seed), []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(3, 14)):
            x = r.random()
            if x < share:
                kind = r.choice(KINDS)
                entity = _entity(r, kind)
                spans.append((kind, len(text), len(text) + len(entity)))
                text += entity
            else:
                text += _other(r) if x < share + (0.2 if share else 0.04) else _word(r)
            text += r.choice([" ", " ", " ", " ", " ", ", ", ". ", ".\n", "\n", " (", ") ", "$$$ ", "&&& ", "### ", "!! ", ": ", '" '])
        out.append((text, spans))
    return out


#: Characters of a window and from one window to the next: every span of up to LENGTH - STRIDE characters lies whole in one.
LENGTH, STRIDE = 1120, 1024
#: The same for the sequences of training; windows scored at once, and windows with hope of a span that are followed at once.
FIT_LENGTH, FIT_STRIDE, ROWS, HELD = 96, 64, 768, 128
#: Characters handled at once by one Python worker.
CHARS = 800_000


def _laid_out(labelled: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences with their tags; spans that one cuts keep the tags of what is inside."""
    rows, tags = [], []
    for text, spans in labelled:
        own, values = np.zeros(len(text), np.int64), symbols_of(text)
        for kind, a, b in spans:
            own[a:b] = 2 + 2 * KINDS.index(kind)
            own[a] -= 1
        for at in range(0, max(1, len(text) - FIT_LENGTH + FIT_STRIDE), FIT_STRIDE):
            row, tag = np.full(FIT_LENGTH, PAD), np.zeros(FIT_LENGTH, np.int64)
            part = values[at : at + FIT_LENGTH]
            row[: len(part)], tag[: len(part)] = part, own[at : at + FIT_LENGTH]
            rows.append(row)
            tags.append(tag)
    return np.array(rows), np.array(tags)


#: Made-up texts of the fit, the share of spans in them, texts without spans for each of them, and steps.
TEXTS, SHARE, PROSE, STEPS = 6000, 0.5, 0.7, 600


@functools.lru_cache(maxsize=2)
def trained(n: int = TEXTS, steps: int = STEPS, seed: int = 0) -> Tagger:
    """A tagger fitted to n made-up texts; the same for the same arguments."""
    return fit(examples(n, seed, SHARE) + examples(int(n * PROSE), seed + 1, 0), steps, seed)


def fit(labelled: list[tuple[str, list[Span]]], steps: int = STEPS, seed: int = 0) -> Tagger:
    """A tagger fitted to texts with labelled spans."""
    tagger = Tagger.fresh(SYMBOLS, TAGS, seed=seed)
    tagger.fit(*_laid_out(labelled), steps=steps, seed=seed)
    return tagger


def windows_of(size: int) -> range:
    """Starts of the windows that cover a text of so many characters."""
    return range(0, size and max(1, size - LENGTH + STRIDE), STRIDE)


_AT = re.compile(r"\s*[\[({]?\s*(?:@|(?<![a-z])at(?![a-z]))\s*[\])}]?\s*", re.I)
_DOT = re.compile(r"\s*[\[({]?\s*(?:\.|(?<![a-z])dot(?![a-z]))\s*[\])}]?\s*", re.I)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: After the bare word at, a full stop that only a space follows ends a sentence: "he was at home. Then" holds no address.
_SENTENCE = re.compile(r"\sat\s[^@]*[A-Za-z0-9-]\.\s", re.I)


def valid(kind: str, text: str) -> bool:
    """Whether a span found by the tagger has what its kind needs."""
    if kind == "email":
        plain = _DOT.sub(".", _AT.sub("@", text, count=1))
        return _EMAIL.fullmatch(plain) is not None and not _SENTENCE.search(text)
    if kind == "ip":
        parts = _DOT.sub(".", text).split(".")
        return len(parts) == 4 and all(re.fullmatch(r"[0-9]{1,3}", x) and int(x) <= 255 for x in parts)
    if kind == "card":
        return is_card(text) and not re.search(r"[A-Za-z]", text)
    return 10 <= len(digits_of(text)) <= 15 and not re.search(r"[^\s0-9()+./-]", text)


def reconciled(found: list[tuple[float, str, int, int]]) -> list[Span]:
    """Spans without overlap with the highest sum of scores; of equal sums the one found first by end."""
    once: dict[Span, float] = {}
    for score, *span in found:
        once[tuple(span)] = max(score, once.get(tuple(span), score))
    spans = sorted(once, key=lambda x: (x[2], x[1], x[0]))
    ends = [x[2] for x in spans]
    sums, before = [0.0], []  # of the best choice among the first spans; how many of them end before a span begins
    for k, span in enumerate(spans):
        before.append(bisect_right(ends, span[1], 0, k))
        sums.append(max(sums[k], sums[before[k]] + once[span]))
    out, k = [], len(spans)
    while k:
        if sums[k] > sums[k - 1]:
            out.append(spans[k - 1])
            k = before[k - 1]
        else:
            k -= 1
    return out[::-1]


def _runs(tags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of the spans that the tags of a sequence make."""
    at = np.flatnonzero(tags)
    if not len(at):
        return
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (tags[at[1:]] % 2 == 1) | (tags[at[1:]] + 1 >> 1 != tags[at[:-1]] + 1 >> 1)
    starts = np.flatnonzero(first)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
        yield int(at[a]), int(at[b - 1]) + 1, (int(tags[at[a]]) - 1) // 2


def _grids(joined: np.ndarray, begins: np.ndarray, sizes: list[int], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, start and size of windows, their symbols) of windows over the whole of every text; those of about one length
    go together."""
    places = np.array([(k, at, min(LENGTH, size - at)) for k, size in enumerate(sizes) for at in windows_of(size)], np.int64).reshape(-1, 3)
    places = places[np.argsort(places[:, 2], kind="stable")]
    for a in range(0, len(places), rows):
        part = places[a : a + rows]
        grid = np.arange(part[-1, 2] + part[-1, 2] % 2)
        where = np.minimum((begins[part[:, 0]] + part[:, 1])[:, None] + grid, len(joined) - 1)
        yield part, np.where(grid < part[:, 2:], joined[where], PAD)


def added_spans(texts: list[str], bases: list[list[Span]], decoder: Decoder, rows: int = ROWS) -> list[list[Span]]:
    """What the tagger adds to the spans of the patterns."""
    sizes = [len(x) for x in texts]
    begins = np.cumsum([0, *sizes])
    found: dict[int, list[tuple[float, str, int, int]]] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []  # windows that may hold spans, and their scores

    def follow() -> None:
        steps = max(len(x) for _, x in held)
        gains = np.full((steps, held[0][1].shape[1], sum(x.shape[2] for _, x in held)), -1e6, np.float32)
        at = 0
        for _, x in held:
            gains[: len(x), :, at : at + x.shape[2]] = x
            at += x.shape[2]
        for (k, start, size), tag, gain in zip(np.concatenate([x for x, _ in held]).tolist(), *decoder.paths(gains), strict=True):
            for i, j, kind in _runs(tag[:size]):
                if (i == 0 and start > 0) or (j == size and start + j < sizes[k]):
                    continue  # cut by the window
                span = texts[k][start + i : start + j]
                begin, end = start + j - len(span.lstrip()), start + i + len(span.rstrip())
                if begin < end and valid(KINDS[kind], span.strip()):
                    found.setdefault(k, []).append((float(gain[i:j].sum()), KINDS[kind], begin, end))
        held.clear()

    for places, symbols in _grids(symbols_of("".join(texts)), begins, sizes, rows):
        gains = decoder.gains(symbols)
        some = decoder.hopeful(gains)
        if len(some):
            held.append((places[some], gains[:, :, some]))
        if sum(len(x) for x, _ in held) >= HELD:
            follow()
    if held:
        follow()
    out: list[list[Span]] = [[] for _ in texts]
    for k, spans in found.items():
        taken = merged([(a, b) for _, a, b in bases[k]])
        starts = [a for a, _ in taken]
        for span in reconciled(spans):
            before = bisect_left(starts, span[2])  # base spans that begin before the end of this one
            if not before or taken[before - 1][1] <= span[1]:
                out[k].append(span)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of spans that overlap, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def _parts(batch: pa.RecordBatch, column: int, decoder: Decoder) -> Iterator[tuple[pa.RecordBatch, list[str | None], list[list[Span]], list[list[Span]]]]:
    """A batch in parts of bounded text: the rows, their texts, the patterns' spans of each and those that the tagger adds."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
    for a, b in slices(sizes, CHARS):
        rows = batch.slice(a, b - a)
        values = rows.column(column).to_pylist()
        texts = [x or "" for x in values]
        bases = [base_spans(x) for x in texts]
        yield rows, values, bases, added_spans(texts, bases, decoder)


def find(docs: DataFrame, tagger: Tagger | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key long, n_email, n_ip, n_card, n_phone long, base_sha256 string, spans string) of every row.

    The numbers and the digest are of the patterns' spans; spans has those that the tagger adds too. Null and empty texts
    have none. Repeated rows stay; other columns are not looked at; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or trained())

    def make():
        decoder = shared.value.decoder()

        def apply(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for rows, _, bases, more in _parts(batch, 1, decoder):
                columns = [rows.column(0)]
                columns += [pa.array([sum(x[0] == kind for x in base) for base in bases], pa.int64()) for kind in KINDS]
                columns.append(pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in bases]))
                columns.append(pa.array([written([*x, *y]) for x, y in zip(bases, more, strict=True)]))
                yield pa.RecordBatch.from_arrays(columns, ["id", *(f"n_{x}" for x in KINDS), "base_sha256", "spans"])

        return apply

    ddl = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_batches(docs.selectExpr(f"cast(`{key}` as long) id", f"`{text}` t"), ddl, make).withColumnRenamed("id", key)


def masked(text: str, spans: list[Span]) -> str:
    """The text with a mark of the kind in the place of each span; spans that overlap share the mark of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger | None = None, text: str = "text") -> DataFrame:
    """The rows with all their columns, personal data in the text replaced by marks. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger or trained())

    def make():
        decoder = shared.value.decoder()

        def apply(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            at = batch.schema.get_field_index(text)
            for rows, values, bases, more in _parts(batch, at, decoder):
                new = [masked(v, [*a, *b]) if a or b else v for v, a, b in zip(values, bases, more, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, batch.schema.field(at).type) if k == at else c for k, c in enumerate(rows.columns)], schema=batch.schema)

        return apply

    return map_batches(docs, docs.schema, make)


def with_length(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """Brings a column of lengths up to date with the text."""
    return docs.withColumn(size, F.length(text).cast(docs.schema[size].dataType)) if size in docs.columns else docs
