"""Deep-shallow sorting of byte strings in groups, with the common prefixes of neighbours.

The shallow phase is a multikey quicksort whose letters are words of eight bytes: all open segments are split by their next
word at once, by numpy's sort in place of partitions around pivots, and those of one string are done. Segments still open after a few words share a long prefix; the deep phase
puts each of them into a blind trie, which looks at branching letters only and compares each string in full just once.
After Manzini and Ferragina, "Engineering a Lightweight Suffix Array Construction Algorithm" (2004).
"""

from __future__ import annotations

import numpy as np

#: Words of the shallow phase.
WORDS = 4


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


class _Branch:
    __slots__ = ("depth", "kids")

    def __init__(self, depth: int, kids: dict):
        self.depth, self.kids = depth, kids


class _Leaf:
    __slots__ = ("items", "text")

    def __init__(self, text: bytes, item: int):
        self.text, self.items = text, [item]


def blind_trie(texts: list[bytes], items: list[int]) -> tuple[list[int], list[int]]:
    """Items in the order of their texts, equal ones as they came, and the common prefix of each with the one before."""
    root: _Branch | _Leaf = _Leaf(texts[items[0]], items[0])
    for item in items[1:]:
        text = texts[item]
        n, path, node = len(text), [], root
        while type(node) is _Branch:
            path.append(node)
            following = node.kids.get(text[node.depth] if node.depth < n else -1)
            node = following if following is not None else next(iter(node.kids.values()))
        known = node.text
        same = common_prefix(text, known)
        if same == n == len(known):
            node.items.append(item)
            continue
        letter, other = text[same] if same < n else -1, known[same] if same < len(known) else -1
        k = 0
        while k < len(path) and path[k].depth < same:
            k += 1
        if k < len(path) and path[k].depth == same:
            path[k].kids[letter] = _Leaf(text, item)
            continue
        below = path[k] if k < len(path) else node
        branch = _Branch(same, {other: below, letter: _Leaf(text, item)})
        if k == 0:
            root = branch
        else:
            above = path[k - 1]
            above.kids[text[above.depth] if above.depth < n else -1] = branch
    order, prefixes, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if type(node) is _Leaf:
            order += node.items
            prefixes += [shared] + [len(node.text)] * (len(node.items) - 1)
        else:
            letters = sorted(node.kids)
            stack += [(node.kids[c], node.depth) for c in letters[:0:-1]]
            stack.append((node.kids[letters[0]], shared))
    return order, prefixes


def sort_groups(texts: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group and text, and the common prefix of each text with the one before it in that order; 0 where a group
    begins. groups: a number for each text."""
    n = len(texts)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    grid = np.frombuffer(b"".join(x[: 8 * WORDS].ljust(8 * WORDS, b"\0") for x in texts), ">u8").reshape(n, WORDS).astype(np.uint64)
    order = np.argsort(groups, kind="stable")
    segment = np.cumsum(np.r_[True, groups[order][1:] != groups[order][:-1]]) - 1
    for word in range(WORDS + 1):
        # the last pass tells strings that end from those that go on in zeros
        key = grid[:, word] if word < WORDS else np.minimum(lengths, 8 * WORDS).astype(np.uint64)
        sizes = np.bincount(segment)
        open_ = np.flatnonzero(sizes[segment] > 1)
        if not len(open_):
            break
        own = order[open_]
        order[open_] = own[np.lexsort((key[own], segment[open_]))]
        value = key[order]
        segment = np.cumsum(np.r_[True, (segment[1:] != segment[:-1]) | (value[1:] != value[:-1])]) - 1
    prefixes = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        differ = grid[a] ^ grid[b]
        first = np.argmax(differ != 0, axis=1)
        word = differ[np.arange(n - 1), first]
        zeros = np.zeros(n - 1, np.int64)
        for byte in range(1, 8):
            zeros += word < np.uint64(1 << (64 - 8 * byte))
        shared = np.where((differ == 0).all(axis=1), 8 * WORDS, 8 * first + zeros)
        prefixes[1:] = np.where(groups[a] == groups[b], np.minimum(shared, np.minimum(lengths[a], lengths[b])), 0)
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    ends = np.r_[starts[1:], n]
    for at, end in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        own, shared = blind_trie(texts, order[at:end].tolist())
        order[at:end] = own
        prefixes[at + 1 : end] = shared[1:]
    return order, prefixes
