"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

Fingerprints are compared once for all documents that share them. Two that differ in at most three of 64 bits agree in three
of six blocks of bits, so each distinct fingerprint is filed under the 20 choices of three blocks, under keys of 32 bits
and more; a key's fingerprints are compared with one another. Keys of many fingerprints are counted before anything is dealt
out by key; their fingerprints are dealt into chunks by hash, and every pair of chunks is a group of its own, so no task
gets more than two chunks, and no pair is lost.

In a group, bit planes stand vertically: word w of plane b holds bit b of 64 fingerprints. For one fingerprint against all,
each plane is inverted where its own bit is set, and added to distances kept in carry-save form, a word for the ones, one for
the twos, and one that stays set once a distance has passed three. Blocks of 64 distances that are all past three are
abandoned. Of the links in a group only a spanning forest leaves the task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, shared_dir, slices
from tessera.llm.components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints in a chunk of a hot key; characters handled at once.
CHUNK, CHARS = 4096, 500_000
_SIZES = (11, 11, 11, 11, 10, 10)


def _masks() -> list[int]:
    blocks, at = [], 0
    for size in _SIZES:
        blocks.append(((1 << size) - 1) << at)
        at += size
    return [a | b | c for a, b, c in itertools.combinations(blocks, 3)]


MASKS = _masks()


def _hashes(text: str | None) -> list[int]:
    words = (text or "").encode().lower().split()
    if not words:
        return []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < SHINGLE:
        return [digest(join(words), SEED)]
    return [digest(x, SEED) for x in map(join, zip(words, words[1:], words[2:], strict=False))]


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """64-bit fingerprints: a bit is set where over half of the hashes have it; 0 without words."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in slices([len(x or "") for x in texts], CHARS):
        found = [_hashes(x) for x in texts[a:b]]
        sizes = np.array([len(x) for x in found])
        rows = np.flatnonzero(sizes)
        if not len(rows):
            continue
        starts = (np.cumsum(sizes) - sizes)[rows]
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint64, int(sizes.sum()))
        bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        set_ = (2 * sums > sizes[rows, None]).astype(np.uint8)
        out[a + rows] = np.packbits(set_, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key long, fp long): the fingerprint's bits as a signed number. Null text counts as empty."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(batch.column(1).to_pylist()).view(np.int64))], ["id", "fp"])

        return apply

    return map_batches(df.selectExpr(f"cast(`{key}` as long) id", f"`{text}` t"), "id long, fp long", make).withColumnRenamed("id", key)


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 rows of words; word w of row b holds bit b of values 64w to 64w + 63. Missing values are zeros."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


class _Distances:
    """Carry-save counters of many distances: up to three, and past it."""

    def __init__(self, shape: tuple[int, ...]):
        self.ones, self.twos, self.past = (np.zeros(shape, np.uint64) for _ in range(3))

    def add(self, plane: np.ndarray) -> None:
        carry = self.ones & plane
        self.ones ^= plane
        self.past |= self.twos & carry
        self.twos ^= carry

    def flatten(self) -> None:
        self.ones, self.twos, self.past = self.ones.ravel(), self.twos.ravel(), self.past.ravel()

    def keep(self, blocks: np.ndarray) -> None:
        self.ones, self.twos, self.past = self.ones[blocks], self.twos[blocks], self.past[blocks]


_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def pairs_within(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of values, whether they differ in at most three bits."""
    planes = planes_of(left ^ right)
    n, words = len(left), np.arange(planes.shape[1])
    distances = _Distances((len(words),))
    for b in range(64):
        distances.add(planes[b, words])
        if b % 8 == 7 and b < 63:
            alive = np.flatnonzero(distances.past != _ALL)
            if len(alive) < len(words):
                words = words[alive]
                distances.keep(alive)
    out = np.zeros(planes.shape[1], np.uint64)
    out[words] = ~distances.past
    return np.unpackbits(out.astype("<u8").view(np.uint8), bitorder="little")[:n].astype(bool)


def matrix_within(values: np.ndarray) -> np.ndarray:
    """Row i, packed: which values differ from value i in at most three bits.

    A value's own bit and the padding count as past the radius from the beginning, so that they keep no block alive; a block
    is a row's word, the distances of 64 values. Planes in which all values agree add nothing and are left out.
    """
    planes = planes_of(values)
    n, words = len(values), planes.shape[1]
    vary = int(np.bitwise_or.reduce(values) ^ np.bitwise_and.reduce(values))
    order = [b for b in range(64) if vary >> b & 1]
    out = np.zeros((n, words), np.uint64)
    padding = np.zeros(words, np.uint64)
    if n % 64:
        padding[-1] = ~np.uint64((1 << n % 64) - 1)
    for a in range(0, n, 512):
        part = values[a : a + 512]
        rows = np.arange(len(part))
        distances = _Distances((len(part), words))
        distances.past |= padding
        own = a + rows
        distances.past[rows, own // 64] |= np.uint64(1) << (own % 64).astype(np.uint64)
        row = word = None
        for k, b in enumerate(order):
            flip = np.where(part >> np.uint64(b) & np.uint64(1), _ALL, np.uint64(0))
            distances.add(planes[b][None, :] ^ flip[:, None] if row is None else planes[b, word] ^ flip[row])
            if k % 8 == 7 and k + 1 < len(order):
                alive = np.flatnonzero(distances.past != _ALL)
                if row is None:
                    if len(alive) > 0.7 * distances.past.size:
                        continue
                    row, word = alive // words, alive % words
                    distances.flatten()
                else:
                    row, word = row[alive], word[alive]
                distances.keep(alive)
        if row is None:
            out[own] = ~distances.past
        else:
            out[a + row, word] = ~distances.past
        out[own, own // 64] |= np.uint64(1) << (own % 64).astype(np.uint64)
    return out


def _forest(values: np.ndarray) -> np.ndarray:
    """For each value of a large group, the index of the first value of its component in the group."""
    near = matrix_within(values)
    n = len(values)
    label = np.full(n, -1)
    unseen = np.full(near.shape[1], _ALL)
    for start in range(n):
        if label[start] >= 0:
            continue
        front = np.array([start])
        unseen[start // 64] &= ~(np.uint64(1) << np.uint64(start % 64))
        while len(front):
            label[front] = start
            reach = np.bitwise_or.reduce(near[front], axis=0) & unseen
            unseen &= ~reach
            front = np.flatnonzero(np.unpackbits(reach.astype("<u8").view(np.uint8), bitorder="little")[:n])
    return label


def links_in_groups(groups: np.ndarray, values: np.ndarray, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each group; groups: a number for each value, equal ones together."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    left, right = [], []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= small)]):
        at = starts[sizes == size]
        i, j = np.triu_indices(int(size), 1)
        for part in np.array_split(at, max(1, len(at) * len(i) // 1_000_000)):
            a, b = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
            near = pairs_within(values[a], values[b])
            a, b = a[near], b[near]
            label = np.arange(len(values)) if len(a) else None
            moved = len(a) > 0
            while moved:
                low = np.minimum(label[a], label[b])
                moved = bool((label[a] != low).any() or (label[b] != low).any())
                np.minimum.at(label, a, low)
                np.minimum.at(label, b, low)
            if len(a):
                own = np.unique(np.r_[a, b])
                own = own[label[own] != own]
                left.append(values[own])
                right.append(values[label[own]])
    for at, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        own = values[at : at + size]
        label = _forest(own)
        moved = np.flatnonzero(label != np.arange(size))
        left.append(own[moved])
        right.append(own[label[moved]])
    none = np.zeros(0, np.uint64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, part, fp), sorted by group; a group's rows may span batches."""
    held: list[tuple[np.ndarray, ...]] = []

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        group, first = np.zeros(len(columns[0]), np.int64), np.ones(len(columns[0]), bool)
        first[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])
        group = np.cumsum(first)
        a, b = links_in_groups(group, columns[3].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        if sum(len(x[0]) for x in held) < 100_000:
            continue
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        # the last group may go on
        same = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]) & (columns[2] == columns[2][-1])
        cut = int(np.argmax(same))
        held = [tuple(x[cut:] for x in columns)]
        if cut:
            yield links([x[:cut] for x in columns])
    if held:
        yield links([np.concatenate(x) for x in zip(*held, strict=True)])


def links(distinct: DataFrame, fp: str = "fp", chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints, as signed numbers: enough to connect all that differ in three bits or
    fewer. Reads `distinct` twice."""
    spark = distinct.sparkSession
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col(fp).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for t, m in enumerate(MASKS)))
    filed = distinct.select(F.col(fp).alias("fp"), F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    path = shared_dir(spark, "hot-keys")
    filed.groupBy("t", "key").count().where(F.col("count") > chunk).write.parquet(path)
    hot = spark.read.parquet(path)
    if hot.isEmpty():
        dealt = filed.select("t", "key", F.lit(0).alias("part"), "fp")
    else:
        # chunks 0 to n - 1; the pair of chunks i <= j has number i * n + j
        n = F.coalesce(F.ceil(F.col("count") / chunk), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda x: F.least(x, F.col("own")) * F.col("n") + F.greatest(x, F.col("own")))
        dealt = filed.join(hot, ["t", "key"], "left").withColumn("n", n).withColumn("own", own).select("t", "key", F.explode(parts).alias("part"), "fp")
    width = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(width, "t", "key", "part").sortWithinPartitions("t", "key", "part").mapInArrow(_compare, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint string, component_id long) of every row.

    Null text counts as empty; empty texts have fingerprint zero and are linked like others. component_id is the smallest
    id reachable over links, the row's own included; null if no row of the component has an id. Repeated rows are repeated.
    An empty table gives an empty result; other columns are not looked at.
    """
    spark = df.sparkSession
    path, apart = shared_dir(spark, "fingerprints"), shared_dir(spark, "distinct")
    fingerprints(df, key, text).write.parquet(path)
    own = spark.read.parquet(path)
    own.groupBy("fp").agg(F.min(key).alias("least")).write.parquet(apart)
    distinct = spark.read.parquet(apart)
    roots = components(links(distinct))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return own.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the smallest id of their component, with all their columns. A document is its id: rows that repeat
    an id stay or go together. Documents without an id stay, as none can be named in their place."""
    groups = near_duplicates(docs, key, text)
    kept = groups.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("_kept")).distinct()
    named = docs.where(F.col(key).isNotNull()).join(kept, F.col(key) == F.col("_kept"), "left_semi")
    return named.unionByName(docs.where(F.col(key).isNull()))
