"""Removal of repeated substrings, by sorting the suffixes at sampled places deep and shallow.

A byte goes if a string of WIDTH bytes covers it that also starts anywhere else. Suffixes are sampled by content: of the
hashes of GRAM bytes in every window of WIDTH bytes the smallest is an anchor, so equal windows hold an anchor at the same
place, and two windows can only be equal if their anchors' grams are. Anchors carry a hash of 128 bits of their surroundings, the
bytes that all windows with this anchor can reach, which stands for these bytes. Only grams that occur again go on:

- surroundings that occur twice are repeated as a whole, and need no further look;
- of other surroundings of a repeated gram one each is read, with one for each repeated sort. In a group of one gram the
  suffixes from the anchor and the prefixes up to it, reversed, are sorted by deep-shallow sorting. The window that begins o
  bytes before the anchor is repeated if another anchor shares o bytes to the left and WIDTH - o to the right: for each o,
  neighbours in either order fall into classes by their common prefixes, and pairs of classes that occur twice are repeated.

A gram with more kinds of surroundings than a task should hold is not sorted: its windows are hashed and counted, dealt out
by hash. All else is counted, joined or sorted by gram or document, and no step holds more than one document or group.

What steps hand on is written to the shared folder only where its shuffle files should go at once, as Hadoop starts a
process for each file and folder that it writes locally. Anchors and counts stay on the executors' disks and are made again
if one is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, release, shared_dir, slices
from tessera.llm.deep_shallow import sort_groups

WIDTH, GRAM = 200, 64
#: Kinds of surroundings of one gram that are sorted in one task; bytes scanned at once.
MOST, BYTES = 20_000, 250_000
#: Rows of a key that are joined by themselves: more than this and more than a thousandth of all.
HOT = 10_000
_LEFT = WIDTH - GRAM
_ONE = 0x9E3779B97F4A7C15


class _Sums:
    """Prefix sums that give the hash of any stretch of a buffer."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        if base not in self.powers or len(self.powers[base][0]) <= n:
            size = 1 << (n + 1).bit_length()
            up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        up, self.down = self.powers[base]
        mixed = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= up[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed, out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (self.sums[end] - self.sums[start]) * self.down[start]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(30)
        return out


def _places(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of joined texts, in order, and the hashes of their grams. Which place of a window is its anchor depends on
    the window's bytes alone: that of the smallest hash, the last of equal ones."""
    first = _Sums(data, _ONE)
    at = np.arange(len(data) - GRAM + 1, dtype=np.int32)
    grams = first.between(at, at + GRAM)
    least, where, span = grams, at, 1  # a sliding minimum of doubled spans

    def lower(by: int) -> tuple[np.ndarray, np.ndarray]:
        later = least[by:] <= least[:-by]
        return np.minimum(least[by:], least[:-by]), np.where(later, where[by:], where[:-by])

    while 2 * span <= _LEFT + 1:
        least, where = lower(span)
        span *= 2
    if rest := _LEFT + 1 - span:
        least, where = lower(rest)
    change = np.zeros(len(data) + 1, np.int32)
    long = ends - begins >= WIDTH
    np.add.at(change, begins[long], 1)
    np.add.at(change, ends[long] - WIDTH + 1, -1)
    found = where[np.cumsum(change)[: len(where)] > 0].astype(np.int64)
    found = found[np.diff(found, prepend=-1) != 0]
    return found, grams[found].view(np.int64)


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, place, gram's hash, two halves of a hash of the surroundings, bytes to the right) of every anchor."""
    found: list[tuple[np.ndarray, ...]] = []
    for a, b in slices([len(x) for x in texts], BYTES):
        sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
        if b == a + 1 and sizes[0] > BYTES:  # one long text, in slices that share what a window needs
            last = -1
            for start in range(0, len(texts[a]) - WIDTH + 1, BYTES):
                data = np.frombuffer(texts[a], np.uint8, min(BYTES + WIDTH - 1, len(texts[a]) - start), start)
                at, gram = _places(data, np.zeros(1, np.int64), np.array([len(data)]))
                keep = at + start > last
                at, gram = at[keep] + start, gram[keep]
                last = int(at[-1]) if len(at) else last
                found.append((np.full(len(at), a), at, gram))
        elif sizes.sum() >= WIDTH:
            ends = np.cumsum(sizes)
            at, gram = _places(np.frombuffer(b"".join(texts[a:b]), np.uint8), ends - sizes, ends)
            text = np.searchsorted(ends, at, side="right")
            found.append((a + text, at - (ends - sizes)[text], gram))
    if not found:
        return (np.zeros(0, np.int64),) * 6
    text, place, gram = (np.concatenate(x) for x in zip(*found, strict=True))
    size = np.fromiter(map(len, texts), np.int64, len(texts))[text]
    start, end = np.maximum(0, place - _LEFT), np.minimum(size, place + WIDTH)
    digest = xxhash.xxh3_128_digest
    sums = b"".join(digest(texts[t][i:j], p - i) for t, i, j, p in zip(text.tolist(), start.tolist(), end.tolist(), place.tolist(), strict=True))
    halves = np.frombuffer(sums, np.int64).reshape(-1, 2)
    return text, place, gram, halves[:, 0], halves[:, 1], end - place


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, t, doc, text): id and t name a row, and equal rows alike."""
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.xxhash64(content)).alias("id"), F.hash(content).alias("t"), F.col(key).cast("long").alias("doc"), content.alias("text"))


def _anchors(keyed: DataFrame) -> DataFrame:
    def make():
        def apply(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in slices(pc.binary_length(batch.column(2)).to_pylist(), 4 * BYTES):
                text, place, gram, one, two, right = anchors_of([x.encode() for x in batch.column(2).slice(a, b - a).to_pylist()])
                columns = (gram, ids[a + text], ts[a + text], place.astype(np.int32), one, two, right.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["gram", "id", "t", "place", "around", "around2", "right"])

        return apply

    return map_batches(keyed.select("id", "t", "text"), "gram long, id long, t int, place int, around long, around2 long, right int", make)


def _surroundings(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes around one anchor of each kind; the join is by row, and a row's list is no longer than its text."""
    lists = wanted.groupBy("id", "t").agg(F.collect_list(F.struct("gram", "place", "right", "n")).alias("own"))
    found = keyed.join(lists, ["id", "t"]).select("id", "t", F.col("text").cast("binary").alias("text"), "own.gram", "own.place", "own.right", "own.n")
    ddl = "gram long, id long, t int, place int, n int, before binary, after binary"

    def make():
        def apply(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            for a, b in slices(pc.binary_length(batch.column(2)).to_pylist(), 4 * BYTES):
                rows = []
                for i, t, text, grams, places, rights, ns in zip(*(c.slice(a, b - a).to_pylist() for c in batch.columns), strict=True):
                    rows += [(g, i, t, p, n, text[max(0, p - _LEFT) : p], text[p : p + r]) for g, p, r, n in zip(grams, places, rights, ns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in ddl.split(", ")])

        return apply

    return map_batches(found, ddl, make)


def repeated_windows(groups: np.ndarray, before: list[bytes], after: list[bytes], n: np.ndarray) -> np.ndarray:
    """For each anchor and each o up to _LEFT, whether the window that begins o bytes before the anchor is in the same group
    again. Equal numbers in groups stand together; n: how often the anchor's surroundings occur."""
    size = len(before)
    grams = {}
    exact = np.fromiter((grams.setdefault((int(g), a[:GRAM]), len(grams)) for g, a in zip(groups, after, strict=True)), np.int64, size)
    right_order, right_shared = sort_groups([x[GRAM:] for x in after], exact)
    left_order, left_shared = sort_groups([x[::-1] for x in before], exact)
    new_right = np.r_[True, exact[right_order][1:] != exact[right_order][:-1]]
    new_left = np.r_[True, exact[left_order][1:] != exact[left_order][:-1]]
    left_size = np.fromiter(map(len, before), np.int64, size)
    right_size = np.fromiter(map(len, after), np.int64, size)
    weight, out = np.minimum(n, 2), np.zeros((size, _LEFT + 1), bool)
    right_class, left_class = np.empty(size, np.int64), np.empty(size, np.int64)
    for o in range(_LEFT + 1):
        right_class[right_order] = np.cumsum(new_right | (right_shared + GRAM < WIDTH - o))
        left_class[left_order] = np.cumsum(new_left | (left_shared < o))
        rows = np.flatnonzero((left_size >= o) & (right_size >= WIDTH - o))
        _, which = np.unique(right_class[rows] * (size + 1) + left_class[rows], return_inverse=True)
        out[rows, o] = np.bincount(which, weight[rows])[which] > 1 if len(rows) else False
    return out


def _sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (id, t, start, end) of surroundings that occur once, from rows in the order of grams; all of a gram come to one
    task, their number is bounded."""

    def spans(rows: list) -> pa.RecordBatch:
        grams, ids, ts, places, n = (np.concatenate([x[k] for x in rows]) for k in range(5))
        before, after = ([y for x in rows for y in x[k]] for k in (5, 6))
        once = np.flatnonzero(n == 1)
        found = np.zeros((len(once), _LEFT + 3), np.int8)
        found[:, 1:-1] = repeated_windows(grams, before, after, n)[once]
        move = np.diff(found, axis=1)
        row, least = np.nonzero(move == 1)
        _, past = np.nonzero(move == -1)  # runs of o: least to past - 1
        at = once[row]
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ts[at]), pa.array((places[at] - past + 1).astype(np.int32)), pa.array((places[at] - least + WIDTH).astype(np.int32))], ["id", "t", "start", "end"])

    held, size = [], 0
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]] + [c.to_pylist() for c in batch.columns[5:]]
        at = 0
        grams = columns[0]
        cuts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]).tolist()
        if held and len(grams) and held[-1][0][-1] == grams[0]:
            cuts = cuts[1:]
        for cut in cuts:  # a gram begins: what is held may be done
            if size + cut - at >= MOST:
                if cut > at:
                    held.append([x[at:cut] for x in columns])
                yield spans(held)
                held, size, at = [], 0, cut
        if at < len(grams):
            held.append([x[at:] for x in columns])
            size += len(grams) - at
    if held:
        yield spans(held)


def _windows(rows: DataFrame) -> DataFrame:
    """Every window of the surroundings with a hash of 128 bits; a few hundred rows at a time, as each gives up to 137."""
    ddl = "id long, t int, start int, n int, one long, two long"

    def make():
        def apply(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            for a in range(0, batch.num_rows, 500):
                out: list[tuple] = []
                for gram, i, t, place, n, before, after in zip(*(c.slice(a, 500).to_pylist() for c in batch.columns), strict=True):
                    text, left = before + after, len(before)
                    for o in range(max(0, WIDTH - len(after)), left + 1):
                        digest = xxhash.xxh3_128_intdigest(text[left - o : left - o + WIDTH], seed=gram & 0xFFFFFFFF)
                        out.append((i, t, place - o, n, (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in ddl.split(", ")])

        return apply

    return map_batches(rows, ddl, make)


def _counted_spans(rows: DataFrame) -> DataFrame:
    """The same spans for grams of very many surroundings, by counting the hashes of their windows."""
    windows = _windows(rows)
    again = windows.groupBy("one", "two").agg(F.sum("n").alias("all")).where("all > 1").select("one", "two")
    return windows.where("n = 1").join(again, ["one", "two"]).select("id", "t", "start", (F.col("start") + WIDTH).cast("int").alias("end"))


def _of_keys(rows: DataFrame, counted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The rows whose keys are in a table of keys with counts. Keys of more than HOT rows and of more than a thousandth of
    all, of which there are less than a thousand, go to every task, so that no key is dealt out to one."""
    most = max(HOT, total // 1000)
    hot = F.broadcast(counted.where(F.col("count") > most).select(keys))
    if hot.isEmpty():
        return rows.join(counted.select(keys), keys, "left_semi")
    others = rows.join(hot, keys, "left_anti").join(counted.where(F.col("count") <= most).select(keys), keys, "left_semi")
    return rows.join(hot, keys, "left_semi").unionByName(others)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """(id, t, starts, ends): stretches of repeated windows in the rows of _keyed() that have any."""
    spark = docs.sparkSession
    keyed = _keyed(docs, key, text)
    places = {x: shared_dir(spark, f"substrings-{x}") for x in ("again", "around", "spans")}
    kept: list[DataFrame] = []

    def keep(rows: DataFrame) -> tuple[DataFrame, int]:
        kept.append(rows.persist(StorageLevel.DISK_ONLY))
        return rows, rows.count()

    def drop(*names: str) -> None:
        while kept:
            kept.pop().unpersist(True)
        release(spark, *(places[x] for x in names))

    try:
        anchors, total = keep(_anchors(keyed))
        grams, _ = keep(anchors.groupBy("gram").count().where("count > 1"))
        _of_keys(anchors, grams, ["gram"], total).write.parquet(places["again"])
        del anchors, grams
        drop()
        again = spark.read.parquet(places["again"])
        kinds, _ = keep(again.groupBy("gram", "around", "around2").agg(F.count("*").alias("count"), F.min(F.struct("id", "t", "place", "right")).alias("one")))
        # surroundings that occur twice
        left = F.least(F.lit(_LEFT), F.col("place"))
        whole = _of_keys(again, kinds.where("count > 1"), ["gram", "around", "around2"], total).where(left + F.col("right") >= WIDTH)
        found = whole.select("id", "t", (F.col("place") - left).cast("int").alias("start"), (F.col("place") + F.col("right")).cast("int").alias("end"))
        # others, in groups of one gram
        several, _ = keep(kinds.groupBy("gram").count().where("count > 1"))
        hot = F.broadcast(several.where(F.col("count") > most).select("gram"))
        wanted = kinds.join(several.where(F.col("count") <= most).select("gram"), "gram", "left_semi")
        columns = ("gram", "one.*", F.least("count", F.lit(2)).cast("int").alias("n"))
        width = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
        around = _surroundings(keyed, wanted.select(*columns)).repartition(width, "gram").sortWithinPartitions("gram")
        found = found.unionByName(around.mapInArrow(_sorted_spans, "id long, t int, start int, end int"))
        if not hot.isEmpty():
            _surroundings(keyed, kinds.join(hot, "gram", "left_semi").select(*columns)).write.parquet(places["around"])
            found = found.unionByName(_counted_spans(spark.read.parquet(places["around"])))
        found.groupBy("id", "t").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")).write.parquet(places["spans"])
        del around, found, whole, again, kinds, several, hot, wanted
    finally:
        drop("again", "around")
    return spark.read.parquet(places["spans"])


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs that spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """(key long, n_bytes long, kept binary, starts array<int>, ends array<int>) of every row: what is left, and the maximal
    runs that were removed, as byte offsets.

    Texts are their UTF-8 bytes, null is empty. Strings are judged on the input, matches do not cross rows, and repeated rows
    are repeats of one another. What is left need not be valid UTF-8. Rows without an id take part. Other columns are not
    looked at. An empty table gives an empty result.
    """
    rows = _keyed(docs, key, text).join(spans(docs, key, text, most), ["id", "t"], "left").select("doc", F.col("text").cast("binary"), "starts", "ends")
    ddl = "id long, n_bytes long, kept binary, starts array<int>, ends array<int>"

    def make():
        def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, kept, first, last = [], [], [], []
            for data, starts, ends in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                runs = merged(starts or [], ends or [])
                at, parts = 0, []
                for a, b in runs:
                    parts.append(data[at:a])
                    at = b
                sizes.append(len(data))
                kept.append(b"".join([*parts, data[at:]]))
                first.append([a for a, _ in runs])
                last.append([b for _, b in runs])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(first, pa.list_(pa.int32())), pa.array(last, pa.list_(pa.int32()))], [x.split()[0] for x in ddl.split(", ")])

        def apply(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for a, b in slices(pc.binary_length(batch.column(1)).to_pylist(), 4 * BYTES):
                yield of_slice(batch.slice(a, b - a))

        return apply

    return map_batches(rows, ddl, make).withColumnRenamed("id", key)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) from what remove_repeated() leaves."""
    left = remove_repeated(docs, key, text)
    return left.select(key, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
