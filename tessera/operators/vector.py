"""Exact nearest neighbours by cosine, for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in the queries of one scan (64 MB); queries and vectors scored at once; rows that a task holds before it cuts them
#: down, or twice what it must hold.
NUMBERS, AT_ONCE, VECTORS, HELD = 8_000_000, 256, 4096, 500_000


def valid(embedding: Column, dim: int) -> Column:
    """Whether an embedding has its dimension and only finite values."""
    return F.coalesce((F.size(embedding) == dim) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def cosine(a: Column, b: Column, more: float = 0.0) -> Column:
    """Cosine of two arrays in double precision; null for different sizes or, without `more`, a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + more
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)


def encode(embedding: Column, dim: int) -> Column:
    """An embedding as it may be stored: floats of the right number, all finite; anything else raises."""
    return F.when(valid(embedding, dim), embedding.cast("array<float>")).otherwise(F.raise_error(F.lit(f"an embedding needs {dim} finite values")).cast("array<float>"))


def normalized(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Vectors of length one, made at write time; zero vectors are left out."""
    e = F.transform(embedding, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, v: s + v * v))
    return vectors.where(size > 0).withColumn(embedding, F.transform(e, lambda x: x / size).cast("array<float>"))


class _Best:
    """The best k of each query among the vectors seen: what may still be among them is held, and cut down from time to time."""

    def __init__(self, queries: np.ndarray, numbers: np.ndarray, k: int):
        self.queries, self.numbers, self.k = queries, numbers, k
        self.least = np.full(len(queries), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def see(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        for a in range(0, len(self.queries), AT_ONCE):
            scores, least = self.queries[a : a + AT_ONCE] @ vectors.T, self.least[a : a + AT_ONCE]
            if len(ids) > self.k:  # the k-th of these is no better than the k-th of all
                np.maximum(least, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k], out=least)
            row, column = np.nonzero(scores >= least[:, None])
            self.held.append((row + a, ids[column], scores[row, column]))
            self.size += len(row)
            if self.size > max(HELD, 2 * self.k * len(self.queries)) and len(self.held) > 1:
                self.cut()

    def cut(self) -> None:
        row, ids, scores = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((-ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.least[row[last]] = scores[last]
        keep = place < self.k
        self.held, self.size = [(row[keep], ids[keep], scores[keep])], int(keep.sum())

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.cut()
            row, ids, scores = self.held[0]
            for at in range(0, len(row), 1_000_000):
                part = slice(at, at + 1_000_000)
                yield pa.RecordBatch.from_arrays([pa.array(self.numbers[row[part]], pa.int32()), pa.array(ids[part], pa.int64()), pa.array(scores[part])], ["i", "chunk_id", "score"])


def _loads(queries: DataFrame, qid: str, embedding: str) -> Iterator[list]:
    rows, numbers = [], 0
    for r in queries.where(F.col(embedding).isNotNull()).select(qid, embedding).toLocalIterator():
        rows.append((r[0], r[1]))
        numbers += len(r[1])
        if numbers >= NUMBERS:
            yield rows
            rows, numbers = [], 0
    if rows:
        yield rows


def top_k(queries: DataFrame, vectors: DataFrame, k: int | Column, most: int | None = None, qid: str = "qid", query_embedding: str = "q_emb", key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """(qid, chunk_id, score, rank): the k nearest vectors of each query, by cosine and then id, both descending.

    The queries go to the tasks, where matrix products score each batch of vectors in one scan, and only the best k of a task
    leave. A set of queries that holds more than NUMBERS numbers takes a scan for each such load. Vectors of another
    dimension, null or of length zero are no candidates; a zero query finds nothing.
    k: a number, or a column over the queries with `most` as its bound.
    """
    bound = k if isinstance(k, int) else most
    kind, spark = queries.schema[qid].dataType.simpleString(), queries.sparkSession
    out = None
    for rows in _loads(queries, qid, query_embedding) if bound > 0 else ():
        by_dim = {}
        for dim in {len(e) for _, e in rows}:
            own = np.array([i for i, (_, e) in enumerate(rows) if len(e) == dim])
            matrix = np.array([rows[i][1] for i in own], np.float64)
            size = np.sqrt((matrix * matrix).sum(1))
            if (size > 0).any():
                by_dim[dim] = matrix[size > 0] / size[size > 0, None], own[size > 0]
        shared = spark.sparkContext.broadcast(by_dim)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {dim: _Best(*own, bound) for dim, own in shared.value.items()}
            for batch in (whole.slice(a, VECTORS) for whole in batches for a in range(0, whole.num_rows, VECTORS)):
                lists = batch.column(1)
                starts, sizes = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
                filled = lists.is_valid().to_numpy(zero_copy_only=False)
                flat, ids = lists.values.to_numpy(zero_copy_only=False), batch.column(0).to_numpy()
                for dim, own in best.items():
                    at = np.flatnonzero(filled & (sizes == dim))
                    part = flat[starts[at, None] + np.arange(dim)].astype(np.float64)
                    norms = np.sqrt((part * part).sum(1))
                    good = np.isfinite(norms) & (norms > 0)
                    if good.any():
                        own.see(part[good] / norms[good, None], ids[at[good]])
            for own in best.values():
                yield from own.rows()

        found = vectors.select(F.col(key).cast("long").alias("chunk_id"), F.col(embedding).alias("e")).where("e is not null").mapInArrow(run, "i int, chunk_id long, score double")
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"i int, qid {kind}")
        part = found.join(F.broadcast(names), "i").select("qid", "chunk_id", "score")  # one load of queries
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"qid {kind}, chunk_id long, score double, rank int")
    ranked = out.select("*", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("chunk_id"))).alias("rank")).where(F.col("rank") <= bound)
    if isinstance(k, int):
        return ranked
    return ranked.join(queries.select(F.col(qid).alias("qid"), k.alias("_k")), "qid").where("rank <= _k").drop("_k")
