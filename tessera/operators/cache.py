"""A semantic cache of vector candidates: an append-only table, read by similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import params

SCHEMA = "id long, embedding array<double>, vector_results array<struct<chunk_id:long,score:double>>, created_at double, model string, candidate_count int"
#: Added to the product of two lengths; queries compared at once; what matrix products may be off.
MORE, AT_ONCE, NEAR = 1e-9, 1024, 1e-7


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first number to the last: equal vectors have equal ones."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def probe(queries: DataFrame, cache: DataFrame, now: float, model: str, threshold: float = params.CACHE_THRESHOLD, ttl: float = params.CACHE_TTL_S) -> DataFrame:
    """(qid, id, similarity, vector_results): the nearest entry of each query (qid, q_emb, min_candidates) among those that
    are fresh, of the model and large enough, if it is near enough. Of equals the smallest id. The cache is bounded in size.

    The entries that count go to the tasks, where matrix products find what is within NEAR of a query's best; that is
    computed again, number by number. Only hits leave.
    """
    live = cache.where((F.col("created_at") > now - ttl) & (F.col("model") == model) & F.col("embedding").isNotNull() & F.col("candidate_count").isNotNull())
    kind = queries.schema["qid"].dataType.simpleString()
    by_dim: dict[int, list] = {}
    for r in live.select("id", "embedding", "candidate_count").collect():  # as many as the cache holds
        by_dim.setdefault(len(r["embedding"]), []).append(r)
    tables = {}
    for dim, rows in by_dim.items():
        rows.sort(key=lambda r: r["id"])
        matrix = np.array([[np.nan if x is None else x for x in r["embedding"]] for r in rows], np.float64).reshape(len(rows), dim)
        tables[dim] = np.array([r["id"] for r in rows]), matrix, np.sqrt(_dots(matrix, matrix)), np.array([r["candidate_count"] for r in rows])
    shared = queries.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, AT_ONCE) for whole in batches for a in range(0, whole.num_rows, AT_ONCE)):
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy()
            starts = lists.offsets.to_numpy()[:-1]
            flat, least = lists.values.to_numpy(zero_copy_only=False), pc.fill_null(pc.cast(batch.column(2), pa.float64()), np.inf).to_numpy()
            for dim, (ids, matrix, lengths, counts) in shared.value.items():
                at = np.flatnonzero(sizes == dim)
                own = flat[starts[at, None] + np.arange(dim)].astype(np.float64)
                with np.errstate(all="ignore"):
                    size = np.sqrt(_dots(own, own))
                    rough = own @ matrix.T / (size[:, None] * lengths + MORE)
                    rough = np.where(counts >= least[at, None], np.where(np.isnan(rough), np.inf, rough), -np.inf)
                    best = rough.max(1, keepdims=True)
                    row, entry = np.nonzero((rough >= best - NEAR) & (rough > -np.inf))
                    exact = _dots(matrix[entry], own[row]) / (lengths[entry] * size[row] + MORE)
                rank = np.where(np.isnan(exact), np.inf, exact)  # Spark and SQL have NaN above all numbers
                order = np.lexsort((entry, -rank, row))
                first = order[np.unique(row[order], return_index=True)[1]]
                first = first[rank[first] >= threshold]
                if len(first):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[row[first]])), pa.array(ids[entry[first]], pa.int64()), pa.array(exact[first])], ["qid", "id", "similarity"])

    found = queries.select("qid", "q_emb", "min_candidates").mapInArrow(run, f"qid {kind}, id long, similarity double")
    first = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id"))  # a query may stand there twice
    best = found.withColumn("_n", first).where(F.col("_n") == 1).drop("_n")
    return best.join(F.broadcast(live.select("id", "vector_results").dropDuplicates(["id"])), "id").select("qid", "id", "similarity", "vector_results")


def touch(cache: DataFrame, hits: DataFrame, now: float) -> DataFrame:
    """The cache with the entries hit made new."""
    used = hits.select("id").distinct().withColumn("_hit", F.lit(True))
    return cache.join(used, "id", "left").withColumn("created_at", F.when(F.col("_hit"), F.lit(float(now))).otherwise(F.col("created_at"))).drop("_hit")


def put(cache: DataFrame, entries: DataFrame, size: int = params.CACHE_SIZE) -> DataFrame:
    """The cache with new entries, the oldest dropped beyond its size. candidate_count is what was asked for, so that a
    small corpus can hit as well."""
    rows = cache.unionByName(entries.select(cache.columns))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(size)


def clear(cache: DataFrame) -> DataFrame:
    return cache.limit(0)
