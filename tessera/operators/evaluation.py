"""Ranking metrics over batches of queries, in long form (qid, category, metric, k, value)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import params
from tessera.functions import text as T

SHOWN = ("ndcg", "mrr", "precision", "map", "recall", "hit_rate", "doc_coverage", "subtopic_recall", "alpha_ndcg")


def _cutoffs(frame: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    return frame.withColumn("k", F.explode(F.array(*(F.lit(k) for k in cutoffs))))


def judged(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Results (qid, chunk_id, doc, rank) with the score of their judgment, 0 without one, and its subtopics. Of repeated
    judgments of a chunk the highest counts."""
    own = qrels.groupBy("qid", "chunk_id").agg(F.max_by("score", "score").alias("score"), F.max_by("subtopics", "score").alias("subtopics")) if "subtopics" in qrels.columns else qrels.groupBy("qid", "chunk_id").agg(F.max("score").alias("score"))
    joined = results.select("qid", "chunk_id", "doc", "rank").join(own, ["qid", "chunk_id"], "left")
    return joined.withColumn("unjudged", F.col("score").isNull()).withColumn("score", F.coalesce("score", F.lit(0)))


def ideal(qrels: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    """(qid, k, ideal_dcg) from all judgments of a query in falling order."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    ranked = qrels.groupBy("qid", "chunk_id").agg(F.max("score").alias("score")).withColumn("i", F.row_number().over(order)).where(F.col("i") <= max(cutoffs))
    return _cutoffs(ranked, cutoffs).where("i <= k").groupBy("qid", "k").agg(F.sum((F.pow(F.lit(2.0), "score") - 1) / F.log2(F.col("i") + 1.0)).alias("ideal_dcg"))


def _long(frame: DataFrame, names: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{x}', `{x}`" for x in names)
    return frame.selectExpr("qid", "k", f"stack({len(names)}, {pairs}) as (metric, value)")


def metrics(queries: DataFrame, results: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = params.CUTOFFS, relevant: int = params.RELEVANT) -> DataFrame:
    """(qid, metric, k, value) for mrr, precision, recall, hit_rate, map, dcg, ndcg and unjudged, for every query of
    `queries`. Precision is divided by k, average precision by the smaller of k and the number of relevant chunks; empty
    denominators give 0."""
    hits = judged(results, qrels).withColumn("rel", (F.col("score") >= relevant).cast("int"))
    so_far = F.sum("rel").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    hits = hits.withColumn("so_far", so_far).where(F.col("rank") <= max(cutoffs))
    gain = (F.pow(F.lit(2.0), "score") - 1) / F.log2(F.col("rank") + 1.0)
    inside = F.col("rank") <= F.col("k")
    found = _cutoffs(hits, cutoffs).where(inside).groupBy("qid", "k").agg(F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum("rel").alias("hits"), F.sum(F.when(F.col("rel") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap"), F.sum(gain).alias("dcg"), F.sum(F.col("unjudged").cast("int")).alias("unjudged"))
    total = qrels.where(F.col("score") >= relevant).groupBy("qid").agg(F.countDistinct("chunk_id").alias("relevant"))
    base = _cutoffs(queries.select("qid").distinct(), cutoffs).join(found, ["qid", "k"], "left").join(total, "qid", "left").join(ideal(qrels, cutoffs), ["qid", "k"], "left")
    n, h = F.coalesce("relevant", F.lit(0)), F.coalesce("hits", F.lit(0))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    dcg = F.coalesce("dcg", F.lit(0.0))
    wide = base.select("qid", "k", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), over(h, F.col("k")).alias("precision"), over(h, n).alias("recall"), (h > 0).cast("double").alias("hit_rate"), over(F.coalesce("ap", F.lit(0.0)), F.least(n, F.col("k"))).alias("map"), dcg.alias("dcg"), over(dcg, F.coalesce("ideal_dcg", F.lit(0.0))).alias("ndcg"), F.coalesce("unjudged", F.lit(0)).cast("double").alias("unjudged"))
    return _long(wide, ["mrr", "precision", "recall", "hit_rate", "map", "dcg", "ndcg", "unjudged"])


def diversity_metrics(queries: DataFrame, results: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = params.CUTOFFS, relevant: int = params.RELEVANT, alpha: float = params.ALPHA) -> DataFrame:
    """(qid, metric, k, value) for doc_coverage, subtopic_recall and alpha_ndcg. qrels have subtopics, which count for chunks
    of at least the relevant score; results have doc. The gain of alpha_ndcg is the score itself, discounted for each
    subtopic seen before, while its ideal is that of ndcg, so it can pass 1."""
    named = qrels.where(F.col("score") >= relevant).select("qid", "chunk_id", F.explode("subtopics").alias("subtopic")).distinct()
    wanted = named.groupBy("qid").agg(F.countDistinct("subtopic").alias("all_subtopics"))
    hits = judged(results, qrels.drop("subtopics")).where(F.col("rank") <= max(cutoffs))
    topics = hits.join(named, ["qid", "chunk_id"], "left")
    seen = F.row_number().over(Window.partitionBy("qid", "subtopic").orderBy("rank")) - 1
    gains = topics.withColumn("gain", F.col("score") * F.when(F.col("subtopic").isNull(), 1.0).otherwise(F.pow(F.lit(1 - alpha), seen)) / F.log2(F.col("rank") + 1.0))
    by_k = _cutoffs(gains, cutoffs).where("rank <= k").groupBy("qid", "k").agg(F.sum("gain").alias("gain"), F.countDistinct("subtopic").alias("covered"), F.countDistinct("doc").alias("docs"))
    base = _cutoffs(queries.select("qid").distinct(), cutoffs).join(by_k, ["qid", "k"], "left").join(wanted, "qid", "left").join(ideal(qrels, cutoffs), ["qid", "k"], "left")
    over = lambda a, b: F.when(F.coalesce(b, F.lit(0.0)) > 0, F.coalesce(a, F.lit(0.0)) / b).otherwise(F.lit(0.0))
    wide = base.select("qid", "k", over(F.col("docs").cast("double"), F.col("k").cast("double")).alias("doc_coverage"), over(F.col("covered").cast("double"), F.col("all_subtopics").cast("double")).alias("subtopic_recall"), over(F.col("gain"), F.col("ideal_dcg")).alias("alpha_ndcg"))
    return _long(wide, ["doc_coverage", "subtopic_recall", "alpha_ndcg"])


def overall(values: DataFrame, queries: DataFrame) -> DataFrame:
    """(metric, k, value): means over all queries that are not of the category negative."""
    return values.join(queries.where("category <> 'negative'").select("qid"), "qid", "left_semi").groupBy("metric", "k").agg(F.avg("value").alias("value"))


def by_category(values: DataFrame, queries: DataFrame) -> DataFrame:
    """(category, metric, k, value, n): means and numbers of queries of every category, negative ones included."""
    return values.join(queries.select("qid", "category"), "qid").groupBy("category", "metric", "k").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def false_positives(values: DataFrame, queries: DataFrame) -> DataFrame:
    """(k, value): mean precision over the negative queries."""
    return values.where("metric = 'precision'").join(queries.where("category = 'negative'").select("qid"), "qid", "left_semi").groupBy("k").agg(F.avg("value").alias("value"))


def over_runs(values: DataFrame) -> DataFrame:
    """Means of (run, category, metric, k, value) over the runs in which each appears."""
    return values.groupBy(*(c for c in values.columns if c not in ("run", "value", "n"))).agg(F.avg("value").alias("value"))


def latency(samples: DataFrame, value: str = "ms", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., p50, p95): the median, and of at least 20 samples the one at 95 hundredths, else the largest. Nulls don't count.
    Equal samples are counted first; no row holds all samples. Without `by`, one task sorts the distinct ones."""
    counted = samples.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    so_far = F.sum("_n").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_to", so_far).withColumn("_all", F.sum("_n").over(group))
    at = lambda k: F.min(F.when(F.col("_to") >= k, F.col("_v")))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    late = F.when(F.col("_all") >= 20, F.floor(F.col("_all") * 0.95) + 1).otherwise(F.col("_all"))
    return placed.groupBy(*by).agg(((at(low) + at(high)) / 2).alias("p50"), at(late).alias("p95"))


def histogram(qrels: DataFrame) -> DataFrame:
    """(score, n, pct) for the scores 0 to 3."""
    scores = qrels.sparkSession.range(4).select(F.col("id").cast("int").alias("score"))
    n = qrels.groupBy("score").agg(F.count("*").alias("n"))
    filled = scores.join(n, "score", "left").select("score", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # four rows
    return filled.select("score", "n", F.when(total > 0, F.col("n") * 100.0 / total).otherwise(0.0).alias("pct"))


def subtopics_of(qrels: DataFrame, relevant: int = params.RELEVANT) -> DataFrame:
    """(qid, subtopics): the distinct subtopics of relevant judgments, in order."""
    return qrels.where(F.col("score") >= relevant).select("qid", F.explode("subtopics").alias("s")).groupBy("qid").agg(F.array_sort(F.collect_set("s")).alias("subtopics"))


def unjudged(pool: DataFrame, qrels: DataFrame) -> DataFrame:
    """What of a pool has no judgment yet."""
    return pool.join(qrels.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")


class Unjudged(ValueError):
    """Results hold chunks without a judgment."""


def strict(results: DataFrame, qrels: DataFrame, shown: int = 5) -> DataFrame:
    """The judgments, if they cover all results; else Unjudged, which counts what is missing and names a few of it."""
    missing = unjudged(results, qrels).select("qid", "chunk_id").distinct()
    if n := missing.count():
        some = ", ".join(f"{r['qid']}/{r['chunk_id']}" for r in missing.orderBy("qid", "chunk_id").limit(shown).collect())
        raise Unjudged(f"{n} results without a judgment, such as {some}")
    return qrels


def autofilled(results: DataFrame, qrels: DataFrame, chunks: DataFrame, queries: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The judgments (qid, chunk_id, score, subtopics, auto_filled), and for results without one what `judge` says of the
    pairs (qid, chunk_id, query, text). Chunks that are not there stay unjudged. Unlike a pool, only results are judged."""
    pairs = unjudged(results, qrels).select("qid", "chunk_id").distinct().join(chunks.select("chunk_id", "text"), "chunk_id").join(queries.select("qid", "query"), "qid")
    own = ("qid", "chunk_id", "score", "subtopics")
    return qrels.select(*own, F.lit(False).alias("auto_filled")).unionByName(judge(pairs.select("qid", "chunk_id", "query", "text")).select(*own, F.lit(True).alias("auto_filled")))


#: Queries of each category in a portfolio, and the terms that one of them takes of its text.
PORTFOLIO = {"exact_lookup": (6, 2), "conceptual": (6, 6), "cross_doc": (8, 8), "natural": (6, 7), "negative": (4, 3)}


def portfolio(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(qid, query, category): thirty queries made from the first texts by id, as many of each category as PORTFOLIO says.
    Those of the category negative ask for terms spelled backwards, which no text holds."""
    bounds, first = [], 1
    for category, (n, terms) in PORTFOLIO.items():
        bounds.append((category, first, first + n - 1, terms))
        first += n
    taken = items.orderBy(key).limit(first - 1)  # the feature's thirty rows
    rows = taken.select(F.col(text).alias("text"), F.row_number().over(Window.orderBy(key)).alias("n"))
    pick = lambda value: F.coalesce(*(F.when(F.col("n").between(a, b), F.lit(value(c, t))) for c, a, b, t in bounds))
    words = F.slice(T.terms(F.col("text")), F.lit(1), pick(lambda c, t: t))
    asked = F.when(pick(lambda c, t: c) == "negative", F.transform(words, F.reverse)).otherwise(words)
    return rows.select(F.format_string("q%02d", "n").alias("qid"), F.array_join(asked, " ").alias("query"), pick(lambda c, t: c).alias("category"))


def probe(embed: Callable[[str], object], search: Callable[[str, object], object], queries: list[str], clock: Callable[[], float] = time.perf_counter) -> list[dict[str, float]]:
    """Milliseconds of embedding, of searching and of both, for each of a few queries one after another. `search` must have
    its result when it returns, so it collects it."""
    out = []
    for query in queries:
        begun = clock()
        vector = embed(query)
        embedded = clock()
        search(query, vector)
        done = clock()
        out.append({"embed_ms": 1000 * (embedded - begun), "search_ms": 1000 * (done - embedded), "total_ms": 1000 * (done - begun)})
    return out


def stale(stored: DataFrame, queries: DataFrame) -> DataFrame:
    """Stored judgments whose query text or category is no longer the same."""
    return stored.join(queries.select("qid", "query", "category"), ["qid", "query", "category"], "left_anti")


def metric(values: dict, k: int) -> float:
    """A value by cutoff of metrics read from JSON, where numbers became strings; 0 if it isn't there."""
    return float(values.get(k, values.get(str(k), 0)))
