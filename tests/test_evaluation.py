import math

import pytest

from tessera.operators import evaluation as E


def values(spark, results, scores, topics=None, docs=None, k=(1, 2, 3)):
    queries = spark.createDataFrame([(1,)], "qid int")
    rows = spark.createDataFrame([(1, c, (docs or {}).get(c, str(c)), i) for i, c in enumerate(results, 1)], "qid int, chunk_id long, doc string, rank int")
    qrels = spark.createDataFrame([(1, c, s, (topics or {}).get(c, [])) for c, s in scores.items()], "qid int, chunk_id long, score int, subtopics array<string>")
    both = E.metrics(queries, rows, qrels, k).unionByName(E.diversity_metrics(queries, rows, qrels, k))
    return {(r.metric, r.k): r.value for r in both.collect()}


def test_gains(spark):
    got = values(spark, [1, 2], {1: 3, 2: 1})
    assert got["dcg", 1] == 7 and math.isclose(got["dcg", 2], 7 + 1 / math.log2(3)) and got["ndcg", 2] == 1


def test_average_precision_and_ranks(spark):
    got = values(spark, [10, 1, 20], {1: 3})
    assert got["map", 3] == 0.5 and got["mrr", 3] == 0.5 and got["mrr", 1] == 0 and got["unjudged", 3] == 2
    assert math.isclose(got["precision", 3], 1 / 3) and got["recall", 3] == 1 and got["hit_rate", 1] == 0
    assert values(spark, [1, 2], {1: 2, 2: 3})["map", 2] == 1


def test_division_is_by_k(spark):
    assert values(spark, [1], {1: 2})["precision", 3] == pytest.approx(1 / 3)


def test_nothing(spark):
    assert set(values(spark, [], {}).values()) == {0.0}
    assert set(values(spark, [0, 1], {}, docs={0: "a", 1: "a"}, k=(2,)).items()) >= {(("doc_coverage", 2), 0.5), (("ndcg", 2), 0.0)}


def test_diversity(spark):
    assert values(spark, [1, 2], {1: 3, 2: 2}, {1: ["a", "b"], 2: ["c"]})["subtopic_recall", 2] == 1
    assert values(spark, [1], {1: 3, 2: 3}, {1: ["a"], 2: ["b"]})["subtopic_recall", 2] == 0.5
    assert math.isclose(values(spark, [1, 2, 3], {}, docs={1: "x", 2: "x", 3: "x"})["doc_coverage", 3], 1 / 3)
    got = values(spark, [0, 1], {0: 3, 1: 3}, {0: ["a"], 1: ["a"]}, k=(2,))["alpha_ndcg", 2]
    assert math.isclose(got, (3 + 1.5 / math.log2(3)) / (7 + 7 / math.log2(3)))


def test_means(spark):
    v = spark.createDataFrame([(1, "precision", 1, 1.0), (2, "precision", 1, 0.0), (3, "precision", 1, 0.5)], "qid int, metric string, k int, value double")
    q = spark.createDataFrame([(1, "x"), (2, "x"), (3, "negative")], "qid int, category string")
    assert E.overall(v, q).first().value == 0.5 and E.false_positives(v, q).first().value == 0.5
    assert {r.category: (r.value, r.n) for r in E.by_category(v, q).collect()} == {"x": (0.5, 2), "negative": (0.5, 1)}
    runs = spark.createDataFrame([(1, "m", 1, 1.0), (2, "m", 1, 0.0)], "run int, metric string, k int, value double")
    assert E.over_runs(runs).first().value == 0.5


def test_latency(spark):
    few = spark.createDataFrame([(float(x),) for x in (1, 2, 9, 4, 5)], "ms double")
    assert tuple(E.latency(few).first()) == (4.0, 9.0)
    many = spark.createDataFrame([(float(x),) for x in range(100)], "ms double")
    assert tuple(E.latency(many).first()) == (49.5, 95.0)


def test_latency_by_key(spark):
    rows = [(k, float(x)) for k in (1, 2) for x in range(100 * k)] + [(3, 7.0), (3, 7.0), (3, 1.0), (3, None), (4, None)]
    frame = spark.createDataFrame(rows, "user_id int, ms double")
    assert sorted(map(tuple, E.latency(frame, by=("user_id",)).collect())) == [(1, 49.5, 95.0), (2, 99.5, 190.0), (3, 7.0, 7.0)]
    assert tuple(E.latency(frame.limit(0)).first()) == (None, None)
    assert "collect_list" not in E.latency(frame)._jdf.queryExecution().toString()


def test_whole_tables(spark):
    """Every user, item and vector is in the queries over whole tables."""
    from tessera.plans import registry
    from tessera.session import table

    d = "/root/testdata/sf0.001"
    users = table(spark, d, "events").where("value is not null").select("user_id").distinct().count()
    assert registry.QUERIES["latency_by_user"](spark, d).count() == users > 1
    items = table(spark, d, "benchmark").count()
    assert len({r.qid for r in registry.QUERIES["exact_bonus"](spark, d).collect()}) == items
    assert any(r.qid >= 100 for r in registry.QUERIES["cache_lookup"](spark, d).collect())


def test_histogram_and_labels(spark):
    q = spark.createDataFrame([(1, 1, 3, ["b", "a"]), (1, 2, 3, ["a"]), (1, 3, 0, ["z"])], "qid int, chunk_id long, score int, subtopics array<string>")
    assert [(r.score, r.n) for r in E.histogram(q).orderBy("score").collect()] == [(0, 1), (1, 0), (2, 0), (3, 2)]
    assert E.subtopics_of(q).first().subtopics == ["a", "b"]
    assert E.metric({"5": 0.25}, 5) == 0.25 and E.metric({5: 1}, 5) == 1 and E.metric({}, 5) == 0


def test_strict_and_probe(spark):
    results = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "qid int, chunk_id long")
    qrels = spark.createDataFrame([(1, 5, 3, []), (2, 7, 0, [])], "qid int, chunk_id long, score int, subtopics array<string>")
    with pytest.raises(E.Unjudged, match="1 results .* 1/6"):
        E.strict(results, qrels)
    assert E.strict(results.where("chunk_id <> 6"), qrels) is qrels
    now = iter(range(100))
    assert E.probe(len, lambda q, v: None, ["a", "b"], clock=lambda: next(now)) == [{"embed_ms": 1000.0, "search_ms": 1000.0, "total_ms": 2000.0}] * 2


def test_portfolio(spark):
    items = spark.createDataFrame([(k, f"one two three four five six seven eight nine t{k}") for k in range(40)], "item_id long, text string")
    rows = E.portfolio(items).collect()
    assert {c: sum(r.category == c for r in rows) for c in E.PORTFOLIO} == {"exact_lookup": 6, "conceptual": 6, "cross_doc": 8, "natural": 6, "negative": 4}
    assert len({r.qid for r in rows}) == 30 and {r.query for r in rows if r.category == "negative"} == {"eno owt eerht"}
