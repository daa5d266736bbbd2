import math
import random
import sqlite3

import pytest

from tessera.functions.porter import porter_tokens, stem, tokens
from tessera.operators import cache, lexical, ranking, vector
from tessera.session import table


def test_stems_of_known_words():
    known = {"running": "run", "ponies": "poni", "relational": "relat", "conflated": "conflat", "generalizations": "gener", "skies": "ski", "dying": "dy", "news": "new", "interrupts": "interrupt"}
    assert {w: stem(w) for w in known} == known
    assert tokens("naïve Été x_y-z3") == ["naiv", "et", "x", "y", "z3"]


def test_stems_as_in_sqlite(spark):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(f, 'row')")
    words = {w for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect() for w in r.text.split()}
    r = random.Random(0)
    ends = ["ational", "tional", "enci", "izer", "logi", "bli", "alli", "ousli", "ization", "ator", "iveness", "aliti", "icate", "ative", "iciti", "ful", "ness", "ement", "ment", "ent", "ion", "ism", "ate", "ing", "ed", "eed", "s", "es", "ies", "y", "e", "ll", ""]
    words |= {"".join(r.choice("bcdeioulrsty") for _ in range(r.randint(1, 6))) + r.choice(ends) for _ in range(6000)}
    bad = []
    for k, word in enumerate(sorted(words)):
        db.execute("delete from f")
        db.execute("insert into f(rowid, t) values (?, ?)", (k + 1, word))
        if (own := sorted(set(tokens(word)))) != (other := sorted(x[0] for x in db.execute("select term from v"))):
            bad.append((word, own, other))
    assert not bad, bad[:20]


TEXTS = ["the quick brown fox", "callee-saved registers are saved", "callee_saved twice callee saved", "saved callee", "Über alles naïve", "fox fox fox jumps", "", "quick quick registers"]


@pytest.mark.parametrize("query", ["fox", "quick fox", "callee-saved", "callee_saved registers", "registers registers", "uber", "-- fox", "--", "absent fox", "saved"])
def test_bm25_as_in_sqlite(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t, tokenize='porter unicode61')")
    db.executemany("insert into f(rowid, t) values (?, ?)", enumerate(TEXTS, 1))
    import re

    match = " ".join(f'"{x}"' for x in re.findall("[a-zA-Z0-9_-]+", query) if len(x) > 1)
    other = {r[0]: abs(r[1]) for r in db.execute("select rowid, bm25(f) from f where f match ?", (match,))} if match else {}
    chunks = spark.createDataFrame(list(enumerate(TEXTS, 1)), "chunk_id long, text string")
    queries = spark.createDataFrame([(7, query)], "qid int, query string")
    own = lexical.bm25(queries, lexical.postings(chunks, porter_tokens), lexical.lengths(chunks, porter_tokens), tokenize=porter_tokens).collect()
    assert {r.chunk_id for r in own} == set(other)
    for r in own:
        assert math.isclose(r.score, other[r.chunk_id], rel_tol=1e-9)
    assert [r.rank for r in sorted(own, key=lambda r: (-r.score, r.chunk_id))] == list(range(1, len(own) + 1))


def test_top_k(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, None), (7, [nan, 1.0]), (8, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "qid int, q_emb array<float>")
    got = [(r.qid, r.chunk_id, r.score) for r in vector.top_k(queries, vectors, 3).orderBy("qid", "rank").collect()]
    assert got == [(1, 2, 1.0), (1, 1, 1.0), (1, 3, 0.0)]
    assert vector.top_k(queries.limit(0), vectors, 3).count() == 0
    assert vector.top_k(queries, vectors, 0).count() == 0
    assert vectors.select(vector.valid(vectors.embedding, 2).alias("v")).where("v").count() == 5
    with pytest.raises(Exception, match="finite"):
        vectors.select(vector.encode(vectors.embedding, 2)).collect()


def ranked(spark, *lists):
    return [spark.createDataFrame([(1, i, 0.5, k) for k, i in enumerate(ids, 1)], "qid int, chunk_id long, score double, rank int") for ids in lists]


def test_rrf(spark):
    got = ranking.rrf(ranked(spark, [1, 2, 3], [3, 2, 1])).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [1, 3, 2]
    assert math.isclose(got[0].score, 1 / 21 + 1 / 23)
    assert ranking.rrf(ranked(spark, [9]), k=0).first().score == 0.5
    assert ranking.rrf(ranked(spark, [5, 6], [7])).count() == 3


def test_fuse_sides(spark):
    near, found = ranked(spark, [1, 2], [2, 3])
    got = {r.chunk_id: r for r in ranking.fuse(near, found).collect()}
    assert math.isclose(got[2].rrf_score, 1 / 22 + 1 / 21) and got[3].embed_score == 0 and got[3].fts_hit and not got[1].fts_hit
    alone = ranking.fuse(near, found.limit(0)).collect()
    assert {r.rrf_score for r in alone} == {0.5}
    assert ranking.fuse(near.limit(0), found).count() == 0


def diversified(spark, rows, limit, decay, schema="doc string, final_score double"):
    names = [x.split()[0] for x in schema.split(", ")]
    frame = spark.createDataFrame([(1, k, *x) for k, x in enumerate(rows, 1)], f"qid int, rank int, {schema}")
    return [(r.doc, round(r.diversity_score, 6)) for r in ranking.diversify(frame.select("qid", "rank", *names), limit, decay).orderBy("rank").collect()]


def test_diversify(spark):
    assert [d for d, _ in diversified(spark, [("a", 10.0), ("a", 9.5), ("b", 9.0)], 3, 0.7)] == ["a", "b", "a"]
    assert [d for d, _ in diversified(spark, [("a", 20.0), ("a", 18.0), ("a", 16.0), ("b", 5.0)], 4, 0.8)] == ["a", "a", "a", "b"]
    assert [d for d, _ in diversified(spark, [("a", 3.0), ("a", 2.0), ("b", 1.0)], 3, 1.0)] == ["a", "a", "b"]
    assert diversified(spark, [("a", 1.0), ("a", -0.4)], 2, 0.7)[1] == ("a", round(-0.28, 6))
    assert diversified(spark, [("a", 1.0)], 0, 0.7) == []
    mixed = diversified(spark, [("a", 9.0, 0.1), ("b", 1.0, 0.9), ("c", 2.0, None)], 3, 0.9, "doc string, final_score double, rerank_score double")
    assert [d for d, _ in mixed] == ["c", "b", "a"]


def test_display(spark):
    frame = spark.createDataFrame([(1, 1, 3.0), (1, 2, 2.0), (1, 3, 1.0), (2, 1, 5.0)], "qid int, rank int, diversity_score double")
    got = {(r.qid, r["rank"]): r.display_score for r in ranking.display(frame).collect()}
    assert got == {(1, 1): 1, (1, 2): 0.5, (1, 3): 0, (2, 1): 1}


def test_pool_keeps_the_first(spark):
    got = [(r.chunk_id, r.list, r.position) for r in ranking.pool(ranked(spark, [1, 2], [2, 3], [3, 4])).orderBy("position").collect()]
    assert got == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 2, 4)]


def test_rerank_ladder():
    calls = []

    def small(query, texts):
        calls.append((len(texts), max(map(len, texts))))
        if sum(map(len, texts)) > 3000:
            raise ranking.TooMuch
        return [(i, float(i)) for i in range(len(texts))]

    assert len(ranking.rerank_ladder("q", ["x" * 5000] * 4, small)) == 4
    assert calls[0] == (4, 5000) and calls[-1] == (4, 600)

    def broken(query, texts):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        ranking.rerank_ladder("q", ["x"], broken)
    with pytest.raises(ranking.TooMuch):
        ranking.rerank_ladder("q", ["x"], lambda q, t: (_ for _ in ()).throw(ranking.TooMuch()))
    assert ranking.rerank_ladder("q", [], small) == []


def test_cache(spark):
    row = lambda i, e, at, n, model="m": (i, e, [(5, 0.5), (6, 0.25)], float(at), model, n)
    entries = spark.createDataFrame([row(1, [1.0, 0.0], 100, 50), row(2, [1.0, 0.0], 100, 50), row(3, [0.0, 1.0], 10, 50), row(4, [1.0, 0.0], 100, 500, "other")], cache.SCHEMA)
    ask = lambda e, n, **kw: cache.probe(spark.createDataFrame([(1, e, n)], "qid int, q_emb array<double>, min_candidates int"), entries, 200.0, "m", ttl=150, **kw).collect()
    hit = ask([1.0, 0.05], 2)[0]
    assert hit.id == 1 and [tuple(x) for x in hit.vector_results] == [(5, 0.5), (6, 0.25)]
    assert ask([1.0, 0.05], 51) == [] and ask([0.0, 1.0], 1) == [] and ask([0.5, 0.8], 1) == []
    assert {r.id: r.created_at for r in cache.touch(entries, spark.createDataFrame([(1,)], "id long"), 300).collect()} == {1: 300, 2: 100, 3: 10, 4: 100}
    kept = cache.put(entries, spark.createDataFrame([row(9, [1.0, 1.0], 400, 9)], cache.SCHEMA), 3)
    assert sorted(r.id for r in kept.collect()) == [2, 4, 9]
    assert cache.clear(entries).count() == 0
