"""Steps that must not deal out more rows as tables grow: their plans, and results against the plain way."""

import re

import numpy as np
import pytest

from tessera.functions.porter import fold, plain_tokens, porter_tokens
from tessera.operators import lexical
from tessera.plans import registry

DATA = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def dealt(frame) -> set[str]:
    """Columns by which a plan deals out rows."""
    return {re.sub(r"#\d+L?", "", c) for c in re.findall(r"hashpartitioning\((.*?), \d+\)", plan(frame))}


TEXTS = ["the quick brown fox", "callee-saved registers are saved", "callee_saved twice callee saved", "saved callee", "Über alles naïve", "fox fox fox jumps", "", "quick quick registers", None, "the the the", "a the the"]
QUERIES = ["fox", "quick fox", "callee-saved", "callee_saved registers", "registers registers", "uber", "-- fox", "--", "absent fox", "saved", "the-the", "the-the the", "fox-fox"]


@pytest.mark.parametrize("tokenize", [plain_tokens, porter_tokens])
@pytest.mark.parametrize("limit", [None, 1, 3])
def test_search_as_by_an_index(spark, monkeypatch, tokenize, limit):
    for name, value in (("TOKENS", 5), ("CELLS", 40), ("HELD", 4)):  # many slices and cuts
        monkeypatch.setattr(lexical, name, value)
    chunks = spark.createDataFrame(list(enumerate(TEXTS * 2, 1)), "chunk_id long, text string").repartition(3)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "qid int, query string")
    rows = lambda frame: sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 12)) for r in frame.collect())
    plain = rows(lexical.bm25(queries, lexical.postings(chunks, tokenize), lexical.lengths(chunks, tokenize), limit, tokenize))
    assert plain and rows(lexical.search(queries, chunks, limit, tokenize)) == plain
    monkeypatch.setattr(lexical, "PHRASES", 3)
    assert rows(lexical.search(queries, chunks, limit, tokenize)) == plain


def test_counts_of_phrases_end_with_their_row():
    words = np.array([0, 1, 0, 1, -1, 0, 0, 0])
    got = lexical._counts(words, np.array([3, 0, 2, 3]), [(0, 1), (1, 0), (0,), (0, 0)])
    assert got.tolist() == [[1, 1, 2, 0], [0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 3, 2]]


@pytest.mark.parametrize("name", ["bm25_and", "bm25_phrase", "bm25_porter"])
def test_full_text_search_deals_out_results_only(spark, name):
    assert dealt(registry.QUERIES[name](spark, DATA)) == {"qid"}


def test_marks_are_taken_from_letters_of_any_script():
    assert fold("ÉáÅẛ̣ İ 한 \U0001e8d0x" + "é" * 99) == "eaaſ i 한 x" + "e" * 99


def test_cache_compares_no_pairs_of_rows(spark):
    from tessera.operators import cache

    vectors = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [3.0, 3.0], [0.0, 0.0], [1.0, 0.0, 0.0]]
    entries = spark.createDataFrame([(9 - k, e, [(k, 0.5)], 100.0, "m", 10 + k % 2) for k, e in enumerate(vectors)], cache.SCHEMA)
    asked = [[1.0, 0.0], [0.1, 2.0], [1.0, 1.0], [0.0, 0.0], [2.0, 0.0, 0.0], [-1.0, 0.0], None, [1.0], [1.0, 0.0]]
    queries = spark.createDataFrame([(k % 8, e, 11 if k == 8 else 10) for k, e in enumerate(asked)], "qid int, q_emb array<float>, min_candidates int").repartition(3)
    found = cache.probe(queries, entries, 200.0, "m", ttl=150)
    assert sorted((r.qid, r.id, round(r.similarity, 6), r.vector_results[0].chunk_id) for r in found.collect()) == [(0, 8, 1.0, 1), (1, 7, 0.998752, 2), (2, 6, 1.0, 3), (4, 4, 1.0, 5)]
    assert "NestedLoop" not in plan(found) and "NestedLoop" not in plan(registry.QUERIES["cache_lookup"](spark, DATA))


def test_postings_are_made_where_the_text_is(spark):
    chunks = spark.createDataFrame(list(enumerate(TEXTS * 2, 1)), "chunk_id long, text string").repartition(3)
    rows = lambda frame: sorted((r.term, r.chunk_id, r.tf, r.dl, tuple(r.positions)) for r in frame.select("term", "chunk_id", "tf", "dl", "positions").collect())
    made = lexical.postings(chunks)
    plain = {}
    for k, text in enumerate(TEXTS * 2, 1):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for at, word in enumerate(words):
            plain.setdefault((word, k, len(words)), []).append(at)
    assert rows(made) == sorted((word, k, len(at), n, tuple(at)) for (word, k, n), at in plain.items())
    assert dealt(made) == set()
    twice = lexical.postings(chunks.union(chunks))
    assert rows(twice) == sorted((word, k, 2 * len(at), n, tuple(sorted(at * 2))) for (word, k, n), at in plain.items())
    assert rows(lexical.postings(chunks.where("text is null"))) == rows(lexical.postings(chunks.limit(0))) == []


@pytest.mark.parametrize("name", ["postings", "postings_after_merge"])
def test_an_index_deals_out_no_postings(spark, name):
    assert not any("chunk_id" in x and "term" in x for x in dealt(registry.QUERIES[name](spark, DATA)))
    assert "SortMergeJoin" not in plan(registry.QUERIES[name](spark, DATA))
