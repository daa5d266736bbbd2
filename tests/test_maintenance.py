from tessera.operators import maintenance as M

CHUNK = "chunk_id long, doc string, start_line int, end_line int, word_count int, text string, is_index boolean, section_no int, embedding array<float>"
PLAN = "doc string, start_line int, end_line int, word_count int, text string, is_index boolean, section_no int"


def test_merge(spark):
    old = spark.createDataFrame([(1, "d", 1, 9, 20, "same", False, 1, [1.0]), (2, "d", 10, 19, 20, "old", False, 1, [2.0]), (3, "d", 20, 29, 20, "moved", False, 1, [3.0]), (4, "d", 30, 39, 20, "gone", False, 1, [4.0]), (5, "d", 1, 9, 20, "double", False, 1, [5.0])], CHUNK)
    new = spark.createDataFrame([("d", 1, 9, 20, "same", False, 1), ("d", 10, 19, 20, "new", False, 1), ("d", 20, 29, 20, "moved", False, 2), ("d", 50, 59, 20, "fresh", False, None)], PLAN)
    once = M.keep_first(old, ["doc", "start_line"], ["chunk_id"])
    plan = {r.start_line: r.action for r in M.merge_plan(once, new, ["end_line", "word_count", "text", "is_index"]).collect()}
    assert plan == {1: "keep", 10: "update", 20: "move", 30: "delete", 50: "insert"}
    merged = M.merge_chunks(old, new)
    got = {r.start_line: (r.chunk_id, r.embedding, r.section_no) for r in merged.collect()}
    assert got == {1: (1, [1.0], 1), 10: (2, None, 1), 20: (3, [3.0], 2), 50: (None, None, None)}
    contexts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "chunk_id long, context string")
    assert sorted(r.chunk_id for r in M.merge_contexts(contexts, merged).collect()) == [1, 3]
    assert sorted(r.chunk_id for r in M.numbered(merged, 100).collect()) == [1, 2, 3, 100]


def test_status_and_labels(spark):
    docs = spark.createDataFrame([("none", None), ("new", 2), ("half", 8), ("done", 1), ("late", 2)], "doc string, expected_chunks int")
    rows = [("new", 1, "abc", None), ("new", 2, "de", None), ("done", 3, "x", [1.0, 2.0]), ("late", 4, "x", [1.0]), ("late", 5, "x", None)] + [("half", 10 + i, "y", None) for i in range(8)]
    chunks = spark.createDataFrame(rows, "doc string, chunk_id long, text string, embedding array<float>")
    contexts = spark.createDataFrame([(3,), (4,), (5,), (10,)], "chunk_id long")
    got = {r.doc: r for r in M.status(docs, chunks, contexts).collect()}
    assert got["none"].label == "pending" and not got["none"].complete and got["none"].chunks == 0
    assert got["new"].label == "context 0%" and got["new"].text_size == 5 and got["new"].complete
    assert got["half"].label == "context 12%"
    assert got["done"].label == "ready" and got["done"].embed_size == 8
    assert got["late"].label == "embed 50%"


def test_signatures(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(M.signature(F.lit("a"), F.lit("b")).alias("s")).first().s == M.signature_of("a", "b")
    now = {"context": "1", "embedding": "2", "chunk": "3"}
    assert not any(M.rebuilds({}, now).values())
    assert M.rebuilds({"context": "0", "embedding": "2", "chunk": "3"}, now) == {"contexts": True, "embeddings": True, "chunks": False}
    assert M.rebuilds({"context": "1", "embedding": "0", "chunk": "0"}, now) == {"contexts": False, "embeddings": True, "chunks": True}


def test_upsert_purge_pending(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "chunk_id long, context string, at int")
    assert {r.chunk_id: r.context for r in M.latest(rows, ["chunk_id"], "at").collect()} == {1: "b", 2: "c"}
    assert M.pending(rows, spark.createDataFrame([(1,)], "chunk_id long")).first().chunk_id == 2
    docs = spark.createDataFrame([("a",), ("b",)], "doc string")
    assert M.purge(docs, docs.where("doc = 'a'")).count() == 1


def test_numbers_have_no_gap(spark):
    rows = spark.createDataFrame([(None, f"d{k % 7}", k) for k in range(50)] + [(3, "x", 1)], "chunk_id long, doc string, start_line int")
    assert sorted(r.chunk_id for r in M.numbered(rows, 10).collect()) == [3, *range(10, 60)]


def test_sections_keep_their_ids(spark):
    old = spark.createDataFrame([(1, "d", 1), (2, "d", 10), (9, "d", 10), (3, "d", 20)], "section_id long, doc string, start_line int")
    new = spark.createDataFrame([("d", 1, "A", 1, 1, 9), ("d", 2, "renamed", 2, 10, 29), ("d", 3, "new", 1, 30, 40), ("e", 1, "x", 1, 1, 2)], "doc string, section_no int, title string, level int, start_line int, end_line int")
    merged = M.merge_sections(old, new)
    assert {(r.doc, r.start_line): r.section_id for r in merged.collect()} == {("d", 1): 1, ("d", 10): 2, ("d", 30): None, ("e", 1): None}
    assert sorted(r.section_id for r in M.numbered(merged, 100, "section_id").collect()) == [1, 2, 100, 101]
