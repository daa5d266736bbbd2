import os
import time

import pytest

from tessera.sources import files, store
from tessera.streaming import ingest


def test_discover_and_markdown(spark, tmp_path):
    docs, data = tmp_path / "docs", tmp_path / "data"
    docs.mkdir()
    data.mkdir()
    (docs / "b.pdf").write_bytes(b"12345")
    (docs / "A.pdf").write_bytes(b"12345")
    (docs / "c.pdf").write_bytes(b"1")
    (docs / "x.txt").write_text("no")
    (data / "b.md").write_text("# B\n", encoding="utf-8")
    (data / "only me.md").write_text("é", encoding="utf-8")
    os.utime(data / "b.md", (time.time() - 999,) * 2)
    got = files.discover(spark, str(docs), str(data)).collect()
    assert [(r.name, r.size, r.stale) for r in got] == [("c", 1, False), ("only me", 2, False), ("A", 5, False), ("b", 5, True)]
    assert files.discover(spark, str(tmp_path / "none"), str(data)).count() == 2
    assert {r.doc: r.md for r in files.read_markdown(spark, str(data)).collect()} == {"b": "# B\n", "only me": "é"}
    taken = files.extract(spark, str(docs / "*.pdf"), lambda: lambda content, path: content.decode() * 2)
    assert {r.name: r.md for r in taken.collect()}["c"] == "11"
    assert files.export_markdown(taken.withColumnRenamed("name", "doc"), str(tmp_path / "out")) == 3


def test_projects(tmp_path):
    home = tmp_path / "Search"
    home.mkdir()
    p = store.Projects(str(tmp_path / "p.json"), str(tmp_path / "data"))
    assert p.add(str(home))["id"] == "search-2" and p.add(str(home))["id"] == "search-2"
    with pytest.raises(ValueError):
        p.add(str(tmp_path / "missing"))
    other = tmp_path / "o"
    other.mkdir()
    with pytest.raises(ValueError):
        p.add(str(other), "index")
    assert p.get(str(home))["id"] == "search-2" and p.get("nothing") is None
    assert p.activate("search-2")["docs_dir"] == str(home) and p.data_dir("search-2").is_dir()
    with pytest.raises(KeyError):
        p.activate("nothing")
    assert p.remove("search-2") and not p.data_dir("search-2").exists() and not p.remove("search-2")
    for bad in ('{"projects": [{"id": ""}]}', '{"projects": [{"id": "Search", "docs_dir": "/a"}]}', '{"projects": [{"docs_dir": "/x/a"}, {"id": "a", "docs_dir": "/b"}]}', "{", "[]"):
        (tmp_path / "p.json").write_text(bad)
        with pytest.raises(ValueError):
            p.all()
    (tmp_path / "p.json").write_text('{"projects": [{"id": " ", "docs_dir": "/x/Manuals"}, {"id": "b", "docs_dir": "/y"}]}')
    assert p.all() == [{"id": "Manuals", "docs_dir": "/x/Manuals"}, {"id": "b", "docs_dir": "/y"}]


def test_meta_results_and_truth(spark, tmp_path):
    m = store.Meta(str(tmp_path / "meta.json"))
    assert m.get("a") is None
    m.set("a", "1")
    m.set("a", "2")
    assert m.get("a") == "2"
    values = spark.createDataFrame([("ndcg", 10, 0.5), ("ndcg", 1, 1.0)], "metric string, k int, value double")
    store.save_result(str(tmp_path / "r"), "run", values, runs=3)
    (tmp_path / "r" / "bad.json").write_text("{")
    got, bad = store.results(str(tmp_path / "r"))
    assert bad == 1 and got[0]["metrics"]["ndcg"] == {"1": 1.0, "10": 0.5} and got[0]["runs"] == 3
    q = spark.createDataFrame([("1", "a b", "x", ["s"])], "qid string, query string, category string, subtopics array<string>")
    j = spark.createDataFrame([("1", 5, "d", 3, 0.5, ["s"], "r")], "qid string, chunk_id long, doc string, score int, confidence double, subtopics array<string>, reason string")
    store.save_ground_truth(q, j, str(tmp_path / "g.json"))
    queries, qrels = store.ground_truth(spark, str(tmp_path / "g.json"))
    assert queries.first().query == "a b" and qrels.first().score == 3
    (tmp_path / "h.json").write_text("not json")
    assert store.ground_truth(spark, str(tmp_path / "h.json")) is None and store.ground_truth(spark, str(tmp_path / "none.json")) is None


def test_tables(spark):
    store.create_tables(spark, "tessera_test")
    store.create_tables(spark, "tessera_test")
    assert store.open_table(spark, "tessera_test", "chunks").columns[0] == "chunk_id"
    spark.sql("DROP DATABASE tessera_test CASCADE")


def test_ingest(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "store", "state"))
    text = lambda n: "# T\n" + "word " * n
    write = lambda rows: spark.createDataFrame(rows, "doc string, md string").coalesce(1).write.mode("append").parquet(source)
    write([("a", text(30)), ("b", text(40))])
    ingest.ingest(spark, source, target, state).awaitTermination()
    first = spark.read.parquet(f"{target}/v=1")
    assert sorted((r.doc, r.chunk_id) for r in first.collect()) == [("a", 1), ("b", 2)]
    write([("b", text(50)), ("c", text(60))])
    ingest.ingest(spark, source, target, state).awaitTermination()
    second = {r.doc: (r.chunk_id, r.word_count) for r in spark.read.parquet(f"{target}/v=2").collect()}
    assert second == {"a": (1, 32), "b": (2, 52), "c": (3, 62)}
