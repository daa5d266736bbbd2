import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import decontaminate, langid, pii, simhash
from tessera.session import table

DATA = "/root/testdata/sf0.001"
REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_stages_against_single_documents(spark):
    docs = table(spark, DATA, "documents")
    assert len(corpus_pipeline.STAGES) == 5
    model = langid.train(docs)
    rows = {r.doc_id: r for r in docs.collect()}
    scorer = langid.Scorer(model)
    kept = {i for i, r in rows.items() if langid.predict(scorer, [r.text])[0][3]}
    groups = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()}
    values = {i: int(groups[i], 16) for i in kept}
    label, moved = {i: i for i in kept}, True
    near = [(a, b) for a in kept for b in kept if a < b and (values[a] ^ values[b]).bit_count() <= 3]
    while moved:
        moved = False
        for a, b in near:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    kept = {i for i in kept if label[i] == i}
    items = [decontaminate.normal(r.text) for r in table(spark, DATA, "benchmark").collect()]
    leaked = {i for i in kept if any(x in decontaminate.normal(rows[i].text) for x in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == kept - leaked and leaked
    for i, r in got.items():
        base = pii.base_spans(rows[i].text)
        assert not any(rows[i].text[a:b] in r.decoded for _, a, b in base if b - a > 11)
        if not re.search(r"[0-9@]|dot", rows[i].text, re.I):
            assert r.decoded == rows[i].text
        assert list(r.ids) == REFERENCE.encode(r.decoded, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_stages_keep_columns_and_odd_rows(spark):
    docs = table(spark, DATA, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (90001, "", "en", "s", 0), (90002, "The and of that to the", None, None, None)], docs.schema)
    rows = docs.unionByName(odd).selectExpr("*", "1 fp", "'x' component_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, rows, DATA)
        assert new.columns == rows.columns, name
        ids = {r.doc_id for r in new.select("doc_id").collect()}
        assert 90002 in ids, name
        rows = spark.createDataFrame(new.collect(), new.schema)
    assert not {90001, None} & ids


def test_empty(spark):
    docs = table(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_no_labels(spark, tmp_path):
    """Without a label there is no model, and a language stage that knows none rejects all."""
    table(spark, DATA, "documents").selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, DATA, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
