import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid as L
from tessera.session import table

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.train(table(spark, DATA, "documents"))


def test_held_out_accuracy(spark, model):
    docs = table(spark, DATA, "documents")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = L.identify(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(lang[r.doc_id] == r.lang_pred for r in held) / len(held) >= 0.99
    assert sum(r.accepted for r in got) >= 0.995 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_probabilities_sum_to_one(spark, model):
    scorer = L.Scorer(model)
    texts = [r.text for r in table(spark, DATA, "documents").limit(200).collect()]
    letters = sorted({int(c) for x in texts for c in L.symbols([x])[0]})
    context = L.symbols([texts[0]])[0][50:53]
    values = np.array([[*context, c] for c in letters]).ravel()
    total = np.exp(scorer.position_logs(values, np.arange(3, len(values), 4))).sum(axis=0)
    assert (total > 0.99).all() and (total < 1.0001).all()


def slow(model, text):
    """Cross-entropies one character at a time."""
    values, begins, counts = L.symbols([text])
    out = np.zeros(len(model.languages))
    for i in range(int(begins[0]), int(begins[0] + counts[0])):
        p = np.full((1, len(model.languages)), model.floor)
        for k in range(L.ORDER):
            before = L.hashes(values[i - k : i], k)[-1:] if k else np.zeros(1, np.uint64)
            own = L.hashes(values[i - k : i + 1], k + 1)[-1:]
            if (at := L._rows(model.contexts[k], before)[0]) >= 0:
                p = p * model.weights[k][at]
            if (at := L._rows(model.keys[k], own)[0]) >= 0:
                p = model.probabilities[k][at][None]
        out -= np.log(p[0])
    return out / counts[0]


def test_against_a_slow_scorer(model):
    texts = ["The and of", "la de en été", "xq zzz kk", "Über", "a"]
    found, _, _ = L.Scorer(model, memory=20).entropies(texts)
    for row, text in zip(found, texts, strict=True):
        assert np.allclose(row, slow(model, text))


def test_texts_do_not_touch_each_other(model):
    texts = ["The and of", "", "123", "la de en", "the"]
    together, _, n = L.Scorer(model).entropies(texts)
    for k, text in enumerate(texts):
        assert np.allclose(together[k], L.Scorer(model).entropies([text])[0][0])
    assert n.tolist() == [10, 0, 0, 8, 3]


def test_rejection(model):
    scorer = L.Scorer(model)
    strange = L.predict(scorer, ["xqzj kkwv zzqx jjjj wxyz qqqq vvvv bcdfg hjklm npqrst " * 3, "привет мир как дела сегодня хорошо"])
    assert not any(x[3] for x in strange)
    assert L.predict(scorer, [None, "", "123 !!", "\n"]) == [("und", 0.0, None, False)] * 4


def test_learning_ignores_the_fold_and_labels(spark, model):
    docs = table(spark, DATA, "documents")
    wrong = docs.withColumn("lang", F.when(L.in_fold(), F.lit("xx")).otherwise(F.col("lang"))).unionByName(docs.limit(5).withColumn("lang", F.lit(None).cast("string")))
    again = L.train(wrong)
    assert again.languages == model.languages and all((a == b).all() for a, b in zip(again.keys, model.keys, strict=True))


def test_rows(spark, model):
    rows = spark.createDataFrame([(1, "The and of the that", "zz", 5), (1, "The and of the that", "zz", 5), (None, None, None, 5)], "doc_id long, text string, lang string, score int")
    got = sorted((str(r.doc_id), r.lang_pred, r.held_out) for r in L.identify(rows, model).collect())
    assert [x[1] for x in got] == ["en", "en", "und"] and got[2][2] is False
    assert L.accepted(rows, model).columns == rows.columns and L.accepted(rows, model).count() == 2
    assert L.identify(rows.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(1, "The and of", None), (2, None, None), (None, "x", "en"), (4, "123", "en")], "doc_id long, text string, lang string")
    for docs in (rows, rows.limit(0)):
        model = L.train(docs)
        assert model.languages == []
        assert {(r.lang_pred, r.score, r.cross_entropy, r.accepted) for r in L.identify(docs, model).collect()} <= {("und", 0.0, None, False)}
        assert L.identify(docs, model).count() == docs.count() and L.accepted(docs, model).count() == 0


def test_long_texts_teach(spark):
    docs = [(k, "der die und das ist nicht " * 2000 if k % 2 else "the of and that is not " * 10, "de" if k % 2 else "en") for k in range(40)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = L.train(rows)
    assert model.languages == ["de", "en"] and L.predict(L.Scorer(model), ["und das ist"])[0][0] == "de"


def test_false_acceptance(spark, model):
    """Texts of a language that none of the models knows, whole and in pieces of 60 characters."""
    docs = table(spark, DATA, "documents").where("lang is not null").select("text", "lang").collect()
    for left_out in model.languages:
        known = {k: [r.text for r in docs if r.lang == k][:150] for k in model.languages if k != left_out}
        scorer = L.Scorer(L.fit(known))
        texts = [r.text for r in docs if r.lang == left_out and len(r.text) > 400][:100]
        assert np.mean([x[3] for x in L.predict(scorer, texts)]) <= 0.05, left_out
        assert np.mean([x[3] for x in L.predict(scorer, [x[100:160] for x in texts])]) <= 0.35, left_out
