import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import separators as S
from tessera.session import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def flat(tmp_path_factory):
    folder, r = tmp_path_factory.mktemp("flat"), np.random.default_rng(2)
    for f in range(3):
        a = r.integers(0, 6, 1000 + f * 7).astype("<u2")
        a[r.random(len(a)) < 0.1] = 9
        a.tofile(folder / f"f{f}")
    np.zeros(0, "<u2").tofile(folder / "f9")
    np.array([9, 9, 9], "<u2").tofile(folder / "f8")
    return folder


@pytest.mark.parametrize("block", [1, 3, 64, 5000])
def test_scan(spark, flat, block):
    expected = []
    for path in flat.iterdir():
        n = k = 0
        for token in np.fromfile(path, "<u2").tolist():
            n += 1
            if token == 9:
                expected.append((path.name, k, n - 1, True))
                n, k = 0, k + 1
        if n:
            expected.append((path.name, k, n, False))
    assert sorted(tuple(x) for x in S.scan(spark, str(flat), 9, 2, block).collect()) == sorted(expected)


def test_bytes_that_look_like_a_separator(spark, tmp_path):
    np.array([0x50AB, 0xCDC4, 0xC450, 0x00C4, 0x5000], "<u2").tofile(tmp_path / "f")
    assert [(x.n_tokens, x.ended) for x in S.scan(spark, str(tmp_path), 0xC450).orderBy("number").collect()] == [(2, True), (2, False)]


def test_counts(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(5000, None), (5001, ""), (None, "x<|endoftext|>y"), (5002, "é" * 10), (5003, "same"), (5003, "same"), (5004, "long " * 100_000)], "doc_id long, text string")
    rows = docs.unionByName(odd).repartition(3)
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    texts = rows.collect()
    expected = sorted((str(x.doc_id), len(e.ids)) for x, e in zip(texts, plain.encode_batch([x.text or "" for x in texts], add_special_tokens=False), strict=True))
    got = S.token_counts(rows.selectExpr("doc_id", "text", "1 file", "2 number"), PATH, 50256)
    assert sorted((str(x.doc_id), x.n_tokens) for x in got.collect()) == expected
    assert S.token_counts(rows.limit(0), PATH, 50256).count() == 0


def test_small_files_keep_their_numbers(spark, monkeypatch):
    monkeypatch.setattr(S, "FILE", 3)
    rows = spark.createDataFrame([(i, "a " * i) for i in range(40)], "doc_id long, text string").repartition(2)
    plain = Tokenizer.from_file(PATH)
    assert {x.doc_id: x.n_tokens for x in S.token_counts(rows, PATH, 50256).collect()} == {i: len(plain.encode("a " * i).ids) for i in range(40)}
