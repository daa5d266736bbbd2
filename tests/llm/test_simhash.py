import re

import numpy as np
import pytest
import xxhash

from tessera.llm import components as C
from tessera.llm import simhash as S
from tessera.session import table


def plain_fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(values, ids=None):
    """Smallest id (or value) of each value's component, by comparing all with all."""
    label = np.array(ids if ids is not None else values.view(np.int64))
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= 3) for v in values]
    moved = True
    while moved:
        moved = False
        for n in near:
            low = label[n].min()
            if (label[n] != low).any():
                label[n] = low
                moved = True
    return label


def test_fingerprints(spark):
    texts = [None, "", "one", "One  two", "a b c", "A\tB\nC d e a b c a b c", "é É x y", "x\x1cy z\xa0w v", *(r.text for r in table(spark, "/root/testdata/sf0.001", "documents").limit(40).collect())]
    assert S.fingerprints_of(texts).tolist() == [plain_fingerprint(x) for x in texts]


def test_distances():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 500).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 7), replace=False)) for _ in a], np.uint64)
    assert (S.pairs_within(a, a ^ flips) == (np.bitwise_count(flips) <= 3)).all()
    values = np.r_[a[:90], a[:90] ^ flips[:90]]
    bits = np.unpackbits(S.matrix_within(values).view(np.uint8), axis=1, bitorder="little")
    assert (bits[:, : len(values)].astype(bool) == (np.bitwise_count(values[:, None] ^ values) <= 3)).all() and not bits[:, len(values) :].any()


def test_blocks_are_abandoned(monkeypatch):
    r = np.random.default_rng(5)
    done = []
    add = S._Distances.add
    monkeypatch.setattr(S._Distances, "add", lambda self, plane: (done.append(plane.size), add(self, plane))[1])
    values = r.integers(0, 2**64, 500, dtype=np.uint64)
    values[250] = values[3] ^ np.uint64(5)
    bits = np.unpackbits(S.matrix_within(values).view(np.uint8), axis=1, bitorder="little")[:, :500].astype(bool)
    assert (bits == (np.bitwise_count(values[:, None] ^ values) <= 3)).all()
    assert sum(done) < 0.5 * 64 * 500 * 8
    done.clear()
    S.pairs_within(values[:-1], values[1:])
    assert sum(done) < 0.6 * 64 * 8
    for few in (values[:1], np.full(70, 7, np.uint64), np.arange(200, dtype=np.uint64)):
        bits = np.unpackbits(S.matrix_within(few).view(np.uint8), axis=1, bitorder="little").astype(bool)
        assert (bits[:, : len(few)] == (np.bitwise_count(few[:, None] ^ few) <= 3)).all() and not bits[:, len(few) :].any()


@pytest.mark.parametrize("chunk", [S.CHUNK, 16])
def test_links_lose_nothing(spark, chunk):
    r = np.random.default_rng(1)
    values = []
    for base in r.integers(0, 2**63, 5).astype(np.uint64):
        v = base
        for k in range(200):
            v = v ^ (np.uint64(1) << np.uint64(r.integers(64)))
            if k % 3 == 0:
                v = v ^ (np.uint64(1) << np.uint64(r.integers(64)))
            values.append(v)
        values += [base ^ np.uint64(1 << b) for b in range(64)]
    values = np.unique(np.array(values, np.uint64))
    frame = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    got = {x.node: x.root for x in C.components(S.links(frame, chunk=chunk)).collect()}
    assert all(got.get(int(a), int(a)) == b for a, b in zip(values.view(np.int64), closed(values), strict=True))


def test_documents(spark):
    got = S.near_duplicates(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    ids = [r.doc_id for r in got]
    assert len(got) == 1000 and closed(np.array([int(r.fingerprint, 16) for r in got], np.uint64), ids).tolist() == [r.component_id for r in got]


def test_odd_rows(spark):
    text = "some words that are shared by all of these rows today"
    rows = [(5, text, 1), (3, text.upper(), 1), (3, text, 1), (None, text, 1), (9, "", 1), (8, None, 1), (None, "alone here now", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(3)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in S.near_duplicates(frame).collect())
    assert got == [("3", "3"), ("3", "3"), ("5", "3"), ("8", "8"), ("9", "8"), ("None", "3"), ("None", "None")]
    kept = S.one_of_each(frame)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "8", "None", "None"]
    assert S.near_duplicates(frame.limit(0)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 100), (7, 7), (None, 3), (500, 501)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 200: 100, 500: 500, 501: 500}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
