import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import deep_shallow as D
from tessera.llm import substrings as S
from tessera.session import table


def test_sorting():
    r = random.Random(4)
    for _ in range(200):
        base = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 90))) for _ in range(3)]
        texts = [r.choice(base)[: r.randint(0, 90)] + bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 5))) for _ in range(r.randint(1, 40))]
        groups = np.array([r.randint(0, 3) for _ in texts])
        order, shared = D.sort_groups(texts, groups)
        assert [(groups[i], texts[i]) for i in order] == sorted((g, t) for g, t in zip(groups, texts, strict=True))
        for k in range(1, len(texts)):
            a, b = order[k - 1], order[k]
            assert shared[k] == (D.common_prefix(texts[a], texts[b]) if groups[a] == groups[b] else 0)


def brute(texts):
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - 199):
            seen.setdefault(t[i : i + 200], []).append((k, i))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + 200] = b"\1" * 200
    out = []
    for t, x in zip(texts, gone, strict=True):
        kept = bytes(c for c, f in zip(t, x, strict=True) if not f)
        out.append((len(t), len(t) - len(kept), sum(x[i] and (i == 0 or not x[i - 1]) for i in range(len(x))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("most", "hot"), [(S.MOST, S.HOT), (3, S.HOT), (S.MOST, 3)])
def test_against_brute_force(spark, most, hot, monkeypatch):
    monkeypatch.setattr(S, "HOT", hot)
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefgh éß") for _ in range(n))
    passages = [text(n) for n in (190, 199, 200, 201, 250, 400, 150, 1000)]
    rows = []
    for i in range(60):
        t = text(r.randint(0, 300))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            t += (p[a:] if r.random() < 0.5 else p[: len(p) - a]) + text(r.randint(0, 200))
        rows.append((i, t))
    rows += [(100, "x" * 700), (101, "ab" * 300), (102, "y" * 200), (103, "y" * 199), (104, None), (105, ""), (None, passages[7]), (None, passages[7][:500]), (106, rows[3][1]), (3, rows[3][1]), (107, "z" * 201), (108, "q" * 100 + passages[4] + "q" * 100 + passages[4] + "r" * 50)]
    frame = spark.createDataFrame([(i, t, 1, b"") for i, t in rows], "doc_id long, text string, gram long, kept binary").repartition(5)
    got = sorted(str((q.doc_id, q.n_bytes, q.n_bytes - len(q.kept), len(q.starts), hashlib.sha256(q.kept).hexdigest())) for q in S.remove_repeated(frame, most=most).collect())
    assert got == sorted(str((i, *b)) for (i, _), b in zip(rows, brute([(t or "").encode() for _, t in rows]), strict=True))


def test_anchors_do_not_depend_on_batches(monkeypatch):
    """Equal windows have an anchor at the same place, whatever stands before and wherever a text is cut into slices."""
    r = random.Random(6)
    text = lambda n, letters=b"ab": bytes(r.choice(letters) for _ in range(n))
    texts = [text(r.choice([150, 200, 400, 3000]), r.choice([b"a", b"ab", b"abcdefgh"])) for _ in range(40)] + [b"", b"ab" * 500, b"z" * 900]
    whole = [np.column_stack(x) for x in [S.anchors_of(texts)]][0]
    for size in (300, 1000, 10**7):
        monkeypatch.setattr(S, "BYTES", size)
        assert (np.column_stack(S.anchors_of(texts)) == whole).all()
        for k, t in enumerate(texts):
            own = np.column_stack(S.anchors_of([t]))
            assert (own[:, 1:] == whole[whole[:, 0] == k][:, 1:]).all()
    for k, t in enumerate(texts[:20]):  # every window of 200 bytes has an anchor whose gram lies in it
        places = whole[whole[:, 0] == k][:, 1]
        assert all(((places >= i) & (places <= i + 136)).any() for i in range(len(t) - 199))


def test_memory_of_a_long_text():
    tracemalloc.start()
    S.anchors_of([random.Random(7).randbytes(8_000_000)])
    assert tracemalloc.get_traced_memory()[1] < 150_000_000
    tracemalloc.stop()


def test_memory_of_a_batch(spark, monkeypatch):
    """A task holds a few slices of a batch as Python objects and numpy's arrays, not all of it."""
    monkeypatch.setattr(S, "map_batches", lambda rows, ddl, make: make())
    r = random.Random(8)
    texts = [r.randbytes(500).hex() for _ in range(16_000)]
    rows = pa.RecordBatch.from_pydict({"id": list(range(16_000)), "t": pa.array([0] * 16_000, pa.int32()), "text": texts})
    own = pa.RecordBatch.from_pydict({"id": list(range(16_000)), "t": pa.array([0] * 16_000, pa.int32()), "text": [x.encode() for x in texts], **{k: [[300] * 15] * 16_000 for k in ("gram", "place", "right", "n")}})
    frame = spark.createDataFrame([], "id long, t int, text string")
    wanted = spark.createDataFrame([], "id long, t int, gram long, place int, right int, n int")
    around = pa.RecordBatch.from_pydict({**{k: list(range(5000)) for k in ("gram", "id", "t", "place", "n")}, "before": [x[:136].encode() for x in texts[:5000]], "after": [x[136:336].encode() for x in texts[:5000]]})
    for apply, batch in ((S._anchors(frame), rows), (S._surroundings(frame, wanted), own), (S._windows(wanted), around)):
        tracemalloc.start()
        out = apply(batch)
        for _ in [out] if isinstance(out, pa.RecordBatch) else out:
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 50_000_000


def test_few_tables_are_written(spark, tmp_path, monkeypatch):
    """Hadoop starts a process for each file of a table that it writes locally; what is kept otherwise is dropped again."""
    seen, release, kept = set(), S.release, spark.sparkContext._jsc.getPersistentRDDs().size()

    def look(session, *paths):
        seen.update(x.name for x in tmp_path.iterdir())
        release(session, *paths)

    monkeypatch.setattr(S, "release", look)
    monkeypatch.setattr(S, "shared_dir", lambda session, purpose: f"{tmp_path}/{purpose}")
    assert S.digests(table(spark, "/root/testdata/sf0.001", "documents")).count() == 200
    assert seen == {"substrings-again", "substrings-spans"}
    assert [x.name for x in tmp_path.iterdir()] == ["substrings-spans"]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.collect()
    assert sorted(tuple(x) for x in S.digests(docs).collect()) == sorted((x.doc_id, *b) for x, b in zip(rows, brute([x.text.encode() for x in rows]), strict=True))


def test_empty(spark):
    assert S.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    short = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in S.digests(short).collect()) == [0, 0]
