import random

import pytest

from tessera.llm import decontaminate as D
from tessera.session import table


def distance(text, item):
    """Smallest edit distance of a stretch of the text to the item, and the first end that has it."""
    column, best = list(range(len(item) + 1)), (len(item), 0)
    for end, c in enumerate(text, 1):
        new = [0] * (len(item) + 1)
        for i in range(1, len(item) + 1):
            new[i] = min(column[i - 1] + (item[i - 1] != c), column[i] + 1, new[i - 1] + 1)
        column = new
        if column[-1] < best[0]:
            best = (column[-1], end)
    return best


def changed(r, text, n, letters):
    p = list(text)
    for _ in range(n):
        at = r.randrange(len(p) + 1)
        kind = r.random()
        if kind < 0.3 and p:
            p[min(at, len(p) - 1)] = r.choice(letters)
        elif kind < 0.6:
            p.insert(at, r.choice(letters))
        elif p:
            p.pop(min(at, len(p) - 1))
    return "".join(p)


@pytest.mark.parametrize("letters", ["abc ", "abcdefgh "])
def test_against_all_distances(letters):
    r = random.Random(5)
    for _ in range(200):
        items = [(k, "".join(r.choice(letters) for _ in range(r.randint(1, 40)))) for k in range(4)]
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        if r.random() < 0.7:
            text += changed(r, r.choice(items)[1], r.randint(0, 5), letters) + "".join(r.choice(letters) for _ in range(20))
        expected = {}
        for k, p in items:
            if p := D.normal(p):
                found = distance(D.normal(text), p)
                if found[0] <= D.budget(len(p), 0.2):
                    expected[k] = found
        assert D.Finder(items, 0.2).find(text) == expected


def test_documents(spark):
    docs, items = (table(spark, "/root/testdata/sf0.01", x) for x in ("documents", "benchmark"))
    own = {(r.doc_id, r.item_id): r.distance for r in D.matches(docs, items).collect()}
    texts = {r.doc_id: D.normal(r.text) for r in docs.collect()}
    planted = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if D.normal(r.text) in t}
    assert planted and planted == {k for k, v in own.items() if v == 0}
    r = random.Random(1)
    some = items.limit(10).collect()
    edited = [(k, "before " + changed(r, x.text, D.budget(len(D.normal(x.text))) // 2, "xyz") + " after") for k, x in enumerate(some)]
    found = {(m.doc_id, m.item_id) for m in D.matches(spark.createDataFrame(edited, "doc_id long, text string"), items).collect()}
    assert found >= {(k, x.item_id) for k, x in enumerate(some)}


def test_blocks_change_nothing(spark):
    docs, items = (table(spark, "/root/testdata/sf0.001", x) for x in ("documents", "benchmark"))
    again = items.unionByName(items.selectExpr("item_id", "concat(text, ' and more') text")).unionByName(items.selectExpr("item_id", "upper(substring(text, 1, 40)) text"))
    whole = sorted(D.matches(docs, again).collect())
    kept = sorted(r.doc_id for r in D.clean(docs, again).select("doc_id").collect())
    assert whole and len({(r.doc_id, r.item_id) for r in whole}) == len(whole) and {r.doc_id for r in whole}.isdisjoint(kept)
    for chars in (200, 6000):
        part = again if chars > 200 else again.where("item_id < 8")
        assert sorted(D.matches(docs, part, block_chars=chars).collect()) == [r for r in whole if chars > 200 or r.item_id < 8]
    assert sorted(r.doc_id for r in D.clean(docs, again, block_chars=12000).select("doc_id").collect()) == kept


def test_odd_rows(spark):
    item = "a passage of a benchmark that is long enough to be one"
    items = spark.createDataFrame([(1, item), (1, item + "!"), (2, None), (3, "  "), (None, "another one of them"), (4, "x")], "item_id long, text string")
    rows = [(1, f"so {item.upper()} it is", 0), (1, f"so {item.upper()} it is", 0), (None, "ANOTHER  one\nof them", 0), (3, None, 0), (4, "", 0), (5, "clean", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = sorted((str(r.doc_id), str(r.item_id), r.distance) for r in D.matches(docs, items).collect())
    assert got == [("1", "1", 0), ("None", "None", 0)]
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert D.matches(docs.limit(0), items).count() == 0 and D.matches(docs, items.limit(0)).count() == 0 and D.clean(docs, items.limit(0)).count() == 6
