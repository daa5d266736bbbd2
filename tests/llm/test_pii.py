import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import pii as P
from tessera.llm.registry import QUERIES
from tessera.llm.tagger import Tagger
from tessera.session import table


def plain(text):
    """The patterns as they are written down."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if P.is_card(m[0])]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(P.digits_of(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], P.KINDS.index(x[0])))


def test_patterns():
    r = random.Random(1)
    for _ in range(20000):
        text = "".join(r.choice("a1@.@+-_ ()9%é\n2") for _ in range(r.randint(0, 40)))
        assert plain(text) == P.base_spans(text), text
    for text in ["4111 1111 1111 1111", "+1 (743) 555-3824", "0000.1.2.255 1.2.3.256", "a@b.c@d.e", "x@y", "1.2.3.4.5.6.7.8"]:
        assert plain(text) == P.base_spans(text)
    assert P.base_spans("a" * 200_000 + "9" * 200_000 + "." + "@" * 1000) == []


def test_gradients():
    t = Tagger.fresh(6, 3, 4, 3, 1)
    r = np.random.default_rng(3)
    for k in t.parameters:
        t.parameters[k] = t.parameters[k].astype(np.float64) + 0.1 * r.standard_normal(t.parameters[k].shape)
    x, y = r.integers(0, 6, (8, 5)), r.integers(0, 3, (8, 5))
    _, gradients = t.gradients(x, y)
    for k, p in t.parameters.items():
        at = tuple(r.integers(0, s) for s in p.shape)
        old, step = p[at], 1e-3
        p[at] = old + step
        up = t.gradients(x, y)[0]
        p[at] = old - step
        down = t.gradients(x, y)[0]
        p[at] = old
        assert abs((up - down) / (2 * step) - gradients[k][at]) < 1e-3, k


@pytest.fixture(scope="module")
def tagger():
    return P.trained()


def test_paths_and_bound():
    """Viterbi and the bound against all tag sequences."""
    r = np.random.default_rng(0)
    for seed in range(6):
        t = Tagger.fresh(7, 5, 4, 3, seed)
        for k in t.parameters:
            t.parameters[k] = (t.parameters[k] + r.standard_normal(t.parameters[k].shape) * 0.7).astype(np.float32)
        t.parameters["out_bias"].reshape(2, 5)[:, 0] += 1.5
        x = r.integers(0, 7, (40, 4))
        scores, p = t._run(x.T)[0], t.parameters
        every = np.array(list(itertools.product(range(5), repeat=4)))
        total = p["first"][every[:, 0]][:, None] + sum(scores[k][:, every[:, k]].T for k in range(4)) + sum(p["move"][every[:, k], every[:, k + 1]] for k in range(3))[:, None]
        best = every[total.argmax(0)]
        decoder = t.decoder()
        tags, gains = decoder.decode(x)
        assert (tags == best).all()
        assert np.allclose(gains, np.take_along_axis(scores.transpose(1, 0, 2), best[:, :, None], 2)[:, :, 0] - scores[:, :, 0].T, atol=1e-3)
        assert set(np.flatnonzero(best.any(1))) <= set(decoder.hopeful(decoder.gains(x)))


def test_held_out_recall(tagger):
    """Spans of forms that the patterns miss, by kind; those of the patterns are not counted."""
    hit, all_, wrong = Counter(), Counter(), 0
    decoder = tagger.decoder()
    for seed in (99, 7):
        labelled = P.examples(300, seed)
        texts = [x for x, _ in labelled]
        bases = [P.base_spans(x) for x in texts]
        for (_, gold), base, more in zip(labelled, bases, P.added_spans(texts, bases, decoder), strict=True):
            own = set(gold) - set(base)
            all_.update(x[0] for x in own)
            hit.update(x[0] for x in own & set(more))
            wrong += len(set(more) - own)
            assert not any(a < d and c < b for _, a, b in more for _, c, d in base)
    assert all(hit[k] / all_[k] >= 0.9 for k in P.KINDS), (hit, all_)
    assert wrong <= 0.03 * sum(hit.values())


def test_windows_cover_the_whole_text():
    for n in [0, 1, P.LENGTH - 1, P.LENGTH, P.LENGTH + 1, P.LENGTH + P.STRIDE, 5000, 100_001]:
        windows = [(a, min(n, a + P.LENGTH)) for a in P.windows_of(n)]
        seen = np.zeros(n, bool)
        for a, b in windows:
            assert a < b
            seen[a:b] = True
        assert seen.all()
        most = P.LENGTH - P.STRIDE
        for at in range(0, max(0, n - most), 37):
            assert any(a <= at and at + most <= b for a, b in windows)


def test_layout_does_not_change_results(tagger):
    """Neither other texts nor the number of windows taken at once change the spans of a text."""
    r = random.Random(4)
    prose = lambda n: " ".join(P._word(r) for _ in range(n))
    texts = [prose(r.choice([0, 5, 200, 900])) + " " + x + " " + prose(r.choice([0, 5, 200])) for x, _ in P.examples(60, seed=5)]
    bases, decoder = [P.base_spans(x) for x in texts], tagger.decoder()
    whole = P.added_spans(texts, bases, decoder)
    assert sum(map(len, whole)) > 30
    assert whole == P.added_spans(texts, bases, decoder, rows=7)
    assert whole == [P.added_spans([x], [b], decoder)[0] for x, b in zip(texts, bases, strict=True)]


def test_spans_in_long_texts(tagger):
    """Spans are found wherever in a long text they stand, at the edges of windows too."""
    r, decoder = random.Random(6), tagger.decoder()
    hit = 0
    for k in range(60):
        before = "".join(P._word(r) + " " for _ in range(400))[: P.STRIDE - 60 + 3 * k]
        address = "jane.doe [at] mail.example.com"
        text = f"{before} {address} {'some more words here ' * 40}"
        hit += ("email", len(before) + 1, len(before) + 1 + len(address)) in P.added_spans([text], [P.base_spans(text)], decoder)[0]
    assert hit >= 57
    assert P.added_spans(["nothing at all here, " * 300], [[]], decoder) == [[]]


def test_at_with_plain_dots(tagger):
    """Addresses with the word at and plain dots have no digit, at sign or word dot."""
    for text, address in [("write to jane at mail.example.com now", "jane at mail.example.com"), ("jane.doe[at]example.com", "jane.doe[at]example.com"), ("please ask kamal.enho (at) torest.org, or", "kamal.enho (at) torest.org"), ("jane.doe [at] example.com", "jane.doe [at] example.com")]:
        at = text.index(address)
        assert P.added_spans([text], [[]], tagger.decoder()) == [[("email", at, at + len(address))]]
    assert not P.valid("email", "he was at home. Then") and P.valid("email", "jane (at) example.com") and P.valid("email", "jane at example.com")


def test_reconcile():
    assert P.reconciled([(3.0, "ip", 0, 5), (2.0, "card", 4, 9), (2.0, "card", 5, 9), (1.0, "ip", 0, 5)]) == [("ip", 0, 5), ("card", 5, 9)]
    assert P.reconciled([]) == []
    r = random.Random(3)
    for _ in range(200):
        spans = {(r.choice(P.KINDS), a, a + r.randint(1, 6)): r.randint(-1, 5) for a in (r.randint(0, 12) for _ in range(r.randint(0, 7)))}
        sets = [c for n in range(len(spans) + 1) for c in itertools.combinations(spans, n) if all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(c, 2))]
        got = P.reconciled([(float(v), *k) for k, v in spans.items()])
        assert tuple(got) in [tuple(sorted(c, key=lambda x: x[1])) for c in sets]
        assert sum(spans[x] for x in got) == max(sum(spans[x] for x in c) for c in sets)
    many = [(1.0, "ip", k, k + 3) for k in range(100_000)]
    assert len(P.reconciled(many)) == 33_334


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, d, "documents").collect()}
    for r in QUERIES["op9_pii_tagger"](spark, d).collect():
        base = plain(texts[r.doc_id])
        own = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in P.KINDS]
        assert set(own.split(",")) <= set(r.spans.split(","))


def test_rows_and_redaction(spark, tagger):
    rows = spark.createDataFrame([(1, "mail a.b@c.de now", 17, 5), (1, "mail a.b@c.de now", 17, 5), (None, None, None, 5), (3, "", 0, 5)], "doc_id long, text string, n_chars long, spans int")
    got = sorted((str(r.doc_id), r.n_email, r.spans) for r in P.find(rows, tagger).collect())
    assert got == [("1", 1, "email:5:13"), ("1", 1, "email:5:13"), ("3", 0, ""), ("None", 0, "")]
    clean = P.with_length(P.redact(rows, tagger))
    assert clean.columns == rows.columns
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in clean.collect() if r.text) == [("1", "mail [EMAIL] now", 16)] * 2
    assert P.find(rows.limit(0), tagger).count() == 0
    assert P.masked("0123456789", [("ip", 2, 5), ("card", 4, 7)]) == "01[IP]789"
