"""Language identification by character models with interpolated Kneser-Ney smoothing.

A model of order four is fitted for each language, on a sample of labelled documents of bounded size. The models stand in
sorted arrays of n-gram hashes with a column for each language, one array an order, beside arrays of contexts with their
interpolation weights; one search serves all languages. A text is reduced to lower-case letters with single spaces for all
else, and belongs to the language with the lowest cross-entropy a character.

Rejection looks at the lowest cross-entropy of each window of WINDOW characters, so that a text in two known languages is
none that no model explains. It is calibrated on sampled documents held back from the fit: the spread of their mean over
windows is measured on pieces of several lengths as a + b / length, and a text is rejected if its own lies more than Z
standard deviations above the language's mean for its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import char_classes as cc
from tessera.llm.common import map_batches, slices

ORDER, Z, WINDOW = 4, 6.0, 64
#: Bounds of the fit: labelled documents of each language, characters taken of each, languages.
SAMPLE, LONGEST, LANGUAGES = 200, 20_000, 500
#: Characters scored at once, n-grams remembered by a worker, and the sharpness of the score.
CHARS, MEMORY, SHARPNESS = 300_000, 300_000, 10.0
EDGE = 1
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and spaces of all texts, each after ORDER - 1 edges; where each text's own begin; how many there are."""
    lowered = [x.lower() for x in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32).astype(np.int64)
    points = np.where(cc.table()[points] == cc.LETTER, points, 32)
    sizes = np.array([len(x) for x in lowered], np.int64)
    ends = np.cumsum(sizes)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    starts = (ends - sizes)[sizes > 0]
    keep[starts] = points[starts] != 32
    last = ends[sizes > 0] - 1  # no space at the end
    keep[last] &= points[last] != 32
    own = np.concatenate([[0], np.cumsum(keep)])
    counts = own[ends] - own[ends - sizes]
    out = np.full(int(counts.sum()) + (ORDER - 1) * len(texts), EDGE, np.int64)
    begins = np.cumsum(counts + ORDER - 1) - counts
    if len(points):
        which = np.repeat(np.arange(len(texts)), counts)
        out[np.arange(len(which)) + (ORDER - 1) * (which + 1)] = points[keep]
    return out, begins, counts


def hashes(values: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position; the first order - 1 are of no use."""
    out = np.full(len(values), np.uint64(order))
    v = values.astype(np.uint64) + np.uint64(77)
    for k in range(order):
        out[k:] += v[: len(v) - k] * _FACTORS[k] if k else v * _FACTORS[0]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def _rows(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each hash in a sorted array, or -1."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # by order, from 1
    probabilities: list[np.ndarray]  # a column for each language
    contexts: list[np.ndarray]  # by order, from 1; hashes of what precedes
    weights: list[np.ndarray]
    floor: float
    means: np.ndarray
    spreads: np.ndarray  # a and b of each language

    def probability(self, own: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """Rows of probabilities of n-grams given by hashes of all their orders, and of the contexts of these."""
        out = np.full((len(own[0]), len(self.languages)), self.floor)
        for k in range(ORDER):
            at = _rows(self.contexts[k], before[k])
            out *= np.where((at >= 0)[:, None], self.weights[k][at], 1.0)
            at = _rows(self.keys[k], own[k])
            hit = at >= 0
            out[hit] = self.probabilities[k][at[hit]]
        return out


def _contexts(values: np.ndarray) -> list[np.ndarray]:
    """For orders from 1, the hash of the order - 1 characters before each position."""
    out = [np.zeros(len(values), np.uint64)]
    for k in range(1, ORDER):
        h = hashes(values, k)
        out.append(np.concatenate([h[:1], h[:-1]]))
    return out


def _counts(values: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """By order from 1: n-gram hashes, counts (of continuations below the highest order), hashes of contexts and places."""
    at = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    before, out = _contexts(values), []
    for k in range(ORDER, 0, -1):
        own, first, n = np.unique(hashes(values, k)[at], return_index=True, return_counts=True)
        at = at[first]
        out.append((own, n, before[k - 1][at], at))
    return out[::-1]


def fit_counts(texts: dict[str, list[str]]) -> Model:
    """Models without calibration."""
    languages = sorted(texts)
    tables, held, letters = [], [], set()
    for language in languages:
        values, begins, counts = symbols(texts[language])
        tables.append(_counts(values, begins, counts))
        held.append(values)
        letters.update(np.unique(values).tolist())
    keys, probabilities, contexts, weights = [], [], [], []
    floor = 1.0 / (len(letters) + 1)
    for k in range(ORDER):
        all_keys = np.unique(np.concatenate([t[k][0] for t in tables]))
        all_contexts = np.unique(np.concatenate([t[k][2] for t in tables]))
        share, weight = np.zeros((len(all_keys), len(languages))), np.ones((len(all_contexts), len(languages)))
        suffix = np.zeros((len(all_keys), len(languages)))
        own_context = np.zeros(len(all_keys), np.uint64)
        own_suffix = np.zeros(len(all_keys), np.uint64)
        for column, (t, values) in enumerate(zip(tables, held, strict=True)):
            own, n, before, at = t[k]
            ones, twos = int((n == 1).sum()), int((n == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            names, which = np.unique(before, return_inverse=True)
            total, kinds = np.bincount(which, n), np.bincount(which)
            rows = np.searchsorted(all_keys, own)
            share[rows, column] = (n - discount) / total[which]
            weight[np.searchsorted(all_contexts, names), column] = discount * kinds / total
            own_context[rows] = before
            if k:
                own_suffix[rows] = hashes(values, k)[at]
        if k:
            suffix = probabilities[k - 1][np.searchsorted(keys[k - 1], own_suffix)]
        else:
            suffix[:] = floor
        keys.append(all_keys)
        contexts.append(all_contexts)
        weights.append(weight)
        probabilities.append(share + weight[np.searchsorted(all_contexts, own_context)] * suffix)
    n = len(languages)
    return Model(languages, keys, probabilities, contexts, weights, floor, np.zeros(n), np.zeros((n, 2)))


class Scorer:
    """Cross-entropies of texts; remembers the n-grams it has met."""

    def __init__(self, model: Model, memory: int = MEMORY):
        self.model, self.memory = model, memory
        self._forget()

    def _forget(self) -> None:
        slots = 1 << (4 * self.memory - 1).bit_length()
        self.slots, self.where = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.rows, self.known = np.zeros((4096, len(self.model.languages))), 0

    def _find(self, wanted: np.ndarray) -> np.ndarray:
        mask = len(self.slots) - 1
        slot = (wanted & np.uint64(mask)).astype(np.int64)
        held = self.slots[slot]
        out = np.where(held == wanted, self.where[slot], -1)
        left = np.flatnonzero((held != wanted) & (held != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & mask
            held = self.slots[slot]
            hit = held == wanted[left]
            out[left[hit]] = self.where[slot[hit]]
            go = ~hit & (held != 0)
            left, slot = left[go], slot[go]
        return out

    def _learn(self, fresh: np.ndarray, rows: np.ndarray) -> np.ndarray:
        while self.known + len(fresh) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        numbers = np.arange(self.known, self.known + len(fresh))
        self.rows[numbers] = rows
        self.known += len(fresh)
        mask = len(self.slots) - 1
        for key, number in zip(fresh.tolist(), numbers.tolist(), strict=True):
            slot = key & mask
            while self.slots[slot]:
                slot = (slot + 1) & mask
            self.slots[slot], self.where[slot] = key, number
        return numbers

    def position_logs(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities at some positions."""
        wanted = hashes(values, ORDER)[at]
        wanted[wanted == 0] = 1
        found = self._find(wanted)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            fresh, first, which = np.unique(wanted[missing], return_index=True, return_inverse=True)
            if self.known + len(fresh) > self.memory:
                self.memory = max(self.memory, 2 * len(fresh))
                self._forget()
                missing = np.arange(len(wanted))
                fresh, first, which = np.unique(wanted, return_index=True, return_inverse=True)
                self.memory = max(self.memory, 2 * len(fresh))
            places = at[missing[first]]
            own = [hashes(values, k + 1)[places] for k in range(ORDER)]
            before = [x[places] for x in _contexts(values)]
            found[missing] = self._learn(fresh, np.log(self.model.probability(own, before)))[which]
        return self.rows[found]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats a character in each language, in the best language of each window, and the number of characters."""
        out, mixed, sizes = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for a, b in slices([len(x) for x in texts], CHARS):
            values, begins, counts = symbols(texts[a:b])
            sizes[a:b] = counts
            rows = np.flatnonzero(counts)
            if not len(rows):
                continue
            n, first = counts[rows], np.cumsum(counts[rows]) - counts[rows]
            at = np.repeat(begins[rows] - first, n) + np.arange(int(n.sum()))
            windows = -(-n // WINDOW)
            own = np.cumsum(windows) - windows
            starts = np.repeat(first, windows) + WINDOW * (np.arange(int(windows.sum())) - np.repeat(own, windows))
            sums = -np.add.reduceat(self.position_logs(values, at), starts, axis=0)
            out[a + rows] = np.add.reduceat(sums, own, axis=0) / n[:, None]
            mixed[a + rows] = np.add.reduceat(sums.min(axis=1), own) / n
        return out, mixed, sizes


def fit(texts: dict[str, list[str]]) -> Model:
    """Fit models on four of five texts of each language, and calibrate rejection on the others. Languages without a letter
    have no model; without any language the model is empty, explains nothing and accepts nothing."""
    texts = {k: v for k, v in texts.items() if any(symbols([x])[2][0] for x in v)}
    if not texts:
        return Model([], [], [], [], [], 1.0, np.zeros(0), np.zeros((0, 2)))
    held = {k: v[::5] if len(v) >= 10 else v for k, v in texts.items()}
    model = fit_counts({k: [x for i, x in enumerate(v) if i % 5] if len(v) >= 10 else v for k, v in texts.items()})
    scorer = Scorer(model)
    for column, language in enumerate(model.languages):
        squares, inverse = [], []
        _, whole, sizes = scorer.entropies(held[language])
        good = sizes > 0
        mean = float(np.average(whole[good], weights=sizes[good])) if good.any() else float(np.log(1 / model.floor))
        for size in (10, 40, 160, 640):
            parts = [x[i : i + size] for x in held[language] for i in range(0, min(len(x), 50 * size), size)]
            _, found, n = scorer.entropies(parts)
            full = n >= size // 2
            if full.sum() >= 5:
                squares.append(float(np.mean((found[full] - mean) ** 2)))
                inverse.append(float(np.mean(1 / n[full])))
        slope = max([s / i for s, i in zip(squares, inverse, strict=True)], default=4.0)
        base = float(np.mean((whole[good] - mean) ** 2)) if good.any() else 0.0
        model.means[column], model.spreads[column] = mean, (base + 0.0025, slope)
    return model


def predict(scorer: Scorer, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
    """(language, score, cross-entropy, accepted) of each text. Ties go to the language first in order."""
    model = scorer.model
    if not model.languages:
        return [("und", 0.0, None, False)] * len(texts)
    found, mixed, n = scorer.entropies([x or "" for x in texts])
    best = found.argmin(axis=1)
    lowest = found[np.arange(len(found)), best]
    score = 1 / np.exp(-SHARPNESS * (found - lowest[:, None])).sum(axis=1)
    limit = model.means[best] + Z * np.sqrt(model.spreads[best, 0] + model.spreads[best, 1] / np.maximum(n, 1))
    return [(model.languages[b], float(s), float(e), bool(m <= x)) if k else ("und", 0.0, None, False) for b, s, e, m, x, k in zip(best, score, lowest, mixed, limit, n, strict=True)]


def in_fold(key: str = "doc_id"):
    """Whether a document is held out of all learning."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on at most about `sample` labelled documents of each language, outside the fold that is held out; which ones
    depends on hashes of their ids. Of a text of more than LONGEST characters a piece of that length is taken, from a place
    that depends on its id as well. Rows without an id, a label or text teach nothing; where none is left, the model is
    empty."""
    labelled = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    labelled = labelled.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~in_fold("id"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return fit({})
    draw = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30))
    limits = F.coalesce(*(F.when(F.col("lang") == k, F.lit(int((1 << 30) * min(1.0, 1.2 * sample / n)))) for k, n in counts.items()))
    start = F.pmod(F.xxhash64("id", F.lit(8)), F.greatest(F.length("text") - LONGEST, F.lit(0)) + 1).cast("int") + 1
    rows = labelled.where(draw < limits).select("lang", draw.alias("draw"), F.substring("text", start, F.lit(LONGEST)).alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["draw"], r["text"])):
        if len(own := texts.setdefault(r["lang"], [])) < sample:
            own.append(r["text"])
    return fit(texts)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key long, held_out boolean, lang_pred string, score double, cross_entropy double, accepted boolean) of every row.

    Null text and text without a letter give und, score 0, no cross-entropy and no acceptance. A row without an id is in no
    fold. Repeated rows stay; other columns are not looked at; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = zip(*predict(scorer, batch.column(2).to_pylist()), strict=True)
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(found, types, strict=True))], ["id", "held_out", "lang_pred", "score", "cross_entropy", "accepted"])

        return apply

    own = docs.select(F.col(key).cast("long").alias("id"), in_fold(key).alias("held_out"), F.col(text).alias("t"))
    return map_batches(own, "id long, held_out boolean, lang_pred string, score double, cross_entropy double, accepted boolean", make).withColumnRenamed("id", key)


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that a model accepts, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = pa.array([x[3] for x in predict(scorer, batch.column(batch.schema.get_field_index(text)).to_pylist())], pa.bool_())
            return pa.RecordBatch.from_arrays([pc.filter(c, keep) for c in batch.columns], schema=batch.schema)

        return apply

    return map_batches(docs, docs.schema, make)
