"""Benchmark decontamination by pigeonhole edit matching.

An item is found in a document where a stretch of the document lies within an edit distance of the item: the error budget, a
share of the item's length, rounded down. An item with budget k is split into k + 1 pieces. k errors leave one piece whole,
so every match holds an exact piece at about its offset; all pieces of all items are sought in one pass of an Aho-Corasick
automaton. Around each hit the stretch that the item could fill, k longer to either side, is verified by the bit-parallel
algorithm of Myers, which keeps a column of the distance table in machine words (here one long integer).

Both sides are compared in lower case with each run of white space as one space. Benchmark items travel to the tasks in
blocks of about a bounded size; a larger benchmark takes more passes over the documents, each written before the next begins,
so the driver holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release, shared_dir

#: Share of an item's characters that may differ; characters of items that go to the tasks at once.
RATE, BLOCK_CHARS = 0.08, 4_000_000

Item = tuple[int | None, str]


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = RATE) -> int:
    return int(length * rate)


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about equal length with their offsets."""
    n = len(text)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit vectors of an item."""

    def __init__(self, text: str, k: int):
        self.text, self.k, self.m = text, k, len(text)
        self.full, self.top = (1 << self.m) - 1, 1 << (self.m - 1)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int] | None:
        """Smallest distance of a stretch of the text, and where its first such stretch ends; none past the budget."""
        if (at := text.find(self.text)) >= 0:
            return 0, at + self.m
        plus, minus, score, found = self.full, 0, self.m, None
        get, full, top, low = self.masks.get, self.full, self.top, self.k + 1
        for end, c in enumerate(text, 1):
            eq = get(c, 0)
            x = eq | minus
            d0 = ((((x & plus) + plus) ^ plus) | x) & full
            up = minus | (~(d0 | plus) & full)
            down = d0 & plus
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = up << 1 & full
            down = down << 1 & full
            plus = down | (~(d0 | up) & full)
            minus = up & d0
            if score < low:
                low, found = score, (score, end)
                if low == 0:
                    break
        return found


class Finder:
    """Searches documents for a block of items."""

    def __init__(self, items: list[Item], rate: float = RATE):
        self.ids: list[int | None] = []
        self.patterns: list[Pattern] = []
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            if not (text := normal(text)):
                continue
            k = budget(len(text), rate)
            self.ids.append(item)
            self.patterns.append(Pattern(text, k))
            for offset, piece in pieces(text, k):
                places.setdefault(piece, []).append((len(self.patterns) - 1, offset))
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str | None) -> dict[int | None, tuple[int, int]]:
        """Items found in a text: id -> (distance, end in the compared form of the text)."""
        out: dict[int | None, tuple[int, int]] = {}
        if self.empty or not (text := normal(text)):
            return out
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, found) in self.automaton.iter(text):
            for p, offset in found:
                pattern = self.patterns[p]
                start = last + 1 - size - offset
                a, b = max(0, start - pattern.k), start + pattern.m + pattern.k
                own = windows.setdefault(p, [])
                # hits come in the order of their ends, so windows begin in order but for the length of the item
                if own and own[-1][0] <= a <= own[-1][1]:
                    own[-1] = (own[-1][0], max(b, own[-1][1]))
                elif not own or (a, b) != own[-1]:
                    own.append((a, b))
        for p, spans in windows.items():
            pattern, merged = self.patterns[p], []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                if found := pattern.best(text[a:b]):
                    hit = (found[0], a + found[1])
                    item = self.ids[p]
                    out[item] = min(hit, out.get(item, hit))
        return out


class Blocks:
    """A benchmark's items in blocks of about `most` characters, dealt by a hash of id and text; the size is measured first.
    Null and blank texts match nothing."""

    def __init__(self, benchmark: DataFrame, item: str = "item_id", text: str = "text", most: int = BLOCK_CHARS):
        self.items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).where("text is not null")
        total = self.items.agg(F.sum(F.length("text").cast("long") + 8)).first()[0] or 0
        self.n = -(-total // most)

    def __iter__(self) -> Iterator[list[Item]]:
        for k in range(self.n):
            part = self.items if self.n == 1 else self.items.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.n)) == k)
            yield [(r["item"], r["text"]) for r in part.distinct().collect()]


def _found(docs: DataFrame, items: list[Item], rate: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items, rate)
        for batch in batches:
            rows = [(i, item, d, end) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for item, (d, end) in finder.find(t).items()]
            if rows:
                columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["id", "item_id", "distance", "end_at"])

    return docs.mapInArrow(run, _DDL)


_DDL = "id long, item_id long, distance int, end_at long"


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key long, item_id long, distance int, end_at long): items found in documents, with the smallest distance and the
    end of its first stretch in the document's compared form.

    There is one row for each document id and item id: rows that repeat an id, or have none, count as one document, and items
    that repeat an id, or have none, as one item, with the smallest of their distances. Null and empty texts match nothing.
    Columns besides those named are not looked at. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    own, blocks = docs.selectExpr(f"cast(`{key}` as long) id", f"`{text}` t"), Blocks(benchmark, most=block_chars)
    if blocks.n == 1:
        found = _found(own, next(iter(blocks)), rate)
    else:
        path = shared_dir(spark, "matches")
        spark.createDataFrame([], _DDL).write.parquet(path)
        for items in blocks:
            _found(own, items, rate).write.mode("append").parquet(path)
        found = spark.read.schema(_DDL).parquet(path)
    best = found.groupBy("id", "item_id").agg(F.min(F.struct("distance", "end_at")).alias("best"))
    return best.select(F.col("id").alias(key), "item_id", "best.distance", "best.end_at")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    blocks, written = Blocks(benchmark, most=block_chars), None
    for items in blocks:

        def run(batches: Iterator[pa.RecordBatch], items: list[Item] = items) -> Iterator[pa.RecordBatch]:
            finder = Finder(items, rate)
            for batch in batches:
                keep = [not finder.find(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([pc.filter(c, pa.array(keep, pa.bool_())) for c in batch.columns], schema=batch.schema)

        kept = docs.mapInArrow(run, docs.schema)
        if blocks.n > 1:
            path = shared_dir(docs.sparkSession, "clean")
            kept.write.parquet(path)
            kept = docs.sparkSession.read.schema(docs.schema).parquet(path)
            if written:
                release(docs.sparkSession, written)
            written = path
        docs = kept
    return docs
