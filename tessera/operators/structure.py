"""Sections and chunks of Markdown documents, and what is made of them for models."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import params
from tessera.functions import text as T


def lines(docs: DataFrame, doc: str = "doc", md: str = "md") -> DataFrame:
    """(doc, n, line): lines from 1; an empty line after a final line feed counts."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(md, "\n", -1)).alias("k", "line")).select("doc", (F.col("k") + 1).alias("n"), "line")


def sections(docs: DataFrame, doc: str = "doc", md: str = "md") -> DataFrame:
    """(doc, section_no, title, level, start_line, end_line) of Markdown headings. A section ends before the next heading,
    whatever its level; headings in code fences count; a heading of # and spaces has an empty title."""
    head = r"(?s)^(#{1,6})" + T.WHITE + "+(.+)$"
    rows = lines(docs, doc, md)
    sizes = docs.select(F.col(doc).alias("doc"), F.size(F.split(md, "\n", -1)).alias("lines"))
    found = rows.where(F.col("line").rlike(head)).select("doc", F.substring(T.strip(F.regexp_extract("line", head, 2)), 1, params.TITLE_CHARS).alias("title"), F.length(F.regexp_extract("line", head, 1)).alias("level"), F.col("n").alias("start_line"))
    order = Window.partitionBy("doc").orderBy("start_line")
    return found.join(sizes, "doc").select("doc", F.row_number().over(order).alias("section_no"), "title", "level", "start_line", F.coalesce(F.lead("start_line").over(order) - 1, F.col("lines")).alias("end_line"))


_HASH = "#"


def fold_chunks(text: str, target: int = params.CHUNK_WORDS) -> Iterator[tuple[int, int, int, str]]:
    """(first line, last line, words, text) of the chunks of a document, in one pass over its lines.

    A chunk closes at a blank line or a line that begins with # once it has `target` words, and at a line that begins with #
    once it has over 50; that line still belongs to it. Chunks of at most ten words are left out.
    """
    rows, first, words = text.split("\n"), 0, 0
    for k, row in enumerate(rows):
        words += len(row.split())
        heading = row.startswith(_HASH)
        full = words >= target and (heading or not row.strip())
        last = k == len(rows) - 1
        if full or last or (heading and words > params.HEADER_SPLIT_OVER):
            body = "\n".join(rows[first : k + 1]).strip()
            if body and words > params.CHUNK_KEEP_OVER:
                yield first + 1, k + 1, words, body
            first, words = k + 1, 0


def chunks(docs: DataFrame, target: int = params.CHUNK_WORDS, doc: str = "doc", md: str = "md") -> DataFrame:
    """(doc, start_line, end_line, word_count, text, is_index). The fold with resets is no window function; it runs in Arrow
    batches, each document in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows := list(fold_chunks(text or "", target)):
                    a, b, n, body = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *(pa.array(x, pa.int32()) for x in (a, b, n)), pa.array(body)], ["doc", "start_line", "end_line", "word_count", "text"])

    found = docs.select(F.col(doc).cast("string"), md).mapInArrow(run, "doc string, start_line int, end_line int, word_count int, text string")
    return found.withColumn("is_index", T.index_like(F.col("text")))


def with_section(chunks_: DataFrame, sections_: DataFrame) -> DataFrame:
    """Chunks with the section of their first line; none before the first heading. An end of null or 0 is open. Headings and
    chunks of a document stand in one order, in which each chunk takes the last heading before it."""
    end = F.coalesce(F.nullif("end_line", F.lit(0)), F.lit(2**31 - 1)).alias("end")
    heads = sections_.select("doc", F.col("start_line").alias("_at"), F.lit(0).alias("_kind"), F.struct("section_no", "title", end).alias("_section"))
    rows = chunks_.select("doc", F.col("start_line").alias("_at"), F.lit(1).alias("_kind"), F.struct(*chunks_.columns).alias("_chunk"))
    order = Window.partitionBy("doc").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = heads.unionByName(rows, allowMissingColumns=True).withColumn("_s", F.last("_section", ignorenulls=True).over(order)).where("_kind = 1")
    inside = F.col("_at") <= F.col("_s.end")
    return found.select("_chunk.*", *(F.when(inside, F.col(f"_s.{x}")).alias(x) for x in ("section_no", "title")))


def neighbours(chunks_: DataFrame) -> DataFrame:
    """Chunks with the parts that a context prompt shows: 500 characters before, 1000 of the chunk, 500 after."""
    order = Window.partitionBy("doc").orderBy("start_line")
    before, after = F.lag("text").over(order), F.lead("text").over(order)
    own = chunks_.withColumn("_before", before).withColumn("_after", after)
    shown = lambda c, part, missing: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, part).otherwise(F.lit(missing))
    return own.withColumn("prev_part", shown(F.col("_before"), F.right("_before", F.lit(500)), "(start of document)")).withColumn("chunk_part", F.substring("text", 1, 1000)).withColumn("next_part", shown(F.col("_after"), F.substring("_after", 1, 500), "(end of document)")).drop("_before", "_after")


def context_prompts(chunks_: DataFrame, template: str) -> DataFrame:
    """(doc, start_line, prompt) from a template with {doc}, {section}, {prev}, {chunk} and {next}."""
    fields = {"doc": F.col("doc"), "section": F.coalesce(F.nullif("title", F.lit("")), F.lit("(no section)")), "prev": F.col("prev_part"), "chunk": F.col("chunk_part"), "next": F.col("next_part")}
    parts = [fields[x[1:-1]] if re.fullmatch(r"\{\w+\}", x) else F.lit(x) for x in re.split(r"(\{\w+\})", template) if x]
    return neighbours(chunks_).select("doc", "start_line", F.concat(*parts).alias("prompt"))
