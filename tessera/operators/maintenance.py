"""Incremental maintenance of the index: plans and results of merges, signatures, status of documents."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merge_plan(existing: DataFrame, planned: DataFrame, content: list[str], section: str = "section_no", keys: tuple[str, ...] = ("doc", "start_line")) -> DataFrame:
    """keys and action for every key of either side: insert, update, move (only the section differs), keep or delete.
    Rows of a key beyond the first of the existing side are duplicates; drop them with keep_first()."""
    old = existing.select(*keys, F.struct(*content).alias("_old"), F.col(section).alias("_was"), F.lit(True).alias("_a"))
    new = planned.select(*keys, F.struct(*content).alias("_new"), F.col(section).alias("_is"), F.lit(True).alias("_b"))
    both = old.join(new, list(keys), "full_outer")
    action = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update").when(~F.col("_was").eqNullSafe(F.col("_is")), "move").otherwise("keep")
    return both.select(*keys, action.alias("action"))


def merge_chunks(existing: DataFrame, planned: DataFrame) -> DataFrame:
    """The chunks after a merge: those planned, with chunk_id and embedding of the existing chunk of the same document and
    first line; the embedding is lost if the content changed. chunk_id is null for new chunks."""
    content = ("end_line", "word_count", "text", "is_index")
    old = keep_first(existing, ["doc", "start_line"], ["chunk_id"]).select("doc", "start_line", "chunk_id", "embedding", F.struct(*content).alias("_old"))
    new = keep_first(planned, ["doc", "start_line"], ["end_line"]).select("doc", "start_line", *content, "section_no")
    joined = new.join(old, ["doc", "start_line"], "left")
    same = F.col("_old").eqNullSafe(F.struct(*content))
    return joined.select("chunk_id", "doc", "start_line", *content, "section_no", F.when(same, F.col("embedding")).alias("embedding"), (~same).alias("changed"))


#: Groups in which new rows are counted.
GROUPS = 1024


def numbered(merged: DataFrame, first: int, name: str = "chunk_id", keys: tuple[str, ...] = ("doc", "start_line")) -> DataFrame:
    """Gives rows without an id consecutive ones from a number on. They are dealt into GROUPS by a hash of their first key and
    counted there, so that a row for each group, and no more, comes to one task."""
    new = merged.where(F.col(name).isNull()).withColumn("_g", F.pmod(F.xxhash64(keys[0]), F.lit(GROUPS)))
    counts = new.groupBy("_g").agg(F.count("*").alias("n"))
    before = counts.select("_g", (F.sum("n").over(Window.orderBy("_g")) - F.col("n")).alias("_before"))  # GROUPS rows at most
    place = F.row_number().over(Window.partitionBy("_g").orderBy(*keys))
    named = new.join(F.broadcast(before), "_g").withColumn(name, (F.lit(first) + F.col("_before") + place - 1).cast("long")).drop("_g", "_before")
    return merged.where(F.col(name).isNotNull()).unionByName(named)


def merge_sections(existing: DataFrame, planned: DataFrame) -> DataFrame:
    """The sections after a merge: those planned, with the section_id of the existing section of the same document and first
    line, of several the smallest; null for new ones, which numbered() names. A changed title, level or end keeps the id."""
    old = existing.groupBy("doc", "start_line").agg(F.min("section_id").alias("section_id"))
    new = keep_first(planned, ["doc", "start_line"], ["section_no"])
    return new.join(old, ["doc", "start_line"], "left").select("section_id", *planned.columns)


def upsert_documents(existing: DataFrame, arrived: DataFrame) -> DataFrame:
    """(doc, path, line_count, expected_chunks, created_at) after documents arrived: what they say replaces what was known of
    them but for the time of creation; the others stay. Of rows that arrive for one document the one with the most lines
    counts."""
    new = keep_first(arrived, ["doc"], [F.desc("line_count"), "path"]).select("doc", *(F.col(x).alias(f"_{x}") for x in ("path", "line_count", "expected_chunks", "created_at")), F.lit(True).alias("_new"))
    both = existing.join(new, "doc", "full_outer")
    value = lambda x: F.when(F.col("_new"), F.col(f"_{x}")).otherwise(F.col(x)).alias(x)
    return both.select("doc", *(value(x) for x in ("path", "line_count", "expected_chunks")), F.coalesce("created_at", "_created_at").alias("created_at"))


def listed(files: DataFrame, states: DataFrame) -> DataFrame:
    """(name, size, size_label, label, ready) of files as discover() finds them, with the state of those that are indexed;
    the others are pending."""
    own = states.select(F.col("doc").alias("name"), "label")
    label = F.coalesce("label", F.lit("pending"))
    return files.select("name", "size").join(own, "name", "left").select("name", "size", T.size_label(F.col("size")).alias("size_label"), label.alias("label"), (label == "ready").alias("ready"))


def ready(rows: DataFrame) -> DataFrame:
    """One row (ready, total) of what listed() gives."""
    return rows.agg(F.count_if("ready").alias("ready"), F.count("*").alias("total"))


def merge_contexts(contexts: DataFrame, merged: DataFrame) -> DataFrame:
    """Contexts whose chunk is still there and unchanged."""
    return contexts.join(merged.where("not changed").select("chunk_id"), "chunk_id", "left_semi")


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Upsert of appended rows: the last one of each key."""
    return keep_first(rows, keys, [F.desc(at)])


def purge(table: DataFrame, present: DataFrame, key: str = "doc") -> DataFrame:
    """Rows of documents that are still there."""
    return table.join(present.select(key), key, "left_semi")


def pending(chunks: DataFrame, done: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks without a context or embedding yet."""
    return chunks.join(done.select(key), key, "left_anti")


def signature(*parts: Column) -> Column:
    """First 16 digits of the SHA-256 of the parts, a line each."""
    return F.left(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(16))


def signature_of(*parts: str) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]


def rebuilds(stored: dict[str, str | None], current: dict[str, str]) -> dict[str, bool]:
    """What changed settings ask for: contexts, embeddings, and whether chunks are cut anew. Nothing stored asks nothing."""
    changed = {k: stored.get(k) is not None and stored[k] != v for k, v in current.items()}
    return {"contexts": changed["context"], "embeddings": changed["embedding"] or changed["context"], "chunks": changed["chunk"]}


def status(documents: DataFrame, chunks: DataFrame, contexts: DataFrame) -> DataFrame:
    """State of every document (doc, expected_chunks): numbers and sizes of its chunks, of those with embedding and context,
    whether it is complete, and a label."""
    with_context = chunks.join(contexts.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("doc").agg(F.count("*").alias("contextualized"))
    sums = chunks.groupBy("doc").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("text_size"), F.coalesce(F.sum(4 * F.size("embedding")), F.lit(0)).alias("embed_size"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    wide = documents.select("doc", "expected_chunks").join(sums, "doc", "left").join(with_context, "doc", "left").select("doc", "expected_chunks", *(zero(c) for c in ("chunks", "embedded", "contextualized", "text_size", "embed_size")))
    complete = F.coalesce(F.col("chunks") >= F.col("expected_chunks"), F.lit(False))
    return wide.withColumn("complete", complete).withColumn("label", label())


def label() -> Column:
    """pending, ready, context p% or embed p%, from the columns of status()."""
    total = F.coalesce(F.nullif("expected_chunks", F.lit(0)), F.col("chunks"))
    part = lambda name, c: F.concat(F.lit(f"{name} "), T.progress(F.col(c), total).cast("string"), F.lit("%"))
    return F.when(F.col("chunks") == 0, "pending").when(F.col("embedded") >= total, "ready").when(F.col("contextualized") < total, part("context", "contextualized")).otherwise(part("embed", "embedded"))
