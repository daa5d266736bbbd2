"""Markdown that arrives as a stream, merged into a table of chunks batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import maintenance, structure

SCHEMA = "doc string, md string"


def merge_batch(arrived: DataFrame, store: str, version: int) -> None:
    """Writes version n + 1 of a chunk table: documents that arrived are cut anew and merged, others stay. Each version is a
    folder of its own, so a batch that runs twice writes the same one, and no path is read while it is written."""
    spark = arrived.sparkSession
    docs = maintenance.keep_first(arrived, ["doc"], [F.desc("md")])
    planned = structure.with_section(structure.chunks(docs), structure.sections(docs))
    if version:
        old = spark.read.parquet(f"{store}/v={version}")
    else:
        old = spark.createDataFrame([], "chunk_id long, doc string, start_line int, end_line int, word_count int, text string, is_index boolean, section_no int, embedding array<float>")
    touched = old.join(docs.select("doc"), "doc", "left_semi")
    first = (old.agg(F.max("chunk_id")).first()[0] or 0) + 1
    merged = maintenance.numbered(maintenance.merge_chunks(touched, planned), first).select(old.columns)
    old.join(docs.select("doc"), "doc", "left_anti").select(old.columns).unionByName(merged).write.mode("overwrite").parquet(f"{store}/v={version + 1}")


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str) -> StreamingQuery:
    """Merges all Parquet files (doc, md) of a folder that are there, and ends."""
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, n: merge_batch(batch, store, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
