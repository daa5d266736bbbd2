"""Documents in folders: finding PDF and Markdown files, taking out text, reading and writing Markdown."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILES = "path string, modificationTime timestamp, length long, content binary"


def _listed(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    """(stem, path, length, modified) of the files of a folder itself."""
    try:
        rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").option("recursiveFileLookup", "false").load(folder)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], _FILES)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), rf"\.{ending}$", "")
    return rows.select(stem.alias("stem"), "path", "length", F.col("modificationTime").alias("modified"))


def discover(spark: SparkSession, docs_dir: str, data_dir: str) -> DataFrame:
    """(name, pdf, md, size, stale): the PDF files of a folder, with the Markdown of the same name from another, and Markdown
    without a PDF; by size and name. size is the PDF's if there is one. stale: the PDF is newer than its Markdown."""
    pdf, md = _listed(spark, docs_dir, "pdf"), _listed(spark, data_dir, "md")
    both = pdf.alias("p").join(md.alias("m"), "stem", "full_outer")
    return both.select(F.col("stem").alias("name"), F.col("p.path").alias("pdf"), F.col("m.path").alias("md"), F.coalesce("p.length", "m.length").alias("size"), F.coalesce(F.col("p.modified") > F.col("m.modified"), F.lit(False)).alias("stale")).orderBy("size", F.lower("name"))


def extract(spark: SparkSession, paths: str, make: Callable[[], Callable[[bytes, str], str]]) -> DataFrame:
    """(name, md) of files by an extractor (content, path) -> Markdown, one for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = make()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([take(content, path)])], ["name", "md"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "name string, md string")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, md) of the UTF-8 Markdown files of a folder, to the last line feed."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    return rows.select(name.alias("doc"), F.decode("content", "UTF-8").alias("md"))


def write_markdown(docs: DataFrame, folder: str) -> None:
    """A Parquet table (doc, md); a file for each document is for the edge of the system only."""
    docs.select("doc", "md").write.mode("append").parquet(folder)


def export_markdown(docs: DataFrame, folder: str) -> int:
    """Writes {doc}.md for each document into a local folder, one after another; returns their number."""
    import pathlib

    target, n = pathlib.Path(folder), 0
    target.mkdir(parents=True, exist_ok=True)
    for row in docs.select("doc", "md").toLocalIterator():
        (target / f"{row['doc'].replace('/', '_')}.md").write_text(row["md"], encoding="utf-8")
        n += 1
    return n
