"""Token counts of documents from flat token files without an index, by a scan for the end-of-document identifier.

Files hold token identifiers of fixed width, one document after another, each ended by the separator. A file is cut into
blocks at fixed offsets, whatever the documents do; in each block one vectorised comparison finds all separators. A block
knows the lengths of the documents that begin and end in it, how many end in it, and where its last separator stands. An
exclusive prefix scan over the blocks of a file, of the sum of the ends and of the largest position, then gives the number
of its first document and the tokens that earlier blocks hold of it.

Files are written by Spark's text writer, with the separator's bytes as the line separator. A second flat file from the same
task holds the documents' ids in the same order, as decimal digits, so that numbers can be turned into ids again. Both are
begun anew after the same number of documents, which bounds what a reader holds, and have the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bpe_automaton import codec
from tessera.llm.common import batch_rows, shared_dir, slices

#: Tokens in a block; characters encoded at once; documents in a file.
BLOCK, CHARS, FILE = 1 << 18, 500_000, 4000


def write(docs: DataFrame, path: str, tokenizer: str, separator: int, key: str = "doc_id", text: str = "text", width: int = 2) -> None:
    """Write stream=tokens and stream=ids below a path. Null text is a document without tokens; a null id is empty."""
    kind = np.dtype(f"<u{width}")
    ends = np.array([separator], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = codec(tokenizer), 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for a, b in slices([len(x) for x in texts], CHARS):
                values = [x.astype(kind).tobytes() for x, _ in own.encode_checked(texts[a:b], special=False)]
                names = [np.frombuffer(b"" if i is None else str(i).encode(), np.uint8).astype(kind).tobytes() for i in ids[a:b]]
                order = list(range(number, number + b - a))
                number += b - a
                for stream, column in (("tokens", values), ("ids", names)):
                    yield pa.RecordBatch.from_arrays([pa.array([stream] * len(order)), pa.array(order, pa.int64()), pa.array(column, pa.binary())], ["stream", "number", "value"])

    rows = docs.selectExpr(f"cast(`{key}` as long) id", f"`{text}` t").mapInArrow(run, "stream string, number long, value binary")
    flat = rows.sortWithinPartitions("stream", "number").select("stream", F.col("value").cast("string"))
    with batch_rows(docs.sparkSession, 1000):
        flat.write.partitionBy("stream").option("maxRecordsPerFile", FILE).option("encoding", "ISO-8859-1").option("lineSep", ends.decode("latin-1")).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def blocks_of(tokens: np.ndarray, separator: int, size: int = BLOCK) -> Iterator[tuple]:
    """(block, tokens before it, its tokens, separators in it, position of the last or -1, lengths ended in it)."""
    for k, at in enumerate(range(0, len(tokens), size)):
        part = tokens[at : at + size]
        ends = np.flatnonzero(part == separator)
        lengths = np.diff(ends, prepend=-1) - 1
        yield k, at, len(part), len(ends), at + int(ends[-1]) if len(ends) else -1, lengths


_BLOCKS = "file string, block int, start long, size long, ends long, last long, lengths array<long>"


def scan(spark: SparkSession, path: str, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, number long, n_tokens long, ended boolean) of every document of the flat files below a path.

    number counts from 0 in each file. Tokens after the last separator are a document that is not ended; nothing after it
    is none. Empty documents count; an empty file has none. A file is at most the 2 GB that a binary row holds; its length
    must be a multiple of the width.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(content.as_buffer(), f"<u{width}")
                rows = list(blocks_of(tokens, separator, block))
                if not rows:
                    continue
                number, start, size, ends, last, lengths = zip(*rows, strict=True)
                offsets = pa.array(np.cumsum([0, *map(len, lengths)]), pa.int32())
                columns = [pa.array([name] * len(rows)), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, ends, last)), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lengths), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _BLOCKS.split(", ")])

    blocks = _files(spark, path).mapInArrow(run, _BLOCKS)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    final = Window.partitionBy("file").orderBy(F.desc("block"))
    stitched = blocks.select("*", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("since"), (F.row_number().over(final) == 1).alias("at_end"))
    carried = F.col("start") - F.col("since") - 1
    ended = stitched.select("file", "first", carried.alias("carried"), F.posexplode("lengths").alias("k", "length")).select("file", (F.col("first") + F.col("k")).alias("number"), (F.col("length") + F.when(F.col("k") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = F.col("start") + F.col("size") - F.greatest("since", "last") - 1
    opened = stitched.where("at_end").select("file", (F.col("first") + F.col("ends")).alias("number"), rest.alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return ended.unionByName(opened)


def ids(spark: SparkSession, path: str, separator: int, width: int = 2) -> DataFrame:
    """(file, number long, id long) from the flat files of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(content.as_buffer(), f"<u{width}")
                cuts = np.flatnonzero(values == separator)
                text = np.where(values == separator, 10, values).astype(np.uint8).tobytes().decode()
                found = [int(x) if x else None for x in text.split("\n")[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cuts)), pa.array(np.arange(len(cuts))), pa.array(found, pa.int64())], ["file", "number", "id"])

    return _files(spark, path).mapInArrow(run, "file string, number long, id long")


def token_counts(docs: DataFrame, tokenizer: str, separator: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long) of every row, by writing flat files into the shared folder and scanning them.

    Null and empty texts have no tokens; repeated rows are repeated; a null id stays null; other columns are not looked at;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    write(docs, path, tokenizer, separator, key, text)
    if docs.isEmpty():
        return spark.createDataFrame([], f"`{key}` long, n_tokens long")
    found = scan(spark, f"{path}/stream=tokens", separator).select("file", "number", "n_tokens")
    return found.join(ids(spark, f"{path}/stream=ids", separator), ["file", "number"]).select(F.col("id").alias(key), "n_tokens")
