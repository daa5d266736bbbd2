"""From raw documents to tokens: a pipeline of five stages, each written as Parquet and read again by the next.

1. language: documents that no language model explains are rejected; null texts and texts without a letter go as well.
2. near_duplicates: of each group of documents linked by SimHash the one with the smallest id stays.
3. decontaminate: documents that hold a benchmark item, within its error budget, go.
4. personal_data: e-mail and IP addresses, card and phone numbers become marks; every document stays.
5. encode: token ids and the text decoded from them.

All stages but the last return the columns of documents, further columns of the input included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_automaton, decontaminate, langid, pii, simhash
from tessera.llm.common import release, shared_dir
from tessera.session import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.with_length(pii.redact(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded)."""
    import public_tokenizers

    coded = bpe_automaton.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", without_benchmark),
    ("personal_data", personal_data),
    ("encode", encode),
]

#: SQL has neither the language models nor the tagger; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between is written into the shared folder, and deleted once the next stage is
    written. What the last stage reads stays, as its result is not yet computed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                release(spark, before)
            before = path
    return docs
