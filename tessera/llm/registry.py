"""Queries of the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm import separators

    return separators.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 50256)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import langid

    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import warc

    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op4_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import mpegts

    return mpegts.read_media(mpegts.to_media(table(spark, sf_dir, "documents")))


def op5_html_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import html_text

    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import substrings

    return substrings.digests(table(spark, sf_dir, "documents"))


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm import bpe_automaton

    return bpe_automaton.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import pii

    return pii.find(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import decontaminate

    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_separator_scan": op1_separator_scan,
    "op2_language_id": op2_language_id,
    "op3_warc_chunks": op3_warc_chunks,
    "op4_mpegts": op4_mpegts,
    "op5_html_line_blocks": op5_html_line_blocks,
    "op6_repeated_substrings": op6_repeated_substrings,
    "op7_bpe_automaton": op7_bpe_automaton,
    "op8_simhash": op8_simhash,
    "op9_pii_tagger": op9_pii_tagger,
    "op10_decontaminate": op10_decontaminate,
}

SQL: dict[str, str] = {}


def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_warc_chunks that SQL expresses."""
    return op3_warc_chunks(spark, sf_dir).select("page_id", "payload_bytes", "record_type", "refers_to")


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_pii_tagger that SQL expresses: numbers of spans of the patterns."""
    return op9_pii_tagger(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES |= {"warc_records": warc_records, "personal_data_counts": personal_data_counts}

SQL |= {
    "warc_records": """SELECT p.page_id, strlen(coalesce(html, '')) AS payload_bytes, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM pages p JOIN (SELECT coalesce(html, '') AS h, min(page_id) AS first FROM pages GROUP BY 1) f ON f.h = coalesce(p.html, '')""",
    "personal_data_counts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
  list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card, list_transform(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS phone FROM d)
SELECT doc_id, len(email) AS n_email, len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR coalesce(try_cast(y AS INTEGER), 0) > 255)) = 0)) AS n_ip,
  len(list_filter(card, lambda x: length(x) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda k: CASE WHEN (length(x) - k) % 2 = 1 THEN (2 * (ascii(x[k]) - 48)) // 10 + (2 * (ascii(x[k]) - 48)) % 10 ELSE ascii(x[k]) - 48 END)) % 10 = 0)) AS n_card,
  len(list_filter(phone, lambda n: n BETWEEN 10 AND 15)) AS n_phone FROM f""",
}
