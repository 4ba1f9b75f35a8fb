"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_sql, html_extract, language_id, line_dedup, nearest, ngram_join, suffix_dedup, token_counts, url_filter, url_filter_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.ngram_join(docs).select("doc_id", "class_id", "n_links")


#: Rules of the url query.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    taught = docs.where(~out & F.col("doc_id").isNotNull())
    profiles = language_id.fit_profiles(taught, order=F.col("doc_id"))
    return language_id.identify_language(docs.select("doc_id", "text", out.alias("held_out")), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = line_dedup.line_keep_runs(docs, min_docs=10, min_chars=1)
    return judged.select("doc_id", "n_lines", "n_dropped", F.sha2(line_dedup.kept_text(F.col("text"), F.col("keep_runs")), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
    SELECT doc_id, i, list_extract(string_split(coalesce(text, ''), chr(10)), i) AS line
    FROM documents, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS t(i)
), keyed AS (
    SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), frequent AS (
    SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), judged AS (
    SELECT doc_id, i, line, k IN (SELECT k FROM frequent) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix_dedup.repeated_spans(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extracted(pages, html_extract.fit_on(pages)).select("page_id", "url", "text", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_url_filter, op3_decontaminate, op4_language_id, op5_byte_bpe, op6_nearest, op7_line_dedup, op8_token_counts, op9_suffix_dedup, op10_html_extract)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": exact_sql.NGRAM_JOIN.strip(),
        "op2_url_filter": url_filter_sql.sql(URL_RULES),
        "op3_decontaminate": exact_sql.DECONTAMINATE.strip(),
        "op7_line_dedup": OP7_SQL.strip(),
        "op9_suffix_dedup": exact_sql.SUFFIX_DEDUP.strip(),
    }
