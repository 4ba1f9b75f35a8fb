"""A corpus pipeline in five stages: language ID, line dedup, near-duplicate join, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; what it returns is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.

Cases, in every stage: a table with no rows goes through; a null text counts as empty, so it goes in the first stage; a null
doc_id, lang, source or n_chars stays as it is; rows that repeat an id are judged each; further columns pass through all
stages but the last, also where they are named like columns that operators add."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import bpe, decontaminate, language_id, line_dedup, ngram_join
from loomspan.llm.common import fresh, marker, named, sized, written
from loomspan.sources.shared import scratch

#: Documents whose likeness to the nearest language profile is below this are in none of the languages. (Texts of five
#: letters have 0.4 or more in their own language; a text in another script has next to nothing.)
LEAST_LIKE = 0.2


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. Documents without a letter go, and those that are like none of the languages (score below LEAST_LIKE).
    Profiles are learned from labelled documents, without those held out for testing."""
    taught = docs.where(~language_id.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    profiles = language_id.fit_profiles(taught, order=F.col("doc_id"))
    m = marker(docs)
    kept = docs.withColumnsRenamed({c: f"{m}{c}" for c in docs.columns if c.lower() in ("lang_pred", "score")})
    said = language_id.identify_language(kept, profiles)
    said = said.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LIKE))
    return said.select(*[named(f"{m}{c}" if c.lower() in ("lang_pred", "score") else c).alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Lines found in 10 documents or more go; ``text`` and ``n_chars`` are what is left. Where nothing but
    blank lines would be left, the first document by id of each such text keeps it whole, so that the join sees one copy;
    of the others, those all of whose lines go have nothing left and go too."""
    m = marker(docs)
    outs = ("keep_runs", "n_dropped", "n_lines")
    names = docs.columns
    docs = docs.withColumnsRenamed({c: f"{m}{c}" for c in names if c.lower() in outs})
    judged = written(line_dedup.line_keep_runs(docs, min_docs=10, min_chars=1))
    left, key, first = fresh(judged, "left"), fresh(judged, "text_key"), fresh(judged, "first_id")
    judged = judged.withColumn(left, line_dedup.kept_text(F.col("text"), F.col("keep_runs")))
    bare = (F.col("n_dropped") > 0) & (F.btrim(F.col(left), F.lit(line_dedup.STRIPPED)) == "")
    emptied = judged.where(bare).withColumn(key, F.md5("text"))
    firsts = sized(written(emptied.groupBy(key).agg(F.min("doc_id").alias(first))))
    firsts = firsts.withColumnRenamed(key, f"{key}_")
    known = F.col(f"{key}_").isNotNull()
    held = emptied.join(firsts, (F.col(key) == F.col(f"{key}_")) & F.col("doc_id").eqNullSafe(F.col(first)), "left")
    held = held.where(known | (F.col("n_dropped") < F.col("n_lines"))).withColumn(left, F.when(known, F.col("text")).otherwise(F.col(left)))
    rest = {"text": F.col(left).alias("text"), "n_chars": F.length(left).cast("long").alias("n_chars")}
    both = judged.where(~bare).unionByName(held.select(*[named(c) for c in judged.columns]))
    return both.select(*[rest.get(c, named(f"{m}{c}" if c.lower() in outs else c).alias(c)) for c in names])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1. Of each group of documents linked by a similarity of 0.8 or more on five-word runs, the one with the
    smallest id stays."""
    return ngram_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3. Documents that overlap a benchmark item go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5. The digests of each document's token ids, and of the bytes decoded from them."""
    made = bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("ngram_join", near_copies),
    ("decontaminate", decontaminated),
    ("byte_bpe", encoded),
]

#: SQL can't express rank-order profiles or byte-pair merges; a test holds the stages against plain Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, with each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch() as keep:  # a stage's own tables go as soon as its result is written
            docs = keep(stage(spark, docs, sf_dir))
    return docs
