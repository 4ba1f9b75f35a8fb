"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed hashes the tokens at a mask's positions and ignores the others, so a substituted token spoils only the seeds that
look at it. Seeds of the benchmark and of the documents are joined; around each hit the two texts are laid over each
other without gaps and the matching tokens of every window are counted, which tolerates substitutions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, sifted, small_enough, spread, spread_join, written

#: Token positions that each mask looks at. Together they hit every window that ``allowed`` accepts, from LEAST tokens up
#: to 13 (a test tries all placements of substitutions); a longer window holds such a one.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7))

#: Items of fewer tokens are no evidence and match nothing.
LEAST = 8

#: Parts into which the documents' seeds are dealt where the benchmark's are too many to be broadcast.
PARTS = 16


def tokens_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, as 64-bit hashes."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds_of(tokens: Column, masks: tuple[tuple[int, ...], ...] = MASKS) -> Column:
    """(mask, position, seed) of every position where a mask fits."""

    def by(number: int, mask: tuple[int, ...]) -> Column:
        last = F.size(tokens) - (mask[-1] + 1)
        made = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(number), *[F.get(tokens, i + k) for k in mask]))
        return F.when(last >= 0, made).otherwise(F.array().cast("array<bigint>"))

    return [by(i, m) for i, m in enumerate(masks)]


def allowed(window: Column) -> Column:
    """Substitutions that a window may hold: a fifth of its tokens, one below 11 tokens."""
    return F.when(window >= 11, F.floor(window * 0.2)).otherwise(1).cast("int")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """Overlaps of documents with benchmark items: ``doc_id``, ``item_id``, ``matched`` int, ``width`` int,
    ``doc_token`` and ``item_token`` int (where the best window starts), one row for each pair that overlaps.

    A pair overlaps if ``window`` consecutive tokens of the item (all of a shorter item) equal, up to ``allowed``
    substitutions, as many consecutive tokens of the document; of several windows the one with most matches is told,
    then the first in the document, then the first in the item.

    Cases: null or empty texts and items of fewer than 8 tokens overlap nothing; null ids and rows that repeat an id
    are judged like others, and their pairs are reported once; empty tables give no rows; other columns are not read.

    Seeds of the benchmark are broadcast when they are counted to be few. Else a bitmap of them, whose size is bounded, is
    broadcast and keeps back the documents' seeds that no item has; those left are dealt by seed and a salt, so that the
    seeds of a common phrase spread. So it is with documents that have hits: only their texts are read again and shuffled.
    """
    if not LEAST <= window <= 13 and masks == MASKS:
        raise ValueError("the default masks are complete for windows of 8 to 13 tokens")
    items = benchmark.select(F.col(item_id).alias("item_id"), tokens_of(F.col(item_text)).alias("it")).where(F.size("it") >= LEAST).distinct()
    items = written(items.select("item_id", "it", F.xxhash64("it").alias("version")))

    def exploded(df: DataFrame, keys: list[str], tokens: str, at: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [df.select(*keys, F.posexplode(s).alias(at, "seed")) for s in seeds_of(F.col(tokens), masks)])

    probes = written(exploded(items, ["item_id", "version"], "it", "item_at"))
    key = F.col(doc_id).alias("doc_id")
    read = docs.select(key, tokens_of(F.col(text)).alias("dt"))
    #: one explode for all masks, so that the texts are read and hashed once
    both = read.select("doc_id", F.explode(F.array(*seeds_of(F.col("dt"), masks))).alias("seeds")).select("doc_id", F.posexplode("seeds").alias("doc_at", "seed"))
    if small_enough(probes):
        met = both.join(F.broadcast(probes), "seed")
    else:
        salted = sifted(both, F.col("seed"), probes.select("seed")).withColumn("part", F.pmod(spread(F.col("doc_id"), F.col("doc_at")), F.lit(PARTS)))
        met = salted.join(probes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))), ["seed", "part"])
    hits = written(met.select("doc_id", "item_id", "version", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).distinct())

    keyed = hits.withColumnRenamed("doc_id", "hit_doc")
    texts = docs.select(key, F.col(text).alias("text"))
    tokens = tokens_of(F.col("text")).alias("dt")
    same_doc = F.col("doc_id").eqNullSafe(F.col("hit_doc"))
    if small_enough(hits):
        named = F.broadcast(keyed.select("hit_doc").distinct())
        joined = texts.join(named, same_doc, "left_semi").select("doc_id", tokens).join(F.broadcast(keyed), same_doc).drop("hit_doc")
    else:
        joined = sifted(texts, F.xxhash64("doc_id"), hits.select(F.xxhash64("doc_id"))).select("doc_id", tokens).join(keyed, same_doc).drop("hit_doc")
    joined = joined.where(F.size("dt") >= LEAST)
    if small_enough(items, weight=1 + F.size("it") / 8):
        known = items.withColumnsRenamed({"item_id": "known_item", "version": "known_version"})
        joined = joined.join(F.broadcast(known), F.col("item_id").eqNullSafe(F.col("known_item")) & (F.col("version") == F.col("known_version")))
    else:
        per = written(hits.groupBy("item_id", "version").agg(F.count("*").alias("n_hits")))
        total = per.agg(F.sum("n_hits")).first()[0] or 0
        per = per.withColumnsRenamed({"item_id": "of", "version": "hit_version"})
        counted = written(items.join(per, F.col("item_id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("hit_version"))).select(F.xxhash64("item_id").alias("name"), "version", "it", "n_hits"))
        joined = spread_join(joined, counted, {"name": F.xxhash64("item_id"), "version": F.col("version")}, {"it": "it"}, "n_hits", total, F.xxhash64("doc_id", "diagonal")).where(F.col("it").isNotNull())

    low, high = F.greatest(F.lit(0), -F.col("diagonal")), F.least(F.size("it"), F.size("dt") - F.col("diagonal"))
    same = F.transform(F.sequence(low, high - 1), lambda i: (F.get(F.col("dt"), i + F.col("diagonal")) == F.get(F.col("it"), i)).cast("int"))
    laid = joined.withColumn("width", F.least(F.lit(window), F.size("it"))).where(high - low >= F.col("width")).select("doc_id", "item_id", "diagonal", "width", low.alias("low"), same.alias("same"))
    windows = F.transform(F.sequence(F.lit(0), F.size("same") - F.col("width")), lambda s: F.struct((-F.aggregate(F.slice("same", s + 1, F.col("width")), F.lit(0), lambda a, x: a + x)).alias("missed"), (s + F.col("low") + F.col("diagonal")).alias("doc_token"), (s + F.col("low")).alias("item_token")))
    best = laid.select("doc_id", "item_id", "width", F.array_min(windows).alias("w")).where(-F.col("w.missed") >= F.col("width") - allowed(F.col("width")))
    one = best.groupBy("doc_id", "item_id").agg(F.min(F.struct("w", "width")).alias("b"))
    return one.select("doc_id", "item_id", (-F.col("b.w.missed")).alias("matched"), F.col("b.width").alias("width"), F.col("b.w.doc_token").alias("doc_token"), F.col("b.w.item_token").alias("item_token"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that overlap no benchmark item, with all their columns. A row with a null id goes only if a row
    with a null id overlaps."""
    name = fresh(docs, "leaked")
    leaked = contaminated(docs, benchmark, doc_id=doc_id, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaked, docs[doc_id].eqNullSafe(leaked[name]), "left_anti")
