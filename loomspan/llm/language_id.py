"""Language identification by rank-order profiles: the most frequent n-grams of a text, in order of frequency, are held
against each language's own order; the language with the least out-of-place distance wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, threshold, without

#: n-grams of a profile, and training texts for each language that are expected in the (bounded) training sample.
TOP, TEXTS_PER_LANGUAGE = 400, 2_000

#: The answer for a text without a letter.
UNDETERMINED = "und"

_WORDS = regex.compile(r"\p{L}+")


def held_out(doc_id: Column) -> Column:
    """Documents that are kept for testing: crc32 of the id's text, modulo 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def ranked_grams(text: str | None, top: int | None = TOP) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent 1-, 2- and 3-grams of the lower-cased letters (words are set off by one space), the most
    frequent first and the smaller code first among equals, and their counts. A gram is packed 21 bits a character."""
    words = _WORDS.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = c[:-1] << 21 | c[1:]
    grams, n = np.unique(np.concatenate([c[c != 32], two, two[:-1] << 21 | c[2:]]), return_counts=True)
    if top is not None and len(grams) > top:  # all that may be among the first, ties at the edge included
        near = n >= np.partition(n, len(n) - top)[len(n) - top]
        grams, n = grams[near], n[near]
    order = np.lexsort((grams, -n))[:top]
    return grams[order], n[order]


def fit_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, per_language: int = TEXTS_PER_LANGUAGE, order: Column | None = None) -> dict[str, list[int]]:
    """For each language its ``top`` n-grams in order, from a sample of about ``per_language`` labelled texts each.

    The sample is drawn by a hash of ``order`` (default: the text), with a rate from the counted labels, so it is the
    same on every run and its size does not grow with the table. Counting runs in Spark; what reaches the driver is
    ``top`` n-grams for each language. Rows with a null label or no letter add nothing.
    """
    rows = bounded_batches(labelled).where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text) if order is None else order).alias("at"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    rate = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, threshold(per_language, n))])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, texts in batch.groupby("lang")["text"]:
                each = [ranked_grams(t, None) for t in texts]
                grams, at = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in each]), len(grams)).astype(np.int64)
                yield pd.DataFrame({"lang": name, "gram": grams, "n": n})

    counts = rows.where(F.col("at") <= F.element_at(rate, F.col("lang"))).select("lang", "text").mapInPandas(counted, "lang string, gram long, n long")
    summed = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    found = summed.withColumn("place", F.row_number().over(first)).where(F.col("place") <= top).orderBy("lang", "place").collect()
    out: dict[str, list[int]] = {name: [] for name in sorted(sizes)}
    for r in found:
        out[r["lang"]].append(r["gram"])
    return {name: grams for name, grams in out.items() if grams}


class Profiles:
    """The languages' places side by side, for one search for all languages."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP):
        self.names, self.top = sorted(profiles), top
        self.grams = np.unique(np.concatenate([np.asarray(profiles[n], np.int64) for n in self.names])) if profiles else np.empty(0, np.int64)
        self.place = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.place[i, np.searchsorted(self.grams, profiles[name])] = np.arange(len(profiles[name]))

    def best(self, text: str | None) -> tuple[str, float]:
        grams, _ = ranked_grams(text, self.top)
        if not len(grams) or not self.names:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.grams, grams)
        at[(at >= len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != grams)] = len(self.grams)
        place = self.place[:, at]
        away = np.where(place < 0, self.top, np.abs(place - np.arange(len(grams)))).sum(axis=1)
        i = int(away.argmin())
        return self.names[i], 1.0 - float(away[i]) / (self.top * len(grams))


def identify_language(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", top: int = TOP) -> DataFrame:
    """``docs`` with ``lang_pred`` string and ``score`` double: 1 is the language's own order, 0 no n-gram in common.

    Only the text is looked at, all of it. Cases: a null text or one without a letter gives ``und`` and 0; the first
    language by name wins a tie; without profiles all is ``und``; repeated rows each get a row; an empty table gives
    none; columns of ``docs`` named like the outputs are replaced.
    """

    @F.pandas_udf("lang_pred string, score double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = Profiles(profiles, top)
        for texts in batches:
            yield pd.DataFrame([table.best(t) for t in texts], columns=["lang_pred", "score"])

    name = fresh(docs, "language")
    return bounded_batches(docs).withColumn(name, best(F.col(text))).select(*without(docs, "lang_pred", "score"), F.col(name)["lang_pred"].alias("lang_pred"), F.col(name)["score"].alias("score"))
