"""Line dedup with DataFrame functions only: digests of lines are dealt by range and sorted by document and position; each
task streams over its stretch and marks first occurrences; what comes back for a document is a run-length bitmap of its
lines, not text."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import marker, maybe_among, small_enough, without, written

#: White space stripped at both ends of a line: space and U+0009 to U+000D.
STRIPPED = " \t\n\x0b\x0c\r"

#: Parts into which the occurrences of one digest can be dealt, by a hash of the document.
PARTS = 1024


def lines_of(text: Column) -> Column:
    """The lines of a text; null and the empty text have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line stripped at both ends, with A-Z (and no other letters) lower-cased."""
    bare = F.btrim(line, F.lit(STRIPPED))
    ascii_only = F.length(bare) == F.octet_length(bare)  # then lower() touches A-Z alone, and is much faster
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def dropped_runs(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc`` (the id), ``version`` long (a hash of the text, for rows that share an id), ``runs`` array<int> and
    ``n_dropped`` long of the documents from which a line goes. ``runs`` are lengths over the lines, kept and dropped in
    turn, a kept run (maybe 0) first; lines after the last run stay. Which lines go: see ``line_keep_runs``.

    Every line is a row (digest, document, position), without its text. Rows are dealt by range of the digest and a part
    of the documents, so a frequent digest spreads over up to PARTS stretches, and sorted by document and position. A
    window streams over each stretch and marks a document's first occurrence. Of the marks, one number for each stretch is
    summed by digest, and the frequent digests go back to their stretches: by broadcast if they are few (counted), else
    by a join on digest and part, which has no hot key.
    """
    doc, t = F.col(doc_id), F.col(text)
    digests = F.transform(lines_of(t), lambda x: F.when(F.length(line_key(x)) >= min_chars, F.unhex(F.md5(line_key(x)))))
    part = F.pmod(F.xxhash64("doc"), F.lit(PARTS)).cast("int")
    found = docs.select(doc.alias("doc"), F.xxhash64(t).alias("version"), F.posexplode(digests).alias("at", "h"))
    found = written(found.where(F.col("h").isNotNull()).withColumn("part", part))
    stretch = Window.partitionBy("h", "part").orderBy("doc", "version", "at")
    first = (F.row_number().over(stretch) == 1) | ~F.lag("doc").over(stretch).eqNullSafe(F.col("doc"))
    streamed = written(found.repartitionByRange("h", "part").withColumn("first", first))
    counts = streamed.groupBy("h").agg(F.count_if("first").alias("n"), F.min(F.struct("doc", "version", "at")).alias("begin"))
    often = written(counts.where(F.col("n") >= min_docs).select("h", "begin"))
    if small_enough(often):
        gone = streamed.join(F.broadcast(often), "h")
    else:
        gone = streamed.join(streamed.select("h", "part").distinct().join(often, "h"), ["h", "part"])
    if keep_first:
        gone = gone.where(F.struct("doc", "version", "at") != F.col("begin"))
    g = F.col("g")
    each = gone.groupBy("doc", "version").agg(F.array_sort(F.collect_set("at")).alias("g"))
    begins = F.filter(g, lambda x, i: F.coalesce(F.get(g, i - 1) != x - 1, F.lit(True)))
    ends = F.filter(g, lambda x, i: F.coalesce(F.get(g, i + 1) != x + 1, F.lit(True)))
    each = each.select("doc", "version", begins.alias("b"), ends.alias("e"), F.size("g").cast("long").alias("n_dropped"))
    runs = F.flatten(F.transform("b", lambda b, i: F.array(b - F.coalesce(F.get("e", i - 1) + 1, F.lit(0)), F.get("e", i) - b + 1)))
    return each.select("doc", "version", runs.alias("runs"), "n_dropped")


def line_keep_runs(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text", keep_first: bool = False) -> DataFrame:
    """Which lines of each document stay when every line whose key is found in ``min_docs`` documents or more goes (with
    ``keep_first``, all but its first occurrence by document and position).

    Returns the columns of ``docs`` and

    * ``n_lines`` long, lines before dropping; ``n_dropped`` long;
    * ``keep_runs`` array<int>: run lengths over the lines, kept and dropped in turn, a kept run (maybe 0) first.

    Keys shorter than ``min_chars`` code points stay.

    Cases: null and empty texts have one empty line, which stays; a key counts once for each distinct doc_id (rows
    with a null doc_id count together as one document); repeated rows each get a row; an empty table gives no rows;
    extra columns pass through, and one named like an output is replaced.

    Only run lengths come back from ``dropped_runs``, keyed by the id and a hash of the text. A bitmap of these keys, whose
    size is bounded, tells the documents that may lose a line: those alone are shuffled to meet their run lengths.
    """
    m = marker(docs)
    told = written(dropped_runs(docs, min_docs, min_chars, keep_first, doc_id, text))
    told = told.select(F.col("doc").alias(f"{m}doc"), F.col("version").alias(f"{m}version"), F.col("runs").alias(f"{m}runs"), F.col("n_dropped").alias(f"{m}gone"))
    held = docs.withColumn(f"{m}hash", F.xxhash64(F.col(text)))
    held = maybe_among(held, F.xxhash64(F.col(doc_id), F.col(f"{m}hash")), told.select(F.xxhash64(f"{m}doc", f"{m}version").alias("code")), f"{m}may")
    met = held.where(F.col(f"{m}may")).join(told, F.col(doc_id).eqNullSafe(F.col(f"{m}doc")) & (F.col(f"{m}hash") == F.col(f"{m}version")), "left")
    out = met.unionByName(held.where(~F.col(f"{m}may")), allowMissingColumns=True)
    whole = F.coalesce(F.col(text), F.lit(""))
    n_lines = (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("int")
    out = out.withColumn(f"{m}n", n_lines)
    runs, n = F.col(f"{m}runs"), F.col(f"{m}n")
    rest = n - F.aggregate(runs, F.lit(0), lambda a, x: a + x)
    return out.select(
        *without(docs, "n_lines", "n_dropped", "keep_runs"),
        n.cast("long").alias("n_lines"),
        F.coalesce(f"{m}gone", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(runs.isNull(), F.array(n)).when(rest > 0, F.concat(runs, F.array(rest))).otherwise(runs).alias("keep_runs"),
    )


def kept_text(text: Column, keep_runs: Column) -> Column:
    """The kept lines joined by a newline. A text without a dropped line is returned as it is (null as empty)."""
    keep = F.flatten(F.transform(keep_runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    kept = F.transform(F.filter(F.arrays_zip(lines_of(text).alias("line"), keep.alias("keep")), lambda x: x["keep"]), lambda x: x["line"])
    return F.when(F.size(keep_runs) <= 1, F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))
