"""Running values and previous rows by key, in an order, without a key's rows ever meeting in one task.

Rows are dealt by ranges of key and order and written, so a piece holds a stretch of one key or some whole keys. Each piece
is counted for itself. Only the first key of a piece can have begun in an earlier one, so what comes before is one row for a
piece at most, and is broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def _free(df: DataFrame) -> str:
    """A start of column names that ``df`` doesn't have."""
    mark = "_o"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return mark


def _dealt(rows: DataFrame, keys: list[str], order: list[str], piece: str) -> DataFrame:
    return written(rows.repartitionByRange(*keys, *order).withColumn(piece, F.spark_partition_id()))


def _met(rows: DataFrame, heads: DataFrame, keys: list[str], piece: str, m: str) -> DataFrame:
    """``rows`` with what came before their piece, for the keys that began earlier."""
    same = [F.col(k).eqNullSafe(F.col(f"{m}k{i}")) for i, k in enumerate(keys)]
    return rows.join(F.broadcast(heads), reduce(Column.__and__, [F.col(piece) == F.col(f"{m}at"), *same]), "left")


def running_sum(rows: DataFrame, keys: list[str], order: list[str], name: str, what: Column | None = None) -> DataFrame:
    """``rows`` with ``name``, the sum of ``what`` (by default of ones: a rank from 1) over the rows of the same keys up to
    each one. Null keys are keys of their own. Rows that tie in ``order`` are taken in any order: name columns that don't."""
    m = _free(rows)
    piece, ones = f"{m}piece", F.lit(1).cast("long") if what is None else what
    columns = [c for c in rows.columns if c.lower() != name.lower()]
    cut = _dealt(rows.withColumn(f"{m}w", ones), keys, order, piece)
    sums = cut.groupBy(*keys, piece).agg(F.sum(f"{m}w").alias(f"{m}sum"))
    earlier = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(*[F.col(k).alias(f"{m}k{i}") for i, k in enumerate(keys)], F.col(piece).alias(f"{m}at"), F.sum(f"{m}sum").over(earlier).alias(f"{m}before")).where(F.col(f"{m}before").isNotNull())
    here = Window.partitionBy(piece, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = _met(cut.withColumn(f"{m}here", F.sum(f"{m}w").over(here)), heads, keys, piece, m)
    so_far = F.when(F.col(f"{m}here").isNull(), F.col(f"{m}before")).otherwise(F.col(f"{m}here") + F.coalesce(f"{m}before", F.lit(0)))
    return local.select(*[F.col(f"`{c}`") for c in columns], so_far.alias(name))


def previous(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """``rows`` with values of the row before of the same keys: new name -> column. Null where there is none."""
    m = _free(rows)
    piece = f"{m}piece"
    kept = [c for c in rows.columns if c.lower() not in {n.lower() for n in columns}]
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns.values())])
    cut = _dealt(rows, keys, order, piece)
    lasts = cut.groupBy(*keys, piece).agg(F.max_by(whole, F.struct(*order)).alias(f"{m}last"))
    earlier = Window.partitionBy(*keys).orderBy(piece)
    heads = lasts.select(*[F.col(k).alias(f"{m}k{i}") for i, k in enumerate(keys)], F.col(piece).alias(f"{m}at"), F.lag(f"{m}last").over(earlier).alias(f"{m}before")).where(F.col(f"{m}before").isNotNull())
    local = cut.withColumn(f"{m}here", F.lag(whole).over(Window.partitionBy(piece, *keys).orderBy(*order)))
    found = F.coalesce(f"{m}here", f"{m}before")
    return _met(local, heads, keys, piece, m).select(*[F.col(f"`{c}`") for c in kept], *[found[f"c{i}"].alias(n) for i, n in enumerate(columns)])
