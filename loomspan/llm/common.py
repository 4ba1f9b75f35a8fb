"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written  # noqa: F401

#: Rows of a table that may be broadcast after its rows were counted; at 64 bytes a row it takes some 6 MB.
BROADCAST_ROWS = 100_000

#: A key with more than one in so many rows is hot. There are fewer hot keys than this number, whatever the table's size.
HOT_SHARE = 1000

#: Spark settings that bound what a Python worker gets at once, and what they are lowered to.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands rows to Python in batches of 2,000 rows and 8 MB at most: a worker's memory
    then doesn't grow with the length of texts. Spark reads these settings when a job starts, so they stay lowered; smaller
    values of the caller are left alone."""
    conf = df.sparkSession.conf
    for name, most in _BATCHES.items():
        number = re.fullmatch(r"(\d+)([kmg]?)b?", conf.get(name).lower())
        if number is None or not 0 < int(number[1]) << " kmg".index(number[2] or " ") * 10 <= most:
            conf.set(name, str(most))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def marker(df: DataFrame) -> str:
    """A start of column names that no column of ``df`` has (names compare without case)."""
    mark = "_m"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return mark


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col(f"`{column.replace('`', '``')}`")


def without(df: DataFrame, *names: str) -> list[Column]:
    """All columns of ``df`` but those that an operator is about to return itself."""
    gone = {n.lower() for n in names}
    return [named(c) for c in df.columns if c.lower() not in gone]


def drawn(code: Column, wanted: int, n: int) -> Column:
    """Whether a row of ``n`` is in a sample of about ``wanted``: its 64-bit hash is held against a threshold as wide, so
    the rate is right for any ``n``."""
    return code <= F.lit(threshold(wanted, n))


def threshold(wanted: int, n: int) -> int:
    """The 64-bit hash up to which about ``wanted`` of ``n`` rows lie."""
    return -(1 << 63) + min((1 << 64) - 1, (wanted << 64) // max(n, 1))


def small_enough(df: DataFrame, most: int | None = None, weight: Column | None = None) -> bool:
    """Whether ``df`` (already written) has at most ``most`` rows, so that it may be broadcast; ``weight`` says how many
    rows of usual size a row counts for."""
    most = BROADCAST_ROWS if most is None else most
    if weight is None:
        return df.limit(most + 1).count() <= most
    return (df.agg(F.sum(weight)).first()[0] or 0) <= most


def sized(df: DataFrame, most: int | None = None, weight: Column | None = None) -> DataFrame:
    """``df`` (already written) with a broadcast hint if its counted rows allow it; else as it is, for a shuffled join."""
    return F.broadcast(df) if small_enough(df, most, weight) else df


def spread(*columns: Column) -> Column:
    """A number from 1 by which equal keys are spread over tasks; a task that is run again gives the same ones."""
    return F.pmod(F.xxhash64(*columns, F.spark_partition_id()), F.lit(1 << 20)) + 1


def spread_join(left: DataFrame, right: DataFrame, keys: dict[str, Column], values: dict[str, str], rows: str, total: int, by: Column) -> DataFrame:
    """``left``, with the columns ``values`` (new name -> column of ``right``) of the row of ``right`` that has the same
    keys: ``keys`` maps the key columns of ``right``, in which a row is unique, to expressions on ``left``. Null where
    nothing fits; a null key fits nothing. Columns of ``left`` named like the values are replaced.

    ``right`` knows how many rows of ``left`` each key has (``rows``, of ``total``). The hot keys, fewer than HOT_SHARE by
    that count, are broadcast. Rows that found theirs, or whose key is null, are then dealt by a hash of ``by`` beside the
    key, so that no task of the shuffled join with all other keys gets more than its share.
    """
    m = marker(left)
    mine = [f"{m}k{i}" for i in range(len(keys))]
    frame = left.withColumns(dict(zip(mine, keys.values(), strict=True)))
    hot = F.col(rows) * HOT_SHARE > total

    def table(kind: str, which: Column) -> DataFrame:
        return right.where(which).select(*[F.col(k).alias(f"{m}{kind}k{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"{m}{kind}v{i}") for i, v in enumerate(values.values())], (F.col(rows) < 0).cast("int").alias(f"{m}{kind}s"))

    same = lambda kind: [F.col(k) == F.col(f"{m}{kind}k{i}") for i, k in enumerate(mine)]
    met = frame.join(F.broadcast(table("h", hot)), reduce(Column.__and__, same("h")), "left")
    known = F.col(f"{m}hs").isNotNull()
    absent = reduce(Column.__or__, [F.col(k).isNull() for k in mine])
    met = met.withColumn(f"{m}salt", F.when(known | absent, spread(by)).otherwise(0).cast("int"))
    out = met.join(table("c", ~hot), reduce(Column.__and__, [*same("c"), F.col(f"{m}salt") == F.col(f"{m}cs")]), "left")
    found = [F.when(known, F.col(f"{m}hv{i}")).otherwise(F.col(f"{m}cv{i}")).alias(name) for i, name in enumerate(values)]
    return out.select(*without(left, *values), *found)


def maybe_among(df: DataFrame, code: Column, codes: DataFrame, name: str) -> DataFrame:
    """``df`` with a flag ``name``: whether its 64-bit hash ``code`` may be among those of ``codes`` (its first column). It is
    true for all that are, and few others. The hashes set bits of a map of 2^20 words of 64 bits, which is broadcast: a
    million rows at most, however many hashes there are."""
    m = marker(df)
    word = lambda c: F.shiftrightunsigned(c, 44)
    bit = lambda c: F.pmod(c, F.lit(64)).cast("int")
    given = F.col(codes.columns[0])
    words = written(codes.groupBy(word(given).alias(f"{m}word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(given))).alias(f"{m}bits")))
    coded = df.withColumn(f"{m}code", code)
    met = coded.join(F.broadcast(words), word(F.col(f"{m}code")) == F.col(f"{m}word"), "left")
    flag = F.coalesce(F.getbit(f"{m}bits", bit(F.col(f"{m}code"))) == 1, F.lit(False))
    return met.select(*[named(c) for c in df.columns], flag.alias(name))


def sifted(df: DataFrame, code: Column, codes: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``code`` may be among ``codes``, as ``maybe_among`` tells."""
    flag = fresh(df, "may")
    return maybe_among(df, code, codes, flag).where(F.col(flag)).drop(flag)
