"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset and Spark runs in this
    process alone (tests), a folder under /tmp; on a cluster that is an error, as executors don't see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"/tmp/loomspan-shared/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """The path of a folder in the shared folder that nobody else has. It goes like the tables that ``written`` makes."""
    path = f"{shared_dir(spark)}/loomspan-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later steps start from the files, not from
    the lineage, so a lost executor costs only its own tasks. The folder goes when the program ends, or at the end of the
    ``scratch`` block in which it was made."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Inside the block, tables that ``written`` makes are for this step only and go at its end; the function that it gives
    writes a table that stays until the program ends. Results that are not yet written when the block ends are lost."""
    began, kept = len(_written), []

    def keep(df: DataFrame) -> DataFrame:
        out = written(df)
        kept.append(_written[-1])
        return out

    try:
        yield keep
    finally:
        gone = [x for x in _written[began:] if x not in kept]
        _written[began:] = kept
        _delete(gone)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    try:
        _delete(_written)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        return
