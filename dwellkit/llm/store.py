"""Tables that a job writes once and reads several times."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellkit.session import shared_dir


#: With this Spark takes away what a write has shuffled once it is done; a task that still needs it runs again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders of the tables written on the way to the one that ``settled`` makes.
_ON_THE_WAY: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Else shuffle files lie there until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the folder that all executors share and read back: cuts the lineage, and
    a lost executor costs a read. An empty table keeps its columns."""
    path = shared_dir(df.sparkSession, purpose)
    if (passing := _ON_THE_WAY.get()) is not None:
        passing.append(path)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], purpose: str) -> DataFrame:
    """What ``make`` returns, stored; the tables that were stored on the way there go. Nothing
    that reads them may leave ``make`` but its result."""
    passing: list[str] = []
    token = _ON_THE_WAY.set(passing)
    try:
        out = stored(make(), purpose)
    finally:
        _ON_THE_WAY.reset(token)
    if passing and (outer := _ON_THE_WAY.get()) is not None:
        outer.append(passing[-1])
    for path in passing[:-1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out


def stored_by(df: DataFrame, key: str, buckets: int, purpose: str) -> DataFrame:
    """``stored`` as a table bucketed by key: to group it by the key moves none of its rows."""
    path = shared_dir(df.sparkSession, purpose)
    name = f"{purpose}_{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    return df.sparkSession.table(name)


def numbered(df: DataFrame, purpose: str, name: str = "row_id") -> DataFrame:
    """``stored`` with a number for each row. The numbers are in the files, so they stay
    as they are when a task runs again; repeated rows get numbers of their own."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), purpose)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
