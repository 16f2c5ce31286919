"""Recordings, event sets and fitted tables on storage."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellkit.operators.prefix import index_rows, join_small
from dwellkit.session import shared_dir

NAMED = T.StructType(
    [
        T.StructField("Time", T.DoubleType()),
        T.StructField("Current", T.DoubleType()),
        T.StructField("State", T.DoubleType()),
    ]
)
NAMED_SPECIES = T.StructType([*NAMED.fields, T.StructField("Species", T.IntegerType())])
POSITIONAL = T.StructType(
    [
        T.StructField("time", T.DoubleType()),
        T.StructField("current", T.DoubleType()),
        T.StructField("state", T.DoubleType()),
    ]
)


def _state(column: str) -> Column:
    """State as INT, cut toward zero; a NaN state counts as missing."""
    return F.when(~F.isnan(column), F.col(column)).cast("int")


def _indexed(df: DataFrame) -> DataFrame:
    return index_rows(df, "record_id", ["time"], F.col("time"))


def _record(df: DataFrame, paths, root: str | None) -> Column:
    """The file as record id: its path below the read root, whatever else is read with it.

    The root is ``root`` or, without it, the one folder that is read. For single files, lists and
    patterns without a root it is the file's name; two files of one name are an error then.
    """
    # Spark gives paths as URLs; ids are plain text.
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(whole, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    name = F.element_at(F.split(path, "/"), -1)
    folder = root or (paths if isinstance(paths, str) and not set("*?[{") & set(paths) else None)
    if folder is None:
        names = [f.rsplit("/", 1)[-1] for f in df.inputFiles()]
        twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        if twice:
            raise ValueError(f"several files are called {twice[0]}: give the folder above them as root")
        return name
    folder = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder).rstrip("/")
    # A relative root starts where its name first stands in the path.
    start = F.lit(1) if folder.startswith("/") or not folder else F.instr(path, f"/{folder}/") + 1
    below = F.substring(path, start + F.lit(len(folder) + 1), F.length(path))
    inside = F.substring(path, start, F.lit(len(folder) + 1)) == F.lit(f"{folder}/")
    strange = F.raise_error(F.concat(path, F.lit(f" does not lie below {folder}"))).cast("string") if root else name
    return F.when(inside, below).otherwise(strange)


def _named(raw: DataFrame, record: Column, species: bool) -> DataFrame:
    rows = raw.select(
        record.alias("record_id"),
        F.col("Time").alias("time"),
        F.col("Current").alias("current"),
        _state("State").alias("state"),
        *([F.col("Species").alias("species")] if species else []),
    )
    return _indexed(rows)


def read_recordings(spark: SparkSession, paths, species: bool = False, root: str | None = None) -> DataFrame:
    """CSV recordings with a Time, Current, State (and Species) header. One recording
    per file, by its path below the folder that is read (or ``root``); samples in time order."""
    raw = (
        spark.read.schema(NAMED_SPECIES if species else NAMED)
        .option("header", True)
        .option("enforceSchema", False)
        .csv(paths)
    )
    return _named(raw, _record(raw, paths, root), species)


def read_written(spark: SparkSession, path: str, kind: str = "string", species: bool = False) -> DataFrame:
    """What ``write_recordings`` wrote: a recording per folder, however many files are in it.

    ``kind`` is the type of the record ids. An empty id comes back as NULL, as a missing one does.
    Numbering samples reads them more than once; to open a file is what a small recording
    costs, so the files are parsed once, into a table in the shared folder.
    """
    fields = (NAMED_SPECIES if species else NAMED).fields
    schema = T.StructType([*fields, T.StructField("record_id", T.StringType())])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    parsed = shared_dir(spark, "parsed")
    raw.write.parquet(parsed)
    return _named(spark.read.schema(schema).parquet(parsed), F.col("record_id").cast(kind), species)


def read_positional(spark: SparkSession, paths, root: str | None = None) -> DataFrame:
    """CSV recordings whose first three columns are time, current and state, whatever
    the header calls them. Record ids are those of ``read_recordings``."""
    raw = spark.read.schema(POSITIONAL).option("header", True).option("enforceSchema", True).csv(paths)
    record = _record(raw, paths, root).alias("record_id")
    rows = raw.select(record, "time", "current", _state("state").alias("state"))
    return _indexed(rows)


def with_classes(
    df: DataFrame, labels: Mapping[str, int], record_class: Mapping[str, str], unclassed: str = "error"
) -> DataFrame:
    """Label and name per recording, from record id -> class name -> label. A class
    without a label is an error; so is a recording without a class, unless
    ``unclassed`` is 'drop'."""
    if unclassed not in ("error", "drop"):
        raise ValueError("unclassed must be 'error' or 'drop'")
    missing = sorted(set(record_class.values()) - set(labels))
    if missing:
        raise KeyError(f"no label for {missing}")
    rows = [(f, name, labels[name]) for f, name in record_class.items()]
    spark = df.sparkSession
    table = spark.createDataFrame(rows, "record_id string, name string, label int")
    joined = join_small(df, table, "record_id", len(rows), "inner" if unclassed == "drop" else "left")
    if unclassed == "drop":
        return joined
    refused = F.raise_error(F.concat(F.lit("no class for recording "), "record_id")).cast("int")
    return joined.withColumn("label", F.when(F.col("name").isNotNull(), F.col("label")).otherwise(refused))


def write_recordings(signal: DataFrame, path: str) -> None:
    """CSV with header, one folder per recording, samples of a file in order.

    The time goes into opening files, so tasks are not merged by their few bytes.
    """
    tasks = int(signal.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    extra = [F.col("species").alias("Species")] if "species" in signal.columns else []
    (
        signal.repartitionByRange(tasks, "record_id", "sample_idx")
        .sortWithinPartitions("record_id", "sample_idx")
        .select(
            "record_id",
            F.col("time").alias("Time"),
            F.col("current").alias("Current"),
            F.col("state").alias("State"),
            *extra,
        )
        .write.mode("overwrite")
        .partitionBy("record_id")
        .option("header", True)
        .csv(path)
    )


def write_signal(signal: DataFrame, path: str, samples_per_file: int = 50_000_000) -> None:
    """Parquet in (record_id, sample_idx) order: range-partitioned, so a long recording
    spreads over many files and time or sample filters prune row groups."""
    (
        signal.repartitionByRange("record_id", "sample_idx")
        .sortWithinPartitions("record_id", "sample_idx")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", samples_per_file)
        .parquet(path)
    )


def write_signal_bucketed(signal: DataFrame, table: str, buckets: int) -> None:
    """A table bucketed and sorted for segmentation: reading it needs no exchange."""
    (
        signal.write.mode("overwrite")
        .bucketBy(buckets, "record_id", "chunk")
        .sortBy("record_id", "chunk", "sample_idx")
        .saveAsTable(table)
    )


def write_events(events: DataFrame, path: str, by: str | None = "label") -> None:
    """Event set as parquet, in one folder per class where there is a class."""
    writer = events.write.mode("overwrite")
    if by and by in events.columns:
        writer = writer.partitionBy(by)
    writer.parquet(path)


def read_events(spark: SparkSession, path: str, by: str | None = "label", kind: str | None = None) -> DataFrame:
    """What ``write_events`` wrote. With ``kind`` the class column has that type, else Spark
    guesses it from the folders' names ('007' becomes 7)."""
    found = spark.read.parquet(path)
    if kind is None or by not in found.columns:
        return found
    fields = [T.StructField(f.name, T.StringType() if f.name == by else f.dataType) for f in found.schema]
    return spark.read.schema(T.StructType(fields)).parquet(path).withColumn(by, F.col(by).cast(kind))
