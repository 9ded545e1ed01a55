"""Intermediate tables in the folder that all executors share, and column names that clash with nothing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The folder of our own, where the session names none.
_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A folder of our own, removed at exit, only where that is unset and the master
    is local, as in tests; elsewhere executors could not read it, so it is refused."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _own is None:
            path = tempfile.mkdtemp(prefix="ragspark-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            _own = f"file://{path}"
        found = _own
    return found.rstrip("/")


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """An unused path; all of one application lie in one folder, so what a lost driver leaves is easily told apart."""
    return f"{shared_dir(spark)}/ragspark/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


#: Spark's own setting (4.1) by which a query's shuffle files go when the query ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """The same rows, read back from a Parquet table: lost executors cost a reread, not the whole lineage.

    Unlike ``checkpoint()`` this runs the plan once and the files are compressed and column-pruned. The shuffle files of
    the write are of no more use when it is done, and are freed with it.
    """
    spark = df.sparkSession
    path, before = new_path(spark), spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables from which nothing unwritten is derived any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._materialized_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``df``, written, with the place of each row in the order as a long column ``name``, from 0 without gaps; rows that are equal in the order take any of their places.

    Rows are dealt to ranges and sorted there; a range begins after the rows of the ranges before it, whose counts are all that the driver sees.
    """
    spark = df.sparkSession
    raw = free_name(df, "_at")
    dealt = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    rows = materialize(dealt.withColumn(raw, F.monotonically_increasing_id()))
    # The id has the number of the range in its upper bits.
    part = F.shiftright(F.col(raw), 33)
    counts = {r[0]: r[1] for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, begun = [], 0
    for p in sorted(counts):
        starts.append((p, begun))
        begun += counts[p]
    of = spark.createDataFrame(starts, "_range long, _start long")
    joined = rows.join(F.broadcast(of), part == F.col("_range"))
    return joined.select(*columns_of(df), (F.col("_start") + F.col(raw).bitwiseAND((1 << 33) - 1)).alias(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]
