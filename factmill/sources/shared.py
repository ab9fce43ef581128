"""The folder that driver and executors share, and intermediate tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="factmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's API."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def scratch_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when the driver ends."""
    folder = f"{shared_folder(spark)}/factmill-{spark.sparkContext.applicationId}"
    fs, there = hadoop_path(spark, folder)
    if fs.mkdirs(there):
        fs.deleteOnExit(there)
    return folder


def dealt(df: DataFrame) -> DataFrame:
    """df, marked for a join that shuffles both sides: it grows with the input, while Spark guesses sizes from compressed files and would send it whole through the driver."""
    return df.hint("merge")


#: Rows of a stored table that one task sorts at most, about, where its rows are dealt by a key.
ROWS_A_TASK = 300_000


def spread(df: DataFrame, *keys: str, stored: DataFrame | None = None) -> DataFrame:
    """df, dealt by keys over so many partitions that a task's share doesn't grow with the input: joins and windows by these keys keep to them. Small inputs are left to the
    session's number of partitions. Rows are counted in the footers of the stored table that df has its rows from, by default itself."""
    n = -(-(df if stored is None else stored).count() // ROWS_A_TASK)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the scratch folder and read it back: lineage is cut, and a lost executor costs only a re-read."""
    path = f"{scratch_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
