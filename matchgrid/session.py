"""Session helpers: adaptive settings, table loading, shared checkpoint folder."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("matchgrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition that is dealt by keys: some hundred megabytes for a chain of sorts and windows.
PARTITION_ROWS = 150_000


def partitions_of(df: DataFrame) -> int:
    """Partitions that the number of rows asks for. For tables that can be counted cheaply."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / PARTITION_ROWS))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key expressions to as many partitions as their number asks for.

    What follows by the same keys, or by more, runs in these partitions, so a
    task's memory does not depend on the size of the table.
    """
    return df.repartition(partitions_of(df), *[F.expr(k) for k in keys])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where the setting is unset and all tasks run on this machine (tests,
    notebooks) a local folder is made; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return (folder or current).rstrip("/")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="matchgrid-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables, below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/matchgrid/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Writes ``df`` as Parquet to the shared checkpoint folder and rereads it.

    Cuts the lineage at a table all executors can read after any loss. Tables
    named in ``instead_of`` are not read any more and go.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in instead_of:
        drop_folder(spark, old.matchgrid_folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.matchgrid_folder = path
    return out


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by this job, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_work(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application.

    Results are lazy and read some of them, so this is for when all results
    have been written.
    """
    drop_folder(spark, work_folder(spark))
