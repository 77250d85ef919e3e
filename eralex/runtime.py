"""Session helpers: table loading and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir``.

    Where it is unset and every task runs in this process, as in tests, a folder beside the warehouse is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-cuts"


_MADE: list[str] = []


def drop_cuts(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` has written in this process, once their last reader is done."""
    n = len(_MADE)
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a compressed columnar table in the shared folder and read it back.

    The files survive the loss of an executor, carry statistics for the join planner
    and take less room than serialized checkpoint blocks. They are deleted by ``drop_cuts``, or when
    the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows, and most bytes on disk, of a table that is sent to all tasks.
SMALL_ROWS, SMALL_BYTES = 200_000, 16 << 20


def if_small(written: DataFrame) -> DataFrame:
    """A table of ``cut``, to be broadcast in joins if its checked size is small; larger ones are joined as the planner sees fit."""
    size = written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(written) if size <= SMALL_BYTES and written.count() <= SMALL_ROWS else written


def builder(app: str = "eralex", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession.Builder:
    """A session for one machine, with the settings that tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
    )
