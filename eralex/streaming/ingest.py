"""Incremental ingest: files that arrive later, each handled once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eralex.operators import ingest, references


def _earlier(spark: SparkSession, path: str, epoch: int, schema) -> DataFrame:
    """Rows of the batches before this one; a state that should be there and is not is an error, never an empty state."""
    if epoch == 0:
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(*[f"{path}/batch={k}" for k in range(epoch)])
    except AnalysisException as e:
        raise RuntimeError(f"state of the batches before {epoch} is missing under {path}") from e


def ingest_stream(spark: SparkSession, source: str, schema, clean: str, rejected: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Validate arriving judgments; first valid row of an id wins over all batches, the rest go to the rejects with reasons.

    A valid row whose id came in an earlier batch is rejected as a duplicate like one of its own
    batch. Both sides have a folder for each batch, so a batch run again after a failure overwrites its own.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        checked = ingest.validated(df, order).persist()
        try:
            ids = _earlier(spark, clean, epoch, schema).select("judgment_id").distinct()
            valid = checked.where(F.size("problems") == 0)
            late = valid.join(ids, "judgment_id", "left_semi").withColumn("problems", F.array(F.lit("duplicate judgment_id")))
            valid.join(ids, "judgment_id", "left_anti").drop("problems").write.mode("overwrite").parquet(f"{clean}/batch={epoch}")
            checked.where(F.size("problems") > 0).unionByName(late).write.mode("overwrite").parquet(f"{rejected}/batch={epoch}")
        finally:
            checked.unpersist()

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "key string, existence long, refs long"


def reference_stream(spark: SparkSession, source: str, schema, state: str, checkpoint: str, columns: list[str], at: str, records: tuple | None = None) -> StreamingQuery:
    """Signed existence and reference counts kept up to date from arriving rows; state of batch n is folder n, so a repeated batch overwrites its own.

    records: (source, schema, key, since, until) of the records that are referred to.
    """
    refs = references.references(spark.readStream.schema(schema).parquet(source).withColumn("__row", F.lit(0)), "__row", columns, at)
    changes = refs.select("key", F.lit(0).cast("long").alias("existence"), F.lit(1).cast("long").alias("refs"))
    if records:
        path, kind, *names = records
        deltas = references.existence_deltas(spark.readStream.schema(kind).parquet(path), *names)
        changes = changes.unionByName(deltas.select("key", F.col("d").alias("existence"), F.lit(0).cast("long").alias("refs")))

    def batch(df: DataFrame, epoch: int) -> None:
        before = spark.createDataFrame([], STATE)
        if epoch:
            try:
                before = spark.read.schema(STATE).parquet(f"{state}/batch={epoch - 1}")
            except AnalysisException as e:
                raise RuntimeError(f"state of batch {epoch - 1} is missing under {state}") from e
        references.merge_state(before, df).write.mode("overwrite").parquet(f"{state}/batch={epoch}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per window and kind; rows later than the watermark are left out of closed windows."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
