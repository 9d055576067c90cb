"""The same resampling and revision rules over streams, with watermarks for late readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resample_stream(readings: DataFrame, keys: list[str], ts: str, value: str, late: str = "2 hours", period: str = "30 minutes", out: str = "demand_mw") -> DataFrame:
    """Means over periods closed on the right; a period is final once the watermark has passed its end."""
    stamped = readings.withColumn("__t", (F.col(ts).cast("timestamp") - F.expr("INTERVAL 1 SECOND")))
    windowed = stamped.withWatermark("__t", late).groupBy(*keys, F.window("__t", period))
    return windowed.agg(F.avg(value).alias(out)).select(*keys, F.col("window.start").cast("timestamp_ntz").alias("ts"), out)


def first_revisions(records: DataFrame, keys: list[str], ts: str, late: str = "2 hours") -> DataFrame:
    """One record for each key within the watermark."""
    return records.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark(keys).drop("__t")


def keep_latest(records: DataFrame, keys: list[str], changed: str, path: str, checkpoint: str, kept: int = 2, tie: str | None = None) -> StreamingQuery:
    """A table of the latest revisions, merged batch by batch; each batch writes a new version beside the last one.

    Of equal times the record with the greatest ``tie`` (all other columns in order, if none is named) stays, as in batch. The newest ``kept``
    versions (two or more, so that a batch that is run again finds the one before it) stay; older ones are removed once a newer one is whole.
    """
    if kept < 2:
        raise ValueError("a batch that is run again needs the version before it")
    spark = records.sparkSession
    rest = [c for c in records.columns if c not in keys]

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = batch
        if epoch:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v{epoch - 1}"))
        order = F.struct(changed, *([tie] if tie else rest))
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
        best.select(*keys, "r.*").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{epoch}")
        if epoch >= kept:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{epoch - kept}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
