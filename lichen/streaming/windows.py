"""Sliding windows over a stream of hourly facts (cell, ts, source_rank, version, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lichen.operators import timeseries


def sliding(facts: DataFrame, hours: int, late: str = "3 hours") -> DataFrame:
    """(cell, first, last, sum, n, avg) of all windows of ``hours`` that begin on the hour. Works on a stream, where rows
    later than ``late`` are left out, and on a table."""
    w = F.window("ts", f"{hours} hours", "1 hour")
    rows = facts.withWatermark("ts", late) if facts.isStreaming else facts
    out = rows.groupBy("cell", w.alias("w")).agg(F.sum("value").alias("sum"), F.count("value").alias("n"))
    return out.select("cell", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "sum", "n", (F.col("sum") / F.col("n")).alias("avg"))


def maintain(facts: DataFrame, store: str, target: str, hours: int, checkpoint: str) -> StreamingQuery:
    """Keeps ``target`` (cell, hour, sum, n, avg) right while corrections come in: each batch is added to the fact store,
    and the windows it touches are recomputed from the best source of each hour. A correction replaces; nothing is
    subtracted. The store is partitioned by day, so a batch reads the days its windows reach and no others; a batch that is
    run again overwrites its own part."""

    def step(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("hour", F.floor(F.unix_timestamp("ts") / 3600).cast("long")).withColumn("day", F.floor(F.col("hour") / 24))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{store}/epoch={epoch}")
        spark = batch.sparkSession
        mine = spark.read.schema(rows.schema).parquet(f"{store}/epoch={epoch}")
        touched = mine.groupBy("cell").agg(F.min("hour").alias("_first"), F.max("hour").alias("_last"))
        first, last = mine.agg(F.min("hour"), F.max("hour")).first()
        if first is None:
            return
        whole = spark.read.parquet(store).where(F.col("day").between((first - hours) // 24, (last + hours) // 24))
        near = whole.join(touched, "cell").where((F.col("hour") > F.col("_first") - hours) & (F.col("hour") < F.col("_last") + hours))
        series = timeseries.latest(near.drop("_first", "_last"), ["cell", "hour"], "value", ["source_rank", "version"])
        changed = timeseries.trailing(series, hours).join(touched, "cell").where("hour >= _first").drop("_first", "_last")
        changed.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return facts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(target: DataFrame) -> DataFrame:
    """The newest state of each cell and hour among the epochs of ``maintain``."""
    rest = [c for c in target.columns if c not in ("cell", "hour", "epoch")]
    return target.groupBy("cell", "hour").agg(F.max_by(F.struct(*rest), "epoch").alias("_s")).select("cell", "hour", "_s.*")
