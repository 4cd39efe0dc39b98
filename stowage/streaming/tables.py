"""Streams from and to tables: results that go on where they stopped, the tail
of a log, frames joined by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow(spark: SparkSession, path: str, schema: str, kind: str = "parquet", per_trigger: int = 16) -> DataFrame:
    """Files as they are added to a folder, at most per_trigger of them in a
    micro-batch: a slow reader holds back what is read, not what is written."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def log_tail(spark: SparkSession, path: str, schema: str, per_trigger: int = 16) -> DataFrame:
    """Readable lines of an append log as they come; broken lines are left out."""
    return follow(spark, path, schema, "json", per_trigger).na.drop("all")


def resume(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends to `out` the results of all that has come since the checkpoint,
    each once, and ends. After a crash, or with nothing new, calling it again is
    harmless: the checkpoint and the sink's log agree on what is done."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def replace_each(stream: DataFrame, out: str, checkpoint: str) -> None:
    """The whole result of an aggregating stream after each micro-batch replaces
    the table `out`."""
    write = lambda df, _: df.write.mode("overwrite").parquet(out)
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()


def frame_pairs(left: DataFrame, right: DataFrame, late: str = "1 hour") -> DataFrame:
    """Frames of two streams that stand at the same position of a clip. Both:
    clip, position, ts, and columns of their own; state is dropped when both are
    behind the watermark by more than `late`."""
    a = left.withColumnRenamed("ts", "left_ts").withWatermark("left_ts", late)
    b = right.select(F.col("clip").alias("right_clip"), F.col("position").alias("right_position"), F.col("ts").alias("right_ts"), *[c for c in right.columns if c not in ("clip", "position", "ts")]).withWatermark("right_ts", late)
    near = (F.col("left_ts") >= F.col("right_ts") - F.expr(f"interval {late}")) & (F.col("left_ts") <= F.col("right_ts") + F.expr(f"interval {late}"))
    return a.join(b, (F.col("clip") == F.col("right_clip")) & (F.col("position") == F.col("right_position")) & near).drop("right_clip", "right_position", "right_ts", "left_ts")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Operations of an actor without a longer break: start, stop, how many."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "actor").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "actor", "n")
