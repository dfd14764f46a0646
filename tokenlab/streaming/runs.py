"""Incremental processing. Beyond batch resume, which the tables of `sources.records` cover, this is an extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.records import RUN


def read_runs(spark: SparkSession, path: str, schema: T.StructType = RUN, files: int = 100) -> DataFrame:
    """A stream of run records from the JSONL files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def append_new(stream: DataFrame, keys: list[str], target: str, checkpoint: str, transform=lambda d: d):
    """Append each key once: a batch's rows are deduplicated, those that target has are left out, the rest is scored.

    A batch that is run again after a failure finds its rows in target and adds nothing. Ends when all is read.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            fresh = fresh.join(spark.read.parquet(target).select(*keys), keys, "left_anti")
        except Exception as e:  # the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        transform(fresh).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _watermarked(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    """A stream with its watermark, which needs an instant rather than a time without a zone; else the rows as they are."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if late and events.isStreaming else events


def window_votes(events: DataFrame, window: Column, answer: str = "event_type", late: str | None = "1 hour", ts: str = "ts") -> DataFrame:
    """Votes by window and answer. With a stream, rows later than `late` behind the latest are left out."""
    rows = _watermarked(events, ts, late)
    out = rows.groupBy(window.alias("w"), F.col(answer).alias("answer")).agg(F.count(F.lit(1)).alias("votes"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "answer", "votes", F.round("total", 4).alias("total"))


def tumbling(events: DataFrame, size: str = "1 day", **kw) -> DataFrame:
    return window_votes(events, F.window("ts", size), **kw)


def sliding(events: DataFrame, size: str = "1 day", step: str = "12 hours", **kw) -> DataFrame:
    return window_votes(events, F.window("ts", size, step), **kw)


def sessions(events: DataFrame, gap: str = "1 hour", by: str = "user_id", late: str | None = "1 hour") -> DataFrame:
    """Events of one user without a gap: start, end, number."""
    rows = _watermarked(events, "ts", late)
    out = rows.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def without_repeats(stream: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return _watermarked(stream, ts, late).dropDuplicatesWithinWatermark([key])
