"""Continuous runs: files that arrive are classified as in an additive run, without looking at what lies there already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import planner, seeds


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1_000) -> DataFrame:
    """Rows of parquet files that appear below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def first_seen(stream: DataFrame, keys: list[str], at: str = "modified", late: str = "1 day") -> DataFrame:
    """One row for each key within ``late`` of each other; state older than that is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def classified(stream: DataFrame) -> DataFrame:
    """Arriving files (root, path, name, ext, excerpt, ...) outside of tagged directories, by the rules: no state, no shuffle."""
    return planner.by_rules(seeds.loose_files(stream))


def windowed_counts(stream: DataFrame, key: str, at: str = "modified", width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, end, key, n) of tumbling or sliding windows; rows later than ``late`` are left out, as their windows are closed."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def run_to_table(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Writes a stream to parquet exactly once; with ``available_now`` it ends when all that is there has been read."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
