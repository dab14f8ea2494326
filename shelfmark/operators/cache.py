"""Cache of parsed excerpts: one row for each path, valid while time and size stay as they were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Times further apart than this are different ones.
SAME_TIME = 1e-3


def newest(cache: DataFrame) -> DataFrame:
    """The latest row of each path: by updated_at, then cache_id; a null time is the oldest."""
    fields = [c for c in cache.columns if c != "path"]
    top = F.max(F.struct("updated_at", "cache_id", F.struct(*fields).alias("r")))
    return cache.groupBy("path").agg(top.alias("t")).select("path", *[F.col(f"t.r.{c}").alias(c) for c in fields])


def is_valid(mtime: Column, size: Column, cached_mtime: Column, cached_size: Column) -> Column:
    return F.coalesce((F.abs(mtime - cached_mtime) < SAME_TIME) & (size == cached_size), F.lit(False))


def lookup(scan: DataFrame, cache: DataFrame) -> DataFrame:
    """``scan`` (path, mtime, size) with ``excerpt`` of the cache and whether it is a ``hit``."""
    old = newest(cache).select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.coalesce("excerpt", F.lit("")).alias("_e"))
    hit = is_valid(F.col("mtime"), F.col("size"), F.col("_m"), F.col("_s"))
    return scan.join(old, "path", "left").withColumns({"hit": hit, "excerpt": F.when(hit, F.col("_e"))}).drop("_m", "_s", "_e")


def upserted(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """(path, mtime, size, excerpt): fresh rows replace those of their path."""
    old = newest(cache).select("path", "mtime", "size", "excerpt").join(fresh.select("path"), "path", "left_anti")
    return old.unionByName(fresh.select("path", "mtime", "size", "excerpt"))


def evicted(cache: DataFrame, scan: DataFrame, root: str | None = None) -> DataFrame:
    """Rows whose path is gone; with ``root`` only below it."""
    below = cache if root is None else cache.where(F.col("path").startswith(root.rstrip("/") + "/"))
    return below.join(scan.select("path").distinct(), "path", "left_anti")
