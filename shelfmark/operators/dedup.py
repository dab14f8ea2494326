"""Exact duplicates: same size and content. Sizes that occur once are settled before any content is hashed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.ranks import ranked_within
from shelfmark.schema import Settings


def content_hash(entries: DataFrame, content: str = "content") -> DataFrame:
    """``entries`` with a hash of the whole content as ``hash``; computed where the row is."""
    return entries.withColumn("hash", F.sha2(F.col(content).cast("binary"), 256))


def duplicate_groups(entries: DataFrame, min_bytes: int | None = None, content: str = "content") -> DataFrame:
    """(path, size, hash, canonical, n_copies, place) of files that have a copy; from (path, size, modified, content).

    The canonical copy has the shortest path, then the earliest time, then the least path; its place is 1. A negative
    ``min_bytes`` turns deduplication off; empty files and those below it have no copies. Rows with a null size or
    content are left out. Only sizes that occur twice are hashed: the first count is combined before its shuffle, and
    the rows that pass go by size *and* hash, so one frequent size is spread over its contents. A content that is a
    third of all rows is ranked by ranges of its rows, in as many tasks as they need.
    """
    least = Settings().dedup_min_bytes if min_bytes is None else min_bytes
    rows = entries.where((F.col("size") > 0) & (F.col("size") >= least) & F.col(content).isNotNull() & F.lit(least >= 0))
    twice = rows.groupBy("size").count().where("count > 1").select("size")
    hashed = content_hash(rows.join(twice, "size", "left_semi"), content).select("path", "size", "modified", "hash")
    copies = hashed.groupBy("size", "hash").agg(F.count("*").alias("n_copies"), F.min(F.struct(F.length("path"), "modified", "path").alias("k")).alias("k")).where("n_copies > 1")
    joined = hashed.join(copies, ["size", "hash"]).withColumn("_l", F.length("path"))
    ranked = ranked_within(joined, ["size", "hash"], ["_l", "modified", "path"], "place")
    return ranked.select("path", "size", "hash", F.col("k.path").alias("canonical"), "n_copies", "place")


def ledger(groups: DataFrame) -> DataFrame:
    """(deleted_path, canonical_path, bytes_freed): the copies a clean-up may delete. Nothing is deleted here."""
    return groups.where("place > 1").select(F.col("path").alias("deleted_path"), F.col("canonical").alias("canonical_path"), F.col("size").alias("bytes_freed"))


def canonical_only(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries without the copies."""
    return entries.join(groups.where("place > 1").select("path"), "path", "left_anti")


def inherited(groups: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assignments of copies, which go where their canonical file goes; copies of files without one are left out."""
    copies = groups.where("place > 1").select("path", "canonical")
    own = assignments.select(F.col("path").alias("canonical"), "category_id")
    name = F.regexp_extract("canonical", "([^/]*)$", 1)
    return copies.join(own, "canonical").select("path", "category_id", F.lit(1.0).alias("score"), F.concat(F.lit("중복 — 정본: "), name).alias("reason"))
