"""Families of names: files with one signature become one row that is assigned once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators.ranks import with_rank


def with_signature(entries: DataFrame) -> DataFrame:
    return entries.withColumn("signature", text.signature(F.col("name"), F.substring(F.coalesce("excerpt", F.lit("")), 1, 80)))


def family_rows(entries: DataFrame, anonymise: bool = True) -> DataFrame:
    """(fid, signature, name, modified, parent, ext, n): a row for each signature, shown by its first file in order of path.

    Members stay in their own rows and find their family by the signature, so a signature that a third of all files
    share (that of names without nouns, '') is one sum here, never a list. Numbers follow the names, from 1, over
    ranges of the rows.
    """
    parent = F.lit("[folder]") if anonymise else F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    first = F.min(F.struct("path", "name", F.date_format("modified", "yyyy-MM-dd").alias("modified"), parent.alias("parent"), F.lower("ext").alias("ext")))
    rows = with_signature(entries).groupBy("signature").agg(first.alias("f"), F.count("*").alias("n"))
    flat = rows.select("signature", "f.name", "f.path", F.coalesce("f.modified", F.lit("")).alias("modified"), "f.parent", "f.ext", "n")
    return with_rank(flat, ["name", "path"], "fid").select(F.col("fid").cast("int").alias("fid"), "signature", "name", "modified", "parent", "ext", "n")


def payload(rows: DataFrame) -> DataFrame:
    """(fid, json): what a model is told of a row; the extension and a count above one only where there are."""
    fields = F.struct(F.col("fid").alias("i"), F.col("name").alias("n"), F.col("modified").alias("m"), F.col("parent").alias("p"), F.nullif("ext", F.lit("")).alias("x"), F.when(F.col("n") > 1, F.col("n")).alias("c"))
    return rows.select("fid", F.to_json(fields).alias("json"))


def propagated(entries: DataFrame, rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """(path, category_id, score, reason) of every member from (fid, category_id, score, reason) of the rows."""
    by_row = rows.select("fid", "signature").join(assigned, "fid").drop("fid")
    return with_signature(entries).select("path", "signature").join(by_row, "signature").select("path", "category_id", "score", "reason")
