"""Catalogue of categories from directories that exist, and which files are new beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text


def top_folders(paths: DataFrame, root: str = "root") -> DataFrame:
    """(root, folder): first directories below each root; from (root, path)."""
    below = F.substring(F.col("path"), F.length(root) + 2, F.length("path"))
    inside = paths.where(F.startswith(F.col("path"), F.concat(F.col(root), F.lit("/"))))
    return inside.select(root, F.regexp_extract(below, "^([^/]+)/", 1).alias("folder")).where("folder != ''").distinct()


def seed_categories(folders: DataFrame, tagged_only: bool = False, root: str = "root") -> DataFrame:
    """(root, id, name, description, time_label, duration, group, tag) of each directory, in the order of names within a root."""
    rows = folders.where(~F.col("folder").startswith(".") & ~F.col("folder").startswith("__"))
    rows = rows.where(text.has_tag(F.col("folder"))) if tagged_only else rows
    parts = text.tag_parts(F.col("folder"))
    plain = F.trim(F.regexp_replace("folder", r"^\s*\d+[\.\-_)\]\s]+", ""))
    period = F.trim(F.regexp_extract(plain, r"[〈(]([^〉)]{1,30})[〉)]\s*$", 1))
    bare = F.trim(F.regexp_replace(plain, r"[〈(][^〉)]{1,30}[〉)]\s*$", ""))
    core = F.when(parts.isNotNull(), F.coalesce(F.nullif(parts["clean_name"], F.lit("")), "folder")).otherwise(bare)
    tag = F.coalesce(parts["signature"], F.lit(""))
    at = F.row_number().over(Window.partitionBy(root).orderBy("folder"))  # directories of one root
    made = rows.select(root, "folder", core.alias("core"), F.when(parts.isNotNull(), parts["period"]).otherwise(period).alias("time_label"), tag.alias("tag"), at.alias("at"))
    word = text.slug(F.col("core"))
    base = F.when(word == "", F.concat(F.lit("existing-"), F.col("at").cast("string"))).otherwise(word)
    return made.select(
        root, F.when(F.col("tag") != "", F.concat(base, F.lit("-"), "tag")).otherwise(base).alias("id"), F.coalesce(F.nullif("core", F.lit("")), "folder").alias("name"),
        F.concat(F.lit("기존 폴더: "), "folder").alias("description"), "time_label", F.lit("mixed").alias("duration"), ((F.col("at") - 1) % 8 + 1).alias("group"), "tag",
    )


def loose_files(paths: DataFrame, root: str = "root") -> DataFrame:
    """Rows of (root, path) that don't lie in a tagged directory: what an additive run looks at."""
    below = F.substring(F.col("path"), F.length(root) + 2, F.length("path"))
    return paths.where(~text.has_tag(F.regexp_extract(below, "^([^/]+)/", 1)))
