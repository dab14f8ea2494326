"""Where files go: directory names, reuse of directories, free names, shortcuts. All results are plans; nothing is moved."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import schema as s
from shelfmark.functions import dates, text
from shelfmark.operators.ranks import ranked_within
from shelfmark.schema import Settings
from shelfmark.session import cut, join_checked


@F.pandas_udf(T.StringType())
def folder_tag(ids: pd.Series) -> pd.Series:
    """The tag of a category id, with brackets: six digits of a 32-bit BLAKE2b, which Spark has no function for."""
    return ids.map(lambda i: f"{s.TAG_PREFIX}{hashlib.blake2b((i or '').encode(), digest_size=4).hexdigest()[:6]}]")


def folders(categories: DataFrame, tag: Column | None = None) -> DataFrame:
    """(category_id, folder) for each category, in order of group, period and name."""
    shown = F.when(F.coalesce("id", F.lit("")) != "", F.col("id")).otherwise(F.col("name"))
    label = folder_tag(shown) if tag is None else tag
    rows = categories.withColumn("_tag", label).withColumn("name", text.composed(F.col("name")))
    name = text.folder_base(F.col("id"), F.col("name"), F.col("time_label"), F.col("duration"), F.col("group"), F.col("_tag"))
    order = Window.orderBy(F.when(F.col("group").between(1, 9), F.col("group")).otherwise(9), F.coalesce(F.nullif("time_label", F.lit("")), F.lit("~")), F.coalesce("name", "id"), "id")
    return rows.select(F.col("id").alias("category_id"), name.alias("folder"), F.row_number().over(order).alias("place"))


def _greedy(pairs: pd.DataFrame) -> pd.DataFrame:
    """Of one root's scored pairs those taken: categories in their order, each directory once."""
    keep, done, used = [], set(), set()
    rows = pairs.sort_values(["place", "score", "dir"], ascending=[True, False, True])
    for c, d in zip(rows["category_id"], rows["dir"], strict=True):
        good = c not in done and d not in used
        keep.append(good)
        if good:
            done.add(c)
            used.add(d)
    return rows[keep][["root", "category_id", "dir"]]


def reused_by_root(wanted: DataFrame, existing: DataFrame, least: float = Settings().fuzzy_least) -> DataFrame:
    """(root, category_id, dir): in each root the existing directory that is like a category's folder; from (root, folder).

    Each distinct directory name is scored once, by a join on tokens. The greedy choice is sequential within a root, so
    a task holds the pairs of at least ``least`` of one root's listing; none come to the driver.
    """
    # a positive score needs a common token, or equal cores, which may have no token
    keys = lambda core: F.explode(F.array_union(text.core_tokens(core), F.array(core)))
    a = wanted.withColumn("ca", text.match_core(F.col("folder"))).withColumn("t", keys(F.col("ca")))
    b = existing.select(F.col("folder").alias("dir")).distinct().withColumn("cb", text.match_core(F.col("dir"))).withColumn("t", keys(F.col("cb")))
    pairs = a.join(b, "t").select("category_id", "place", "ca", "dir", "cb").distinct()
    scored = pairs.withColumn("score", text.fuzzy_score(F.col("cb"), F.col("ca"))).where(F.col("score") >= least)
    listed = existing.select("root", F.col("folder").alias("dir")).distinct()
    near = listed.join(scored.select("category_id", "place", "dir", "score"), "dir")
    return near.groupBy("root").applyInPandas(_greedy, "root string, category_id string, dir string")


def reused(wanted: DataFrame, existing: list[str], least: float = Settings().fuzzy_least) -> dict[str, str]:
    """category_id -> existing directory for the listing of a single root."""
    dirs = wanted.sparkSession.createDataFrame([("", d) for d in existing], "root string, folder string")
    return {r["category_id"]: r["dir"] for r in reused_by_root(wanted, dirs, least).collect()}


def numbered(rows: DataFrame, directory: str = "folder", name: str = "name", order: str = "path") -> DataFrame:
    """``rows`` with a free name as ``new_name``: the first of a name keeps it, others get ' (2)', ' (3)' before the extension.

    A number that some file of the directory already has as its own name is skipped. Places and taken numbers are ranked
    together by ranges of the rows, so neither a name that a third of all files share nor a long row of numbers is one task.
    """
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    base = cut(ranked_within(rows, [directory, name], [order], "_k").withColumns({"_s": stem, "_e": ext}))
    part = lambda i: F.regexp_extract(name, r"^(.*) \((\d+)\)(\.[^.]*)?$", i)
    group = [directory, "_s", "_e"]
    own = rows.select(directory, part(1).alias("_s"), part(3).alias("_e"), part(2).try_cast("int").alias("_n")).where("_n >= 2").distinct()
    taken = own.join(base.where("_k = 2").select(*group), group, "left_semi")  # only names that two files have need a number
    taken = cut(ranked_within(taken, group, ["_n"], "_i"))
    # a number n that is the i-th taken one moves all from n - i + 1 on: in the order of those and of the places k, a place's own place is its free number
    asked = base.where("_k > 1").join(taken.select(*group).distinct(), group, "left_semi").select(*group, F.col("_k").alias("_at"), F.lit(1).alias("_who"))
    moved = taken.select(*group, (F.col("_n") - F.col("_i") + 1).alias("_at"), F.lit(0).alias("_who"))
    placed = ranked_within(asked.unionByName(moved), group, ["_at", "_who"], "_free").where("_who = 1").select(*group, F.col("_at").alias("_k"), (F.col("_free") + 1).alias("_free"))
    joined = base.join(placed, [*group, "_k"], "left")
    new = F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat("_s", F.lit(" ("), F.coalesce("_free", "_k").cast("string"), F.lit(")"), "_e"))
    return joined.withColumn("new_name", new).select(*rows.columns, "new_name")


def placements(assigned: DataFrame, folder_of: DataFrame, root: Column) -> DataFrame:
    """(path, category_id, folder, new_name, new_path, score, reason) of each assigned file; categories without a folder go to the catch-all's."""
    dirs = folder_of.select("category_id", "folder")
    rows = join_checked(assigned.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1)), dirs, "category_id")
    named = numbered(rows.select("path", "category_id", "name", "folder", "score", "reason"))
    return named.select("path", "category_id", "folder", "new_name", F.concat(root, F.lit("/"), "folder", F.lit("/"), "new_name").alias("new_path"), "score", "reason")


def shortcuts(placed: DataFrame, assigned: DataFrame, folder_of: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(path, category_id, shortcut): one for each secondary category whose score is near enough to the first."""
    second = assigned.select("path", F.col("score").alias("_p"), F.explode("secondary").alias("_s")).where(F.col("_p") - F.col("_s.score") <= settings.ambiguity)
    rows = second.join(placed.select("path", F.col("category_id").alias("_c"), "new_name"), "path").where("_s.category_id != _c")
    out = join_checked(rows.select("path", "new_name", F.col("_s.category_id").alias("category_id")), folder_of.select("category_id", "folder"), "category_id")
    return out.select("path", "category_id", F.concat("folder", F.lit("/"), "new_name").alias("shortcut"))


def shortcut_categories(cuts: DataFrame, folder_of: DataFrame) -> DataFrame:
    """(shortcut_path, category_id): the category in whose folder a shortcut lies; categories with one are in use."""
    parents = cuts.where(F.col("shortcut_path").isNotNull()).select("shortcut_path", F.regexp_replace("shortcut_path", "/[^/]*$", "").alias("folder"))
    return join_checked(parents, folder_of.select("folder", "category_id"), "folder").select("shortcut_path", "category_id")


def adopted(listing: DataFrame, placed: DataFrame, folder_of: DataFrame) -> DataFrame:
    """Files that already lie in a category's folder and weren't placed: (path, category_id, score, reason)."""
    rows = join_checked(listing, folder_of.select("category_id", "folder"), "folder")
    left = rows.join(placed.select(F.col("new_path").alias("path")), "path", "left_anti")
    return left.select("path", "category_id", F.lit(1.0).alias("score"), F.lit(s.ADOPTED_REASON).alias("reason"))


def stamps(placed: DataFrame, categories: DataFrame) -> DataFrame:
    """(category_id, stamp): median time of a folder's files in epoch seconds, else the middle of its period."""
    timed = ranked_within(placed.where(F.col("mtime").isNotNull()).select("category_id", "mtime"), ["category_id"], ["mtime"], "_at")
    size = timed.groupBy("category_id").agg(F.max("_at").alias("_n"))
    middle = join_checked(timed, size, "category_id").where("_at IN (floor((_n + 1) / 2), ceil((_n + 1) / 2))")
    median = middle.groupBy("category_id").agg(F.avg("mtime").alias("m"))
    point = F.unix_timestamp(dates.label_point(F.col("time_label")).cast("timestamp")).cast("double")
    rows = categories.select(F.col("id").alias("category_id"), point.alias("p")).join(median, "category_id", "left")
    return rows.select("category_id", F.coalesce("m", "p").alias("stamp"))


def renumbered(names: DataFrame) -> DataFrame:
    """(dir, new_dir) for directories without a group: they become the ninth's, with a free name."""
    base = names.where(~text.has_group(F.col("dir")) & ~F.col("dir").startswith(".")).withColumn("name", F.concat(F.lit("9. "), "dir"))
    out = numbered(base.withColumn("folder", F.lit("")), order="dir")
    return out.select("dir", F.col("new_name").alias("new_dir"))


def sweep_order(paths: DataFrame) -> DataFrame:
    """Directories with their depth, the deepest first: the order in which empty ones go."""
    return paths.select("path", F.size(F.split("path", "/")).alias("depth")).orderBy(F.desc("depth"), "path")


def surviving(categories: DataFrame, placed: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Categories with at least one file or shortcut."""
    used = placed.select("category_id")
    used = used if cuts is None else used.unionByName(cuts.select("category_id"))
    return categories.join(used.select(F.col("category_id").alias("id")), "id", "left_semi")


def recovered(assigned: DataFrame, listing: DataFrame) -> DataFrame:
    """(assigned_path, path): for assigned files that are gone, the first listed file of the same name."""
    name = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    gone = assigned.select("path").join(listing.select("path"), "path", "left_anti").select(F.col("path").alias("assigned_path"), name("path").alias("_n"))
    return gone.join(listing.select("path", name("path").alias("_n")), "_n").groupBy("assigned_path").agg(F.min("path").alias("path"))


def garbled_directories(names: DataFrame) -> DataFrame:
    """(dir, action): garbled directories are removed if empty, else merged into the catch-all's; from (dir, n_files)."""
    return names.where(text.looks_mojibake(F.col("dir"), True)).select("dir", F.when(F.col("n_files") == 0, "remove").otherwise(f"merge into 9. {s.CATCH_ALL_NAME}").alias("action"))
