"""Assigning files to categories by rules, and putting others' assignments in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import schema as s
from shelfmark.functions import dates, similarity
from shelfmark.schema import Settings
from shelfmark.session import cut, is_small, join_checked


def by_rules(entries: DataFrame) -> DataFrame:
    """``entries`` with category_id, score and reason, in place of its own: by the first keyword in name or excerpt, else by extension, else the catch-all."""
    entries = entries.drop("category_id", "score", "reason")
    words = F.concat(F.coalesce("name", F.lit("")), F.lit("\n"), F.coalesce("excerpt", F.lit("")))
    keyword = F.coalesce(*[F.when(words.rlike(f"(?iu)(?:{p})"), cid) for cid, _, p in s.KEYWORDS])
    kinds = F.create_map(*[F.lit(x) for cid, (_, exts) in s.EXTENSIONS.items() for e in exts.split() for x in ("." + e, cid)])
    kind = F.try_element_at(kinds, F.lower("ext"))
    found = F.when(keyword.isNotNull(), F.struct(keyword.alias("c"), F.lit(0.8).alias("s"), F.lit(s.BY_KEYWORD).alias("d")))
    found = found.when(kind.isNotNull(), F.struct(kind.alias("c"), F.lit(0.6).alias("s"), F.lit(s.BY_EXTENSION).alias("d")))
    found = found.otherwise(F.struct(F.lit(s.CATCH_ALL).alias("c"), F.lit(0.4).alias("s"), F.lit(s.BY_NOTHING).alias("d")))
    shown = F.when(F.coalesce("ext", F.lit("")) == "", "noext").otherwise(F.lower("ext"))
    return entries.withColumn("_f", found).select(
        *entries.columns, F.col("_f.c").alias("category_id"), F.col("_f.s").alias("score"), F.concat("_f.d", F.lit(" ("), shown, F.lit(")")).alias("reason")
    )


def _names() -> dict[str, str]:
    return {cid: name for cid, name, _ in s.KEYWORDS} | {cid: name for cid, (name, _) in s.EXTENSIONS.items()} | {s.CATCH_ALL: s.CATCH_ALL_NAME}


def rule_plan(entries: DataFrame, least: int = 2, most: int = s.MOST_CATEGORIES) -> DataFrame:
    """``by_rules``, with categories of fewer than ``least`` files merged into the catch-all, and all but the ``most``
    largest: ties by the first path. At least two categories stay, if so many are large enough; else all do.

    Counts are over at most a few dozen categories, so their table is broadcast; the files are read once more instead
    of shuffled.
    """
    rows = by_rules(entries)
    own = [c for c in rows.columns if c not in ("category_id", "score", "reason")]
    counts = rows.groupBy("category_id").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    large = F.sum(F.when(F.col("n") >= least, 1).otherwise(0)).over(Window.partitionBy())
    kept = counts.withColumn("keep", (large < 2) | (F.col("n") >= least))
    merged = kept.groupBy(F.when(F.col("keep"), F.col("category_id")).otherwise(s.CATCH_ALL).alias("to")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    ranked = merged.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first")))
    fate = kept.withColumn("to", F.when(F.col("keep"), F.col("category_id")).otherwise(s.CATCH_ALL)).join(ranked.select("to", "rank"), "to")
    fate = fate.select("category_id", "keep", F.when(F.col("rank") <= most, F.col("to")).otherwise(s.CATCH_ALL).alias("final"))
    out = rows.join(F.broadcast(fate), "category_id")  # a row for each category of the rules
    reason = F.when(F.col("keep"), F.col("reason")).otherwise(F.concat("reason", F.lit(s.MERGED_SUFFIX)))
    return out.select(*own, F.col("final").alias("category_id"), "score", reason.alias("reason"))


def histogram(assigned: DataFrame) -> DataFrame:
    """(category_id, category_name, n), of categories named by the rules."""
    names = F.create_map(*[F.lit(x) for pair in _names().items() for x in pair])
    return assigned.groupBy("category_id").agg(F.count("*").alias("n")).select("category_id", F.coalesce(F.try_element_at(names, F.col("category_id")), F.col("category_id")).alias("category_name"), "n")


# --- assignments that come from elsewhere ---------------------------------------------------------------------------


def cleaned_categories(categories: DataFrame) -> DataFrame:
    """(id, name, description, time_label, duration, group): one row for each id, the longest name first.

    Groups outside 1 to 9 become 9, unknown durations ''. Names with lost characters, or garbled ones, are rejected.
    Whatever names a catch-all becomes the one catch-all, which is always there.
    """
    from shelfmark.functions import text

    duration = F.lower(F.trim(F.coalesce("duration", F.lit(""))))
    duration = F.when(duration == "multiyear", "multi-year").when(duration.isin(*s.DURATIONS), duration).otherwise("")
    name = F.trim(F.coalesce("name", F.lit("")))
    sound = ~name.rlike("[�﻿]") & ~text.looks_mojibake(name, True) & (name != "")
    other = (F.col("id") == s.CATCH_ALL) | name.rlike("기타|그 외|분류되지 않은|프로젝트 외")
    rows = categories.where(F.col("id").isNotNull() & sound & ~other).select(
        "id", name.alias("name"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("time_label", F.lit("")).alias("time_label"),
        duration.alias("duration"), F.when(F.col("group").between(1, 9), F.col("group")).otherwise(9).cast("int").alias("group"),
    )
    one = rows.groupBy("id").agg(F.max(F.struct(F.length("name"), "name", "description", "time_label", "duration", "group")).alias("r")).select("id", *[f"r.{c}" for c in ("name", "description", "time_label", "duration", "group")])
    spark = categories.sparkSession
    return one.unionByName(spark.createDataFrame([(s.CATCH_ALL, s.CATCH_ALL_NAME, "", "", "", 9)], "id string, name string, description string, time_label string, duration string, `group` int"))


def coerced(assigned: DataFrame, categories: DataFrame) -> DataFrame:
    """Assignments (path, category_id, score, secondary, reason) with unknown categories as the catch-all, and secondary
    ones dropped where unknown or the same as the first; reasons are cut at 140 characters; the first row of a path counts."""
    known = categories.select(F.col("id").alias("category_id"), F.lit(True).alias("_k")).distinct()
    one = assigned.groupBy("path").agg(F.min_by(F.struct("category_id", "score", "secondary", "reason"), "pos").alias("a")).select("path", "a.*")
    first = join_checked(one, known, "category_id", "left").withColumn("category_id", F.when(F.col("_k"), F.col("category_id")).otherwise(s.CATCH_ALL))
    each = first.select("path", F.col("category_id").alias("_c"), F.posexplode("secondary").alias("_at", "_s")).withColumn("category_id", F.col("_s.category_id")).where("category_id != _c")
    kept = join_checked(each, known, "category_id").groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_s"))), lambda x: x["_s"]).alias("_kept"))  # a file's own few
    none = F.array().cast(dict(assigned.dtypes)["secondary"])
    return first.join(kept, "path", "left").select("path", "category_id", "score", F.coalesce("_kept", none).alias("secondary"), F.substring(F.coalesce("reason", F.lit("")), 1, 140).alias("reason"))


def normalised(assigned: DataFrame, entries: DataFrame, categories: DataFrame, settings: Settings = Settings(), reclassify: bool = True) -> tuple[DataFrame, DataFrame]:
    """A plan put in order: (path, category_id, score, secondary, reason) of every entry, and the categories.

    Categories are cleaned; paths that are masked or cut are found by their ends; the first assignment of an entry (by
    ``pos``) counts, with known categories only; entries without one, and those in the catch-all, go by their period.
    Assignments of what is no entry are left out. ``assigned`` has path, pos, category_id, score, secondary and reason.
    """
    cats = cut(cleaned_categories(categories))
    columns = ["path", "pos", "category_id", "score", "secondary", "reason"]
    rows = assigned.select(columns)
    found = suffix_matched(rows, entries).select(F.col("assigned_path").alias("path"), F.col("path").alias("_to"))
    loose = rows.join(found, "path").withColumn("path", F.col("_to")).select(columns)
    sound = cut(coerced(rows.join(entries.select("path"), "path", "left_semi").unionByName(loose), cats))
    whole = covered(sound, entries, cats, settings, reclassify)
    none = F.array().cast(dict(assigned.dtypes)["secondary"])
    second = sound.select("path", "secondary", F.col("category_id").alias("_c"))
    kept = F.when(F.col("_c") == F.col("category_id"), F.col("secondary"))  # of a file that was moved by its period nothing else holds
    return whole.join(second, "path", "left").select("path", "category_id", "score", F.coalesce(kept, none).alias("secondary"), "reason"), cats


def closest(assigned: DataFrame, categories: DataFrame, order: str = "id") -> DataFrame:
    """Assignments whose unknown categories become the catalogue's first, in ``order``; the catch-all where it is empty."""
    first = categories.agg(F.min_by("id", order).alias("_first"))
    known = categories.select(F.col("id").alias("category_id"), F.lit(True).alias("_k")).distinct()
    out = join_checked(assigned, known, "category_id", "left").crossJoin(F.broadcast(first))  # one row
    return out.withColumn("category_id", F.when(F.col("_k"), F.col("category_id")).otherwise(F.coalesce("_first", F.lit(s.CATCH_ALL)))).select(assigned.columns)


def named(categories: DataFrame, nouns) -> DataFrame:
    """Categories whose name has a noun, by ``nouns``, a function of a column: those that may be the first of their members."""
    return categories.where(F.size(nouns(F.col("name"))) > 0)


def prompt_rows(categories: DataFrame) -> DataFrame:
    """(id, name, description): what a model is told of a catalogue when it assigns files."""
    return categories.select("id", "name", F.coalesce("description", F.lit("")).alias("description"))


def merged(assigned: DataFrame, merges: DataFrame) -> DataFrame:
    """Assignments after (drop, keep) merges of categories: one step, not followed further."""
    m = merges.select(F.col("drop").alias("category_id"), F.col("keep").alias("_to"))
    out = join_checked(assigned, m, "category_id", "left")
    return out.withColumn("category_id", F.coalesce("_to", "category_id")).select(assigned.columns)


def time_rescued(entries: DataFrame, categories: DataFrame, members: DataFrame | None = None, settings: Settings = Settings(), need_nouns: bool = False, reclassify: bool = True) -> DataFrame:
    """(path, category_id, compat): for each file the category whose period has its day and which fits it best.

    Files are joined with the periods' days, not with all categories: each period is unrolled to the months it touches,
    so the join has an equality and a catalogue of any size. What members have is joined by value. Ties go to the
    narrower period, then the id. ``entries`` may have a ``sig`` with nouns; ``members`` (category_id, sig) may be None.
    ``need_nouns``: decline files without proper nouns, as happens wherever no analyser for them is present.
    """
    sigs = (entries if "sig" in entries.columns else similarity.signals(entries)).select("path", "sig")
    if need_nouns:
        sigs = sigs.where((F.size("sig.name_nouns") > 0) | (F.size("sig.body_nouns") > 0))
    period = dates.label_range(F.col("time_label"))
    cats = categories.where(F.col("id") != s.CATCH_ALL).select(F.col("id").alias("category_id"), period.alias("period")).where("period IS NOT NULL")
    if members is None:
        members = sigs.limit(0).select(F.lit("").alias("category_id"), "sig")
    else:
        members = members.select("category_id", "sig")
        cats = cats.join(members.select("category_id").distinct(), "category_id", "left_semi")
    month = lambda d: F.trunc(d, "month")
    spread = cats.withColumn("_month", F.explode(F.sequence(month(F.col("period.start")), month(F.col("period.end")), F.expr("interval 1 month"))))
    day = F.col("sig.day")
    near = join_checked(sigs.withColumn("_month", month(day)), cut(spread), "_month").where(day.between(F.col("period.start"), F.col("period.end")))
    scored = similarity.axes(cut(near.select("path", "category_id", "sig", "period")), members, categories, reclassify)
    scored = scored.withColumn("compat", similarity.compatibility(reclassify)).where(F.col("compat") >= settings.rescue_least)
    span = F.datediff(F.col("period.end"), F.col("period.start"))
    best = scored.groupBy("path").agg(F.min(F.struct((-F.round("compat", 6)).alias("k"), span.alias("span"), "category_id", "compat")).alias("b"))
    return best.select("path", "b.category_id", "b.compat")


def covered(assigned: DataFrame, entries: DataFrame, categories: DataFrame, settings: Settings = Settings(), reclassify: bool = True) -> DataFrame:
    """Assignments (path, category_id, score, reason) of all entries: those without one, and those in the catch-all, go where
    their period says; else they are the catch-all's.

    Members of a category are the files that are assigned to it. A file that was in the catch-all keeps a higher score.
    """
    entries = entries if "sig" in entries.columns else similarity.signals(entries)
    sigs = entries.select("path", "sig")
    assigned = assigned.select("path", "category_id", "score", "reason")
    members = sigs.join(assigned.where(F.col("category_id") != s.CATCH_ALL).select("path", "category_id"), "path").select("category_id", "sig")
    all_ = entries.select("path").join(assigned, "path", "left")
    open_ = all_.where(F.col("category_id").isNull() | (F.col("category_id") == s.CATCH_ALL))
    found = time_rescued(sigs.join(open_.select("path"), "path", "left_semi"), categories, members, settings, reclassify=reclassify)
    out = all_.join(found.select("path", F.col("category_id").alias("_to")), "path", "left")
    lost = F.col("category_id").isNull()
    return out.select(
        "path",
        F.coalesce("_to", "category_id", F.lit(s.CATCH_ALL)).alias("category_id"),
        F.when(F.col("_to").isNotNull(), F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(s.RESCUE_SCORE))).when(lost, s.LOST_SCORE).otherwise(F.col("score")).alias("score"),
        F.when(F.col("_to").isNotNull(), s.RESCUE_REASON).when(lost, s.LOST_REASON).otherwise(F.col("reason")).alias("reason"),
    )


def absorbed(assigned: DataFrame, entries: DataFrame, categories: DataFrame, settings: Settings = Settings(), reclassify: bool = True) -> DataFrame:
    """(small_id, large_id, compat): where the files of each category of fewer than min_category_size go.

    Each small category has at most that many files, so the pairs are (small categories x their few files x large
    categories): a stated set against the catalogue's ids, without what their members have, which is joined by value.
    The best mean compatibility wins, ties by id; below ``absorb_least`` it is the catch-all.
    """
    counts = assigned.groupBy("category_id").agg(F.count("*").alias("n"))
    known = counts.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_semi")
    small = counts.where((F.col("n") < settings.min_category_size) & (F.col("category_id") != s.CATCH_ALL)).select("category_id")
    large = cut(known.where((F.col("n") >= settings.min_category_size) & (F.col("category_id") != s.CATCH_ALL)).select("category_id"))
    sigs = (entries if "sig" in entries.columns else similarity.signals(entries)).select("path", "sig").join(assigned.select("path", "category_id"), "path")
    few = sigs.join(small, "category_id", "left_semi").select("path", F.col("category_id").alias("small_id"), "sig")
    pairs = few.crossJoin(F.broadcast(large) if is_small(large) else large)
    scored = similarity.axes(cut(pairs), sigs.join(large, "category_id", "left_semi").select("category_id", "sig"), categories, reclassify)
    means = scored.groupBy("small_id", "category_id").agg(F.avg(similarity.compatibility(reclassify)).alias("m"))
    best = means.groupBy("small_id").agg(F.min(F.struct((-F.round("m", 6)).alias("k"), "category_id", "m")).alias("b"))
    out = small.select(F.col("category_id").alias("small_id")).join(best, "small_id", "left")
    fits = F.coalesce(F.col("b.m") >= settings.absorb_least, F.lit(False))
    return out.select("small_id", F.when(fits, F.col("b.category_id")).otherwise(s.CATCH_ALL).alias("large_id"), F.coalesce("b.m", F.lit(0.0)).alias("compat"))


def apply_absorption(assigned: DataFrame, redirect: DataFrame) -> DataFrame:
    """Assignments with small categories' files moved and their reason told."""
    out = join_checked(assigned, redirect.select(F.col("small_id").alias("category_id"), "large_id"), "category_id", "left")
    reason = F.when(F.col("large_id").isNotNull(), F.regexp_replace(F.concat(F.coalesce("reason", F.lit("")), F.lit(s.ABSORBED_REASON)), r"^[ ·]+", "")).otherwise(F.col("reason"))
    return out.withColumn("reason", reason).withColumn("category_id", F.coalesce("large_id", "category_id")).select(assigned.columns)


def suffix_matched(assigned: DataFrame, entries: DataFrame) -> DataFrame:
    """(assigned_path, path): for assignments whose path isn't an entry's, the first entry whose path ends in it, or in whose name it ends.

    Both come down to one last part of a path ending in the other, so the longer side's endings are unrolled and the
    join is an equality on a whole name: no end that many names share, as an extension, ever meets itself.
    """
    last = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    endings = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, F.length(c))))
    loose = assigned.select(F.col("path").alias("assigned_path")).distinct().join(entries.select(F.col("path").alias("assigned_path")), "assigned_path", "left_anti")
    # whichever entry has the name will do, so the first path of each name is enough
    named = entries.where("name != ''").groupBy("name").agg(F.min("path").alias("path"))
    ends = entries.groupBy(last("path").alias("end")).agg(F.min("path").alias("path")).where("end != ''")
    within = loose.withColumn("name", endings(last("assigned_path"))).join(named, "name")
    bare = cut(loose.where(~F.col("assigned_path").contains("/") & (F.col("assigned_path") != "")))
    sizes = bare.agg(F.collect_set(F.length("assigned_path")).alias("sizes")).first()["sizes"]  # lengths of names
    around = ends.withColumn("assigned_path", endings(F.col("end"))).where(F.length("assigned_path").isin(sizes or [0]))
    both = within.select("assigned_path", "path").unionByName(join_checked(around, bare, "assigned_path").select("assigned_path", "path"))
    return both.groupBy("assigned_path").agg(F.min("path").alias("path"))
