"""Likeness: sets, strings, and the seven axes between a file and a category.

A file is described by a struct of (parent, stem, schema, ext, name_nouns, body_nouns, day). What the members of a category
have in common is a table of (category, kind, value) that is joined, never an array: a category may be a third of all files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import schema as s
from shelfmark.functions import dates, text
from shelfmark.session import cut, join_checked


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 if either is empty or null."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common start."""
    n = F.least(F.length(a), F.length(b))
    differs = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, n)


def prefix_share(stem: Column, stems: Column, shortest: Column | None = None) -> Column:
    """Longest common start with any of the stems over the shortest length; 0 below two characters.

    ``shortest``: length of the shortest non-empty stem where it is known. Only stems that share the first two
    characters are compared further.
    """
    least = F.array_min(F.transform(F.filter(stems, lambda t: t != ""), F.length)) if shortest is None else shortest
    near = F.filter(stems, lambda t: t.startswith(F.left(stem, F.lit(2))) & (F.length(t) >= 2))
    best = F.array_max(F.transform(near, lambda t: common_prefix(stem, t)))
    share = F.least(F.lit(1.0), best / F.greatest(F.least(F.length(stem), least), F.lit(1)))
    return F.when((F.length(stem) < 2) | F.coalesce(best < 2, F.lit(True)), 0.0).otherwise(F.coalesce(share, F.lit(0.0)))


def extension_match(ext: Column, exts: Column) -> Column:
    """1 if shared, 0.5 if it is one that every corpus has, else 0."""
    shared = (F.coalesce(ext, F.lit("")) != "") & F.coalesce(F.array_contains(exts, ext), F.lit(False))
    return F.when(~shared, 0.0).when(ext.isin(s.GENERIC_EXTENSIONS), 0.5).otherwise(1.0)


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def signals(entries: DataFrame, name_nouns: Column | None = None, body_nouns: Column | None = None) -> DataFrame:
    """``entries`` (path, name, ext, excerpt, modified) with the struct of a file as ``sig``.

    ``name_nouns`` and ``body_nouns``: columns of arrays, as a morphological analyser gives them; without them the two sets
    are empty, as they are where no analyser can be loaded.
    """
    stem = text.strip_ext(F.col("name"))
    none = F.array().cast("array<string>")
    given = lambda c: none if c is None else F.coalesce(F.array_distinct(c), none)
    return entries.withColumn(
        "sig",
        F.struct(
            parent_of(F.col("path")).alias("parent"),
            stem.alias("stem"),
            text.schema_sequence(stem).alias("schema"),
            F.col("ext").alias("ext"),
            given(name_nouns).alias("name_nouns"),
            given(body_nouns).alias("body_nouns"),
            F.col("modified").cast("date").alias("day"),
        ),
    )


#: Kinds of what members have: nouns of names and bodies, schemas, extensions, parents, parents of parents, stems.
NAME, BODY, SCHEMA, EXT, PARENT, ABOVE, STEM = "name", "body", "schema", "ext", "parent", "above", "stem"


def features(members: DataFrame) -> DataFrame:
    """(category_id, kind, value), each once, of ``members`` (category_id, sig); materialised."""
    sig = F.col("sig")
    one = lambda kind, c: F.array(F.struct(F.lit(kind).alias("kind"), c.alias("value")))
    many = lambda kind, c: F.transform(c, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    each = F.concat(
        many(NAME, sig["name_nouns"]), many(BODY, sig["body_nouns"]), one(SCHEMA, sig["schema"]), one(EXT, sig["ext"]),
        one(PARENT, sig["parent"]), one(ABOVE, parent_of(sig["parent"])), one(STEM, sig["stem"]),
    )
    rows = members.select("category_id", F.explode(each).alias("f")).select("category_id", "f.kind", "f.value").where("value IS NOT NULL AND NOT (kind IN ('ext', 'stem') AND value = '')")
    return cut(rows.distinct())


def _longest_start(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """(category_id, stem, start): the longest common start of a stem with a member's, of two characters at least.

    In the order of stems the member with the longest one is the last before or the first after; only stems that share
    two characters are looked at together.
    """
    head = F.left("stem", F.lit(2))
    asked = pairs.select("category_id", F.col("sig.stem").alias("stem")).where("length(stem) >= 2").distinct().withColumn("own", F.lit(False))
    members = feats.where(F.col("kind") == STEM).select("category_id", F.col("value").alias("stem")).where("length(stem) >= 2").withColumn("own", F.lit(True))
    both = asked.withColumn("head", head)
    both = join_checked(both, members.select("category_id", head.alias("head")).distinct(), ["category_id", "head"], "left_semi").unionByName(members.withColumn("head", head))
    at = Window.partitionBy("category_id", "head").rowsBetween(Window.unboundedPreceding, 0)
    near = lambda *order: F.last(F.when(F.col("own"), F.col("stem")), ignorenulls=True).over(at.orderBy(*order))
    rows = both.withColumn("before", near("stem", F.desc("own"))).withColumn("after", near(F.desc("stem"), "own")).where("NOT own")
    start = lambda c: F.when(F.col(c).isNull(), 0).otherwise(common_prefix(F.col("stem"), F.col(c)))
    return rows.withColumn("start", F.greatest(start("before"), start("after"))).where("start >= 2").select("category_id", "stem", "start")


def _places(pairs: DataFrame, parents: DataFrame, above: DataFrame) -> DataFrame:
    """(category_id, parent, _place): 1 for a directory that a member is in, 0.5 for one next to, above or below such a one."""
    asked = pairs.select("category_id", F.col("sig.parent").alias("parent")).distinct()
    grand = parent_of(F.col("parent"))
    meets = lambda keys, have, place: asked.withColumn("at", keys).join(have, ["category_id", "at"]).select("category_id", "parent", F.lit(place).alias("_place"))
    found = meets(F.col("parent"), parents, 1.0).unionByName(meets(grand, parents, 0.5)).unionByName(meets(F.explode(F.array(grand, F.col("parent"))), above, 0.5))
    return found.groupBy("category_id", "parent").agg(F.max("_place").alias("_place"))


def axes(pairs: DataFrame, members: DataFrame, categories: DataFrame, reclassify: bool = True) -> DataFrame:
    """``pairs`` (path, category_id, sig), each once, with the seven axes s1 to s7 between the file and the category's ``members``."""
    feats = features(members)
    sig = F.col("sig")
    kinds = lambda kind, name: feats.where(F.col("kind") == kind).select("category_id", F.col("value").alias(name))
    # nouns in common, for each pair that has some
    noun = lambda axis, c: F.transform(c, lambda v: F.struct(F.lit(axis).alias("kind"), v.alias("value")))
    asked = pairs.select("path", "category_id", F.explode(F.concat(noun(NAME, sig["name_nouns"]), noun(BODY, sig["body_nouns"]))).alias("a")).select("path", "category_id", "a.*")
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"_{kind}")
    nouns = cut(asked.join(feats, ["category_id", "kind", "value"]).groupBy("path", "category_id").agg(n(NAME), n(BODY)))
    # a schema that a member has, else the most like one, for each schema and category once
    schemas = pairs.select("category_id", F.col("sig.schema").alias("schema")).distinct()
    theirs = feats.where(F.col("kind") == SCHEMA).select("category_id", F.col("value").alias("other"))
    own = schemas.join(theirs.withColumnRenamed("other", "schema"), ["category_id", "schema"], "left_semi").withColumn("_like", F.lit(1.0))
    rest = schemas.join(own.select("category_id", "schema"), ["category_id", "schema"], "left_anti")
    rest = rest.join(theirs, "category_id").groupBy("category_id", "schema").agg(F.max(edit_similarity(F.col("schema"), F.col("other"))).alias("_like"))
    like = own.unionByName(rest)
    size = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"_n_{kind}")
    known = feats.groupBy("category_id").agg(size(NAME), size(BODY), F.min(F.when(F.col("kind") == STEM, F.length("value"))).alias("_shortest"))
    known = known.join(categories.select(F.col("id").alias("category_id"), dates.label_range(F.col("time_label")).alias("_period"), F.coalesce("duration", F.lit("")).alias("_duration")), "category_id", "outer")
    rows = pairs.withColumns({"schema": sig["schema"], "stem": sig["stem"], "ext": sig["ext"], "parent": sig["parent"]})
    rows = join_checked(rows, nouns, ["path", "category_id"], "left")
    rows = join_checked(rows, cut(like), ["category_id", "schema"], "left")
    rows = join_checked(rows, cut(_longest_start(pairs, feats)), ["category_id", "stem"], "left")
    rows = join_checked(rows, kinds(EXT, "ext").withColumn("_ext", F.lit(True)), ["category_id", "ext"], "left")
    rows = join_checked(rows, cut(known), "category_id", "left")
    if not reclassify:
        rows = join_checked(rows, cut(_places(pairs, kinds(PARENT, "at"), kinds(ABOVE, "at"))), ["category_id", "parent"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    overlap = lambda axis, kind: F.coalesce(zero(f"_{axis}") / F.nullif(F.size(sig[f"{axis}_nouns"]) + zero(f"_n_{kind}") - zero(f"_{axis}"), F.lit(0)), F.lit(0.0))
    place = F.lit(0.0) if reclassify else F.coalesce("_place", F.lit(0.0))
    ext = F.when(F.col("_ext").isNull(), 0.0).when(sig["ext"].isin(s.GENERIC_EXTENSIONS), 0.5).otherwise(1.0)
    start = F.when(F.col("start").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("start") / F.greatest(F.least(F.length("stem"), F.col("_shortest")), F.lit(1))))
    parts = [overlap("name", NAME), F.coalesce("_like", F.lit(0.0)), dates.decay(sig["day"], F.col("_period"), F.col("_duration")), place, overlap("body", BODY), ext, start]
    return rows.select(*pairs.columns, *[p.alias(f"s{i + 1}") for i, p in enumerate(parts)])


def _weighed(parts: list[Column], reclassify: bool, weights: s.Weights) -> Column:
    w = weights.reclassify() if reclassify else weights
    total = sum(getattr(w, f"s{i + 1}") * p for i, p in enumerate(parts))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def compatibility(reclassify: bool = True, weights: s.Weights = s.Weights()) -> Column:
    """Weighed sum of the axes s1 to s7, within 0 and 1."""
    return _weighed([F.lit(0.0) if reclassify and i == 4 else F.col(f"s{i}") for i in range(1, 8)], reclassify, weights)


def pair_compatibility(a: Column, b: Column, reclassify: bool = True, weights: s.Weights = s.Weights()) -> Column:
    """Of two files: days apart count over 365, whatever the duration."""
    days = F.abs(F.datediff(a["day"], b["day"]))
    same = F.when(a["parent"] == b["parent"], 1.0).when(parent_of(a["parent"]) == parent_of(b["parent"]), 0.5).otherwise(0.0)
    parts = [
        jaccard(a["name_nouns"], b["name_nouns"]),
        edit_similarity(a["schema"], b["schema"]),
        F.coalesce(F.exp(-days / 365.0), F.lit(0.0)),
        F.lit(0.0) if reclassify else same,
        jaccard(a["body_nouns"], b["body_nouns"]),
        extension_match(a["ext"], F.array(b["ext"])),
        prefix_share(a["stem"], F.array(b["stem"])),
    ]
    return _weighed(parts, reclassify, weights)
