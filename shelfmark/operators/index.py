"""Full-text index, search and history over recorded runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.session import is_small, join_checked, spread

#: Columns that the index reads, in order, and those that the search for substrings reads. Fixed values.
INDEXED = ("filename", "folder", "original_path", "new_path", "category", "reason", "content_excerpt")
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(files: DataFrame) -> DataFrame:
    """(term, file_id, column, place): where each term is. A filter on terms is applied as the tokens come up, before any shuffle."""
    rows = spread(files.select("file_id", *INDEXED))
    texts = rows.select("file_id", F.posexplode(F.array(*INDEXED)).alias("column", "text"))
    return texts.select("file_id", "column", F.posexplode(text.search_tokens(F.col("text"))).alias("place", "term")).select("term", "file_id", "column", "place")


def packed(post: DataFrame) -> DataFrame:
    """Postings for storing: (term, file_id, column, places). Write them sorted by term, so prefix filters prune row groups."""
    return post.groupBy("term", "file_id", "column").agg(F.sort_array(F.collect_list("place")).alias("places")).repartitionByRange("term").sortWithinPartitions("term", "file_id")


def unpacked(stored: DataFrame) -> DataFrame:
    return stored.select("term", "file_id", "column", F.explode("places").alias("place"))


def lengths(files: DataFrame) -> DataFrame:
    """(file_id, length): number of tokens of all indexed columns."""
    sizes = [F.size(text.search_tokens(F.col(c))) for c in INDEXED]
    return spread(files.select("file_id", *INDEXED)).select("file_id", sum(sizes[1:], sizes[0]).alias("length"))


def _phrase_hits(post: DataFrame, words: list[str]) -> DataFrame:
    """(file_id, tf) of a phrase whose last word is a prefix. Terms are filtered by equality or prefix in the scan."""
    *first, last = words
    hits = post.where(F.col("term").startswith(last)).select("file_id", "column", "place")
    for i, w in enumerate(reversed(first), 1):
        before = post.where(F.col("term") == w).select("file_id", "column", (F.col("place") + i).alias("place"))
        hits = hits.join(before, ["file_id", "column", "place"], "left_semi")
    return hits.groupBy("file_id").agg(F.count("*").alias("tf"))


def bm25(post: DataFrame, length: DataFrame, query: str, limit: int | None = 100) -> DataFrame:
    """(file_id, score), the best first: lower is better, as the index's ranking has it; ties by file_id.

    Only postings of the query's terms are read; the numbers of rows and tokens are one row. A query without words has
    no hits. ``limit`` None gives all.
    """
    phrases = text.query_phrases(query)
    total = length.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    if not phrases or not total["n"]:
        return length.select("file_id", F.lit(0.0).alias("score")).limit(0)
    hits = None
    for i, words in enumerate(phrases):
        one = _phrase_hits(post, words).select("file_id", F.lit(i).alias("phrase"), "tf")
        hits = one if hits is None else hits.unionByName(one)
    found = hits.groupBy("phrase").agg(F.count("*").alias("n"))
    n_all = F.lit(float(total["n"]))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((n_all - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    norm = K1 * (1 - B + B * F.col("length") / F.lit(float(total["mean"])))
    rows = hits.join(F.broadcast(found), "phrase").join(length, "file_id")  # a row for each word of the query
    scored = rows.groupBy("file_id").agg((-F.sum(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm))).alias("score"))
    return scored if limit is None else scored.orderBy("score", "file_id").limit(limit)


def like(files: DataFrame, query: str, without: DataFrame | None = None, limit: int | None = 100) -> DataFrame:
    """file_ids of rows with the query as a substring of a field, newest first; '%' and '_' are wildcards, ASCII case is ignored."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pattern = "%" + "".join(ch.lower() if ch.isascii() else ch for ch in query.strip()) + "%"
    any_ = F.lit(False)
    for c in INDEXED:
        any_ = any_ | F.coalesce(fold(F.col(c)).like(pattern), F.lit(False))
    hits = files.where(any_ & F.lit(bool(query.strip()))).select("file_id")
    hits = hits if without is None else hits.join(without.select("file_id"), "file_id", "left_anti")
    return hits if limit is None else hits.orderBy(F.desc("file_id")).limit(limit)


def search(files: DataFrame, post: DataFrame, length: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """(rank, file_id, op_id, new_path, category, snippet, matched_in): ranked hits, then those of substrings up to the limit.

    A ranked hit is shown by the first of its columns that has the query or one of its words, and its field is found from
    that; one of a substring by its excerpt, else it is its name that matched. The order is over at most ``limit`` rows.
    """
    ranked = bm25(post, length, query, limit).select("file_id", F.lit(0).alias("src"), "score")
    more = like(files, query, ranked, limit).select("file_id", F.lit(1).alias("src"), (-F.col("file_id")).cast("double").alias("score"))
    top = ranked.unionByName(more).orderBy("src", "score", "file_id").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy("src", "score", "file_id")))
    rows = files.join(F.broadcast(top), "file_id") if limit <= 50_000 else files.join(top, "file_id")  # at most ``limit`` rows
    words = text.query_phrases(query)
    needles = list(dict.fromkeys([query.strip(), *[w for ws in words for w in ws]]))
    shown = lambda columns: F.coalesce(*[F.nullif(text.excerpt_around(F.coalesce(c, F.lit("")), n), F.lit("")) for n in needles for c in columns], F.lit(""))
    rows = rows.withColumn("snippet", F.when(F.col("src") == 0, shown(INDEXED)).otherwise(shown(["content_excerpt"])))
    field = text.matched_field(F.col("snippet"), F.col("new_path"), F.col("category"), F.col("reason"), F.col("content_excerpt"), F.col("original_path"))
    liked = F.when(F.col("snippet") != "", "content").otherwise("name")
    return rows.select("rank", "file_id", "op_id", "new_path", "category", "snippet", F.when(F.col("src") == 0, field).otherwise(liked).alias("matched_in"))


# --- runs -------------------------------------------------------------------------------------------------------


def history(operations: DataFrame, files: DataFrame, limit: int | None = 50) -> DataFrame:
    """Runs, newest first, with their number of files and report path ('' where the statistics can't be read)."""
    counts = files.groupBy("op_id").agg(F.count("*").alias("moved_count"))
    path = F.coalesce(F.get_json_object(F.when(F.try_parse_json("stats_json").isNotNull(), F.col("stats_json")), "$.report_path"), F.lit(""))
    out = operations.join(counts, "op_id", "left").select("op_id", "target_root", "started_at", "finished_at", "dry_run", F.coalesce("moved_count", F.lit(0)).alias("moved_count"), path.alias("report_path"))
    return out if limit is None else out.orderBy(F.desc("op_id")).limit(limit)


def latest(operations: DataFrame) -> DataFrame:
    return operations.agg(F.max("op_id").alias("op_id"))


def purged(files: DataFrame, moved: DataFrame) -> DataFrame:
    """Recorded rows that stay when ``moved`` (original_path, new_path) is recorded: those at neither path."""
    stale = moved.select(F.col("original_path").alias("p")).unionByName(moved.select(F.col("new_path").alias("p"))).where("p IS NOT NULL").distinct()
    return files.join(stale, files["new_path"] == stale["p"], "left_anti")


def orphans(files: DataFrame, listing: DataFrame, newest: int | None = 5_000) -> DataFrame:
    """Of the newest rows those whose path no longer exists: the sweep's bounded look-back; of all rows if ``newest`` is None."""
    seen = files if newest is None else files.orderBy(F.desc("file_id")).limit(newest)
    return seen.join(listing.select(F.col("path").alias("new_path")), "new_path", "left_anti")


def reindexed(listing: DataFrame, op_id: int) -> DataFrame:
    """Rows for a listing (path): category is the parent directory, score 1, no reason or excerpt."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return listing.select(
        F.lit(op_id).cast("bigint").alias("op_id"), F.col("path").alias("original_path"), F.col("path").alias("new_path"), name.alias("filename"), folder.alias("folder"),
        F.regexp_extract(folder, "([^/]*)$", 1).alias("category"), F.lit("").alias("reason"), F.lit(1.0).alias("score"), F.lit("").alias("content_excerpt"),
    )


def backfilled(files: DataFrame, operations: DataFrame) -> DataFrame:
    """``files`` with missing category names taken from their run's statistics."""
    kind = "array<struct<id:string,name:string>>"
    cats = operations.select("op_id", F.explode(F.from_json(F.get_json_object(F.when(F.try_parse_json("stats_json").isNotNull(), F.col("stats_json")), "$.categories"), kind)).alias("c")).select("op_id", F.col("c.id").alias("category"), F.col("c.name").alias("_n"))
    one = cats.groupBy("op_id", "category").agg(F.max("_n").alias("_n"))
    out = join_checked(files, one, ["op_id", "category"], "left")
    return out.withColumn("category_name", F.coalesce(F.nullif("category_name", F.lit("")), "_n", F.lit(""))).select(files.columns)


#: Columns that a recorded file has, with their kinds.
COLUMNS = {
    "file_id": "bigint", "op_id": "bigint", "original_path": "string", "new_path": "string", "filename": "string", "folder": "string", "category": "string", "category_name": "string",
    "reason": "string", "score": "double", "content_excerpt": "string", "created_at": "timestamp_ntz",
}


def migrated(files: DataFrame, operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An older table of files with the columns it lacks, names filled from the runs' statistics; and its postings, made anew."""
    lacking = {c: F.lit(None).cast(kind) for c, kind in COLUMNS.items() if c not in files.columns}
    whole = backfilled(files.withColumns(lacking), operations)
    return whole, postings(whole)


def catalogue_names(files: DataFrame, categories: DataFrame) -> DataFrame:
    """(file_id, category_name) by the catalogue, '' for unknown and null categories."""
    names = categories.select(F.col("id").alias("category"), F.col("name").alias("_n"))
    small = F.broadcast(names) if is_small(names) else names
    return files.select("file_id", "category").join(small, "category", "left").select("file_id", F.coalesce("_n", F.lit("")).alias("category_name"))
