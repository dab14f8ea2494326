"""Queries on search, history, recording, reports and vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import schema as s
from shelfmark.functions import text
from shelfmark.operators import dedup, index, report, vectors
from shelfmark.plans.adapters import D, documents, lit
from shelfmark.plans.text_queries import _sql_around
from shelfmark.session import shared_folder, table
from shelfmark.sources import sinks

C = F.col
QUERY = "budget archive"
PHRASE = "reading_list"
LIKE = "Bericht"
HYBRID = "syllabus"
MODELS = ("gemini-2.5-pro", "GPT-4o-mini", "own-llama-70b", "somebody-else", "claude-3-5-haiku")


def _files(spark, sf_dir):
    return table(spark, sf_dir, "files")


def bm25_search(spark, sf_dir):
    """All ranked hits of two words."""
    f = _files(spark, sf_dir)
    return index.bm25(index.postings(f), index.lengths(f), QUERY, None).select("file_id", F.round("score", 6).alias("score"))


def bm25_phrase(spark, sf_dir):
    """A query token of two words is a phrase."""
    f = _files(spark, sf_dir)
    return index.bm25(index.postings(f), index.lengths(f), PHRASE, None).select("file_id", F.round("score", 6).alias("score"))


def bm25_top(spark, sf_dir):
    """The report of the hundred best."""
    f = _files(spark, sf_dir)
    return index.bm25(index.postings(f), index.lengths(f), QUERY, 100).select("file_id", F.round("score", 6).alias("score"))


def posting_counts(spark, sf_dir):
    return index.postings(_files(spark, sf_dir)).groupBy("term").agg(F.countDistinct("file_id").alias("n_rows"), F.count("*").alias("n_uses"))


def bm25_stored(spark, sf_dir):
    """Over an index that is written first and then read by its terms."""
    path = shared_folder(spark)
    sinks.write_postings(_files(spark, sf_dir), path)
    return index.bm25(*sinks.stored_index(spark, path), QUERY, None).select("file_id", F.round("score", 6).alias("score"))


def like_search(spark, sf_dir):
    return index.like(_files(spark, sf_dir), LIKE, None, None)


def hybrid_search(spark, sf_dir):
    """Ranked hits and then those of substrings, with snippets."""
    f = _files(spark, sf_dir)
    return index.search(f, index.postings(f), index.lengths(f), HYBRID)


def matched_field(spark, sf_dir):
    f = _files(spark, sf_dir).where("content_excerpt IS NOT NULL")
    snippet = text.excerpt_around(C("content_excerpt"), "archive")
    return f.select("file_id", text.matched_field(snippet, C("new_path"), C("category"), C("reason"), C("content_excerpt"), C("original_path")).alias("field"))


def op_history(spark, sf_dir):
    return index.history(table(spark, sf_dir, "operations"), _files(spark, sf_dir), None)


def op_history_top(spark, sf_dir):
    return index.history(table(spark, sf_dir, "operations"), _files(spark, sf_dir))


def latest_op(spark, sf_dir):
    return index.latest(table(spark, sf_dir, "operations"))


def stale_purge(spark, sf_dir):
    """What stays of the index when the latest run is recorded."""
    f = _files(spark, sf_dir)
    last = f.agg(F.max("op_id")).first()[0]
    return index.purged(f.where(C("op_id") < F.lit(last)), f.where(C("op_id") == F.lit(last))).select("file_id")


def orphan_sweep(spark, sf_dir):
    """All recorded rows whose file is gone: the listing lacks new paths of an odd length."""
    f = _files(spark, sf_dir)
    listing = f.select(C("new_path").alias("path")).where("length(path) % 2 = 0").distinct()
    return index.orphans(f, listing, None).select("file_id")


def reindex(spark, sf_dir):
    listing = _files(spark, sf_dir).select(C("new_path").alias("path")).where("path IS NOT NULL").distinct()
    return index.reindexed(listing, 0)


def backfill_names(spark, sf_dir):
    return index.catalogue_names(_files(spark, sf_dir), table(spark, sf_dir, "categories"))


def stats_backfill(spark, sf_dir):
    """Names from the runs' statistics, where those can be read."""
    return index.backfilled(_files(spark, sf_dir), table(spark, sf_dir, "operations")).select("file_id", "category_name")


def report_distribution(spark, sf_dir):
    return report.distribution(_files(spark, sf_dir)).withColumn("share", F.round("share", 9))


def report_moves(spark, sf_dir):
    return report.moves(_files(spark, sf_dir), 1)


def report_totals(spark, sf_dir):
    return report.totals(_files(spark, sf_dir), table(spark, sf_dir, "shortcuts"))


def run_duration(spark, sf_dir):
    return report.durations(table(spark, sf_dir, "operations"))


def skip_list(spark, sf_dir):
    """The first rows that were not moved, as the report has them."""
    return report.skipped(_files(spark, sf_dir))


def llm_cost(spark, sf_dir):
    """Costs of calls, events standing for calls of several models."""
    e = table(spark, sf_dir, "events")
    names = F.array(*[F.lit(m) for m in MODELS])
    calls = e.select(F.element_at(names, (F.pmod(C("event_id"), F.lit(len(MODELS))) + 1).cast("int")).alias("model"), F.lit(3000).alias("prompt_chars"), F.length("props").alias("response_chars"), F.abs("value").alias("duration"), (F.pmod(C("event_id"), F.lit(7)) != 0).alias("success"))
    return report.call_costs(calls).withColumns({c: F.round(c, 6) for c in ("seconds", "dollars", "won")})


def report_freed(spark, sf_dir):
    return report.freed(dedup.ledger(dedup.duplicate_groups(documents(spark, sf_dir), 1)))


def dedup_ledger_labels(spark, sf_dir):
    return documents(spark, sf_dir).select("path", text.bytes_label(C("size") * 1000).alias("label"))


def llm_usage(spark, sf_dir):
    """Usage of calls, events standing for calls."""
    e = table(spark, sf_dir, "events")
    calls = e.select(F.lit(3000).alias("prompt_chars"), F.length("props").alias("response_chars"), F.abs("value").alias("duration"), (F.pmod(C("event_id"), F.lit(5)) / 10.0).alias("ttft"), (F.pmod(C("event_id"), F.lit(7)) != 0).alias("success"))
    u = report.call_usage(calls)
    return u.withColumns({c: F.round(c, 6) for c in ("mean_ttft", "tokens_per_second")})


def cosine_pairs(spark, sf_dir):
    return vectors.cosine_pairs(table(spark, sf_dir, "embeddings"), 0.4).withColumn("cosine", F.round("cosine", 6))


def similar_components(spark, sf_dir):
    return vectors.merged_groups(table(spark, sf_dir, "embeddings"), 0.4)


def cosine_to_first(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.orderBy("vec_id").first()["embedding"]
    return vectors.cosine_to(e, list(first)).select("vec_id", F.round("cosine", 6).alias("cosine"))


def tfidf_weights(spark, sf_dir):
    return vectors.tfidf(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 6))


QUERIES = {f.__name__: f for f in (
    bm25_search, bm25_phrase, bm25_top, bm25_stored, posting_counts, like_search, hybrid_search, matched_field, op_history, op_history_top, latest_op, stale_purge, orphan_sweep, reindex, backfill_names, stats_backfill,
    report_distribution, report_moves, report_totals, run_duration, skip_list, llm_cost, report_freed, dedup_ledger_labels, llm_usage, cosine_pairs, similar_components, cosine_to_first, tfidf_weights,
)}


# --- SQL --------------------------------------------------------------------------------------------------------------


def _tok(x):
    plain = f"lower(translate(regexp_replace(coalesce({x}, ''), '[\\x{{0300}}-\\x{{036F}}]', '', 'g'), {lit(text.ACCENTED)}, {lit(text.BASE)}))"
    return f"regexp_extract_all({plain}, {lit(text.SEARCH_TOKEN)})"


_TOKENS = "tk AS (SELECT file_id, c.i AS col, c.t AS w FROM (SELECT file_id, unnest([" + ", ".join(f"{{'i': {i}, 't': {_tok(c)}}}" for i, c in enumerate(index.INDEXED)) + "]) AS c FROM files))"


def _bm25(phrases):
    """SQL of the score; phrases are lists of words."""
    parts = []
    for i, words in enumerate(phrases):
        k = len(words)
        tests = " AND ".join([f"w[p + {j}] = {lit(x)}" for j, x in enumerate(words[:-1])] + [f"starts_with(w[p + {k - 1}], {lit(words[-1])})"])
        parts.append(f"SELECT {i} AS ph, file_id, sum(len(list_filter(range(1, len(w) - {k - 2}), lambda p: {tests}))) AS tf FROM tk GROUP BY file_id")
    return f"""WITH {_TOKENS}, le AS (SELECT file_id, sum(len(w)) AS dl FROM tk GROUP BY file_id), st AS (SELECT count(*) AS n, avg(dl) AS mean FROM le),
      h AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE tf > 0), df AS (SELECT ph, count(*) AS c FROM h GROUP BY ph)
      SELECT file_id, round(-sum(greatest(1e-6, ln((st.n - c + 0.5) / (c + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / st.mean))), 6) AS score FROM h JOIN df USING (ph) JOIN le USING (file_id), st GROUP BY file_id"""


_low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_like = " OR ".join(f"coalesce({_low.format(c)} LIKE {lit('%' + LIKE.lower() + '%')}, false)" for c in index.INDEXED)
_path = "coalesce(CASE WHEN json_valid(stats_json) THEN json_extract_string(stats_json, '$.report_path') END, '')"
_hist = f"SELECT op_id, target_root, started_at, finished_at, dry_run, coalesce(n, 0) AS moved_count, {_path} AS report_path FROM operations LEFT JOIN (SELECT op_id, count(*) AS n FROM files GROUP BY op_id) USING (op_id)"
_first = lambda x: f"lower(left(coalesce({x}, ''), 30))"
_bare = "lower(translate(s, '«»', ''))"
_field = " ".join(f"WHEN {_first(c)} != '' AND contains({_bare}, {_first(c)}) THEN '{n}'" for n, c in (("name", "regexp_extract(new_path, '([^/]*)$', 1)"), ("category", "category"), ("reason", "reason"), ("content", "content_excerpt"), ("path", "original_path")))
_COS = "co AS (SELECT a.vec_id AS a, b.vec_id AS b, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"
_label = "CASE WHEN {0} >= 1048576 THEN printf('%.1f', {0} / 1048576.0) || ' MB' ELSE {0} || ' B' END"

_price = lambda i: "CASE " + " ".join(f"WHEN lower(model) = {lit(m)} THEN {p[i]!r}" for m, p in s.PRICES.items()) + f" WHEN {' OR '.join(f'contains(lower(model), {lit(w)})' for w in s.LOCAL)} THEN 0.0 ELSE {s.UNKNOWN_PRICE[i]!r} END"
_shown = "coalesce(" + ", ".join(f"nullif({_sql_around("coalesce(" + c + ", '')", HYBRID)}, '')" for c in index.INDEXED) + ", '')"
_hybrid_like = " OR ".join(f"coalesce({_low.format(c)} LIKE {lit('%' + HYBRID + '%')}, false)" for c in index.INDEXED)

ORACLE = {
    "run_duration": "SELECT op_id, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS seconds FROM operations",
    "skip_list": "SELECT file_id, original_path, coalesce(reason, '') AS reason FROM files WHERE new_path IS NULL ORDER BY file_id LIMIT 500",
    "llm_cost": f"""WITH c AS (SELECT CASE event_id % 5 {' '.join(f'WHEN {i} THEN {lit(m)}' for i, m in enumerate(MODELS))} END AS model, 1000 AS pt, length(props) // 3 AS rt, abs(value) AS duration, event_id % 7 = 0 AS failed FROM events)
      SELECT model, count(*) AS n_calls, count(*) FILTER (failed) AS n_failed, sum(pt)::BIGINT AS prompt_tokens, sum(rt)::BIGINT AS response_tokens, round(sum(duration), 6) AS seconds, round(sum(pt / 1e6 * ({_price(0)}) + rt / 1e6 * ({_price(1)})), 6) AS dollars, round(sum(pt / 1e6 * ({_price(0)}) + rt / 1e6 * ({_price(1)})) * 1380.0, 6) AS won FROM c GROUP BY model""",
    "hybrid_search": f"""WITH b AS (SELECT file_id, 0 AS src, score FROM ({_bm25(text.query_phrases(HYBRID)).replace('round(-sum', '(-sum').replace(', 6) AS score', ') AS score')}) ORDER BY score, file_id LIMIT 100),
      l AS (SELECT file_id, 1 AS src, -file_id::DOUBLE AS score FROM files WHERE ({_hybrid_like}) AND file_id NOT IN (SELECT file_id FROM b) ORDER BY file_id DESC LIMIT 100),
      t AS (SELECT *, row_number() OVER (ORDER BY src, score, file_id) AS rank FROM (SELECT * FROM b UNION ALL SELECT * FROM l) ORDER BY src, score, file_id LIMIT 100),
      x AS (SELECT f.*, t.rank, t.src, CASE WHEN src = 0 THEN {_shown} ELSE {_sql_around("coalesce(content_excerpt, '')", HYBRID)} END AS s FROM t JOIN files f USING (file_id))
      SELECT rank::INT AS rank, file_id, op_id, new_path, category, s AS snippet, CASE WHEN src = 1 THEN CASE WHEN s != '' THEN 'content' ELSE 'name' END WHEN s = '' THEN '' {_field} ELSE 'match' END AS matched_in FROM x""",
    "bm25_search": _bm25(text.query_phrases(QUERY)),
    "bm25_stored": _bm25(text.query_phrases(QUERY)),
    "bm25_phrase": _bm25(text.query_phrases(PHRASE)),
    "bm25_top": _bm25(text.query_phrases(QUERY)) + " ORDER BY score, file_id LIMIT 100",
    "posting_counts": f"WITH {_TOKENS}, u AS (SELECT file_id, unnest(w) AS term FROM tk) SELECT term, count(DISTINCT file_id) AS n_rows, count(*) AS n_uses FROM u GROUP BY term",
    "like_search": f"SELECT file_id FROM files WHERE {_like}",
    "matched_field": f"SELECT file_id, CASE WHEN s = '' THEN '' {_field} ELSE 'match' END AS field FROM (SELECT *, {_sql_around('content_excerpt', 'archive')} AS s FROM files WHERE content_excerpt IS NOT NULL)",
    "op_history": _hist,
    "op_history_top": _hist + " ORDER BY op_id DESC LIMIT 50",
    "latest_op": "SELECT max(op_id) AS op_id FROM operations",
    "stale_purge": "WITH l AS (SELECT max(op_id) AS m FROM files), p AS (SELECT original_path AS p FROM files, l WHERE op_id = m UNION SELECT new_path FROM files, l WHERE op_id = m) SELECT file_id FROM files, l WHERE op_id < m AND (new_path IS NULL OR new_path NOT IN (SELECT p FROM p WHERE p IS NOT NULL))",
    "orphan_sweep": "SELECT file_id FROM files WHERE new_path IS NULL OR length(new_path) % 2 != 0",
    "reindex": "SELECT 0::BIGINT AS op_id, p AS original_path, p AS new_path, regexp_extract(p, '([^/]*)$', 1) AS filename, regexp_replace(p, '/[^/]*$', '') AS folder, regexp_extract(regexp_replace(p, '/[^/]*$', ''), '([^/]*)$', 1) AS category, '' AS reason, 1.0::DOUBLE AS score, '' AS content_excerpt FROM (SELECT DISTINCT new_path AS p FROM files WHERE new_path IS NOT NULL)",
    "backfill_names": "SELECT file_id, coalesce(c.name, '') AS category_name FROM files f LEFT JOIN categories c ON f.category = c.id",
    "stats_backfill": """WITH j AS (SELECT op_id, unnest(CAST(json_extract(CASE WHEN json_valid(stats_json) THEN stats_json END, '$.categories') AS JSON[])) AS c FROM operations),
      o AS (SELECT op_id, json_extract_string(c, '$.id') AS category, max(json_extract_string(c, '$.name')) AS n FROM j GROUP BY 1, 2)
      SELECT file_id, coalesce(nullif(category_name, ''), n, '') AS category_name FROM files LEFT JOIN o USING (op_id, category)""",
    "report_distribution": "SELECT op_id, coalesce(category, '') AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY op_id), 9) AS share FROM files GROUP BY 1, 2",
    "report_moves": "SELECT file_id, original_path, new_path, category, score, reason FROM files WHERE op_id = 1 ORDER BY file_id LIMIT 500",
    "report_totals": "SELECT op_id, count(*) AS n_files, count(*) FILTER (new_path IS NULL) AS n_skipped, coalesce(any_value(s.n), 0) AS n_shortcuts, count(DISTINCT category) AS n_categories FROM files LEFT JOIN (SELECT op_id, count(*) AS n FROM shortcuts GROUP BY op_id) s USING (op_id) GROUP BY op_id",
    "report_freed": f"WITH {D}, g AS (SELECT size, count(*) AS c FROM d WHERE size >= 1 GROUP BY size, sha256(content) HAVING count(*) > 1), t AS (SELECT coalesce(sum(c - 1), 0)::BIGINT AS n, coalesce(sum(size * (c - 1)), 0)::BIGINT AS bytes FROM g) SELECT n, bytes, {_label.format('bytes')} AS label FROM t",
    "dedup_ledger_labels": f"WITH {D} SELECT path, {_label.format('(size * 1000)')} AS label FROM d",
    "llm_usage": "SELECT count(*) AS n_calls, count(*) FILTER (event_id % 7 = 0) AS n_failed, (count(*) * 3000 // 3)::BIGINT AS prompt_tokens, floor(sum(length(props)) / 3)::BIGINT AS response_tokens, round(avg(event_id % 5 / 10.0) FILTER (event_id % 5 > 0), 6) AS mean_ttft, round(sum(length(props)) / 3 / sum(abs(value)), 6) AS tokens_per_second FROM events",
    "cosine_pairs": f"WITH {_COS} SELECT a, b, round(cosine, 6) AS cosine FROM co WHERE cosine >= 0.4",
    "similar_components": f"WITH RECURSIVE {_COS}, ed AS (SELECT a, b FROM co WHERE cosine >= 0.4 UNION ALL SELECT b, a FROM co WHERE cosine >= 0.4), re AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT ed.b, re.c FROM re JOIN ed ON re.v = ed.a) SELECT v AS vec_id, min(c) AS component FROM re GROUP BY v",
    "cosine_to_first": "WITH f AS (SELECT embedding::DOUBLE[] AS r FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], r) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_inner_product(r, r)), 6) AS cosine FROM embeddings, f",
    "tfidf_weights": f"WITH t AS (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM c GROUP BY term), w AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM c JOIN d USING (term), n) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w",
}
