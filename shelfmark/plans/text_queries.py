"""Queries on names, paths, texts and dates, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import schema as s
from shelfmark.functions import budget, dates, similarity, text
from shelfmark.plans.adapters import E, R, entries, in_list, lit, rooted, rr
from shelfmark.session import table

C = F.col


def metadata_projection(spark, sf_dir):
    return entries(spark, sf_dir).select("path", "name", "ext", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"), F.substring("excerpt", 1, 1800).alias("excerpt"))


def payload_projection(spark, sf_dir):
    return entries(spark, sf_dir).select("path", "name", "ext", F.substring("excerpt", 1, 600).alias("excerpt"))


def ignore_scan(spark, sf_dir):
    return rooted(spark, sf_dir).select("root", "path", text.ignored(C("path"), C("root")).alias("ignored"))


def safe_path(spark, sf_dir):
    return rooted(spark, sf_dir).select("path", text.safe_path(C("path")).alias("shown"), text.safe_path(C("path"), True).alias("masked"))


def strip_core(spark, sf_dir):
    e = entries(spark, sf_dir)
    stem = text.strip_ext(C("name"))
    return e.select("path", stem.alias("stem"), text.strip_core(stem).alias("core"))


def schema_sequence(spark, sf_dir):
    return entries(spark, sf_dir).select(text.schema_sequence(text.strip_ext(C("name"))).alias("schema")).groupBy("schema").agg(F.count("*").alias("n"))


def noun_fallback(spark, sf_dir):
    return entries(spark, sf_dir).select("path", F.array_join(text.nouns(C("name")), " ").alias("nouns"), F.array_join(text.nouns(C("excerpt"), 8), " ").alias("first"))


def excerpt_cap(spark, sf_dir):
    return entries(spark, sf_dir).select("path", text.capped(C("excerpt")).alias("shown"), text.capped(C("excerpt"), True).alias("whole"))


def member_text(spark, sf_dir):
    return entries(spark, sf_dir).select("path", text.member_text(C("name"), C("excerpt")).alias("text"))


def category_tokens(spark, sf_dir):
    return table(spark, sf_dir, "categories").select("id", F.array_join(F.array_sort(text.category_tokens(C("name"), C("description"))), " ").alias("tokens"))


def name_tokens(spark, sf_dir):
    return entries(spark, sf_dir).select("path", F.array_join(F.array_sort(text.name_tokens(C("name"))), " ").alias("tokens"))


def opaque_names(spark, sf_dir):
    return entries(spark, sf_dir).where(text.opaque_name(C("name"), C("ext"))).select("path", "name")


def lev_similarity(spark, sf_dir):
    """Schemas of names against the most frequent one of their extension."""
    e = entries(spark, sf_dir).select("ext", text.schema_sequence(text.strip_ext(C("name"))).alias("schema"))
    n = e.groupBy("ext", "schema").agg(F.count("*").alias("n"))
    top = n.groupBy("ext").agg(F.max(F.struct("n", "schema")).alias("t")).select("ext", C("t.schema").alias("top"))
    return n.join(top, "ext").select("ext", "schema", "n", F.round(similarity.edit_similarity(C("schema"), C("top")), 6).alias("like"))


def sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "categories").select("id", text.sanitize_name(C("name")).alias("folder"), text.sanitize_name(C("description")).alias("described"))


def parse_tag(spark, sf_dir):
    f = table(spark, sf_dir, "files").where("folder IS NOT NULL").select(F.regexp_extract("folder", "([^/]*)$", 1).alias("name")).distinct()
    t = text.tag_parts(C("name"))
    return f.select("name", t["clean_name"].alias("clean_name"), t["period"].alias("period"), t["signature"].alias("signature"), text.has_group(C("name")).alias("grouped"), text.match_core(C("name")).alias("core"))


def fuzzy_score(spark, sf_dir):
    """Names of directories against the category they were made for."""
    f = table(spark, sf_dir, "files").where("folder IS NOT NULL AND category IS NOT NULL").select(F.regexp_extract("folder", "([^/]*)$", 1).alias("folder"), C("category").alias("id")).distinct()
    rows = f.join(table(spark, sf_dir, "categories").select("id", "name"), "id")
    return rows.select("folder", "id", F.round(text.fuzzy_score(text.match_core(C("folder")), text.match_core(C("name"))), 6).alias("score"))


def redact(spark, sf_dir):
    """Planted keys in documents come out as placeholders."""
    planted = F.concat(F.coalesce("text", F.lit("")), F.lit(" sk-"), F.lpad(C("doc_id").cast("string"), 20, "k"), F.lit(" api_key=abcdefghijkl"), C("doc_id").cast("string"), F.lit(" ?key=Zz9"))
    return table(spark, sf_dir, "documents").select("doc_id", text.redact(planted).alias("text"))


def mojibake_flag(spark, sf_dir):
    f = table(spark, sf_dir, "files")
    return f.select("file_id", text.mojibake_hits(F.coalesce("content_excerpt", F.lit(""))).alias("hits"), text.looks_mojibake(C("content_excerpt")).alias("garbled"), text.looks_mojibake(C("filename"), True).alias("name_garbled"))


def mojibake_repair(spark, sf_dir):
    f = table(spark, sf_dir, "files").where(text.looks_mojibake(C("filename"), True))
    return f.select("file_id", text.repaired_mojibake(C("filename"), True).alias("repaired"))


def excerpt_around(spark, sf_dir):
    f = table(spark, sf_dir, "files").where("content_excerpt IS NOT NULL")
    return f.select("file_id", text.excerpt_around(C("content_excerpt"), "archive").alias("snippet")).where("snippet != ''")


def html_text(spark, sf_dir):
    page = F.concat(F.lit("<html><head><style>b{x}</style></head><body><p>"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p><script>var a=1;</script>&amp; end</body></html>"))
    return table(spark, sf_dir, "documents").select("doc_id", text.html_text(page).alias("text"))


def time_label_range(spark, sf_dir):
    r = dates.label_range(C("time_label"))
    return table(spark, sf_dir, "categories").select("id", r["start"].alias("start_day"), r["end"].alias("end_day"), dates.label_point(C("time_label")).alias("point"))


def time_decay(spark, sf_dir):
    """How near each file is to its own category's period."""
    cats = table(spark, sf_dir, "categories").select(C("id").alias("category"), dates.label_range(C("time_label")).alias("p"), F.coalesce("duration", F.lit("")).alias("duration"))
    rows = entries(spark, sf_dir).join(cats, "category")
    return rows.select("file_id", F.round(dates.decay(C("modified").cast("date"), C("p"), C("duration")), 6).alias("near"))


def chunk_capacity(spark, sf_dir):
    """Rows that models take at once, by the size of the catalogue."""
    models = ["gemini-2.5-flash-002", "gemini-2.5-pro", "gpt-4o-mini", "claude-sonnet-x", "qwen2.5-32b-q4", "own-model", ""]
    rows = spark.createDataFrame([(m, n) for m in models for n in (10, 60, 300)], "model string, n_categories int")
    context = budget.effective_context(C("model"))
    return rows.select("model", "n_categories", context.alias("context"), budget.chunk_size(context, C("n_categories")).alias("rows_at_once"), budget.use_rolling(context, F.lit(1000)).alias("rolling"))


def tier_pick(spark, sf_dir):
    n = table(spark, sf_dir, "files").groupBy("op_id").agg(F.count("*").alias("n"))
    return n.select("op_id", "n", budget.tier(C("n")).alias("tier"))


QUERIES = {f.__name__: f for f in (
    metadata_projection, payload_projection, ignore_scan, safe_path, strip_core, schema_sequence, noun_fallback, excerpt_cap, member_text, category_tokens, name_tokens, opaque_names, lev_similarity, sanitize_name, parse_tag,
    fuzzy_score, redact, mojibake_flag, mojibake_repair, excerpt_around, html_text, time_label_range, time_decay, chunk_capacity, tier_pick,
)}


# --- SQL --------------------------------------------------------------------------------------------------------------


def sql_strip_ext(x):
    return rr(f"coalesce({x}, '')", s.EXTENSION_TAIL)


def sql_core(x):
    head = rr(rr(rr(x, r"^\s+|\s+$"), s.NUMBER_HEAD), s.STUDENT_HEAD)
    return rr(rr(head, "(?i)" + s.CLERICAL_TAIL), r"\s+$")


def sql_schema(x):
    for p, c in text.SCHEMA_RUNS:
        x = rr(x, p, c)
    return f"translate({x}, {lit(text.SCHEMA_LETTERS[0])}, {lit(text.SCHEMA_LETTERS[1])})"


def sql_nouns(x):
    plain = f"list_transform(regexp_extract_all(coalesce({x}, ''), {lit(s.NOUN)}), lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z]') THEN lower(w) ELSE w END)"
    good = f"list_filter({plain}, lambda w: NOT regexp_matches(w, {lit('(?i)' + s.EXTENSION_LIKE)}) AND NOT {in_list('w', s.NOISE_NOUNS)})"
    return good


def sql_distinct(x):
    """Order-preserving; x is the name of a column."""
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"


def sql_mojibake_hits(x):
    return "(" + " + ".join(f"(length({x}) - length(replace({x}, {lit(m)}, ''))) // {len(m)}" for m in s.MOJIBAKE_MARKS) + ")"


def sql_mojibake(x, strict=False):
    h = sql_mojibake_hits(x)
    rule = f"({h} >= 3 OR {h} / greatest(length({x}), 1) >= 0.25)" if strict else f"({h} >= 3 AND {h} >= length({x}) * 0.01)"
    return f"coalesce({rule} AND length({x}) > 0, false)"


def sql_trim(x):
    return f"trim({x}, ' ')"


def sql_sanitize(x):
    c = sql_trim(x)
    for _ in range(3):
        c = sql_trim(rr(rr(rr(c, s.JSON_HEAD), s.JSON_KEY), s.JSON_TAIL))
    c = rr(rr(rr(rr(c, s.INVALID.replace("\x00-\x1f", r"\x00-\x1f").replace("\x7f-\x9f", r"\x{7f}-\x{9f}"), "_"), r"[_\s]{2,}", " "), r"^[ _]+|[ _]+$"), r"[. ]+$")
    c = f"(SELECT CASE WHEN {in_list('upper(c)', s.RESERVED)} THEN '_' || c ELSE c END FROM (SELECT {c} AS c))"
    return f"(SELECT CASE WHEN coalesce({x}, '') = '' OR length({rr('v', r'[^\p{L}\p{N}]')}) < 2 OR {sql_mojibake('v', True)} THEN 'folder' ELSE substring(v, 1, {s.LONGEST_NAME}) END FROM (SELECT {c} AS v))"


def sql_match(x):
    c = sql_trim(rr(sql_trim(rr(rr(sql_trim(x), s.GROUP_HEAD), s.TAG)), s.TIME_TAIL))
    return f"lower({rr(c, r'\s+', ' ')})"


def sql_fuzzy(a, b):
    tok = lambda c: f"list_distinct(list_filter(regexp_extract_all({c}, '[0-9A-Za-z가-힣]+'), lambda t: length(t) >= 2))"
    n = f"len(list_intersect({tok(a)}, {tok(b)}))"
    cover = f"{n} / nullif(least(len({tok(a)}), len({tok(b)})), 0)"
    return f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN {n} > 0 THEN CASE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN greatest({cover}, 0.85) ELSE {cover} END ELSE 0.0 END"


def sql_range(x):
    c = sql_trim(x)
    g = lambda p, i: f"try_cast(regexp_extract({c}, {lit(p)}, {i}) AS INT)"
    m = lambda p: f"regexp_matches({c}, {lit(p)})"
    month = f"least(greatest({g(dates.MONTH, 2)}, 1), 12)"
    start = (
        f"CASE WHEN {m(dates.YEARS)} AND {g(dates.YEARS, 1)} <= {g(dates.YEARS, 2)} THEN make_date({g(dates.YEARS, 1)}, 1, 1) WHEN {m(dates.QUARTER)} THEN make_date({g(dates.QUARTER, 1)}, {g(dates.QUARTER, 2)} * 3 - 2, 1) "
        f"WHEN {m(dates.HALF)} THEN make_date({g(dates.HALF, 1)}, {g(dates.HALF, 2)} * 6 - 5, 1) WHEN {m(dates.MONTH)} THEN make_date({g(dates.MONTH, 1)}, {month}, 1) WHEN {m(dates.YEAR)} THEN make_date({g(dates.YEAR, 1)}, 1, 1) END"
    )
    end = (
        f"CASE WHEN {m(dates.YEARS)} AND {g(dates.YEARS, 1)} <= {g(dates.YEARS, 2)} THEN make_date({g(dates.YEARS, 2)}, 12, 31) WHEN {m(dates.QUARTER)} THEN make_date({g(dates.QUARTER, 1)}, {g(dates.QUARTER, 2)} * 3, 28) "
        f"WHEN {m(dates.HALF)} THEN CASE WHEN {g(dates.HALF, 2)} = 1 THEN make_date({g(dates.HALF, 1)}, 6, 30) ELSE make_date({g(dates.HALF, 1)}, 12, 31) END WHEN {m(dates.MONTH)} THEN make_date({g(dates.MONTH, 1)}, {month}, 28) WHEN {m(dates.YEAR)} THEN make_date({g(dates.YEAR, 1)}, 12, 31) END"
    )
    point = (
        f"CASE WHEN {m(dates.QUARTER)} THEN make_date({g(dates.QUARTER, 1)}, {g(dates.QUARTER, 2)} * 3 - 1, 15) WHEN {m(dates.MONTH)} THEN make_date({g(dates.MONTH, 1)}, {month}, 15) WHEN {m(dates.YEAR)} THEN make_date({g(dates.YEAR, 1)}, 6, 15) END"
    )
    return start, end, point


def sql_decay(day, start, end, duration):
    away = f"CASE WHEN {day} > {end} THEN {day} - {end} ELSE {start} - {day} END"
    return f"CASE WHEN {day} IS NULL OR {start} IS NULL OR {end} IS NULL THEN 0.0 WHEN {day} BETWEEN {start} AND {end} THEN 1.0 ELSE exp(-({away}) / CASE WHEN {duration} IN ('burst', 'short') THEN 90.0 ELSE 365.0 END) END"


def _sql_path(masked):
    bad = sql_mojibake(rr("x", r"^\s*\d\.\s+"), True)
    one = f"CASE WHEN {bad} THEN '[unknown-folder]' ELSE x END"
    if masked:
        one = f"CASE WHEN i < len(string_split(path, '/')) AND x != '' THEN '[folder]' ELSE {one} END"
    return f"array_to_string(list_transform(string_split(path, '/'), lambda x, i: {one}), '/')"


_start, _end, _point = sql_range("time_label")
_name = lit("([^/]*)$")
_glob = r"^\..*$|^~\$.*$|^Thumbs\.db$|^\.DS_Store$|^desktop\.ini$"
_families = sorted((k for k in s.MODEL_CONTEXT if k != "default"), key=len, reverse=True)
_html = "'<html><head><style>b{x}</style></head><body><p>' || replace(coalesce(text, ''), chr(10), '</p><p>') || '</p><script>var a=1;</script>&amp; end</body></html>'"


def _sql_html():
    c = rr(rr(rr(_html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " "), r"(?s)<!--.*?-->", " "), "<[^>]*>", "\n")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = f"replace({c}, {lit(entity)}, {lit(ch)})"
    return sql_trim(rr(rr(c, r"[ \t\r\f]*\n[ \t\r\f\n]*", "\n"), r"^\n+|\n+$"))


def _sql_redact():
    c = "coalesce(text, '') || ' sk-' || lpad(doc_id::VARCHAR, 20, 'k') || ' api_key=abcdefghijkl' || doc_id || ' ?key=Zz9'"
    for p, by in s.SECRETS:
        c = rr(c, p, by)
    return c


def _sql_around(x, needle):
    n, low = len(needle), needle.lower()
    return f"""(SELECT CASE WHEN a > 0 THEN (CASE WHEN b > 1 THEN '…' ELSE '' END) || replace(substring({x}, b, a - b), chr(10), ' ') || '«' || replace(substring({x}, a, {n}), chr(10), ' ') || '»'
      || replace(substring({x}, a + {n}, z - a - {n}), chr(10), ' ') || (CASE WHEN z <= length({x}) THEN '…' ELSE '' END) ELSE '' END
      FROM (SELECT a, greatest(a - 60, 1) AS b, least(a + {n} + 60, length({x}) + 1) AS z FROM (SELECT strpos(lower({x}), {lit(low)}) AS a)))"""


_nt = rf"list_transform(regexp_split_to_array({sql_strip_ext('name')}, {lit(r'[\s_\-\.,()\[\]{}<>]+')}), lambda t: lower(trim(t, ' ')))"
_ct = rf"list_transform(regexp_split_to_array({sql_strip_ext("coalesce(name, '') || ' ' || coalesce(description, '')")}, {lit(r'[\s_\-\.,()\[\]{}<>]+')}), lambda t: lower(trim(t, ' ')))"
_opaque = " OR ".join(f"regexp_matches(st, {lit(p.replace('^(?i)', '(?i)^'))})" for p in s.OPAQUE_FORMS)
_ctx = "CASE " + " ".join(f"WHEN contains(lower(trim(model)), {lit(k)}) THEN {max(s.LEAST_CONTEXT, int(a * b))}" for k, (a, b) in ((k, s.MODEL_CONTEXT[k]) for k in _families)) + " ELSE 4096 END"

ORACLE = {
    "metadata_projection": f"WITH {E} SELECT path, name, ext, strftime(modified, '%Y-%m-%dT%H:%M:%S') AS modified, substring(excerpt, 1, 1800) AS excerpt FROM e",
    "payload_projection": f"WITH {E} SELECT path, name, ext, substring(excerpt, 1, 600) AS excerpt FROM e",
    "ignore_scan": f"WITH {R} SELECT root, path, len(list_filter(string_split(substring(path, length(root) + 1), '/'), lambda x: regexp_matches(x, {lit(_glob)}))) > 0 AS ignored FROM r",
    "safe_path": f"WITH {R} SELECT path, {_sql_path(False)} AS shown, {_sql_path(True)} AS masked FROM r",
    "strip_core": f"WITH {E} SELECT path, {sql_strip_ext('name')} AS stem, {sql_core(sql_strip_ext('name'))} AS core FROM e",
    "schema_sequence": f"WITH {E} SELECT {sql_schema(sql_strip_ext('name'))} AS schema, count(*) AS n FROM e GROUP BY 1",
    "noun_fallback": f"WITH {E}, g AS (SELECT path, {sql_nouns('name')} AS a, {sql_nouns('excerpt')} AS b FROM e) SELECT path, array_to_string({sql_distinct('a')}, ' ') AS nouns, array_to_string(({sql_distinct('b')})[1:8], ' ') AS first FROM g",
    "name_tokens": f"WITH {E} SELECT path, array_to_string(list_sort(list_distinct(list_filter({_nt}, lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^[0-9]+$') AND NOT regexp_matches(t, {lit(r'^(?:v\d+|r\d+|[ivxlcdm]+)$')}) AND NOT {in_list('t', s.NAME_STOPS)}))), ' ') AS tokens FROM e",
    "category_tokens": f"SELECT id, array_to_string(list_sort(list_distinct(list_filter({_ct}, lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^[0-9]+$') AND NOT regexp_matches(t, {lit(r'^(?:v\d+|r\d+|[ivxlcdm]+)$')}) AND NOT {in_list('t', s.NAME_STOPS)}))), ' ') AS tokens FROM categories",
    "excerpt_cap": f"WITH {E} SELECT path, left(excerpt, 1200) AS shown, left(excerpt, 1800) AS whole FROM e",
    "member_text": f"WITH {E} SELECT path, name || chr(10) || left(excerpt, 600) AS text FROM e",
    "opaque_names": f"WITH {E}, g AS (SELECT path, name, ext, trim({sql_strip_ext('name')}, ' ') AS st FROM e) SELECT path, name FROM g WHERE name = '' OR st = '' OR {_opaque} OR ({in_list('ext', ['.' + m for m in s.MEDIA])} AND len(list_filter(regexp_extract_all(st, '[A-Za-z가-힣]{{3,}}'), lambda w: NOT regexp_matches(w, {lit(s.CAMERA_WORD.replace('^(?i)', '(?i)^'))}))) = 0)",
    "lev_similarity": f"WITH {E}, n AS (SELECT ext, {sql_schema(sql_strip_ext('name'))} AS schema, count(*) AS n FROM e GROUP BY 1, 2), t AS (SELECT ext, schema AS top FROM (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY n DESC, schema DESC) AS k FROM n) WHERE k = 1) SELECT ext, schema, n, round(CASE WHEN greatest(length(schema), length(top)) = 0 THEN 1.0 ELSE 1 - levenshtein(schema, top) / greatest(length(schema), length(top)) END, 6) AS \"like\" FROM n JOIN t USING (ext)",
    "sanitize_name": f"SELECT id, {sql_sanitize('name')} AS folder, {sql_sanitize('description')} AS described FROM categories",
    "parse_tag": f"""WITH f AS (SELECT DISTINCT regexp_extract(folder, {_name}, 1) AS name FROM files WHERE folder IS NOT NULL), g AS (SELECT name, regexp_matches(name, {lit(s.TAG)}) AS t, rtrim({rr('name', s.TAG)}, ' ') AS core FROM f)
      SELECT name, CASE WHEN t THEN {sql_trim(rr('rtrim(' + rr('core', s.PERIOD_TAIL) + ", ' ')", r'^\s*\d+[\.\-_)\s]+'))} END AS clean_name, CASE WHEN t THEN {sql_trim(f"regexp_extract(core, {lit(s.PERIOD_TAIL)}, 1)")} END AS period,
      CASE WHEN t THEN regexp_extract(name, {lit(s.TAG)}, 1) END AS signature, regexp_matches(name, {lit(s.GROUP_HEAD)}) AS grouped, {sql_match('name')} AS core FROM g""",
    "fuzzy_score": f"WITH f AS (SELECT DISTINCT regexp_extract(folder, {_name}, 1) AS folder, category AS id FROM files WHERE folder IS NOT NULL AND category IS NOT NULL), g AS (SELECT folder, id, {sql_match('folder')} AS a, {sql_match('name')} AS b FROM f JOIN categories USING (id)) SELECT folder, id, round({sql_fuzzy('a', 'b')}, 6) AS score FROM g",
    "redact": f"SELECT doc_id, {_sql_redact()} AS text FROM documents",
    "mojibake_flag": f"SELECT file_id, ({sql_mojibake_hits("coalesce(content_excerpt, '')")})::INT AS hits, {sql_mojibake('content_excerpt')} AS garbled, {sql_mojibake('filename', True)} AS name_garbled FROM files",
    "excerpt_around": f"SELECT file_id, snippet FROM (SELECT file_id, {_sql_around('content_excerpt', 'archive')} AS snippet FROM files WHERE content_excerpt IS NOT NULL) WHERE snippet != ''",
    "html_text": f"SELECT doc_id, {_sql_html()} AS text FROM documents",
    "time_label_range": f"SELECT id, {_start} AS start_day, {_end} AS end_day, {_point} AS point FROM categories",
    "time_decay": f"WITH {E}, c AS (SELECT id, {_start} AS a, {_end} AS b, coalesce(duration, '') AS duration FROM categories) SELECT file_id, round({sql_decay('modified::DATE', 'a', 'b', 'duration')}, 6) AS near FROM e JOIN c ON e.category = c.id",
    "chunk_capacity": f"""WITH m AS (SELECT * FROM (VALUES ('gemini-2.5-flash-002'), ('gemini-2.5-pro'), ('gpt-4o-mini'), ('claude-sonnet-x'), ('qwen2.5-32b-q4'), ('own-model'), ('')) a(model), (VALUES (10), (60), (300)) b(n_categories)), c AS (SELECT *, {_ctx} AS context FROM m)
      SELECT model, n_categories, context, (CASE WHEN context - 15000 - n_categories * 60 <= 0 THEN 0 ELSE least((context - 15000 - n_categories * 60) // 100, 5000) END)::INT AS rows_at_once, (context - 15600) // 100 >= 40 AS rolling FROM c""",
    "tier_pick": "SELECT op_id, count(*) AS n, CASE WHEN count(*) < 60 THEN 'small' WHEN count(*) < 100 THEN 'medium' ELSE 'large' END AS tier FROM files GROUP BY op_id",
}
