"""Queries on deduplication, caching, families, classification and placement, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import schema as s
from shelfmark.functions import similarity, text
from shelfmark.operators import cache, dedup, families, placement, planner, seeds
from shelfmark.operators.ranks import with_rank
from shelfmark.plans.adapters import D, E, R, documents, entries, in_list, lit, rooted, rr
from shelfmark.plans.text_queries import sql_decay, sql_distinct, sql_mojibake, sql_nouns, sql_range, sql_sanitize, sql_schema, sql_strip_ext, sql_trim
from shelfmark.session import cut, table

C = F.col


# --- deduplication and cache


def dup_groups(spark, sf_dir):
    return dedup.duplicate_groups(documents(spark, sf_dir), 1)


def dup_ledger(spark, sf_dir):
    return dedup.ledger(dup_groups(spark, sf_dir))


def canonical_only(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return dedup.canonical_only(docs, dedup.duplicate_groups(docs, 1)).select("path", "size")


def dup_inherit_category(spark, sf_dir):
    docs = documents(spark, sf_dir)
    groups = dedup.duplicate_groups(docs, 1)
    assigned = docs.select("path", F.regexp_extract("path", "^/([^/]*)/", 1).alias("category_id"))
    return dedup.inherited(groups, assigned)


def _scan(spark, sf_dir):
    """What a new scan would see: every cached path, half of them touched since."""
    old = cache.newest(table(spark, sf_dir, "parser_cache"))
    touched = F.pmod(C("cache_id"), F.lit(2)) == 0
    return old.select("path", (C("mtime") + F.when(touched, 60.0).otherwise(0.0)).alias("mtime"), "size")


def cache_hits(spark, sf_dir):
    return cache.lookup(_scan(spark, sf_dir), table(spark, sf_dir, "parser_cache")).select("path", "hit", "excerpt")


def cache_upsert(spark, sf_dir):
    """Half of the cached paths parsed again, and new ones beside each."""
    seen = _scan(spark, sf_dir).where(F.length("path") % 2 == 0).withColumn("excerpt", F.lit("again"))
    fresh = seen.unionByName(seen.withColumn("path", F.concat("path", F.lit(".new"))))
    return cache.upserted(table(spark, sf_dir, "parser_cache"), fresh)


def cache_evict(spark, sf_dir):
    listed = table(spark, sf_dir, "files").select(C("original_path").alias("path"))
    return cache.evicted(table(spark, sf_dir, "parser_cache"), listed).select("cache_id", "path")


# --- families


def signature_rows(spark, sf_dir):
    return families.family_rows(entries(spark, sf_dir), anonymise=False)


def signature_payload(spark, sf_dir):
    return families.payload(families.family_rows(entries(spark, sf_dir)))


def _family_plan(spark, sf_dir):
    """Families assigned by the extension of their first file, and by ids in their name."""
    e = entries(spark, sf_dir)
    rows = families.family_rows(e)
    assigned = rows.select("fid", F.when(C("ext") == "", s.CATCH_ALL).otherwise(F.substring("ext", 2, 9)).alias("category_id"), F.lit(0.9).alias("score"), F.lit("name family").alias("reason"))
    return e, families.propagated(e, rows, assigned)


def signature_propagate(spark, sf_dir):
    return _family_plan(spark, sf_dir)[1]


# --- classification


def heuristic_plan(spark, sf_dir):
    return planner.rule_plan(entries(spark, sf_dir)).select("path", "category_id", "score", "reason")


def category_histogram(spark, sf_dir):
    return planner.histogram(planner.by_rules(entries(spark, sf_dir)))


def category_top12(spark, sf_dir):
    return planner.histogram(planner.rule_plan(entries(spark, sf_dir))).orderBy(F.desc("n"), "category_id").limit(s.MOST_CATEGORIES + 1)


def _by_ext(spark, sf_dir):
    e = entries(spark, sf_dir).where("category IS NOT NULL")
    return e, e.select("path", C("category").alias("category_id"), "score", "reason")


def _signals(spark, sf_dir):
    """Files with nouns by patterns, where an analyser would give its own."""
    e, assigned = _by_ext(spark, sf_dir)
    sig = similarity.signals(e, text.nouns(text.strip_ext(C("name"))), text.nouns(F.substring("excerpt", 1, 500), 8))
    return sig.select("path", "sig").join(assigned, "path")


def _beside(spark, sf_dir):
    """Files against the category after their own, of those that have files; and the members."""
    from pyspark.sql import Window

    members = cut(_signals(spark, sf_dir))
    used = members.select("category_id").distinct()
    nxt = used.withColumn("to", F.coalesce(F.lead("category_id").over(Window.orderBy("category_id")), F.min("category_id").over(Window.partitionBy())))  # ids of a catalogue
    pairs = members.join(F.broadcast(nxt), "category_id").select("path", C("to").alias("category_id"), "sig")
    return pairs, members.select("category_id", "sig"), table(spark, sf_dir, "categories")


def axes(spark, sf_dir):
    """The seven axes of each file against another category than its own."""
    out = similarity.axes(*_beside(spark, sf_dir), reclassify=False)
    return out.select("path", *[F.round(f"s{i}", 6).alias(f"s{i}") for i in range(1, 8)])


def compatibility(spark, sf_dir):
    """Of each file with another category, the present directory counted and not."""
    out = similarity.axes(*_beside(spark, sf_dir), reclassify=False)
    return out.select("path", F.round(similarity.compatibility(False), 6).alias("kept"), F.round(similarity.compatibility(True), 6).alias("again"))


def pair_compat(spark, sf_dir):
    """Of each file with the next one of its directory."""
    sig = similarity.signals(entries(spark, sf_dir)).select("path", "sig", C("sig.parent").alias("parent"))
    rows = cut(with_rank(sig, ["parent", "path"]))
    after = rows.select((C("rank") - 1).alias("rank"), "parent", C("sig").alias("next"))
    near = rows.join(after, ["rank", "parent"])
    return near.select("path", F.round(similarity.pair_compatibility(C("sig"), C("next"), False), 6).alias("compat"))


def time_rescue(spark, sf_dir):
    e, assigned = _by_ext(spark, sf_dir)
    sigs = cut(similarity.signals(e).select("path", "sig"))
    members = sigs.join(assigned.select("path", "category_id"), "path")
    found = planner.time_rescued(sigs, table(spark, sf_dir, "categories"), members)
    return found.select("path", "category_id", F.round("compat", 6).alias("compat"))


def covered_plan(spark, sf_dir):
    """Every file's assignment when those of a third are lost: by period, else the catch-all."""
    e, assigned = _by_ext(spark, sf_dir)
    given = assigned.join(e.select("path", "file_id"), "path").where("file_id % 3 != 0")
    sigs = cut(similarity.signals(e).select("path", "sig"))
    return planner.covered(given, sigs, table(spark, sf_dir, "categories"))


def small_absorb(spark, sf_dir):
    """Where the few files of small categories go, categories being years, extensions and remainders of names' lengths."""
    e = entries(spark, sf_dir)
    assigned = e.select("path", F.concat(F.year("modified").cast("string"), "ext", (F.length("name") % 5).cast("string")).alias("category_id"), "score", "reason")
    cats = assigned.select(C("category_id").alias("id"), F.left("category_id", F.lit(4)).alias("time_label"), F.lit("annual").alias("duration")).distinct()
    out = planner.absorbed(assigned, e, cats)
    return out.select("small_id", "large_id", F.round("compat", 6).alias("compat"))


def consolidated(spark, sf_dir):
    """Assignments after merging each category into the first of its name's last word."""
    e, assigned = _by_ext(spark, sf_dir)
    cats = table(spark, sf_dir, "categories").select("id", F.element_at(F.split("name", " "), -1).alias("w"))
    first = cats.groupBy("w").agg(F.min("id").alias("keep"))
    merges = cats.join(first, "w").where("id != keep").select(C("id").alias("drop"), "keep")
    return planner.merged(assigned, merges).select("path", "category_id")


def coerced_plan(spark, sf_dir):
    """Assignments against a catalogue of which half the ids are known; paths that are assigned again count as first assigned."""
    cats = table(spark, sf_dir, "categories").where("group_no <= 4").select("id")
    rows = table(spark, sf_dir, "files").where("category IS NOT NULL").select(
        C("original_path").alias("path"), C("file_id").alias("pos"), C("category").alias("category_id"), "score", "reason",
        F.array(*[F.struct(c.alias("category_id"), F.lit(x).alias("score")) for c, x in ((F.lit("misc"), 0.1), (F.lit("nowhere"), 0.2), (F.concat("category", F.lit("")), 0.3))]).alias("secondary"),
    )
    out = planner.coerced(rows, cats)
    return out.select("path", "category_id", "score", F.concat_ws(",", F.transform("secondary", lambda x: x["category_id"])).alias("second"), "reason")


def closest_category(spark, sf_dir):
    """Assignments to a catalogue of half the ids; the rest goes to its first."""
    _, assigned = _by_ext(spark, sf_dir)
    return planner.closest(assigned, table(spark, sf_dir, "categories").where("group_no <= 4")).select("path", "category_id")


def named_categories(spark, sf_dir):
    return planner.named(table(spark, sf_dir, "categories"), text.nouns).select("id")


def category_projection(spark, sf_dir):
    return planner.prompt_rows(table(spark, sf_dir, "categories"))


def shortcut_categories(spark, sf_dir):
    """Categories in use by their shortcuts."""
    f = table(spark, sf_dir, "files").where("folder IS NOT NULL AND category IS NOT NULL")
    own = f.groupBy("folder").agg(F.min("category").alias("category_id"))
    return placement.shortcut_categories(table(spark, sf_dir, "shortcuts"), own)


def suffix_match(spark, sf_dir):
    """Masked paths and bare ends of names, as models give them back, against the files."""
    e = entries(spark, sf_dir)
    given = F.when(F.pmod(C("file_id"), F.lit(3)) == 0, F.concat(F.lit("[folder]/"), "name")).when(F.pmod(C("file_id"), F.lit(3)) == 1, F.substring("name", 4, 300)).otherwise(C("path"))
    return planner.suffix_matched(e.select(given.alias("path")), e)


def clean_categories(spark, sf_dir):
    """Also of ids that come again with another name, duration and group."""
    cats = table(spark, sf_dir, "categories").withColumnRenamed("group_no", "group")
    again = cats.withColumns({"name": F.concat(F.substring("name", 1, 20), F.repeat(F.lit("+"), F.length("id"))), "duration": F.upper("duration"), "group": C("group") + 3})
    return planner.cleaned_categories(cats.unionByName(again))


# --- directories and placement


def seed_catalogue(spark, sf_dir):
    return seeds.seed_categories(seeds.top_folders(rooted(spark, sf_dir)))


def seed_catalogue_tagged(spark, sf_dir):
    return seeds.seed_categories(seeds.top_folders(rooted(spark, sf_dir)), tagged_only=True)


def additive_filter(spark, sf_dir):
    return seeds.loose_files(rooted(spark, sf_dir)).select("root", "path")


def _catalogue(spark, sf_dir):
    return table(spark, sf_dir, "categories").withColumnRenamed("group_no", "group")


def compose_folder(spark, sf_dir):
    """Directory names with a plain tag in place of the hashed one, which SQL can't make."""
    return placement.folders(_catalogue(spark, sf_dir), F.lit("[FA·000000]"))


def folder_tag(spark, sf_dir):
    return placement.folders(_catalogue(spark, sf_dir))


def _placed(spark, sf_dir):
    e, assigned = _by_ext(spark, sf_dir)
    return placement.placements(assigned, placement.folders(_catalogue(spark, sf_dir), F.lit("[FA·000000]")), F.lit("/root"))


def placement_plan(spark, sf_dir):
    return _placed(spark, sf_dir).select("path", "category_id", "new_path")


def collision_numbering(spark, sf_dir):
    """Free names if all files of a kind came into one directory."""
    e = entries(spark, sf_dir).select("path", "name", C("ext").alias("folder"))
    return placement.numbered(e)


def shortcut_plan(spark, sf_dir):
    e, assigned = _by_ext(spark, sf_dir)
    near = F.array(F.struct(F.lit("misc").alias("category_id"), (C("score") - 0.1).alias("score")), F.struct(F.lit("none").alias("category_id"), C("score").alias("score")))
    return placement.shortcuts(_placed(spark, sf_dir), assigned.withColumn("secondary", near), placement.folders(_catalogue(spark, sf_dir), F.lit("[FA·000000]")))


def adopt_leftovers(spark, sf_dir):
    """Of a root's listing what lies in a directory of a category but wasn't placed by the latest run."""
    f = table(spark, sf_dir, "files").where("folder IS NOT NULL AND category IS NOT NULL AND new_path IS NOT NULL")
    own = f.groupBy("folder").agg(F.min("category").alias("category_id"))
    last = f.agg(F.max("op_id")).first()[0]
    return placement.adopted(f.select(C("new_path").alias("path"), "folder").distinct(), f.where(C("op_id") == F.lit(last)).select("new_path"), own)


def median_stamp(spark, sf_dir):
    m = cache.newest(table(spark, sf_dir, "parser_cache")).select("path", "mtime")
    e, assigned = _by_ext(spark, sf_dir)
    out = placement.stamps(assigned.join(m, "path", "left"), _catalogue(spark, sf_dir))
    return out.select("category_id", F.round("stamp", 3).alias("stamp"))


def reuse_folders(spark, sf_dir):
    """In each root the top directories that the catalogue's folders take over."""
    return placement.reused_by_root(placement.folders(_catalogue(spark, sf_dir)), seeds.top_folders(rooted(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (
    dup_groups, dup_ledger, canonical_only, dup_inherit_category, cache_hits, cache_upsert, cache_evict, signature_rows, signature_payload, signature_propagate, heuristic_plan, category_histogram, category_top12,
    axes, compatibility, pair_compat, time_rescue, covered_plan, small_absorb, consolidated, coerced_plan, closest_category, named_categories, category_projection, shortcut_categories, suffix_match, clean_categories, seed_catalogue, seed_catalogue_tagged, additive_filter, compose_folder, folder_tag, placement_plan,
    collision_numbering, shortcut_plan, adopt_leftovers, median_stamp, reuse_folders,
)}


# --- SQL --------------------------------------------------------------------------------------------------------------

_G = f"""{D}, g AS (SELECT path, size, hash, first_value(path) OVER w AS canonical, count(*) OVER (PARTITION BY size, hash) AS n_copies, row_number() OVER w AS place
  FROM (SELECT path, size, modified, sha256(content) AS hash FROM d WHERE size >= 1) WINDOW w AS (PARTITION BY size, hash ORDER BY length(path), modified NULLS FIRST, path)),
  groups AS (SELECT * FROM g WHERE n_copies > 1)"""
_N = "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC NULLS LAST, cache_id DESC) AS k FROM parser_cache) WHERE k = 1)"
_S = _N + ", sc AS (SELECT path, mtime + CASE WHEN cache_id % 2 = 0 THEN 60.0 ELSE 0.0 END AS mtime, size FROM n)"


def _bounded(x, p):
    one = rr(x, rf"(?i)(^|[^A-Za-z0-9])(?:{p})([^A-Za-z0-9]|$)", r"\1 \2")
    return rr(one, rf"(?i)(^|[^A-Za-z0-9])(?:{p})([^A-Za-z0-9]|$)", r"\1 \2")


_head = rr(sql_strip_ext(rr("name", s.DECORATION_HEAD)), s.SHORT_PARENS, " ")
_head = rr(_bounded(_bounded(_head, "|".join(s.DATE_FORMS)), s.VERSION_FORM), "(?i)" + s.SEQUENCE_FORM, " ")
_noise = in_list("w", s.SIGNATURE_NOISE)
_SIG = f"""{E}, s1 AS (SELECT *, {sql_nouns(_head)} AS a, {sql_nouns('substring(excerpt, 1, 80)')} AS b FROM e),
  s2 AS (SELECT * EXCLUDE (a, b), list_filter({sql_distinct('a')}, lambda w: NOT {_noise}) AS a, list_filter(({sql_distinct('b')})[1:8], lambda w: NOT {_noise}) AS b FROM s1),
  s3 AS (SELECT * EXCLUDE (a, b), CASE WHEN len(a) < 2 THEN list_concat(a, b) ELSE a END AS c FROM s2),
  sg AS (SELECT * EXCLUDE (c), array_to_string(({sql_distinct('c')})[1:2], ' ') AS signature FROM s3),
  fr AS (SELECT signature, count(*) AS n, arg_min(name, path) AS name, arg_min(strftime(modified, '%Y-%m-%d'), path) AS modified, arg_min(regexp_extract(path, '([^/]*)/[^/]*$', 1), path) AS parent, arg_min(ext, path) AS ext, min(path) AS first FROM sg GROUP BY signature),
  rw AS (SELECT (row_number() OVER (ORDER BY name, first))::INT AS fid, signature, name, modified, parent, ext, n FROM fr)"""
_words = "name || chr(10) || excerpt"
_kw = " ".join(f"WHEN regexp_matches({_words}, {lit(f'(?i)(?:{p})')}) THEN {lit(c)}" for c, _, p in s.KEYWORDS)
_ex = " ".join(f"WHEN {in_list('ext', ['.' + x for x in xs.split()])} THEN {lit(c)}" for c, (_, xs) in s.EXTENSIONS.items())
_RULES = f"""{E}, k AS (SELECT *, CASE {_kw} END AS kw, CASE {_ex} END AS kx FROM e),
  ru AS (SELECT path, coalesce(kw, kx, 'misc') AS c, CASE WHEN kw IS NOT NULL THEN 0.8 WHEN kx IS NOT NULL THEN 0.6 ELSE 0.4 END::DOUBLE AS score,
    (CASE WHEN kw IS NOT NULL THEN {lit(s.BY_KEYWORD)} WHEN kx IS NOT NULL THEN {lit(s.BY_EXTENSION)} ELSE {lit(s.BY_NOTHING)} END) || ' (' || (CASE WHEN ext = '' THEN 'noext' ELSE ext END) || ')' AS reason FROM k),
  ct AS (SELECT c, count(*) AS n, min(path) AS first FROM ru GROUP BY c),
  kp AS (SELECT *, (SELECT count(*) FROM ct WHERE n >= 2) < 2 OR n >= 2 AS keep FROM ct),
  mg AS (SELECT CASE WHEN keep THEN c ELSE 'misc' END AS t, sum(n) AS n, min(first) AS first FROM kp GROUP BY 1),
  rk AS (SELECT t, row_number() OVER (ORDER BY n DESC, first) AS rank FROM mg),
  pl AS (SELECT path, CASE WHEN rank <= 12 THEN t ELSE 'misc' END AS category_id, score, CASE WHEN keep THEN reason ELSE reason || {lit(s.MERGED_SUFFIX)} END AS reason FROM ru JOIN kp USING (c) JOIN rk ON t = CASE WHEN keep THEN c ELSE 'misc' END)"""
_names = "CASE " + " ".join(f"WHEN category_id = {lit(c)} THEN {lit(n)}" for c, n in planner._names().items()) + " ELSE category_id END"
_A = f"{E}, a AS (SELECT path, category AS category_id, score, reason, modified, name, ext FROM e WHERE category IS NOT NULL)"
_sa, _sb, _ = sql_range("time_label")
_PAR = "regexp_replace({}, '/[^/]*$', '')"
_SIGS = f"sg AS (SELECT *, {_PAR.format('path')} AS parent, {sql_strip_ext('name')} AS stem, {sql_schema(sql_strip_ext('name'))} AS sch, modified::DATE AS day FROM a)"
_LEV = "(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END)"
_EXT = f"CASE WHEN {in_list('x.ext', s.GENERIC_EXTENSIONS)} THEN 0.5 ELSE 1.0 END"
_LCP = "(SELECT coalesce(min(i) - 1, least(length({a}), length({b}))) FROM (SELECT unnest(range(1, least(length({a}), length({b})) + 1)) AS i) WHERE substring({a}, i, 1) != substring({b}, i, 1))"
# prefix length without correlated subqueries
_LCP = "len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: left({a}, i) = left({b}, i)))"


def _weighed(parts, again):
    w = s.Weights().reclassify() if again else s.Weights()
    return "least(1.0, greatest(0.0, " + " + ".join(f"{getattr(w, f's{i + 1}')!r} * {p}" for i, p in enumerate(parts)) + "))"


_grand = _PAR.format("parent")
_AX = f"""{_A.replace("modified, name, ext FROM e", "modified, name, ext, excerpt FROM e")}, {_SIGS}, cats AS (SELECT id AS category_id, {_sa} AS pa, {_sb} AS pb, coalesce(duration, '') AS duration FROM categories),
  n0 AS (SELECT path, category_id, {sql_nouns('stem')} AS a, ({sql_nouns('substring(excerpt, 1, 500)')}) AS b FROM sg), n1 AS (SELECT path, category_id, {sql_distinct('a')} AS nn, ({sql_distinct('b')})[1:8] AS bn FROM n0),
  us AS (SELECT DISTINCT category_id FROM sg), nx AS (SELECT category_id, coalesce(lead(category_id) OVER (ORDER BY category_id), (SELECT min(category_id) FROM us)) AS other FROM us),
  pr AS (SELECT x.*, n1.nn, n1.bn, nx.other FROM sg x JOIN nx USING (category_id) JOIN n1 USING (path)),
  kn AS (SELECT category_id, list_distinct(flatten(list(nn))) AS kn, list_distinct(flatten(list(bn))) AS kb FROM n1 GROUP BY 1),
  sch AS (SELECT DISTINCT category_id AS other, sch FROM sg), stm AS (SELECT DISTINCT category_id AS other, stem FROM sg WHERE stem != ''), exs AS (SELECT DISTINCT category_id AS other, ext FROM sg WHERE ext != ''),
  pas AS (SELECT category_id AS other, list(DISTINCT parent) AS ps FROM sg GROUP BY 1), mn AS (SELECT other, min(length(stem)) AS l FROM stm GROUP BY 1),
  x2 AS (SELECT path, max({_LEV.format(a='x.sch', b='y.sch')}) AS v FROM pr x JOIN sch y USING (other) GROUP BY path),
  x7 AS (SELECT path, max({_LCP.format(a='x.stem', b='y.stem')}) AS v FROM pr x JOIN stm y USING (other) WHERE length(x.stem) >= 2 AND left(x.stem, 2) = left(y.stem, 2) GROUP BY path),
  ax AS (SELECT x.path, coalesce(len(list_intersect(x.nn, kn.kn)) / nullif(len(list_distinct(list_concat(x.nn, kn.kn))), 0), 0.0) AS s1, x2.v AS s2, {sql_decay('x.day', 'pa', 'pb', 'duration')} AS s3,
      CASE WHEN list_contains(pas.ps, x.parent) THEN 1.0 WHEN len(list_filter(pas.ps, lambda p: {_PAR.format('p')} = {_PAR.format('x.parent')} OR {_PAR.format('p')} = x.parent OR p = {_PAR.format('x.parent')})) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS s4,
      coalesce(len(list_intersect(x.bn, kn.kb)) / nullif(len(list_distinct(list_concat(x.bn, kn.kb))), 0), 0.0) AS s5, (CASE WHEN e.ext IS NULL THEN 0.0 ELSE {_EXT} END)::DOUBLE AS s6,
      (CASE WHEN coalesce(x7.v, 0) < 2 THEN 0.0 ELSE least(1.0, x7.v / greatest(1, least(length(x.stem), mn.l))) END)::DOUBLE AS s7
    FROM pr x LEFT JOIN cats ON cats.category_id = x.other JOIN kn ON kn.category_id = x.other JOIN pas ON pas.other = x.other LEFT JOIN mn ON mn.other = x.other LEFT JOIN exs e ON e.other = x.other AND e.ext = x.ext JOIN x2 ON x2.path = x.path LEFT JOIN x7 ON x7.path = x.path)"""
_seven = [f"s{i}" for i in range(1, 8)]
_TOP = f"{R}, tf AS (SELECT DISTINCT root, regexp_extract(substring(path, length(root) + 2), '^([^/]+)/', 1) AS folder FROM r WHERE starts_with(path, root || '/')), tp AS (SELECT * FROM tf WHERE folder != '' AND NOT starts_with(folder, '.') AND NOT starts_with(folder, '__'))"
_plain = sql_trim(rr("folder", r"^\s*\d+[\.\-_)\]\s]+"))
_tagged = f"regexp_matches(folder, {lit(s.TAG)})"
_tcore = f"rtrim({rr('folder', s.TAG)}, ' ')"
_tclean = sql_trim(rr(f"rtrim({rr(_tcore, s.PERIOD_TAIL)}, ' ')", r"^\s*\d+[\.\-_)\s]+"))
_PT = r"[〈(]([^〉)]{1,30})[〉)]\s*$"


def _seeds(only):
    return f"""WITH {_TOP}, q AS (SELECT root, folder, CASE WHEN {_tagged} THEN coalesce(nullif({_tclean}, ''), folder) ELSE {sql_trim(rr(_plain, _PT))} END AS core,
      CASE WHEN {_tagged} THEN {sql_trim(f"regexp_extract({_tcore}, {lit(s.PERIOD_TAIL)}, 1)")} ELSE {sql_trim(f"regexp_extract({_plain}, {lit(_PT)}, 1)")} END AS time_label,
      regexp_extract(folder, {lit(s.TAG)}, 1) AS tag, row_number() OVER (PARTITION BY root ORDER BY folder) AS nth FROM tp {'WHERE ' + _tagged if only else ''}),
    u AS (SELECT *, substring(lower({rr(rr('core', '[^A-Za-z0-9가-힣]+', '-'), '^-+|-+$')}), 1, 40) AS word FROM q)
    SELECT root, (CASE WHEN word = '' THEN 'existing-' || nth ELSE word END) || (CASE WHEN tag != '' THEN '-' || tag ELSE '' END) AS id, coalesce(nullif(core, ''), folder) AS name, '기존 폴더: ' || folder AS description,
      time_label, 'mixed' AS duration, ((nth - 1) % 8 + 1)::INT AS "group", tag FROM u"""


_label = sql_trim("coalesce(time_label, '')")
_shown = "CASE WHEN coalesce(name, '') != '' THEN name ELSE id END"
_period = f"CASE WHEN {_label} = '' THEN '' WHEN lower(trim(coalesce(duration, ''), ' ')) = 'multi-year' OR regexp_matches({_label}, {lit(s.MULTI_YEAR)}) THEN ' 〈' || {_label} || '〉' ELSE ' (' || {_label} || ')' END"
_FO = f"""fo AS (SELECT id AS category_id, trim(substring({sql_sanitize('full_name')}, 1, 120 - 11 - 1) || ' [FA·000000]', ' ') AS folder,
  row_number() OVER (ORDER BY CASE WHEN group_no BETWEEN 1 AND 9 THEN group_no ELSE 9 END, coalesce(nullif(time_label, ''), '~'), coalesce(name, id), id)::INT AS place
  FROM (SELECT *, (CASE WHEN group_no BETWEEN 1 AND 9 THEN group_no ELSE 9 END) || '. ' || ({_shown}) || ({_period}) AS full_name FROM categories))"""


def _numbered(src, directory, name):
    """Names with free numbers: the k-th number from 2 on that no file of the directory has for itself."""
    parts = rf"regexp_extract({name}, '^(.*) \((\d+)\)(\.[^.]*)?$'"
    return f"""nb AS (SELECT *, row_number() OVER (PARTITION BY {directory}, {name} ORDER BY path) AS k, regexp_extract({name}, '^(.*?)(\\.[^.]*)?$', 1) AS st, regexp_extract({name}, '^(.*?)(\\.[^.]*)?$', 2) AS ex FROM {src}),
  tk AS (SELECT {directory} AS dir, {parts}, 1) AS st, {parts}, 3) AS ex, list_sort(list_distinct(list(try_cast({parts}, 2) AS INT)))) AS taken FROM {src} WHERE try_cast({parts}, 2) AS INT) >= 2 GROUP BY 1, 2, 3),
  nw AS (SELECT nb.*, CASE WHEN k = 1 THEN {name} ELSE nb.st || ' (' || list_reduce(list_prepend(k, list_transform(coalesce(taken, []), lambda t: t::BIGINT)), lambda a, b: CASE WHEN b <= a THEN a + 1 ELSE a END) || ')' || nb.ex END AS new_name FROM nb LEFT JOIN tk ON tk.dir = nb.{directory} AND tk.st = nb.st AND tk.ex = nb.ex)"""


_PLACED = f"{_A}, {_FO}, pr AS (SELECT a.path, category_id, regexp_extract(a.path, '([^/]*)$', 1) AS name, folder, score, reason FROM a JOIN fo USING (category_id)), {_numbered('pr', 'folder', 'name')}"
_H = "(CASE WHEN lower(trim(coalesce(duration, ''), ' ')) = 'multiyear' THEN 'multi-year' WHEN lower(trim(coalesce(duration, ''), ' ')) IN ('burst', 'short', 'annual', 'multi-year', 'mixed', '') THEN lower(trim(coalesce(duration, ''), ' ')) ELSE '' END)"



def _near(base, pairs):
    """Compatibility, without the present directory, of rows x of ``pairs`` (path, sch, stem, ext, s3) with the members of category_id."""
    return f"""{base},
  sch AS (SELECT DISTINCT category_id, sch FROM sg), stm AS (SELECT DISTINCT category_id, stem FROM sg WHERE stem != ''), exs AS (SELECT DISTINCT category_id, ext FROM sg WHERE ext != ''),
  mn AS (SELECT category_id, min(length(stem)) AS l FROM stm GROUP BY category_id),
  pr AS ({pairs}),
  p2 AS (SELECT path, category_id, max({_LEV.format(a='x.sch', b='y.sch')}) AS v FROM pr x JOIN sch y USING (category_id) GROUP BY 1, 2),
  p7 AS (SELECT path, category_id, max({_LCP.format(a='x.stem', b='y.stem')}) AS v FROM pr x JOIN stm y USING (category_id) WHERE length(x.stem) >= 2 AND left(x.stem, 2) = left(y.stem, 2) GROUP BY 1, 2),
  cp AS (SELECT x.*, {_weighed(['0.0', 'p2.v', 'x.s3', '0.0', '0.0', f"(CASE WHEN e.ext IS NULL THEN 0.0 ELSE {_EXT} END)", "(CASE WHEN coalesce(p7.v, 0) < 2 THEN 0.0 ELSE least(1.0, p7.v / greatest(1, least(length(x.stem), mn.l))) END)"], True)} AS compat
    FROM pr x JOIN p2 USING (path, category_id) LEFT JOIN p7 USING (path, category_id) LEFT JOIN mn USING (category_id) LEFT JOIN exs e ON e.category_id = x.category_id AND e.ext = x.ext)"""


_COVER = _near(
    f"{_A.replace('modified, name, ext FROM e', 'modified, name, ext, file_id FROM e')}, {_SIGS.replace('sg AS', 'sga AS')}, sg AS (SELECT * FROM sga WHERE file_id % 3 != 0 AND category_id != 'misc'), cats AS (SELECT id AS category_id, {_sa} AS pa, {_sb} AS pb FROM categories WHERE id != 'misc'), op AS (SELECT * FROM sga WHERE file_id % 3 = 0 OR category_id = 'misc')",
    "SELECT x.path, x.sch, x.stem, x.ext, 1.0 AS s3, c.category_id, c.pb - c.pa AS span FROM op x JOIN cats c ON x.day BETWEEN c.pa AND c.pb WHERE c.category_id IN (SELECT category_id FROM sg)",
)
_RESCUE = _near(f"{_A}, {_SIGS}, cats AS (SELECT id AS category_id, {_sa} AS pa, {_sb} AS pb FROM categories WHERE id != 'misc')", "SELECT x.path, x.sch, x.stem, x.ext, 1.0 AS s3, c.category_id, c.pb - c.pa AS span FROM sg x JOIN cats c ON x.day BETWEEN c.pa AND c.pb WHERE c.category_id IN (SELECT category_id FROM sg)")
_ABSORB = _near(
    f"{E}, a AS (SELECT path, year(modified) || ext || (length(name) % 5) AS category_id, modified, name, ext FROM e), {_SIGS}, n AS (SELECT category_id, count(*) AS n FROM sg GROUP BY 1)",
    "SELECT x.path, x.sch, x.stem, x.ext, x.category_id AS small_id, n.category_id, CASE WHEN year(x.day) = left(n.category_id, 4)::INT THEN 1.0 ELSE exp(-(CASE WHEN year(x.day) > left(n.category_id, 4)::INT THEN x.day - make_date(left(n.category_id, 4)::INT, 12, 31) ELSE make_date(left(n.category_id, 4)::INT, 1, 1) - x.day END) / 365.0) END AS s3 FROM sg x, n WHERE n.n >= 3 AND x.category_id IN (SELECT category_id FROM n WHERE n < 3)",
)

ORACLE = {
    "dup_groups": f"WITH {_G} SELECT * FROM groups",
    "dup_ledger": f"WITH {_G} SELECT path AS deleted_path, canonical AS canonical_path, size AS bytes_freed FROM groups WHERE place > 1",
    "canonical_only": f"WITH {_G} SELECT path, size FROM d WHERE path NOT IN (SELECT path FROM groups WHERE place > 1)",
    "dup_inherit_category": f"WITH {_G} SELECT path, regexp_extract(canonical, '^/([^/]*)/', 1) AS category_id, 1.0::DOUBLE AS score, '중복 — 정본: ' || regexp_extract(canonical, '([^/]*)$', 1) AS reason FROM groups WHERE place > 1",
    "cache_hits": f"WITH {_S} SELECT sc.path, abs(sc.mtime - n.mtime) < 0.001 AND sc.size = n.size AS hit, CASE WHEN abs(sc.mtime - n.mtime) < 0.001 AND sc.size = n.size THEN coalesce(n.excerpt, '') END AS excerpt FROM sc JOIN n USING (path)",
    "cache_upsert": f"WITH {_S}, sn AS (SELECT path, mtime, size FROM sc WHERE length(path) % 2 = 0) SELECT path, mtime, size, excerpt FROM n WHERE length(path) % 2 != 0 UNION ALL SELECT path, mtime, size, 'again' FROM sn UNION ALL SELECT path || '.new', mtime, size, 'again' FROM sn",
    "cache_evict": "SELECT cache_id, path FROM parser_cache WHERE path NOT IN (SELECT original_path FROM files)",
    "signature_rows": f"WITH {_SIG} SELECT * FROM rw",
    "signature_propagate": f"WITH {_SIG} SELECT sg.path, CASE WHEN rw.ext = '' THEN 'misc' ELSE substring(rw.ext, 2, 9) END AS category_id, 0.9::DOUBLE AS score, 'name family' AS reason FROM sg JOIN rw USING (signature)",
    "heuristic_plan": f"WITH {_RULES} SELECT * FROM pl",
    "category_histogram": f"WITH {_RULES} SELECT c AS category_id, {_names.replace('category_id', 'c')} AS category_name, count(*) AS n FROM ru GROUP BY c",
    "category_top12": f"WITH {_RULES} SELECT category_id, {_names} AS category_name, count(*) AS n FROM pl GROUP BY category_id ORDER BY n DESC, category_id LIMIT 13",
    "axes": f"WITH {_AX} SELECT path, {', '.join(f'round({x}, 6) AS {x}' for x in _seven)} FROM ax",
    "compatibility": f"WITH {_AX} SELECT path, round({_weighed(_seven, False)}, 6) AS kept, round({_weighed([*_seven[:3], '0.0', *_seven[4:]], True)}, 6) AS again FROM ax",
    "pair_compat": f"""WITH {E}, a AS (SELECT path, modified, name, ext FROM e), {_SIGS}, pp AS (SELECT x.*, lead(path) OVER w AS np, lead(stem) OVER w AS nstem, lead(sch) OVER w AS nsch, lead(ext) OVER w AS next_ext, lead(day) OVER w AS nday FROM sg x WINDOW w AS (PARTITION BY parent ORDER BY path)),
      q AS (SELECT x.*, {_LEV.format(a='x.sch', b='x.nsch')} AS p2, coalesce(exp(-abs(x.day - x.nday) / 365.0), 0.0) AS p3, CASE WHEN x.ext != '' AND x.ext = x.next_ext THEN {_EXT} ELSE 0.0 END AS p6, {_LCP.format(a='x.stem', b='x.nstem')} AS l FROM pp x WHERE np IS NOT NULL)
      SELECT path, round({_weighed(['0.0', 'p2', 'p3', '1.0', '0.0', 'p6', "(CASE WHEN stem = '' OR nstem = '' OR l < 2 THEN 0.0 ELSE least(1.0, l / greatest(1, least(length(stem), length(nstem)))) END)"], False)}, 6) AS compat FROM q""",
    "time_rescue": f"WITH {_RESCUE} SELECT path, category_id, round(compat, 6) AS compat FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(compat, 6) DESC, span, category_id) AS k FROM cp WHERE compat >= 0.12) WHERE k = 1",
    "covered_plan": f"WITH {_COVER}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(compat, 6) DESC, span, category_id) AS k FROM cp WHERE compat >= 0.12) WHERE k = 1) SELECT a.path, coalesce(b.category_id, CASE WHEN a.file_id % 3 = 0 THEN 'misc' ELSE a.category_id END) AS category_id, CASE WHEN b.category_id IS NOT NULL THEN greatest(coalesce(CASE WHEN a.file_id % 3 != 0 THEN a.score END, 0.0), 0.45) WHEN a.file_id % 3 = 0 THEN 0.3 ELSE a.score END AS score, CASE WHEN b.category_id IS NOT NULL THEN {lit(s.RESCUE_REASON)} WHEN a.file_id % 3 = 0 THEN {lit(s.LOST_REASON)} ELSE a.reason END AS reason FROM sga a LEFT JOIN b ON b.path = a.path",
    "small_absorb": f"WITH {_ABSORB}, m AS (SELECT small_id, category_id, avg(compat) AS m FROM cp GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY small_id ORDER BY round(m, 6) DESC, category_id) AS k FROM m) SELECT n.category_id AS small_id, CASE WHEN b.m >= 0.2 THEN b.category_id ELSE 'misc' END AS large_id, round(coalesce(b.m, 0.0), 6) AS compat FROM n LEFT JOIN b ON b.small_id = n.category_id AND k = 1 WHERE n.n < 3",
    "consolidated": f"WITH {_A}, w AS (SELECT id, string_split(name, ' ')[-1] AS w FROM categories), f AS (SELECT w, min(id) AS keep FROM w GROUP BY w) SELECT path, coalesce(keep, category_id) AS category_id FROM a LEFT JOIN (SELECT id, keep FROM w JOIN f USING (w) WHERE id != keep) ON id = category_id",
    "coerced_plan": "WITH k AS (SELECT id FROM categories WHERE group_no <= 4), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY original_path ORDER BY file_id) AS r FROM files WHERE category IS NOT NULL) WHERE r = 1), c AS (SELECT *, CASE WHEN category IN (SELECT id FROM k) THEN category ELSE 'misc' END AS cid FROM o) SELECT original_path AS path, cid AS category_id, score, CASE WHEN 'misc' IN (SELECT id FROM k) AND cid != 'misc' THEN 'misc' ELSE '' END AS second, left(coalesce(reason, ''), 140) AS reason FROM c",
    "closest_category": f"WITH {_A}, k AS (SELECT id FROM categories WHERE group_no <= 4) SELECT path, CASE WHEN category_id IN (SELECT id FROM k) THEN category_id ELSE (SELECT min(id) FROM k) END AS category_id FROM a",
    "named_categories": f"SELECT id FROM categories WHERE len({sql_nouns('name')}) > 0",
    "category_projection": "SELECT id, name, coalesce(description, '') AS description FROM categories",
    "shortcut_categories": "WITH o AS (SELECT folder, min(category) AS category_id FROM files WHERE folder IS NOT NULL AND category IS NOT NULL GROUP BY folder) SELECT shortcut_path, category_id FROM shortcuts JOIN o ON folder = regexp_replace(shortcut_path, '/[^/]*$', '')",
    "signature_payload": f"WITH {_SIG} SELECT fid, '{{\"i\":' || fid || ',\"n\":' || to_json(name) || ',\"m\":' || to_json(coalesce(modified, '')) || ',\"p\":\"[folder]\"' || CASE WHEN ext != '' THEN ',\"x\":' || to_json(ext) ELSE '' END || CASE WHEN n > 1 THEN ',\"c\":' || n ELSE '' END || '}}' AS json FROM rw",
    "suffix_match": f"WITH {E}, g AS (SELECT DISTINCT CASE file_id % 3 WHEN 0 THEN '[folder]/' || name WHEN 1 THEN substring(name, 4, 300) ELSE path END AS a FROM e) SELECT a AS assigned_path, min(path) AS path FROM g JOIN e ON (ends_with(path, a) OR ends_with(a, name)) WHERE a != '' AND name != '' AND a NOT IN (SELECT path FROM e) GROUP BY a",
    "clean_categories": f"""WITH c AS (SELECT id, name, description, time_label, duration, group_no FROM categories UNION ALL SELECT id, substring(name, 1, 20) || repeat('+', length(id)), description, time_label, upper(duration), group_no + 3 FROM categories),
      g AS (SELECT id, trim(name, ' ') AS name, coalesce(description, '') AS description, coalesce(time_label, '') AS time_label, {_H} AS duration, (CASE WHEN group_no BETWEEN 1 AND 9 THEN group_no ELSE 9 END)::INT AS "group" FROM c
      WHERE NOT regexp_matches(name, '[�﻿]') AND NOT {sql_mojibake('name', True)} AND trim(name, ' ') != '' AND NOT (id = 'misc' OR regexp_matches(name, '기타|그 외|분류되지 않은|프로젝트 외')))
      SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(name) DESC, name DESC, description DESC, time_label DESC, duration DESC, "group" DESC) AS k FROM g) WHERE k = 1
      UNION ALL SELECT 'misc', '기타', '', '', '', 9""",
    "seed_catalogue": _seeds(False),
    "seed_catalogue_tagged": _seeds(True),
    "additive_filter": f"WITH {R} SELECT root, path FROM r WHERE NOT regexp_matches(regexp_extract(substring(path, length(root) + 2), '^([^/]+)/', 1), {lit(s.TAG)})",
    "compose_folder": f"WITH {_FO} SELECT * FROM fo",
    "placement_plan": f"WITH {_PLACED} SELECT path, category_id, '/root/' || folder || '/' || new_name AS new_path FROM nw",
    "collision_numbering": f"WITH {E}, c AS (SELECT path, name, ext AS folder FROM e), {_numbered('c', 'folder', 'name')} SELECT path, name, folder, new_name FROM nw",
    "shortcut_plan": f"WITH {_PLACED} SELECT path, 'misc' AS category_id, (SELECT folder FROM fo WHERE category_id = 'misc') || '/' || new_name AS shortcut FROM nw WHERE category_id != 'misc' AND score - (score - 0.1) <= 0.15 AND 'misc' IN (SELECT category_id FROM fo)",
    "adopt_leftovers": f"WITH f AS (SELECT * FROM files WHERE folder IS NOT NULL AND category IS NOT NULL AND new_path IS NOT NULL), o AS (SELECT folder, min(category) AS category_id FROM f GROUP BY folder) SELECT DISTINCT new_path AS path, category_id, 1.0::DOUBLE AS score, {lit(s.ADOPTED_REASON)} AS reason FROM f JOIN o USING (folder) WHERE new_path NOT IN (SELECT new_path FROM f WHERE op_id = (SELECT max(op_id) FROM f))",
    "median_stamp": f"WITH {_A}, {_N}, m AS (SELECT category_id, median(mtime) AS m FROM a JOIN n USING (path) GROUP BY category_id) SELECT id AS category_id, round(coalesce(m, epoch({sql_range('time_label')[2]}::TIMESTAMP)), 3) AS stamp FROM categories LEFT JOIN m ON m.category_id = id",
}
