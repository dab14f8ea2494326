import datetime as dt
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import cache, components, dedup, families, index, placement, planner, report, vectors
from shelfmark import schema as s
from shelfmark import session
from shelfmark.plans import assign
from shelfmark.plans.assign import microbatch, rolling
from shelfmark.schema import Settings

T = dt.datetime(2024, 3, 5)
ENTRY = "path string, name string, ext string, excerpt string, modified timestamp"


def entries(spark, names, excerpt=""):
    return spark.createDataFrame([(f"/d/{i:03}/{n}", n, ("." + n.rsplit(".", 1)[1]) if "." in n else "", excerpt, T) for i, n in enumerate(names)], ENTRY)


def test_duplicates(spark):
    rows = [("/long/a", 3, T, "abc"), ("/b", 3, T, "abc"), ("/c", 3, T, "abd"), ("/e", 0, T, ""), ("/f", None, T, "abc"), ("/g", 3, T, None), ("/h", 2, T, "ab")]
    d = spark.createDataFrame(rows, "path string, size long, modified timestamp, content string")
    g = {r["path"]: (r["canonical"], r["n_copies"], r["place"]) for r in dedup.duplicate_groups(d, 1).collect()}
    assert g == {"/b": ("/b", 2, 1), "/long/a": ("/b", 2, 2)}
    assert dedup.duplicate_groups(d, -1).count() == 0 and dedup.duplicate_groups(d).count() == 0 and dedup.duplicate_groups(d.limit(0), 1).count() == 0
    assert [tuple(r) for r in dedup.ledger(dedup.duplicate_groups(d, 1)).collect()] == [("/long/a", "/b", 3)]


def test_cache(spark):
    c = spark.createDataFrame([(1, "a", 1.0, 5, "x", T), (2, "a", 2.0, 5, "y", T + dt.timedelta(1)), (3, "b", 1.0, 5, None, None)], "cache_id long, path string, mtime double, size long, excerpt string, updated_at timestamp")
    scan = spark.createDataFrame([("a", 2.0005, 5), ("b", 1.0, 5), ("c", 1.0, 1), ("a2", None, None)], "path string, mtime double, size long")
    assert {r["path"]: (r["hit"], r["excerpt"]) for r in cache.lookup(scan, c).collect()} == {"a": (True, "y"), "b": (True, ""), "c": (False, None), "a2": (False, None)}
    assert {r["path"] for r in cache.evicted(c, scan).collect()} == set()


def test_families_and_propagation(spark):
    e = entries(spark, [f"강의평가_{i}.pdf" for i in range(50)] + ["budget plan.xlsx"])
    rows = families.family_rows(e)
    assert sorted(r["n"] for r in rows.collect()) == [1, 50]
    out, catalogue = rolling(e, lambda p: {"new_categories": [{"id": "x"}], "assignments": [{"i": f["i"], "c": "x", "p": 0.9, "r": "r"} for f in p["files"]]}, 1 << 20)
    assert out.count() == 51 and [c["id"] for c in catalogue] == ["x"]

    def fails(p):
        if len(p["files"]) > 1:
            raise ValueError("too long")
        return {"assignments": [{"i": p["files"][0]["i"], "c": "nowhere"}]}

    out, _ = microbatch(e, fails)
    assert {r["category_id"] for r in out.collect()} == {"misc"}


def test_rule_plan(spark):
    names = ["invoice 1.pdf", "invoice 2.pdf", "a.png", "b.png", "c.xyz", "d"]
    got = {r["name"]: r["category_id"] for r in planner.rule_plan(entries(spark, names)).collect()}
    assert got == {"invoice 1.pdf": "receipts", "invoice 2.pdf": "receipts", "a.png": "images", "b.png": "images", "c.xyz": "misc", "d": "misc"}
    assert {r["category_id"] for r in planner.rule_plan(entries(spark, ["a.png", "x.zip"])).collect()} == {"images", "archives"}  # too few to merge
    assert planner.rule_plan(entries(spark, ["a.png"]).limit(0)).count() == 0


def test_absorption_and_rescue(spark):
    e = entries(spark, [f"강의평가_{i}.hwp" for i in range(9)] + ["강의평가_x.hwp", "zzz.exe"])
    cat = F.when(F.col("name") == "강의평가_x.hwp", "tiny").when(F.col("name") == "zzz.exe", "odd").otherwise("big")
    assigned = e.select("path", cat.alias("category_id"), F.lit(0.9).alias("score"), F.lit("").alias("reason"))
    cats = spark.createDataFrame([(c, "", "") for c in ("tiny", "odd", "big")], "id string, time_label string, duration string")
    to = {r["small_id"]: r["large_id"] for r in planner.absorbed(assigned, e, cats).collect()}
    assert to == {"tiny": "big", "odd": "misc"}
    moved = planner.apply_absorption(assigned, planner.absorbed(assigned, e, cats))
    assert {r["category_id"] for r in moved.collect()} == {"big", "misc"}
    cats = spark.createDataFrame([("wide", "2024", ""), ("narrow", "2024-03", "burst"), ("other", "2020", "")], "id string, time_label string, duration string")
    low = Settings(rescue_least=0.01)
    assert {r["category_id"] for r in planner.time_rescued(e, cats, settings=low).collect()} == {"narrow"}
    assert planner.time_rescued(e, cats, settings=low, need_nouns=True).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_free_names(spark, seed):
    rnd = random.Random(seed)
    names = [rnd.choice(["a.txt", "a (2).txt", "a (3).txt", "b", "b (2)"]) for _ in range(12)]
    rows = spark.createDataFrame([(f"{i:02}", "d", n) for i, n in enumerate(names)], "path string, folder string, name string")
    new = [r["new_name"] for r in placement.numbered(rows).collect()]
    assert set(names) <= set(new) and len(new) == len(names)  # each name is kept by its first file


def test_tags_and_reuse(spark):
    c = spark.createDataFrame([("avoca", "AVOCA 시스템", "2024-Q3", "short", 2), ("m", "기타", "", "mixed", 99), (None, None, None, None, None)], "id string, name string, time_label string, duration string, `group` int").where("id IS NOT NULL")
    f = {r["category_id"]: r["folder"] for r in placement.folders(c).collect()}
    import hashlib

    assert f["avoca"] == f"2. AVOCA 시스템 (2024-Q3) [FA·{hashlib.blake2b(b'avoca', digest_size=4).hexdigest()[:6]}]" and f["m"].startswith("9. 기타 [FA·")
    assert placement.reused(placement.folders(c), ["AVOCA", "etc"]) == {"avoca": "AVOCA"}


def test_reuse_in_every_root(spark):
    c = spark.createDataFrame([("avoca", "AVOCA 시스템", "", "short", 2), ("ф", "Отчёт", "", "", 3)], "id string, name string, time_label string, duration string, `group` int")
    dirs = [(f"/r{i:04}", d) for i in range(900) for d in ("a b c", "AVOCA", "avoca 시스템", "3. Отчёт")]  # the last root is far beyond 2,000 directories
    got = placement.reused_by_root(placement.folders(c), spark.createDataFrame(dirs, "root string, folder string")).collect()
    assert {(r["root"], r["category_id"], r["dir"]) for r in got} == {(f"/r{i:04}", c, d) for i in range(900) for c, d in (("avoca", "AVOCA"), ("ф", "3. Отчёт"))} and len(got) == 1800


def test_reuse_query_reads_every_root(spark, tmp_path):
    from shelfmark.plans.plan_queries import reuse_folders

    spark.createDataFrame([("avoca", "AVOCA", "", "short", 2)], "id string, name string, time_label string, duration string, `group` int").write.parquet(f"{tmp_path}/categories.parquet")
    spark.createDataFrame([(1, f"/r/dir{i:04}/f") for i in range(2100)] + [(2, "/z/AVOCA/f")], "op_id long, new_path string").write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame([(1, "/r"), (2, "/z")], "op_id long, target_root string").write.parquet(f"{tmp_path}/operations.parquet")
    assert [(r["root"], r["category_id"], r["dir"]) for r in reuse_folders(spark, str(tmp_path)).collect()] == [("/z", "avoca", "AVOCA")]


def test_bm25_against_sqlite(spark):
    rnd = random.Random(4)
    words = "alpha beta gamma alphabet delta budget budgets été naïve list reading".split()
    rows = [(i, *[" ".join(rnd.choices(words, k=rnd.randrange(0, 9))) for _ in index.INDEXED]) for i in range(1, 60)]
    files = spark.createDataFrame(rows, "file_id long, " + ", ".join(f"{c} string" for c in index.INDEXED))
    con = sqlite3.connect(":memory:")
    try:
        con.execute(f"CREATE VIRTUAL TABLE t USING fts5({', '.join(index.INDEXED)}, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index in this sqlite")
    con.executemany(f"INSERT INTO t(rowid, {', '.join(index.INDEXED)}) VALUES ({', '.join('?' * 8)})", rows)
    post, length = index.postings(files).cache(), index.lengths(files).cache()
    for query, match in (("alpha", '"alpha"*'), ("alpha budget", '"alpha"* OR "budget"*'), ("reading_list", '"reading_list"*'), ("ete", '"ete"*')):
        want = {r[0]: r[1] for r in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
        got = {r["file_id"]: r["score"] for r in index.bm25(post, length, query, None).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert index.bm25(post, length, "  ", None).count() == 0 and index.like(files, "", None, None).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cosine_pairs(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(120, 5)).astype("float32")
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None)], "vec_id long, embedding array<float>")
    n = np.linalg.norm(v, axis=1)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if n[i] and n[j] and float(v[i].astype(float) @ v[j].astype(float)) / (n[i] * n[j]) >= 0.8}
    for block in (4096, 50):
        assert {(r["a"], r["b"]) for r in vectors.cosine_pairs(df, 0.8, block=block).collect()} == want


def test_report(spark):
    f = spark.createDataFrame([(1, 1, "/a", "/n/a", "c", 0.5, "r"), (2, 1, "/b", None, None, None, None)], "file_id long, op_id long, original_path string, new_path string, category string, score double, reason string")
    sc = spark.createDataFrame([(1, 1, 1, "/s")], "shortcut_id long, op_id long, file_id long, shortcut_path string")
    out = report.markdown(f, sc, None, 1)
    assert "## Categories" in out and "/n/a" in out and "/s" in out


def fake(log):
    """A model that makes a category of each first word, and knows all tasks."""

    def answer(p):
        log.append((p.get("task", "rolling"), len(p.get("files", p.get("categories", [])))))
        word = lambda f: f["n"].split("_")[0].split(".")[0]
        if p.get("task") == "merge":
            return {"categories": [c for c in p["categories"] if c["id"] != "odd"]}
        if p.get("task") == "consolidate":
            return {"merges": [{"drop": "budget", "keep": "report"}, {"drop": "nowhere", "keep": "report"}, {"drop": "report", "keep": "report"}]}
        cats = [{"id": w} for w in sorted({word(f) for f in p["files"]})]
        given = [{"i": f["i"], "c": word(f), "p": 0.9, "r": "word"} for f in p["files"]]
        return {"categories": cats, "new_categories": cats, "assignments": given}

    return answer


NAMES = [f"{w}_{x}.pdf" for w in ("report", "budget", "minutes", "odd") for x in ("alpha", "beta", "gamma", "delta", "zeta", "kappa", "sigma", "omega")]


@pytest.mark.parametrize("way, tasks", [("microbatch", ["discover", "merge", "assign"]), ("two_stage", ["discover", "assign"]), ("single_call", ["plan"])])
def test_ways_of_planning(spark, way, tasks):
    log = []
    e = entries(spark, NAMES)
    out, catalogue = getattr(assign, way)(e, fake(log))
    got = {r["path"]: r["category_id"] for r in out.collect()}
    assert len(got) == len(NAMES) and list(dict.fromkeys(t for t, _ in log)) == tasks
    for path, c in got.items():
        word = path.rsplit("/", 1)[1].split("_")[0]
        assert c == ("misc" if word == "odd" and "merge" in tasks else word)


def test_planning_that_fails(spark):
    e = entries(spark, NAMES)

    def picky(p):  # no more than two files at once, never those of 'budget'
        if len(p.get("files", [])) > 2 or any("budget" in f["n"] for f in p.get("files", [])):
            raise RuntimeError("too much")
        return fake([])(p)

    got = {r["path"]: (r["category_id"], r["reason"]) for r in assign.microbatch(e, picky)[0].collect()}
    assert len(got) == len(NAMES) and all(c in ("report", "minutes", "misc") for p, (c, _) in got.items() if "budget" not in p)
    assert all(c == "documents" and "(.pdf)" in r for p, (c, r) in got.items() if "budget" in p)  # by the rules

    def dead(p):
        raise ValueError("no answer")

    for mode in ("auto", "on"):
        out, catalogue = assign.plan(e, dead, mode=mode)
        assert catalogue == [] and out.count() == len(NAMES)


def test_dispatch_of_plans(spark):
    e = entries(spark, NAMES)
    for context, mode, economy, first in ((1 << 20, "auto", False, "discover"), (8_192, "on", False, "discover"), (8_192, "off", True, "plan"), (8_192, "off", False, "discover")):
        log = []
        assign.plan(e, fake(log), context, mode, economy)
        assert log[0][0] == first
    log = []
    assign.plan(entries(spark, NAMES + [f"more_{a}{b}.pdf" for a in "abcdefgh" for b in "xyz"]), fake(log), 1 << 20)
    assert log[0][0] == "rolling"


def test_consolidation(spark):
    out, catalogue = assign.two_stage(entries(spark, NAMES), fake([]))
    out, left = assign.consolidate(out, catalogue, fake([]))
    assert "budget" not in {c["id"] for c in left} and {r["category_id"] for r in out.where("path LIKE '%budget%'").collect()} == {"report"}
    assert assign.consolidate(out, left[:1], fake([]))[1] == left[:1]


def test_covered(spark):
    names = ["Plan_a.txt", "Plan_b.txt", "Plan_c.txt", "lost_1.bin", "kept.txt"]
    e = entries(spark, names)
    far = e.withColumn("modified", F.when(F.col("name") == "lost_1.bin", F.lit(dt.datetime(1999, 1, 1))).otherwise(F.col("modified")))
    given = e.where("name IN ('Plan_a.txt', 'Plan_b.txt', 'kept.txt')").select("path", F.when(F.col("name") == "kept.txt", "misc").otherwise("p").alias("category_id"), F.lit(0.8).alias("score"), F.lit("told").alias("reason"))
    cats = spark.createDataFrame([("p", "2024", "annual"), ("misc", None, None)], "id string, time_label string, duration string")
    got = {r["path"].rsplit("/", 1)[1]: (r["category_id"], r["score"], r["reason"]) for r in planner.covered(given, far, cats).collect()}
    assert got["Plan_a.txt"] == ("p", 0.8, "told") and got["Plan_c.txt"] == ("p", 0.45, s.RESCUE_REASON)
    assert got["lost_1.bin"] == ("misc", 0.3, s.LOST_REASON) and got["kept.txt"][0] in ("p", "misc") and got["kept.txt"][1] == 0.8
    assert planner.covered(given.limit(0), far, cats).count() == 5 and planner.covered(given, far.limit(0), cats).count() == 0


def test_numbers_that_are_taken(spark):
    # every second number is some file's own name
    names = ["a.txt"] * 30 + [f"a ({i}).txt" for i in range(2, 40, 2)] + ["b.txt", "b (2).txt"]
    rows = spark.createDataFrame([(f"/{i:03}", n, "f") for i, n in enumerate(names)], "path string, name string, folder string")
    got = [r["new_name"] for r in placement.numbered(rows).collect()]
    assert len(set(got)) == len(names) and {f"a ({i}).txt" for i in range(2, 41)} <= set(got)
    assert placement.numbered(rows.limit(0)).count() == 0


def test_migration(spark):
    old = spark.createDataFrame([(1, 1, "/a/x.txt", "c", None)], "file_id long, op_id long, original_path string, category string, extra string")
    ops = spark.createDataFrame([(1, '{"categories": [{"id": "c", "name": "Cs"}]}')], "op_id long, stats_json string")
    whole, posts = index.migrated(old, ops)
    assert set(index.COLUMNS) | {"extra"} == set(whole.columns) and whole.first()["category_name"] == "Cs" and {r["term"] for r in posts.collect()} == {"a", "x", "txt", "c"}
    assert index.migrated(old.limit(0), ops)[0].count() == 0


def test_broadcasts_are_bounded_by_bytes(spark):
    wide = spark.range(20).selectExpr("id", "repeat('x', 1000) AS t", "array(repeat('y', 1000)) AS a")
    assert session.is_small(wide) and not session.is_small(wide, most_bytes=20_000) and not session.is_small(wide, most=19)
    assert session.is_small(wide.limit(0), most=0)


def test_report_has_calls_and_skipped(spark):
    files = spark.createDataFrame([(1, 1, "/a", "/b", "c", 1.0, "r"), (2, 1, "/x", None, None, None, "locked")], "file_id long, op_id long, original_path string, new_path string, category string, score double, reason string")
    cuts = spark.createDataFrame([], "op_id long, shortcut_id long, shortcut_path string")
    ops = spark.createDataFrame([(1, T, T + dt.timedelta(seconds=90))], "op_id long, started_at timestamp, finished_at timestamp")
    calls = spark.createDataFrame([("gpt-4o", 3_000_000, 300_000, 2.0, True), (None, 3, 3, 1.0, False)], "model string, prompt_chars long, response_chars long, duration double, success boolean")
    out = report.markdown(files, cuts, None, 1, operations=ops, calls=calls)
    assert "- duration: 90.0 s" in out and "- /x: locked" in out and "| gpt-4o | 1 | 0 | 1000000 | 100000 | 3.5000 |" in out


def test_a_plan_in_order(spark):
    e = entries(spark, ["Plan_a.txt", "Plan_b.txt", "note.md", "lost.bin"]).withColumn("modified", F.when(F.col("name") == "lost.bin", F.lit(dt.datetime(1999, 1, 1))).otherwise(F.col("modified")))
    path = {r["name"]: r["path"] for r in e.collect()}
    second = [("q", 0.5), ("nowhere", 0.4), ("p", 0.3)]
    rows = [
        (path["Plan_a.txt"], 0, "p", 0.9, second, "x" * 200), (path["Plan_a.txt"], 1, "q", 0.8, [], "again"), ("[folder]/Plan_b.txt", 2, "nowhere", 0.7, second, None),
        ("ote.md", 3, "q", 0.6, [], "cut off"), ("/no/such.file", 4, "p", 0.9, [], ""),
    ]
    given = spark.createDataFrame(rows, "path string, pos int, category_id string, score double, secondary array<struct<category_id:string,score:double>>, reason string")
    cats = spark.createDataFrame([("p", "Plans", None, "2024", "annual", 1), ("q", "Notes", None, None, "??", 12), ("bad", "\ufffd", None, None, None, 1)], "id string, name string, description string, time_label string, duration string, `group` int")
    out, kept = planner.normalised(given, e, cats)
    got = {r["path"].rsplit("/", 1)[1]: r for r in out.collect()}
    assert set(got) == set(path) and {r["id"] for r in kept.collect()} == {"p", "q", "misc"}
    assert got["Plan_a.txt"]["category_id"] == "p" and [x["category_id"] for x in got["Plan_a.txt"]["secondary"]] == ["q"] and len(got["Plan_a.txt"]["reason"]) == 140
    assert got["Plan_b.txt"]["category_id"] == "p" and got["Plan_b.txt"]["reason"] == s.RESCUE_REASON and got["Plan_b.txt"]["score"] == 0.7  # unknown, then by its period
    assert got["note.md"]["category_id"] == "q" and got["lost.bin"]["category_id"] == "misc" and got["lost.bin"]["score"] == 0.3
    assert planner.normalised(given.limit(0), e, cats)[0].count() == 4 and planner.normalised(given, e.limit(0), cats)[0].count() == 0
