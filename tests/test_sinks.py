import datetime as dt
import logging

from shelfmark import runlog, schema
from shelfmark.operators import index, placement
from shelfmark.plans.assign import plan
from shelfmark.sources import sinks

T = dt.datetime(2024, 1, 1)


def test_files_are_touched_only_when_asked(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("x")
    b.write_text("x")
    placed = spark.createDataFrame([(str(a), str(tmp_path / "n" / "a.txt")), (str(tmp_path / "gone"), str(tmp_path / "n" / "g"))], "path string, new_path string")
    assert not any(r["done"] for r in sinks.move_files(placed).collect()) and a.exists()
    got = {r["source"]: (r["done"], r["problem"]) for r in sinks.move_files(placed, dry_run=False).collect()}
    assert got[str(a)] == (True, None) and got[str(tmp_path / "gone")][0] is False and (tmp_path / "n" / "a.txt").exists()
    cuts = spark.createDataFrame([(str(tmp_path / "n" / "a.txt"), str(tmp_path / "c" / "a.txt"))], "target string, shortcut string")
    assert sinks.link_files(cuts, dry_run=False).first()["done"] and (tmp_path / "c" / "a.txt").read_text() == "x"
    ledger = spark.createDataFrame([(str(b), str(tmp_path / "n" / "a.txt")), (str(tmp_path / "n" / "a.txt"), str(tmp_path / "none"))], "deleted_path string, canonical_path string")
    sinks.delete_copies(ledger, dry_run=False).collect()
    assert not b.exists() and (tmp_path / "n" / "a.txt").exists()


def test_record_and_search(spark, tmp_path):
    store = str(tmp_path / "store")
    op = lambda i: spark.createDataFrame([(i, "/r", T)], "op_id long, target_root string, started_at timestamp")
    files = lambda i, n: spark.createDataFrame([(i * 10 + k, i, f"/a{k}", f"/n{k}", "name", "f", "c", "r", f"text number{k}") for k in range(n)], "file_id long, op_id long, original_path string, new_path string, filename string, folder string, category string, reason string, content_excerpt string")
    cuts = spark.createDataFrame([(1, 1, "/s")], "shortcut_id long, op_id long, shortcut_path string")
    sinks.record_run(store, op(1), files(1, 3), cuts)
    sinks.record_run(store, op(2), files(2, 2), cuts.limit(0))
    sinks.record_run(store, op(1), files(1, 1), cuts)
    back = spark.read.parquet(f"{store}/files")
    assert back.count() == 3 and spark.read.parquet(f"{store}/operations").count() == 2
    sinks.write_postings(back, f"{store}/postings")
    hits = index.bm25(index.unpacked(spark.read.parquet(f"{store}/postings")), index.lengths(back), "number1")
    assert [r["file_id"] for r in hits.collect()] == [21]


def test_settings_and_log(tmp_path):
    p = str(tmp_path / "s.json")
    schema.save_settings(schema.Settings(min_category_size=5), p)
    assert schema.load_settings(p).min_category_size == 5 and schema.load_settings(p + "x") == schema.Settings()
    (tmp_path / "bad.json").write_text('{"min_category_size": 4, "unknown": 1')
    assert schema.load_settings(str(tmp_path / "bad.json")) == schema.Settings()
    log = runlog.start(str(tmp_path / "l"))
    log.info("key %s", "sk-" + "a" * 20)
    logging.shutdown()
    assert "REDACTED" in (tmp_path / "l").read_text() and "aaaa" not in (tmp_path / "l").read_text()


def test_recovery_and_plan(spark):
    a = spark.createDataFrame([("/x/f.txt",), ("/y/g.txt",)], "path string")
    listing = spark.createDataFrame([("/z/f.txt",), ("/y/g.txt",)], "path string")
    assert [tuple(r) for r in placement.recovered(a, listing).collect()] == [("/x/f.txt", "/z/f.txt")]
    dirs = spark.createDataFrame([("ì\x8b\x9cì\xa0\x95", 0), ("ëëë", 2), ("fine", 0)], "dir string, n_files int")
    assert [r["action"][:5] for r in placement.garbled_directories(dirs).orderBy("n_files").collect()] == ["remov", "merge"]
    e = spark.createDataFrame([("/a/invoice.pdf", "invoice.pdf", ".pdf", "", T)], "path string, name string, ext string, excerpt string, modified timestamp")
    assert plan(e)[0].first()["category_id"] == "receipts"
    assert plan(e, lambda p: {"new_categories": [{"id": "n"}], "assignments": [{"i": f["i"], "c": "n"} for f in p["files"]]})[0].first()["category_id"] == "n"


def test_terms_are_filtered_in_the_scan(spark, tmp_path):
    files = spark.read.parquet("/root/testdata/sf0.001/files.parquet")
    sinks.write_postings(files, f"{tmp_path}/p")
    post, length = sinks.stored_index(spark, f"{tmp_path}/p")
    hits = index.bm25(post, length, "budget archive", None)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,budget)" in plan and "StringStartsWith(term,archive)" in plan
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, index.bm25(index.postings(files), index.lengths(files), "budget archive", None).collect()))
