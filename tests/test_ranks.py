import random

from shelfmark.operators.planner import suffix_matched
from shelfmark.operators.ranks import ranked_within, with_rank


def test_ranks(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None, "hot", "hot", "hot"]), rnd.randrange(50), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, id int").repartition(7)
    got = {r["id"]: r["rank"] for r in with_rank(df, ["o", "id"]).collect()}
    assert got == {r[2]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}
    within = {r["id"]: r["rank"] for r in ranked_within(df, ["g"], ["o", "id"]).collect()}
    for g in ("a", "b", None, "hot"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        assert [within[r[2]] for r in own] == list(range(1, len(own) + 1))
    assert with_rank(df.limit(0), ["o"]).count() == 0 and ranked_within(df.limit(0), ["g"], ["o"]).count() == 0


def test_ties_take_all_numbers(spark):
    df = spark.createDataFrame([("x", 1)] * 20, "g string, o int")
    assert sorted(r["rank"] for r in ranked_within(df, ["g"], ["o"]).collect()) == list(range(1, 21))


def test_suffix_match(spark):
    entries = spark.createDataFrame([("/a/data.txt", "data.txt"), ("/b/a.txt", "a.txt"), ("/c/x", "")], "path string, name string")
    assigned = spark.createDataFrame([("[folder]/a.txt",), ("ta.txt",), ("/a/data.txt",), ("none",), ("",)], "path string")
    assert {r["assigned_path"]: r["path"] for r in suffix_matched(assigned, entries).collect()} == {"[folder]/a.txt": "/b/a.txt", "ta.txt": "/a/data.txt"}
