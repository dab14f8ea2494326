import random

import pytest

from shelfmark.llm import mixing as m

TARGETS = "source string, target_share double, max_repeats int"


def run(spark, docs, targets, **kw):
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, source string, n_tokens int, repeats int")
    chosen, shares = m.mix(d, spark.createDataFrame(targets, TARGETS), **kw)
    return [tuple(r) for r in chosen.collect()], {r["source"]: r for r in m.reached(chosen, shares).collect()}


def test_shares_and_caps(spark):
    rnd = random.Random(1)
    docs = [(i, "word " * rnd.randrange(5, 60), "big" if i % 3 else "small") for i in range(900)] + [(5_000 + i, "tiny text here", "rare") for i in range(4)]
    rows, by = run(spark, docs, [("big", 0.5, 1), ("small", 0.45, 4), ("rare", 0.05, 3), ("absent", 0.2, 2)], total=20_000)
    assert by["absent"]["tokens"] == 0 and by["rare"]["most_repeats"] <= 3 and by["rare"]["tokens"] == by["rare"]["available_tokens"] * 3
    for s in ("big", "small"):
        assert abs(by[s]["tokens"] - by[s]["budget_tokens"]) <= 60 and by[s]["most_repeats"] <= by[s]["max_repeats"]
    assert all(r[3] >= 1 for r in rows) and len({r[0] for r in rows}) == len(rows)


def test_default_total_reaches_every_share(spark):
    docs = [(i, "word " * (1 + i % 9), "ab"[i % 2]) for i in range(2_000)]
    _, by = run(spark, docs, [("a", 0.7, 2), ("b", 0.3, 1)])
    assert by["a"]["reached_share"] == pytest.approx(0.7, abs=0.01)
    assert sum(r["reached_share"] for r in by.values()) == pytest.approx(1)


def test_nested_thresholds(spark):
    docs = [(i, "some text of a few words", "a") for i in range(500)]
    small, _ = run(spark, docs, [("a", 1.0, 1)], total=600)
    large, _ = run(spark, docs, [("a", 1.0, 1)], total=1_500)
    assert {r[0] for r in small} < {r[0] for r in large}


def test_edges(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, "x", None), (4, "long " * 200_000, "a"), (4, "twice", "a"), (None, "no key", "a"), (9, "y", "unknown")]
    rows, by = run(spark, docs, [("a", 1.0, 1), (None, 0.5, 1), ("b", None, None)])
    assert {r[0] for r in rows} == {4, None} and by["a"]["reached_share"] == 1.0
    assert run(spark, [], [("a", 1.0, 1)])[0] == [] and run(spark, docs, [])[0] == []
    with pytest.raises(ValueError):
        run(spark, docs, [("a", 0.5, 1), ("a", 0.5, 1)])


def test_one_source_of_a_third_and_ties(spark):
    docs = [(7, "the same document", "a")] * 300 + [(i, "other words", "b") for i in range(600)]
    rows, by = run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)], total=1_200)
    assert by["a"]["tokens"] in (0, by["a"]["available_tokens"])  # rows with one key are taken or left together
