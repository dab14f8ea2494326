import datetime as dt
import random

import pytest

from shelfmark.operators.snapshots import change_counts, snapshot_changes

T = dt.datetime(2024, 1, 1)
RUNS = "op_id long, target_root string, started_at timestamp"
ROWS = "file_id long, op_id long, original_path string, new_path string, created_at timestamp, at string, sign int, _run string, v string"


def run(spark, rows, runs, **kw):
    r = spark.createDataFrame([(*x, "clash", 7, "clash", "clash") for x in rows], ROWS)
    o = spark.createDataFrame(runs, RUNS)
    return {(x["op_id"], x["original_path"]): (x["change_type"], tuple(x["changed_fields"])) for x in snapshot_changes(r, o, **kw).collect()}


def test_kinds_order_and_nulls(spark):
    runs = [(2, "r", T), (1, "r", T + dt.timedelta(days=1)), (3, "r", T + dt.timedelta(days=2))]  # started_at, not op_id, orders
    rows = [(1, 2, "a", "x", T), (2, 2, "b", None, T), (3, 2, "c", None, T), (4, 2, None, "n", T), (5, 1, "a", "y", T), (6, 1, "b", None, T), (7, 1, "c", "z", T), (8, 1, "d", "w", T)]
    got = run(spark, rows, runs)
    kinds = {k: v[0] for k, v in got.items()}
    assert kinds == {(1, "a"): "changed", (1, "c"): "changed", (1, "d"): "added", (1, None): "removed"} | {(3, p): "removed" for p in "abcd"}
    assert got[(1, "a")][1] == ("new_path",)


def test_repeats_corrections_and_ties(spark):
    runs = [(1, "r", T), (2, "r", T + dt.timedelta(days=1))]
    rows = [(1, 1, "a", "x", T), (1, 1, "a", "x", T), (2, 2, "a", "old", T), (3, 2, "a", "x", T + dt.timedelta(hours=1))]
    assert run(spark, rows, runs) == {}  # the later correction counts, repeats don't
    tie = [(1, 1, "a", "x", T), (5, 2, "a", "five", T), (4, 2, "a", "x", T), (9, 2, "a", "none", None)]
    assert run(spark, tie, runs) == {(2, "a"): ("changed", ("new_path",))}  # equal times: the highest file_id; a null time is the lowest


def test_empty_and_unknown(spark):
    runs = [(1, "r", T), (2, "r", T + dt.timedelta(days=1)), (7, None, None)]
    assert run(spark, [], runs) == {}
    assert run(spark, [(1, 99, "a", "x", T), (2, None, "a", "x", T)], runs) == {}
    assert run(spark, [(1, 1, "a", "x", T)], runs) == {(2, "a"): ("removed", ("new_path",))}  # an empty run is an empty snapshot
    assert run(spark, [(1, 1, "a", "x", T)], []) == {}


def test_long_values_and_counts(spark):
    runs = [(1, "r", T), (2, "r", T + dt.timedelta(days=1))]
    rows = spark.createDataFrame([(1, 1, "a", "x" * 200_000, T), (2, 2, "a", "x" * 200_000 + "y", T), (3, 2, "b", "", T)], ROWS.split(", at")[0])
    out = snapshot_changes(rows, spark.createDataFrame(runs, RUNS))
    assert [tuple(r) for r in change_counts(out).collect()] == [(2, 1, 0, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    runs = [(i, rnd.choice("rs"), T + dt.timedelta(days=rnd.randrange(1000))) for i in range(1, 9)]
    rows = [(i, rnd.randrange(1, 9), rnd.choice("abcdef"), rnd.choice(["x", "y", None]), T + dt.timedelta(hours=rnd.randrange(3))) for i in range(80)]
    last = {}
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        last.setdefault(r[1], {})[r[2]] = r[3]
    want = {}
    for root in "rs":
        own = sorted((r for r in runs if r[1] == root), key=lambda r: (r[2], r[0]))
        for a, b in zip(own, own[1:]):
            x, y = last.get(a[0], {}), last.get(b[0], {})
            for p in x.keys() | y.keys():
                if p not in x or p not in y or x[p] != y[p]:
                    want[b[0], p] = "added" if p not in x else "removed" if p not in y else "changed"
    assert {k: v[0] for k, v in run(spark, rows, runs).items()} == want
