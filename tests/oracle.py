"""Runs a query and its SQL over the same tables and compares the rows."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings operations files shortcuts parser_cache categories benchmark mix_targets name_lexicon".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in data)


def differences(spark, name, sf_dir, queries, oracle):
    df = queries[name](spark, sf_dir)
    a = rows(df.columns, df.collect())
    cur = connect(sf_dir).execute(oracle[name])
    b = rows([c[0] for c in cur.description], cur.fetchall())
    assert a[0] == b[0], f"{name}: columns {a[0]} and {b[0]}"
    return list((a[1] - b[1]).items())[:5], list((b[1] - a[1]).items())[:5], sum(a[1].values())
