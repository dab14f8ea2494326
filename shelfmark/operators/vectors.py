"""Likeness by vectors: TF-IDF weights, cosine, and groups of what is alike."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators.components import components
from shelfmark.session import spread

#: Vectors of one block of the exact search for pairs.
BLOCK = 4_096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def cosine_to(vectors: DataFrame, reference: list[float], vector: str = "embedding") -> DataFrame:
    """``vectors`` with the cosine to one vector."""
    return vectors.withColumn("cosine", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in reference])))


def _pairs(table: pa.Table, threshold: float) -> pa.Table:
    """Pairs of one (block, block) task of at least the threshold, by matrix products of slices."""
    mine = table.column("query").to_numpy()
    ids = table.column("id").combine_chunks()
    v = np.stack([np.asarray(x, np.float64) for x in table.column("v").to_pylist()]) if table.num_rows else np.zeros((0, 1))
    size = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    q, r = np.flatnonzero(mine), np.flatnonzero(~mine)
    a, b, c = [], [], []
    for s in range(0, len(q), 512):
        part = q[s : s + 512]
        cos = v[part] @ v[r].T
        i, j = np.nonzero(cos >= threshold - 1e-12)
        a.append(part[i])
        b.append(r[j])
        c.append(cos[i, j])
    cat = lambda x, t: np.concatenate([np.zeros(0, t), *x])
    out = pa.table({"a": ids.take(pa.array(cat(a, np.int64))), "b": ids.take(pa.array(cat(b, np.int64))), "cosine": pa.array(cat(c, np.float64))})
    import pyarrow.compute as pc

    return out.filter(pc.less(out["a"], out["b"])) if table.num_rows and table.column("i")[0] == table.column("j")[0] else out


def cosine_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(a, b, cosine), a < b, of at least ``threshold``: exact, by blocks against blocks.

    Only pairs that reach the threshold leave a task; a task holds two blocks of ``block`` vectors. This is the exact
    operator for sets that can be compared in full, as a catalogue's descriptions. Null vectors are left out.
    """
    kind = dict(vectors.dtypes)[key]
    rows = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    n = max(1, -(-rows.count() // block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    up, down = F.sequence(F.col("block"), F.lit(n - 1)), F.sequence(F.lit(0), F.col("block"))
    left = rows.select("id", "v", F.lit(True).alias("query"), F.col("block").alias("i"), F.explode(up).alias("j"))
    right = rows.select("id", "v", F.lit(False).alias("query"), F.explode(down).alias("i"), F.col("block").alias("j"))
    found = left.unionByName(right).groupBy("i", "j").applyInArrow(lambda t: _pairs(t, threshold), f"a {kind}, b {kind}, cosine double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")


def merged_groups(vectors: DataFrame, threshold: float = 0.55, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component): groups linked by pairs of at least the threshold; a vector alone is its own group."""
    linked = components(cosine_pairs(vectors, threshold, key, vector)).select(F.col("node").alias(key), "component")
    return vectors.select(key).join(linked, key, "left").select(key, F.coalesce("component", key).alias("component"))


def tfidf(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, term, weight): smooth-idf weights of a document's terms, of length 1. Terms are search tokens of the whole text."""
    terms = spread(docs.select(key, column)).select(key, F.explode(text.search_tokens(F.col(column))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = docs.count()
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    raw = terms.join(df, "term").select(key, "term", (F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))
