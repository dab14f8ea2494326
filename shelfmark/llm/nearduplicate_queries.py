"""Queries on files that are nearly the same, and their SQL."""

from pyspark.sql import functions as F

from shelfmark.llm import nearduplicates as nd
from shelfmark.session import table

#: What TESTDATA.md sets for files: single words, 0.7.
THRESHOLD = 0.7


def _texts(spark, sf_dir):
    """One text for each path: that of its lowest file_id with an excerpt."""
    files = table(spark, sf_dir, "files").where("content_excerpt != ''")
    one = files.groupBy("original_path").agg(F.min(F.struct("file_id", "filename", "content_excerpt")).alias("f"))
    return one.select("f.file_id", F.concat(F.coalesce("f.filename", F.lit("")), F.lit("\n"), "f.content_excerpt").alias("text"))


def p5_found(spark, sf_dir):
    pairs = nd.expanded(*nd.similar_pairs(_texts(spark, sf_dir), "file_id", "text", THRESHOLD, shingle=1))
    return pairs.select(F.col("a").alias("file_id_a"), F.col("b").alias("file_id_b"))


def p5_groups(spark, sf_dir):
    """Class, group and number of links of each file."""
    return nd.groups(_texts(spark, sf_dir), "file_id", "text", THRESHOLD, shingle=1).select(F.col("key").alias("file_id"), F.col("class").alias("class_id"), F.col("group").alias("group_id"), "n_links")


def p5_documents(spark, sf_dir):
    """Groups of documents by runs of five words and a similarity of 0.8."""
    out = nd.groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), F.col("class").alias("class_id"), F.col("group").alias("group_id"), "n_links")


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups, "p5_documents": p5_documents}
ORACLE = {
    "p5_found": r"""
WITH f AS (SELECT file_id, coalesce(filename, '') || chr(10) || content_excerpt AS t FROM (SELECT *, row_number() OVER (PARTITION BY original_path ORDER BY file_id) AS k FROM files WHERE content_excerpt != '') WHERE k = 1),
w AS (SELECT file_id, list_distinct(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS w FROM f),
u AS (SELECT file_id, len(w) AS n, unnest(w) AS word FROM w),
c AS (SELECT a.file_id AS file_id_a, b.file_id AS file_id_b, a.n + b.n AS n, count(*) AS k FROM u a JOIN u b ON a.word = b.word AND a.file_id < b.file_id AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n GROUP BY 1, 2, 3)
SELECT file_id_a, file_id_b FROM c WHERE k >= 0.7 * (n - k)"""
}
