"""The driver's tables as the operators' inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.session import table


def entries(spark, sf_dir):
    """(path, name, ext, excerpt, modified, file_id, op_id, category, score, reason): the latest row of each path."""
    fields = ("filename", "content_excerpt", "created_at", "op_id", "category", "score", "reason")
    top = table(spark, sf_dir, "files").groupBy("original_path").agg(F.max(F.struct("file_id", *fields)).alias("r"))
    name = F.coalesce(F.col("r.filename"), F.lit(""))
    return top.select(
        F.col("original_path").alias("path"), name.alias("name"), text.extension(name).alias("ext"), F.coalesce("r.content_excerpt", F.lit("")).alias("excerpt"), F.col("r.created_at").alias("modified"),
        "r.file_id", "r.op_id", "r.category", "r.score", F.coalesce("r.reason", F.lit("")).alias("reason"),
    )


E = r"""e AS (SELECT original_path AS path, coalesce(filename, '') AS name, lower(regexp_extract(coalesce(filename, ''), '(\.[A-Za-z0-9]{1,6})$', 1)) AS ext,
  coalesce(content_excerpt, '') AS excerpt, created_at AS modified, file_id, op_id, category, score, coalesce(reason, '') AS reason
  FROM (SELECT *, row_number() OVER (PARTITION BY original_path ORDER BY file_id DESC) AS k FROM files) WHERE k = 1)"""


def documents(spark, sf_dir):
    """(path, size, modified, content) of the documents, as files of their text."""
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/doc_"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.octet_length("text").cast("bigint").alias("size"), "modified", F.col("text").alias("content"))


D = "d AS (SELECT '/' || coalesce(source, 'none') || '/doc_' || doc_id AS path, strlen(text)::BIGINT AS size, modified, text AS content FROM documents)"


def rooted(spark, sf_dir):
    """(root, path): each path once, with the root of its run."""
    files = table(spark, sf_dir, "files").select("op_id", F.col("new_path").alias("path")).where("path IS NOT NULL")
    ops = table(spark, sf_dir, "operations").select("op_id", F.col("target_root").alias("root"))
    return files.join(ops, "op_id").select("root", "path").distinct()


R = "r AS (SELECT DISTINCT target_root AS root, new_path AS path FROM files JOIN operations USING (op_id) WHERE new_path IS NOT NULL)"


# --- pieces of SQL --------------------------------------------------------------------------------------------------


def lit(text_: str) -> str:
    return "'" + text_.replace("'", "''") + "'"


def rr(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def in_list(x: str, values) -> str:
    return f"{x} IN ({', '.join(map(lit, values))})"
