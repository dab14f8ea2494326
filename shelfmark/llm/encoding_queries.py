"""Queries on text in the wrong encoding."""

from pyspark.sql import functions as F

from shelfmark.llm import encodings as e
from shelfmark.session import table

#: (table, key, field)
FIELDS = (("files", "file_id", "content_excerpt"), ("files", "file_id", "filename"), ("parser_cache", "cache_id", "excerpt"))


def _garbled(spark, sf_dir):
    columns = [(name, key, field, table(spark, sf_dir, name).select(key, field)) for name, key, field in FIELDS]
    model = e.fit([df.select(field) for _, _, field, df in columns])
    out = None
    for name, key, field, df in columns:
        one = e.garbled(df, key, field, model).select(F.lit(name).alias("tbl"), F.col("key").alias("row_id"), F.lit(field).alias("field"), "garbled", "restored", "complete")
        out = one if out is None else out.unionByName(one)
    return out


def p3_found(spark, sf_dir):
    return _garbled(spark, sf_dir).select("tbl", "row_id", "field")


def p3_restored(spark, sf_dir):
    """The garbled texts with what they were."""
    return _garbled(spark, sf_dir)


QUERIES = {"p3_found": p3_found, "p3_restored": p3_restored}
ORACLE = {}
