"""Queries on personal information."""

from pyspark.sql import functions as F

from shelfmark.llm import personal as p
from shelfmark.session import table


def _personal(spark, sf_dir, found_only):
    return p.personal(table(spark, sf_dir, "files"), "file_id", ["content_excerpt", "filename"], table(spark, sf_dir, "name_lexicon"), found_only=found_only)


def p4_found(spark, sf_dir):
    return _personal(spark, sf_dir, True).select(F.col("key").alias("file_id"), "field", F.explode("kinds").alias("kind"))


def p4_redacted(spark, sf_dir):
    """Every text with placeholders for what is personal."""
    return _personal(spark, sf_dir, False).select(F.col("key").alias("file_id"), "field", "redacted")


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
ORACLE = {}
