"""Queries on the consistent form of names and paths."""

from pyspark.sql import functions as F

from shelfmark.llm import canonical as c
from shelfmark.llm import encodings as e
from shelfmark.session import table


def _forms(spark, sf_dir, changed_only):
    files = table(spark, sf_dir, "files")
    shared = spark.sparkContext.broadcast(e.fit([files.select("filename")]))  # characters of filenames and what stands before them
    skip = {"filename": lambda: lambda value: bool(shared.value.spans(value))}
    return c.forms(files, "file_id", ["filename", "original_path", "folder"], skip, changed_only)


def p2_found(spark, sf_dir):
    return _forms(spark, sf_dir, True).select(F.col("key").alias("file_id"), "field")


def p2_forms(spark, sf_dir):
    """Every value in the consistent form."""
    return _forms(spark, sf_dir, False).select(F.col("key").alias("file_id"), "field", "canonical", "was_canonical", F.array_join("spoofed", " ").alias("spoofed"))


QUERIES = {"p2_found": p2_found, "p2_forms": p2_forms}
ORACLE = {}
