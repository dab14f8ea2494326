"""Queries on changes between snapshots, and their SQL."""

from shelfmark.operators.snapshots import change_counts, snapshot_changes
from shelfmark.session import table


def _changes(spark, sf_dir):
    return snapshot_changes(table(spark, sf_dir, "files"), table(spark, sf_dir, "operations"))


def p1_found(spark, sf_dir):
    return _changes(spark, sf_dir).select("op_id", "original_path", "change_type")


def p1_fields(spark, sf_dir):
    """Changes of the placement and classification fields, with the fields that changed."""
    from pyspark.sql import functions as F

    fields = ("new_path", "filename", "folder", "category", "reason", "score")
    changes = snapshot_changes(table(spark, sf_dir, "files"), table(spark, sf_dir, "operations"), fields=fields)
    return changes.select("op_id", "original_path", "change_type", F.array_join("changed_fields", ",").alias("fields"))


def p1_counts(spark, sf_dir):
    return change_counts(_changes(spark, sf_dir))


_SIDES = """
WITH r AS (
  SELECT op_id, lead(op_id) OVER w AS nxt, row_number() OVER w AS rn FROM operations
  WINDOW w AS (PARTITION BY target_root ORDER BY started_at NULLS FIRST, op_id)),
f AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY op_id, original_path
    ORDER BY created_at DESC NULLS LAST, file_id DESC NULLS LAST) AS k FROM files) WHERE k = 1),
a AS (SELECT f.* FROM f JOIN r ON f.op_id = r.op_id WHERE rn > 1),
b AS (SELECT f.* REPLACE (r.nxt AS op_id) FROM f JOIN r ON f.op_id = r.op_id WHERE nxt IS NOT NULL),
c AS (
  SELECT coalesce(a.op_id, b.op_id) AS op_id, coalesce(a.original_path, b.original_path) AS original_path,
    CASE WHEN b.file_id IS NULL THEN 'added' WHEN a.file_id IS NULL THEN 'removed' ELSE 'changed' END AS change_type,
    {differs}
  FROM a FULL JOIN b ON a.op_id = b.op_id AND a.original_path = b.original_path)
"""
_ONE = _SIDES.format(differs="a.new_path IS DISTINCT FROM b.new_path AS d") + ", d AS (SELECT op_id, original_path, change_type FROM c WHERE change_type != 'changed' OR d)"
_FIELDS = ("category", "filename", "folder", "new_path", "reason", "score")
_ALL = _SIDES.format(
    differs="list_filter([" + ", ".join(f"CASE WHEN b.file_id IS NULL OR a.file_id IS NULL OR a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in _FIELDS) + "], lambda x: x IS NOT NULL) AS fields"
)

QUERIES = {"p1_found": p1_found, "p1_fields": p1_fields, "p1_counts": p1_counts}
ORACLE = {
    "p1_found": _ONE + "SELECT * FROM d",
    "p1_fields": _ALL + "SELECT op_id, original_path, change_type, array_to_string(fields, ',') AS fields FROM c WHERE len(fields) > 0",
    "p1_counts": _ONE
    + "SELECT op_id, count(*) FILTER (change_type = 'added') AS n_added, count(*) FILTER (change_type = 'removed') AS n_removed, count(*) FILTER (change_type = 'changed') AS n_changed FROM d GROUP BY op_id",
}
