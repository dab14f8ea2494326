"""What changed between consecutive full snapshots.

Every snapshot counts once with sign +1 for the change that leads to it and once with sign -1 for the change that
leads away from it. Its rows are unpivoted into cells (change, key, field, value, sign) plus one marker cell for the
presence of the key. Equal cells of two neighbouring snapshots cancel; what is left of the sums tells which keys were
added, removed or changed, and in which fields.

Two shuffles: one that leaves a row for each snapshot and key (with map-side combine, so repeated deliveries of one
key never meet in one task unreduced), one that brings a key's two versions together. Both have the key in their hash,
so neither a root nor a run that holds a third of all rows makes a large task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import join_checked

#: Name of the marker cell; it can't be that of a field, which is a plain column name.
PRESENCE = "\u0000present"


def latest_rows(rows: DataFrame, run: str, keys: Sequence[str], fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each (run, key): that with the highest ``order`` columns; a null there ranks lowest."""
    newest = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[F.col(c) for c in fields]).alias("v")))
    picked = rows.groupBy(F.col(run).alias("_run"), *[F.col(k) for k in keys]).agg(newest.alias("_n"))
    return picked.select("_run", *keys, *[F.col(f"_n.v.`{c}`").alias(c) for c in fields])


def neighbours(runs: DataFrame, run: str, root: str, started: str) -> DataFrame:
    """(run, next run, whether it is its root's first), runs of a root ordered by ``started``, then by id."""
    w = Window.partitionBy(root).orderBy(F.col(started).asc_nulls_first(), F.col(run))
    return runs.where(F.col(run).isNotNull()).select(
        F.col(run).alias("_run"), F.lead(run).over(w).alias("_next"), (F.row_number().over(w) == 1).alias("_first")
    )


def _cells(fields: Sequence[str]) -> Column:
    marker = F.struct(F.lit(PRESENCE).alias("field"), F.lit(None).cast("string").alias("value"))
    return F.array(marker, *[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])


def snapshot_changes(
    rows: DataFrame,
    runs: DataFrame,
    keys: Sequence[str] = ("original_path",),
    fields: Sequence[str] = ("new_path",),
    run: str = "op_id",
    root: str = "target_root",
    started: str = "started_at",
    order: Sequence[str] = ("created_at", "file_id"),
) -> DataFrame:
    """(run, keys, change_type, changed_fields) for each key that differs between a root's neighbouring runs.

    * ``change_type`` is 'added', 'removed' or 'changed'; ``changed_fields`` lists, sorted, the fields that differ (all
      of them for an added or removed key). ``run`` is the later run.
    * Within a run a key counts once, with its row of highest ``order``. Repeated rows and late corrections so collapse.
    * A null field is a value of its own: null against null is no change, null against a value is one. A null key is a
      key. Values are compared as stored.
    * A run without rows is an empty snapshot: all its predecessor's keys are removed. A root's first run has no
      changes. Rows whose run is null or unknown to ``runs`` belong to no root and give none.
    * Empty tables give an empty result. Columns besides those named are never read, whatever they are called.
    """
    latest = latest_rows(rows, run, keys, fields, order)
    sides = F.array(
        F.when(~F.col("_first"), F.struct(F.col("_run").alias("at"), F.lit(1).alias("sign"))),
        F.when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("at"), F.lit(-1).alias("sign"))),
    )
    signed = (
        join_checked(latest, neighbours(runs, run, root, started), "_run")
        .withColumn("_s", F.explode(F.filter(sides, lambda s: s.isNotNull())))
        .select(F.col("_s.at").alias("_at"), F.col("_s.sign").alias("_sign"), *keys, *fields)
        .repartition("_at", *keys)
    )
    cells = signed.select("_at", "_sign", *keys, F.explode(_cells(fields)).alias("_c"))
    left = (
        cells.groupBy("_at", *keys, F.col("_c.field").alias("_field"), F.col("_c.value").alias("_value"))
        .agg(F.sum("_sign").alias("_n"))
        .where("_n != 0")
    )
    marker = F.col("_field") == PRESENCE
    presence = F.sum(F.when(marker, F.col("_n")).otherwise(0))
    return left.groupBy("_at", *keys).agg(presence.alias("_p"), F.sort_array(F.collect_set(F.when(~marker, F.col("_field")))).alias("changed_fields")).select(
        F.col("_at").alias(run),
        *keys,
        F.when(F.col("_p") > 0, "added").when(F.col("_p") < 0, "removed").otherwise("changed").alias("change_type"),
        "changed_fields",
    )


def change_counts(changes: DataFrame, run: str = "op_id") -> DataFrame:
    """Numbers of added, removed and changed keys of each run; runs without changes have no row."""
    count = lambda kind: F.count(F.when(F.col("change_type") == kind, 1)).alias(f"n_{kind}")
    return changes.groupBy(run).agg(count("added"), count("removed"), count("changed"))
