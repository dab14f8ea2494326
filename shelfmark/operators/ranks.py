"""Row numbers without a window: for orders over whole tables and for groups that may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import cut, join_checked

_LOW = (1 << 33) - 1  # monotonically_increasing_id: the partition above bit 33, the row in it below


def with_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """``df`` with row numbers from 1 in ``order`` (nulls first) over the whole table.

    Rows are range-partitioned by the full order, so equal leading columns are split too; each partition is sorted and
    numbered, and the numbers of rows before it, one for each partition, are added. Rows that tie in all of ``order``
    get any order among them, fixed by a checkpoint.
    """
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    starts, before = [], 0
    for p, n in counts:
        starts.append((p, before))
        before += n
    spark = df.sparkSession
    offsets = spark.createDataFrame(starts, "_p bigint, _before bigint")
    out = join_checked(rows.withColumn("_p", F.shiftright("_m", 33)), offsets, "_p")
    return out.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(_LOW) + 1).drop("_m", "_p", "_before")


def ranked_within(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """``df`` with row numbers from 1 within each group; a group of any size is spread over as many tasks as its rows need."""
    rows = with_rank(df, [*groups, *order], "_rank")
    first = rows.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]).agg(F.min("_rank").alias("_first"))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(first, same).withColumn(name, (F.col("_rank") - F.col("_first") + 1).cast("int")).select(*df.columns, name)
