"""What writes: the index's tables, reports, and, only where asked for, files themselves."""

from __future__ import annotations

import os
import shutil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import index


def record_run(store: str, operation: DataFrame, files: DataFrame, shortcuts: DataFrame) -> None:
    """Appends a run to the tables below ``store``, which are partitioned by run; a run that is written again replaces itself."""
    spark = operation.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        for name, df in (("operations", operation), ("files", files), ("shortcuts", shortcuts)):
            df.write.mode("overwrite").partitionBy("op_id").parquet(f"{store}/{name}")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def write_postings(files: DataFrame, path: str) -> None:
    """Stores the full-text index, sorted by term, and the rows' lengths beside it."""
    index.packed(index.postings(files)).write.mode("overwrite").parquet(path)
    index.lengths(files).write.mode("overwrite").parquet(f"{path}.lengths")


def stored_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths as ``write_postings`` stores them. A search's filters on terms reach the scan, which skips row groups of other terms."""
    return index.unpacked(spark.read.parquet(path)), spark.read.parquet(f"{path}.lengths")


def write_report(text: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _acted(rows: DataFrame, act, dry_run: bool) -> DataFrame:
    """(source, target, done, problem): ``act`` on each row where it lies, or nothing if ``dry_run``. A row that fails is told, not raised."""

    def run(batches):
        for b in batches:
            done, problem = [], []
            for source, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    if not dry_run:
                        act(source, target)
                    done.append(not dry_run)
                    problem.append(None)
                except OSError as e:
                    done.append(False)
                    problem.append(f"{type(e).__name__}: {e.strerror}")
            yield pa.record_batch([b.column(0), b.column(1), pa.array(done), pa.array(problem, pa.string())], names=["source", "target", "done", "problem"])

    return rows.mapInArrow(run, "source string, target string, done boolean, problem string")


def move_files(placed: DataFrame, dry_run: bool = True) -> DataFrame:
    """Moves (path -> new_path) on a file system that all executors share; a file already there stays, a taken name is a problem."""

    def move(source: str, target: str) -> None:
        if source == target or (not os.path.exists(source) and os.path.exists(target)):
            return  # done by an earlier attempt of this task
        if os.path.exists(target):
            raise FileExistsError(17, "name is taken", target)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        shutil.move(source, target)

    return _acted(placed.select(F.col("path").alias("source"), F.col("new_path").alias("target")), move, dry_run)


def link_files(shortcuts: DataFrame, dry_run: bool = True) -> DataFrame:
    """Makes shortcuts (target -> shortcut) as hard links, else symbolic ones."""

    def link(source: str, target: str) -> None:
        if os.path.lexists(target):
            return
        os.makedirs(os.path.dirname(target), exist_ok=True)
        try:
            os.link(source, target)
        except OSError:
            os.symlink(source, target)

    return _acted(shortcuts.select(F.col("target").alias("source"), F.col("shortcut").alias("target")), link, dry_run)


def delete_copies(ledger: DataFrame, dry_run: bool = True) -> DataFrame:
    """Deletes the ledger's copies whose canonical file is there."""

    def delete(source: str, target: str) -> None:
        if os.path.exists(target) and os.path.exists(source):
            os.remove(source)

    return _acted(ledger.select(F.col("deleted_path").alias("source"), F.col("canonical_path").alias("target")), delete, dry_run)
