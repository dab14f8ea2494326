"""Tables of a run's report, and their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import schema as s
from shelfmark.functions import budget, text
from shelfmark.schema import Settings


def distribution(files: DataFrame) -> DataFrame:
    """(op_id, category, n, share) of each run."""
    n = files.groupBy("op_id", F.coalesce("category", F.lit("")).alias("category")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("op_id")))


def moves(files: DataFrame, op_id: int, limit: int = Settings().report_rows) -> DataFrame:
    """A run's moves, the report's first rows by file_id."""
    rows = files.where(F.col("op_id") == op_id).select("file_id", "original_path", "new_path", "category", "score", "reason")
    return rows.orderBy("file_id").limit(limit)


def durations(operations: DataFrame) -> DataFrame:
    """(op_id, seconds) of each run; null for one that hasn't ended."""
    return operations.select("op_id", (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))).cast("double").alias("_m")).select("op_id", (F.col("_m") / 1e6).alias("seconds"))


def call_costs(calls: DataFrame) -> DataFrame:
    """(model, n_calls, n_failed, prompt_tokens, response_tokens, seconds, dollars, won) of each model's calls."""
    c = F.col
    per = calls.withColumn("_d", budget.cost(c("model"), c("prompt_chars"), c("response_chars")))
    tokens = lambda x: F.sum(F.floor(c(x) / 3))
    out = per.groupBy("model").agg(
        F.count("*").alias("n_calls"), F.count(F.when(~c("success"), 1)).alias("n_failed"), tokens("prompt_chars").alias("prompt_tokens"), tokens("response_chars").alias("response_tokens"),
        F.sum("duration").alias("seconds"), F.sum("_d").alias("dollars"),
    )
    return out.withColumn("won", c("dollars") * s.WON)


def skipped(files: DataFrame, most: int = Settings().report_rows) -> DataFrame:
    """(file_id, original_path, reason) of rows that were not moved, the report's first by file_id."""
    return files.where(F.col("new_path").isNull()).select("file_id", "original_path", F.coalesce("reason", F.lit("")).alias("reason")).orderBy("file_id").limit(most)


def totals(files: DataFrame, shortcuts: DataFrame) -> DataFrame:
    """(op_id, n_files, n_skipped, n_shortcuts, n_categories); n_files counts all assignments of the run."""
    cuts = shortcuts.groupBy("op_id").agg(F.count("*").alias("n_shortcuts"))
    per = files.groupBy("op_id").agg(F.count("*").alias("n_files"), F.count(F.when(F.col("new_path").isNull(), 1)).alias("n_skipped"), F.countDistinct("category").alias("n_categories"))
    return per.join(cuts, "op_id", "left").select("op_id", "n_files", "n_skipped", F.coalesce("n_shortcuts", F.lit(0)).alias("n_shortcuts"), "n_categories")


def freed(ledger: DataFrame) -> DataFrame:
    """One row: copies, bytes, and bytes as they're shown."""
    return ledger.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes_freed"), F.lit(0)).alias("bytes")).withColumn("label", text.bytes_label(F.col("bytes")))


def markdown(files: DataFrame, shortcuts: DataFrame, ledger: DataFrame | None, op_id: int, settings: Settings = Settings(), operations: DataFrame | None = None, calls: DataFrame | None = None) -> str:
    """The report of one run. Only its own tables come to the driver: counts, and at most ``report_rows`` rows of each list."""
    most = settings.report_rows
    run = files.where(F.col("op_id") == op_id)
    n = run.count()
    lines = [f"# Run {op_id}", "", f"- files: {n}"]
    if operations is not None:
        took = [r["seconds"] for r in durations(operations.where(F.col("op_id") == op_id)).limit(1).collect() if r["seconds"] is not None]
        lines += [f"- duration: {took[0]:.1f} s"] if took else []
    lines += ["", "## Categories", "", "| category | files | share |", "|---|---|---|"]
    lines += [f"| {r['category']} | {r['n']} | {r['share']:.1%} |" for r in distribution(run).orderBy(F.desc("n"), "category").limit(most).collect()]
    lines += ["", "## Moves", "", "| from | to | reason |", "|---|---|---|"]
    lines += [f"| {r['original_path']} | {r['new_path'] or ''} | {r['reason'] or ''} |" for r in moves(files, op_id, most).collect()]
    if n > most:
        lines.append(f"| … | +{n - most} more | |")
    cuts = shortcuts.where(F.col("op_id") == op_id)
    lines += ["", "## Shortcuts", ""] + [f"- {r['shortcut_path']}" for r in cuts.where("shortcut_path IS NOT NULL").orderBy("shortcut_id").limit(most).collect()]
    lines += ["", "## Skipped", ""] + [f"- {r['original_path']}: {r['reason']}" for r in skipped(run, most).collect()]
    if calls is not None:
        lines += ["", "## Model calls", "", "| model | calls | failed | prompt tokens | response tokens | $ |", "|---|---|---|---|---|---|"]
        lines += [f"| {r['model']} | {r['n_calls']} | {r['n_failed']} | {r['prompt_tokens']} | {r['response_tokens']} | {r['dollars']:.4f} |" for r in call_costs(calls).orderBy(F.desc("dollars"), "model").limit(most).collect()]
    if ledger is not None:
        lines += ["", "## Duplicates", "", f"- {freed(ledger).first()['label']} freed"]
        lines += [f"- {r['deleted_path']} = {r['canonical_path']} ({r['label']})" for r in ledger.withColumn("label", text.bytes_label(F.col("bytes_freed"))).orderBy("deleted_path").limit(most).collect()]
    return "\n".join(lines) + "\n"


def call_usage(calls: DataFrame) -> DataFrame:
    """Totals of model calls (prompt_chars, response_chars, duration, ttft, success)."""
    c = F.col
    tokens = lambda x: F.floor(F.sum(x) / 3)
    return calls.agg(
        F.count("*").alias("n_calls"),
        F.count(F.when(~c("success"), 1)).alias("n_failed"),
        tokens("prompt_chars").alias("prompt_tokens"),
        tokens("response_chars").alias("response_tokens"),
        F.avg(F.when(c("ttft") > 0, c("ttft"))).alias("mean_ttft"),
        (F.sum("response_chars") / 3 / F.nullif(F.sum("duration"), F.lit(0.0))).alias("tokens_per_second"),
    )
