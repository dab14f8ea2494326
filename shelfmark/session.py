"""Session helpers: table access, lineage cuts that survive lost executors, joins behind a size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows, and most bytes as an estimate, of a side that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 64 << 20


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelfmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is the cluster's ``spark.checkpoint.dir``; a temporary one is made only on a single machine, as in tests.
    """
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder, set if it wasn't."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="shelfmark-checkpoint-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, for tables that are written to be read again."""
    return f"{checkpoints(spark)}/{uuid.uuid4()}"


def _bytes(df: DataFrame):
    """Estimated bytes of a row: texts by their length, arrays and structs as JSON, all else 16."""
    total = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return total


def is_small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``most`` rows and bytes; reads no more than ``most + 1`` rows."""
    n, size = df.limit(most + 1).select(_bytes(df).alias("b")).agg(F.count("*"), F.sum("b")).first()
    return n <= most and (size or 0) <= most_bytes


#: Tables up to this size, in fewer files than there are cores, are spread before costly work on their rows.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is a small scan of few files, whose row groups may be a single task; else as it is."""
    files = len(df.inputFiles())
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not files or files >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores)


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join; ``right`` is broadcast only if it is counted and found small, else both sides are shuffled and AQE splits hot keys.
    It is read twice: what is dear to make should be materialised."""
    return left.join(F.broadcast(right) if is_small(right, most) else right, on, how)
