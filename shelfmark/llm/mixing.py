"""Mixing sources to target shares of tokens, without sorting.

Each document has a place in [0, 2^32) by a hash of its key. Tokens are summed by source and the top bits of the place,
so a source is a histogram of at most BUCKETS numbers whatever its number of documents. A source's budget is met by
all documents below a threshold of the place; the histogram gives the bucket it lies in, and only that bucket is cut
into BUCKETS finer ones, until its width is one place. Thresholds are nested: a smaller budget takes a subset of a
larger one's documents. The result is a filter on the place, without sort, window or collected rows.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrow import over_batches, strings
from shelfmark.session import cut, join_checked

TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: The split before the merges that belongs to the rank files; a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PLACE_BITS = 32
BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS


def with_tokens(df: DataFrame, key: str, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, keep, n_tokens): tokens of the whole text; 0 for null and empty texts. ``tokenizer`` is a rank file on every executor."""

    def make():
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def step(batch: pa.RecordBatch):
            sizes = pa.array([len(encode(t)) for t in strings(batch.column(0))], pa.int64())
            return pa.record_batch([*batch.columns[1:], sizes], names=[*batch.schema.names[1:], "n_tokens"])

        return step

    kept = [key, *[c for c in keep if c != key]]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", n_tokens bigint"
    return over_batches(df.select(F.col(text).alias("_t"), *kept), "_t", schema, make)


@dataclass
class Share:
    """What one source gives: its documents ``full`` times each, and once more those whose place is below ``threshold``."""

    source: str
    target: float
    effective: float
    max_repeats: int
    available: int
    budget: int
    full: int = 0
    threshold: int = 0


def budgets(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> list[Share]:
    """Token budget of each source that has a target.

    Shares of sources without tokens are spread over the others in proportion (``effective``). Without ``total`` the
    mix is the largest in which every source reaches its effective share within its repeats. With ``total``, sources
    that can't reach their share give all they have, max_repeats times.
    """
    live = {s: t for s, t in targets.items() if available.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    weight = sum(t[0] for t in live.values())
    if total is None:
        total = min((int(available[s] * r * weight / share) for s, (share, r) in live.items()), default=0)
    out = []
    for s, (share, repeats) in sorted(targets.items()):
        have, effective = available.get(s, 0), share / weight if s in live else 0.0
        out.append(Share(s, share, effective, repeats, have, min(round(total * effective), have * max(repeats, 0))))
    return out


def _place(key: str):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(1 << PLACE_BITS))


def _thresholds(docs: DataFrame, source: str, shares: list[Share]) -> None:
    """Finds each share's threshold, one histogram of the open buckets at a time: PLACE_BITS / BUCKET_BITS passes at most."""
    open_ = {}
    for s in shares:
        s.full, rest = divmod(s.budget, s.available) if s.available else (0, 0)
        if rest:
            open_[s.source] = [0, rest, s]
    width = 1 << PLACE_BITS
    spark = docs.sparkSession
    while open_ and width > 1:
        step = max(1, width >> BUCKET_BITS)
        bounds = spark.createDataFrame([(s, lo, lo + width) for s, (lo, _, _) in open_.items()], f"{source} string, _lo bigint, _hi bigint")
        inside = docs.join(F.broadcast(bounds), source).where("_place >= _lo AND _place < _hi")
        sums = inside.groupBy(source, F.floor((F.col("_place") - F.col("_lo")) / step).cast("int").alias("b")).agg(F.sum("n_tokens").alias("n")).collect()
        by: dict[str, dict[int, int]] = {}
        for r in sums:
            by.setdefault(r[0], {})[r["b"]] = r["n"]
        for s, slot in open_.items():
            lo, rest, _ = slot
            bucket = 0
            for bucket in range(BUCKETS):
                n = by.get(s, {}).get(bucket, 0)
                if n > rest:
                    break
                rest -= n
            slot[0], slot[1] = lo + bucket * step, rest
        width = step
    for lo, rest, share in open_.values():
        share.threshold = lo


def mix(
    docs: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total: int | None = None,
    tokenizer: str = TOKENIZER,
    most_targets: int = 10_000,
) -> tuple[DataFrame, list[Share]]:
    """(key, source, n_tokens, repeats) of the documents in the mix, and the shares.

    * A source's documents all appear ``full`` times, and once more if below its threshold; so no document is used
      more than max_repeats times, and a source misses its budget by less than the tokens of the documents that share
      one place of 2^32.
    * Documents whose source is null or has no target are not in the mix; nor are those without tokens. Targets with a
      null source, share or repeats count as 0. A source that is listed twice is an error, as are more than
      ``most_targets`` targets: they're held on the driver.
    * Rows that repeat a key share a place and are taken or left together; each counts its own tokens.
    * A source of a third of all rows is no more than BUCKETS numbers for each task.
    """
    rows = targets.where(F.col("source").isNotNull()).select("source", F.coalesce("target_share", F.lit(0.0)), F.coalesce("max_repeats", F.lit(0))).limit(most_targets + 1).collect()
    if len(rows) > most_targets or len({r[0] for r in rows}) < len(rows):
        raise ValueError("targets: too many, or a source is listed twice")
    wanted = {r[0]: (float(r[1]), int(r[2])) for r in rows}
    known = docs.where(F.col(source).isin(list(wanted))) if wanted else docs.limit(0)
    sized = cut(with_tokens(known, key, text, [source], tokenizer).withColumn("_place", _place(key)))
    available = {r[0]: int(r[1]) for r in sized.groupBy(source).agg(F.sum("n_tokens")).collect()}
    shares = budgets(available, wanted, total)
    _thresholds(sized, source, shares)
    spec = docs.sparkSession.createDataFrame([(s.source, s.full, s.threshold) for s in shares], f"{source} string, _full int, _threshold bigint")
    repeats = F.col("_full") + F.when(F.col("_place") < F.col("_threshold"), 1).otherwise(0)
    chosen = join_checked(sized, spec, source).withColumn("repeats", repeats).where("repeats > 0 AND n_tokens > 0")
    return chosen.select(key, source, "n_tokens", "repeats"), shares


def reached(chosen: DataFrame, shares: list[Share], source: str = "source") -> DataFrame:
    """One row for each target: shares wanted and reached, tokens, documents and repeats used."""
    spark = chosen.sparkSession
    plan = spark.createDataFrame([(s.source, s.target, s.effective, s.max_repeats, s.available, s.budget) for s in shares], f"{source} string, target_share double, effective_share double, max_repeats int, available_tokens bigint, budget_tokens bigint")
    got = chosen.groupBy(source).agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"))
    total = got.agg(F.sum("tokens")).first()[0]
    out = plan.join(got, source, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(source, "target_share", "effective_share", F.coalesce(F.col("tokens") / F.lit(total), F.lit(0.0)).alias("reached_share"), "max_repeats", zero("most_repeats"), "available_tokens", "budget_tokens", zero("tokens"), zero("n_docs"))
