"""Assigning rows by a model, which is any function from a prompt to a dictionary. Only rows of families come to the driver, chunk by chunk."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import schema as s
from shelfmark.operators import families
from shelfmark.session import cut

Model = Callable[[dict], dict]


def recovered_json(text: str) -> str:
    """``text`` with what a cut-off JSON value lacks at its end: its string, the value of a last key, its brackets."""
    open_: list[str] = []
    inside = escaped = False
    for ch in text:
        if inside:
            inside, escaped = escaped or ch != '"', not escaped and ch == "\\"
        elif ch == '"':
            inside = True
        elif ch in "{[":
            open_.append("}" if ch == "{" else "]")
        elif ch in "}]" and open_ and open_[-1] == ch:
            open_.pop()
    if not open_ and not inside:
        return text
    head = text[:-1] if inside and escaped else text
    closing = "".join(reversed(open_))
    for middle in ('"', '": null', "", " null", ": null"):
        tail = head + middle if inside or middle in ("", " null", ": null") else head
        for end in (tail, tail.rstrip().rstrip(","), tail.rstrip().rstrip(",").rstrip() + ":null"):
            try:
                json.loads(end + closing)
                return end + closing
            except ValueError:
                pass
    return text


class Assignments:
    """A model's assignments of families' rows, kept as tables: a chunk's are written when it is done, not held on the driver."""

    def __init__(self, entries: DataFrame):
        self.spark, self.entries = entries.sparkSession, entries
        self.rows = cut(families.family_rows(entries))
        self.total = self.rows.count()
        self.parts: list[DataFrame] = []
        self.held: list[tuple[int, str, float, str]] = []
        self.catalogue: list[dict] = []

    def chunk(self, at: int, size: int) -> list[dict]:
        part = families.payload(self.rows.where(F.col("fid").between(at, at + size - 1))).orderBy("fid").collect()  # at most MOST_CHUNK rows
        return [json.loads(r["json"]) for r in part]

    def add_categories(self, answer: dict) -> None:
        """Those an answer proposes, under either of two keys; the first of an id counts."""
        known = {c["id"] for c in self.catalogue}
        for c in [*(answer.get("categories") or []), *(answer.get("new_categories") or [])]:
            if isinstance(c, dict) and c.get("id") and c["id"] not in known:
                self.catalogue.append(c)
                known.add(c["id"])

    def take(self, files: list[dict], answer: dict) -> set[int]:
        """Of an answer the first assignment of each of the files; gives the numbers that have one."""
        known, wanted = {c["id"] for c in self.catalogue} | {s.CATCH_ALL}, {f["i"] for f in files}
        seen: dict[int, tuple] = {}
        for a in answer.get("assignments", []):
            if isinstance(a, dict) and a.get("i") in wanted and a["i"] not in seen:
                seen[a["i"]] = (a["i"], a.get("c") if a.get("c") in known else s.CATCH_ALL, float(a.get("p") or 0.0), str(a.get("r") or ""))
        self.add(seen.values())
        return set(seen)

    def add(self, rows) -> None:
        self.held += rows
        if len(self.held) >= s.MOST_CHUNK:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.parts.append(cut(self.spark.createDataFrame(self.held, _ASSIGNED)))
            self.held = []

    def rest(self, files: list[dict], done: set[int], category: str = s.CATCH_ALL, score: float = 0.3) -> None:
        self.add((f["i"], category, score, "") for f in files if f["i"] not in done)

    def by_rules(self, files: list[dict], done: set[int]) -> None:
        """Files that no answer has, by the rules on their names."""
        from shelfmark.operators import planner

        left = [(f["i"], f["n"], f.get("x") or "") for f in files if f["i"] not in done]
        if left:
            rows = self.spark.createDataFrame(left, "fid int, name string, ext string").withColumn("excerpt", F.lit(""))
            self.add((r["fid"], r["category_id"], r["score"], r["reason"]) for r in planner.by_rules(rows).collect())

    def done(self) -> DataFrame:
        """(path, category_id, score, reason) of all files."""
        self.flush()
        assigned = self.spark.createDataFrame([], _ASSIGNED)
        for part in self.parts:
            assigned = assigned.unionByName(part)
        return families.propagated(self.entries, self.rows, assigned)


_ASSIGNED = "fid int, category_id string, score double, reason string"
_FAILS = (ValueError, RuntimeError)


def _asked(model: Model, prompt: dict) -> dict:
    """The model's answer, or an empty one if it fails."""
    try:
        answer = model(prompt)
        return answer if isinstance(answer, dict) else {}
    except _FAILS:
        return {}


def _halved(model: Model, prompt: dict) -> dict:
    """The answer for a prompt's files; where the model fails the two halves' answers, down to a single file."""
    try:
        return model(prompt)
    except _FAILS:
        files = prompt["files"]
        if len(files) <= 1:
            return {}
        half = len(files) // 2
        a, b = (_halved(model, prompt | {"files": part}) for part in (files[:half], files[half:]))
        return {k: [*a.get(k, []), *b.get(k, [])] for k in ("new_categories", "categories", "assignments")}


def rolling(entries: DataFrame, model: Model, context: int, chunk: int | None = None) -> tuple[DataFrame, list[dict]]:
    """Assignments of all files and the catalogue, by sweeping the families' rows in chunks that shrink as the catalogue grows.

    ``model`` gets {'categories': [...], 'files': [{i, n, m, p, x, c}]} and gives {'new_categories': [...], 'assignments':
    [{i, c, p, r}]}. If it fails for a chunk with a ValueError or a RuntimeError, the chunk goes to the catch-all; the first
    assignment of a row counts, and rows it leaves out go to the catch-all.
    """
    work, at = Assignments(entries), 1
    while at <= work.total:
        room = (context - (s.SYSTEM_TOKENS + len(work.catalogue) * s.CATEGORY_TOKENS + s.RESPONSE_TOKENS)) // s.ROW_TOKENS
        size = chunk or max(1, min(room, s.MOST_CHUNK))
        files = work.chunk(at, size)
        answer = _asked(model, {"categories": work.catalogue, "files": files})
        work.add_categories(answer)
        work.rest(files, work.take(files, answer))
        at += size
    return work.done(), work.catalogue


def _merged_catalogue(model: Model, found: list[dict]) -> list[dict]:
    """The catalogue that a model makes of all proposals; the proposals if it makes none."""
    return [c for c in _asked(model, {"task": "merge", "categories": found}).get("categories", []) if isinstance(c, dict) and c.get("id")] or found


def _assign(work: Assignments, model: Model, size: int) -> None:
    for at in range(1, work.total + 1, size):
        files = work.chunk(at, size)
        work.by_rules(files, work.take(files, _halved(model, {"task": "assign", "categories": work.catalogue, "files": files})))


def microbatch(entries: DataFrame, model: Model, size: int = 12) -> tuple[DataFrame, list[dict]]:
    """Small batches: each proposes categories, the proposals are merged, and each batch is assigned to what they became.

    ``model`` gets a 'task' of 'discover' (files), 'merge' (categories) or 'assign' (categories, files). A batch that
    fails is halved until it is a single row; rows without an assignment go by the rules.
    """
    work = Assignments(entries)
    for at in range(1, work.total + 1, size):
        work.add_categories(_halved(model, {"task": "discover", "files": work.chunk(at, size)}))
    found, work.catalogue = work.catalogue, []
    work.add_categories({"categories": _merged_catalogue(model, found) if found else []})
    _assign(work, model, size)
    return work.done(), work.catalogue


def single_call(entries: DataFrame, model: Model, most: int = 120, size: int = 30) -> tuple[DataFrame, list[dict]]:
    """One call designs the catalogue: of all rows, which it then assigns too, or of a systematic sample of ``most`` if there are more, and the rows are assigned in chunks."""
    work = Assignments(entries)
    sample = [json.loads(r["json"]) for r in families.payload(systematic_sample(work.rows, most)).collect()]
    answer = _asked(model, {"task": "plan", "files": sample})
    work.add_categories(answer)
    if work.total <= most:
        work.by_rules(sample, work.take(sample, answer))
    else:
        _assign(work, model, size)
    return work.done(), work.catalogue


def two_stage(entries: DataFrame, model: Model, size: int = 60) -> tuple[DataFrame, list[dict]]:
    """Categories first, batch by batch and merged if there was more than one; then each batch is assigned, by halves or the rules where it fails."""
    work, batches = Assignments(entries), 0
    for at in range(1, work.total + 1, size):
        work.add_categories(_asked(model, {"task": "discover", "files": work.chunk(at, size)}))
        batches += 1
    if batches > 1 and work.catalogue:
        found, work.catalogue = work.catalogue, []
        work.add_categories({"categories": _merged_catalogue(model, found)})
    _assign(work, model, size)
    return work.done(), work.catalogue


def systematic_sample(rows: DataFrame, most: int = 120) -> DataFrame:
    """Every so-many-th row of the families for one call that designs the catalogue; a sample is the feature."""
    step = max(1, rows.count() // most)
    return rows.where((F.col("fid") - 1) % step == 0).orderBy("fid").limit(most)


def consolidate(assigned: DataFrame, catalogue: list[dict], model: Model, least: int = 2) -> tuple[DataFrame, list[dict]]:
    """Assignments and catalogue after the merges a model proposes, from ``least`` categories on; what it proposes to split stays.

    ``model`` gets {'task': 'consolidate', 'categories': [...]} and gives {'merges': [{'drop', 'keep'}]}. Merges that drop
    or keep an unknown category, or drop one twice, don't count.
    """
    from shelfmark.operators import planner

    if len(catalogue) < least:
        return assigned, catalogue
    known, drops = {c["id"] for c in catalogue}, {}
    for m in _asked(model, {"task": "consolidate", "categories": catalogue}).get("merges", []):
        if isinstance(m, dict) and m.get("drop") in known and m.get("keep") in known and m["drop"] != m["keep"]:
            drops.setdefault(m["drop"], m["keep"])
    if not drops:
        return assigned, catalogue
    table = assigned.sparkSession.createDataFrame(list(drops.items()), "drop string, keep string")
    return planner.merged(assigned, table), [c for c in catalogue if c["id"] not in drops]


def plan(entries: DataFrame, model: Model | None = None, context: int = 8_192, mode: str = "auto", economy: bool = False, budget: int = 2_000) -> tuple[DataFrame, list[dict]]:
    """Assignments (path, category_id, score, reason) and new categories, by the way that suits the model.

    Without a model by rules. With one, the first of these that gives a catalogue: rolling chunks if there are enough
    files and the model takes enough at once; small batches if ``mode`` is 'on', or 'auto' and the prompt is too large;
    a single call with ``economy``; else two stages. If none does, by rules.
    """
    from shelfmark.operators import planner

    by_rules = planner.rule_plan(entries).select("path", "category_id", "score", "reason")
    if model is None:
        return by_rules, []
    ways = []
    capacity = (context - s.SYSTEM_TOKENS - 10 * s.CATEGORY_TOKENS - s.RESPONSE_TOKENS) // s.ROW_TOKENS
    if capacity >= s.LEAST_CHUNK and entries.limit(s.LEAST_CHUNK).count() >= s.LEAST_CHUNK:
        ways.append(lambda: rolling(entries, model, context))
    chars = entries.agg(F.sum(F.length("name") + F.least(F.length(F.coalesce("excerpt", F.lit(""))), F.lit(1_200)))).first()[0] or 0
    if mode == "on" or (mode == "auto" and chars // 3 > max(1_024, context - budget)):
        ways.append(lambda: microbatch(entries, model))
    ways.append((lambda: single_call(entries, model)) if economy else (lambda: two_stage(entries, model)))
    for way in ways:
        try:
            out, catalogue = way()
        except _FAILS:
            continue
        if catalogue:
            return out, catalogue
    return by_rules, []
