"""Text statistics of documents, and text types learnt from thresholds on them.

One pass counts in how many documents of each language a word occurs; words of at least COMMON_SHARE of a language's
documents are its common words. Of a language with fewer than KNOWN documents nothing can be said of its common words:
what depends on them abstains for its documents, so that they are neither held against them nor for them. A second pass gives each document its statistics. Thresholds on the statistics are
labelling functions: each says which text types a document may be, or abstains. How far each can be trusted is learnt
by expectation-maximisation from how they agree, on the histogram of their answers over all documents, whose size is
bounded by the number of answers, not of documents. The posterior type is then an expression in Spark's columns.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrow import over_batches, strings
from shelfmark.session import cut, join_checked

WORD = re.compile(r"[^\W_]+")
SPACES = " \t\n\r\f"
STOP = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*(?=\s|$)")
LINE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
MARKER = re.compile(r"\s*(?:[-*+•◦▪‣·☐☑✓–—]|\[[ xX]?\]|\(?\d{1,4}[.)]|\(?[a-zA-Z가-힣][.)])\s")
CELLS = re.compile(r"[|\t;]|,(?=\S)|\S {3,}\S|^\s*[^:.!?]{1,40}: \S[^.!?]{0,24}$")
DIGITS = re.compile(r"\d+")

#: A common word is in at least this share of a language's documents; of how many documents at least that can be told.
COMMON_SHARE, KNOWN = 0.25, 8
#: A language's code; at most 26^2 + 26^3 of them. All else is UNKNOWN, whose documents are held against the words of all languages.
LANG, UNKNOWN = "^[a-z]{2,3}$", "und"
#: Words of a chunk, for the statistics that are means over chunks.
CHUNK = 20

TYPES = ("prose", "list", "table", "junk")
OTHERS = ("list", "table", "junk")


class Common(NamedTuple):
    """Common words of all languages, and the languages that have some."""

    words: frozenset[str]
    langs: frozenset[str]

    def known(self, lang: str) -> bool:
        return lang in self.langs or lang == UNKNOWN


def _lang(lang: str) -> Column:
    return F.when(F.col(lang).rlike(LANG), F.col(lang)).otherwise(UNKNOWN)


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n_docs): documents of a language with the word; word '' counts all its documents. What is no code is 'und'."""

    def make():
        def step(batch: pa.RecordBatch):
            counts: dict[str, Counter] = {}
            for t, code in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                c = counts.setdefault(code, Counter())
                c.update(set(WORD.findall(t.lower())))
                c[""] += 1
            rows = [(code, w, n) for code, c in counts.items() for w, n in c.items()]
            return pa.record_batch([pa.array(x) for x in zip(*rows, strict=True)], names=["lang", "word", "n_docs"])

        return step

    parts = over_batches(docs.select(F.col(text).alias("_t"), _lang(lang).alias("_l")), "_t", "lang string, word string, n_docs bigint", make)
    return parts.groupBy("lang", "word").agg(F.sum("n_docs").alias("n_docs"))


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> Common:
    """Common words of all languages. At most (mean distinct words of a document) / COMMON_SHARE words for each code of a language."""
    counts = cut(word_counts(docs, text, lang))
    sizes = counts.where((F.col("word") == "") & (F.col("n_docs") >= KNOWN)).select("lang", F.col("n_docs").alias("n"))
    often = counts.where("word != ''").join(F.broadcast(sizes), "lang").where(F.col("n_docs") >= COMMON_SHARE * F.col("n"))  # a row for each code
    return Common(frozenset(r[0] for r in often.select("word").distinct().collect()), frozenset(r[0] for r in sizes.select("lang").collect()))


STATS = (
    "n_words bigint, mean_word_length double, symbol_share double, line_stop_share double, common_share double, digit_share double, "
    "words_per_stop double, words_per_line double, marker_share double, cell_share double, distinct_share double, prose_share double, single_share double, common_known boolean"
)


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def statistics_of(text: str, common: Common, lang: str = UNKNOWN) -> tuple:
    """The statistics of one text, in the order of STATS."""
    low = text.lower()
    words = WORD.findall(low)
    n, size = len(words), len(text)
    in_words = sum(map(len, words))
    letters = in_words if len(low) == size else sum(map(len, WORD.findall(text)))
    spaces = sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip()]
    is_common = [w in common.words for w in words]
    chunks = [(is_common[i : i + CHUNK], words[i : i + CHUNK]) for i in range(0, n, CHUNK)]
    if len(chunks) > 1 and len(chunks[-1][0]) < CHUNK // 2:
        chunks[-1] = (is_common[-CHUNK:], words[-CHUNK:])
    stops = len(STOP.findall(text))
    return (
        n,
        _ratio(in_words, n),
        _ratio(size - letters - spaces, size - spaces),
        _ratio(sum(1 for x in lines if LINE_END.search(x.rstrip())), len(lines)),
        _ratio(sum(is_common), n),
        _ratio(sum(map(len, DIGITS.findall(text))), size - spaces),
        _ratio(n, stops) if stops else float(n),
        _ratio(n, len(lines)),
        _ratio(sum(1 for x in lines if MARKER.match(x)), len(lines)),
        _ratio(sum(1 for x in lines if CELLS.search(x)), len(lines)),
        _ratio(sum(len(set(w)) / len(w) for _, w in chunks), len(chunks)),
        _ratio(sum(1 for c, _ in chunks if sum(c) >= len(c) / 4), len(chunks)),
        _ratio(sum(1 for w in words if len(w) == 1), n),
        common.known(lang),
    )


def with_statistics(docs: DataFrame, common: Common, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, statistics). ``common_known`` tells whether the language has common words to count. Null and empty texts, and texts without words, have 0 for what would be divided by nothing."""

    def make():
        def step(batch: pa.RecordBatch):
            columns = zip(*[statistics_of(t, common, code) for t, code in zip(strings(batch.column(1)), batch.column(2).to_pylist(), strict=True)], strict=True)
            return pa.record_batch([batch.column(0), *[pa.array(c) for c in columns]], names=["_k", *[x.split()[0] for x in STATS.split(", ")]])

        return step

    out = over_batches(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), _lang(lang).alias("_l")), "_t", f"_k {dict(docs.dtypes)[key]}, {STATS}", make)
    return out.withColumnRenamed("_k", key)


def labelling_functions() -> dict[str, list[tuple[Column, tuple[str, ...]]]]:
    """Name -> answers in order of precedence: a condition, and the types it speaks for. No condition met: it abstains."""
    c = F.col
    known = lambda name: F.when(c("common_known"), c(name))
    share, chunks = known("common_share"), known("prose_share")
    return {
        "common words": [(share >= 0.45, ("prose",)), (share >= 0.28, ("prose",)), (share < 0.05, OTHERS), (share < 0.13, OTHERS)],
        "chunks of prose": [(chunks >= 0.5, ("prose",)), (chunks < 0.5, OTHERS)],
        "words to a stop": [(c("words_per_stop").between(5, 45), ("prose",)), (c("n_words") > 0, OTHERS)],
        "words to a line": [(c("words_per_line") >= 8, ("prose",)), (c("words_per_line") < 5, ("list", "table"))],
        "lines that end in a stop": [(c("line_stop_share") >= 0.5, ("prose",)), (c("line_stop_share") < 0.1, OTHERS)],
        "markers": [(c("marker_share") >= 0.5, ("list",))],
        "cells": [(c("cell_share") >= 0.5, ("table",))],
        "repetition": [(c("distinct_share") < 0.5, ("junk",)), (c("distinct_share") < 0.75, OTHERS)],
        "word length": [(~c("mean_word_length").between(2.2, 12), ("junk",))],
        "symbols": [(c("symbol_share") >= 0.25, ("junk", "table")), (c("symbol_share") < 0.06, ("prose", "list"))],
        "digits": [(c("digit_share") >= 0.1, ("table", "junk"))],
        "single letters": [(c("single_share") >= 0.3, ("junk",))],
    }


def votes() -> dict[str, Column]:
    """Each labelling function's answer: the number of the condition that holds, or the number of conditions if it abstains."""
    out = {}
    for name, answers in labelling_functions().items():
        e = F.lit(len(answers))
        for i, (condition, _) in reversed(list(enumerate(answers))):
            e = F.when(condition, i).otherwise(e)
        out[name] = e
    return out


def learn(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, list[np.ndarray]]:
    """Prior of the types and, for each labelling function, P(answer | type), by expectation-maximisation.

    It starts from the types each answer speaks for; those starts also stay as a weak prior of ``strength`` documents.
    """
    strength = 20.0
    start = []
    for answers in labelling_functions().values():
        p = np.full((len(answers) + 1, len(TYPES)), 0.15)
        p[-1] = 0.3
        for i, (_, types) in enumerate(answers):
            for t in types:
                p[i, TYPES.index(t)] = 0.7
        start.append(p / p.sum(0))
    prior, given = np.array([0.7, 0.1, 0.1, 0.1]), start
    for _ in range(rounds):
        post = posterior(patterns, prior, given) * counts[:, None]
        prior = (post.sum(0) + 1) / (post.sum() + len(TYPES))
        given = []
        for j, s in enumerate(start):
            p = s * strength
            np.add.at(p, patterns[:, j], post)
            given.append(p / p.sum(0))
    return prior, given


def posterior(patterns: np.ndarray, prior: np.ndarray, given: list[np.ndarray]) -> np.ndarray:
    logs = np.log(prior)[None] + sum(np.log(g[patterns[:, j]]) for j, g in enumerate(given))
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _pattern() -> Column:
    """All answers as one number."""
    code, base = F.lit(0).cast("bigint"), 1
    for (_, answers), vote in zip(labelling_functions().items(), votes().values(), strict=True):
        code = code + vote * base
        base *= len(answers) + 1
    return code


def _unpacked(codes: np.ndarray) -> np.ndarray:
    out = []
    for answers in labelling_functions().values():
        codes, answer = np.divmod(codes, len(answers) + 1)
        out.append(answer)
    return np.stack(out, axis=1)


def fit(stats: DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The patterns of answers that occur, and what is learnt from how often: at most 5 * 3^6 * 2^5 patterns whatever the number of documents."""
    rows = stats.groupBy(_pattern().alias("p")).count().collect()
    codes = np.array([r[0] for r in rows], np.int64)
    return codes, *learn(_unpacked(codes), np.array([r[1] for r in rows], float))


def with_types(stats: DataFrame, model: tuple[np.ndarray, np.ndarray, list[np.ndarray]]) -> DataFrame:
    """``stats`` with the posterior of each type (p_prose, ...) and the likeliest as text_type. A text without words is junk."""
    codes, prior, given = model
    post = posterior(_unpacked(codes), prior, given)
    rows = [(int(c), *map(float, p)) for c, p in zip(codes, post, strict=True)]
    table = stats.sparkSession.createDataFrame(rows, "_p bigint, " + ", ".join(f"_{t} double" for t in TYPES))
    scored = join_checked(stats.withColumn("_p", _pattern()), table, "_p", "left")
    none = F.col("n_words") == 0
    p = {f"p_{t}": F.when(none, float(t == "junk")).otherwise(F.col(f"_{t}")) for t in TYPES}
    best = F.greatest(*[F.col(n) for n in p])
    kind = F.coalesce(*[F.when(F.col(f"p_{t}") == best, t) for t in TYPES])
    return scored.withColumns(p).withColumn("text_type", kind).drop("_p", *[f"_{t}" for t in TYPES])


def text_types(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Statistics, posteriors and text type of each row of ``docs``; repeated rows each get theirs. Extra columns aren't read."""
    stats = cut(with_statistics(docs, common_words(docs, text, lang), key, text, lang))
    return with_types(stats, fit(stats))
