"""Evaluation passages in training text.

Items and documents are split into words and each word is canonicalised: numbers, names and units become typed
placeholders, everything else stays. Windows of ten canonical words are hash-joined, so a question whose numbers and
names were exchanged still meets its item; a window needs LEAST_FIXED words that are no placeholders for that, else it
is joined as it is written. The slots of the joined windows then decide: equal everywhere is a verbatim passage, a
one-to-one renaming of slot values over all windows of the pair is a re-parameterised one, anything else is only a
common template.

What is a name or a unit is learnt from all items together: by capitals and the words before, not by how rare it is.
What was learnt and the items' windows are Bloom filters of a size that doesn't grow with the items beyond a bound;
they are united in Spark, and the corpus is read once. Documents' windows that don't pass stay in the Python worker. Items
and documents are canonicalised by the same filters, so what a filter takes for a name by chance is one on both sides.
The join on the hash itself is exact.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrow import Filter, filter_of, over_batches, strings
from shelfmark.session import cut

WORD = re.compile(r"[^\W_]+")
WIDTH = 10
#: Words of a window that are no placeholders, at least, for its template to mean something.
LEAST_FIXED = 4
#: Windows of a pair, at least, for its passage to be a re-parameterised one: with fewer it is a turn of phrase.
LEAST_WINDOWS = 3
#: log2 of bits: of the words' filters, and of the windows' at most (64 MB); and least bits for each thing in one.
WORD_BITS, WINDOW_BITS, BITS_EACH = 23, 29, 16
#: Uses of a word after a number that make it a unit, and their share of its uses.
UNIT_USES, UNIT_SHARE = 3, 0.8

#: Units, in the languages of the corpus. A unit counts as one only right after a number.
UNITS = frozenset(
    """grams gram kilos kilo kilograms metres meters miles litres liters minutes hours days nights weeks months years coins
    gramm kilo meter liter minuten stunden tage tagen nächte nächten wochen monate monaten jahre jahren münzen
    grammes mètres litres heures jours nuits semaines mois ans pièces
    gramos metros litros minutos horas días noches semanas meses años monedas
    граммов метров литров минут часов дней ночей недель месяцев лет монет
    그램 미터 리터 분 시간 일 밤 주 개월 년""".split()
)
#: Words before a noun in languages that write all nouns with a capital. A word that mostly follows one is no name.
BEFORE_NOUNS = frozenset(
    """der die das den dem des ein eine einen einem einer eines kein keine keinen keinem keiner keines
    im am zum zur vom beim ins ans jeder jede jedes jeden jedem dieser diese dieses diesen diesem welcher welche welches welchen welchem""".split()
)

_NUM = re.compile(r"\d+(.*)$")
_MIXED = re.compile(r"[a-z]+([가-힣]+)$")
_INSIDE = re.compile(r"[^\s.!?:¿¡„“«\"(。！？]\s*$")


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s)


@dataclass
class Lexicon:
    """Words of the items, and which of them are names and units; by lower-case words."""

    words: Filter
    names: Filter
    units: Filter

    def forms(self, words: list[str]) -> list[tuple[str, bool, bool]]:
        """For each word as written its template form, whether it is a slot, and whether it may be a unit. Words that are equal in lower case and occur in an item have equal forms."""
        low = [w.lower() for w in words]
        h = np.fromiter(map(_hash, low), np.uint64, len(low))
        known, name, unit = (f.has(h) for f in (self.words, self.names, self.units))
        out = []
        for w, x, k, n, u in zip(words, low, known, name, unit, strict=True):
            if m := _NUM.match(x):
                out.append(("\x01num" + m[1], True, False))
            elif m := _MIXED.match(x):
                out.append(("\x01name" + m[1], True, False))
            elif n or (w[0].isupper() and not k):
                out.append(("\x01name", True, False))
            else:
                out.append((x, False, bool(u) or x in UNITS))
        return out


def lexicon(items: DataFrame, text: str = "text") -> Lexicon:
    """Names and units of all items.

    A word is a name if it is written with a capital in each of its uses, inside a sentence at least once, and doesn't
    mostly follow a word of BEFORE_NOUNS; a unit if UNIT_SHARE of at least UNIT_USES uses follow a number.
    """

    def make():
        def step(batch: pa.RecordBatch):
            total: dict[str, list[int]] = defaultdict(lambda: [0] * 5)
            for t in strings(batch.column(0)):
                before = ""
                for m in WORD.finditer(t):
                    w = m.group()
                    low = w.lower()
                    n = total[low]
                    n[0] += 1
                    n[1] += w[0].isupper()
                    n[2] += w[0].isupper() and _INSIDE.search(t[max(0, m.start() - 3) : m.start()]) is not None
                    n[3] += before in BEFORE_NOUNS
                    n[4] += before.isdigit()
                    before = low
            if not total:
                return None
            return pa.record_batch([pa.array(list(total)), *[pa.array(c, pa.int64()) for c in zip(*total.values(), strict=True)]], names=["word", "n", "capital", "inside", "noun", "number"])

        return step

    parts = over_batches(items.select(F.col(text).alias("_t")), "_t", "word string, n bigint, capital bigint, inside bigint, noun bigint, number bigint", make)
    words = cut(parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "capital", "inside", "noun", "number")]))
    name = "capital = n AND inside > 0 AND 2 * noun < n AND length(word) > 1"
    unit = f"number >= {UNIT_USES} AND number >= {UNIT_SHARE} * n"

    def of(condition: str) -> Filter:
        def hashes(batches):
            for batch in batches:
                yield pa.record_batch([pa.array(np.fromiter(map(_hash, batch.column(0).to_pylist()), np.uint64, batch.num_rows).view(np.int64))], names=["h"])

        return filter_of(words.where(condition).select("word").mapInArrow(hashes, "h bigint"), WORD_BITS)

    return Lexicon(of("true"), of(name), of(unit))


_UNIT_HASH = np.uint64(_hash("\x01unit"))
_POWERS = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(64)], dtype=np.uint64)
_LITERAL = np.uint64(_hash("\x01literal"))


def _sums(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += h[j : j + n] * _POWERS[j]
    return total


def _mixed(total: np.ndarray) -> np.ndarray:
    total = (total ^ total >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ total >> np.uint64(32)


def windows(df: DataFrame, key: str, text: str, lexicon: Lexicon, width: int = WIDTH, wanted: Filter | None = None, prefix: str = "") -> DataFrame:
    """(key, pos, hash, words, slots) of the canonical windows; with ``wanted`` only of those that pass the filter.

    A window of too few fixed words has no slots and the hash of its words. A window that begins with a unit is given
    twice, with the unit as a slot and as a word, as what makes it a unit lies outside.
    """

    def make():
        codes: dict[str, tuple[int, int, bool, bool, bool]] = {}

        def learn(words: set[str]) -> None:
            new = [w for w in words if w not in codes]
            for w, (form, slot, unit) in zip(new, lexicon.forms(new), strict=True):
                codes[w] = (_hash(form), _hash(w.lower()), slot, unit, form == "\x01num")

        def step(batch: pa.RecordBatch):
            words = [WORD.findall(t) for t in strings(batch.column(1))]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            flat = [w for ws in words for w in ws]
            if len(flat) < width:
                return None
            if len(codes) > 500_000:
                codes.clear()
            learn(set(flat))
            table = [codes[w] for w in flat]
            h = np.fromiter((c[0] for c in table), np.uint64, len(flat))
            own = np.fromiter((c[1] for c in table), np.uint64, len(flat))
            slot = np.fromiter((c[2] for c in table), bool, len(flat))
            unit = np.fromiter((c[3] for c in table), bool, len(flat))
            number = np.fromiter((c[4] for c in table), bool, len(flat))
            doc = np.repeat(np.arange(len(words)), sizes)
            unit[1:] &= number[:-1] & (doc[1:] == doc[:-1])
            unit[0] = False
            plain, bare = h.copy(), slot.copy()
            h[unit] = _UNIT_HASH
            slot |= unit
            n = len(flat) - width + 1
            fixed = np.convolve(~slot, np.ones(width, np.int64), "valid")
            total, literal = _sums(h, width), _sums(own, width) ^ _LITERAL
            hashes = _mixed(np.where(fixed >= LEAST_FIXED, total, literal))
            # what makes a window's first word a unit lies outside it
            first = _mixed(total + (plain[:n] - h[:n]) * _POWERS[0])
            keep = doc[:n] == doc[width - 1 :]
            also = keep & unit[:n] & (fixed + 1 >= LEAST_FIXED)
            if wanted is not None:
                keep &= wanted.has(hashes)
                also &= wanted.has(first)
            whole, again = np.flatnonzero(keep), np.flatnonzero(also)
            at = np.concatenate([whole, again])
            starts = np.concatenate([[0], np.cumsum(sizes)])
            slots = [slot[i : i + width].tolist() if fixed[i] >= LEAST_FIXED else [False] * width for i in whole]
            return pa.record_batch(
                [
                    batch.column(0).take(pa.array(doc[at])),
                    pa.array(at - starts[doc[at]], pa.int32()),
                    pa.array(np.concatenate([hashes[whole], first[again]]).view(np.int64)),
                    pa.array([[w.lower() for w in flat[i : i + width]] for i in at], pa.list_(pa.string())),
                    pa.array(slots + [[bool(bare[i]), *slot[i + 1 : i + width].tolist()] for i in again], pa.list_(pa.bool_())),
                ],
                names=[prefix + c for c in ("key", "pos", "hash", "words", "slots")],
            )

        return step

    schema = ", ".join(prefix + c for c in (f"key {dict(df.dtypes)[key]}", "pos int", "hash bigint", "words array<string>", "slots array<boolean>"))
    return over_batches(df.select(key, text), text, schema, make)


def template_matches(
    documents: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    doc_text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
) -> DataFrame:
    """Windows that a document and an item share up to their slots: (key, pos, words, i_key, i_pos, i_words, slots).

    Null and empty texts, and those of fewer than ``width`` words, have no windows. Repeated rows are each matched
    under their own key. Two windows that begin with the same unit may be given twice. Extra columns aren't read.
    """
    items = items.where(F.col(item_text).isNotNull()).select(item_key, item_text)
    learnt = lexicon(items, item_text)
    theirs = cut(windows(items, item_key, item_text, learnt, width, prefix="i_"))
    bits = min(WINDOW_BITS, max(20, math.ceil(math.log2(BITS_EACH * (theirs.count() + 1)))))
    ours = windows(documents, doc_key, doc_text, learnt, width, filter_of(theirs.select("i_hash"), bits))
    fixed = lambda words, slots: F.transform(F.arrays_zip(F.col(words).alias("w"), F.col(slots).alias("s")), lambda x: F.when(~x["s"], x["w"]))
    return ours.join(theirs, (F.col("hash") == F.col("i_hash")) & (fixed("words", "slots") == fixed("i_words", "i_slots")))


def verbatim(matches: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(document, item) with at least one window equal in all words, slots included."""
    return matches.where(F.col("words") == F.col("i_words")).select(F.col("key").alias(doc_key), F.col("i_key").alias(item_key)).distinct()


def leaks(matches: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(document, item, kind, n_windows, n_verbatim) for each pair that shares a template window.

    ``kind``: 'verbatim' if a window is equal in all words; 'reparameterised' if it has LEAST_WINDOWS windows and the
    pairs of slot values over all of them form a one-to-one renaming; else 'template'.
    """
    pairs = F.filter(F.arrays_zip(F.col("i_words").alias("a"), F.col("words").alias("b"), F.col("slots").alias("s")), lambda x: x["s"])
    per = matches.select(
        "key", "i_key", "pos", (F.col("words") == F.col("i_words")).alias("same"), F.transform(pairs, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("p")
    )
    counts = per.groupBy("key", "i_key").agg(F.countDistinct("pos").alias("n_windows"), F.countDistinct(F.when(F.col("same"), F.col("pos"))).alias("n_verbatim"), F.array_distinct(F.flatten(F.collect_set("p"))).alias("p"))
    n = lambda f: F.size(F.array_distinct(F.transform("p", lambda x: x[f])))
    kind = F.when(F.col("n_verbatim") > 0, "verbatim").when((n("a") == F.size("p")) & (n("b") == F.size("p")) & (F.col("n_windows") >= LEAST_WINDOWS), "reparameterised").otherwise("template")
    return counts.select(F.col("key").alias(doc_key), F.col("i_key").alias(item_key), kind.alias("kind"), "n_windows", "n_verbatim")
