"""Text that looks the same in one consistent form.

The form: composed accents and syllables (NFC), characters of ordinary width, plain spaces, nothing invisible, no
ligatures, each word in letters of one script. Characters are stable if the form keeps them whatever stands around
them, which normalisation's quick-check property and a few character classes tell. Only segments of unstable
characters, with the stable character before them as context, are normalised and spliced into the unchanged rest; a
value without any is not touched. Superscripts, fractions, signs and the like, which differ in look, stay, and so do
joiners where scripts and emoji need them and slashes that only look like a path's.

Letters that look alike are those that Unicode's table of confusables gives one skeleton; it comes with Spark, in ICU.
"""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.arrow import over_batches

#: Letters that look like a Latin letter, Cyrillic and Greek.
CYRILLIC_LOOKS = dict(zip("АВЕКМНОРСТУХІЈЅЁЇҮӀаеорсухіјѕёїһԁԛԝүӏ", "ABEKMHOPCTYXIJSËÏYIaeopcyxijsëïhdqwyl", strict=True))
GREEK_LOOKS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχϳ", "ABEZHIKMNOPTYXaikvopuxj", strict=True))
GREEK_CYRILLIC = dict(zip("ΑΒΕΗΚΜΟΡΤΥΧΓΠΦοαρχκ", "АВЕНКМОРТУХГПФоархк", strict=True))

_TO = {
    ("cyrillic", "latin"): CYRILLIC_LOOKS,
    ("greek", "latin"): GREEK_LOOKS,
    ("greek", "cyrillic"): GREEK_CYRILLIC,
    ("latin", "cyrillic"): {v: k for k, v in reversed(CYRILLIC_LOOKS.items())},
    ("latin", "greek"): {v: k for k, v in reversed(GREEK_LOOKS.items())},
    ("cyrillic", "greek"): {v: k for k, v in reversed(GREEK_CYRILLIC.items())},
}
WORD = re.compile(r"(?:[^\W_][\u0300-\u036f]*)+")
_SCRIPTS = re.compile("[A-Za-zÀ-ɏḀ-ỿ]|([Ͱ-Ͽἀ-῾])|([Ѐ-ԯ])")
#: Letters of alphabets beside Latin, by the first word of their names in Unicode; other scripts may share a word with Latin.
ALPHABETS = ("ARMENIAN", "CHEROKEE", "COPTIC", "CYRILLIC", "DESERET", "GEORGIAN", "GREEK", "LISU")
_FOREIGN = re.compile("[Ͱ-֏Ⴀ-ჿᎠ-᏿ᲀ-ᲈἀ-῾Ⲁ-⳿ꓐ-꓿Ꙁ-ꚟꭰ-ꮿ\U00010400-\U0001044f]")
#: Hyphens that look like the plain one; between letters they are it.
_HYPHENS = re.compile(r"(?<=[^\W\d_])[‐‑−](?=[^\W\d_])")
#: Scripts whose letters a joiner after them tells apart: Arabic to Mongolian, but for Georgian, Hangul and Cherokee.
_JOINING = re.compile("[\u0600-\u109f\u1780-\u18af\ufb50-\ufdff]")
_JOINERS = "\u200c\u200d"
#: More look-alikes of Latin letters, by alphabet: filled by ``learn_looks``.
LOOKS: dict[str, dict[str, str]] = {}


def looks(spark: SparkSession) -> dict[str, dict[str, str]]:
    """Alphabet -> letter -> the Latin letter of the same skeleton and case."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    ascii_letters = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    skeleton = {}
    for c in ascii_letters:
        skeleton.setdefault((checker.getSkeleton(c), c.isupper()), c)
    letters = [chr(c) for c in range(0x370, 0x10450) if _FOREIGN.match(chr(c)) and chr(c).isalpha()]
    parts = checker.getSkeleton("\n".join(letters)).split("\n")  # one call; skeletons of letters hold no line breaks
    out: dict[str, dict[str, str]] = {}
    for c, k in zip(letters, parts, strict=True):
        like = skeleton.get((k, c.isupper() or not c.islower())) or skeleton.get((k, not c.isupper()))
        alphabet = ud.name(c, "").split(" ")[0]
        if like and alphabet in ALPHABETS:
            out.setdefault(alphabet.lower(), {})[c] = like
    return out


def learn_looks(table: dict[str, dict[str, str]]) -> None:
    """Takes these look-alikes of Latin letters beside those of the fixed tables, which come first."""
    LOOKS.clear()
    LOOKS.update({script: letters | {"cyrillic": CYRILLIC_LOOKS, "greek": GREEK_LOOKS}.get(script, {}) for script, letters in table.items()})


def fold(c: str) -> str:
    """What the form writes for one character, before composition."""
    kind = ud.category(c)
    if kind == "Zs":
        return " "
    if kind in ("Zl", "Zp"):
        return "\n"
    if kind == "Cf" or (kind == "Cc" and c not in "\t\n\r") or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef" or c in "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ":
        return ""
    tag = ud.decomposition(c).split(" ")[0]
    if tag in ("<wide>", "<narrow>") or "ﬀ" <= c <= "ﬆ" or "ﬓ" <= c <= "ﬗ" or "\U0001d400" <= c <= "\U0001d7ff":
        return ud.normalize("NFKC", c)
    return c


@cache
def unstable() -> re.Pattern:
    """Runs of characters that the form may not keep: folded, not allowed in NFC, or able to join the one before (quick check No or Maybe)."""
    second = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    odd = set()
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or code < 0x80 and c.isprintable():
            continue
        parts = ud.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and ud.normalize("NFC", c) == c:
            second.add(chr(int(parts[1], 16)))
        if ud.combining(c) or fold(c) != c or ud.normalize("NFC", c) != c:
            odd.add(code)
    odd |= {ord(c) for c in second}
    ranges, start = [], None
    for code in sorted(odd):
        if start is None or code != last + 1:
            if start is not None:
                ranges.append((start, last))
            start = code
        last = code
    ranges.append((start, last))
    body = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return re.compile(f"[^{body}]?[{body}]+", re.DOTALL)


def folded(part: str) -> str:
    """Each character as the form writes it; a joiner stays after a letter or sign that needs it."""
    if "\u200c" not in part and "\u200d" not in part:
        return "".join(map(fold, part))
    out = ""
    for c in part:
        before = out[-1:]
        needed = c in _JOINERS and before and (_JOINING.match(before) or (c == "\u200d" and ud.category(before) in ("So", "Sk")))
        out += c if needed else fold(c)
    return out


def _segment(m: re.Match) -> str:
    return ud.normalize("NFC", folded(m.group()))


@cache
def _script(c: str) -> str | None:
    m = _SCRIPTS.match(c)
    if m:
        return "greek" if m[1] else "cyrillic" if m[2] else "latin"
    if _FOREIGN.match(c) and (first := ud.name(c, "").split(" ")[0]) in ALPHABETS:
        return first.lower()
    return None


def _like(s: str, target: str) -> dict[str, str]:
    return LOOKS[s] if target == "latin" and s in LOOKS else _TO.get((s, target), {})


def one_script(word: str) -> str:
    """The word in letters of one script, or as it is if its foreign letters don't all have a like one in any of its scripts.

    Of several possible scripts the one with most letters that no other script of the word could have written is taken,
    then the one with most letters, then Latin.
    """
    by: dict[str, list[str]] = {}
    for c in word:
        if s := _script(c):
            by.setdefault(s, []).append(c)
    if len(by) < 2:
        return word
    best = None
    for target in sorted(by, key=lambda s: (("latin", "cyrillic", "greek").index(s) if s in ("latin", "cyrillic", "greek") else 3, s)):
        others = [(s, c) for s in by if s != target for c in by[s]]
        if all(c in _like(s, target) for s, c in others):
            own = sum(all(c not in _like(target, s) for s in by if s != target) for c in by[target])
            rank = (own, len(by[target]))
            if best is None or rank > best[0]:
                best = (rank, target)
    if best is None:
        return word
    target = best[1]
    return ud.normalize("NFC", "".join(c if (s := _script(c)) in (None, target) else _like(s, target)[c] for c in word))


def mixed(word: str) -> bool:
    return len({_script(c) for c in word} - {None}) > 1


def spoofed(value: str) -> list[str]:
    """Words that are wholly in look-alikes of Latin letters, beside Latin words but none of their own alphabet.

    Such a word is in one script, so it stays as it is and is in the form; that it reads as another word is only told.
    """
    if not _FOREIGN.search(value):
        return []
    scripts = [(w, {s for c in w if (s := _script(c))}) for w in WORD.findall(value)]
    alone = lambda w, s: len(s) == 1 and "latin" not in s and all(c in _like(next(iter(s)), "latin") for c in w if _script(c))
    odd = [(w, s) for w, s in scripts if alone(w, s)]
    plain = [s for w, s in scripts if s and not alone(w, s)]
    return [w for w, s in odd if {"latin"} in plain and not any(s & p for p in plain)]


def canonical(value: str) -> str:
    """The consistent form of a value; it is its own form, and a value in the form comes out as it is."""
    if value.isascii() and value.isprintable():
        return value
    out = _HYPHENS.sub("-", unstable().sub(_segment, value))
    if _FOREIGN.search(out):
        out = WORD.sub(lambda m: one_script(m.group()), out)
    return out


def is_canonical(value: str) -> bool:
    return canonical(value) == value and not (_FOREIGN.search(value) and any(map(mixed, WORD.findall(value))))


def forms(df: DataFrame, key: str, fields: list[str], skip=None, changed_only: bool = False) -> DataFrame:
    """(key, field, value, canonical, was_canonical, spoofed) for every row and field; with ``changed_only`` those that weren't in the form.

    ``skip``: field -> a function of a value (made in the task) that tells whether it is left alone, as for text in the
    wrong encoding. A null stays null and counts as being in the form, an empty text too. Repeated rows each come out.
    Printable ASCII never leaves the JVM when only changed values are asked for. Extra columns aren't read.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    values = df.select(F.col(key).alias("_k"), each.alias("_e")).select("_k", "_e.field", F.col("_e.value").alias("_t"))
    if changed_only:
        values = values.where(F.col("_t").rlike(r"[^ -~\t\n\r]"))
    skip = skip or {}
    table = looks(df.sparkSession)  # some hundred letters

    def make():
        learn_looks(table)
        alone = {f: g() for f, g in skip.items()}
        known: dict[tuple[bool, str], tuple[str, bool, list[str]]] = {}

        def look(field: str, value: str | None):
            if value is None:
                return None, True, []
            at = (field in alone, value)
            if at not in known:
                if len(known) > 100_000:
                    known.clear()
                fine = is_canonical(value)
                left = fine or (field in alone and alone[field](value))
                known[at] = (value, True, spoofed(value)) if left else ((new := canonical(value)), False, spoofed(new))
            return known[at]

        def step(batch: pa.RecordBatch):
            fields_, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            got = [look(f, t) for f, t in zip(fields_, texts, strict=True)]
            rows = pa.array([i for i, g in enumerate(got) if not (changed_only and g[1])], pa.int64())
            full = [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] for g in got], pa.list_(pa.string()))]
            return pa.record_batch([c.take(rows) for c in full], names=["key", "field", "value", "canonical", "was_canonical", "spoofed"])

        return step

    schema = f"key {dict(df.dtypes)[key]}, field string, value string, canonical string, was_canonical boolean, spoofed array<string>"
    return over_batches(values, "_t", schema, make)
