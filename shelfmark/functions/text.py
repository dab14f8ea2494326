"""Column functions on names, paths and texts. A null gives null unless said otherwise; all stay in the JVM but those at the end."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import schema as s


def _drop(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def _in(x: Column, values: Sequence[str]) -> Column:
    return x.isin(list(values))


# --- file names -------------------------------------------------------------------------------------------------


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; '' without one."""
    return F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,6})$", 1))


def strip_ext(name: Column) -> Column:
    return _drop(F.coalesce(name, F.lit("")), s.EXTENSION_TAIL)


def strip_core(stem: Column) -> Column:
    """What tells a project: without sort numbers, student heads and any stack of clerical tails."""
    head = _drop(_drop(F.regexp_replace(stem, r"^\s+|\s+$", ""), s.NUMBER_HEAD), s.STUDENT_HEAD)
    return _drop(_drop(head, "(?iu)" + s.CLERICAL_TAIL), r"\s+$")


#: Classes of characters and what stands for a run of each, in this order; private-use characters keep them apart.
SCHEMA_RUNS = (("[가-힣]+", ""), ("[A-Za-z]+", ""), ("[0-9]+", ""), (r"[_\-. ()\[\]{}<>·]+", ""), ("[^-]+", ""))
SCHEMA_LETTERS = ("", "KANSP")


def schema_sequence(stem: Column) -> Column:
    """Runs of Korean, Latin letters, digits, separators and the rest as K, A, N, S, P."""
    runs = reduce(lambda c, r: _drop(c, *r), SCHEMA_RUNS, stem)
    return F.translate(runs, *SCHEMA_LETTERS)


def nouns(text: Column, most: int | None = None) -> Column:
    """Candidate nouns in order of first use, without extensions, clerical words and repeats."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(s.NOUN), F.lit(0))
    plain = F.transform(words, lambda w: F.when(w.rlike("^[A-Za-z]"), F.lower(w)).otherwise(w))
    out = F.array_distinct(F.filter(plain, lambda w: ~w.rlike("(?i)" + s.EXTENSION_LIKE) & ~_in(w, s.NOISE_NOUNS)))
    return F.slice(out, 1, most) if most else out


def signature(name: Column, body: Column) -> Column:
    """Key of a family of names: its first nouns, filled up from the body; '' without any."""
    bound = lambda p: rf"(?i)(?<![A-Za-z0-9])(?:{p})(?![A-Za-z0-9])"
    head = _drop(strip_ext(_drop(name, s.DECORATION_HEAD)), s.SHORT_PARENS, " ")
    head = _drop(_drop(_drop(head, bound("|".join(s.DATE_FORMS)), " "), bound(s.VERSION_FORM), " "), "(?i)" + s.SEQUENCE_FORM, " ")
    keep = lambda c: F.filter(c, lambda w: ~_in(w, s.SIGNATURE_NOISE))
    own = keep(nouns(head))
    more = keep(nouns(F.substring(body, 1, 1000), 8))
    both = F.when(F.size(own) < s.SIGNATURE_NOUNS, F.array_distinct(F.concat(own, more))).otherwise(own)
    return F.array_join(F.slice(both, 1, s.SIGNATURE_NOUNS), " ")


def opaque_name(name: Column, ext: Column) -> Column:
    """Whether a name says nothing: numbers, hashes, camera names, or media without a word."""
    stem = F.trim(strip_ext(name))
    auto = reduce(lambda a, b: a | b, [stem.rlike(p) for p in s.OPAQUE_FORMS])
    kind = F.when(F.coalesce(ext, F.lit("")) != "", F.lower(ext)).otherwise(extension(name))
    words = F.filter(F.regexp_extract_all(stem, F.lit("[A-Za-z가-힣]{3,}"), F.lit(0)), lambda w: ~w.rlike(s.CAMERA_WORD))
    silent = _in(kind, ["." + m for m in s.MEDIA]) & (F.size(words) == 0)
    return F.coalesce(name, F.lit("")).isin("") | (stem == "") | auto | silent


def name_tokens(text: Column) -> Column:
    """Distinct substantive tokens of a name or a category's wording."""
    parts = F.split(strip_ext(text), r"[\s_\-\.,()\[\]{}<>]+")
    lower = F.transform(parts, lambda t: F.lower(F.trim(t)))
    good = F.filter(lower, lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$") & ~t.rlike(r"^(?:v\d+|r\d+|[ivxlcdm]+)$") & ~_in(t, s.NAME_STOPS))
    return F.array_distinct(good)


def category_tokens(name: Column, description: Column, keywords: Column | None = None) -> Column:
    """Distinct substantive tokens of a category's wording."""
    words = [F.coalesce(c, F.lit("")) for c in (name, description)] + ([] if keywords is None else [F.array_join(keywords, " ")])
    return name_tokens(F.concat_ws(" ", *words))


def substantive(token: Column) -> Column:
    return (F.length(token) >= 3) | token.rlike("[가-힣]")


def tokens_overlap(a: Column, b: Column) -> Column:
    """Whether two sets of tokens share a substantive one: equal, one in the other, or the same first four characters."""
    near = lambda x, y: (x == y) | x.contains(y) | y.contains(x) | ((F.length(x) >= 4) & (F.length(y) >= 4) & (F.left(x, F.lit(4)) == F.left(y, F.lit(4))))
    return F.exists(F.filter(a, substantive), lambda x: F.exists(F.filter(b, substantive), lambda y: near(x, y)))


def ignored(path: Column, root: Column, patterns: Sequence[str] = s.IGNORED) -> Column:
    """Whether any part of the path below ``root`` matches one of the glob patterns."""
    glob = "|".join("^" + "".join({"*": ".*", "?": "."}.get(ch, ch if ch.isalnum() else "\\" + ch) for ch in p) + "$" for p in patterns)
    below = F.substring(path, F.length(root) + 1, F.length(path))
    return F.exists(F.split(below, "/"), lambda part: part.rlike(glob))


# --- directories ------------------------------------------------------------------------------------------------


def mojibake_hits(text: Column) -> Column:
    """Number of marks of UTF-8 read as Latin-1."""
    return reduce(lambda a, b: a + b, [((F.length(text) - F.length(F.replace(text, F.lit(m)))) / len(m)).cast("int") for m in s.MOJIBAKE_MARKS])


def looks_mojibake(text: Column, strict: bool = False) -> Column:
    """Three marks that are 1 % of a text; strict, for names: three marks or 25 %."""
    hits, size = mojibake_hits(text), F.length(text)
    rule = (hits >= 3) | (hits / F.greatest(size, F.lit(1)) >= 0.25) if strict else (hits >= 3) & (hits >= size * 0.01)
    return F.coalesce(rule & (size > 0), F.lit(False))


def repaired_mojibake(text: Column, strict: bool = False) -> Column:
    """Re-read as UTF-8 where the marks show and the result is sound; else unchanged. Strict: characters beyond Latin-1 as '?'."""
    beyond = r"[^\x{00}-\x{FF}]"

    def sound(c: Column) -> Column:
        back = F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string"))
        return F.when(~looks_mojibake(back, strict), back)

    back = F.when(~text.rlike(beyond), sound(text))
    if strict:  # a lenient decoding without U+FFFD is a valid one
        relaxed = sound(_drop(text, beyond, "?"))
        back = back.otherwise(F.when(~relaxed.contains("\ufffd"), relaxed))
    return F.when(looks_mojibake(text, strict), F.coalesce(back, text)).otherwise(text)


@F.pandas_udf(T.StringType())
def composed(names: pd.Series) -> pd.Series:
    """Normalisation form C, which Spark has no function for."""
    return names.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def sanitize_name(name: Column, fallback: str = "folder") -> Column:
    """A name that file systems take; ``fallback`` if too little is left; from a name in composed form (see ``composed``)."""
    leak = lambda c: F.trim(_drop(_drop(_drop(c, s.JSON_HEAD), s.JSON_KEY), s.JSON_TAIL))
    c = leak(leak(leak(F.trim(name))))
    c = _drop(_drop(_drop(_drop(c, s.INVALID, "_"), r"[_\s]{2,}", " "), r"^[ _]+|[ _]+$"), r"[. ]+$")
    c = F.when(_in(F.upper(c), s.RESERVED), F.concat(F.lit("_"), c)).otherwise(c)
    visible = F.length(_drop(c, r"[^\p{L}\p{N}]"))
    bad = F.coalesce(name, F.lit("")).isin("") | (visible < 2) | looks_mojibake(c, True)
    return F.when(bad, F.lit(fallback)).otherwise(F.substring(c, 1, s.LONGEST_NAME))


def has_tag(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(s.TAG)


def tag_of(name: Column) -> Column:
    """The hexadecimal tag at a name's end; '' without one."""
    return F.regexp_extract(name, s.TAG, 1)


def tag_parts(name: Column) -> Column:
    """Struct (clean_name, period, signature) of a tagged name; null for any other."""
    core = F.rtrim(_drop(name, s.TAG))
    period = F.trim(F.regexp_extract(core, s.PERIOD_TAIL, 1))
    clean = F.trim(_drop(F.rtrim(_drop(core, s.PERIOD_TAIL)), r"^\s*\d+[\.\-_)\s]+"))
    return F.when(has_tag(name), F.struct(clean.alias("clean_name"), period.alias("period"), tag_of(name).alias("signature")))


def has_group(name: Column) -> Column:
    return name.rlike(s.GROUP_HEAD)


def looks_multiyear(label: Column) -> Column:
    return label.rlike(s.MULTI_YEAR)


def folder_base(category_id: Column, name: Column, time_label: Column, duration: Column, group: Column, tag: Column) -> Column:
    """Directory name of a category: group, name, period, tag; ``tag`` with its brackets."""
    g = F.when(group.between(1, 9), group).otherwise(F.lit(9))
    label = F.trim(F.coalesce(time_label, F.lit("")))
    spans = (F.lower(F.trim(F.coalesce(duration, F.lit("")))) == "multi-year") | looks_multiyear(label)
    period = F.when(label == "", F.lit(None)).when(spans, F.concat(F.lit("〈"), label, F.lit("〉"))).otherwise(F.concat(F.lit("("), label, F.lit(")")))
    shown = F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(category_id)
    base = sanitize_name(F.concat_ws(" ", F.concat(g.cast("string"), F.lit(".")), shown, period))
    return F.trim(F.concat(F.substring(base, F.lit(1), F.lit(s.LONGEST_NAME) - F.length(tag) - 1), F.lit(" "), tag))


def match_core(name: Column) -> Column:
    """A directory name without group, tag and bracketed period, for comparison."""
    c = F.trim(_drop(F.trim(_drop(_drop(F.trim(name), s.GROUP_HEAD), s.TAG)), s.TIME_TAIL))
    return F.lower(_drop(c, r"\s+", " "))


def core_tokens(core: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(core, F.lit("[0-9A-Za-z가-힣]+"), F.lit(0)), lambda t: F.length(t) >= 2))


def fuzzy_score(a: Column, b: Column) -> Column:
    """How far the tokens of the shorter core are in the longer: 0 to 1, at least 0.85 if one core is within the other."""
    x, y = core_tokens(a), core_tokens(b)
    inter = F.size(F.array_intersect(x, y))
    cover = inter / F.nullif(F.least(F.size(x), F.size(y)), F.lit(0))
    within = F.when(a.contains(b) | b.contains(a), F.greatest(cover, F.lit(0.85))).otherwise(cover)
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, 0.0).when(a == b, 1.0).when(inter > 0, within).otherwise(0.0)


def slug(core: Column) -> Column:
    return F.substring(F.lower(_drop(_drop(core, "[^A-Za-z0-9가-힣]+", "-"), "^-+|-+$")), 1, 40)


def safe_path(path: Column, anonymise: bool = False) -> Column:
    """Path for display: parents masked as [folder], or garbled parts as [unknown-folder]."""
    parts = F.split(path, "/")
    last = F.size(parts) - 1

    def shown(part: Column, i: Column) -> Column:
        bad = looks_mojibake(_drop(part, r"^\s*\d\.\s+"), True)
        masked = F.when(bad, "[unknown-folder]").otherwise(part)
        return F.when((i < last) & (part != ""), "[folder]").otherwise(masked) if anonymise else masked

    return F.array_join(F.transform(parts, shown), "/")


# --- texts ------------------------------------------------------------------------------------------------------


def redact(text: Column) -> Column:
    """Keys and tokens as placeholders."""
    return reduce(lambda c, p: _drop(c, p[0], p[1].replace("\\1", "$1")), s.SECRETS, text)


def excerpt_around(text: Column, needle: str, radius: int = 60) -> Column:
    """The first place of ``needle``, in any case, marked and with what stands around it; '' without one."""
    n = len(needle)
    at = F.locate(needle.lower(), F.lower(text))
    start = F.greatest(at - radius, F.lit(1))
    end = F.least(at + n + radius, F.length(text) + 1)
    piece = lambda a, b: F.translate(F.substring(text, a, b - a), "\n", " ")
    out = F.concat(
        F.when(start > 1, "…").otherwise(""), piece(start, at), F.lit("«"), piece(at, at + n), F.lit("»"), piece(at + n, end), F.when(end <= F.length(text), "…").otherwise("")
    )
    return F.when((at > 0) & F.lit(n > 0), out).otherwise("")


def matched_field(snippet: Column, new_path: Column, category: Column, reason: Column, content: Column, original_path: Column) -> Column:
    """Which field a snippet comes from: the first whose first 30 characters are in it."""
    bare = F.lower(F.translate(snippet, "«»", ""))
    fields = (("name", F.regexp_extract(new_path, r"([^/]*)$", 1)), ("category", category), ("reason", reason), ("content", content), ("path", original_path))
    start = lambda c: F.left(F.lower(F.coalesce(c, F.lit(""))), F.lit(30))
    hit = F.coalesce(*[F.when((start(c) != "") & bare.contains(start(c)), label) for label, c in fields], F.lit("match"))
    return F.when(F.coalesce(snippet, F.lit("")) == "", "").otherwise(hit)


def capped(excerpt: Column, reclassify: bool = False, most: int = 1_800) -> Column:
    """What a model is shown of an excerpt: all of it for files that are moved anyway, else 1,200 characters at most."""
    return F.left(F.coalesce(excerpt, F.lit("")), F.lit(most if reclassify else min(most, 1_200)))


def member_text(name: Column, excerpt: Column) -> Column:
    """A file as a document for comparing: its name and the start of its excerpt."""
    return F.concat(F.coalesce(name, F.lit("")), F.lit("\n"), F.left(F.coalesce(excerpt, F.lit("")), F.lit(600)))


def html_text(html: Column) -> Column:
    """Text of a page by patterns, without scripts and styles; entities of mark-up characters are resolved. Parsers give the exact form."""
    c = _drop(html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    c = _drop(_drop(c, r"(?s)<!--.*?-->", " "), r"<[^>]*>", "\n")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(ch))
    return F.trim(_drop(_drop(c, r"[ \t\r\f]*\n[ \t\r\f\n]*", "\n"), r"^\n+|\n+$"))


def rtf_text(rtf: Column) -> Column:
    return F.trim(_drop(_drop(rtf, r"\\'[0-9a-fA-F]{2}|\\[a-zA-Z]+-?\d* ?|[{}]", " "), r"\s+", " "))


def strip_fence(text: Column) -> Column:
    """A model's answer without its thoughts and code fences."""
    return F.trim(_drop(_drop(_drop(text, r"(?s)^.*</think>"), r"^\s*```[A-Za-z]*\s*"), r"\s*```\s*$"))


def bytes_label(n: Column) -> Column:
    """'x.x MB' from a mebibyte on, else 'n B'."""
    return F.when(n >= 1 << 20, F.concat(F.format_string("%.1f", n / float(1 << 20)), F.lit(" MB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


# --- search -----------------------------------------------------------------------------------------------------


def _accents() -> tuple[str, str]:
    """Letters with accents and their base letters, by decomposition; syllables stay whole."""
    import unicodedata as ud

    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        base = ud.normalize("NFD", chr(code))
        if len(base) > 1 and all(ud.combining(c) for c in base[1:]):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BASE = _accents()
MARKS = r"[\x{0300}-\x{036F}]"
MARKED = r"[\x{00C0}-\x{0530}\x{1E00}-\x{1FFF}]"
SEARCH_TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def search_tokens(c: Column) -> Column:
    """Tokens as the full-text index has them: lower case, without accents; '_' and '-' split."""
    c = F.coalesce(c, F.lit(""))
    plain = F.when(c.rlike(MARKED), F.translate(_drop(c, MARKS), ACCENTED, BASE)).otherwise(c)
    return F.regexp_extract_all(F.lower(plain), F.lit(SEARCH_TOKEN), F.lit(0))


def query_phrases(query: str) -> list[list[str]]:
    """Words of each of a query's tokens; the last one of a token is a prefix. Any of them may match."""
    import re
    import unicodedata as ud

    kept = "".join(ch if ch.isalnum() or ch in "-_ " else " " for ch in query)
    fold = lambda t: "".join(c for c in ud.normalize("NFD", t) if not ud.combining(c)) if not re.search("[가-힣]", t) else t
    words = [[w for w in re.split(r"[^\w]|_", fold(t).lower()) if w] for t in kept.split()]
    return [w for w in words if w]
