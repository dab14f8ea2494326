"""Personal information in free text, replaced by typed placeholders.

Three steps keep offsets. Transducers rewrite a text to a plain form and note for each character which source
characters it stands for: odd widths, look-alike letters and invisible characters, spelled-out digits, and disguised
"at" and "dot". Detectors look for e-mail addresses, identity numbers, phone numbers, street addresses and names in
the plain form. Their spans are mapped back to the source, where placeholders replace them and all else stays as it was.

The lexicon of names is completed from all texts first: a word is a family name if it follows several of the known
given names and is hardly met elsewhere, and the other way round. Which words announce a name is learnt as well: those
that stand before two words with capitals of which, often enough, one is a known name. Names are tables that are joined,
of any size; Python workers see them as filters of a bounded size, and what a filter lets through is joined with the table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrow import Filter, filter_of, over_batches, strings
from shelfmark.llm.canonical import CYRILLIC_LOOKS, fold
from shelfmark.session import cut, is_small, join_checked

KINDS = ("email", "id_number", "phone", "address", "name")

# --- transducers -----------------------------------------------------------------------------------------------

#: Words for digits.
DIGIT_WORDS = {
    w: str(d)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
        "ноль один два три четыре пять шесть семь восемь девять",
        "공 일 이 삼 사 오 육 칠 팔 구",
    )
    for d, w in enumerate(words.split())
} | {"oh": "0", "영": "0", "nul": "0", "zwo": "2"}

_LONG = "|".join(sorted((w for w in DIGIT_WORDS if not "가" <= w <= "힣"), key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:{_LONG}|\d)(?:[\s,.\-]+(?:{_LONG}|\d+)){{5,}}(?!\w)")
_SPELLED_KO = re.compile(r"(?<![가-힣])[공영일이삼사오육칠팔구](?:[\s\-]?[공영일이삼사오육칠팔구]){6,}(?![가-힣])")
_ONE = re.compile(rf"(?i){_LONG}|[공영일이삼사오육칠팔구]")
#: Words for "at" and "dot": between brackets, between spaces; and "dot" after an "at" between spaces.
_AT_IN, _AT_OUT = r"at|a|@|arroba|arobase|chez|собака|골뱅이", "at|arroba|arobase|собака|골뱅이"
_DOT_IN, _DOT_OUT, _DOT_AFTER = r"dot|punkt|point|punto|точка|점|\.", "dot|punkt|punto|точка", "dot|punkt|point|punto|точка|점"
_AT = re.compile(rf"(?i)\s?[\[({{<]\s?(?:{_AT_IN})\s?[\])}}>]\s?|(?<=[\w])\s(?:{_AT_OUT})\s(?=[\w-]+(?:\s?[\[({{]?\s?(?:{_DOT_AFTER})\s?[\])}}]?\s?[\w-]+)+)")
_DOT = re.compile(rf"(?i)\s?[\[({{<]\s?(?:{_DOT_IN})\s?[\])}}>]\s?|(?<=[\w])\s(?:{_DOT_OUT})\s(?=[a-z]{{2,}})")
_DASH = re.compile("[‐-―−﹘﹣]")
#: What any match of the above has, or a character that is rewritten.
_PLAIN = re.compile(rf"(?i)[^ -~\n\t가-힣а-яёß-öø-ÿ«»“”‘’„…]|[\[({{<]\s?(?:{_AT_IN}|{_DOT_IN})\s?[\])}}>]|\s(?:{_AT_OUT}|{_DOT_OUT})\s")


@dataclass
class Plain:
    """A text's plain form; character i stands for source[starts[i]:ends[i]]. Without offsets it is the source."""

    text: str
    starts: list[int] | None = None
    ends: list[int] | None = None

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])

    def replaced(self, pattern: re.Pattern, by) -> "Plain":
        """Each match rewritten as a whole: all its new characters stand for all its old ones."""
        found = [(m.start(), m.end(), by(m)) for m in pattern.finditer(self.text)]
        found = [x for x in found if self.text[x[0] : x[1]] != x[2]]
        if not found:
            return self
        starts, ends = self.starts or list(range(len(self.text))), self.ends or list(range(1, len(self.text) + 1))
        text, s, e, at = [], [], [], 0
        for a, b, new in found:
            text += [self.text[at:a], new]
            s += starts[at:a] + [starts[a]] * len(new)
            e += ends[at:a] + [ends[b - 1]] * len(new)
            at = b
        return Plain("".join([*text, self.text[at:]]), s + starts[at:], e + ends[at:])


_ODD = re.compile(r"[^\x00-\x7f가-힣ㄱ-ㆎÀ-ÖØ-öø-ſ–-”„…€«»]")
_MIXED = re.compile("[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]")
_MIXED_RUN = re.compile(r"[A-Za-z0-9._+\-@]*[A-Za-z][Ѐ-ӿ][A-Za-zЀ-ӿ0-9._+\-@]*|[Ѐ-ӿ]+[A-Za-z][A-Za-zЀ-ӿ0-9._+\-@]*")


def _letters(m: re.Match) -> str:
    return "".join(CYRILLIC_LOOKS.get(c, c) for c in m.group())


def _digits(m: re.Match) -> str:
    return re.sub(r"(?<=\d)[\s,](?=\d)", "", _ONE.sub(lambda w: DIGIT_WORDS[w.group().lower()], m.group()))


def plain(text: str, words: set[str] | None = None) -> Plain:
    """The plain form that detectors read; ``words``: the text's letter runs in lower case."""
    words = words_of(text) if words is None else words
    spelled = len(words & DIGIT_WORDS.keys()) > 1 and _SPELLED.search(text)
    if not spelled and not _PLAIN.search(text) and (text.isascii() or not (_SPELLED_KO.search(text) or _MIXED.search(text))):
        return Plain(text)
    out = Plain(text).replaced(_ODD, lambda m: fold(m.group()))
    out = out.replaced(_DASH, lambda m: "-")
    if _MIXED.search(out.text):
        out = out.replaced(_MIXED_RUN, _letters)
    out = out.replaced(_SPELLED, _digits) if spelled else out
    return out.replaced(_SPELLED_KO, _digits).replaced(_AT, lambda m: "@").replaced(_DOT, lambda m: ".")


TOKEN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """Letter runs in lower case."""
    return set(TOKEN.findall(text.lower()))


# --- detectors -------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"(?i)(?<![a-z0-9.+])[a-z0-9](?:[a-z0-9._+\-]{0,62}[a-z0-9_])?@(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}(?![a-z0-9])")

_FB, _FE = r"(?<![A-Za-z0-9@+])(?<![0-9][.,/\-])", r"(?![A-Za-z0-9@])(?![.,/\-][0-9])"

ID_NUMBER = re.compile(
    "|".join(
        [
            rf"{_FB}\d{{2}}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[- ]?[1-8]\d{{6}}{_FE}",  # resident number, ko
            rf"{_FB}\d{{3}}([- ])\d{{2}}\1\d{{4}}{_FE}",  # social security, en
            rf"{_FB}[0-9XYZ]\d{{7}}-?[A-Z]{_FE}",  # DNI and NIE, es
            rf"{_FB}[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]\d{{2}}[CFGHJKLMNPRTVWXYZ0-9]\d{{3}}[0-9D]{_FE}",  # identity card, de
            rf"{_FB}[12] ?\d\d ?(?:0[1-9]|1[0-2]|[2-9]\d) ?(?:\d\d|2[AB]) ?\d{{3}} ?\d{{3}} ?\d\d{_FE}",  # sécurité sociale, fr
            rf"{_FB}\d\d \d\d \d{{6}}{_FE}|{_FB}\d{{3}}-\d{{3}}-\d{{3}} \d\d{_FE}",  # passport and insurance, ru
        ]
    )
)
PHONE = re.compile(
    "|".join(
        [
            rf"{_FB}(?:\+82[- .]?(?:\(0\))?10|010)[- .]?\d{{4}}[- .]?\d{{4}}{_FE}",
            rf"{_FB}(?:\(0(?:2|[3-6]\d)\) ?|\+82[- ]?(?:2|[3-6]\d)[- ]|0(?:2|[3-6]\d)[-.) ])\d{{3,4}}[-. ]\d{{4}}{_FE}",
            rf"{_FB}(?:\+?1[- .]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[- .])[2-9]\d\d[- .]\d{{4}}{_FE}",
            rf"{_FB}(?:(?:\+44|0044) ?(?:\(0\) ?)?|\(?0)[1-9]\d{{2,3}}\)?[ -]?\d{{3}} ?\d{{3}}{_FE}",
            rf"{_FB}(?:(?:\+49|0049)[ ]?(?:\(0\) ?)?|\(?0)[1-9]\d{{1,4}}\)?[ /\-]{{1,3}}\d{{3,8}}(?:[ \-]\d{{2,4}})?{_FE}",
            rf"{_FB}(?:(?:\+33|0033) ?(?:\(0\) ?)?|0)[1-9](?:[ .\-]?\d\d){{4}}{_FE}",
            rf"{_FB}(?:\+34|0034)[ \-]?\d{{3}}[ \-]?\d{{3}}[ \-]?\d{{3}}{_FE}|{_FB}6\d\d([ \-.])\d{{3}}\1\d{{3}}{_FE}|{_FB}6\d\d \d\d \d\d \d\d{_FE}",
            rf"{_FB}(?:\+7|8)[ \-]?\(?\d{{3}}\)?[ \-]\d{{3}}[ \-]\d\d[ \-]\d\d{_FE}",
            rf"{_FB}\+\d{{1,3}}(?:[ .\-]?\(?\d{{1,4}}\)?){{2,5}}{_FE}",
        ]
    )
)
#: Words for a telephone. Any number of seven digits or more right after one is a phone number.
CALLED = re.compile(
    rf"(?i)(?<!\w)(?:tel|telephone|phone|mobile|cell|call|fax|telefon|handy|mobil|téléphone|tél|portable|teléfono|móvil|тел|телефон|моб|전화|휴대폰|연락처)(?:[.:]| no\.?| nr\.?)?:? ?(\+?\(?\d(?:[ .\-/()]{{0,2}}\d){{6,14}}){_FE}"
)
#: Digits of a number that is spelled out as words.
SPELLED_DIGITS = range(7, 16)
#: Words before a number that make it a number of something else. Fixed values.
_NOT_PHONE = re.compile(r"(?i)(?:artikel|article|art|version|fassung|versión|версия|버전|build|ref|reference|order|po|invoice|rechnung|facture|factura|счёт|주문번호|part|lot|lote|nr|no)[.:#\- ]{0,3}$")

_CAP = r"[A-ZÀ-ÖØ-Þ][\w’'\-]*"
#: For each language: what an address has at least, for a quick check, and its form.
ADDRESSES = (
    # en: number, name, kind of street; flat; town
    (
        (" St", " R", " L", " Av", " C", " D", " Way", " Pl", " Sq", " T", " B"),
        re.compile(
            rf"(?<![\w\-/.,])\d{{1,5}}[a-zA-Z]?,? (?:{_CAP} ){{1,3}}(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Court|Ct|Drive|Dr|Close|Way|Place|Square|Terrace|Crescent|Boulevard|Blvd)\b\.?(?:,? (?:Flat|Unit|Apt|Apartment|Suite|Floor)\.? ?\w+)?(?:,? {_CAP}(?: {_CAP})*,? [A-Z]{{2}} \d{{5}})?"
        ),
    ),
    # de
    (
        ("stra", "str.", "Stra", "Str.", "weg", "Weg", "gasse", "Gasse", "allee", "Allee", "platz", "Platz", "ring", "Ring", "ufer", "damm", "steig", "pfad", "hof ", "Am ", "An de", "Im ", "In de", "Zum ", "Zur ", "Auf de", "Unter de", "Hinter de"),
        re.compile(
            rf"(?<!\w)(?:[A-ZÄÖÜ][\w\-]*(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz|ring|ufer|damm|steig|pfad|hof)|(?:[A-ZÄÖÜ][\w\-]*[ -])+(?:Stra(?:ß|ss)e|Str\.|Weg|Gasse|Allee|Platz|Ring|Ufer|Damm)|(?:Am|An der|An den|Im|In der|In den|Zum|Zur|Auf dem|Auf der|Unter den|Hinter dem) (?:[A-ZÄÖÜ][\w\-]* ?){{1,2}}) ?\d{{1,4}} ?[a-z]?(?![\w.,]\d)(?:, (?:\d{{5}} )?[A-ZÄÖÜ][\w\-]+)?(?! ?%)"
        ),
    ),
    # fr
    (
        ("rue ", "avenue ", "av. ", "chemin ", "allée", "boulevard ", "bd ", "place ", "quai ", "impasse ", "route ", "cours ", "passage ", "square "),
        re.compile(
            rf"(?<![\w\-/.,])\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|av\.|chemin|allée|allées|boulevard|bd|place|quai|impasse|route|cours|passage|square)(?: (?:de la|de l[’'] ?|des|du|de|d[’']))? ?[\wÀ-ÿ’'\-]+(?: {_CAP})*(?:, (?:\d{{5}} )?{_CAP})?"
        ),
    ),
    # es
    (
        ("Calle ", "C/", "Plaza ", "Plza", "Avda", "Aven", "Av.", "Paseo ", "Camino ", "Carrera ", "Ronda ", "Traves"),
        re.compile(
            rf"(?<!\w)(?:Calle|C/|Plaza|Plza\.|Avda\.|Avenida|Av\.|Paseo|Camino|Carrera|Ronda|Travesía)(?: (?:de la|de los|de las|del|de))? {_CAP}(?: (?:de|del|la|las|los|{_CAP}))*,?(?: (?:n\.?º|núm\.|no\.))? ?\d{{1,4}}(?:, (?:piso|puerta|planta|esc\.) ?\w+)*(?:, (?:\d{{5}} )?{_CAP})?"
        ),
    ),
    # ru
    (
        ("ул", "пер", "пр", "наб", "пл", "бул", "б-р", "ш.", "шоссе"),
        re.compile(
            r"(?<!\w)(?:ул|пер|просп|пр-т|пр|наб|пл|бул|б-р|ш|шоссе|улица|переулок|проспект)\.? [А-ЯЁ][\w\-]*(?: [А-ЯЁ][\w\-]*)*,? (?:д\. ?)?\d{1,4}[а-я]?(?:, ?(?:корп|стр)\. ?\w+)?(?:, ?кв\. ?\d+)?(?:, ?г\. ?[А-ЯЁ][\w\-]*)?"
        ),
    ),
    # ko
    (
        ("로", "길"),
        re.compile(
            r"(?<![가-힣])(?:[가-힣]{1,6}(?:특별시|광역시|시|도) )?(?:[가-힣]{1,5}(?:시|군|구|동|읍|면) ){1,3}[가-힣]{1,8}(?:로|길)(?:\d*(?:번)?길)? ?\d{1,4}(?:-\d+)?(?:번길 ?\d{1,4})?(?:,? ?\d{1,3}동 ?\d{1,4}호|,? ?\d{1,3}층|,? ?\d{1,4}호)?(?![\d가-힣])"
        ),
    ),
)
#: What any phone or identity number has at least.
_NUMERIC = re.compile(r"\d(?:[ ().\-/]{0,3}\d){6}|[A-Z][A-Z0-9]\d\d")

# --- names -----------------------------------------------------------------------------------------------------

#: Between the parts of a name: a blank, a comma or a file name's separator, and perhaps an initial.
_GAP = r"(?:,? |[_\-.]|, ?)"
_BETWEEN = re.compile(rf"(?:{_GAP}(?:[A-ZÀ-ÞА-ЯЁ]\.? ?{_GAP}?)?)$")
_FORWARD = re.compile(r" (?:[A-ZÀ-ÞА-ЯЁ]\. )?$")
_LAST = re.compile(r"([^\W\d_]+)(?: [A-ZÀ-ÞА-ЯЁ]\.)? $")
#: Titles; words before a given and a family name; family names of two syllables; words around Korean names.
TITLES = frozenset("mr mrs ms miss dr prof sir madam madame monsieur mme mlle herr frau herrn fräulein don doña señor señora sr sra г господин госпожа тов".split())
_WORD = r"[A-ZÀ-ÞА-ЯЁ][^\W\d_]+(?:-[A-ZÀ-ÞА-ЯЁ][^\W\d_]+)?"
#: A word, and after it two with capitals, with a comma between them if the family name comes first.
ANNOUNCED = re.compile(rf"(?<!\w)([^\W\d_]+\s?[.:]?) (?=({_WORD})(?: [A-ZÀ-ÞА-ЯЁ]\.)?(,?) (?:[A-ZÀ-ÞА-ЯЁ]\. )?({_WORD}))")
KO_COMPOUND = frozenset("남궁 황보 제갈 사공 선우 서문 독고 동방".split())
#: A run of syllables that may be a name, with the word before and the one after; the latter without its particle.
KO_RUN = re.compile(r"(?:(?<![가-힣])([가-힣]+[: ]{1,2}))?(?<![가-힣])([가-힣]{2,5})(?=[ ,.(]|$)(?= ?([가-힣]*))")
KO_PARTICLE = re.compile("(?:이|은|는|가|을|를|께|에게|의|과|와)$")
KO_AFTER = re.compile(r"(?:은|는|이|가|을|를|의|와|과|도|만|에게|에게서|께|께서|님|씨|님이|씨가|씨는|님은|으로|로|이다|입니다)?")


@dataclass
class Names:
    """Known names in lower case; Korean ones apart, as they are written in one word."""

    given: set[str] = field(default_factory=set)
    family: set[str] = field(default_factory=set)
    ko_given: set[str] = field(default_factory=set)
    ko_family: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, rows) -> "Names":
        """From (token, 'given' or 'family'); rows with a null are left out."""
        out = cls(ko_family=set(KO_COMPOUND))
        for token, part in rows:
            if token and part in ("given", "family"):
                hangul = "가" <= token[0] <= "힣"
                getattr(out, ("ko_" if hangul else "") + part).add(token.lower())
        out.__post_init__()
        return out

    def __post_init__(self):
        #: First parts of given names of two.
        self.joined = {g.split("-")[0] for g in self.given if "-" in g}

    def rows(self) -> list[tuple[str, str]]:
        return [(kind, w) for kind in PARTS for w in sorted(getattr(self, kind))]


#: Kinds of names, and what each stands with.
PARTS = {"given": "family", "family": "given", "ko_given": "ko_family", "ko_family": "ko_given"}
#: Bits of a filter for each name in it, and log2 of bits at least and at most (16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 24, 20, 27


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _filter(words: DataFrame) -> Filter:
    """Of a table's one column of words."""

    def hashes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array(np.fromiter(map(_hash, batch.column(0).to_pylist()), np.uint64, batch.num_rows).view(np.int64))], names=["h"])

    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(BITS_EACH * (words.count() + 1)))))
    return filter_of(words.mapInArrow(hashes, "h bigint"), bits)


def _passing(found: Filter, words: Iterable[str], kind: str = "") -> set[str]:
    words = list(words)
    ok = found.has(np.fromiter((_hash(kind + w) for w in words), np.uint64, len(words)))
    return {w for w, y in zip(words, ok, strict=True) if y}


_HYPHENED = re.compile(r"[^\W\d_]+-[^\W\d_]+")


@dataclass
class Lexicon:
    """Names as a filter of kinds and words."""

    names: Filter

    @classmethod
    def of(cls, names: DataFrame) -> "Lexicon":
        return cls(_filter(names.select(F.concat("kind", "word"))))

    def within(self, texts: list[str], words: list[set[str]]) -> Names:
        """Names that the texts, with these words, can hold; a filter may let another word pass."""
        korean: set[str] = set()
        west = set().union(*words, *(_HYPHENED.findall(t.lower()) for t in texts if "-" in t))
        for w in west:
            if "가" <= w[0] <= "힣" or "가" <= w[-1] <= "힣":
                for run in HANGUL.findall(w):
                    korean.update(run[a : a + k] for a in (0, 1, 2) for k in (1, 2, 3, 4) if a + k <= len(run))
        return Names(*(_passing(self.names, korean if kind.startswith("ko_") else west, kind) for kind in ("given", "family", "ko_given", "ko_family")))


def _tokens(text: str, names: Names, join: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, lower case) of letter runs; runs joined by a hyphen are one where that is a known name, or, with ``join``, where both have capitals."""
    raw = [(m.start(), m.end(), m.group().lower()) for m in TOKEN.finditer(text)]
    out = []
    i = 0
    while i < len(raw):
        a, b, w = raw[i]
        if i + 1 < len(raw) and text[b : raw[i + 1][0]] == "-" and ((j := f"{w}-{raw[i + 1][2]}") in names.family or j in names.given or join and text[a].isupper() and text[raw[i + 1][0]].isupper()):
            out.append((a, raw[i + 1][1], j))
            i += 2
        else:
            out.append((a, b, w))
            i += 1
    return out


HANGUL = re.compile("[가-힣]+")


def _given_in(run: str, names: Names) -> int:
    """Length of the given name that a run of syllables is, but for a particle; 0 if it is none."""
    return next((k for k in (4, 3, 2, 1) if run[:k] in names.ko_given and len(run) >= k and KO_AFTER.fullmatch(run[k:])), 0)


def _korean(text: str, names: Names) -> list[tuple]:
    out = []
    runs = [m.span() for m in HANGUL.finditer(text)]
    claim = lambda family, given: (("ko_family", family), ("ko_given", given))
    for i, (a, b) in enumerate(runs):
        run = text[a:b]
        for n in (2, 1):
            if run[:n] not in names.ko_family:
                continue
            if len(run) > n and (k := _given_in(run[n:], names)):
                out.append((a, a + n + k, claim(run[:n], run[n : n + k])))
                break
            if len(run) == n and i + 1 < len(runs) and text[b : runs[i + 1][0]] == " " and (k := _given_in(text[slice(*runs[i + 1])], names)):
                out.append((a, runs[i + 1][0] + k, claim(run, text[runs[i + 1][0] :][:k])))
                break
    return out


def find_names(text: str, names: Names, words: set[str]) -> list[tuple]:
    """Spans of a given and a family name together, in either order, and what they are taken for: two of (kind, word)."""
    out = []
    if not words.isdisjoint(names.given) or names.joined and not words.isdisjoint(names.joined):
        used = -1
        for (a, b, w), (c, d, x) in _near(_tokens(text, names)):
            if a < used:
                continue
            forward = w in names.given and x in names.family
            if (forward or (w in names.family and x in names.given)) and _BETWEEN.fullmatch(text[b:c]) and (text[a].isupper() or text[a:b].islower()):
                if text[a - 1 : a] == "-" and a > 1 and (m := _JOINED.search(text, max(used, 0), a)):
                    a = m.start()  # the first of two given names
                out.append((a, d, (("given", w), ("family", x)) if forward else (("family", w), ("given", x))))
                used = d
    if names.ko_family and (len(names.ko_given) > 300 or any(g in text for g in names.ko_given)):
        out += _korean(text, names)
    return out


_JOINED = re.compile(r"(?<!\w)[A-ZÀ-ÞА-ЯЁ][^\W\d_]+-$")


def _near(tokens):
    """Neighbouring tokens, and those with a single letter between them."""
    for i in range(len(tokens) - 1):
        yield tokens[i], tokens[i + 1]
        if i + 2 < len(tokens) and len(tokens[i + 1][2]) == 1:
            yield tokens[i], tokens[i + 2]


def announcements(text: str, names: Names, words: set[str]) -> Counter:
    """(words, whether a name follows): what stands before two words with capitals; and before and after runs of syllables that begin as a family name."""
    out: Counter = Counter()
    for m in ANNOUNCED.finditer(text):
        given, family = (m[4], m[2]) if m[3] else (m[2], m[4])
        out[m[1].lower(), given.lower() in names.given or family.lower() in names.family] += 1
    if names.ko_family:
        for before, run, after in KO_RUN.findall(text):
            known = [n for n in (2, 1) if run[:n] in names.ko_family and len(run) > n]
            if known:
                named = any(run[n:] in names.ko_given for n in known)
                for words in (before, ">" + KO_PARTICLE.sub("", after) if after else ""):
                    if words:
                        out[words, named] += 1
    return out


def candidates(text: str, names: Names, cues: set[str] = frozenset(), words: set[str] | None = None) -> Counter:
    """(kind, word, partner): words next to a known name where its other part would be, and those that a cue announces. Names in addresses don't count."""
    out: Counter = Counter()
    words = words_of(text) if words is None else words
    west = not (words.isdisjoint(names.given) and words.isdisjoint(names.family) and words.isdisjoint(names.joined))
    text = EMAIL.sub("@", text) if west and "@" in text else text
    for (a, b, w), (c, d, x) in _near(_tokens(text, names, True)) if west else ():
        if not (text[a].isupper() and text[c].isupper()) or w in TITLES or x in TITLES:
            continue
        if text[b:c] == ", " and w in names.family and x not in names.given and x not in names.family and len(x) > 2:
            alone = not ((m := _LAST.search(text, max(0, a - 40), a)) and m[1].lower() in names.given)  # else it's what follows a whole name
            if alone and not text[d : d + 2].strip().isdigit():
                out["given", x, w] += 1
        if not _FORWARD.fullmatch(text[b:c]):
            continue
        if w in names.given and x not in names.given and len(x) > 2:
            out["family", x, w] += 1
        if x in names.family and w not in names.family and len(w) > 2:
            out["given", w, x] += 1
    for m in ANNOUNCED.finditer(text) if cues else ():
        if m[1].lower() not in cues:
            continue
        given, family = (m[4].lower(), m[2].lower()) if m[3] else (m[2].lower(), m[4].lower())
        if given not in TITLES and family not in TITLES and len(given) > 2 and len(family) > 2:
            for kind, word, other in (("given", given, family), ("family", family, given)):
                if word not in getattr(names, kind):
                    out[kind, word, other] += 1
                    out[kind, word, ""] += 1  # the cue is a partner of its own
    for before, run, after in KO_RUN.findall(text) if cues and names.ko_family else ():
        if before not in cues and (not after or ">" + KO_PARTICLE.sub("", after) not in cues):
            continue
        for n in (2, 1):
            family, given = run[:n], run[n:]
            if not 1 <= len(given) <= 3 or (n == 2 and family not in names.ko_family):
                continue
            if given in names.ko_given and family not in names.ko_family:
                out["ko_family", family, given] += 1
            if family in names.ko_family and given not in names.ko_given and len(given) >= 2:
                out["ko_given", given, family] += 1
            break
    return out


#: A word becomes a name with so many partners, if at least this share of its uses with a capital stand next to one; or
#: with one partner, so many uses and the higher share. Without so many partners that are known names, most uses have a capital.
PARTNERS, SHARE, USES, HIGH = 2, 0.25, 2, 0.6
#: Words announce names if at least so many known ones follow them, in this share of their uses before two words with capitals.
ANNOUNCES, OFTEN = 5, 0.5


def _tallied(rows: DataFrame, lexicon: Lexicon, of, kinds: str) -> DataFrame:
    """Sums of the counters that ``of`` gives for each text and the names it can hold; (kinds, n)."""
    column = rows.columns[0]
    names = [x.split()[0] for x in kinds.split(", ")]

    def make():
        def step(batch: pa.RecordBatch):
            total: Counter = Counter()
            texts = Counter(strings(batch.column(0)))
            words = [words_of(t) for t in texts]
            known = lexicon.within(list(texts), words)
            for (t, n), w in zip(texts.items(), words, strict=True):
                for k, v in of(t, known, w).items():
                    total[k] += v * n
            if not total:
                return None
            return pa.record_batch([*map(pa.array, zip(*total, strict=True)), pa.array(list(total.values()), pa.int64())], names=[*names, "n"])

        return step

    return over_batches(rows, column, f"{kinds}, n bigint", make).groupBy(*names).agg(F.sum("n").alias("n"))


def completed(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``names`` (kind, word) with those learnt from all rows of the one-column table; sums are combined in the tasks.

    Names learnt help to learn others, so it goes on until a pass adds none; the set only grows. Candidates, their uses
    and the names are tables; nothing of them comes to the driver.
    """
    column = texts.columns[0]
    rows = texts.where(F.col(column) != "")
    names = cut(names)
    lexicon = Lexicon.of(names)
    said = _tallied(rows, lexicon, announcements, "words string, named boolean").groupBy("words").agg(F.sum(F.when(F.col("named"), F.col("n")).otherwise(0)).alias("named"), F.sum("n").alias("n"))
    cue_filter = _filter(cut(said.where((F.col("named") >= ANNOUNCES) & (F.col("named") >= OFTEN * F.col("n"))).select("words")))
    other = F.create_map(*[F.lit(x) for pair in PARTS.items() for x in pair])

    class Cues:
        """Membership in the filter, asked once for each word in a task."""

        def __init__(self):
            self.known: dict[str, bool] = {}

        def __contains__(self, words: str) -> bool:
            if words not in self.known:
                if len(self.known) > 200_000:
                    self.known.clear()
                self.known[words] = bool(words) and bool(_passing(cue_filter, [words]))
            return self.known[words]

    cues = Cues()
    while True:
        pairs = _tallied(rows, lexicon, lambda t, known, words: candidates(t, known, cues, words), "kind string, word string, partner string")
        # partners are names, or found beside a cue; words aren't names yet: both by the table, as filters may err
        partners = names.select(F.col("kind").alias("_k"), F.col("word").alias("partner"), F.lit(True).alias("_known"))
        pairs = cut(pairs.withColumn("_k", other[F.col("kind")]).join(partners, ["_k", "partner"], "left").join(names, ["kind", "word"], "left_anti"))
        cued = pairs.where("partner = ''").select("kind", "word").distinct().withColumn("_cued", F.lit(True))
        pairs = pairs.join(cued, ["kind", "word"], "left").where("_known OR _cued")
        likely = pairs.groupBy("kind", "word").agg(F.count("*").alias("partners"), F.count("_known").alias("known"), F.sum("n").alias("n")).where((F.col("partners") >= PARTNERS) | (~F.col("kind").startswith("ko_") & (F.col("n") >= USES)))
        likely = cut(likely)
        seen = _uses(rows, likely.where(~F.col("kind").startswith("ko_")).select("word").distinct())
        share = F.when(F.col("partners") >= PARTNERS, SHARE).otherwise(HIGH)
        new = cut(likely.join(seen, "word", "left").where(F.col("kind").startswith("ko_") | ((F.col("n") >= share * F.coalesce("uses", F.lit(0))) & ((F.col("known") >= PARTNERS) | (F.coalesce("small", F.lit(0)) <= F.coalesce("uses", F.lit(0)))))).select("kind", "word"))
        if not new.limit(1).count():
            return names
        names = cut(names.unionByName(new))
        lexicon = Lexicon.of(names)


#: A word, with a second one joined by a hyphen if both have a capital.
USED = re.compile(r"[A-ZÀ-ÞА-ЯЁ][^\W\d_]*(?:-[A-ZÀ-ÞА-ЯЁ][^\W\d_]*)?|[^\W\d_]+")


def _uses(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(word, uses, small): how often each of the words is used with a capital and without, outside of e-mail addresses."""
    wanted, column = _filter(words), rows.columns[0]

    def make():
        def step(batch: pa.RecordBatch):
            total: Counter = Counter()
            for t in strings(batch.column(0)):
                total.update(USED.findall(EMAIL.sub("@", t) if "@" in t else t))
            low = {w: w.lower() for w in total}
            known = _passing(wanted, set(low.values()))
            found = [(low[w], w[0] != low[w][0], n) for w, n in total.items() if low[w] in known]
            return pa.record_batch([*map(pa.array, zip(*found, strict=True))], names=["word", "capital", "n"]) if found else None

        return step

    out = over_batches(rows, column, "word string, capital boolean, n bigint", make).join(F.broadcast(words) if is_small(words) else words, "word", "left_semi")
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return out.groupBy("word").agg(of(F.col("capital")).alias("uses"), of(~F.col("capital")).alias("small"))


# --- whole -----------------------------------------------------------------------------------------------------


def find(text: str, names: Names, p: Plain | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the source text, in order, without overlap: earlier kinds of KINDS take precedence."""
    p = p or plain(text)
    return [x[:3] for x in _found(text, names, p, words_of(p.text))]


def _found(text: str, names: Names, p: Plain, words: set[str]) -> list[tuple]:
    """(start, end, kind, claims), the latter of names only; from the plain form and its words."""
    t = p.text
    spans: list[tuple] = []

    def take(kind: str, found) -> None:
        nonlocal t
        for a, b, *claims in found:
            spans.append((a, b, kind, *claims))
            t = t[:a] + "\x00" * (b - a) + t[b:]

    if "@" in t:
        take("email", [m.span() for m in EMAIL.finditer(t)])
    if _NUMERIC.search(t):
        take("id_number", [m.span() for m in ID_NUMBER.finditer(t)])
        take("phone", [m.span() for m in PHONE.finditer(t) if not _NOT_PHONE.search(t[max(0, m.start() - 16) : m.start()])])
        take("phone", [m.span(1) for m in CALLED.finditer(t)])
        if p.starts is not None:
            take("phone", [x for x in _spelled(text, p) if "\x00" not in t[slice(*x)]])
    for least, form in ADDRESSES:
        if any(k in t for k in least):
            take("address", [m.span() for m in form.finditer(t)])
    take("name", find_names(t, names, words))
    return sorted((*p.source(a, b), kind, *rest) for a, b, kind, *rest in spans)


def _spelled(text: str, p: Plain) -> list[tuple[int, int]]:
    """Where numbers of a phone number's length stand in the plain form that are words in the source."""
    out = []
    for m in _SPELLED.finditer(text):
        a, b = bisect_left(p.starts, m.start()), bisect_left(p.starts, m.end())
        if _ONE.search(m.group()) and p.text[a:b].isdigit() and len(p.text[a:b]) in SPELLED_DIGITS:
            out.append((a, b))
    return out


def redacted(text: str, spans: list[tuple]) -> str:
    """The text with each span replaced by the placeholder of its kind."""
    out, at = [], 0
    for a, b, kind, *_ in spans:
        if a < at:
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def name_table(lexicon: DataFrame) -> DataFrame:
    """(kind, word) from (token, 'given' or 'family'), with the compound family names of Korean; rows with a null are left out."""
    spark = lexicon.sparkSession
    korean = F.when(F.col("token").rlike("^[가-힣]"), F.lit("ko_")).otherwise(F.lit(""))
    rows = lexicon.where("token != '' AND name_part IN ('given', 'family')").select(F.concat(korean, "name_part").alias("kind"), F.lower("token").alias("word"))
    return rows.unionByName(spark.createDataFrame([("ko_family", w) for w in sorted(KO_COMPOUND)], "kind string, word string")).distinct()


_PIECES = "array<struct<before string, found string, kind string, one string, two string>>"


def personal(df: DataFrame, key: str, fields: list[str], lexicon: DataFrame | Names, learn: bool = True, found_only: bool = False) -> DataFrame:
    """(key, field, kinds, redacted) of each row and field; ``kinds`` are those found, sorted, without repeats.

    ``lexicon``: a table of (token, name_part), or some Names. Texts are looked at once each, however often they're
    repeated, and joined back to their rows by two 64-bit hashes. ``learn``: whether these texts complete the lexicon
    first. A null text stays null, and an empty one empty, with no kinds; with ``found_only`` rows without kinds are left
    out. Repeated rows each come out. Whole texts are read, of any length. Extra columns aren't.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    rows = df.select(F.col(key).alias("key"), each.alias("_e")).select("key", "_e.field", F.col("_e.text").alias("text"))
    hashed = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64("text", F.lit(1))})
    texts = cut(hashed.where("text != ''").groupBy("field", "h1", "h2").agg(F.first("text").alias("text")))
    spark = df.sparkSession
    names = spark.createDataFrame(lexicon.rows(), "kind string, word string") if isinstance(lexicon, Names) else name_table(lexicon)
    names = completed(texts.select("text"), names) if learn else cut(names)
    shared = spark.sparkContext.broadcast(Lexicon.of(names))  # of at most 16 MB

    def make():
        def step(batch: pa.RecordBatch):
            source = strings(batch.column(3))
            words = [words_of(t) for t in source]
            plains = [plain(t, w) for t, w in zip(source, words, strict=True)]
            words = [w if p.starts is None else words_of(p.text) for p, w in zip(plains, words, strict=True)]
            known = shared.value.within([p.text for p in plains], words)
            got = []
            for i, (t, p, w) in enumerate(zip(source, plains, words, strict=True)):
                pieces, at = [], 0
                for a, b, kind, *claims in _found(t, known, p, w):
                    if a >= at:
                        one, two = ("\x00".join(c) for c in claims[0]) if claims else (None, None)
                        pieces.append((t[at:a], t[a:b], kind, one, two))
                        at = b
                if pieces:
                    got.append((i, pieces, t[at:]))
            if not got:
                return None
            at, pieces, tails = zip(*got, strict=True)
            at = pa.array(at, pa.int64())
            kind = pa.list_(pa.struct([(c, pa.string()) for c in ("before", "found", "kind", "one", "two")]))
            pieces = pa.array([[dict(zip(("before", "found", "kind", "one", "two"), x, strict=True)) for x in row] for row in pieces], kind)
            return pa.record_batch([*[c.take(at) for c in batch.columns[:3]], pieces, pa.array(tails, pa.string())], names=["field", "h1", "h2", "pieces", "tail"])

        return step

    on = ["field", "h1", "h2"]
    found = over_batches(texts.select("field", "h1", "h2", "text"), "text", f"field string, h1 bigint, h2 bigint, pieces {_PIECES}, tail string", make)
    found = _confirmed(cut(found), names, on)
    shown = F.transform("pieces", lambda x: F.concat(x["before"], F.when(x["kind"].isNull(), x["found"]).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))))
    kinds = F.array_sort(F.array_distinct(F.filter(F.transform("pieces", lambda x: x["kind"]), lambda k: k.isNotNull())))
    found = found.select(*on, kinds.alias("kinds"), F.concat(F.array_join(shown, ""), "tail").alias("redacted")).where(F.size("kinds") > 0)
    if found_only:
        return hashed.where("text != ''").select("key", *on).join(found, on).select("key", "field", "kinds", "redacted")
    none = F.array().cast("array<string>")
    out = join_checked(hashed.where("text != ''"), cut(found), on, "left").select("key", "field", F.coalesce("kinds", none).alias("kinds"), F.coalesce("redacted", "text").alias("redacted"))
    bare = hashed.where("text IS NULL OR text = ''")  # of one hash each, and nothing to find
    return out.unionByName(bare.select("key", "field", none.alias("kinds"), F.col("text").alias("redacted")))


def _confirmed(found: DataFrame, names: DataFrame, on: list[str]) -> DataFrame:
    """``found`` without the kind of names of which a word isn't in the table, but only passed a filter."""
    piece = F.explode(F.filter("pieces", lambda x: x["one"].isNotNull())).alias("p")
    claims = found.select(*on, piece).select(*on, F.explode(F.array("p.one", "p.two")).alias("claim")).distinct()
    known = names.select(F.concat("kind", F.lit("\x00"), "word").alias("claim"))
    wrong = cut(claims.select("claim").distinct().join(known, "claim", "left_anti"))
    if not wrong.limit(1).count():
        return found
    bad = claims.join(wrong, "claim", "left_semi").groupBy(*on).agg(F.collect_set("claim").alias("_bad"))  # of one text
    is_bad = lambda x: F.coalesce(F.array_contains("_bad", x["one"]) | F.array_contains("_bad", x["two"]), F.lit(False))
    checked = F.transform("pieces", lambda x: F.struct(x["before"].alias("before"), x["found"].alias("found"), F.when(~is_bad(x), x["kind"]).alias("kind"), x["one"].alias("one"), x["two"].alias("two")))
    return found.join(bad, on, "left").withColumn("pieces", checked).drop("_bad")
