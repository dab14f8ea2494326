"""Text decoded with the wrong encoding: where it is, and what it was.

A hidden Markov model labels characters: one state for clean text, one for each pair of (true, wrong) encodings. A
state's character model is learnt by garbling clean texts of the corpus itself with its pair. Only runs of characters
beyond ASCII are emitted, each with its end, as ASCII reads the same in every state. The likeliest path gives spans,
and each span gets the inverse of its state's pair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrow import over_batches, slices, strings

#: (true encoding, wrong one), in order of preference where several read a span alike. Fixed values.
PAIRS = (
    ("utf-8", "cp1252"),
    ("utf-8", "latin-1"),
    ("utf-8", "mac_roman"),
    ("utf-8", "cp850"),
    ("utf-8", "cp437"),
    ("utf-8", "cp1251"),
    ("utf-8", "cp949"),
    ("utf-8 twice", "cp1252"),
    ("utf-8 twice", "latin-1"),
    ("cp949", "cp1252"),
    ("cp949", "latin-1"),
    ("cp949", "utf-8"),
    ("cp1252", "utf-8"),
    ("cp1252", "cp949"),
    ("cp1252", "cp1251"),
    ("cp1251", "utf-8"),
    ("cp1251", "cp1252"),
    ("koi8_r", "cp1251"),
)
CLEAN = len(PAIRS)
#: Pairs of single-byte sets: each of their characters reads as some letter in the other, so a likelier reading alone proves nothing.
LETTER_FOR_LETTER = frozenset({("cp1252", "cp1251"), ("cp1251", "cp1252"), ("koi8_r", "cp1251")})
#: Letters that a stretch of such a pair has at least in whole words, and the share of its words that may be otherwise.
LETTERS, OTHERWISE = 3, 0.2

#: Texts of a column that the counts of all its texts are scaled down to: the weight of what was learnt against that of what is unseen.
WEIGHT = 1_200
ENTER, LEAVE, SMOOTH = 1e-4, 0.01, 0.02
#: Logarithms of entering a state, leaving it, staying in it and in the clean one.
ENTERS, LEAVES, STAY, STAY_CLEAN = np.log(ENTER / CLEAN), np.log(LEAVE), np.log1p(-LEAVE), np.log1p(-ENTER)
#: A character is suspect, and a text with one worth a path, if some state makes it this many times likelier than clean text.
SUSPECT = 3.0

#: Syllables of at most so many uses, after scaling, may come from a garbled text that was taken for clean.
STRAY = 3
#: Weight of other cases of the words learnt in the clean state.
RARER = 0.02
#: Characters that odd but soundly decoded text is written with: soft hyphen and spaces, accents, Greek, syllable parts, joiners, ligatures, wide forms. Fixed values.
ODD_FORMS = ((0xA0, 0xA0), (0xAD, 0xAD), (0x300, 0x36F), (0x391, 0x3C9), (0x1100, 0x11FF), (0x2000, 0x200F), (0x202F, 0x202F), (0x2060, 0x2060), (0x3000, 0x3000), (0xFB00, 0xFB06), (0xFEFF, 0xFEFF), (0xFF01, 0xFF5E))

RUN = re.compile(r"[^\x00-\x7f]+")
#: Runs with what a wrong reading may draw into them: one letter, as the second byte of cp949.
AROUND = re.compile(r"[^\x00-\x7f]+(?:[A-Za-z][^\x00-\x7f]+)*[A-Za-z]?")
WORDLIKE = re.compile(r"(?:[^\W\d_]|[^\x00-\x7f])+")
_LATIN, _CYRILLIC = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]"), re.compile("[Ѐ-ӿ]")
LOST = "�"

#: Characters that are taken off a piece's start and end: bytes of a sequence that was cut off.
CUTS = [(a, b) for a in range(4) for b in range(4)]


def _decode(data: bytes, encoding: str) -> str:
    """Decoding as lenient software does it: undefined bytes of a single-byte set stay as control characters, others are lost."""
    if encoding in ("cp1252", "cp1251"):
        return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in data) if any(128 <= b < 160 for b in data) else data.decode(encoding)
    return data.decode(encoding, "replace")


def _encode(text: str, encoding: str) -> bytes | None:
    """Inverse of _decode, or None if a character can't come from it."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding not in ("cp1252", "cp1251"):
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not 128 <= ord(c) < 160:
                return None
            out.append(ord(c))
    return bytes(out)


def garble(text: str, pair: tuple[str, str]) -> str | None:
    """``text`` as it reads when decoded wrongly; None if the true encoding can't hold it."""
    true, wrong = pair
    try:
        if true == "utf-8 twice":
            return _decode(_decode(text.encode(), wrong).encode(), wrong)
        return _decode(text.encode(true), wrong)
    except UnicodeEncodeError:
        return None


def restore(text: str, pair: tuple[str, str]) -> tuple[str, bool]:
    """The inverse, and whether nothing was lost. Lost characters come out as U+FFFD; an impossible span stays as it is."""
    true, wrong = pair
    whole = LOST not in text
    if not whole and true not in ("utf-8", "cp949"):
        parts = [p if p == LOST else restore(p, pair)[0] for p in re.split(f"({LOST})", text) if p]
        return "".join(parts), False
    data = b"".join(b"\xff" if part == LOST else _encode(part, wrong) or b"" for part in re.split(f"({LOST})", text))
    if whole and _encode(text, wrong) is None:
        return text, False
    rounds = 2 if true == "utf-8 twice" else 1
    out = text
    for i in range(rounds):
        try:
            out = data.decode("utf-8" if rounds == 2 else true, "strict" if whole else "replace")
        except UnicodeDecodeError:
            return text, False
        if i + 1 < rounds:
            again = _encode(out, wrong)
            if again is None:
                return text, False
            data = again
    if not whole and sum(c != LOST for c in out) <= sum(c < "\x80" for c in text):
        return text, False  # nothing beyond ASCII could be given back
    return re.sub(f"{LOST}+", LOST, out), whole


def in_words(text: str, start: int, stop: int, pair: tuple[str, str]) -> tuple[int, int] | None:
    """The part of a stretch whose words look like the work of a pair of LETTER_FOR_LETTER, or None.

    Cyrillic is garbled in whole words, without a letter of ASCII in them, so a stretch loses what reaches into another
    word at its ends. Latin letters garbled to Cyrillic stand beside those of ASCII and give words of one script again.
    An accent in a word, or a sign by itself, is neither.
    """
    runs = [m for m in WORDLIKE.finditer(text, max(0, start - 64), min(len(text), stop + 64)) if m.start() < stop and m.end() > start and not m.group().isascii()]
    if pair[0] != "cp1252":
        whole = [m.start() >= start and m.end() <= stop and not any(c < "\x80" for c in m.group()) for m in runs]
        if not any(whole):
            return None
        first, last = whole.index(True), len(whole) - whole[::-1].index(True)
        runs, whole = runs[first:last], whole[first:last]
        fits = sum(len(m.group()) for m, ok in zip(runs, whole, strict=True) if ok and len(m.group()) > 1) >= LETTERS and whole.count(False) <= OTHERWISE * len(runs)
        return (runs[0].start(), runs[-1].end()) if fits else None
    mixed = lambda w: _LATIN.search(w) is not None and _CYRILLIC.search(w) is not None
    again = [text[m.start() : max(m.start(), start)] + restore(text[max(m.start(), start) : min(m.end(), stop)], pair)[0] + text[min(m.end(), stop) : m.end()] for m in runs]
    return (start, stop) if any(mixed(m.group()) for m in runs) and sum(map(mixed, again)) <= OTHERWISE * len(runs) else None


def presumed_clean(text: str) -> bool:
    """Whether a text may teach the clean state: nothing lost, no control characters, no run that another reading makes shorter text of."""
    if LOST in text or re.search("[\x80-\x9f─-▟-豈-﫿一-鿿]", text):
        return False
    return all(map(_presumed_clean_run, RUN.findall(text)))


@lru_cache(200_000)
def _presumed_clean_run(run: str) -> bool:
    if len(run) > 1:
        for wrong in ("latin-1", "cp1252", "mac_roman", "cp850", "cp1251", "cp949"):
            data = _encode(run, wrong)
            if data:
                try:
                    data.decode("utf-8")
                    return False
                except UnicodeDecodeError:
                    pass
    return len(re.findall("[¡-ÿ]", run)) < 4


def _kind(c: str) -> str:
    """Class of the character before, for the clean state."""
    if c == "":
        return ""
    if "가" <= c <= "힣":
        return "h"
    if "Ѐ" <= c <= "ӿ":
        return "c"
    return "l" if c.isalpha() else "p"


#: Characters of a run whose scores are made at once and kept; characters of the runs kept, and of those summed at once; what rounding may cost a sum.
PIECE, HELD_CHARS, HELD_STEPS, SLACK = 64, 200_000, 4_096, 1e-3


#: Weight of each (state, character before, character); other cases of clean words have the state CLEAN, the words as they are PLAIN.
Counts = dict[tuple[int, str, str], float]
PLAIN = CLEAN + 1


#: True encodings of the pairs; a text has the bits of those that can hold it.
TRUE = tuple(dict.fromkeys(true.split()[0] for true, _ in PAIRS))


def parts(texts: Iterable[str]) -> Counter:
    """Uses of (bits of TRUE, part as of AROUND) in the clean ones of some texts: all that is learnt from them."""
    out: Counter = Counter()
    for t in texts:
        if not t.isascii() and presumed_clean(t):
            found = AROUND.findall(t)
            whole = "".join(found)
            bits = sum(1 << i for i, true in enumerate(TRUE) if _holds(true, whole))
            for part in found:
                out[bits, part] += 1
    return out


def counted(uses: dict[tuple[int, str], int]) -> Counts:
    """Uses of characters after others in parts of clean texts, and in these as each pair garbles them: once for a part, however often it is there."""
    out: Counter = Counter()

    def add(state: int, run: str, n: float) -> None:
        for previous, c in zip(["", *run], [*run, ""], strict=True):
            out[state, previous, c] += n

    plain: Counter = Counter()
    for (_, part), n in uses.items():
        for run in RUN.findall(part):
            plain[run] += n
    for run, n in plain.items():
        add(PLAIN, run, n)
        for v in {run.upper(), run.lower(), run.capitalize()} - {run}:
            if v.isprintable():
                add(CLEAN, v, RARER * n)
    for state, pair in enumerate(PAIRS):
        bit = 1 << TRUE.index(pair[0].split()[0])
        held: Counter = Counter()
        for (bits, part), n in uses.items():
            if bits & bit:
                held[part] += n
        for part, n in held.items():
            for run in _garbled_runs(part, pair):
                add(state, run, n)
    return out


def learnt(texts: Iterable[str]) -> Counts:
    """Uses of characters after others in the clean ones of some texts, and in these as each pair garbles them."""
    return counted(parts(texts))


def _holds(encoding: str, text: str) -> bool:
    try:
        text.encode(encoding)
    except UnicodeEncodeError:
        return False
    return True


def _garbled_runs(part: str, pair: tuple[str, str]) -> list[str]:
    made = garble(part, pair)
    return RUN.findall(made) if made is not None else []


class Model:
    """Log-likelihoods of a character after another, in each state. '' stands for a run's start and end."""

    def __init__(self, texts: Iterable[str] = (), counts: Counts | None = None):
        """From texts, each of weight 1, or from what ``learnt`` counted in them."""
        known = {chr(i) for i in range(128)}
        by: list[list] = [[] for _ in range(PLAIN)]
        for (k, previous, c), n in (learnt(texts) if counts is None else counts).items():
            by[min(k, CLEAN)].append((previous, c, n))
            if k == PLAIN:
                known.add(c)
        self.states = [self._tables(x) for x in by[:CLEAN]]
        self.close = self._tables(by[CLEAN], stray=STRAY)
        pairs, single, before = self._tables(by[CLEAN], _kind, STRAY)
        self.states.append((pairs, self._with_unseen(single), before))
        self.totals = [sum(s[1].values()) for s in self.states]
        self.cache: dict[tuple[str, str], np.ndarray] = {}
        self.run_gains: dict[str, np.ndarray] = {}
        self.run_chars = 0
        ratio = {c: max(self._one(k, "", c, False) for k in range(CLEAN)) - self._one(CLEAN, "", c, False) for k in range(CLEAN) for c in self.states[k][1]}
        self.known = frozenset(known)
        self.suspects = frozenset(c for c, r in ratio.items() if r > np.log(SUSPECT) and c)

    @staticmethod
    def _tables(counts: list[tuple[str, str, float]], kind=lambda c: c, stray: int = 0) -> tuple[dict, Counter, Counter]:
        """Weights of pairs, characters and contexts of a state; syllables of at most ``stray`` uses have none."""
        pairs, single, before = Counter(), Counter(), Counter()
        for previous, c, n in counts:
            key = kind(previous)
            pairs[key, c] += n
            before[key] += n
            single[c] += n
        if stray:
            gone = {c for c, n in single.items() if n <= stray and "가" <= c <= "힣"}
            single = Counter({c: n for c, n in single.items() if c not in gone})
            pairs = {k: n for k, n in pairs.items() if k[1] not in gone}
        return dict(pairs), single, before

    @staticmethod
    def _with_unseen(single: Counter) -> Counter:
        """Adds a little for characters that clean text may have though what was learnt doesn't: other spellings of what it has, not other text."""
        out, total = Counter(single), sum(single.values())
        if any("가" <= c <= "힣" for c in single if c):
            for i in range(0xAC00, 0xD7A4):
                out[chr(i)] += 0.01
        for low, high in ODD_FORMS:
            for i in range(low, high + 1):
                out[chr(i)] += 5e-5 * total
        return out

    def _one(self, state: int, previous: str, c: str, context: bool = True) -> float:
        pairs, single, before = self.states[state]
        total = self.totals[state]
        p = (single[c] + SMOOTH) / (total + SMOOTH * 60_000)
        if context:
            key = previous if state != CLEAN else _kind(previous)
            back = 2.0 if state != CLEAN else 0.01 * before[key] + 2
            p = (pairs.get((key, c), 0) + back * p) / (before[key] + back)
            if state == CLEAN:
                n = self.close[2][previous]
                p = (self.close[0].get((previous, c), 0) + (0.02 * n + 5) * p) / (1.02 * n + 5)
        return float(np.log(p))

    def scores(self, previous: str, c: str) -> np.ndarray:
        out = self.cache.get((previous, c))
        if out is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            out = self.cache[previous, c] = np.array([self._one(k, previous, c) for k in range(CLEAN + 1)])
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, state) of the stretches that the likeliest path doesn't call clean."""
        if self.suspects.isdisjoint(text) and self.known.issuperset(text):
            return []
        return self._path(text) if self._leaves_clean(text) else []

    def _gains(self, text: str) -> Iterator[np.ndarray]:
        """What each state has over clean text for each character of the runs, with staying in it, in pieces."""
        for run in RUN.findall(text):
            short = len(run) <= PIECE
            got = self.run_gains.get(run) if short else None
            if got is not None:
                yield got
                continue
            for start in range(0, len(run), PIECE):
                piece = run[start : start + PIECE]
                steps = np.array([self.scores(previous, c) for previous, c in zip([run[start - 1] if start else "", *piece], piece)])
                if start + PIECE >= len(run):
                    steps[-1] += self.scores(run[-1], "")
                got = steps[:, :CLEAN] - steps[:, CLEAN:] + (STAY - STAY_CLEAN)
                yield got
            if short:
                if self.run_chars > HELD_CHARS:
                    self.run_gains.clear()
                    self.run_chars = 0
                self.run_gains[run] = got
                self.run_chars += len(run)

    def _leaves_clean(self, text: str) -> bool:
        """Whether the likeliest path may leave the clean state. A path between clean characters is in one state, so it
        does only if a stretch has more over clean text in some state than entering and leaving it costs."""
        over = np.zeros(CLEAN)  # of the best stretch that ends where the last sums did, or 0
        last = inner = -np.inf
        held: list[np.ndarray] = []
        n = 0

        def take() -> None:
            nonlocal over, last, inner, held, n
            sums = np.concatenate([over[None], *held]).cumsum(0)
            lows = np.minimum(np.minimum.accumulate(sums), 0)
            best = (sums[1:] - lows[:-1]).max(1)
            inner = max(inner, last, best[:-1].max(initial=-np.inf))
            last, over = best[-1], sums[-1] - lows[-1]
            held, n = [], 0

        for gains in self._gains(text):
            held.append(gains)
            n += len(gains)
            if n > HELD_STEPS:
                take()
        if held:
            take()
        cost = ENTERS - STAY + SLACK
        return last + cost > 0 or inner + cost + LEAVES - STAY_CLEAN > 0

    def _path(self, text: str) -> list[tuple[int, int, int]]:
        """The stretches that the likeliest path doesn't call clean, each with a state that gives a reading."""
        at: list[int] = []
        steps: list[np.ndarray] = []
        for m in RUN.finditer(text):
            previous = ""
            for i, c in enumerate(m.group(), m.start()):
                at.append(i)
                steps.append(self.scores(previous, c))
                previous = c
            steps[-1] = steps[-1] + self.scores(previous, "")
        stay = np.full(CLEAN + 1, STAY)
        stay[CLEAN] = STAY_CLEAN
        v = np.full(CLEAN + 1, ENTERS)
        v[CLEAN] = 0.0
        entered = np.zeros((len(at), CLEAN + 1), bool)
        into_clean = [CLEAN] * len(at)
        v += steps[0]
        for i in range(1, len(at)):
            best = int(v[:CLEAN].argmax())
            out, into = v[best] + LEAVES, v[CLEAN] + ENTERS
            v += stay
            np.less(v, into, out=entered[i])
            clean = v[CLEAN]
            np.maximum(v, into, out=v)
            if out > clean:
                into_clean[i] = best
                clean = out
            v[CLEAN] = clean
            v += steps[i]
        state = int(v.argmax())
        path = [0] * len(at)
        for i in range(len(at) - 1, -1, -1):
            path[i] = state
            state = into_clean[i] if state == CLEAN else CLEAN if entered[i, state] else state
        out_: list[tuple[int, int, int]] = []
        for i, s in zip(at, path, strict=True):
            if s == CLEAN:
                out_.append((-1, -1, s)) if out_ and out_[-1][2] != CLEAN else None
            elif out_ and out_[-1][2] == s:
                out_[-1] = (out_[-1][0], i + 1, s)
            else:
                out_.append((i, i + 1, s))
        checked = [self._reading(text, start, stop, state) for start, stop, state in out_ if state != CLEAN]
        return [x for x in checked if x is not None]

    def _clean_score(self, text: str) -> float:
        total = 0.0
        for run in RUN.findall(text.lower()):
            previous = ""
            for c in [*run, ""]:
                total += self._one(CLEAN, previous, c)
                previous = c
        return total

    def _reading(self, text: str, start: int, stop: int, state: int) -> tuple[int, int, int] | None:
        """A stretch and its state: the labelled one if its inverse gives likelier clean text, else, as states may read alike, the first whose does;
        the labelled one if characters are lost; else None."""
        span = text[start:stop]
        for k in (state, *range(CLEAN)):
            if PAIRS[k][1] == "utf-8" and LOST not in span:
                continue  # what UTF-8 reads without loss was UTF-8
            part = in_words(text, start, stop, PAIRS[k]) if PAIRS[k] in LETTER_FOR_LETTER else (start, stop)
            if part:
                fixed, whole = restore(text[slice(*part)], PAIRS[k])
                if whole and self._clean_score(fixed) > self._clean_score(text[slice(*part)]) + 5:
                    return *part, k
        k = state if LOST in span else self._piece(span, state)
        return None if k is None else (start, stop, k)

    def _piece(self, span: str, state: int) -> int | None:
        """The state whose inverse gives likelier clean text for a piece of a span that has none as a whole: one cut off inside a sequence, or with bytes that became spaces."""
        for k in (state, *range(CLEAN)):
            if PAIRS[k][0] not in ("utf-8", "utf-8 twice", "cp949") or PAIRS[k][1] == "utf-8":
                continue
            for piece in span.split():
                for a, b in CUTS:
                    part = piece[a : len(piece) - b]
                    if len(part) > 1 and not part.isascii():
                        fixed, whole = restore(part, PAIRS[k])
                        if whole and self._clean_score(fixed) > self._clean_score(part) + 5:
                            return k
        return None

    def repaired(self, text: str, spans: list[tuple[int, int, int]]) -> tuple[str, bool]:
        """The text with each span restored, and whether all of them could be without loss."""
        out, end, whole = [], 0, True
        for start, stop, state in spans:
            fixed, ok = restore(text[start:stop], PAIRS[state])
            out += [text[end:start], fixed]
            end, whole = stop, whole and ok
        return "".join([*out, text[end:]]), whole


#: Counts that a task holds before it gives them on, and characters in their parts.
HELD, HELD_TEXT = 400_000, 8_000_000


def _learnt_of(df: DataFrame) -> tuple[Counts, int]:
    """Counts over all distinct texts of a one-column table, and their number. Each part of them is garbled once: their uses
    are added up in Spark before, and the counts after; only characters and what stands before them come to the driver."""
    column = df.columns[0]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            bits, texts = zip(*held, strict=True)
            return pa.record_batch([pa.array(bits, pa.int32()), pa.array(texts), pa.array(held.values(), pa.int64())], names=["bits", "part", "n"])

        for batch in batches:
            for some in slices(batch, column):
                for key, n in parts(some.column(0).to_pylist()).items():
                    held[key] += n
                held[-1, ""] += some.num_rows
                if len(held) > HELD or sum(len(part) for _, part in held) > HELD_TEXT:
                    yield rows()
                    held = Counter()
        if held:
            yield rows()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            states, before, after = zip(*held, strict=True)
            return pa.record_batch([pa.array(states, pa.int32()), pa.array(before), pa.array(after), pa.array([round(n / RARER) for n in held.values()], pa.int64())], names=["state", "before", "after", "n"])

        for batch in batches:
            for some in slices(batch, "part"):
                uses = dict(zip(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True), some.column(2).to_pylist(), strict=True))
                held[-1, "", ""] += uses.pop((-1, ""), 0)
                for key, n in counted(uses).items():
                    held[key] += n
                if len(held) > HELD:
                    yield rows()
                    held = Counter()
        if held:
            yield rows()

    texts = df.where(F.col(column) != "").distinct()
    uses = texts.mapInArrow(take, "bits int, part string, n bigint").groupBy("bits", "part").agg(F.sum("n").alias("n"))
    sums = uses.mapInArrow(count, "state int, before string, after string, n bigint").groupBy("state", "before", "after").agg(F.sum("n").alias("n"))
    counts = {(r["state"], r["before"], r["after"]): r["n"] * RARER for r in sums.collect()}
    return counts, round(counts.pop((-1, "", ""), 0))


def fit(texts: list[DataFrame]) -> Model:
    """Learns from all texts of each one-column table, each distinct one with the same weight; together they weigh as WEIGHT texts if there are more."""
    total: Counter = Counter()
    for df in texts:
        counts, n = _learnt_of(df)
        for key, uses in counts.items():
            total[key] += uses * min(1, WEIGHT / max(1, n))
    return Model(counts=total)


def garbled(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, garbled, restored, complete) for the rows whose text has a stretch in the wrong encoding.

    ``restored`` has each stretch as it was, with U+FFFD for what was lost, or unchanged where nothing could be given
    back; ``complete`` tells whether all of it could. Null and empty texts have no row; repeated rows each have theirs,
    and their common text is labelled once for each task. Extra columns aren't read.
    """
    context = df.sparkSession.sparkContext
    shared = context.broadcast(model)  # characters and what stands before them

    def make():
        known: dict[str, tuple[str, bool] | None] = {}

        def look(t: str):
            if t.isascii():
                return None
            if t not in known:
                if len(known) > 20_000:
                    known.clear()
                spans = shared.value.spans(t)
                known[t] = shared.value.repaired(t, spans) if spans else None
            return known[t]

        def step(batch: pa.RecordBatch):
            found = [(i, t, r) for i, t in enumerate(strings(batch.column(1))) if (r := look(t))]
            if not found:
                return None
            rows, texts, fixed = zip(*found, strict=True)
            return pa.record_batch(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string()), pa.array([f[0] for f in fixed], pa.string()), pa.array([f[1] for f in fixed])],
                names=["key", "garbled", "restored", "complete"],
            )

        return step

    schema = f"key {dict(df.dtypes)[key]}, garbled string, restored string, complete boolean"
    beyond = F.col("_t").rlike(r"[^\x00-\x7f]")
    return over_batches(df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(beyond), "_t", schema, make)
