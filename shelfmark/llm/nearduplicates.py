"""All pairs of documents whose sets of words have a Jaccard similarity of at least a threshold, by a token-group matrix.

A query of n tokens and a partner of m have at least ceil(t / (1 + t) * (n + m)) tokens in common, so the first token
they share, in any order of all tokens, is among the first n - that + 1 of each. With the rarest tokens first:

1. the matrix: each document has a row under each of its first tokens, its prefix. What stands under one token is cut
   into groups of at most GROUP documents of like size, and each group has its union of tokens, as bits;
2. queries: every document is bounded against the unions of the groups under the tokens of its prefix; only groups that
   can hold a partner are opened, and their documents are bounded by the difference of the two bit sets;
3. what is left is verified on the exact token sets, in tasks of bounded size.

Where many documents stand under one token, two of them share a second token too, among as many more of the first of
each, and a third: such a list is split by its documents' next tokens, and again, as long as that leaves fewer pairs.

No bound is a sample or a cap: nothing that reaches the threshold is lost. Documents with equal sets are one class and
enter once. A document has as many rows as its prefix has tokens that another document has too, whatever the number of
documents: tokens that are counted once have no partner and no row. Tokens of few documents are one group that is opened
at once, so rows under them have no bits for a union, only a few for the difference. Bits don't grow with a text: a set of more than PART tokens is parted by
the tokens' hashes, and a pair that reaches the threshold reaches it in one part at least, so each part is a document.
A token of more than LIST documents is split into ranges, each pair of ranges being a task of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.arrow import over_batches, strings
from shelfmark.operators.components import components
from shelfmark.session import cut, is_small, join_checked

WORD = re.compile(r"[^\W_]+")
#: 64-bit words of the bits of a document or group, and of the parities of its tokens; documents of a group.
WIDE, ODD, GROUP = 8, 2, 16
#: Tokens of a part: a larger set is parted by the next power of two.
PART = 192
#: Rows of a list that isn't split by further tokens, nor one of at most so many pairs; tokens by which a list is made at most.
SHORT, LONG, DEPTH = 96, 1 << 15, 4
#: Share of bits that unions of groups lack at least; those of fuller ones exclude hardly any document.
FULL = 0.25
#: Rows under one token, and of one range of it beyond that.
LIST = 65_536
#: Counters of tokens: 2^COUNTERS at most (32 MB with the documents), twice the number of tokens if that is less.
COUNTERS, CHUNK = 25, 16
#: Of a verifying task, as an estimate: pairs and bytes of token sets.
TASK_PAIRS, TASK_BYTES = 500_000, 64 << 20

_EPS = 1e-9
_SPLIT = 1 << 16


def least_overlap(n, m, threshold: float):
    """Words in common that sets of n and m words need at least."""
    return np.ceil(threshold / (1 + threshold) * (n + m) - _EPS)


def _runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, or of the whole where it is shorter."""
    n = max(1, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(width, len(hashes))):
        out = (out ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def token_sets(docs: DataFrame, key: str, text: str, shingle: int = 1) -> DataFrame:
    """(key, n, tokens, h1, h2): distinct words, or runs of ``shingle`` words, as sorted 64-bit hashes, and a hash of the set.

    Texts without words (null, empty, punctuation) have no row: nothing is similar to them. Texts with fewer words than
    a shingle are one shingle.
    """

    def make():
        known: dict[str, int] = {}

        def token(word: str) -> int:
            if len(known) > 1_000_000:
                known.clear()
            known[word] = h = xxhash.xxh3_64_intdigest(word)
            return h

        def step(batch: pa.RecordBatch):
            rows, sets = [], []
            for i, t in enumerate(strings(batch.column(1))):
                words = WORD.findall(t.lower())
                if not words:
                    continue
                if shingle > 1:
                    a = np.unique(_runs(np.array([known.get(w) or token(w) for w in words], np.uint64), shingle)).view(np.int64)
                else:
                    words = set(words)
                    a = np.fromiter((known.get(w) or token(w) for w in words), np.uint64, len(words)).view(np.int64)
                a.sort()
                rows.append(i)
                sets.append(a)
            digests = [xxhash.xxh3_128_intdigest(a.tobytes()) for a in sets]
            half = lambda d, s: (d >> s & (1 << 64) - 1) - (1 << 63)
            return pa.record_batch(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array([len(a) for a in sets], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))),
                    pa.array([half(d, 0) for d in digests], pa.int64()),
                    pa.array([half(d, 64) for d in digests], pa.int64()),
                ],
                names=["key", "n", "tokens", "h1", "h2"],
            )

        return step

    return over_batches(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), "_t", f"key {dict(docs.dtypes)[key]}, n int, tokens array<bigint>, h1 bigint, h2 bigint", make)


def members_of(sets: DataFrame) -> DataFrame:
    """(key, class): the least key with the same set. Only hashes are shuffled."""
    named = sets.groupBy("h1", "h2").agg(F.min("key").alias("class"))
    return sets.select("key", "h1", "h2").join(named, ["h1", "h2"]).select("key", "class")


def classes_of(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(id, n, tokens): one row for each distinct set. If few documents are copies, ``sets`` is read again without them; else it's written once more."""
    copies = members.where("key != class").select("key")
    rows = join_checked(sets, copies, "key", "left_anti").select(F.col("key").alias("id"), "n", "tokens")
    return rows if is_small(copies) else cut(rows)


def _levels(classes: DataFrame) -> tuple[dict[int, bytes], int, float]:
    """Counts of tokens over all classes, as 1 + 8 * log2 in a byte, by the low bits of the token, in compressed chunks; the number of those bits; the mean count.

    Each task sends its non-zero chunks of counters compressed, whatever its number of documents; they are added in Spark.
    A counter saturates at 65,535 within a task. It may count several tokens, but never too few: 1 means a single one.
    """
    total = classes.agg(F.sum("n")).first()[0] or 0
    bits = min(COUNTERS, max(CHUNK, math.ceil(math.log2(2 * total + 1))))

    def count(batches):
        own = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            index, n = np.unique(_index(_flat(batch.column(0)), bits), return_counts=True)
            own[index] = np.minimum(own[index] + n.astype(np.uint32), 65_535).astype(np.uint16)
        parts = own.reshape(-1, 1 << CHUNK)
        used = np.flatnonzero(parts.any(1))
        if len(used):
            yield pa.record_batch([pa.array(used, pa.int32()), pa.array([pa.compress(parts[u].tobytes(), "zstd", asbytes=True) for u in used], pa.binary())], names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros(1 << CHUNK, np.uint64)
        for x in table.column("counts"):
            sums += np.frombuffer(pa.decompress(x.as_py(), 2 << CHUNK, "zstd"), np.uint16)
        level = np.zeros(1 << CHUNK, np.uint8)
        some = sums > 0
        level[some] = np.minimum(255, 1 + np.rint(8 * np.log2(sums[some].astype(float))))
        return pa.table({"chunk": table.column("chunk")[:1], "level": pa.array([pa.compress(level.tobytes(), "zstd", asbytes=True)], pa.binary())})

    sums = classes.select("tokens").mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, level binary")
    rows = sums.collect()  # at most 2^(COUNTERS - CHUNK) rows of 2^CHUNK bytes
    return {r["chunk"]: bytes(r["level"]) for r in rows}, bits, total / (1 << bits)


def _unpacked(chunks: dict[int, bytes], bits: int) -> np.ndarray:
    out = np.zeros((1 << (bits - CHUNK), 1 << CHUNK), np.uint8)
    for chunk, level in chunks.items():
        out[chunk] = np.frombuffer(pa.decompress(level, 1 << CHUNK, "zstd"), np.uint8)
    return out.ravel()


def _flat(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().view(np.uint64)


def _index(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens & np.uint64((1 << bits) - 1)).astype(np.int64)


def _level(count: int) -> int:
    return min(255, 1 + round(8 * math.log2(count)))


def _parting(n: int) -> int:
    """Into 2^this parts a set of n tokens is parted."""
    return min(16, max(0, math.ceil(math.log2(max(1, n) / PART))))


def _parts(tokens: np.ndarray, threshold: float) -> Iterator[tuple[int, int, bool, np.ndarray]]:
    """(parting, part, whether only to meet smaller sets, its tokens): a pair meets in the parting of its smaller set."""
    own = _parting(len(tokens))
    for parting in range(_parting(math.ceil(threshold * len(tokens) - _EPS)), own + 1):
        if not parting:
            yield 0, 0, own > 0, tokens
            continue
        part = (tokens >> np.uint64(64 - parting)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.diff(part[order], prepend=-1))
        for s, e in zip(starts, [*starts[1:], len(order)], strict=True):
            yield parting, int(part[order[s]]), parting < own, tokens[order[s:e]]


def _matrix(classes: DataFrame, threshold: float) -> DataFrame:
    """(key, task, id, meta, blob): a row under each token of the prefix of each (part of a) class that isn't alone in having it.

    ``key`` is the token, or, where its count stands out (above GROUP and what a counter has of other tokens), its
    counter; ``task`` 0 for the former, else the pair of ranges. ``meta`` packs sizes and place (see _Rows); ``blob`` has
    the parities of the former, and of the latter the bits, the number of such tokens before this one, and the counters
    of those, with this one's and those after it where it may have more than SHORT rows. A counter that comes again has
    the number of times in the bits above it, so that it is another token to both of a pair.
    """
    levels, bits, load = _levels(classes)
    shared = classes.sparkSession.sparkContext.broadcast(levels)  # 32 MB at most
    many, alone, longest = _level(GROUP + 3 * load if load > 1 else GROUP), 1, _level(LIST)
    short = _level(SHORT)

    def run(batches):
        level_of = _unpacked(shared.value, bits)
        for batch in batches:
            lists = batch.column(2)
            flat, offsets = _flat(lists), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            subs = [(i, *x) for i in range(batch.num_rows) for x in _parts(flat[offsets[i] : offsets[i + 1]], threshold)]
            sizes = np.array([len(x[4]) for x in subs], np.int64)
            tokens = np.concatenate([np.zeros(0, np.uint64), *[x[4] for x in subs]])
            sub = np.repeat(np.arange(len(subs)), sizes)
            index = _index(tokens, bits)
            level = level_of[index].astype(np.int64)
            order = np.argsort(sub << 40 | level << 32 | index, kind="stable")
            first = np.cumsum(sizes) - sizes
            place = np.arange(len(order)) - first[sub]
            tokens, index, level = tokens[order], index[order], level[order]
            prefix = sizes - np.ceil(threshold * sizes - _EPS).astype(np.int64) + 1
            again = np.zeros(len(order), bool)  # two tokens of one counter
            again[1:] = (index[1:] == index[:-1]) & (sub[1:] == sub[:-1]) & (level[1:] > many)
            at = np.flatnonzero((place < prefix[sub]) & (level > alone) & ~again)
            set_ = np.zeros((len(subs), WIDE * 64), np.uint8)
            set_[sub, (tokens >> np.uint64(COUNTERS) & np.uint64(WIDE * 64 - 1)).astype(np.int64)] = 1
            packed = np.packbits(set_, axis=1, bitorder="little")
            odd = np.bincount(sub * (ODD * 64) + (tokens >> np.uint64(40) & np.uint64(ODD * 64 - 1)).astype(np.int64), minlength=len(subs) * ODD * 64) & 1
            odd = np.packbits(odd.astype(np.uint8).reshape(len(subs), -1), axis=1, bitorder="little")
            new = np.ones(len(order), bool)
            new[1:] = (index[1:] != index[:-1]) | (sub[1:] != sub[:-1])
            times = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            named = (index | np.minimum(times, 127) << COUNTERS).astype("<u4")
            begins = first + np.bincount(sub[level <= many], minlength=len(subs))
            ends = first + np.minimum(sizes, prefix + DEPTH - 1)
            rows, keys, tasks, metas, blobs = [], [], [], [], []
            last = -1
            for t in at.tolist():
                s = int(sub[t])
                i, parting, part, visits, _ = subs[s]
                if s != last:
                    last, before, parity, begin = s, packed[s].tobytes(), odd[s].tobytes(), int(begins[s])
                    own = named[begin : max(begin, int(ends[s]))].tobytes()
                meta = (int(sizes[s]) << 44) | (int(place[t]) << 24) | (min(int(offsets[i + 1] - offsets[i]), (1 << 22) - 1) << 2) | visits << 1
                if level[t] <= many:
                    rows.append(i)
                    keys.append(int(tokens[t] ^ np.uint64(parting * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
                    tasks.append(0)
                    metas.append(meta)
                    blobs.append(parity)
                    continue
                blob = before + (t - begin).to_bytes(4, "little") + (own if level[t] >= short else own[: 4 * (t - begin)])
                key = int(index[t]) | parting << 26 | part << 32
                ranges = 1 if level[t] <= longest else math.ceil(2 ** ((int(level[t]) - 0.5) / 8) / LIST)
                mine = xxhash.xxh3_64_intdigest(subs[s][4].tobytes()) % ranges if ranges > 1 else 0
                for other in range(ranges):
                    rows.append(i)
                    keys.append(key)
                    tasks.append(1 + min(mine, other) * _SPLIT + max(mine, other))
                    metas.append(meta | (mine > other))
                    blobs.append(blob)
            yield pa.record_batch(
                [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(tasks, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(metas, pa.int64()), pa.array(blobs, pa.binary())],
                names=["key", "task", "id", "meta", "blob"],
            )

    return classes.select("id", "n", "tokens").mapInArrow(run, f"key bigint, task bigint, id {dict(classes.dtypes)['id']}, meta bigint, blob binary")


class _Rows:
    """Rows of whole lists, sorted by list and size."""

    def __init__(self, table: pa.Table):
        key, task, meta = (table.column(c).to_numpy() for c in ("key", "task", "meta"))
        run = np.cumsum((np.diff(key, prepend=key[:1]) != 0) | (np.diff(task, prepend=task[:1]) != 0))
        order = np.lexsort((meta >> 44, run))
        self.run, task, meta = run[order], task[order], meta[order]
        self.ids = table.column("id").combine_chunks().take(pa.array(order))
        self.n, self.place, self.whole = meta >> 44, meta >> 24 & ((1 << 20) - 1), meta >> 2 & ((1 << 22) - 1)
        self.visits, self.side = (meta >> 1 & 1).astype(bool), meta & 1
        self.across = np.where(task > 0, (task - 1) // _SPLIT != (task - 1) % _SPLIT, False)
        self.many = task > 0
        blob = table.column("blob").combine_chunks().take(pa.array(order))
        _, offsets, data = blob.buffers()
        offsets = np.frombuffer(offsets, np.int32)[blob.offset : blob.offset + len(order) + 1] // 4
        self.data = np.frombuffer(data, np.uint32) if data is not None else np.zeros(0, np.uint32)
        part = lambda of, wide: self.data[offsets[:-1][of, None] + np.arange(2 * wide)].view(np.uint64)
        self.bits = np.zeros((len(order), WIDE), np.uint64)
        self.odd = np.zeros((len(order), ODD), np.uint64)
        self.bits[self.many] = part(self.many, WIDE)
        self.odd[~self.many] = part(~self.many, ODD)
        # tokens of many documents of a row: where they start and end in data, and which of them is the list's own
        self.tokens = np.where(self.many, offsets[:-1] + 2 * WIDE + 1, 0).astype(np.int64)
        self.stop = np.where(self.many, offsets[1:], 0).astype(np.int64)
        self.own = np.zeros(len(order), np.int64)
        self.own[self.many] = self.data[self.tokens[self.many] - 1]


class _List:
    """Rows that have the same ``depth`` tokens, ``path`` before the last, or many such lists, each a run; sorted by run and size."""

    def __init__(self, rows: _Rows, at: np.ndarray, run: np.ndarray, last: np.ndarray, path: tuple[int, ...], t: float):
        """``last``: which of a row's tokens of many documents is the last of the list's."""
        self.rows, self.at, self.run, self.last, self.path, self.t = rows, at, run, last, path, t
        self.depth = len(path) + 1
        self.n, self.place = rows.n[at], rows.place[at] + last - rows.own[at]
        place = np.arange(len(at))
        code = self.run.astype(np.int64) << 20 | self.n
        most = np.minimum(np.floor(self.n / t + _EPS), (1 << 20) - 1).astype(np.int64)
        self.reach = np.searchsorted(code, self.run.astype(np.int64) << 20 | most, side="right") - place - 1
        self.reach[self.place + least_overlap(self.n, self.n, t) > self.n + len(path)] = 0  # no partner of its size or more
        self.total = int(self.reach.sum())

    def some(self, keep: np.ndarray, path: tuple[int, ...]) -> _List:
        return _List(self.rows, self.at[keep], self.run[keep], self.last[keep], path, self.t)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of rows that no bound excludes."""
        upto = np.cumsum(self.reach)
        s = 0
        while s < len(upto) and upto[-1] > (done := upto[s - 1] if s else 0):
            e = max(s + 1, int(np.searchsorted(upto, done + (1 << 18), side="right")))
            i = np.repeat(np.arange(s, e), self.reach[s:e])
            j = np.arange(len(i)) - np.repeat(upto[s:e] - self.reach[s:e] - done, self.reach[s:e]) + i + 1
            yield self.near(i, j)
            s = e

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of those pairs of one run, the first of no greater size, that no bound excludes and that have no earlier list in common."""
        rows, t = self.rows, self.t
        least = least_overlap(self.n[i], self.n[j], t)
        ok = (self.n[i] >= t * self.n[j] - _EPS) & (self.place[i] + least <= self.n[i] + len(self.path)) & (self.place[j] + least <= self.n[j] + len(self.path))
        i, j, least = i[ok], j[ok], least[ok]
        a, b = self.at[i], self.at[j]
        bits = rows.bits if len(a) and rows.many[a[0]] else rows.odd  # rows of one call have one kind of bits
        ok = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64) <= rows.n[a] + rows.n[b] - 2 * least  # each differing bit is a token that one of them lacks
        i, j, a, b = i[ok], j[ok], a[ok], b[ok]
        ok = ~(rows.visits[a] & rows.visits[b]) & (~rows.across[a] | (rows.side[a] != rows.side[b]))
        ok &= np.minimum(rows.whole[a], rows.whole[b]) >= t * np.maximum(rows.whole[a], rows.whole[b]) - _EPS
        i, j = i[ok], j[ok]
        if len(i) and rows.many[self.at[i[0]]]:
            i, j = self.first(i, j)
        return self.at[i], self.at[j]

    def first(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose first common tokens, of those of many documents, are the list's own; the others stand in an earlier list too."""
        used = np.unique(np.concatenate([i, j]))
        sizes = self.last[used]
        at = np.repeat(self.rows.tokens[self.at[used]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        token, of = self.rows.data[at], np.repeat(np.arange(len(used)), sizes)
        for known in self.path:
            token, of = token[other := token != known], of[other]
        known, code, n = np.unique(token, return_inverse=True, return_counts=True)
        rank = np.empty(len(known), np.int64)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(known))
        code = rank[code]
        # the 64 most frequent tokens have a bit of their own, which decides; the rest shares 64 bits, which only clear
        own, rest = np.zeros(len(used), np.uint64), np.zeros(len(used), np.uint64)
        np.bitwise_or.at(own, of[code < 64], np.uint64(1) << code[code < 64].astype(np.uint64))
        np.bitwise_or.at(rest, of[code >= 64], np.uint64(1) << (code[code >= 64] % 64).astype(np.uint64))
        a, b = np.searchsorted(used, i), np.searchsorted(used, j)
        ok = (own[a] & own[b]) == 0
        i, j, a, b = i[ok], j[ok], a[ok], b[ok]
        open_ = np.flatnonzero(rest[a] & rest[b])
        if len(open_):
            begins = np.searchsorted(of, np.arange(len(used) + 1))
            sets: dict[int, set] = {}
            get = lambda r: sets.get(r) or sets.setdefault(r, set(token[begins[r] : begins[r + 1]].tolist()))
            ok = np.ones(len(i), bool)
            ok[open_] = [get(x).isdisjoint(get(y)) for x, y in zip(a[open_].tolist(), b[open_].tolist(), strict=True)]
            i, j = i[ok], j[ok]
        return i, j

    def split(self) -> _List:
        """One list's rows under each token after its last that may be the next one a pair shares, as runs."""
        rows = self.rows
        prefix = self.n - np.ceil(self.t * self.n - _EPS).astype(np.int64) + 1
        end = np.minimum(rows.stop[self.at] - rows.tokens[self.at], prefix + self.depth - self.place + self.last)
        sizes = np.maximum(0, end - self.last - 1)
        of = np.repeat(np.arange(len(self.at)), sizes)
        last = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.last[of] + 1
        token = rows.data[rows.tokens[self.at[of]] + last]
        order = np.argsort(token, kind="stable")
        return _List(rows, self.at[of[order]], token[order], last[order], (*self.path, self.token()), self.t)

    def token(self) -> int:
        return int(self.rows.data[self.rows.tokens[self.at[0]] + self.last[0]])


def _listed(one: _List) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a list of many rows: split by further tokens, if that leaves fewer pairs, else by groups, if their unions lack enough to exclude any."""
    if one.depth < DEPTH:
        parts = one.split()
        if parts.total + 4 * len(parts.at) < one.total:
            yield from _all(parts)
            return
    yield from _within(one)


def _all(lists: _List) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of many lists of one path: those of few pairs together, each other one by itself."""
    if not len(lists.at):
        return
    starts = np.flatnonzero(np.diff(lists.run.astype(np.int64), prepend=-1))
    ends = np.append(starts[1:], len(lists.at))
    long = (np.add.reduceat(lists.reach, starts) > LONG) & (ends - starts > SHORT)
    yield from lists.some(np.repeat(~long, ends - starts), lists.path).pairs()
    for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        yield from _listed(lists.some(np.arange(s, e), lists.path))


def _within(one: _List) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one list, by groups of like size and their unions."""
    n, bits, t = one.n, one.rows.bits[one.at], one.t
    size = len(n)
    starts = np.arange(0, size, GROUP)
    lacks = ~np.bitwise_or.reduceat(bits, starts, axis=0)
    if np.bitwise_count(lacks).mean() < 64 * FULL:
        yield from one.pairs()
        return
    low, high = n[starts], n[np.minimum(starts + GROUP, size) - 1]
    step = max(1, min(64, (1 << 18) // len(starts)))
    for q in range(0, size, step):
        m, own = n[q : q + step, None], bits[q : q + step]
        first, last = q // GROUP, int(np.searchsorted(low, m[-1, 0] / t + _EPS, side="right"))
        missing = np.bitwise_count(lacks[None, first:last] & own[:, None]).sum(2, dtype=np.int64)
        least = least_overlap(m, np.maximum(low[first:last], m), t)  # partners before the query in the order have it as theirs
        query, group = np.nonzero((missing <= m - least) & (low[first:last] <= m / t + _EPS) & (high[first:last] >= m) & (one.reach[q : q + step, None] > 0))
        i = np.repeat(query + q, GROUP)
        j = ((group + first)[:, None] * GROUP + np.arange(GROUP)).ravel()
        ok = (j > i) & (j < size)
        if ok.any():
            yield one.near(i[ok], j[ok])


def _candidates(table: pa.Table, t: float) -> Iterator[pa.RecordBatch]:
    """(a, b, size) of the pairs in whole lists that no bound excludes; size is the tokens of both."""
    rows = _Rows(table)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def out():
        i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        found.clear()
        return pa.record_batch([rows.ids.take(pa.array(i)), rows.ids.take(pa.array(j)), pa.array(rows.whole[i] + rows.whole[j], pa.int64())], names=["a", "b", "size"])

    def parts():
        at = np.flatnonzero(~rows.many)
        yield from _List(rows, at, rows.run[at], rows.own[at], (), t).pairs()
        at = np.flatnonzero(rows.many)
        yield from _all(_List(rows, at, rows.run[at], rows.own[at], (), t))

    waiting = 0
    for i, j in parts():
        found.append((i, j))
        waiting += len(i)
        if waiting > TASK_PAIRS:
            yield out()
            waiting = 0
    yield out()


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by list, as tables of whole lists."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, task = batch.column("key").to_numpy(), batch.column("task").to_numpy()
        new = np.flatnonzero((np.diff(key) != 0) | (np.diff(task) != 0))
        if held and (held[-1].column("key")[-1].as_py(), held[-1].column("task")[-1].as_py()) != (int(key[0]), int(task[0])):
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            last = int(new[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def candidate_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, size), a < b: the pairs of classes that the matrix doesn't exclude, once each, materialised."""
    kind = dict(classes.dtypes)["id"]
    matrix = _matrix(classes, threshold).repartition("key", "task").sortWithinPartitions("key", "task")
    found = matrix.mapInArrow(lambda batches: (x for table in _lists(batches) for x in _candidates(table, threshold)), f"a {kind}, b {kind}, size bigint")
    return cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "size").distinct())


def _overlaps(pairs: pa.Table, sets: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two sets of each pair, and their similarity."""
    a, b = (pc.index_in(pairs.column(c), sets.column("id").combine_chunks()).to_numpy() for c in ("a", "b"))
    lists = sets.column("tokens").combine_chunks()
    offsets = lists.offsets.to_numpy()
    _, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    offsets, n = offsets - offsets[0], np.diff(offsets)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    common = np.zeros(len(a), np.int64)
    mark = np.zeros(len(code) + 1, bool)
    starts = np.flatnonzero(np.diff(a, prepend=-1))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(a)], strict=True):
        own = code[offsets[a[s]] : offsets[a[s] + 1]]
        mark[own] = True
        for p in range(s, e, 4096):
            some = b[p : min(p + 4096, e)]
            sizes = n[some]
            ends = np.cumsum(sizes)
            at = np.repeat(offsets[some] - (ends - sizes), sizes) + np.arange(ends[-1])
            common[p : p + len(some)] = np.add.reduceat(mark[code[at]].astype(np.int64), ends - sizes)
        mark[own] = False
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return a[back], b[back], (common / (n[a] + n[b] - common))[back]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least row that each of n rows is linked to, directly or over others."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _checked(classes: DataFrame, threshold: float, links: bool) -> DataFrame:
    """Candidates on their exact sets, in tasks of a bounded number of pairs and tokens: (a, b, similarity); with ``links``
    (id, to, n_links) instead: a task's links of a class are counted, and its groups given as links to their first."""
    kind = dict(classes.dtypes)["id"]
    pairs = candidate_pairs(classes, threshold)
    total = pairs.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    side = max(4, math.ceil(math.sqrt(max(total["n"] / TASK_PAIRS, 8 * (total["size"] or 0) / TASK_BYTES))))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    tasks = pairs.select("a", "b", (place("a") * side + place("b")).alias("task"))
    needed = tasks.select("task", F.col("a").alias("id")).unionByName(tasks.select("task", F.col("b").alias("id"))).distinct()
    sets = join_checked(classes.select("id", "tokens"), cut(needed), "id")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, likeness = _overlaps(left, right)
        ok = likeness >= threshold - _EPS
        if not links:
            return left.select(["a", "b"]).append_column("similarity", pa.array(likeness)).filter(pa.array(ok))
        a, b = a[ok], b[ok]
        n = np.bincount(a, minlength=right.num_rows) + np.bincount(b, minlength=right.num_rows)
        to, some = _forest(a, b, right.num_rows), pa.array(np.flatnonzero(n))
        ids = right.column("id").combine_chunks()
        return pa.table({"id": ids.take(some), "to": ids.take(pa.array(to)).take(some), "n_links": pa.array(n, pa.int64()).take(some)})

    out = f"id {kind}, to {kind}, n_links bigint" if links else f"a {kind}, b {kind}, similarity double"
    return tasks.groupBy("task").cogroup(sets.groupBy("task")).applyInArrow(check, out)


def similar_classes(classes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of classes of at least ``threshold``; from (id, n, tokens) with unique ids and
    sets, which is read several times and should be materialised."""
    return _checked(classes, threshold, links=False)


def _classes(docs: DataFrame, key: str, text: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    sets = cut(token_sets(docs.where(F.col(key).isNotNull()), key, text, shingle))
    members = cut(members_of(sets))
    return classes_of(sets, members), members


def similar_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (a, b, similarity) and members (key, class) of all documents that have words.

    A class is the documents with equal sets and is named by its least key. Keys must be unique; rows with a null key
    are left out, as a class couldn't be named by them. Repeated texts are members of one class, not pairs. Extra
    columns aren't read. An empty table gives empty results.
    """
    classes, members = _classes(docs, key, text, shingle)
    return similar_classes(classes, threshold), members


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of documents: those of similar classes, and those within a class."""
    one, two = (members.select(F.col("key").alias(f"k{c}"), F.col("class").alias(c)) for c in "ab")
    across = pairs.select("a", "b").join(one, "a").join(two, "b").select("ka", "kb")
    within = one.join(two.withColumnRenamed("b", "a"), "a").where("ka < kb").select("ka", "kb")
    return across.unionByName(within).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """(key, class, group, n_links): one row for each document that has words; group is the least class linked to its own,
    directly or over others, n_links the number of classes its own is linked to.

    Links are counted where they are found: between tasks go a count for each class, and a link to the first of each
    task's group, but no list of links. As for similar_pairs otherwise.
    """
    classes, members = _classes(docs, key, text, shingle)
    links = cut(_checked(classes, threshold, links=True))
    linked = components(links.where("id != to"), "id", "to").select(F.col("node").alias("class"), "component")
    counts = links.groupBy(F.col("id").alias("class")).agg(F.sum("n_links").alias("n_links"))
    out = members.join(linked, "class", "left").join(counts, "class", "left")
    return out.select("key", "class", F.coalesce("component", "class").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
