"""Reader of streams in a compound file (the container of older office formats), after its published description."""

from __future__ import annotations

import struct

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFA  # sector numbers from here on are marks, not sectors


class Compound:
    """Streams of a compound file by path, in order of their paths."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        first_dir, self.cutoff = struct.unpack_from("<I", data, 48)[0], struct.unpack_from("<I", data, 56)[0]
        first_mini = struct.unpack_from("<I", data, 60)[0]
        next_difat, n_difat = struct.unpack_from("<II", data, 68)
        sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < _END]
        for _ in range(n_difat):
            if next_difat >= _END:
                break
            block = struct.unpack(f"<{self.size // 4}I", self._sector(next_difat))
            sectors += [s for s in block[:-1] if s < _END]
            next_difat = block[-1]
        self.fat = [x for s in sectors for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        self.mini_fat = [x for s in self._chain(first_mini, self.fat) for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        self.entries = []
        raw = b"".join(map(self._sector, self._chain(first_dir, self.fat)))
        for at in range(0, len(raw) - 127, 128):
            n, kind = struct.unpack_from("<H", raw, at + 64)[0], raw[at + 66]
            left, right, child = struct.unpack_from("<III", raw, at + 68)
            start, size = struct.unpack_from("<I", raw, at + 116)[0], struct.unpack_from("<Q", raw, at + 120)[0]
            self.entries.append((raw[at : at + max(0, n - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, size & 0xFFFFFFFF))
        root = self.entries[0]
        self.mini = b"".join(map(self._sector, self._chain(root[5], self.fat)))[: root[6]]

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size].ljust(self.size, b"\0")

    def _chain(self, n: int, table: list[int]) -> list[int]:
        out: list[int] = []
        while n < _END and n < len(table) and len(out) <= len(table):
            out.append(n)
            n = table[n]
        return out

    def streams(self) -> dict[tuple[str, ...], tuple[int, int]]:
        """Path -> (first sector, size)."""
        out: dict[tuple[str, ...], tuple[int, int]] = {}
        todo, seen = [(self.entries[0][4], ())], set()
        while todo:
            n, above = todo.pop()
            if n >= len(self.entries) or (n, above) in seen:
                continue
            seen.add((n, above))
            name, kind, left, right, child, start, size = self.entries[n]
            todo += [(left, above), (right, above)]
            if kind == 2:
                out[(*above, name)] = (start, size)
            elif kind == 1:
                todo.append((child, (*above, name)))
        return dict(sorted(out.items()))

    def read(self, start: int, size: int, most: int | None = None) -> bytes:
        want = size if most is None else min(size, most)
        if size < self.cutoff:
            parts = [self.mini[n * self.mini_size : (n + 1) * self.mini_size] for n in self._chain(start, self.mini_fat)]
        else:
            parts = [self._sector(n) for n in self._chain(start, self.fat)[: want // self.size + 1]]
        return b"".join(parts)[:want]
