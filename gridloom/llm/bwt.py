"""Column-wise construction of a collection's Burrows-Wheeler transform with bounded common prefixes.

All strings are extended to the left by one symbol a round, from their ends. A round reads the transform so far once in
order, finds each string's next place from symbol counts, and writes the transform with one symbol per string inserted.
The transform lies in chunks, which are spilled to files and read and written in sequence once it is large.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

#: Entries per chunk, and entries that are held in memory; beyond, chunks go to files.
CHUNK, IN_MEMORY = 1 << 21, 1 << 23
_NONE = np.uint8(255)
_FIELDS = ("symbol", "entry", "common")


class Chunks:
    """A sequence of chunks (symbol uint8, entry uint64, common uint8), in memory or in files of a temporary folder."""

    def __init__(self, spill: bool):
        self.folder = tempfile.mkdtemp(prefix="bwt-") if spill else None
        self.rows: list = []

    def append(self, *columns: np.ndarray) -> None:
        if self.folder is None:
            self.rows.append(columns)
            return
        name = os.path.join(self.folder, str(len(self.rows)))
        for field, c in zip(_FIELDS, columns, strict=True):
            c.tofile(f"{name}.{field}")
        self.rows.append(name)

    def read(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.folder is None:
            return self.rows[i]
        kinds = (np.uint8, np.uint64, np.uint8)
        return tuple(np.fromfile(f"{self.rows[i]}.{f}", k) for f, k in zip(_FIELDS, kinds, strict=True))

    def __len__(self) -> int:
        return len(self.rows)

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


class Collection:
    """Strings of at most ``width`` bytes, right-aligned in a matrix."""

    def __init__(self, strings: list[bytes], match: int):
        self.match, self.n = match, len(strings)
        self.width = max(map(len, strings), default=0)
        self.lengths = np.fromiter(map(len, strings), np.int64, self.n)
        flat = b"".join(s.rjust(self.width, b"\0") for s in strings) + b"\0" * 8
        self.flat = np.frombuffer(flat, np.uint8)
        used = np.unique(np.frombuffer(b"".join(strings), np.uint8)) if strings else np.zeros(0, np.uint8)
        if len(used) > 254:
            raise ValueError("texts in UTF-8 never use all byte values")
        self.codes = len(used) + 1
        self.code = np.zeros(256, np.uint8)
        self.code[used] = np.arange(1, len(used) + 1)

    def symbols(self, string: np.ndarray, suffix: int) -> np.ndarray:
        """Codes of the symbol before the suffix of that length; 0 where the string ends there."""
        ended = self.lengths[string] == suffix
        at = string * self.width + max(0, self.width - suffix - 1)
        return np.where(ended, np.uint8(0), self.code[self.flat[at]])


class _Minima:
    """Least values of ranges of one chunk's common prefixes, by a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of values[first .. last], both included; _NONE where the range is empty."""
        size = last - first + 1
        out = np.full(len(first), _NONE, np.uint8)
        level = np.zeros(len(first), np.int64)
        full = size > 0
        level[full] = np.frexp(size[full].astype(np.float64))[1] - 1
        for k in np.unique(level[full]):
            here = np.flatnonzero(full & (level == k))
            row = self.rows[k]
            out[here] = np.minimum(row[first[here]], row[last[here] - (1 << int(k)) + 1])
        return out


def _survey(state: Chunks, places: np.ndarray, codes: int, match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One read of the transform for the entries at ``places`` (ascending): their symbol, how often it stands before, what the
    suffixes that grow there will share with the entries before and after them, and the counts of all symbols.

    A suffix cT comes right after cT', where T' is the last entry before T with symbol c; they share one symbol more than T'
    and T, which share the least common prefix on the way from T' to T. The same holds for the next entry with symbol c. Lengths
    are cut at ``match``; 0 where no such entry is.
    """
    symbol, left, right = (np.zeros(len(places), np.uint8) for _ in range(3))
    rank, counts = np.empty(len(places), np.int64), np.zeros(codes + 1, np.int64)
    seen, since = np.zeros(codes + 1, bool), np.full(codes + 1, _NONE, np.uint8)
    open_, open_min = np.full(codes + 1, -1), np.full(codes + 1, _NONE, np.uint8)
    every = np.arange(codes + 1)
    start = done = 0

    def grown(x: np.ndarray) -> np.ndarray:
        return (np.minimum(x, match - 1) + 1).astype(np.uint8)

    for i in range(len(state)):
        b, _, c = state.read(i)
        n = len(b)
        end = np.searchsorted(places, start + n)
        here = places[done:end] - start
        if n:
            least = _Minima(c)
            order = np.argsort(b, kind="stable")
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            ordered = b[order]
            begin, finish = np.searchsorted(ordered, every), np.searchsorted(ordered, every, side="right") - 1
            there = finish >= begin
            first, last = order[np.minimum(begin, n - 1)], order[np.maximum(finish, 0)]
            to_first = np.minimum(open_min, least(np.zeros(codes + 1, np.int64), first))
            known = np.flatnonzero(there & (open_ >= 0))
            right[open_[known]] = grown(to_first[known])
            whole = np.minimum.reduce(c)
            open_[known] = -1
            open_min = np.minimum(open_min, whole)

            s, r = b[here], place[here]
            symbol[done:end], rank[done:end] = s, r - begin[s] + counts[s]
            begins, ends = r == begin[s], r == finish[s]
            before = order[np.maximum(r - 1, 0)]
            inside = least(np.where(begins, 0, before + 1), here)
            value = np.where(begins, np.minimum(inside, since[s]), inside)
            left[done:end] = np.where(begins & ~seen[s], 0, grown(value))
            after = order[np.minimum(r + 1, n - 1)]
            value = least(here + 1, np.where(ends, n - 1, after))
            right[done:end] = np.where(ends, 0, grown(value))
            wait = np.flatnonzero(ends)
            open_[s[wait]], open_min[s[wait]] = done + wait, value[wait]

            tail = least(last + 1, np.full(codes + 1, n - 1))
            since = np.where(there, tail, np.minimum(since, whole))
            seen |= there
            counts += finish + 1 - begin
        start, done = start + n, end
    return symbol, rank, left, right, counts[:codes]


def _insert(state: Chunks, before: np.ndarray, symbol: np.ndarray, entry: np.ndarray, left: np.ndarray, right: np.ndarray, spill: bool) -> Chunks:
    """One read and write of the transform: entries go in before the old entries numbered ``before`` (ascending), with what they
    share with their neighbours on both sides."""
    out = Chunks(spill)
    start = done = 0
    for i in range(len(state)):
        b, e, c = state.read(i)
        end = len(before) if i == len(state) - 1 else np.searchsorted(before, start + len(b))
        k = end - done
        at = before[done:end] - start + np.arange(k)
        old = np.ones(len(b) + k, bool)
        old[at] = False
        nb, ne, nc = np.empty(len(old), np.uint8), np.empty(len(old), np.uint64), np.zeros(len(old) + 1, np.uint8)
        nb[old], ne[old], nc[:-1][old] = b, e, c
        nb[at], ne[at] = symbol[done:end], entry[done:end]
        nc[at + 1] = right[done:end]
        nc[at] = left[done:end]
        for a in range(0, max(1, len(old)), CHUNK):
            out.append(nb[a : a + CHUNK], ne[a : a + CHUNK], nc[:-1][a : a + CHUNK])
        start, done = start + len(b), end
    state.close()
    return out


def build(coll: Collection) -> Chunks:
    """The transform of all suffixes in order. An entry is string << 16 | suffix length; ``common`` is how many bytes, at most ``match``, it shares with the entry before."""
    n = coll.n
    strings = np.arange(n)
    state = Chunks(False)
    state.append(coll.symbols(strings, 0), strings.astype(np.uint64) << np.uint64(16), np.zeros(n, np.uint8))
    places, size = strings.copy(), n
    for suffix in range(1, coll.width + 1):
        symbol, rank, left, right, counts = _survey(state, places, coll.codes, coll.match)
        alive = symbol > 0
        strings, symbol, rank, left, right = (x[alive] for x in (strings, symbol, rank, left, right))
        if not len(strings):
            break
        below = np.cumsum(counts[1:]) - counts[1:]
        to = n + below[symbol.astype(np.int64) - 1] + rank
        order = np.argsort(to)
        places, strings = to[order], strings[order]
        size += len(places)
        entry = strings.astype(np.uint64) << np.uint64(16) | np.uint64(suffix)
        state = _insert(state, places - np.arange(len(places)), coll.symbols(strings, suffix), entry, left[order], right[order], size > IN_MEMORY)
    return state


def least_owner(coll: Collection, owner: np.ndarray) -> np.ndarray:
    """For each string and each offset of a ``match``-byte window the least owner of any string with that window.

    A matrix of strings by offsets; offsets past a string's last window hold the string's own owner.
    """
    offsets = max(1, coll.width - coll.match + 1)
    out = np.repeat(owner[:, None], offsets, axis=1)
    state = build(coll)
    try:
        kept = []
        for i in range(len(state)):
            _, e, c = state.read(i)
            long = (e & np.uint64(0xFFFF)) >= coll.match
            kept.append((e[long], c[long]))
    finally:
        state.close()
    if not kept:
        return out
    e, c = (np.concatenate(x) for x in zip(*kept, strict=True))
    if not len(e):
        return out
    string, suffix = (e >> np.uint64(16)).astype(np.int64), (e & np.uint64(0xFFFF)).astype(np.int64)
    starts = np.flatnonzero(c < coll.match)
    low = np.minimum.reduceat(owner[string], starts)
    out[string, coll.lengths[string] - suffix] = np.repeat(low, np.diff(np.r_[starts, len(e)]))
    return out
