"""Suffix arrays with common-prefix values by induced sorting through queues that spill to disk.

A queue for each symbol holds tuples (suffix, common prefix with the tuple before it). Smaller suffixes are taken from
the queues in order, and each pushes its left neighbour into that one's queue, with a common prefix one longer than the
least between the two sources. Large suffixes are induced upwards from the leftmost small ones, small ones downwards from
the large ones. The leftmost small suffixes are ordered by recursion on their names; their common prefixes start from
the recursion's values. Tuples are handled in blocks of numpy arrays; a queue's blocks go to disk beyond a limit.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of tuples that a pair of queues keeps in memory.
MEMORY = 96 << 20
BLOCK = 1 << 16
#: A reduced string of more symbols is ordered by doubling its ranks, as a queue for each symbol no longer pays.
SYMBOLS = 2048
_FAR = np.int32(2**31 - 2)


class Queues:
    """First-in-first-out queues of (suffix, common prefix) blocks by symbol, kept after reading; old blocks spill."""

    def __init__(self, symbols: int, memory: int):
        self.blocks: list[list] = [[] for _ in range(symbols)]
        self.read = [0] * symbols
        self.memory, self.held, self.file, self.end = memory, 0, None, 0
        self.recent: list[tuple[int, int]] = []

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        block = np.stack((at, lcp.astype(at.dtype)))
        self.recent.append((symbol, len(self.blocks[symbol])))
        self.blocks[symbol].append(block)
        self.held += block.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="suffixes-")  # scratch of this task alone, gone when it closes
        for symbol, i in self.recent:
            block = self.blocks[symbol][i]
            self.file.seek(self.end)
            self.file.write(block.tobytes())
            self.blocks[symbol][i] = (self.end, block.dtype, block.shape)
            self.end += block.nbytes
        self.recent, self.held = [], 0

    def get(self, symbol: int, i: int) -> np.ndarray:
        block = self.blocks[symbol][i]
        if isinstance(block, np.ndarray):
            return block
        start, dtype, shape = block
        self.file.seek(start)
        return np.frombuffer(self.file.read(dtype.itemsize * shape[0] * shape[1]), dtype).reshape(shape)

    def unread(self, symbol: int) -> np.ndarray | None:
        """All blocks pushed since the last call, as one."""
        start, end = self.read[symbol], len(self.blocks[symbol])
        if start == end:
            return None
        self.read[symbol] = end
        return np.concatenate([self.get(symbol, i) for i in range(start, end)], axis=1) if end - start > 1 else self.get(symbol, start)

    def all(self, symbol: int) -> np.ndarray | None:
        some = self.blocks[symbol]
        return np.concatenate([self.get(symbol, i) for i in range(len(some))], axis=1) if some else None

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _range_min(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(x[low:high + 1]) for each pair; _FAR where low > high."""
    out = np.full(len(low), _FAR, np.int32)
    width = high - low + 1
    level = np.frexp(np.maximum(width, 1).astype(np.float64))[1] - 1
    table, span = x, 1
    for k in range(int(level.max(initial=0)) + 1):
        now = np.flatnonzero((level == k) & (width > 0))
        if len(now):
            out[now] = np.minimum(table[low[now]], table[high[now] - span + 1])
        if 2 * span > len(x):
            break
        table = np.minimum(table[:-span], table[span:]) if len(table) > span else table
        span *= 2
    return out


class _Inducer:
    """Pushes the left neighbours of suffixes that are scanned in order, upwards or downwards."""

    def __init__(self, text: np.ndarray, symbols: int, up: bool, carry: bool, memory: int):
        self.text, self.up, self.carry, self.queues = text, up, carry, Queues(symbols, memory)
        self.since = np.full(symbols, _FAR, np.int32)  # least common prefix since the last push to each queue
        self.begun = np.zeros(symbols, bool)

    def scan(self, symbol: int, at: np.ndarray, lcp: np.ndarray, same: bool) -> None:
        """same: neighbours with the same symbol are induced too."""
        for start in range(0, len(at), BLOCK):
            self._block(symbol, at[start : start + BLOCK], lcp[start : start + BLOCK], same)

    def _block(self, symbol: int, at: np.ndarray, lcp: np.ndarray, same: bool) -> None:
        left = at - 1
        seen = self.text[left]
        over = (seen > symbol) if self.up else (seen < symbol)
        source = np.flatnonzero((over | (seen == symbol) if same else over) & (left >= 0))
        if self.carry:
            lcp = lcp.astype(np.int32)
        if not len(source):
            if self.carry:
                np.minimum(self.since, lcp.min(), out=self.since)
            return
        to = seen[source]
        order = np.argsort(to, kind="stable")
        source, to = source[order], to[order]
        cut = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1))
        names, ends = to[cut].astype(np.int64), np.concatenate((cut[1:], [len(to)]))
        if self.carry:
            low = np.concatenate(([0], source[:-1] + 1))
            low[cut] = 0
            least = _range_min(lcp, low, source)
            least[cut] = np.minimum(least[cut], self.since[names])
            least += 1
            least[cut[~self.begun[names]]] = 0
            np.minimum(self.since, lcp.min(), out=self.since)
            self.since[names] = _range_min(lcp, source[ends - 1] + 1, np.full(len(names), len(lcp) - 1))
            self.begun[names] = True
        else:
            least = np.zeros(len(source), np.int32)
        left = left[source]
        for name, s, e in zip(names.tolist(), cut.tolist(), ends.tolist(), strict=True):
            self.queues.push(name, left[s:e], least[s:e])


def _induce(text: np.ndarray, symbols: int, small: np.ndarray, small_lcp: np.ndarray, run: np.ndarray, carry: bool, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From the leftmost small suffixes in order: (large, small, and their common prefixes) of each symbol, downwards.

    Yields (suffixes in rising order, common prefix of each with the one before it, number of large ones) by symbol.
    """
    bounds = np.searchsorted(text[small], np.arange(symbols + 1), "left")
    up = _Inducer(text, symbols, True, carry, memory // 2)
    for c in range(symbols):
        last = -1
        while (block := up.queues.unread(c)) is not None:
            up.scan(c, block[0], block[1], True)
            last = int(block[0][-1])
        if bounds[c] < bounds[c + 1]:
            at, lcp = small[bounds[c] : bounds[c + 1]], small_lcp[bounds[c] : bounds[c + 1]].copy()
            lcp[0] = min(run[last], run[at[0]]) if last >= 0 else 0
            up.scan(c, at, lcp, False)
    down = _Inducer(text, symbols, False, carry, memory // 2)
    end = np.array([[len(text) - 1], [0]], small.dtype)
    for c in range(symbols - 1, -1, -1):
        last = -1
        while (block := down.queues.unread(c)) is not None:
            down.scan(c, block[0], block[1], True)
            last = int(block[0][-1])
        large = up.queues.all(c)
        if large is not None:
            lcp = np.concatenate((large[1][1:], [0]))[::-1].copy()  # with the larger one, from the largest on
            lcp[0] = min(run[last], run[large[0][-1]]) if last >= 0 else 0
            down.scan(c, large[0][::-1], lcp, False)
        some = down.queues.all(c) if c else end
        parts, lcps = [], []
        if large is not None:
            parts.append(large[0])
            lcps.append(large[1])
        if some is not None:
            rising = np.concatenate(([0], some[1][:0:-1]))
            rising[0] = min(run[large[0][-1]], run[some[0][-1]]) if large is not None else 0
            parts.append(some[0][::-1])
            lcps.append(rising)
        if parts:
            yield np.concatenate(parts), np.concatenate(lcps), np.array([0 if large is None else large.shape[1]])
    up.queues.close()
    down.queues.close()


def _assemble(text: np.ndarray, symbols: int, small: np.ndarray, small_lcp: np.ndarray, run: np.ndarray, carry: bool, memory: int) -> tuple[np.ndarray, np.ndarray]:
    done = list(_induce(text, symbols, small, small_lcp, run, carry, memory))[::-1]
    return np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, known to be start at least."""
    out = start.astype(np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = np.maximum(x, y) < len(text)
        live = live[inside][text[x[inside]] == text[y[inside]]]
        out[live] += 1
        if limit is not None:
            live = live[out[live] < limit]
    return out


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string that ends in its least symbol, by doubling ranks."""
    rank, step, n = names.astype(np.int64), 1, len(names)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key)
        fresh = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2


def suffix_array(text: np.ndarray, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before it) of an array of small integers.

    The last symbol must be 0 and occur nowhere else.
    """
    n = len(text)
    kind = np.int32 if n < 2**31 else np.int64
    if n == 1:
        return np.zeros(1, kind), np.zeros(1, kind)
    symbols = int(text.max()) + 1
    rise = np.sign(text[1:].astype(np.int64) - text[:-1])
    change = np.append(np.where(rise != 0, np.arange(n - 1), n - 1), n - 1)
    change = np.minimum.accumulate(change[::-1])[::-1]  # where the run that each position is in ends
    is_small = np.append(rise, 1)[change] > 0
    run = (change - np.arange(n) + 1).astype(np.int32)
    small = (np.flatnonzero(is_small[1:] & ~is_small[:-1]) + 1).astype(kind)
    if len(small) > 1:
        # Order the substrings from one leftmost small position to the next, then name them.
        rough, _ = _assemble(text, symbols, small[np.argsort(text[small], kind="stable")], np.zeros(len(small), np.int32), run, False, memory)
        place = np.full(n, -1, kind)
        place[small] = np.arange(len(small))
        order = place[rough]
        order = order[order >= 0]
        size = np.append(np.diff(small) + 1, 1)
        a, b = order[:-1], order[1:]
        equal = size[a] == size[b]
        pick = np.flatnonzero(equal)
        longest = size[a[pick]]
        same, live = np.ones(len(pick), bool), np.arange(len(pick))
        for i in range(int(longest.max(initial=0))):
            live = live[longest[live] > i]
            differs = text[small[a[pick[live]]] + i] != text[small[b[pick[live]]] + i]
            same[live[differs]] = False
            live = live[~differs]
            if not len(live):
                break
        equal[pick] = same
        name = np.empty(len(small), np.int64)
        name[order] = np.concatenate(([0], np.cumsum(~equal)))
        if name.max() + 1 == len(small):
            by_name = order
            before = np.zeros(len(small), np.int64)
        elif name.max() < SYMBOLS:
            by_name, before = suffix_array(name, memory)
        else:
            by_name = _doubled(name)
            before = np.concatenate(([0], _common(name, by_name[:-1], by_name[1:], np.zeros(len(small) - 1, np.int64))))
        a, b = by_name[:-1], by_name[1:]
        known = small[np.minimum(b + before[1:], len(small) - 1)] - small[b]
        small_lcp = np.concatenate(([0], _common(text, small[a].astype(np.int64), small[b].astype(np.int64), known))).astype(np.int32)
        small = small[by_name]
    else:
        small_lcp = np.zeros(len(small), np.int32)
    return _assemble(text, symbols, small, small_lcp, run, True, memory)
