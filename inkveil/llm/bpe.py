"""Byte-level BPE: padded matrices of equal-width pieces, merged one leftmost lowest-rank pair per row and round."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import as_long, return_memory, slices, small_batches, spread
from inkveil.plans.storage import spread_out

NONE = np.int32(2**31 - 1)
#: Pieces beyond this many bytes are merged with a heap, whose time is not quadratic in the length.
LONG = 1024
#: Stretches of text between single spaces that are kept with their ids; beyond this the rare ones are forgotten.
KEPT = 1_200_000
#: Seconds without a task after which a Python worker lets its encoder go.
IDLE = 5.0
#: Text bytes that are encoded together.
TEXT_BYTES = 4 << 20
#: The pattern that the shortcuts of ByteBPE.encoded() are right for; with any other it finds the pieces of whole texts.
_SHORTCUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What a word may end in and still be two pieces for certain: the word, and a run of these.
_TAIL = ".,;:!?)]}\"'$%&*#|"
#: A space between two other characters: no piece begins before such a space and ends after it.
_CUT = re.compile(r"(?<=\S) (?=\S)").split


class ByteBPE:
    """Encoder and decoder for a rank file. A rank is also the token's id; every single byte has one."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.shortcuts = pattern == _SHORTCUTS
        found = regex.compile(pattern).finditer
        self.split = regex.compile(pattern).findall if self.shortcuts else lambda text: [m.group() for m in found(text) if m.group()]
        self.vocab = {i: t for t, i in self.ranks.items()}
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        size = max(self.vocab) + 1
        lengths = np.array([len(self.vocab.get(i, b"")) for i in range(size)], np.int64)
        self.token_start = np.concatenate(([0], np.cumsum(lengths)))
        self.token_bytes = np.frombuffer(b"".join(self.vocab.get(i, b"") for i in range(size)), np.uint8)
        # Any two tokens whose joined bytes are a token may merge, at that token's rank.
        pairs = {(self.ranks[t[:i]], self.ranks[t[i:]]): r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.pairs = pairs
        self._build(np.array([(a << 32) | b for a, b in pairs], np.int64), np.array(list(pairs.values()), np.int32))
        self.decimal = [str(i) for i in range(size)]
        self.known: dict[str, bytes] = {}  # ids (int32, little-endian) of pieces that are not a plain word
        self.units: dict[str, int] = {}  # stretches that a space precedes, in the order of their ids in flat
        self.flat, self.begin, self.asked = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, filled in rounds."""
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.mask = (1 << self.bits) - 1
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 1
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            winner = np.zeros(len(todo), bool)
            winner[first] = True
            winner &= free
            self.keys[at[winner]], self.values[at[winner]] = keys[todo[winner]], values[todo[winner]]
            todo = todo[~winner]
            slot[todo] = (slot[todo] + 1) & self.mask
            self.probes += 1

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merged pairs, NONE where two ids do not merge or one is padding (negative)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot, found = self._slot(keys), np.full(keys.shape, NONE, np.int32)
        flat, at, out = keys.ravel(), slot.ravel(), found.ravel()
        todo = np.flatnonzero(flat >= 0)
        for _ in range(self.probes):
            held = self.keys[at[todo]]
            hit = held == flat[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held != -1)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
        return found

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most `width` bytes."""
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.rank_of(ids[:, :-1], ids[:, 1:])
        out = [b""] * len(pieces)
        row = np.arange(len(pieces))
        while len(row):
            at = ranks.argmin(axis=1)  # the first of equal minima: the leftmost
            low = ranks[np.arange(len(row)), at]
            over = low == NONE
            if over.any():
                done, step = ids[over].astype("<i4").tobytes(), 4 * ids.shape[1]
                for at_, (r, n) in enumerate(zip(row[over].tolist(), sizes[over].tolist(), strict=True)):
                    out[r] = done[at_ * step : at_ * step + 4 * n]
                go = ~over
                row, ids, ranks, sizes, at, low = row[go], ids[go], ranks[go], sizes[go], at[go], low[go]
                if not len(row):
                    break
            sizes = sizes - 1
            lane, cols = np.arange(len(row)), np.arange(ids.shape[1])
            src = np.minimum(cols + (cols > at[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, src, 1)
            ids[lane, at] = low
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(src[:, :-1], ranks.shape[1] - 1), 1)
            keep = max(2, int(sizes.max()))  # narrow the matrix as rows shrink
            ids, ranks = ids[:, :keep], ranks[:, : keep - 1]
            right = np.minimum(at, keep - 2)
            ranks[lane, right] = self.rank_of(ids[lane, right], ids[lane, right + 1])
            ranks[:, -1][sizes < keep] = NONE
            left = np.maximum(at - 1, 0)
            ranks[lane, left] = self.rank_of(ids[lane, left], ids[lane, left + 1])
        return out

    def _merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece, lowest rank and then leftmost first, from a heap."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := pairs.get((r, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if before[i] >= 0 and (x := pairs.get((ids[before[i]], r))) is not None:
                heapq.heappush(heap, (x, before[i], ids[before[i]], r))
        return np.array([x for x in ids if x >= 0], "<i4").tobytes()

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, from matrices of pieces of about one length."""
        out, widths = [b""] * len(pieces), {}
        for i, raw in enumerate(pieces):
            if (whole := self.ranks.get(raw)) is not None:
                out[i] = whole.to_bytes(4, "little")
            else:
                n = len(raw)
                widths.setdefault(n + (n & 1) if n <= 24 else 1 << (n - 1).bit_length(), []).append(i)
        for width, some in sorted(widths.items()):
            step = max(1, (1 << 20) // width)
            for at in range(0, len(some), step):
                part = some[at : at + step]
                got = [self._merge_long(pieces[i]) for i in part] if width > LONG else self._merge_matrix([pieces[i] for i in part], width)
                for i, ids in zip(part, got, strict=True):
                    out[i] = ids
        return out

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, piece by piece."""
        found = [self.split(t) for t in texts]
        if len(self.known) > KEPT // 4:
            self.known.clear()
        new = list(set(chain.from_iterable(found)).difference(self.known))
        self.known.update(zip(new, self.merged([p.encode() for p in new]), strict=True))
        return [b"".join([self.known[p] for p in pieces]) for pieces in found]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of stretches that a space precedes. A word of letters is one piece with its space; a word and a run of
        marks are two; the pattern finds the pieces of all others."""
        plain, ended, odd = {}, [], []
        for i, u in enumerate(words):
            if u.isalpha():
                plain[u] = b""
            elif (w := u.rstrip(_TAIL)).isalpha():
                ended.append((i, w, u[len(w) :]))
                plain[w] = b""
            else:
                odd.append(i)
        plain = dict(zip(plain, self.merged([b" " + w.encode() for w in plain]), strict=True))
        marks = list({m for _, _, m in ended})
        of_mark = dict(zip(marks, self._joined(marks), strict=True))
        out = [plain.get(u, b"") for u in words]
        for i, w, m in ended:
            out[i] = plain[w] + of_mark[m]
        for i, ids in zip(odd, self._joined([" " + words[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    def _forget(self) -> None:
        """Keep the stretches that several batches asked for, half of KEPT at most: what came once seldom comes again."""
        asked = self.asked[: len(self.units)]
        bar = max(2, int(np.partition(asked, -(KEPT // 2))[-(KEPT // 2)]) + 1)
        keep = asked >= bar
        size = np.diff(self.begin[: len(asked) + 1])
        self.flat = self.flat[spread(self.begin[:-1][: len(asked)][keep], size[keep])[1]]
        self.begin = np.concatenate(([0], np.cumsum(size[keep])))
        self.units = {u: i for i, u in enumerate(u for u, k in zip(self.units, keep.tolist(), strict=True) if k)}
        self.asked = asked[keep] // 2

    def _slots(self, words: list[str]) -> np.ndarray:
        """Where the ids of each of these distinct stretches begin and end among self.flat: the index into self.begin."""
        if len(self.units) > KEPT:
            self._forget()
        units = self.units
        out = np.fromiter(map(units.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(out < 0)
        if len(new):
            made = self._learn([words[i] for i in new.tolist()])
            out[new] = np.arange(len(units), len(units) + len(new))
            units.update(zip([words[i] for i in new.tolist()], out[new].tolist(), strict=True))
            self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(made), "<i4")))
            size = np.fromiter(map(len, made), np.int64, len(made)) // 4
            self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(size)))
            self.asked = np.concatenate((self.asked, np.zeros(len(new), np.int32)))
        self.asked[out] += 1
        return out

    def _loose(self, text: str) -> bytes:
        """Ids of a text with spaces beside other white space, which pieces may cross: it is cut elsewhere only."""
        cuts = _CUT(text)
        last = " " + cuts.pop() if len(cuts) > 1 and cuts[-1][-1].isspace() else ""
        slots = self._slots(list(dict.fromkeys(cuts[1:])))
        at = dict(zip(dict.fromkeys(cuts[1:]), slots.tolist(), strict=True))
        head, tail = self._joined([cuts[0], last])
        flat, begin = self.flat, self.begin
        return b"".join([head, *[flat[begin[at[u]] : begin[at[u] + 1]].tobytes() for u in cuts[1:]], tail])

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text's) of a string column; a null is empty.

        Texts are cut at single spaces, where pieces end in any case, so that what is common is encoded once; the pattern
        and the merges see only stretches not known yet. Cutting, telling equal stretches and joining ids work on columns.
        """
        n = len(texts)
        if not self.shortcuts:
            made = self._joined([x or "" for x in texts.to_pylist()])
            return np.frombuffer(b"".join(made), "<i4"), np.cumsum([0, *(len(x) // 4 for x in made)])
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        count = lists.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(count) - count
        row = np.repeat(np.arange(n), count)
        size = pc.binary_length(coded.dictionary).to_numpy()
        begins, ends = ((pc.binary_length(trim(coded.dictionary)).to_numpy() < size) | (size == 0) for trim in (pc.utf8_ltrim_whitespace, pc.utf8_rtrim_whitespace))
        loose = (begins | ends)[codes]  # next to a space that pieces may cross
        loose[first] = ends[codes[first]]
        whole = (np.bincount(row[loose], minlength=n) == 0) | (count == 1)
        inner = whole[row]
        inner[first] = False
        met = np.zeros(len(words), bool)
        met[codes[inner]] = True
        slot = np.zeros(len(words), np.int64)
        slot[met] = self._slots(words[met].tolist())
        slot = slot[codes[inner]]
        flat, begin = self.flat, self.begin
        at = np.flatnonzero(whole)
        heads = [b""] * n
        for i, ids in zip(at.tolist(), self._joined(words[codes[first[at]]].tolist()), strict=True):
            heads[i] = ids
        for i in np.flatnonzero(~whole).tolist():
            heads[i] = self._loose(texts[i].as_py())
        size = np.zeros(len(codes), np.int64)
        size[inner] = begin[slot + 1] - begin[slot]
        size[first] = np.fromiter(map(len, heads), np.int64, n) // 4
        place = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        is_head = np.zeros(len(codes), bool)
        is_head[first] = True
        from_head = np.repeat(is_head, size)
        out[from_head] = np.frombuffer(b"".join(heads), "<i4")
        out[~from_head] = flat[spread(begin[slot], size[inner])[1]]
        return out, np.append(place[first], len(out)) if n else np.zeros(1, np.int64)

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        ids, at = self.encoded(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        return np.split(ids, at[1:-1]) if len(texts) else []

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        starts = self.token_start[ids]
        return self.token_bytes[spread(starts, self.token_start[ids + 1] - starts)[1]].tobytes()


@lru_cache(maxsize=2)
def load(rank_file: str, pattern: str) -> ByteBPE:
    """One encoder for each Python worker and vocabulary."""
    return ByteBPE(rank_file, pattern)


_leaving = None


def _leave() -> None:
    load.cache_clear()
    return_memory()


@contextmanager
def lent(rank_file: str, pattern: str) -> Iterator[ByteBPE]:
    """The worker's encoder for one task. Tasks that follow at once find it as it was; after IDLE seconds without one it goes:
    Spark keeps workers beyond their stage, and what comes then needs the executor's memory."""
    global _leaving
    if _leaving is not None:
        _leaving.cancel()
    try:
        yield load(rank_file, pattern)
    finally:
        _leaving = threading.Timer(IDLE, _leave)
        _leaving.daemon = True
        _leaving.start()


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row, whole texts, no special tokens; a null or empty text has no ids.

    rank_file is read on each executor: the tokenizer's package is installed there like the library itself.
    Repeated rows, null ids and other columns change nothing: a row's result comes from its text alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(rank_file, pattern) as bpe:
            for b in slices(batches, "text", TEXT_BYTES):
                yield pa.record_batch([b.column("doc_id"), pa.array(bpe.encode(b.column("text")), pa.list_(pa.int32()))], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return spread_out(docs.select(as_long(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data binary): the bytes of each row's ids; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(rank_file, pattern) as bpe:
            for b in batches:
                yield pa.record_batch([b.column("doc_id"), pa.array([bpe.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())], ["doc_id", "data"])

    small_batches(encoded.sparkSession)
    return encoded.select(as_long(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every row, decode the ids, and return digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One pass without a shuffle; the ids never leave the Python worker. Nulls and repeats as in encode().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(rank_file, pattern) as bpe:
            sha = hashlib.sha256
            for b in slices(batches, "text", TEXT_BYTES):
                counts, ids_sha, text_sha = [], [], []
                for ids in bpe.encode(b.column("text")):
                    counts.append(len(ids))
                    ids_sha.append(sha(" ".join([bpe.decimal[i] for i in ids.tolist()]).encode()).hexdigest())
                    text_sha.append(sha(bpe.decode(ids)).hexdigest())
                yield pa.record_batch([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return spread_out(docs.select(as_long(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
