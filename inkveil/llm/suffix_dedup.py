"""Substring dedup by bytes: suffix arrays of shards, by external induced sorting with common-prefix values."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkveil.llm.anchors import Shard, byte_unit, removals
from inkveil.llm.common import spread
from inkveil.llm.suffixes import suffix_array

#: Bytes of distinct pieces whose suffixes are sorted together; an anchor's pieces stay together whatever their size.
SORT_BYTES = 2 << 20


def least_ranks(pieces: list[bytes], ranks: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, least): for each window of each piece, the least rank of a piece that has it.

    Windows that are equal are neighbours in the suffix array, with common prefixes of `window` at least between them.
    """
    size = np.array([len(p) for p in pieces], np.int64)
    text = np.zeros(int(size.sum()) + len(pieces) + 1, np.uint16)  # a 1 ends each piece, a 0 the whole
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    text[:-1] = 1
    text[spread(begin, size)[1]] = raw.astype(np.uint16) + 2
    order, common = suffix_array(text)
    count = np.maximum(size - window + 1, 0)
    of_piece, at = spread(begin, count)
    slot = np.full(len(text), -1, np.int64)  # of the suffixes that begin a whole window
    slot[at] = np.arange(len(at))
    mine = slot[order]
    fresh = np.concatenate(([0], np.cumsum(common[1:] < window)))
    whole = mine >= 0
    group = fresh[whole]
    mine = mine[whole]
    if not len(mine):
        return np.cumsum(count) - count, np.zeros(0, np.int64)
    cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.minimum.reduceat(ranks[of_piece[mine]], cut)
    out = np.empty(len(mine), np.int64)
    out[mine] = np.repeat(least, np.diff(np.concatenate((cut, [len(mine)]))))
    return np.concatenate((np.cumsum(count) - count, [len(at)])), out


def shortened(piece: bytes, window: int) -> tuple[bytes, np.ndarray]:
    """The piece with runs of one byte cut to `window` bytes, and for each window of the piece the place of an equal one.

    No window reaches beyond both ends of such a run, so the distinct windows stay; a run would else cost the sort one
    step for each of its bytes.
    """
    raw = np.frombuffer(piece, np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(raw[1:] != raw[:-1]) + 1))
    size = np.diff(np.concatenate((starts, [len(raw)])))
    kept = np.minimum(size, window)
    ends = np.cumsum(kept)
    run = np.repeat(np.arange(len(size)), size)[: len(raw) - window + 1]
    left = (starts + size)[run] - np.arange(len(run))
    return raw[spread(starts, kept)[1]].tobytes(), ends[run] - np.minimum(left, window)


def repeated_windows(shard: Shard, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window of it) of the shard's windows that a smaller rank has too."""
    n = len(shard.anchor)
    data, offset = shard.data.tobytes(), shard.offset.tolist()
    anchors = shard.anchor.tolist()
    pieces, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    while at < n:
        end, held, distinct, of, total, cuts = at, {}, [], [], 0, {}
        while end < n and (total < SORT_BYTES or anchors[end] == anchors[end - 1]):
            if end > at and anchors[end] != anchors[end - 1]:
                held.clear()  # only pieces with one anchor can be equal
            piece = data[offset[end] : offset[end + 1]]
            if (u := held.get(piece)) is None:
                u = held[piece] = len(distinct)
                if len(piece) > 8 * window:
                    piece, cuts[u] = shortened(piece, window)
                distinct.append(piece)
                total += len(piece)
            of.append(u)
            end += 1
        of = np.array(of)
        ranks = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(ranks, of, shard.rank[at:end])
        slots, least = least_ranks(distinct, ranks, window)
        count = shard.count[at:end].astype(np.int64)
        who, slot = spread(slots[of], count)
        if cuts:
            begin = np.cumsum(count) - count
            for i in np.flatnonzero(np.isin(of, list(cuts))).tolist():
                slot[begin[i] : begin[i] + count[i]] = slots[of[i]] + cuts[of[i]]
        gone = least[slot] < shard.rank[at:end][who]
        place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        pieces.append(at + who[gone])
        starts.append(place[gone])
        at = end
    return np.concatenate(pieces), np.concatenate(starts)


def _finish(b: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, covered: np.ndarray) -> pa.RecordBatch:
    n = b.num_rows
    kept = ~covered
    begins = covered.copy()
    begins[1:] &= ~(covered[:-1] & (text[1:] == text[:-1]))
    removed, spans = (np.bincount(text[x], minlength=n).astype(np.int64) for x in (covered, begins))
    left = np.diff(offsets) - removed
    raw, at = data[kept].tobytes(), np.concatenate(([0], np.cumsum(left))).tolist()
    digests = [hashlib.sha256(raw[at[i] : at[i + 1]]).hexdigest() for i in range(n)]
    return pa.record_batch([b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept(b: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, covered: np.ndarray) -> pa.RecordBatch:
    raw = data[~covered].tobytes()
    at = np.concatenate(([0], np.cumsum(np.bincount(text[~covered], minlength=b.num_rows)))).tolist()
    return pa.record_batch([b.column("doc_id"), pa.array([raw[s:e] for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["doc_id", "kept"])


def suffix_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, without bytes covered by a string of a smaller doc_id.

    A byte goes if a string of `window` UTF-8 bytes that covers it also starts in a document with a smaller doc_id. Null
    texts count as empty. A null id ranks like the largest one; rows that share an id do not count against each other.
    Strings are judged on the input. Repeated rows fare alike, and other columns are not looked at.
    """
    return removals(docs, byte_unit(window), repeated_windows, _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col, text_col)


def deduped_bytes(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the kept bytes of every row (they need not be valid UTF-8); as suffix_dedup()."""
    return removals(docs, byte_unit(window), repeated_windows, _kept, "doc_id long, kept binary", id_col, text_col)
