"""Substring dedup by words: suffix automata of reference shards and the matching statistics of what streams past them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkveil.llm.anchors import Shard, removals, word_unit


class SuffixAutomaton:
    """The suffix automaton of several token sequences; matches never cross from one to the next."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, p: int, q: int, token) -> int:
        """A state for the part of q that is one longer than p."""
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new = len(self.length) - 1
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = new
            p = self.link[p]
        return new

    def add(self, tokens: list) -> None:
        nexts, link, length, last = self.next, self.link, self.length, 0
        for token in tokens:
            if (q := nexts[last].get(token)) is not None:  # an earlier sequence has this prefix's state
                last = q if length[q] == length[last] + 1 else self._clone(last, q, token)
                continue
            now, p = len(length), last
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0 and token not in nexts[p]:
                nexts[p][token] = now
                p = link[p]
            if p >= 0:
                q = nexts[p][token]
                link[now] = q if length[q] == length[p] + 1 else self._clone(p, q, token)
            last = now

    def matches(self, tokens: list) -> list[int]:
        """Matching statistics: for each token the length of the longest suffix up to it that a sequence contains."""
        nexts, link, length, state, size, out = self.next, self.link, self.length, 0, 0, []
        for token in tokens:
            q = nexts[state].get(token)
            while q is None and state > 0:
                state = link[state]
                size = length[state]
                q = nexts[state].get(token)
            if q is not None:
                state, size = q, size + 1
            out.append(size)
        return out


def repeated_windows(shard: Shard, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window of it) of the shard's windows that a smaller rank has too.

    The pieces with one anchor are a reference shard. They stream in order of rank past the automaton of all smaller
    ranks: where the matching statistic reaches `window`, the window that ends there is a repeat. Then they join the
    automaton. What one sequence gives against an unchanged automaton is kept for its copies.
    """
    pieces, starts = [], []
    cut = np.concatenate((np.flatnonzero(np.concatenate(([True], shard.anchor[1:] != shard.anchor[:-1]))), [len(shard.anchor)]))
    rank, offset, data = shard.rank.tolist(), shard.offset.tolist(), shard.data.tobytes()
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if rank[s] == rank[e - 1]:
            continue
        reference, held, seen, at = SuffixAutomaton(), set(), {}, s
        while at < e:
            end = at
            while end < e and rank[end] == rank[at]:
                end += 1
            block = [data[offset[i] : offset[i + 1]] for i in range(at, end)]
            if held:
                for i, piece in zip(range(at, end), block, strict=True):
                    if (found := seen.get(piece)) is None:
                        found = seen[piece] = [j - window + 1 for j, n in enumerate(reference.matches(piece.split())) if n >= window]
                    pieces += [i] * len(found)
                    starts += found
            for piece in block:
                if piece not in held and e > end:
                    words = piece.split()
                    held.add(piece)
                    if seen.get(piece) is None or len(seen[piece]) < len(words) - window + 1:
                        reference.add(words)
                        seen.clear()
            at = end
    return np.array(pieces, np.int64), np.array(starts, np.int64)


def _finish(b: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, covered: np.ndarray) -> pa.RecordBatch:
    n = b.num_rows
    words = np.bincount(text, minlength=n)
    removed = np.bincount(text[covered], minlength=n)
    raw, token0 = data.tobytes(), np.cumsum(words) - words
    digests = []
    for i in range(n):
        all_words = raw[offsets[i] : offsets[i + 1]].split()
        if removed[i]:
            gone = covered[token0[i] : token0[i] + words[i]].tolist()
            all_words = [w for w, g in zip(all_words, gone, strict=True) if not g]
        digests.append(hashlib.sha256(b" ".join(all_words)).hexdigest())
    return pa.record_batch([b.column("doc_id"), pa.array(words.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _kept(b: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, covered: np.ndarray) -> pa.RecordBatch:
    raw, out, at = data.tobytes(), [], 0
    for i, n in enumerate(np.bincount(text, minlength=b.num_rows).tolist()):
        out.append(b" ".join(w for w, g in zip(raw[offsets[i] : offsets[i + 1]].split(), covered[at : at + n].tolist(), strict=True) if not g).decode())
        at += n
    return pa.record_batch([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, without words covered by a window of a smaller doc_id.

    Words are runs of anything but the space and 0x09-0x0D. Windows are judged on the input: what is removed from one
    document still counts against later ones. Null and empty texts have no words. A null id ranks like the largest; rows
    that share an id do not count against each other, so repeated rows fare alike. Other columns are not looked at.
    """
    return removals(docs, word_unit(window), repeated_windows, _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", id_col, text_col)


def deduped_texts(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the kept words of every row, joined by one space; as substring_dedup()."""
    return removals(docs, word_unit(window), repeated_windows, _kept, "doc_id long, text string", id_col, text_col)
