"""Packing token ids into rows of fixed length: best-fit decreasing with a segment tree over free capacities."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.bpe import TEXT_BYTES, load
from inkveil.llm.common import as_long, slices, small_batches, spread
from inkveil.plans.storage import spread_out

#: Tokens that are packed together. A task holds one such shard at a time, however large its partition is.
SHARD_TOKENS = 1 << 20

PACKED = "shard long, row int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>, n_tokens int"


class FreeCapacities:
    """A segment tree over the capacities 0..top: how many open rows have each; the least one that still fits."""

    def __init__(self, top: int):
        self.leaves = 1 << max(1, top.bit_length())
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def least_fit(self, need: int) -> int:
        """The least capacity >= need of an open row, or -1."""
        i = need + self.leaves
        if self.count[i]:
            return need
        while i > 1:  # up until a right sibling holds something, then down its leftmost path
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items by row: longest first (ties in input order), each into the open row it leaves the least room in."""
    rows: list[list[int]] = []
    free, tree = defaultdict(list), FreeCapacities(capacity)
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[item]
        if need == capacity:
            rows.append([item])
            continue
        room = tree.least_fit(need)
        if room < 0:
            rows.append([])
            at, room = len(rows) - 1, capacity
        else:
            at = free[room].pop()
            tree.add(room, -1)
        rows[at].append(item)
        if room > need:
            free[room - need].append(at)
            tree.add(room - need, 1)
    return rows


def _rows_of(matrix: np.ndarray, width: int) -> pa.Array:
    """The rows of a flat matrix of int32 as a binary column."""
    offsets = np.arange(0, 4 * len(matrix) + 1, 4 * width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def pack(docs: DataFrame, rank_file: str, pattern: str, capacity: int = 2048, pad_id: int = 50256, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows: shard, row, ids and positions (int32, little-endian, padded to capacity), cu_seqlens, doc_ids, starts, n_tokens.

    Every text is encoded whole; one longer than `capacity` is cut into segments that carry their start, so joining
    a document's segments by start gives its ids back. Segment i of a row is ids[cu_seqlens[i]:cu_seqlens[i + 1]], of
    document doc_ids[i] from token starts[i]; positions begin at 0 again with each segment. Padding follows the last.

    No shuffle: a task packs what it reads, about shard_tokens tokens at a time, so memory is bounded and a lost
    task is simply done again. Null and empty texts give no segment. Repeated rows are packed each; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_file, pattern)
        held: list[tuple[int | None, int, np.ndarray]] = []
        shard, tokens = TaskContext.get().partitionId() << 32, 0

        def packed() -> pa.RecordBatch:
            rows = best_fit_decreasing([len(x[2]) for x in held], capacity)
            items = [held[i] for row in rows for i in row]
            size = np.array([len(x[2]) for x in items])
            many = np.array([len(row) for row in rows])
            first = np.cumsum(many) - many
            ends = np.cumsum(size)
            base = np.repeat(ends[first] - size[first], many)  # tokens before an item's row
            begin = np.repeat(np.arange(len(rows)) * capacity, many) + ends - size - base
            item, place = spread(begin, size)
            ids, positions = np.full(len(rows) * capacity, pad_id, "<i4"), np.zeros(len(rows) * capacity, "<i4")
            ids[place] = np.concatenate([x[2] for x in items])
            positions[place] = place - begin[item]
            cuts = np.insert(ends - base, first, 0)
            cut_at, item_at = np.concatenate((first + np.arange(len(rows)), [len(cuts)])), np.concatenate((first, [len(items)]))
            listed = lambda at, values, kind: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
            columns = [pa.array(np.full(len(rows), shard)), pa.array(np.arange(len(rows)), pa.int32()), _rows_of(ids, capacity), _rows_of(positions, capacity), listed(cut_at, cuts, pa.int32()), listed(item_at, [x[0] for x in items], pa.int64()), listed(item_at, [x[1] for x in items], pa.int64()), pa.array(np.add.reduceat(size, first), pa.int32())]
            return pa.record_batch(columns, [x.split()[0] for x in PACKED.split(", ")])

        for b in slices(batches, "text", TEXT_BYTES):
            for doc, ids in zip(b.column("doc_id").to_pylist(), bpe.encode(b.column("text")), strict=True):
                held += [(doc, at, ids[at : at + capacity]) for at in range(0, len(ids), capacity)]
                tokens += len(ids)
                if tokens >= shard_tokens:
                    yield packed()
                    held, shard, tokens = [], shard + 1, 0
        if held:
            yield packed()

    small_batches(docs.sparkSession)
    return spread_out(docs.select(as_long(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, PACKED)


def digests(packed: DataFrame) -> DataFrame:
    """The packed rows with SHA-256 digests in place of the two matrices' rows."""
    return packed.select("shard", "row", "n_tokens", F.size("doc_ids").alias("n_segments"), "doc_ids", "starts", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


def write(packed: DataFrame, path: str) -> None:
    """Write the matrices, segment lengths and position resets as Parquet, by Spark's writer and so safe against lost tasks."""
    packed.write.parquet(path)


