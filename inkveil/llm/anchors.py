"""Passages that texts may share, found by anchors and dealt to shards.

A window is k consecutive tokens (words or bytes) of one text. Its anchor is the least hash among the n-grams inside it,
so equal windows have equal anchors, and neighbouring windows mostly share one. Anchors that two texts hold mark the
only windows that can be equal; the maximal runs of such windows with one anchor are cut out as pieces and meet in the
shard of that anchor, where an exact method decides. All of this is linear in the text, and no task gathers more than its
share of anchors: a batch sends one entry for an anchor however many of its texts hold it.

Equal texts are one text here: equal in two independent 64-bit hashes (10**10 texts hold a false pair with a chance of
10**-19). Its rank is the smallest doc_id that has it: all windows of a later copy are repeats, so only the first is searched.

Equal pieces are settled where they are read: an occurrence with a larger rank than another one that its task has met is
a repeat as a whole, and only the others travel. So of a line that a third of all documents holds, a task sends about as
many pieces as its least rank changes, and the shard of that anchor grows with the tasks and not with the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import mix, partitions, slices, small_batches, spread, text_buffer
from inkveil.llm.words import find_words, hash_grams, hash_words
from inkveil.plans.storage import spread_out

#: Pieces that a task remembers the least rank of, of those that it met more than once.
REMEMBERED = 1 << 18

#: Bytes of text whose anchors, and whose pieces, leave a task together.
FLUSH_ANCHORS, FLUSH_PIECES = 24 << 20, 2 << 20
LAST = (1 << 63) - 1
_LOW = np.uint64((1 << 40) - 1)


@dataclass(frozen=True)
class Unit:
    """What tokens are: their byte ranges, and hashes of runs of `gram` of them."""

    name: str
    window: int
    gram: int
    #: (offsets, data) -> (start, end, text) of the tokens
    tokens: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: (data, start, end) -> hash of each run of `gram` tokens
    grams: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _byte_tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(len(data))
    return at, at + 1, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _byte_grams(gram: int) -> Callable:
    def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data) - gram + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        two = data[:-1].astype(np.uint64) | (data[1:].astype(np.uint64) << np.uint64(8))
        four = two[:-2] | (two[2:] << np.uint64(16))
        eight = four[:-4] | (four[4:] << np.uint64(32))
        out = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
        for at in [*range(8, gram - 8, 8), gram - 8]:
            out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + eight[at : at + n]
        return mix(out)

    return hashes


def byte_unit(window: int, gram: int = 20) -> Unit:
    return Unit("byte", window, gram, _byte_tokens, _byte_grams(gram))


def word_unit(window: int, gram: int = 4) -> Unit:
    return Unit("word", window, gram, find_words, lambda data, start, end: hash_grams(hash_words(data, start, end), gram))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have :][: len(x) - width + 1]) if have < width else out


def runs(unit: Unit, data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first token, windows, anchor) of each maximal run of a text's windows that share an anchor."""
    n = len(start) - unit.window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    least = sliding_min(unit.grams(data, start, end), unit.window - unit.gram + 1)
    first = np.flatnonzero(text[:n] == text[unit.window - 1 :])
    if not len(first):
        return none, none, none, np.zeros(0, np.uint64)
    least, owner = least[first], text[first]
    cut = np.concatenate(([0], np.flatnonzero((least[1:] != least[:-1]) | (owner[1:] != owner[:-1])) + 1))
    return owner[cut], first[cut], np.diff(np.concatenate((cut, [len(first)]))), least[cut]


def shorten(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """An anchor's bucket (from its high bits) above its low 40 bits: the more buckets, the more bits tell anchors apart."""
    return (((anchor >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40)) | (anchor & _LOW)


def _with_repeats(anchor: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (anchor, key) in order; True at the first of each anchor; True where an anchor has several keys."""
    order = np.lexsort((key, anchor))
    anchor, key = anchor[order], key[order]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1])
    anchor, key = anchor[fresh], key[fresh]
    first = np.ones(len(anchor), bool)
    first[1:] = anchor[1:] != anchor[:-1]
    at = np.flatnonzero(first)
    return anchor, key, first, np.repeat(np.diff(np.concatenate((at, [len(anchor)]))) > 1, np.diff(np.concatenate((at, [len(anchor)]))))


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rank, key, digest, text): the id is the rank, a null id ranks like the largest; a null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("rank"), "text", F.xxhash64("text").alias("key"), F.xxhash64(F.lit("second"), "text").alias("digest"))


def shared_anchors(texts: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    """(key, anchors array<long>): for each text the shortened anchors that another text has too."""
    spark = texts.sparkSession

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, tick = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            anchor, key, first, many = _with_repeats(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            rows = []
            for asks, pick in ((True, first), (False, many)):
                a, k = anchor[pick], key[pick]
                b = (a >> np.uint64(40)).astype(np.int64) if asks else (k.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((k, b))
                a, k, b = a[order], k[order], b[order]
                cut = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)])) if len(b) else [0]
                low = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]) if asks else a.astype("<u8")
                rows += [(int(b[s]), asks, low[s:e].tobytes(), k[s:e].tobytes()) for s, e in zip(cut[:-1], cut[1:], strict=True)]
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["bucket", "asks", "anchors", "keys"])

        for b in slices(batches, "text"):
            offsets, data = text_buffer(b.column("text"))
            start, end, text = unit.tokens(offsets, data)
            owner, _, _, anchor = runs(unit, data, start, end, text)
            held.append((shorten(anchor, buckets), b.column("key").to_numpy()[owner]))
            size += len(data)
            if size >= FLUSH_ANCHORS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = [], []
        for b in batches:
            for bucket, asks, anchors, keys in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                key = np.frombuffer(keys, np.int64)
                if asks:
                    wide = np.zeros((len(key), 8), np.uint8)
                    wide[:, :5] = np.frombuffer(anchors, np.uint8).reshape(-1, 5)
                    asked.append((wide.view("<u8").ravel() | np.uint64(bucket << 40), key))
                else:
                    known.append((np.frombuffer(anchors, np.uint64), key))
        if asked:
            anchor, key, _, many = _with_repeats(np.concatenate([x[0] for x in asked]), np.concatenate([x[1] for x in asked]))
            known.append((anchor[many], key[many]))
        if known:
            yield pa.record_batch([pa.array(np.concatenate([x[1] for x in known])), pa.array(np.concatenate([x[0] for x in known]).view(np.int64))], ["key", "anchor"])

    sent = texts.select("key", "text").mapInArrow(send, "bucket long, asks boolean, anchors binary, keys binary")
    found = sent.repartition(partitions(spark), "bucket").mapInArrow(match, "key long, anchor long")
    return found.groupBy("key").agg(F.collect_list("anchor").alias("anchors"))  # of one text, and so bounded by it


PIECES = "bucket long, anchors binary, keys binary, ranks binary, firsts binary, counts binary, sizes binary, data binary"


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] + [pa.binary()] * 7
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])


def settled_row(bucket: int, key: np.ndarray, rank: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return _piece_rows([(bucket, b"", key.tobytes(), rank.tobytes(), first.astype("<i4").tobytes(), count.astype("<i4").tobytes(), b"", b"")])


class Met:
    """The least ranks of pieces (by hash) that a task has met more than once."""

    def __init__(self) -> None:
        self.hashes, self.ranks = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def settled(self, hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Which of these occurrences have an equal one with a smaller rank, here or before."""
        names, at, times = np.unique(hashes, return_inverse=True, return_counts=True)
        least = np.full(len(names), LAST)
        np.minimum.at(least, at, ranks)
        known = np.searchsorted(self.hashes, names)
        known[known == len(self.hashes)] = 0
        again = self.hashes[known] == names if len(self.hashes) else np.zeros(len(names), bool)
        least[again] = np.minimum(least[again], self.ranks[known[again]])
        self.ranks[known[again]] = least[again]
        fresh = ~again & (times > 1)
        if fresh.any():
            if len(self.hashes) + fresh.sum() > REMEMBERED:  # start afresh: what is forgotten is sent once more
                self.hashes, self.ranks = self.hashes[:0], self.ranks[:0]
            both = np.concatenate((self.hashes, names[fresh]))
            order = np.argsort(both)
            self.hashes, self.ranks = both[order], np.concatenate((self.ranks, least[fresh]))[order]
        return ranks > least[at]


def pieces_by_shard(firsts: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    """Blobs of pieces by bucket from (key, rank, text, anchors); a piece holds all tokens of its run of windows.

    Occurrences that are repeats as a whole come as rows without data: (key, rank, first window, windows) is all they need.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met()
        for b in slices(batches, "text", FLUSH_PIECES):
            offsets, data = text_buffer(b.column("text"))
            start, end, text = unit.tokens(offsets, data)
            owner, first, count, anchor = runs(unit, data, start, end, text)
            if not len(owner):
                continue
            short = shorten(anchor, buckets)
            lists = b.column("anchors")
            wanted = lists.flatten().to_numpy().view(np.uint64)
            holder = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            salt = np.uint64(0x9E3779B97F4A7C15)
            keep = np.isin(mix(short + owner.astype(np.uint64) * salt), mix(wanted + holder.astype(np.uint64) * salt))
            owner, first, count, short = owner[keep], first[keep], count[keep], short[keep]
            token0 = np.searchsorted(text, np.arange(b.num_rows), "left")  # a text's first token
            all_ranks = b.column("rank").to_numpy()
            told = met.settled(mix(short + hash_words(data, start[first], end[first + count + unit.window - 2])), all_ranks[owner]) if len(owner) else np.zeros(0, bool)
            if told.any():
                o, f = owner[told], first[told]
                yield settled_row(int(short[told][0] >> np.uint64(40)), b.column("key").to_numpy()[o], all_ranks[o], f - token0[o], count[told])
                owner, first, count, short = owner[~told], first[~told], count[~told], short[~told]
            order = np.argsort(short, kind="stable")
            owner, first, count, short = owner[order], first[order], count[order], short[order]
            begin, stop = start[first], end[first + count + unit.window - 2]
            size = stop - begin
            bucket = (short >> np.uint64(40)).astype(np.int64)
            edges = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
            key, rank = b.column("key").to_numpy()[owner], all_ranks[owner]
            rows = []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                place = spread(begin[s:e], size[s:e])[1]
                rows.append((int(bucket[s]), short[s:e].tobytes(), key[s:e].tobytes(), rank[s:e].tobytes(), (first[s:e] - token0[owner[s:e]]).astype("<i4").tobytes(), count[s:e].astype("<i4").tobytes(), size[s:e].astype("<i4").tobytes(), data[place].tobytes()))
            if rows:
                yield _piece_rows(rows)

    # doc_id and least are not read here, but with them both joins of removals() shuffle the same columns of the texts, once
    return firsts.select("key", "rank", "text", "anchors", "doc_id", "least").mapInArrow(cut, PIECES)


@dataclass
class Shard:
    """The pieces of one task's buckets, by anchor and then by rank."""

    anchor: np.ndarray
    key: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    count: np.ndarray
    offset: np.ndarray
    data: np.ndarray


def load_shard(batches: Iterator[pa.RecordBatch], settled: list[tuple[np.ndarray, ...]]) -> Shard | None:
    """The pieces of the batches; the rows that are settled already go into the list as (key, rank, first, count)."""
    kinds = (np.uint64, np.int64, np.int64, np.int32, np.int32, np.int32, np.uint8)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for b in batches:
        for row in zip(*(b.column(i + 1).to_pylist() for i in range(len(kinds))), strict=True):
            made = [np.frombuffer(x, kind) for x, kind in zip(row, kinds, strict=True)]
            if len(made[0]):
                for part, x in zip(parts, made, strict=True):
                    part.append(x)
            else:
                settled.append(tuple(made[1:5]))
    if not parts[0]:
        return None
    anchor, key, rank, first, count, size, data = (np.concatenate(p) for p in parts)
    begin = np.cumsum(size, dtype=np.int64) - size
    order = np.lexsort((first, key, rank, anchor))
    size = size[order].astype(np.int64)
    moved = np.concatenate([data[s : s + n] for s, n in zip(begin[order].tolist(), size.tolist(), strict=True)])
    return Shard(anchor[order], key[order], rank[order], first[order], count[order], np.concatenate(([0], np.cumsum(size))), moved)


def span_rows(key: np.ndarray, rank: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """(key, rank, span): each text's repeated windows as runs of windows [first, end), joined where they touch; start in the
    high 32 bits of a span and the end in the low."""
    order = np.lexsort((first, rank, key))
    key, rank, first, end = key[order], rank[order], first[order].astype(np.int64), end[order].astype(np.int64)
    text = np.ones(len(key), bool)
    text[1:] = (key[1:] != key[:-1]) | (rank[1:] != rank[:-1])
    lift = np.cumsum(text) << 33  # so that the running maximum starts anew with each text
    reach = np.maximum.accumulate(end + lift)
    fresh = text.copy()
    fresh[1:] |= first[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    ends = reach[np.concatenate((at[1:], [len(key)])) - 1] - lift[at]
    return pa.record_batch([pa.array(key[at]), pa.array(rank[at]), pa.array((first[at] << 32) | ends)], ["key", "rank", "span"])


def removals(docs: DataFrame, unit: Unit, decide: Callable[[Shard, int], tuple[np.ndarray, np.ndarray]], finish: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs what `finish` makes of the tokens covered by windows that a smaller doc_id has too.

    decide(shard, window) gives (piece, window of it) of the repeated windows among a shard's pieces; finish(batch, data,
    start, end, text, covered) gives a record batch of `schema`, from the tokens of a batch and which are covered.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    buckets = 4 * partitions(spark)
    texts = texts_of(spread_out(docs.select(id_col, text_col)), id_col, text_col)  # both joins below read these very columns, so the texts are shuffled once
    least = texts.groupBy("key", "digest").agg(F.min("rank").alias("least")).withColumnRenamed("digest", "__digest")
    # "<=" and ">=", as an equality would become a join key, and the texts would be shuffled again by it.
    placed = texts.join(least, "key").where("digest <= __digest and digest >= __digest")
    firsts = placed.where("rank <= least").join(shared_anchors(texts, unit, buckets), "key")
    window = unit.window

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[tuple[np.ndarray, ...]] = []
        if (shard := load_shard(batches, told)) is not None:
            piece, at = decide(shard, window)
            first = shard.first[piece] + at
            told.append((shard.key[piece], shard.rank[piece], first, np.ones(len(first), np.int64)))
        if told:
            key, rank, first, count = (np.concatenate(x) for x in zip(*told, strict=True))
            if len(key):
                yield span_rows(key, rank, first, first + count)

    dealt = pieces_by_shard(firsts, unit, buckets).repartition(partitions(spark), "bucket")
    spans = dealt.mapInArrow(judge, "key long, rank long, span long").repartition(partitions(spark), "key").groupBy("key", "rank").agg(F.collect_list("span").alias("spans")).withColumnRenamed("rank", "__rank")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            offsets, data = text_buffer(b.column("text"))
            start, end, text = unit.tokens(offsets, data)
            count = np.bincount(text, minlength=b.num_rows)
            token0 = np.cumsum(count) - count
            copy = b.column("rank").to_numpy() > b.column("least").to_numpy()
            lists = b.column("spans")
            packed = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(b.num_rows), lists.value_lengths().fill_null(0).to_numpy())
            owner, packed = owner[~copy[owner]], packed[~copy[owner]]
            whole = np.flatnonzero(copy & (count >= window))
            steps = np.zeros(len(start) + 1, np.int64)
            np.add.at(steps, np.concatenate((token0[owner] + (packed >> 32), token0[whole])), 1)
            np.add.at(steps, np.concatenate((token0[owner] + (packed & 0xFFFFFFFF) + window - 1, token0[whole] + count[whole])), -1)
            yield finish(b, offsets, data, start, end, text, np.cumsum(steps[:-1]) > 0)

    # as above: of texts whose keys alone are equal, each has its own spans
    mine = (placed["key"] == spans["key"]) & (F.col("least") <= F.col("__rank")) & (F.col("least") >= F.col("__rank"))
    return placed.join(spans, mine, "left").select("doc_id", "rank", "least", "text", "spans").mapInArrow(cover, schema)
