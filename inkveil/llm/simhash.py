"""SimHash near-duplicate detection by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import as_long, materialize, mix, partitions, slices, small_batches, spread
from inkveil.llm.components import connected_components, stars
from inkveil.plans.storage import spread_out

#: A block group above this size is cut into tiles of pairs of parts, each of about this many fingerprints.
TILE = 2048
#: Fingerprints whose keys tell which groups are that large, at most. Any choice gives the same links.
SAMPLED = 1 << 14
#: Groups up to this size are compared at once, pair by pair; larger ones by forest().
SMALL = 256
#: How a fingerprint travels to each of its groups, and how many a task makes at once and a bucket holds, about.
RECORD = np.dtype([("tile", "<u4"), ("fp", "<u8"), ("fp2", "<u8"), ("node", "<i8")])
RECORDS = 1 << 20
_MORE = np.uint64(0x9E3779B97F4A7C15)
#: Fingerprints above which near_dedup() takes longer block keys; either choice is exact.
MANY = 1 << 24
#: Orders of the bits that similar_groups() takes its 16-bit keys from, whatever the size of the input.
ORDERS = 16
#: Texts of a group that are compared by their shingles at once.
VERIFIED = 256


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; A-Z lower-cased, words between ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one text; 0 if it has no word."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, wide: bool = False) -> DataFrame:
    """(doc_id, fp, fp2) of every row: the fingerprint as a signed long, and with `wide` 64 bits more, else 0.

    Null, empty and white texts have 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            hashes = [shingle_hashes(t, shingle, seed) for t in b.column("text").to_pylist()]
            fps = np.array([majority(h) for h in hashes], np.uint64)
            more = np.array([majority(mix(h + _MORE)) if wide else 0 for h in hashes], np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fps.view(np.int64)), pa.array(more.view(np.int64))], ["doc_id", "fp", "fp2"])

    small_batches(docs.sparkSession)
    return spread_out(docs.select(as_long(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, "doc_id long, fp long, fp2 long")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of the bits that pairs within `distance` agree on for one mask at least: any blocks-distance of the blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(one[i] for i in pick) for pick in combinations(range(blocks), blocks - distance)]


def exact_keys(distance: int, blocks: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Keys (rows x choices) of 64-bit fingerprints; pairs within `distance` bits share one for certain."""
    masks = np.array(block_masks(distance, blocks), np.uint64)
    names = mix(np.arange(len(masks), dtype=np.uint64))
    return lambda fp, fp2: mix((fp[:, None] & masks) ^ names).view(np.int64)


def sampled_keys(orders: int, width: int, seed: int = 5) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Keys of 128-bit fingerprints: blocks of `width` bits of several fixed random orders of the bits."""
    random = np.random.default_rng(seed)
    columns = np.concatenate([random.permutation(128)[: 128 // width * width].reshape(-1, width) for _ in range(orders)])

    def keys(fp: np.ndarray, fp2: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.stack((fp, fp2), 1).astype("<u8").view(np.uint8).reshape(len(fp), 16), axis=1, bitorder="little")
        out = np.zeros((len(fp), len(columns)), np.uint64)
        for i, c in enumerate(columns):
            packed = np.zeros((len(fp), 8), np.uint8)
            packed[:, : -(-width // 8)] = np.packbits(bits[:, c], axis=1, bitorder="little")
            out[:, i] = mix(packed.view("<u8").ravel() | np.uint64(i << 32))
        return out.view(np.int64)

    return keys


def forest(fps: np.ndarray, distance: int, more: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (index, index) that connect what the fingerprints' links connect, at most one fewer than fingerprints.

    A search from each fingerprint not reached yet; a step compares one fingerprint with all that are left, so
    a tight group is used up in a few steps and no list of all pairs arises.
    """
    left, found = np.arange(len(fps)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            apart = np.bitwise_count(fps[left] ^ fps[at])
            if more is not None:
                apart = apart + np.bitwise_count(more[left] ^ more[at])
            near = apart <= distance
            if near.any():
                got = left[near].tolist()
                found += [(at, x) for x in got]
                queue += got
                left = left[~near]
    return found


def group_links(rows: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (nodes, nodes) among RECORDs of the same tile that connect those within `distance` bits."""
    rows = rows[np.argsort(rows["tile"], kind="stable")]
    fp, fp2, node = (np.ascontiguousarray(rows[c]) for c in ("fp", "fp2", "node"))
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(rows)), bool), rows["tile"][1:] != rows["tile"][:-1])))
    ends = np.append(starts[1:], len(rows))[: len(starts)]
    size = ends - starts
    end = np.repeat(ends, size)
    at, ahead = np.flatnonzero(np.repeat(size <= SMALL, size)), 1
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at := at[at + ahead < end[at]]):
        near = at[np.bitwise_count(fp[at] ^ fp[at + ahead]) + np.bitwise_count(fp2[at] ^ fp2[at + ahead]) <= distance]
        a.append(node[near])
        b.append(node[near + ahead])
        ahead += 1
    for s, e in zip(starts[size > SMALL].tolist(), ends[size > SMALL].tolist(), strict=True):
        if got := forest(fp[s:e], distance, fp2[s:e]):
            x, y = np.array(got).T
            a.append(node[s:e][x])
            b.append(node[s:e][y])
    return np.concatenate(a), np.concatenate(b)


def large_groups(nodes: DataFrame, total: int, keys: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, parts) of the groups that a sample of SAMPLED fingerprints shows to be beyond TILE."""
    share = min(1.0, SAMPLED / max(1, total))
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 40)) < int(share * (1 << 40))).select("fp", "fp2").limit(2 * SAMPLED).toArrow()
    fp, fp2 = (sample.column(i).to_numpy().view(np.uint64) for i in (0, 1))
    key, n = np.unique(keys(fp, fp2).view(np.uint64), return_counts=True)
    parts = np.ceil(n / share / TILE).astype(np.int64)
    return key[parts > 1], parts[parts > 1]


def near_links(nodes: DataFrame, distance: int, keys: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Links (a, b) among distinct fingerprints `nodes` (fp, fp2, node) that connect those within `distance` bits.

    Rows meet on block keys, in one shuffle of packed records; the Hamming distance is then verified. Groups beyond TILE,
    as a sample tells, are dealt as tiles of two parts each (all pairs of parts), so that no task holds a whole hot group;
    a task gives stars of what its links connect, not its pairs.
    """
    spark = nodes.sparkSession
    total, per_node = nodes.count(), keys(np.zeros(1, np.uint64), np.zeros(1, np.uint64)).shape[1]
    hot, parts = large_groups(nodes, total, keys)
    buckets = max(partitions(spark), total * per_node // RECORDS)

    def packed(fp: np.ndarray, fp2: np.ndarray, node: np.ndarray, key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        row, key, count = np.repeat(np.arange(len(node)), key.shape[1]), key.ravel(), count.ravel()
        if (count > 1).any():
            own = (mix(node[row].view(np.uint64) ^ key) % count.astype(np.uint64)).astype(np.int64)
            of, other = spread(np.zeros(len(count), np.int64), count)
            pair = (np.minimum(own[of], other) << 32 | np.maximum(own[of], other)).astype(np.uint64)
            row, key = row[of], np.where(count[of] > 1, mix(key[of] ^ mix(pair + np.uint64(1))), key[of])
        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        row, bucket = row[order], bucket[order]
        out = np.empty(len(row), RECORD)
        out["tile"], out["fp"], out["fp2"], out["node"] = key[order] & np.uint64(0xFFFFFFFF), fp[row], fp2[row], node[row]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        pieces = [out[s:e].tobytes() for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(out)], strict=True)]
        return pa.record_batch([pa.array(bucket[cuts].astype(np.int32)), pa.array(pieces, pa.binary())], ["bucket", "records"])

    def dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, fp2, node = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        fp, fp2 = fp.view(np.uint64), fp2.view(np.uint64)
        key = keys(fp, fp2).view(np.uint64)
        count = np.ones(key.shape, np.int64)
        if len(hot):
            where = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            count = np.where(hot[where] == key, parts[where], 1)
        upto, start = np.concatenate(([0], np.cumsum(count.sum(axis=1)))), 0
        while start < len(node):
            end = max(start + 1, int(np.searchsorted(upto, upto[start] + RECORDS, "right")) - 1)
            yield packed(fp[start:end], fp2[start:end], node[start:end], key[start:end], count[start:end])
            start = end

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) * per_node >= RECORDS // 2:
                yield from dealt(held)
                held = []
        if held:
            yield from dealt(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x.as_py(), RECORD) for b in batches for x in b.column(1)]
        if held:
            a, b = stars(*group_links(np.concatenate(held), distance))
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    records = nodes.select("fp", "fp2", "node").mapInArrow(spell, "bucket int, records binary")
    return records.repartitionById(buckets, "bucket").mapInArrow(run, "a long, b long")


def _grouped(fps: DataFrame, distance: int) -> DataFrame:
    """fps (doc_id, fp, fp2) with component_id."""
    nodes = materialize(fps.groupBy("fp", "fp2").agg(F.min("doc_id").alias("node")).where("node is not null"))
    keys = exact_keys(distance, distance + 2 if nodes.count() < MANY else distance + 4)
    roots = connected_components(near_links(nodes, distance, keys))
    named = nodes.join(roots, "node", "left").select("fp", "fp2", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, ["fp", "fp2"], "left")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Pigeonhole: the 64 bits form distance + 2 blocks (distance + 4 for very many fingerprints); two that differ in at
    most `distance` bits agree on all but `distance` blocks, so they share a key for one choice of so many blocks. Equal
    fingerprints are one node whose name is their smallest doc_id, so copies never form pairs.

    Null, empty and white texts have fingerprint zero and link like any other. Rows with a null doc_id form no node; they
    get the component of their fingerprint, or null if no row with an id has it. Repeated rows give repeated results;
    columns other than the two named are not looked at.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, seed))
    return _grouped(fps, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def expected_bits(similarity: float, bits: int = 128) -> float:
    """Expected differing bits of texts with this Jaccard similarity of shingles (cosine 2J / (1 + J))."""
    return bits * float(np.arccos(2 * similarity / (1 + similarity))) / np.pi


def packed_set(hashes: np.ndarray) -> bytes:
    """The sorted distinct hashes, eight bytes each."""
    return np.unique(hashes).astype("<u8").tobytes()


def set_name(packed: bytes) -> int:
    """A 64-bit hash (signed) of a packed set: texts that share it have similarity one."""
    name = xxhash.xxh64_intdigest(packed)
    return name - (name >> 63 << 64)


def set_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """(doc_id, fp, fp2, node) of every row: 128 bits of fingerprint, and the name of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            hashes = [shingle_hashes(t, shingle, seed) for t in b.column("text").to_pylist()]
            fp, fp2 = (pa.array(np.array([majority(h) for h in x], np.uint64).view(np.int64)) for x in (hashes, [mix(h + _MORE) for h in hashes]))
            yield pa.record_batch([b.column("doc_id"), fp, fp2, pa.array([set_name(packed_set(h)) for h in hashes], pa.int64())], ["doc_id", "fp", "fp2", "node"])

    small_batches(docs.sparkSession)
    rows = docs.select(as_long(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread_out(rows).mapInArrow(run, "doc_id long, fp long, fp2 long, node long")


def similar_forest(sets: list[np.ndarray], fp: np.ndarray, fp2: np.ndarray, distance: int, similarity: float) -> list[tuple[int, int]]:
    """As forest(), but a link needs `similarity` of the sets (sorted, distinct) besides `distance` of the fingerprints."""
    size = np.array([len(x) for x in sets])
    left, found = np.arange(len(sets)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) + np.bitwise_count(fp2[left] ^ fp2[at]) <= distance
            near &= np.minimum(size[left], size[at]) >= similarity * np.maximum(size[left], size[at])
            for i in np.flatnonzero(near).tolist():
                both = len(np.intersect1d(sets[at], sets[left[i]], assume_unique=True))
                near[i] = both >= similarity * (size[at] + size[left[i]] - both)
            got = left[near].tolist()
            found += [(at, x) for x in got]
            queue += got
            left = left[~near]
    return found


def verified_links(groups: DataFrame, texts: DataFrame, shingle: int, seed: int, distance: int, similarity: float) -> DataFrame:
    """Links (a, b) between nodes of one group (node, least, fp, fp2, component) whose shingles have the similarity.

    texts: __id, text; a node's text is one of its least id. A group's nodes meet in tiles of two parts each, as in
    near_links(), so that every pair is met and no task holds a large group; a tile gives stars of what its true links
    connect. Texts are shuffled once, by id, and the shingles once, by tile.
    """
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / VERIFIED).cast("int").alias("parts"))
    dealt = groups.join(sizes, "component").withColumn("own", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.xxhash64("component", F.least("own", other), F.greatest("own", other)))
    asked = dealt.select(F.col("least").alias("__id"), "node", "fp", "fp2", tiles.alias("tiles"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [packed_set(shingle_hashes(t, shingle, seed)) for t in b.column("text").to_pylist()]
            own = [set_name(x) == n for x, n in zip(sets, b.column("node").to_pylist(), strict=True)]  # an id may come with several texts
            yield pa.record_batch([*(b.column(c) for c in ("tiles", "node", "fp", "fp2")), pa.array(sets, pa.binary())], ["tiles", "node", "fp", "fp2", "shingles"]).filter(pa.array(own, pa.bool_()))

    small_batches(groups.sparkSession)
    sets = texts.join(asked, "__id").select("text", "tiles", "node", "fp", "fp2").mapInArrow(spell, "tiles array<long>, node long, fp long, fp2 long, shingles binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, int, bytes]] = {}
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            nodes = list(held)
            fp, fp2 = (np.array([held[x][i] for x in nodes], np.int64).view(np.uint64) for i in (0, 1))
            got = similar_forest([np.frombuffer(held[x][2], "<u8") for x in nodes], fp, fp2, distance, similarity)
            if got:
                a, b = stars(*(np.array([nodes[x[i]] for x in got], np.int64) for i in (0, 1)))
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            for tile, node, fp, fp2, shingles in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if tile != now:
                    yield from done()
                    held, now = {}, tile
                held[node] = (fp, fp2, shingles)
        yield from done()

    met = sets.select(F.explode("tiles").alias("tile"), "node", "fp", "fp2", "shingles")
    return met.repartition(partitions(groups.sparkSession), "tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """(doc_id, component_id) where texts link whose distinct shingles' Jaccard similarity is `similarity` or more.

    Candidates are within the expected distance at that similarity and three standard deviations more, of 128 bits; keys
    of sampled 16-bit blocks, the same at every size, lead to them. Groups of candidates are then searched for links by
    the exact similarity of their shingles, so nothing below it links. Shingles and sets are told apart by 64-bit hashes.
    Nulls and repeated rows as in near_dedup(); copies are one node.
    """
    fps = materialize(set_fingerprints(docs, id_col, text_col, shingle, seed))
    distance = allowed_bits(similarity)
    nodes = fps.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("fp", "fp2")).alias("f")).where("least is not null")
    nodes = materialize(nodes.select("node", "least", "f.fp", "f.fp2"))
    near = connected_components(near_links(nodes, distance, sampled_keys(ORDERS, 16)))
    groups = materialize(nodes.join(near, "node"))
    texts = docs.select(as_long(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    roots = connected_components(verified_links(groups, texts, shingle, seed, distance, similarity))
    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(first, "component").select("node", "component_id"), "node", "left").select("doc_id", "component_id")


def allowed_bits(similarity: float) -> int:
    """The distance within which candidates lie: the expected one and three standard deviations more."""
    mean = expected_bits(similarity)
    return int(mean + 3 * np.sqrt(mean * (1 - mean / 128)))


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the documents whose group has a smaller id; rows with a null id, and all that repeat the
    smallest one, stay. Columns are those of docs.

    Of groups only the ids that go are joined; texts move only if those ids are too many to broadcast.
    """
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
