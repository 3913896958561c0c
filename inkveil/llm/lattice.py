"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points, neighbour cells probed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import materialize, small_batches
from inkveil.llm.components import connected_components
from inkveil.llm.vectors import dimension, matrix, selected

#: The 240 shortest vectors of E8: what leads from a point to its neighbours.
ROOTS = np.array(
    [[(s if k == i else t if k == j else 0) for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    + [[x / 2 for x in signs] for signs in product((1, -1), repeat=8) if np.prod(signs) == 1]
)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd round the worst component the other way."""
    r = np.round(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    if len(odd):
        gap = x[odd] - r[odd]
        worst = np.abs(gap).argmax(axis=1)
        r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of rows of eight numbers: E8 is D8 and D8 shifted by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def tables_of(dim: int, tables: int, pieces: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections (tables x pieces x dim x 8) with orthogonal columns where dim allows, and shifts of the lattice."""
    random = np.random.default_rng(seed)
    made = [np.linalg.qr(random.standard_normal((max(dim, 8), 8)))[0][:dim] for _ in range(tables * pieces)]
    return np.array(made).reshape(tables, pieces, dim, 8), random.uniform(0, 1, (tables, pieces, 8))


def cells(unit: np.ndarray, projections: np.ndarray, shifts: np.ndarray, scale: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x pieces x 8 doubled home points, rows x probes x pieces x 8 doubled probed points) for one table.

    The probed cells are the nearest other cells, reached from home by a root in one piece.
    """
    points, gains, moved = [], [], []
    for p, (projection, shift) in enumerate(zip(projections, shifts, strict=True)):
        x = unit @ projection * scale + shift
        home = decode(x)
        gain = (x - home) @ ROOTS.T  # the higher, the nearer lies home + root
        points.append(home)
        gains.append(gain)
        moved.append(np.full(len(ROOTS), p))
    home, gain, piece = np.stack(points, 1), np.hstack(gains), np.concatenate(moved)
    pick = np.argpartition(-gain, min(probes, gain.shape[1] - 1), axis=1)[:, :probes]
    near = np.repeat(home[:, None], probes, axis=1)
    row, col = np.indices(pick.shape)
    near[row, col, piece[pick]] += ROOTS[pick % len(ROOTS)]
    return np.rint(2 * home).astype(np.int64), np.rint(2 * near).astype(np.int64)


def _hash(points: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit hash of rows of small integers."""
    flat = points.reshape(*points.shape[: points.ndim - 2], -1).astype(np.uint64)
    h = np.full(flat.shape[:-1], 0x9E3779B97F4A7C15 ^ (table * 0x2545F491), np.uint64)
    for i in range(flat.shape[-1]):
        h = (h ^ flat[..., i]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def candidate_links(classes: DataFrame, dim: int, threshold: float, tables: int, probes: int, pieces: int, scale: float, seed: int, sketch_bits: int = 64) -> DataFrame:
    """Pairs (a, b), a < b, of classes (id, part, v) of one part that share a cell, or one's cell is probed by the other.

    A row's sketch holds the signs of `sketch_bits` more projections; pairs whose sketches differ in more bits than a
    pair at the threshold does but once in millions are dropped before their vectors are moved.
    """
    projections, shifts = tables_of(dim, tables, pieces, seed)
    signs = np.random.default_rng(seed + 1).standard_normal((dim, sketch_bits))
    share = np.arccos(threshold) / np.pi
    apart = int(np.ceil(sketch_bits * share + 5.5 * np.sqrt(sketch_bits * share * (1 - share))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                v = matrix(b.column("v"))
                unit = v / np.linalg.norm(v, axis=1)[:, None]
                ids, parts = b.column("id").to_numpy(), b.column("part").to_numpy()
                sketch = np.packbits(unit @ signs >= 0, axis=1, bitorder="little").view("<i8").ravel()
                for t in range(tables):
                    home, near = (_hash(x, t) for x in cells(unit, projections[t], shifts[t], scale, probes))
                    keys = np.hstack((home[:, None], near)).ravel()
                    n = probes + 1
                    probed = np.tile(np.arange(n) > 0, len(ids))
                    yield pa.record_batch([pa.array(keys), pa.array(np.repeat(parts, n)), pa.array(probed), pa.array(np.repeat(ids, n)), pa.array(np.repeat(sketch, n))], ["cell", "part", "probed", "id", "sketch"])

    keyed = classes.select("id", F.col("part").cast("long").alias("part"), "v").mapInArrow(run, "cell long, part long, probed boolean, id long, sketch long")
    held = keyed.where("not probed").select("cell", "part", F.col("id").alias("b"), F.col("sketch").alias("sb"))
    asks = keyed.select("cell", "part", F.col("id").alias("a"), F.col("sketch").alias("sa"), "probed")
    met = asks.join(held, ["cell", "part"]).where((F.col("a") != F.col("b")) & (F.col("probed") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= apart))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose cosine in double precision reaches the threshold."""
    v = classes.select("id", "v")
    both = pairs.join(v.withColumnsRenamed({"id": "a", "v": "va"}), "a").join(v.withColumnsRenamed({"id": "b", "v": "vb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = matrix(b.column("va")), matrix(b.column("vb"))
            near = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))) >= threshold
            yield pa.record_batch([pa.array(b.column(c).to_numpy()[near]) for c in ("a", "b")], ["a", "b"])

    return both.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def near_dedup(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", part_col: str = "label", threshold: float = 0.98, tables: int = 6, probes: int = 24, pieces: int = 1, scale: float = 6.0, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Rows link if their part_col values are equal and not null and their vectors' cosine is at least the threshold. Equal
    vectors of a part are one class from the start, so copies form no pairs; a class's links count all its members and
    those of linked classes. component_id is the smallest id reachable, kept is vec_id = component_id. Rows whose part
    is null, or whose vector is null, empty, zero or holds a null or non-finite component, have no link and stay. Rows
    with a null id have no link and null for component_id and kept. Rows that repeat an id count as members each.

    Distances shrink like sqrt(8 / dim) in a projection; scale sets a pair at the threshold apart by less than half the
    distance of neighbouring lattice points. `pieces` lattices in a row make finer cells for larger tables.
    """
    spark = rows.sparkSession
    small_batches(spark)
    part = F.col(part_col).cast("long").alias("part")
    live = selected(rows, id_col, vector_col, part).where("part is not null").where(F.exists("v", lambda x: x != 0))
    live = live.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 and 0.0 are one value
    members = materialize(live.select("id", "part", "v", F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary")).alias("h")))
    classes = materialize(members.groupBy("part", "h").agg(F.min("id").alias("id"), F.count("*").alias("size"), F.min_by("v", "id").alias("v")))
    dim = dimension(classes)
    if dim:
        links = materialize(verified(candidate_links(classes, dim, threshold, tables, probes, pieces, scale, seed), classes, threshold))
    else:
        links = spark.createDataFrame([], "a long, b long")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("id").alias("b"), "size")
    others = both.join(sizes, "b").groupBy("a").agg(F.sum("size").alias("others"))
    roots = connected_components(links)
    told = classes.join(others, classes.id == others.a, "left").join(roots, classes.id == roots.node, "left")
    told = told.select("part", "h", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    mine = members.join(told, ["part", "h"]).select("id", "n_links", "component_id").distinct()
    ids = rows.select(F.col(id_col).cast("long").alias("vec_id"))
    out = ids.join(mine.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), ids.vec_id == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
