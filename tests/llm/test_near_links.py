import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.llm import components, simhash

from tests.llm import brute


def nodes_of(spark, fps):
    return spark.createDataFrame([(int(x), int(y), i) for i, (x, y) in enumerate(np.array(fps, np.uint64).view(np.int64))], "fp long, fp2 long, node long")


def crowded(n=300):
    """128-bit fingerprints that agree on the first 16 bits, in clusters, so that one key has them all."""
    r = random.Random(4)
    out = []
    for _ in range(n // 5):
        x = [r.getrandbits(48) << 16, r.getrandbits(64)]
        out.append(list(x))
        for _ in range(4):
            x[r.randrange(2)] ^= 1 << r.randrange(16, 64)
            out.append(list(x))
    return out


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("tile", [2048, 20])
def test_keys_move_once_and_links_connect_what_is_near(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    fps = crowded()
    links = simhash.near_links(nodes_of(spark, fps), 3, simhash.sampled_keys(simhash.ORDERS, 16))
    assert exchanges(links) == 1
    met = {(x.a, x.b) for x in links.collect()}
    assert all(a > b for a, b in met)
    pairs = {frozenset(x) for x in met}
    near = lambda i, j: sum((x ^ y).bit_count() for x, y in zip(fps[i], fps[j], strict=True)) <= 3
    named = list(range(len(fps)))
    assert brute.components(named, lambda i, j: frozenset((i, j)) in pairs) == brute.components(named, near)


def test_hot_groups_are_told_by_a_sample(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 20)
    fps, keys = crowded(), lambda fp, fp2: (fp[:, None] & np.uint64(0xFFFF)).view(np.int64)
    assert [x.tolist() for x in simhash.large_groups(nodes_of(spark, fps), len(fps), keys)] == [[0], [15]]
    monkeypatch.setattr(simhash, "SAMPLED", 100)
    hot, parts = simhash.large_groups(nodes_of(spark, fps), len(fps), keys)
    assert hot.tolist() == [0] and 8 <= parts[0] <= 25
    got = {x.node: x.component for x in components.connected_components(simhash.near_links(nodes_of(spark, fps), 1, keys)).collect()}
    assert got == {i: i - i % 5 for i in range(len(fps))}


@pytest.mark.parametrize("small", [256, 8, 1])
def test_group_links_at_either_size(monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    r = np.random.default_rng(5)
    rows = np.zeros(400, simhash.RECORD)
    rows["tile"], rows["fp"], rows["fp2"], rows["node"] = r.integers(0, 30, 400), r.integers(0, 1 << 10, 400), r.integers(0, 4, 400), r.permutation(400)
    pairs = {frozenset(x) for x in zip(*(x.tolist() for x in simhash.group_links(rows, 2)), strict=True)}
    at = {int(x["node"]): x for x in rows}
    near = lambda i, j: at[i]["tile"] == at[j]["tile"] and sum((int(at[i][c]) ^ int(at[j][c])).bit_count() for c in ("fp", "fp2")) <= 2
    assert brute.components(list(range(400)), lambda i, j: frozenset((i, j)) in pairs) == brute.components(list(range(400)), near)
    assert [len(x) for x in simhash.group_links(rows[:0], 2)] == [0, 0]


def test_stars():
    r = np.random.default_rng(3)
    for n in (0, 1, 40, 90):
        a, b = r.integers(0, 100, (2, n))
        got = dict(zip(*(x.tolist() for x in components.stars(a, b)), strict=True))
        named = sorted({*a.tolist(), *b.tolist()})
        pairs = {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)}
        want = brute.components(named, lambda i, j: frozenset((named[i], named[j])) in pairs)
        assert got == {x: least for x, least in zip(named, want, strict=True) if x != least}


def test_stars_need_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, f=components.materialize: written.append(1) or f(df))
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") % 4).alias("b"))
    got = {x.node: x.component for x in components.connected_components(links).collect()}
    assert got == {i: i % 4 for i in range(60)} and len(written) == 1
    chain = spark.range(9).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {x.component for x in components.connected_components(chain).collect()} == {0} and len(written) > 2


def test_repeated_ids_with_several_texts(spark):
    r = random.Random(2)
    texts = [" ".join(r.choices([f"w{i}" for i in range(500)], k=200)) for _ in range(3)]
    near = [t.rpartition(" ")[0] + " changed" for t in texts]
    rows = [(7, texts[0]), (7, texts[1]), (9, near[0]), (8, near[1]), (8, near[1]), (None, near[2]), (5, texts[2]), (7, None), (11, "")]
    got = sorted(((x.doc_id, x.component_id) for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(7, 7), (7, 7), (9, 7), (8, 7), (8, 7), (None, None), (5, 5), (7, 7), (11, 7)], key=str)
