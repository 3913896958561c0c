import random

import numpy as np
import pytest

from inkveil.llm import anchors, automaton, suffix_dedup
from inkveil.llm.automaton import SuffixAutomaton
from inkveil.llm.suffixes import suffix_array
from tests.llm import brute


def texts(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ß", "a", "b"]
    passages = [" ".join(r.choices(vocabulary, k=r.randint(10, 40))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(r.choices(vocabulary, k=r.randint(0, 30))) for _ in range(r.randint(0, 6))]
        out.append(r.choice([" ", "\n", "\t  "]).join(parts))
    out += [None, "", " \n", "a " * 200, "a " * 150, out[3], out[3], "one two", "x" * 49, "x" * 50, "x" * 50, "x" * 400, " " * 60]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts(1)
    made = list(enumerate(t))
    random.Random(2).shuffle(made)
    return made + [(None, t[3]), (None, "a " * 30), made[0], (7, "same id, other text " * 9)]


@pytest.mark.parametrize(("operator", "plain"), [(automaton.substring_dedup, brute.op1), (suffix_dedup.suffix_dedup, brute.op4)])
def test_against_brute_force(spark, rows, operator, plain):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, key string, rank int").repartition(5)
    assert sorted((tuple(r) for r in operator(df).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("operator", [automaton.substring_dedup, suffix_dedup.suffix_dedup, automaton.deduped_texts, suffix_dedup.deduped_bytes])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_kept_texts(spark, rows):
    import hashlib

    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), hashlib.sha256(r.text.encode()).hexdigest()) for r in automaton.deduped_texts(df).collect())
    assert kept == sorted((str(r[0]), r[3]) for r in brute.op1(rows))
    kept = sorted((str(r.doc_id), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.deduped_bytes(df).collect())
    assert kept == sorted((str(r[0]), r[4]) for r in brute.op4(rows))


@pytest.mark.parametrize("length", [32_800, 32_850, 70_000])
@pytest.mark.parametrize(("operator", "plain"), [(automaton.substring_dedup, brute.op1), (suffix_dedup.suffix_dedup, brute.op4)])
def test_long_runs(spark, length, operator, plain):
    # a run's windows share one anchor, so the run is one piece, whose windows do not fit 16 bits
    run = "-" * length if plain is brute.op4 else "word " * (length // 5)
    made = [(1, "left " + run + " one"), (2, "right " + run + " two")]
    assert sorted((tuple(r) for r in operator(spark.createDataFrame(made, "doc_id long, text string")).collect()), key=str) == plain(made)
    assert plain(made)[1][2] >= length // 5


def test_a_million_equal_bytes(spark):
    made = [(1, "left " + "-" * 10**6 + " one"), (2, "right " + "-" * 10**6 + " two")]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (10**6 + 3, 1)}  # 't ' before and a blank behind as well


@pytest.mark.parametrize(("operator", "plain"), [(automaton.substring_dedup, brute.op1), (suffix_dedup.suffix_dedup, brute.op4)])
def test_a_line_that_most_documents_hold(spark, monkeypatch, operator, plain):
    """Equal pieces are settled where they are read, whichever rank comes first and however little a task remembers."""
    r = random.Random(3)
    line = " ".join(f"common{i}" for i in range(20))
    made = [(i, " ".join(r.choices(["a", "b", "c", "d", "e"], k=25)) + ("\n" + line + "\n" + line if i % 3 else "") + " end" + str(i % 7)) for i in range(120)]
    r.shuffle(made)
    made += [(2**63 - 1, line), (2**63 - 2, line), (-(2**63), line + " x"), (None, "only " + line)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    want = plain([(2**63 - 1 if i is None else i, t) for i, t in made])
    for remembered in (anchors.REMEMBERED, 2):
        monkeypatch.setattr(anchors, "REMEMBERED", remembered)
        got = sorted((tuple(x) if x.doc_id is not None else (2**63 - 1, *tuple(x)[1:]) for x in operator(df).collect()), key=str)
        assert got == want


def test_texts_that_share_a_key(spark, monkeypatch):
    """Where the first hash of different texts is the same, the second tells them apart."""
    from pyspark.sql import functions as F

    real = anchors.texts_of
    monkeypatch.setattr(anchors, "texts_of", lambda *a: real(*a).withColumn("key", F.length("text").cast("long") % 2))
    shared = "the same thirteen words stand here in three of the four texts of this test"
    made = [(1, shared + " a"), (2, "one " + shared), (3, shared + " a"), (4, "b " * 40), (5, "b " * 41)]
    got = sorted((tuple(r) for r in automaton.substring_dedup(spark.createDataFrame(made, "doc_id long, text string")).collect()), key=str)
    assert [x for x in got if x[0] == 3] == [x for x in brute.op1(made) if x[0] == 3]


def test_shortened_runs():
    r = random.Random(5)
    for _ in range(300):
        piece = b"".join(bytes([r.choice(b"ab")]) * r.choice([1, 1, 2, 3, 9, 30]) for _ in range(r.randint(2, 9)))
        window = r.randint(1, min(7, len(piece)))
        short, at = suffix_dedup.shortened(piece, window)
        assert [short[a : a + window] for a in at.tolist()] == [piece[i : i + window] for i in range(len(piece) - window + 1)]
        assert {short[i : i + window] for i in range(len(short) - window + 1)} == {piece[i : i + window] for i in range(len(piece) - window + 1)}


def test_met():
    met = anchors.Met()
    assert met.settled(np.array([5, 6, 5], np.uint64), np.array([3, 1, 9])).tolist() == [False, False, True]
    assert met.settled(np.array([5, 6, 5], np.uint64), np.array([2, 7, 3])).tolist() == [False, False, True]
    assert met.settled(np.array([5], np.uint64), np.array([2])).tolist() == [False]


def test_automaton_matching_statistics():
    r = random.Random(5)
    for _ in range(150):
        held = [r.choices("abc", k=r.randint(0, 14)) for _ in range(3)]
        a = SuffixAutomaton()
        for x in held:
            a.add(x)
        t = r.choices("abcd", k=20)
        strings = ["".join(x) for x in held]
        want = [max(n for n in range(i + 2) if n == 0 or any("".join(t[i + 1 - n : i + 1]) in s for s in strings)) for i in range(len(t))]
        assert a.matches(t) == want


@pytest.mark.parametrize("memory", [200, 1 << 20])
def test_suffix_array(memory):
    r = np.random.default_rng(1)
    for i in range(150):
        t = r.integers(1, r.integers(2, 6), r.integers(1, 90))
        t = np.append(np.tile(t[: max(1, len(t) // 4)], 4) if i % 3 == 0 else t, 0).astype(np.uint16)
        order, common = suffix_array(t, memory)
        whole = t.tolist()
        want = sorted(range(len(t)), key=lambda j: whole[j:])
        assert order.tolist() == want
        lcp = [0] + [next(k for k in range(len(t)) if whole[a + k] != whole[b + k]) for a, b in zip(want[:-1], want[1:], strict=True)]
        assert common.tolist() == lcp
