"""A quality classifier learnt from positive and unlabelled texts with the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import as_long, slices, small_batches, text_buffer
from inkveil.llm.words import find_words, hash_grams, hash_words
from inkveil.plans.storage import spread_out

#: Hashed byte trigrams.
TRIGRAMS = 2048
#: Thresholds at which each share (0 to 1) among the other features switches a feature on.
STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
SHARES = 9
WIDTH = TRIGRAMS + SHARES * (1 + len(STEPS))
#: Rows the classifier is fitted on at most: trusted positives, and unlabelled rows.
POSITIVES, UNLABELLED = 3000, 5000


def _per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, weights=values, minlength=n)


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of WIDTH numbers for each text: trigram frequencies, and shares that tell prose from clutter and repetition."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    some = np.maximum(size, 1)
    if len(data) >= 3:
        b = data.astype(np.uint32)
        h = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 11)
        own = text[:-2] == text[2:]
        out[:, :TRIGRAMS] = np.bincount(text[:-2][own] * TRIGRAMS + h[own], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS) / np.maximum(size - 2, 1)[:, None]
    start, end, of = find_words(offsets, data)
    words = np.maximum(np.bincount(of, minlength=n), 1)
    hashes = hash_words(data, start, end)
    shares = np.zeros((n, SHARES))
    if len(start):
        same = np.zeros(len(start), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        shares[:, 0] = _per_text(same, of, n) / words
        for k, gram in ((1, 1), (2, 3), (3, 6)):  # repeated runs of so many words
            g = hash_grams(hashes, gram)
            own = of[: len(g)] == of[gram - 1 :]
            g, o = g[own], of[: len(g)][own]
            order = np.lexsort((g, o))
            again = np.zeros(len(g), bool)
            again[1:] = (g[order][1:] == g[order][:-1]) & (o[order][1:] == o[order][:-1])
            shares[:, k] = _per_text(again, o[order], n) / np.maximum(np.bincount(o, minlength=n), 1)
        shares[:, 4] = np.minimum(1, _per_text(end - start, of, n) / words / 20)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    shares[:, 5] = _per_text(upper, text, n) / some
    shares[:, 6] = _per_text(digit, text, n) / some
    shares[:, 7] = _per_text(~letter & ~digit & (data > 32), text, n) / some
    shares[:, 8] = 1 / (1 + np.log1p(words - 1))
    out[:, TRIGRAMS : TRIGRAMS + SHARES] = shares
    out[:, TRIGRAMS + SHARES :] = (shares[:, :, None] >= STEPS).reshape(n, -1)
    return out


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 150, rate: float = 0.01, decay: float = 1e-3) -> dict:
    """Weights that minimise the non-negative PU risk with logistic loss, by full-batch Adam steps.

    Risk: prior E_p[l(z)] + max(0, E_u[l(-z)] - prior E_p[l(-z)]). Where the second term goes below zero, the step
    climbs it instead, which keeps the classifier from treating unlabelled positives as negatives. Both float32 arrays are
    overwritten.
    """
    mean, scale = unlabelled.mean(0), np.sqrt(unlabelled.var(0) + 1e-7)
    p, u = positive, unlabelled
    for x in (p, u):  # in place: the driver holds each sample once
        x -= mean
        x /= scale
        np.clip(x, -5, 5, out=x)
    w, b, m, v = np.zeros(p.shape[1], np.float32), 0.0, np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    for t in range(1, rounds + 1):
        zp, zu = p @ w + b, u @ w + b
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gain, up, un = -prior * sigmoid(-zp) / len(zp), prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
        gp, gu = (gain - up, un) if rest >= 0 else (up, -un)
        grad = np.concatenate((p.T @ gp.astype(np.float32) + u.T @ gu.astype(np.float32) + decay * w, [gp.sum() + gu.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - step[-1]
    return {"mean": mean.astype(np.float32), "scale": scale.astype(np.float32), "w": w, "b": float(b)}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -5, 5) @ model["w"] + model["b"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id, written in decimal, has remainder 2 by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict | None:
    """A model from trusted positives (labels.quality = 1) and unlabelled documents, both outside the held-out quarter.

    The sample is at most `positives` and `unlabelled` rows, chosen by a hash of the id; features are computed on the
    executors, so what reaches the driver is bounded by these two parameters. The class prior is estimated as the share
    of ones among the labels outside the held-out quarter. None if there is no positive or no unlabelled text.
    """
    small_batches(docs.sparkSession)
    spread_id = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 40))
    known = labels.select(as_long("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out())
    counts = known.agg(F.sum((F.col("quality") == 1).cast("long")), F.count("*")).first()
    total = docs.count()
    if not counts[0] or not total:
        return None
    cut = [int(min(1.0, 0.9 * n / of) * (1 << 40)) for n, of in ((positives, counts[0]), (unlabelled, total))]
    trusted = known.where((F.col("quality") == 1) & (spread_id < cut[0])).select("doc_id").distinct().limit(positives).withColumn("trusted", F.lit(True))
    texts = docs.select(as_long("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out())
    open_id = F.coalesce(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 40)) < cut[1], F.lit(False))
    picked = texts.join(F.broadcast(trusted), "doc_id", "left").withColumn("open", open_id).where("trusted or open")  # trusted: at most `positives` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = features(*text_buffer(b.column("text")))
            yield pa.record_batch([b.column("doc_id"), pc.fill_null(b.column("trusted"), False), b.column("open"), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["doc_id", "trusted", "open", "x"])

    rows = picked.select("doc_id", "trusted", "open", "text").mapInArrow(run, "doc_id long, trusted boolean, open boolean, x binary").limit(2 * (positives + unlabelled)).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["x"]))  # the same sums whichever task came first
    x = {}
    for k in ("trusted", "open"):
        mine = [r["x"] for r in rows if r[k]]
        x[k] = np.empty((len(mine), WIDTH), np.float32)
        for i, raw in enumerate(mine):
            x[k][i] = np.frombuffer(raw, np.float16)
    del rows
    if not len(x["trusted"]) or not len(x["open"]):
        return None
    return fit(x["trusted"], x["open"], float(np.clip(counts[0] / counts[1], 0.05, 0.95)))


def score(docs: DataFrame, model: dict | None, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its text alone; without a model every score is 0.5.

    Null texts count as empty and get a score too. A null id is scored, and held_out is false for it. Repeated rows are
    scored each, and other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some 25 kB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = predict(sent.value, features(*text_buffer(b.column("text")))) if sent.value else np.full(b.num_rows, 0.5)
            yield pa.record_batch([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    scored = spread_out(docs.select(as_long("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict | None, threshold: float = 0.7) -> DataFrame:
    """The rows of docs (with a text column) whose text scores at least the threshold, all columns as they were.

    One pass, without a shuffle. Without a model every row stays.
    """
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield b.filter(pa.array(predict(sent.value, features(*text_buffer(b.column("text")))) >= threshold))

    small_batches(docs.sparkSession)
    return spread_out(docs).mapInArrow(run, docs.schema)
