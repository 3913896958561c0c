"""Mixing by soft membership: document rates whose expected token totals by domain match target weights.

In SQL expressions alone. A naive Bayes classifier over hashed words learns domains from a labelled table and gives each
document a posterior p over them. Rates r minimise sum_k (S_k - T_k)^2 / N_k, where S_k = sum_d n_d r_d p_dk is domain k's
expected tokens, N_k its tokens at rate one and T_k its target, over least <= r (<= most, if given), by projected gradient steps.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import materialize
from inkveil.plans.storage import spread_out

BUCKETS = 4096
#: Labelled rows that the classifier is fitted on at most.
LABELLED = 20_000
#: A posterior counts the evidence of so many words at most, spread over the whole text, so that it stays soft.
EVIDENCE = 12.0

#: Where no document may be lost, the total exceeds the least one by this share, and by it again after every so many rounds
#: that miss: rising domains also raise the others a little, which a target at its lower bound leaves no room for.
HEADROOM, PATIENCE = 0.01, 8
#: Gradient steps within one expression; then the rates are written, and further steps start from them.
STEPS = 24

_WORDS = "[\\x20\\x09-\\x0D]+"


def exploded(rows: DataFrame) -> DataFrame:
    """rows (text and others) with a row for each word w in place of the text."""
    others = [c for c in rows.columns if c != "text"]
    return rows.select(*others, F.explode(F.split("text", _WORDS, -1)).alias("w")).where("w <> ''")


def train(labelled: DataFrame, limit: int = LABELLED) -> dict | None:
    """A model from labelled (text, domain) rows: log-probabilities of word buckets by domain, and log-priors.

    At most about `limit` rows, chosen by a hash of the text. The counts are aggregated by Spark; domains x BUCKETS
    numbers reach the driver, whatever the input. Rows without a domain are left out; None if no row is left.
    """
    known = labelled.where("domain is not null").select(F.col("domain").cast("string").alias("domain"), "text")
    sizes = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    total = sum(sizes.values())
    picked = known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(min(1.0, limit / total) * (1 << 40)))
    seen = exploded(picked).groupBy("domain", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")).count()
    counts = {k: [0.5] * BUCKETS for k in sorted(sizes)}
    for r in seen.collect():
        counts[r["domain"]][r["b"]] += r["count"]
    logs = {k: [math.log(x / sum(c)) for x in c] for k, c in counts.items()}
    return {"domains": list(logs), "logs": list(logs.values()), "priors": [math.log(sizes[k] / total) for k in logs]}


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__mix_id, __mix_h): what tells texts apart; rows that share both have one posterior."""
    return docs.select(F.col(id_col).cast("long").alias("__mix_id"), F.xxhash64(F.col(text_col).cast("string")).alias("__mix_h"))


def memberships(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__mix_id, __mix_h, __mix_n (words) and __mix_p (posterior by domain) of every text with words.

    One pass over the words, within generated code; sums by text are combined before the shuffle, which moves a row of
    domains + 3 numbers for each text. Rows that share id and text are summed and divided by their number: that of pieces
    at place 0, or at place 1 where the text begins with white space.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("__mix_id"), F.xxhash64(F.col(text_col).cast("string")).alias("__mix_h"), F.col(text_col).cast("string").alias("text"))
    at = F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int")
    logs = [F.sum(F.lit(x)[at]).alias(f"s{k}") for k, x in enumerate(model["logs"])]
    words = spread_out(rows).select("__mix_id", "__mix_h", F.posexplode(F.split("text", _WORDS, -1)).alias("at", "w")).where("w <> ''")
    sums = words.groupBy("__mix_id", "__mix_h").agg(F.count("*").alias("all"), F.count_if(F.col("at") == 0).alias("c0"), F.count_if(F.col("at") == 1).alias("c1"), *logs)
    sums = sums.withColumn("__mix_n", F.expr("all div if(c0 > 0, c0, c1)"))
    weight = F.least(F.col("__mix_n").cast("double"), F.lit(EVIDENCE)) / F.col("all")
    z = [F.col(f"s{k}") * weight + F.lit(x) for k, x in enumerate(model["priors"])]
    out = sums.withColumn("z", F.array(*z)).withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    out = out.withColumn("t", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    return out.select("__mix_id", "__mix_h", "__mix_n", F.transform("e", lambda x: x / F.col("t")).alias("__mix_p"))


def joined(docs: DataFrame, members: DataFrame, priors: list[float]) -> DataFrame:
    """docs (with __mix_id and __mix_h) with their memberships; texts without words have none and the priors."""
    m = members.withColumnsRenamed({"__mix_id": "__mix_j", "__mix_h": "__mix_g"})
    out = docs.join(m, F.col("__mix_id").eqNullSafe(F.col("__mix_j")) & (F.col("__mix_h") == F.col("__mix_g")), "left").drop("__mix_j", "__mix_g")
    return out.withColumn("__mix_n", F.coalesce("__mix_n", F.lit(0))).withColumn("__mix_p", F.coalesce("__mix_p", F.array(*[F.lit(math.exp(x)) for x in priors])))


def rate_column(steps: list[list[float]], least: float, most: float, start: Column, p_col: str = "__mix_p") -> Column:
    """A row's rate after the given gradient steps from `start`, each projected to [least, most]."""
    rate = start
    for step in steps:
        move = sum((F.col(p_col)[k] * F.lit(c) for k, c in enumerate(step)), F.lit(0.0))
        rate = F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), rate - move))
    return rate


def fit_rates(members: DataFrame, domains: int, targets: list[float] | float, least: float = 0.0, most: float = math.inf, keep_all: bool = False, rounds: int = 240, tolerance: float = 1e-4) -> tuple[DataFrame, dict]:
    """members (with __mix_n, __mix_p) with their rate __mix_r, and a report of N, T and S by domain.

    targets: weights by domain, or an exponent a for weights in proportion to N_k ** a. Totals sum to the tokens at rate
    one, or with keep_all to HEADROOM above the least total at which no target is below what its domain has, and to more
    where that cannot be met. With weights 1 / N_k the
    gradient's Lipschitz constant in the token-weighted metric is one (the domains' overlap matrix is row-stochastic), so
    the step size is one. Each round is one aggregation of `domains` sums; nothing else reaches the driver. Targets that are
    not reached within the tolerance (posteriors so soft that no rates reach them, `most`, or `rounds`) raise a warning.
    """
    def sums(rate: Column) -> list[float]:
        row = members.agg(*[F.sum(F.col("__mix_n") * rate * F.col("__mix_p")[k]).alias(f"s{k}") for k in range(domains)]).first()
        return [float(x or 0.0) for x in row]

    base = sums(F.lit(1.0))
    weight = [x**targets if x > 0 else 0.0 for x in base] if isinstance(targets, (int, float)) else [w if x > 0 else 0.0 for w, x in zip(targets, base, strict=True)]
    if not sum(weight):
        return members.withColumn("__mix_r", F.lit(1.0)), {"base": base, "target": base, "reached": base, "rounds": 0}
    total = (1 + HEADROOM) * max((x / w for x, w in zip(base, weight, strict=True) if w), default=0.0) if keep_all else sum(base) / sum(weight)
    target = [w * total for w in weight]
    start, steps, done = F.lit(min(max(1.0, least), most)), [], 0
    reached = sums(start)
    while done < rounds and max(abs(s - t) for s, t in zip(reached, target, strict=True)) > tolerance * sum(target):
        if keep_all and done and done % PATIENCE == 0:
            target = [(1 + HEADROOM) * t for t in target]
        if len(steps) == STEPS:
            members = materialize(members.withColumn("__mix_r", rate_column(steps, least, most, start)))
            start, steps = F.col("__mix_r"), []
        steps.append([(s - t) / n if n > 0 else 0.0 for s, t, n in zip(reached, target, base, strict=True)])
        before, reached, done = reached, sums(rate_column(steps, least, most, start)), done + 1
        if not keep_all and max(abs(a - b) for a, b in zip(before, reached, strict=True)) <= 1e-3 * tolerance * sum(target):
            break
    if max(abs(s - t) for s, t in zip(reached, target, strict=True)) > tolerance * sum(target):
        warnings.warn(f"mixing: targets missed after {done} rounds; tokens by domain wanted {target}, reached {reached}", RuntimeWarning, stacklevel=2)
    return members.withColumn("__mix_r", rate_column(steps, least, most, start)), {"base": base, "target": target, "reached": reached, "rounds": done}


def document_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | float, least: float = 0.0, most: float = math.inf) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posterior, rate of every row of docs (doc_id, text).

    labelled: (text, domain). targets: weights by domain (one that is missing has none), or an exponent. Null and empty
    texts have no tokens and the priors as posterior; null ids and repeated rows are rated like others. Without labelled
    rows every rate is one. A missed target is told by a warning. Posteriors are written to the shared folder once; the rounds then read only them.
    """
    model = train(labelled)
    rows = keyed(docs)
    if model is None:
        model = {"domains": [""], "logs": [[0.0] * BUCKETS], "priors": [0.0]}
        members = materialize(joined(rows, memberships(docs, model), model["priors"])).withColumn("__mix_r", F.lit(min(max(1.0, least), most)))
    else:
        members = materialize(joined(rows, memberships(docs, model), model["priors"]))
        members, _ = fit_rates(members, len(model["domains"]), wanted(targets, model["domains"]), least, most)
    likeliest = F.array(*[F.lit(k) for k in model["domains"]])[(F.array_position("__mix_p", F.array_max("__mix_p")) - 1).cast("int")]
    return members.select(F.col("__mix_id").alias("doc_id"), F.col("__mix_n").alias("n_tokens"), F.nullif(likeliest, F.lit("")).alias("domain"), F.col("__mix_p").alias("posterior"), F.col("__mix_r").alias("rate"))


def wanted(targets: dict[str, float] | float, domains: list[str]) -> list[float] | float:
    return [float(targets.get(k, 0.0)) for k in domains] if isinstance(targets, dict) else float(targets)


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | float, id_col: str = "doc_id", most: float = math.inf) -> DataFrame:
    """docs with each row as often as its rate says, once at least: thin domains are repeated, no document is lost.

    The fraction of a rate is rounded up or down by a hash of the id, so that expected totals hold and a rerun gives the
    same rows. Columns are those of docs. Without labelled rows docs comes back as it is.
    """
    model = train(labelled)
    if model is None:
        return docs
    members = materialize(joined(keyed(docs, id_col), memberships(docs, model, id_col), model["priors"]))
    members, _ = fit_rates(members, len(model["domains"]), wanted(targets, model["domains"]), 1.0, most, keep_all=True)
    dice = F.pmod(F.xxhash64(F.coalesce("__mix_id", F.lit(-1)), F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.greatest(F.lit(1), F.floor(F.col("__mix_r") + dice).cast("int"))
    often = members.dropDuplicates(["__mix_id", "__mix_h"]).select(F.col("__mix_id").alias("__mix_j"), F.col("__mix_h").alias("__mix_g"), times.alias("__mix_c"))
    rows = docs.withColumn("__mix_id", F.col(id_col).cast("long")).withColumn("__mix_h", F.xxhash64(F.col("text").cast("string")))
    matched = rows.join(often, F.col("__mix_id").eqNullSafe(F.col("__mix_j")) & (F.col("__mix_h") == F.col("__mix_g")))
    return matched.withColumn("__mix_i", F.explode(F.expr("sequence(1, __mix_c)"))).select(*docs.columns)
