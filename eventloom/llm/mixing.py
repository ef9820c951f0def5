"""Mixing to target weights by soft membership, in DataFrame functions only."""

from __future__ import annotations

import json
import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import carry, join_small, materialize

SPACES = r"[\x20\x09-\x0D]+"
BINS = 1 << 15
#: The classifier is fitted on at most so many labelled documents, the first by a hash of their id.
MOST_LABELLED = 20_000
MIN_Z = 4.0
HEADS = ("toxic", "quality")
DOMAINS = ("toxic", "low", "high")
TARGETS = {"toxic": 0.0, "low": 0.2, "high": 0.8}
#: The mixed corpus has this share of all tokens.
BUDGET = 0.5
#: Targets that soft posteriors cannot reach (no toxic token at all) are neared ever more slowly. After so many steps the rates are
#: returned as they are, with a warning that states how far their totals are from the targets.
STEPS = 30
TOLERANCE = 1e-9


def features(text: Column) -> tuple[Column, Column]:
    """(number of words, distinct hashed words) of a text in lower case; punctuation at a word's end is part of no word."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), "")
    bare = F.array_distinct(F.transform(F.array_distinct(words), lambda w: (F.pmod(F.xxhash64(F.btrim(w, F.lit(".,;:"))), F.lit(BINS)) + 1).cast("int")))
    return F.size(words).cast("long"), bare


def solve(m: list[list[float]], v: list[float]) -> list[float]:
    """m x = v by elimination, for a few unknowns."""
    n = len(v)
    a = [[*row, b] for row, b in zip(m, v)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        for r in range(n):
            if r != i and a[i][i]:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i])]
    return [a[i][n] / a[i][i] if a[i][i] else 0.0 for i in range(n)]


def array_literal(values: list[float]) -> Column:
    """A constant array; parsing folds into one literal of the plan."""
    return F.expr(f"from_json('{json.dumps(values)}', 'array<double>')")


def dot(weights: list[float], bins: Column) -> Column:
    w = array_literal(weights)
    return F.aggregate(bins, F.lit(0.0), lambda a, b: a + F.element_at(w, b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> dict[str, tuple[list[float], float, float]]:
    """For each head (bin weights, slope, offset): log-odds of the hashed words that tell its classes apart by MIN_Z standard errors,
    then a logistic fit of the summed weights by Newton steps. A head without both classes has no weights and says its base rate.
    """
    ids = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(h).cast("int").alias(h) for h in HEADS]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = materialize(ids.select(F.col("doc_id").alias("_lid"), *[F.coalesce(h, F.lit(0)).alias(f"_{h}") for h in HEADS]))
    narrow = docs.select(F.col("doc_id").alias("_lid"), "text").where("text IS NOT NULL")
    rows = materialize(join_small(narrow, ids, ["_lid"]).select(*[F.col(f"_{h}").alias(h) for h in HEADS], features(F.col("text"))[1].alias("bins")))
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(h).alias(h) for h in HEADS]).first()
    counts = rows.select(F.explode("bins").alias("bin"), *HEADS).groupBy("bin").agg(F.count("*").alias("n"), *[F.sum(h).alias(h) for h in HEADS]).collect()
    weights = {h: [0.0] * BINS for h in HEADS}
    for h in HEADS:
        yes, no = sums[h] or 0, sums.n - (sums[h] or 0)
        if not yes or not no:
            continue
        for r in counts:
            a, b = r[h] + 0.5, r.n - r[h] + 0.5
            w = math.log(a / (yes + 1)) - math.log(b / (no + 1))
            if abs(w) >= MIN_Z * math.sqrt(1 / a + 1 / b):
                weights[h][r.bin - 1] = round(w, 6)
    scored = materialize(rows.select(*HEADS, *[dot(weights[h], F.col("bins")).alias(f"s_{h}") for h in HEADS]))
    out = {}
    for h in HEADS:
        yes, n = sums[h] or 0, sums.n
        slope, offset = 0.0, math.log((yes + 0.5) / (n - yes + 0.5))
        if any(weights[h]):
            slope = 0.5
            for _ in range(12):
                s, p = F.col(f"s_{h}"), sigmoid(F.lit(slope) * F.col(f"s_{h}") + F.lit(offset))
                q = p * (1 - p) + 1e-9
                r = scored.agg(F.sum((p - F.col(h)) * s).alias("gs"), F.sum(p - F.col(h)).alias("g1"), F.sum(q * s * s).alias("ss"), F.sum(q * s).alias("s1"), F.sum(q).alias("q1")).first()
                # A little weight decay keeps separable classes finite.
                ds, do = solve([[r.ss + 1.0, r.s1], [r.s1, r.q1 + 1.0]], [r.gs + slope, r.g1 + offset])
                ds, do = max(-1.0, min(1.0, ds)), max(-3.0, min(3.0, do))
                slope, offset = slope - ds, offset - do
                if abs(ds) + abs(do) < 1e-6:
                    break
        out[h] = (weights[h], slope, offset)
    return out


def posteriors(docs: DataFrame, model: dict[str, tuple[list[float], float, float]]) -> DataFrame:
    """docs with n_tokens and p_toxic, p_low and p_high, which sum to 1."""
    n, bins = features(F.col("text"))
    df = docs.withColumns({"n_tokens": n, "_bins": bins})
    df = df.withColumns({f"_{h}": sigmoid(F.lit(model[h][1]) * dot(model[h][0], F.col("_bins")) + F.lit(model[h][2])) for h in HEADS}).drop("_bins")
    clean = 1 - F.col("_toxic")
    return df.withColumns({"p_toxic": F.col("_toxic"), "p_low": clean * (1 - F.col("_quality")), "p_high": clean * F.col("_quality")}).drop("_toxic", "_quality")


def rates(df: DataFrame, targets: dict[str, float], budget: float, steps: int = STEPS) -> tuple[list[list[float]], list[float], list[float]]:
    """(gradient steps, target totals, reached totals) of projected-gradient least squares over the documents of df.

    Minimises the squared distance of the expected domain totals sum_i rate_i tokens_i p_i to budget x all tokens x target over rates
    of 0 or more, from rates of `budget`. A document's gradient is tokens_i p_i . residual; the step of all documents is scaled by
    the inverse of sum_i tokens_i p_i p_i' over the documents with a rate above 0, so that a step without projection is exact. Only
    totals of the few domains reach the driver; a document's rate is a function of the steps so far.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    t = F.col("n_tokens").cast("double")
    moves: list[list[float]] = []
    goal: list[float] = []
    got: list[float] = []
    for _ in range(steps):
        now = df.withColumn("_r", rate_of(moves, budget))
        live = F.when(F.col("_r") > 0, 1.0).otherwise(0.0)
        r = now.agg(F.sum(t).alias("t"), *[F.sum(F.col("_r") * t * x).alias(f"a{i}") for i, x in enumerate(p)], *[F.sum(live * t * x * y).alias(f"h{i}_{j}") for i, x in enumerate(p) for j, y in enumerate(p) if j >= i]).first()
        total = r.t or 0.0
        goal = [budget * total * targets.get(d, 0.0) for d in DOMAINS]
        was, got = got, [r[f"a{i}"] or 0.0 for i in range(len(p))]
        miss = [a - g for a, g in zip(got, goal)]
        if not total or max(map(abs, miss)) <= TOLERANCE * total or was and max(abs(x - y) for x, y in zip(was, got)) <= TOLERANCE * total:
            break
        ridge = 1e-9 * total
        h = [[(r[f"h{min(i, j)}_{max(i, j)}"] or 0.0) + ridge * (i == j) for j in range(len(p))] for i in range(len(p))]
        moves.append(solve(h, miss))
    else:
        far = math.sqrt(sum((a - g) ** 2 for a, g in zip(got, goal))) / max(1.0, sum(goal))
        warnings.warn(f"rates have not settled after {steps} steps: their totals are {far:.2e} of all target tokens from the targets", stacklevel=2)
    return moves, goal, got


def rate_of(moves: list[list[float]], start: float) -> Column:
    """The rate after the steps: each subtracts posterior . step and projects to 0 or more."""
    if not moves:
        return F.lit(float(start))
    steps = F.expr(f"from_json('{json.dumps(moves)}', 'array<array<double>>')")
    p = [F.col(f"p_{d}") for d in DOMAINS]

    def move(rate: Column, s: Column) -> Column:
        change = sum((F.get(s, F.lit(i)) * x for i, x in enumerate(p)), F.lit(0.0))
        return F.greatest(F.lit(0.0), rate - change)

    return F.aggregate(steps, F.lit(float(start)), move)


@carry("doc_id", "text")
def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, p_toxic, p_low, p_high and rate: how often each document should be read, so that the expected token
    totals of the domains come to budget x all tokens x target, as near as rates of 0 or more allow.

    Targets must be 0 or more and sum to 1. A null or empty text has no tokens and the posterior of a text without known words. With
    no labels every document has even posteriors. Rows are documents of their own, repeated ones too; labels of one id count as their
    greatest; a null label counts as 0. Unless keep_text, the text is left out, and posteriors are computed once. Extra columns are carried; an empty table gives no rows.
    """
    if any(v < 0 for v in targets.values()) or abs(sum(targets.values()) - 1) > 1e-6 or set(targets) - set(DOMAINS):
        raise ValueError(f"targets must be shares of {DOMAINS} that sum to 1")
    model = fit(docs, labels)
    if not keep_text:
        scored = materialize(posteriors(docs, model).drop("text"))
        moves, _, _ = rates(scored.where("n_tokens > 0"), targets, budget)
        return scored.withColumn("rate", rate_of(moves, budget))
    slim = materialize(posteriors(docs.select("text"), model).drop("text").where("n_tokens > 0"))
    moves, _, _ = rates(slim, targets, budget)
    return posteriors(docs, model).withColumn("rate", rate_of(moves, budget))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = mix(docs.select("doc_id", "text"), labels, keep_text=False)
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("p_toxic", "p_low", "p_high", "rate")])
