"""Mixing to target weights by soft membership, in built-in functions only.

A naive Bayes classifier fitted on the labelled table gives each document posteriors over domains. Nonnegative rates
per document are then fitted by projected gradient least squares, so that the expected tokens of each domain meet
their targets. A rate is a fold over the residuals of the earlier steps, so the state of a step is one number per
domain, and a step is one aggregation over the written posteriors.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ASCII_SPACE, discard, text_or_empty, written

#: Target shares of the tokens, of the corpus's present total. Domains come from the labelled table, see `domain_of`.
#: Against the shares of the given tables they take a third of what is low and a half and more of what is toxic.
TARGETS = {"good": 0.93, "low": 0.06, "toxic": 0.01}
#: The classifier is fitted on at most so many labelled rows, those with the smallest hash of their doc_id.
MAX_TRAINING_ROWS = 8192
BUCKETS = 4096
#: The evidence of a text counts as much as that of so many words, which keeps memberships soft on long texts.
EVIDENCE = 64.0
RIDGE, MAX_STEPS, TOLERANCE = 1e-6, 60, 1e-5
#: After so many steps the rates are written, so that a step folds over no more earlier ones.
FOLD = 10


DOMAINS = ("good", "low", "toxic")


def domain_of() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("good")


def _word_buckets(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), f"{ASCII_SPACE}+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _vector(values) -> Column:
    """A literal array of doubles, parsed once when the plan is folded."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def fit_classifier(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Log priors and per-bucket log likelihoods of each domain, with add-one smoothing.

    Labels without both values are left out; of labels that repeat a doc_id the worst counts. What returns to the
    driver is at most BUCKETS counts a domain.
    """
    own = labels.where("toxic is not null and quality is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", domain_of().alias("domain"))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    counts = np.ones((len(DOMAINS), BUCKETS))
    seen = np.ones(len(DOMAINS))
    at = {d: k for k, d in enumerate(DOMAINS)}
    got = rows.select("domain", F.explode_outer(_word_buckets(F.col("text"))).alias("b")).groupBy("domain", "b").count().collect()
    for r in got:
        if r.b is not None:
            counts[at[r.domain], r.b] += r["count"]
    for r in rows.groupBy("domain").count().collect():
        seen[at[r.domain]] += r["count"]
    return np.log(seen / seen.sum()), np.log(counts / counts.sum(axis=1, keepdims=True))


def posteriors(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """`docs` without text, with `tokens` (words of the text) and `p` (posteriors in the order of the domains)."""
    prior, likelihood = model
    out = docs.withColumn("_b", _word_buckets(text_or_empty())).drop("text").withColumn("tokens", F.size("_b").cast("long"))
    weight = F.lit(EVIDENCE) / F.greatest(F.lit(EVIDENCE), F.col("tokens").cast("double"))

    def evidence(k: int) -> Column:
        table = _vector(likelihood[k] - likelihood[0])
        total = F.aggregate("_b", F.lit(0.0), lambda a, b: a + F.element_at(table, b + 1))
        return F.lit(float(prior[k] - prior[0])) + total * weight

    out = out.withColumn("_s", F.array(F.lit(0.0), *[evidence(k) for k in range(1, len(prior))])).drop("_b")
    out = out.withColumn("_e", F.transform("_s", lambda s: F.exp(s - F.array_max("_s"))))
    return out.withColumn("p", F.transform("_e", lambda e: e / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))).drop("_s", "_e")


def rate_of(steps: list[np.ndarray], start: Column | None = None) -> Column:
    """The rate after these steps: each takes the posteriors' product with its direction and projects onto the rates >= 0."""
    start = F.lit(1.0) if start is None else start
    if not steps:
        return start
    moves = F.from_json(F.lit(json.dumps([[float(v) for v in s] for s in steps])), "array<array<double>>")
    dot = lambda m: F.aggregate(F.zip_with("p", m, lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(moves, start, lambda r, m: F.greatest(F.lit(0.0), r - dot(m)))


@dataclass
class Fit:
    """The steps taken, the largest distance of an expected share from its target that is left, and whether they ended there."""

    steps: list[np.ndarray]
    residual: float
    converged: bool


def fit_rates(member: DataFrame, targets: np.ndarray, max_steps: int = MAX_STEPS) -> Fit:
    """Projected gradient on the least squares of (expected domain tokens - targets), in shares of all tokens.

    The squares are weighted by the inverse of the token-weighted second moments of the memberships whose rates are not
    at zero, and the documents' coordinates by their tokens. A step that does not lower the squares is halved. The fit
    has converged if all shares are within TOLERANCE of their targets, or if no step lowers the squares by a thousandth
    any more (targets that no rates reach). A step is one aggregation; the driver sees K + K^2 sums of it.
    """
    size = len(targets)
    total = member.agg(F.sum("tokens").alias("n")).first().n
    if not total:
        return Fit([], 0.0, True)
    state, rate = member.select("tokens", "p"), F.lit(1.0)

    def seen(moves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The residual, and the moments of the documents that are not at zero."""
        now = state.select("tokens", "p", rate_of(moves, rate).alias("r"))
        p, live = F.col("p"), F.when(F.col("r") > 0, F.col("tokens")).otherwise(0)
        sums = [F.sum(F.col("tokens") * F.col("r") * p[k]).alias(f"s{k}") for k in range(size)]
        got = now.agg(*sums, *[F.sum(live * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(size) for j in range(i, size)]).first()
        moments = np.array([[got[f"m{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)]) / total
        return np.array([got[f"s{k}"] for k in range(size)]) / total - targets, moments

    steps: list[np.ndarray] = []
    open_steps: list[np.ndarray] = []
    residual, moments = seen([])
    scale = 1.0
    for _ in range(max_steps):
        if np.abs(residual).max() <= TOLERANCE or scale < 1 / 64:
            return Fit(steps, float(np.abs(residual).max()), True)
        move = scale * np.linalg.solve(moments + RIDGE * np.eye(size), residual)
        after, active = seen([*open_steps, move])
        if after @ after > 0.999 * (residual @ residual):
            scale /= 2
            continue
        steps.append(move)
        open_steps.append(move)
        residual, moments, scale = after, active, min(1.0, 2 * scale)
        if len(open_steps) == FOLD:
            before, state = state, written(state.select("tokens", "p", rate_of(open_steps, rate).alias("r")), "rates")
            if len(steps) > FOLD:
                discard(before)
            rate, open_steps = F.col("r"), []
    return Fit(steps, float(np.abs(residual).max()), False)


def _draw() -> Column:
    """A number in [0, 1) from a hash of doc_id."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mixing")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _copies(steps: list[np.ndarray]) -> Column:
    return F.floor(rate_of(steps) + _draw())


def mixing(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `tokens`, a posterior `p_<domain>` for each domain, `rate`, `copies`, `residual`, `converged`.

    `targets` are shares of the present tokens for each of the domains good, low and toxic; one that is left out is 0.
    `tokens` counts words between ASCII white space, of the whole text however long; null and empty texts have none, get
    the prior as posteriors and the rate that this implies. `copies` is the rate rounded up or down by a hash of doc_id,
    so that its expectation is the rate. Targets that the memberships cannot reach are met as nearly as least squares
    allows: `residual` is the largest distance of a share from its target, and `converged` says whether the fit ended by
    itself. Without any token all rates are 1. Repeated rows are rated alike; an empty table gives an empty result.
    Other columns, whatever their names, are not read.
    """
    own = docs.select("doc_id", "text")
    member = written(posteriors(own, fit_classifier(own, labels)), "posteriors")
    fit = fit_rates(member, _targets(targets))
    each = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    report = [F.lit(fit.residual).alias("residual"), F.lit(fit.converged).alias("converged")]
    return member.select("doc_id", "tokens", *each, rate_of(fit.steps).alias("rate"), _copies(fit.steps).alias("copies"), *report)


def mixing_resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of `docs`, each as often as its copies say (also not at all), with all their columns, whatever their names.

    The rates are fitted on written posteriors; to apply them, the posteriors are computed again beside the texts,
    which is cheaper than to shuffle these. Cases are as in `mixing`.
    """
    model = fit_classifier(docs, labels)
    member = written(posteriors(docs.select("doc_id", "text"), model), "posteriors")
    fit = fit_rates(member, _targets(targets))
    row = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    times = posteriors(row, model).select("_row", F.explode(F.array_repeat(F.lit(0), _copies(fit.steps).cast("int"))))
    return times.select("_row.*")


def _targets(targets: dict[str, float]) -> np.ndarray:
    if unknown := set(targets) - set(DOMAINS):
        raise ValueError(f"no such domain: {sorted(unknown)}")
    return np.array([targets.get(d, 0.0) for d in DOMAINS])
