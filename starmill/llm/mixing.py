"""Mixing by soft membership: posteriors over domains, and a rate for every document.

1. A classifier learnt from the labelled table predicts each document's posterior over the domains
   ``good``, ``poor`` and ``toxic`` (naive Bayes over the presence of telling words and over
   ranges of simple text statistics).
2. Least squares fits a rate for every document, none negative, so that the expected tokens of
   each domain (rate x tokens x posterior, summed over all documents) meet the target weights.
   Rates stay as near to 1 as that allows: the sum of tokens x (rate - 1)^2 is the least possible.

The second step is projected descent with a lazy projection: after any number of steps the rate is
``max(0, 1 + posterior . step)``, so the only state is one number per domain. The gradient is not
taken as it is but scaled by the curvature of the active documents (a projected Newton step with
a line search): plain gradient steps need thousands of aggregates where these need a few. A step is one
aggregate over the stored documents (domain totals at the present rates, and the curvature);
the driver holds only those few sums. The first steps are taken on the documents summed in cells of
``1 / GRID``, the last ones on the documents themselves with their unrounded posteriors: the domain
totals are off by at most ``TOLERANCE`` of all tokens, if the documents allow the targets.

``mixing_rates`` fits the targets as they are given. ``mix`` first sets targets that its documents
can meet: a domain's share may be at most ``REPEAT`` times its present share, and what lies
beyond goes to the other domains in proportion to their targets. It returns the unmet share.

Everything runs in DataFrame operations: no Python on the executors. The classifier is fitted on
at most ``TRAIN_ROWS`` labelled rows, drawn by hash, and keeps ``FEATURES`` features per
domain; posteriors, tokens and rates cover every document.

Defined results: a null text is an empty text (no tokens, rate by its posterior); null keys are
carried and never learnt from; repeated rows each get their rate; labels with a null are not learnt
from, repeated labels count each time; extra columns are ignored by ``mixing_rates`` and kept by
``mix``; no row is left out, a rate may be 0; an empty table gives an empty result; without labels
every posterior is the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.llm.words import free_name
from starmill.sources.workdir import materialize

DOMAINS = ("good", "poor", "toxic")
#: Share of the expected tokens that each domain shall have.
TARGETS = {"good": 0.93, "poor": 0.06, "toxic": 0.01}
TRAIN_ROWS = 10_000
FEATURES = 64
REPEAT = 4.0  # a domain is drawn at most this many times as much as the documents hold
GRID = 256  # the fit starts on posteriors summed in this many steps
STEPS = 40
TOLERANCE = 1e-9


def words_of(text: Column) -> Column:
    """Lower-case words; where the text begins or ends with white space, an empty one there."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+")


def ranges(name: str, value: Column, limits: list[float]) -> Column:
    """A pseudo-word that says in which range the value lies (blanks keep it from being a word)."""
    step = F.lit(0)
    for limit in limits:
        step = step + F.when(value >= limit, 1).otherwise(0)
    return F.concat(F.lit(f" {name} "), step.cast("string"))


def with_features(docs: DataFrame, text: str, words: str, tokens: str, found: str) -> DataFrame:
    """``docs`` with the different words, the number of words and the statistics' ranges."""
    raw = F.coalesce(F.col(text), F.lit(""))
    size = F.col(tokens).cast("double") + 1e-9
    letters = F.length(raw).cast("double") + 1e-9
    marks = F.regexp_count(raw, F.lit("[#*$%&|<>]"))
    capitals = F.regexp_count(raw, F.lit("[A-Z]"))
    statistics = [
        ranges("words", F.col(tokens), [5, 20, 50, 100, 200, 400, 800, 1600]),
        ranges("marks", marks / size, [0.01, 0.05, 0.2, 0.5, 1.0, 2.0]),
        ranges("capitals", capitals / letters, [0.01, 0.02, 0.05, 0.1, 0.3]),
        ranges("length", letters / size, [4.0, 5.0, 6.0, 6.5, 7.0, 8.0, 9.0]),
        ranges("kinds", F.size(words) / size, [0.02, 0.1, 0.2, 0.35, 0.5, 0.6, 0.7, 0.8, 0.9]),
    ]
    out = docs.withColumn(words, words_of(F.col(text)))
    all_words = F.size(words)
    count = all_words - F.when(F.col(words)[0] == "", 1).otherwise(0)
    count -= F.when((all_words > 1) & (F.get(words, all_words - 1) == ""), 1).otherwise(0)
    out = out.withColumn(tokens, count.cast("long"))
    out = out.withColumn(words, F.array_distinct(words))
    return out.withColumn(found, F.array(*statistics))


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor")


class Classifier:
    """Naive Bayes weights: ``bias`` per domain, and a weight per feature and domain for its
    presence. ``FEATURES`` features per domain bound its size."""

    def __init__(self, bias: list[float], weights: dict[str, list[float]]):
        self.bias, self.weights = bias, weights

    def with_posterior(self, docs: DataFrame, features: Column, out: str) -> DataFrame:
        """``docs`` with the posterior per domain, an array that sums to 1. Each step is a column
        of its own, so that it is computed once."""
        names = F.array(*[F.lit(w) for w in self.weights]).cast("array<string>")
        docs = docs.withColumn(out, F.array_intersect(features, names))
        sums = []
        for k, bias in enumerate(self.bias):
            if not self.weights:
                sums.append(F.lit(bias))
                continue
            pairs = [x for w, v in self.weights.items() for x in (F.lit(w), F.lit(v[k]))]
            sums.append(F.aggregate(out, F.lit(bias), _adding(F.create_map(*pairs))))
        docs = docs.withColumn(out, F.array(*sums))
        docs = docs.withColumn(
            out, F.array(*[F.exp(F.col(out)[k] - F.array_max(out)) for k in range(len(sums))])
        )
        total = sum((F.col(out)[k] for k in range(1, len(sums))), F.col(out)[0])
        parts = [F.col(out)[k] / total for k in range(len(sums))]
        return docs.withColumn(out, F.array(*parts))


def _adding(weights: Column) -> Callable[[Column, Column], Column]:
    return lambda total, word: total + F.element_at(weights, word)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    key: str,
    text: str,
    train_rows: int = TRAIN_ROWS,
    features: int = FEATURES,
) -> Classifier:
    """Fit the classifier on at most ``train_rows`` labelled documents, the least by hash."""
    known = labels.select(F.col("doc_id").alias("key"), domain_of(F.col("quality"), F.col("toxic"))
                          .alias("domain")).where("key IS NOT NULL AND domain IS NOT NULL")
    drawn = known.orderBy(F.xxhash64("key"), "key", "domain").limit(train_rows)
    drawn = materialize(drawn, "drawn")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(drawn), "key")  # at most train_rows short rows
    rows = with_features(rows, "text", "words", "tokens", "found")
    rows = materialize(rows.select("domain", F.concat("words", "found").alias("words")), "train")
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    prior = [math.log((sizes.get(d, 0) + 1) / (total + len(DOMAINS))) for d in DOMAINS]
    if not total:
        return Classifier([0.0] * len(DOMAINS), {})
    seen = rows.select("domain", F.explode("words").alias("word")).groupBy("word").agg(
        *[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS]
    )
    # log odds of each word's presence in a domain against the rest, weighed by its evidence
    scored = []
    for d in DOMAINS:
        inside, rest = sizes.get(d, 0) + 2, total - sizes.get(d, 0) + 2
        others = sum((F.col(o) for o in DOMAINS if o != d), F.lit(0))
        p, q = (F.col(d) + 1) / inside, (others + 1) / rest
        gain = p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))
        scored.append(F.struct(F.lit(d).alias("for"), gain.alias("gain")))
    told = materialize(seen.select("*", F.array(*scored).alias("scores")), "words")
    weights: dict[str, list[float]] = {}
    bias = list(prior)
    for k in range(len(DOMAINS)):
        best = told.orderBy(F.col("scores")[k]["gain"].desc(), "word").limit(features)
        for row in best.collect():
            if row["word"] in weights:
                continue
            share = [(row[d] + 0.5) / (sizes.get(d, 0) + 1) for d in DOMAINS]
            weights[row["word"]] = [math.log(s / (1 - s)) for s in share]
            bias = [b + math.log(1 - s) for b, s in zip(bias, share)]
    return Classifier(bias, weights)


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small symmetric system by elimination."""
    rows = [[*m, r] for m, r in zip(matrix, right)]
    size = len(rows)
    for i in range(size):
        pivot = max(range(i, size), key=lambda k: abs(rows[k][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for k in range(size):
            if k != i:
                share = rows[k][i] / rows[i][i]
                rows[k] = [x - share * y for x, y in zip(rows[k], rows[i])]
    return [row[-1] / row[i] for i, row in enumerate(rows)]


def rate(posterior: Column, step: list[float]) -> Column:
    moved = sum((posterior[k] * F.lit(s) for k, s in enumerate(step)), F.lit(1.0))
    return F.greatest(F.lit(0.0), moved)


def fit_step(stored: DataFrame, targets: Mapping[str, float]) -> list[float]:
    """The numbers ``step`` for which the rates meet the targets, for a stored frame of
    ``tokens`` and ``posterior``.

    The wanted total of each domain is its target share of the present tokens of all documents.
    The fit starts on cells of near posteriors, each with its mean; their number is bounded by
    ``GRID``. From there it goes on over the documents, which takes few steps.
    """
    size = len(DOMAINS)
    rows = stored.where(F.col("tokens") > 0)
    p = [F.col("posterior")[k] for k in range(size)]
    cells = rows.groupBy(*[F.round(x * GRID).alias(f"cell{k}") for k, x in enumerate(p)]).agg(
        F.sum("tokens").cast("double").alias("tokens"),
        *[F.sum(F.col("tokens") * x).alias(f"sum{k}") for k, x in enumerate(p)],
    )
    means = F.array(*[F.col(f"sum{k}") / F.col("tokens") for k in range(size)])
    cells = materialize(cells.select("tokens", means.alias("posterior")), "cells")
    whole = cells.agg(F.sum("tokens")).first()[0] or 0.0
    if not whole:
        return [0.0] * size
    wanted = [whole * targets[d] / sum(targets.values()) for d in DOMAINS]
    start = descend(cells, wanted, whole, [0.0] * size)
    return descend(rows, wanted, whole, start)


def attainable(
    targets: Mapping[str, float], present: Mapping[str, float], repeat: float = REPEAT
) -> dict[str, float]:
    """``targets`` as shares, none beyond ``repeat`` times the domain's present share; the excess is
    spread over the others in proportion to their targets. Where all reach that limit the targets
    stay as they are."""
    whole = sum(targets.values())
    shares = {d: targets[d] / whole for d in DOMAINS}
    limits = {d: repeat * present[d] for d in DOMAINS}
    full: set[str] = set()
    goal = shares
    while beyond := {d for d in DOMAINS if d not in full and goal[d] > limits[d]}:
        full |= beyond
        rest = sum(shares[d] for d in DOMAINS if d not in full)
        if rest <= 0:
            return shares
        left = 1 - sum(limits[d] for d in full)
        goal = {d: limits[d] if d in full else shares[d] * left / rest for d in DOMAINS}
    return goal


def domain_shares(rows: DataFrame, step: list[float] | None = None) -> dict[str, float]:
    """Expected share of each domain at the rates of ``step`` (before any: rate 1) among the tokens
    that ``rows`` (``tokens`` and ``posterior``) hold; zeros without tokens."""
    own = rate(F.col("posterior"), step or [0.0] * len(DOMAINS))
    sums = [F.sum(F.col("tokens") * own * F.col("posterior")[k]) for k in range(len(DOMAINS))]
    row = rows.agg(F.sum("tokens"), *sums).first()
    return {d: (row[k + 1] or 0.0) / (row[0] or 1) for k, d in enumerate(DOMAINS)}


def descend(
    rows: DataFrame, wanted: list[float], whole: float, step: list[float]
) -> list[float]:
    """From ``step`` on to where the domain totals over ``rows`` (``tokens`` and ``posterior``)
    are ``wanted``, or as near as the rows allow; ``whole`` is the sum of tokens."""
    size = len(DOMAINS)

    def sums(at: list[float]) -> tuple[list[float], list[list[float]]]:
        """Residual and curvature with the rates at ``at``: one aggregate."""
        own = rate(F.col("posterior"), at)
        p = [F.col("posterior")[k] for k in range(size)]
        mass = F.col("tokens") * own
        active = F.col("tokens") * F.when(own > 0, 1.0).otherwise(0.0)
        row = rows.agg(
            *[F.sum(mass * p[k]).alias(f"t{k}") for k in range(size)],
            *[F.sum(active * p[i] * p[j]).alias(f"c{i}_{j}") for i in range(size) for j in range(size)],
        ).first()
        residual = [row[f"t{k}"] - wanted[k] for k in range(size)]
        return residual, [[row[f"c{i}_{j}"] for j in range(size)] for i in range(size)]

    residual, curve = sums(step)
    for _ in range(STEPS):
        error = sum(r * r for r in residual)
        if math.sqrt(error) <= TOLERANCE * whole:
            break
        damped = [
            [c + (whole * 1e-12 if i == j else 0.0) for j, c in enumerate(line)]
            for i, line in enumerate(curve)
        ]
        change, length = solve(damped, residual), 1.0
        while True:
            there = [s - length * c for s, c in zip(step, change)]
            found = sums(there)
            if sum(r * r for r in found[0]) < error or length < 1e-3:
                break
            length /= 2
        if sum(r * r for r in found[0]) >= error:
            break  # the targets are as near as these documents allow
        step, (residual, curve) = there, found
    return step


def with_posterior(
    docs: DataFrame, labels: DataFrame, key: str, text: str, tokens: str, posterior: str
) -> DataFrame:
    classifier = learn(docs, labels, key, text)
    words, found = free_name(docs, "_words"), free_name(docs, "_found")
    out = with_features(docs, text, words, tokens, found)
    features = F.concat(F.col(words), F.col(found))
    return classifier.with_posterior(out, features, posterior).drop(words, found)


def mixing_rates(
    docs: DataFrame,
    labels: DataFrame,
    targets: Mapping[str, float] = TARGETS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``key``, ``n_tokens``, one posterior per domain (``p_good``, ...) and ``rate``, one row
    per document."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = with_posterior(narrow, labels, "key", "text", "tokens", "posterior")
    stored = materialize(out.select("key", "tokens", "posterior"), "posteriors")
    step = fit_step(stored, targets)
    return stored.select(
        F.col("key").alias(key),
        F.col("tokens").alias("n_tokens"),
        *[F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)],
        rate(F.col("posterior"), step).alias("rate"),
    )


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: Mapping[str, float] = TARGETS,
    key: str = "doc_id",
    text: str = "text",
    name: str = "rate",
    unmet: str = "unmet",
) -> DataFrame:
    """``docs`` with each document's rate as the column ``name`` (how many times a draw of the
    mixture takes it, on average; 0: never) and, the same in all rows, the share of the targets'
    tokens that these documents do not supply as the column ``unmet``."""
    tokens, posterior = free_name(docs, "_tokens"), free_name(docs, "_posterior")
    name, unmet = free_name(docs, name), free_name(docs, unmet)
    stored = materialize(with_posterior(docs, labels, key, text, tokens, posterior), "mixture")
    rows = stored.select(F.col(tokens).alias("tokens"), F.col(posterior).alias("posterior"))
    step = fit_step(rows, attainable(targets, domain_shares(rows)))
    got, whole = domain_shares(rows, step), sum(targets.values())
    missing = sum(max(0.0, targets[d] / whole - got[d]) for d in DOMAINS)
    rated = stored.withColumn(name, rate(F.col(posterior), step))
    return rated.withColumn(unmet, F.lit(missing)).select(*docs.columns, name, unmet)
