"""Mixing documents to target domain weights by soft membership; DataFrame functions only.

1. A naive Bayes classifier over hashed words, counted over all labelled documents, gives every text its domain
   posteriors. 2. Least squares fits a nonnegative rate a document, so that the expected tokens of each domain,
   sum(rate * tokens * posterior), meet the targets; it is solved by its dual, one multiplier a domain. 3. A rate becomes whole copies by a hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.own_columns import packed, unpacked
from tallyline.llm.prefilter import with_possible_partner
from tallyline.sources.scratch import written

BUCKETS = 1 << 14
SMOOTHING = 0.5
NEWTON_STEPS = 100
TOLERANCE = 1e-7
NEARNESS = 1e-5
LEAST_SCALE = 0.01
DIGITS = 6


def _buckets() -> Column:
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(
        F.filter(words, lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")
    )


def _bags(texts: DataFrame, *keep: str) -> DataFrame:
    """A row a word, with its bucket; one row with a null bucket for a text without words."""
    return texts.select(*keep, F.explode_outer(_buckets()).alias("bucket"))


def word_odds(docs: DataFrame, labels: DataFrame, domains: list[str]) -> DataFrame:
    """``bucket, l0, l1, ...``: log probability of each bucket in each domain; and bucket -1: log prior of the domain.

    ``labels`` has doc_id and domain. At most ``BUCKETS + 1`` rows.
    """
    labelled = labels.where(F.col("domain").isin(domains)).select("doc_id", "domain").dropDuplicates(["doc_id"])
    texts = with_possible_partner(docs.select("doc_id", "text"), labelled, "doc_id").join(
        labelled.hint("shuffle_hash"), "doc_id"
    )
    counted = _bags(texts, "domain").groupBy("bucket", "domain").agg(F.count(F.lit(1)).alias("n"))
    priors = labelled.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).select(F.lit(-1).alias("bucket"), "domain", "n")
    counts = counted.where("bucket IS NOT NULL").union(priors)
    table = counts.groupBy("bucket").agg(
        *(F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, d in enumerate(domains))
    )
    table = written(table, "mixing-counts")
    words = F.col("bucket") >= 0
    sums = table.agg(
        *(F.sum(F.when(words, F.col(f"n{k}"))).alias(f"w{k}") for k in range(len(domains))),
        *(F.sum(F.when(~words, F.col(f"n{k}"))).alias(f"d{k}") for k in range(len(domains))),
    ).first()
    documents = sum(sums[f"d{k}"] or 0 for k in range(len(domains)))

    def level(k: int) -> Column:
        n = F.col(f"n{k}") + SMOOTHING
        in_words = F.log(n / F.lit(float(sums[f"w{k}"] or 0) + SMOOTHING * BUCKETS))
        return F.when(words, in_words).otherwise(F.log(n / F.lit(documents + SMOOTHING * len(domains))))

    return table.select("bucket", *(level(k).alias(f"l{k}") for k in range(len(domains))))


def posteriors(docs: DataFrame, odds: DataFrame, domains: list[str]) -> DataFrame:
    """``text_key, m, n, p0, p1, ...`` per distinct text: its number of rows, its words, its domain posteriors.

    The words' evidence counts by the square root of their number, not as if they were independent.
    """
    k = range(len(domains))
    prior = odds.where("bucket = -1").first()
    priors = [prior[f"l{i}"] if prior else 0.0 for i in k]
    even = [F.coalesce(F.col(f"l{i}"), F.lit(0.0)) for i in k]
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text")
    rows = texts.groupBy("text_key").agg(F.count(F.lit(1)).alias("m"))
    summed = (
        _bags(texts, "text_key")
        .join(F.broadcast(odds.where("bucket >= 0")), "bucket", "left")
        .groupBy("text_key")
        .agg(F.count("bucket").alias("words"), *(F.sum(even[i]).alias(f"s{i}") for i in k))
    )
    joined = summed.join(rows, "text_key")
    level = [F.lit(priors[i]) + F.col(f"s{i}") / F.greatest(F.sqrt("words"), F.lit(1.0)) / F.sqrt("m") for i in k]
    with_levels = joined.select("text_key", "m", (F.col("words") / F.col("m")).alias("n"), *(level[i].alias(f"v{i}") for i in k))
    top = F.greatest(*(F.col(f"v{i}") for i in k)) if len(domains) > 1 else F.col("v0")
    total = sum((F.exp(F.col(f"v{i}") - top) for i in k), F.lit(0.0))
    return with_levels.select("text_key", "m", "n", *((F.exp(F.col(f"v{i}") - top) / total).alias(f"p{i}") for i in k))


def fitted_rates(texts: DataFrame, targets: list[float], least: float = 0.0, budget: float | None = None) -> DataFrame:
    """``texts`` with ``rate``: least squares on sum_k (expected_k - target_k)^2 / scale_k.

    ``targets`` are weights of the domains; all targets add up to ``budget`` tokens: by default as many as there are. With
    ``least`` above 0 the budget is at least so large that no domain has to fall below ``least`` times its tokens. A scale is
    the target, or a hundredth of the budget where that is more, so a weight may be 0. The squared distance of the rates from
    1, by tokens, is added with a weight of ``NEARNESS``: of all rates that meet the targets the nearest ones are taken.

    The rates are max(least, 1 + sum_k multiplier_k * p_k). Newton steps on the multipliers end when the gradient is below
    ``TOLERANCE`` of the tokens; a fit that does not get there is an error. Each step is one aggregation; only sums by domain
    and pair of domains reach the driver.
    """
    k = range(len(targets))
    mass = F.col("m") * F.col("n")
    have = texts.agg(*(F.sum(mass * F.col(f"p{i}")).alias(f"t{i}") for i in k)).first()
    have = [float(have[f"t{i}"] or 0.0) for i in k]
    total = sum(have)
    if not total:
        return texts.withColumn("rate", F.lit(max(1.0, float(least))))
    weights = [w / sum(targets) for w in targets]
    size = total if budget is None else budget
    if least > 0:
        size = max([size, *(least * have[i] / weights[i] for i in k if weights[i] > 0)])
    goals = np.array([w * size for w in weights]) / total
    ties = NEARNESS * np.maximum(goals, LEAST_SCALE * size / total)

    def reached(multipliers: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual's value, gradient and curvature, all as a part of the tokens."""
        free = _free_rate(multipliers)
        rate = F.greatest(F.lit(float(least)), free)
        value = rate * rate / 2 + float(least) * F.least(F.lit(0.0), free - float(least))
        open_ = F.when(free > float(least), mass).otherwise(0.0)
        sums = texts.agg(
            F.sum(mass * value).alias("value"),
            *(F.sum(mass * F.col(f"p{i}") * rate).alias(f"t{i}") for i in k),
            *(F.sum(open_ * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"c{i}_{j}") for i in k for j in range(i + 1)),
        ).first()
        gradient = np.array([sums[f"t{i}"] for i in k]) / total - goals + ties * multipliers
        curvature = np.array([[sums[f"c{max(i, j)}_{min(i, j)}"] for j in k] for i in k]) / total + np.diag(ties)
        return sums["value"] / total - goals @ multipliers + ties @ multipliers**2 / 2, gradient, curvature

    multipliers = np.zeros(len(targets))
    value, gradient, curvature = reached(multipliers)
    for _ in range(NEWTON_STEPS):
        if np.abs(gradient).max() <= TOLERANCE:
            break
        direction = -np.linalg.solve(curvature, gradient)
        part, slope = 1.0, gradient @ direction
        while True:
            found = reached(multipliers + part * direction)
            # Near the end the value's own rounding hides what a step gains.
            if found[0] <= value + 1e-4 * part * slope + 1e-12 * (1 + abs(value)) or part < 1e-6:
                break
            part /= 2
        multipliers = multipliers + part * direction
        value, gradient, curvature = found
    if np.abs(gradient).max() > TOLERANCE:
        raise RuntimeError(f"the rates of {len(targets)} domains did not converge: gradient {gradient}")
    rate = F.greatest(F.lit(float(least)), _free_rate(multipliers))
    return texts.withColumn("rate", F.round(rate, DIGITS))


def _free_rate(multipliers: np.ndarray) -> Column:
    return sum((F.lit(float(x)) * F.col(f"p{i}") for i, x in enumerate(multipliers)), F.lit(1.0))


def mixing_rates(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float], least: float = 0.0
) -> DataFrame:
    """``text_key, n, rate, p0, ...`` per distinct text (see :func:`mixed_documents`)."""
    domains = list(targets)
    texts = written(posteriors(docs, word_odds(docs, labels, domains), domains), "mixing-posteriors")
    return written(fitted_rates(texts, list(targets.values()), least), "mixing-fitted")


def with_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], least: float = 0.0) -> DataFrame:
    """``docs`` with ``n_tokens``, ``rate`` and ``copies``, the whole number that the rate gives this document.

    ``labels`` has doc_id and domain; other domains than those of ``targets`` and null ones are left out. Without labels the
    posteriors are even. A null or empty text has 0 tokens and the rate that its prior posterior gives. Rows that repeat get
    one rate, and copies by their doc_id; a null doc_id counts as one id. Empty tables give an empty result. Columns of
    these three names are replaced.
    """
    rates = mixing_rates(docs, labels, targets, least).select(
        "text_key", F.col("n").cast("long").alias("n_tokens"), "rate"
    )
    chance = F.pmod(F.xxhash64("doc_id", "text_key", F.lit("copies")), F.lit(1_000_000)) / 1_000_000
    whole = F.floor("rate")
    copies = (whole + (F.col("rate") - whole > chance).cast("int")).cast("int")
    rest = docs.drop("n_tokens", "rate", "copies")
    rated = packed(rest).withColumn("text_key", F.xxhash64("text")).join(rates, "text_key")
    return rated.select(*unpacked(rest.columns), "n_tokens", "rate", copies.alias("copies"))


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float], least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` as often as their copies, with their own columns."""
    rated = with_rates(packed(docs), labels, targets, least).where("copies > 0")
    repeated = rated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*unpacked(docs.columns))


def quality_domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain``: toxic, else low (quality 0) or good; rows with a null flag have no domain."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.where("toxic IS NOT NULL AND quality IS NOT NULL").select("doc_id", domain.alias("domain"))
