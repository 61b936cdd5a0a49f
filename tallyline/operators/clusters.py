"""k-means that gives the same clusters on every run and in every engine.

Features are standardised and kept as whole millionths of a deviation, so sums of members do not depend on their
order. The first centres are the means of ``k`` equal parts of the rows by the sum of their features; then
rows go to the nearest centre (ties: the smaller number) and centres to the mean of their rows until nothing moves.
Each step is one aggregation over the written features; only its ``k`` rows of sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.operators.grouping import table_quantiles
from tallyline.sources.scratch import written

UNIT, STEPS = 1_000_000, 100

Centres = dict[int, list[int]]


def _places(features: Sequence[str]) -> list[str]:
    return [f"_z{i}" for i in range(len(features))]


def standardised(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """``table`` without rows that lack a feature, with each feature's millionths of a deviation; 0 where all rows agree."""
    ready = written(table.dropna("any", subset=list(features)), "clusters")
    moments = ready.agg(
        *(F.avg(f).alias(f"mean{i}") for i, f in enumerate(features)),
        *(F.stddev_pop(f).alias(f"std{i}") for i, f in enumerate(features)),
    ).first()
    columns = {}
    for i, (f, name) in enumerate(zip(features, _places(features))):
        z = (F.col(f) - F.lit(moments[f"mean{i}"])) / F.lit(moments[f"std{i}"]) if moments[f"std{i}"] else F.lit(0.0)
        columns[name] = F.floor(z * float(UNIT) + 0.5).cast("long")
    return ready.withColumns(columns)


def nearest(centres: Centres, places: Sequence[str]) -> Column:
    """Number of the nearest centre."""
    numbers = sorted(centres)
    away = []
    for number in numbers:
        parts = [F.col(p).cast("double") - float(c) for p, c in zip(places, centres[number])]
        away.append(sum((d * d for d in parts[1:]), parts[0] * parts[0]))
    closest = F.array_position(F.array(*away), F.array_min(F.array(*away)))
    return F.element_at(F.array(*(F.lit(n) for n in numbers)), closest.cast("int")).cast("int")


def _means(points: DataFrame, number: Column, places: Sequence[str]) -> Centres:
    """Centres of the groups that have rows."""
    means = points.groupBy(number.alias("cluster")).agg(
        *(F.floor(F.sum(p) / F.count(F.lit(1)) + 0.5).cast("long").alias(p) for p in places)
    )
    return {r["cluster"]: [r[p] for p in places] for r in means.collect()}


def fit_clusters(table: DataFrame, features: Sequence[str], k: int, steps: int = STEPS) -> tuple[Centres, DataFrame]:
    """Centres by number, and the rows with their standardised features.

    A group that loses all rows is gone, so there may be fewer than ``k``; an empty table has none.
    """
    places = _places(features)
    score = sum((F.col(p) for p in places[1:]), F.col(places[0]))
    points = written(standardised(table, features).withColumn("_score", score.cast("double")), "cluster-points")
    if points.isEmpty():
        return {}, points
    cuts = table_quantiles(points, ["_score"], [i / k for i in range(1, k)]).first()
    part = sum(((F.col("_score") > F.lit(c)).cast("int") for c in cuts["quantiles"]), F.lit(0))
    centres = _means(points, part, places)
    for _ in range(steps):
        moved = _means(points, nearest(centres, places), places)
        if moved == centres:
            break
        centres = moved
    return centres, points


def assign_clusters(table: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """``table`` without rows that lack a feature, with the number of each row's ``cluster``."""
    centres, points = fit_clusters(table, features, k)
    number = nearest(centres, _places(features)) if centres else F.lit(None).cast("int")
    return points.select(*table.columns, number.alias("cluster"))
