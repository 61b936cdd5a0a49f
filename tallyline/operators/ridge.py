"""Ridge regressions on numbers and category levels, several at once, with an effect of its own for every level.

A prediction is an intercept, a slope times each number, and one effect a category. They are fitted by rounds: first the
numbers, by normal equations on what the effects leave over, then each category in turn, whose effects are the sums of what
is left over in the level, divided by its rows plus the penalty, less their mean over the levels. After each round the
numbers follow again. Rounds lead to the least penalised squares of all at once. All regressions take their sums from the
same scans, so folds and other labels cost no further pass. Effects are tables, joined by measured size: nothing of the
length of a category's levels reaches the driver, which solves systems of one row a number. The rows are dealt once by the
category with most levels and kept in buckets of it, as are its effects, so no round shuffles the rows again for them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.grouping import table_quantiles
from tallyline.schema import fill_missing_columns, require_columns
from tallyline.sources.scratch import bucketed, dealt_in_slices, dropped, removed, written

ROUNDS, PENALTY = 3, 1.0
#: Files of the rows, and tasks of a pass that meets the effects of the category they are dealt by.
BUCKETS = 96
MISSING = "missing"


@dataclass(frozen=True)
class Target:
    """One regression of ``label`` on ``numbers``, learned from the rows where ``learn`` is true and the label known.

    A label that is a number of some regression, as it is, is given by its name: its column is kept once.
    """

    name: str
    label: Column | str
    numbers: Sequence[str]
    learn: Column | None = None


@dataclass(frozen=True)
class Line:
    """Intercept, and by number the slope and the deviation of the rows learned from."""

    intercept: float
    slopes: Mapping[str, float]
    deviations: Mapping[str, float]


@dataclass(frozen=True)
class Ridges:
    """Fitted regressions: ``effects`` has by category a table of ``level`` and a column a regression, in order of ``lines``.

    ``fills`` has by number what stands for a missing value, ``shifts`` what is taken off.
    """

    lines: Mapping[str, Line]
    effects: Mapping[str, DataFrame]
    fills: Mapping[str, float]
    shifts: Mapping[str, float]

    def predict(self, df: DataFrame, names: Mapping[str, str]) -> DataFrame:
        """``df`` with the predictions of the regressions in ``names`` under new names.

        Levels that were never learned have no effect; a missing category is a level as others are. A number that is
        missing counts as the median of the rows learned from, an absent column as 0.
        """
        ready = fill_missing_columns(require_columns(df, self.effects), list(self.fills))
        ready = ready.withColumns({_level(k): F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for k, c in enumerate(self.effects)})
        order = {name: i for i, name in enumerate(self.lines)}
        x = _numbers(self.fills, self.shifts)
        # Sums so far, so a later join that shuffles carries one number a regression.
        ready = ready.withColumns({f"_p{order[n]}": _on_line(self.lines[n], x) for n in names})
        for k, table in enumerate(self.effects.values()):
            shown = [F.col(f"e{order[n]}").alias(f"_e{order[n]}") for n in names]
            ready = ready.join(table.select(F.col("level").alias(_level(k)), *shown), _level(k), "left")
            more = {f"_p{order[n]}": F.col(f"_p{order[n]}") + F.coalesce(F.col(f"_e{order[n]}"), F.lit(0.0)) for n in names}
            ready = ready.withColumns(more).drop(*(f"_e{order[n]}" for n in names))
        added = {name: F.col(f"_p{order[target]}") for target, name in names.items()}
        return ready.withColumns(added).select(*(c for c in df.columns if c not in added), *added)

    def importance(self, target: str) -> list[tuple[str, float]]:
        """A number's slope in deviations, a category's mean effect over its levels; both without their signs."""
        line, place = self.lines[target], list(self.lines).index(target)
        rows = [(n, abs(s) * line.deviations[n]) for n, s in line.slopes.items()]
        for category, table in self.effects.items():
            mean = table.agg(F.avg(F.abs(F.col(f"e{place}"))).alias("mean")).first()["mean"]
            rows.append((category, mean or 0.0))
        return rows

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(t, None, v.intercept, None, None, None) for t, v in self.lines.items()]
        rows += [(t, n, s, v.deviations[n], self.fills[n], self.shifts[n]) for t, v in self.lines.items() for n, s in v.slopes.items()]
        kept = spark.createDataFrame(
            [(i, *r) for i, r in enumerate(rows)],
            "place int, target string, number string, weight double, deviation double, filling double, shift double",
        )
        kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/lines")
        names = spark.createDataFrame(list(enumerate(self.effects)), "place int, category string")
        names.coalesce(1).write.mode("overwrite").parquet(f"{path}/categories")
        for k, table in enumerate(self.effects.values()):
            table.write.mode("overwrite").parquet(f"{path}/effects-{k}")


def load_ridges(spark: SparkSession, path: str) -> Ridges:
    rows = sorted(spark.read.parquet(f"{path}/lines").collect())
    names = [r["category"] for r in sorted(spark.read.parquet(f"{path}/categories").collect())]
    slopes = [r for r in rows if r["number"] is not None]
    lines = {
        r["target"]: Line(
            r["weight"],
            {s["number"]: s["weight"] for s in slopes if s["target"] == r["target"]},
            {s["number"]: s["deviation"] for s in slopes if s["target"] == r["target"]},
        )
        for r in rows
        if r["number"] is None
    }
    effects = {c: spark.read.parquet(f"{path}/effects-{k}") for k, c in enumerate(names)}
    return Ridges(lines, effects, {s["number"]: s["filling"] for s in slopes}, {s["number"]: s["shift"] for s in slopes})


def _level(k: int) -> str:
    return f"_level{k}"


def _numbers(fills: Mapping[str, float], shifts: Mapping[str, float]) -> dict[str, Column]:
    return {n: F.coalesce(F.col(n).cast("double"), F.lit(fills[n])) - F.lit(shifts[n]) for n in fills}


def _on_line(line: Line, x: Mapping[str, Column]) -> Column:
    return sum((F.lit(s) * x[n] for n, s in line.slopes.items()), F.lit(line.intercept))


def _solved(numbers: Sequence[str], rows: float, sums: np.ndarray, products: np.ndarray, left: float, crossed: np.ndarray, penalty: float) -> Line:
    """The line through rows with these sums; a number that hardly varies has slope 0."""
    if rows == 0:
        return Line(0.0, dict.fromkeys(numbers, 0.0), dict.fromkeys(numbers, 0.0))
    mean = sums / rows
    spread = products - rows * np.outer(mean, mean)
    own = np.diag(spread).copy()
    flat = own <= 1e-12 * np.maximum(np.diag(products), 1e-300)
    wanted = np.where(flat, 0.0, crossed - mean * left)
    spread[flat, :] = spread[:, flat] = 0.0
    np.fill_diagonal(spread, np.where(flat, 1.0, own * (1.0 + penalty / rows)))
    slopes = np.linalg.solve(spread, wanted)
    deviations = np.sqrt(np.where(flat, 0.0, own) / rows)
    return Line(
        float(left / rows - slopes @ mean),
        {n: float(s) for n, s in zip(numbers, slopes)},
        {n: float(d) for n, d in zip(numbers, deviations)},
    )


def fit_ridges(
    df: DataFrame, targets: Sequence[Target], categorical: Sequence[str], rounds: int = ROUNDS, penalty: float = PENALTY,
    dealt_by: str | None = None,
) -> Ridges:
    """Fit all ``targets`` (at most 62) by the same ``rounds`` over ``df``.

    Numbers are as if standardised, so the penalty does not depend on their units. Each category and round is a job
    of one aggregation over the written rows. Without rows all predictions are 0. ``dealt_by`` is the category with most
    levels, if one has too many for a broadcast: the result does not depend on it.
    """
    tables: list[str] = []
    try:
        return _fitted(df, targets, categorical, rounds, penalty, dealt_by, tables)
    finally:
        dropped(df.sparkSession, tables)


def _fitted(
    df: DataFrame, targets: Sequence[Target], categorical: Sequence[str], rounds: int, penalty: float, dealt_by: str | None, tables: list[str]
) -> Ridges:
    numbers = list(dict.fromkeys(n for t in targets for n in t.numbers))
    ready = fill_missing_columns(require_columns(df, categorical), numbers)
    labels = [(F.col(t.label) if isinstance(t.label, str) else t.label).cast("double") for t in targets]
    # One column for regressions of the same label.
    first = [next(i for i, other in enumerate(targets) if other.label is t.label) for t in targets]
    label_of = [t.label if isinstance(t.label, str) and t.label in numbers else f"_y{i}" for i, t in zip(first, targets)]
    hub = None if dealt_by is None else list(categorical).index(dealt_by)
    learned = [F.coalesce(t.learn if t.learn is not None else F.lit(True), F.lit(False)) & y.isNotNull() for t, y in zip(targets, labels)]
    use = sum((F.when(flag, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, flag in enumerate(learned)), F.lit(0).cast("long"))
    selected = ready.select(
        use.alias("_use"),
        *(labels[i].alias(f"_y{i}") for i in dict.fromkeys(first) if f"_y{i}" in label_of),
        *(F.col(n).cast("double").alias(n) for n in numbers),
        *(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(_level(k)) for k, c in enumerate(categorical)),
    )
    selected = selected.where("_use > 0")
    if hub is None:
        rows = written(selected, "ridge-rows")
    else:
        name, dealt_at = dealt_in_slices(selected, "ridge-rows", _level(hub), BUCKETS)
        tables.append(name)
        rows = df.sparkSession.table(name)
    known = rows.agg(
        F.count(F.lit(1)).alias("rows"), *(F.count(n).alias(f"n{j}") for j, n in enumerate(numbers)), *(F.avg(n).alias(f"a{j}") for j, n in enumerate(numbers))
    ).first()
    shifts = {n: known[f"a{j}"] or 0.0 for j, n in enumerate(numbers)}
    fills = dict.fromkeys(numbers, 0.0)
    gaps = [n for j, n in enumerate(numbers) if 0 < known[f"n{j}"] < known["rows"]]
    if gaps:
        fills |= {r["metric"]: r["quantiles"][0] for r in table_quantiles(rows, gaps, [0.5]).collect()}
    x = _numbers(fills, shifts)

    # Sums of products once for every set of regressions that share a row.
    pairs = [(i, j) for i in range(len(numbers)) for j in range(i + 1)]
    shared = rows.groupBy("_use").agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.sum(x[n]).alias(f"s{j}") for j, n in enumerate(numbers)),
        *(F.sum(x[numbers[i]] * x[numbers[j]]).alias(f"p{i}_{j}") for i, j in pairs),
    ).collect()

    def moments(t: int) -> tuple[float, np.ndarray, np.ndarray]:
        mine = [r for r in shared if r["_use"] >> t & 1]
        places = [numbers.index(n) for n in targets[t].numbers]
        sums = np.array([sum(r[f"s{j}"] for r in mine) for j in places], float)
        products = np.array([[sum(r[f"p{max(i, j)}_{min(i, j)}"] for r in mine) for j in places] for i in places], float)
        return sum(r["rows"] for r in mine), sums, products.reshape(len(places), len(places))

    fixed = [moments(t) for t in range(len(targets))]
    mine = [F.col("_use").bitwiseAND(F.lit(1 << t).cast("long")) != 0 for t in range(len(targets))]
    effects: dict[int, DataFrame] = {}

    def beside(k: int | None) -> tuple[DataFrame, list[Column]]:
        """The rows, and per regression the label without the effects of all categories but ``k``."""
        joined, left = rows, [F.col(c) for c in label_of]
        for other, table in effects.items():
            if other != k:
                # Buckets meet buckets: the rows stay where they are, the effects of a bucket are held in its task.
                table = table.hint("shuffle_hash") if other == hub else table
                shown = [F.col(f"e{t}").alias(f"_e{other}_{t}") for t in range(len(targets))]
                joined = joined.join(table.select(F.col("level").alias(_level(other)), *shown), _level(other), "left")
                left = [y - F.coalesce(F.col(f"_e{other}_{t}"), F.lit(0.0)) for t, y in enumerate(left)]
        return joined, left

    def fitted_lines() -> list[Line]:
        joined, left = beside(None)
        sums = joined.agg(
            *(F.sum(F.when(mine[t], y)).alias(f"l{t}") for t, y in enumerate(left)),
            *(F.sum(F.when(mine[t], y * x[n])).alias(f"c{t}_{j}") for t, y in enumerate(left) for j, n in enumerate(targets[t].numbers)),
        ).first()
        found = []
        for t, target in enumerate(targets):
            crossed = np.array([sums[f"c{t}_{j}"] or 0.0 for j in range(len(target.numbers))], float)
            found.append(_solved(list(target.numbers), *fixed[t], sums[f"l{t}"] or 0.0, crossed, penalty))
        return found

    def centred(table: DataFrame) -> DataFrame:
        """Effects that add up to 0, as those of the least squares do; the next intercept takes their mean."""
        means = table.agg(*(F.avg(f"e{t}").alias(f"e{t}") for t in range(len(targets)))).first()
        return table.select("level", *((F.col(c) - F.lit(m or 0.0)).alias(c) for c, m in means.asDict().items()))

    lines = fitted_lines()
    for _ in range(rounds):
        for k in range(len(categorical)):
            joined, left = beside(k)
            over = [y - _on_line(line, x) for y, line in zip(left, lines)]
            sums = joined.groupBy(F.col(_level(k)).alias("level")).agg(
                *(F.try_divide(F.sum(F.when(mine[t], o)), F.count(F.when(mine[t], 1)) + F.lit(penalty)).alias(f"e{t}") for t, o in enumerate(over))
            )
            if k == hub:
                name, path = bucketed(sums, "ridge-effects", "level", BUCKETS)
                tables.append(name)
                effects[k], found_at = centred(df.sparkSession.table(name)), path
            else:
                effects[k] = centred(written(sums, "ridge-effects"))
        lines = fitted_lines()
    if rounds and hub is not None:
        # Its join comes last, and by measured size: the table of buckets is known to this fit only.
        effects[hub] = centred(df.sparkSession.read.schema(effects[hub].schema).parquet(found_at))
    if hub is not None:
        removed(df.sparkSession, dealt_at)
    places = sorted(range(len(categorical)), key=lambda k: k == hub)
    named = {categorical[k]: effects[k] for k in places} if rounds else {}
    return Ridges({t.name: line for t, line in zip(targets, lines)}, named, fills, shifts)
