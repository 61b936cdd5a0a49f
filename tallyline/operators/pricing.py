"""Freight price sensitivity, recommendations and what-if scenarios."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import clipped, ratio
from tallyline.operators.grouping import attach, quantile_row, with_row
from tallyline.operators.lines import with_freight_price
from tallyline.operators.profile import grouped
from tallyline.schema import LINE_KEY
from tallyline.sources.scratch import MOST_SLICES, in_slices, shuffles_cleared, sliced, written


@dataclass(frozen=True)
class Targets:
    """Target margins as fractions (fixed values)."""

    product: float = 0.492
    freight: float = -0.1501
    delivered: float = 0.4541


# Candidate grid sizes (fixed values).
GRID_SIZES = (50, 100, 200, 500)


def _cell_sums(ol: DataFrame) -> DataFrame:
    """Per month number, weekday, channel and region: what prices and demand need of the lines."""
    lines = with_freight_price(ol).withColumns(
        {
            "month": F.month("order_date"),
            "day_of_week": F.weekday("order_date"),
            "unit_cost": ratio("line_freight_cost", "line_quantity"),
        }
    )
    return grouped(lines, "month", "day_of_week", "order_channel", "order_region").agg(
        F.avg("price").alias("avg_price"),
        F.avg("line_quantity").alias("avg_quantity"),
        F.sum("price").alias("_prices"),
        F.count("price").alias("_priced"),
        F.sum("unit_cost").alias("_costs"),
        F.count("unit_cost").alias("_costed"),
    )


def _with_logs(cells: DataFrame) -> DataFrame:
    return cells.withColumn("log_price", F.log(F.col("avg_price") + 0.01)).withColumn(
        "log_quantity", F.log(F.col("avg_quantity") + 0.01)
    )


def demand_cells(ol: DataFrame) -> DataFrame:
    """Mean freight price and quantity per month number, weekday, channel and region."""
    return _with_logs(_cell_sums(ol)).drop("_prices", "_priced", "_costs", "_costed")


def log_log_elasticity(ol: DataFrame) -> DataFrame:
    """Slope of log quantity on log price over the demand cells."""
    return demand_cells(ol).agg(F.regr_slope("log_quantity", "log_price").alias("slope"))


def demand_response(price: Column, reference: Column, slope: Column, demand: str = "power") -> Column:
    """Relative demand at ``price``.

    ``power`` is what a log-log slope means, (price / reference) ^ slope, and 1
    where there is no reference price; ``exp`` is exp(-slope * price).
    """
    if demand == "exp":
        return F.exp(-slope * price)
    return F.when(reference > 0, F.pow(price / reference, slope)).otherwise(1.0)


def market(ol: DataFrame) -> DataFrame:
    """One row: 5 % and 95 % freight price, mean price, mean unit cost and demand slope.

    Means and slope come from one pass over the lines, the quantiles from two.
    """
    row = _with_logs(_cell_sums(ol)).agg(
        F.try_divide(F.sum("_prices"), F.sum("_priced")).alias("avg_price"),
        F.try_divide(F.sum("_costs"), F.sum("_costed")).alias("avg_unit_cost"),
        F.regr_slope("log_quantity", "log_price").alias("slope"),
    )
    prices = with_freight_price(ol).select("price")
    return with_row(row, quantile_row(prices, ["price"], [0.05, 0.95]), "_edges").select(
        "avg_price",
        "avg_unit_cost",
        F.col("_edges.of")["price"][0].alias("lower_price"),
        F.col("_edges.of")["price"][1].alias("upper_price"),
        "slope",
    )


def price_grid(ol: DataFrame, sizes: Sequence[int] = GRID_SIZES, demand: str = "power") -> DataFrame:
    """Simulated profit at evenly spaced prices, for each grid size.

    The grid is generated on the single market row; its size is fixed by ``sizes``.
    """
    sized = market(ol).withColumn("size", F.explode(F.array(*(F.lit(s) for s in sizes))))
    stepped = sized.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    share = F.col("step").cast("double") / (F.col("size") - 1).cast("double")
    priced = stepped.withColumn(
        "price", F.col("lower_price") + share * (F.col("upper_price") - F.col("lower_price"))
    )
    response = demand_response(
        F.greatest(F.col("price"), F.lit(0.01)), F.col("avg_price"), F.col("slope"), demand
    )
    return priced.withColumn("demand", response).select(
        "size",
        "step",
        "price",
        "demand",
        ((F.col("price") - F.col("avg_unit_cost")) * F.col("demand")).alias("profit"),
    )


def price_range(ol: DataFrame, sizes: Sequence[int] = GRID_SIZES, demand: str = "power") -> DataFrame:
    """Price bounds and the grid size with the least spread of simulated profit."""
    spread = price_grid(ol, sizes, demand).groupBy("size").agg(
        F.min("price").alias("lower_price"),
        F.max("price").alias("upper_price"),
        F.stddev_samp("profit").alias("_std"),
    )
    return spread.agg(
        F.min("lower_price").alias("lower_price"),
        F.max("upper_price").alias("upper_price"),
        F.min_by("size", F.struct("_std", "size")).alias("best_size"),
        F.min("_std").alias("profit_std"),
    )


def recommend_freight_price(
    df: DataFrame, freight_cost: str = "line_freight_cost", targets: Targets | None = None, steps: int = 48
) -> DataFrame:
    """Freight revenue per line that brings the margins closest to their targets.

    Product revenue is set from its own target. Between the price that meets
    the freight target and the one that meets the delivered target the two
    squared gaps pull in opposite directions; halving that interval on the sign
    of the derivative finds the balance. The search loops on whole Arrow
    batches: as a SQL higher-order function it took a hundred times longer.
    """
    t = targets or Targets()
    a, b = 1.0 - t.freight, 1.0 - t.delivered

    @F.pandas_udf("double")
    def balance(product_cost: pd.Series, cost: pd.Series, revenue: pd.Series) -> pd.Series:
        total = product_cost + cost
        ends = (cost / a).clip(lower=0.01), (total / b - revenue).clip(lower=0.01)
        low, high = np.minimum(*ends).to_numpy(), np.maximum(*ends).to_numpy()
        c, d, p = cost.to_numpy(), total.to_numpy(), revenue.to_numpy()
        for _ in range(steps):
            x = (low + high) / 2.0
            y = p + x
            falling = (a - c / x) * c / (x * x) + (b - d / y) * d / (y * y) < 0
            low, high = np.where(falling, x, low), np.where(falling, high, x)
        return pd.Series((low + high) / 2.0)

    base = df.select(
        LINE_KEY,
        "line_product_cost",
        (F.col("line_product_cost") / F.lit(1.0 - t.product)).alias("product_revenue"),
        F.col(freight_cost).alias("predicted_freight_cost"),
    )
    known = F.col("line_product_cost").isNotNull() & F.col("predicted_freight_cost").isNotNull()
    price = balance("line_product_cost", "predicted_freight_cost", "product_revenue")
    return base.withColumn("freight_revenue", F.when(known, price))


def target_gap(
    df: DataFrame, freight_cost: str = "line_freight_cost", targets: Targets | None = None
) -> DataFrame:
    """Margins reached at the recommended price, minus the targets."""
    t = targets or Targets()
    r = recommend_freight_price(df, freight_cost, t)
    revenue = F.col("product_revenue") + F.col("freight_revenue")
    cost = F.col("line_product_cost") + F.col("predicted_freight_cost")

    def margin(income: Column, outlay: Column) -> Column:
        return F.when(income == 0, 0.0).otherwise((income - outlay) / income)

    return r.select(
        LINE_KEY,
        (margin(F.col("product_revenue"), F.col("line_product_cost")) - t.product).alias("product_margin_gap"),
        (margin(F.col("freight_revenue"), F.col("predicted_freight_cost")) - t.freight).alias("freight_margin_gap"),
        (margin(revenue, cost) - t.delivered).alias("delivered_margin_gap"),
    )


def scenario_lines(ol: DataFrame, mode: str = "unit", known: DataFrame | None = None) -> DataFrame:
    """Line columns a scenario needs, with the market's bounds and demand slope; ``known`` is the market, where it is at hand.

    A candidate is a unit price, or a multiplier of freight cost with
    ``mode="multiplier"``; ``_scale`` turns it into a line price.
    """
    lines = with_freight_price(ol).select(
        LINE_KEY,
        F.col("line_quantity").alias("_q"),
        F.col("line_freight_cost").alias("_c"),
        F.col("price").alias("_ref"),
        F.col("line_quantity" if mode == "unit" else "line_freight_cost").alias("_scale"),
    )
    bounds = (market(ol) if known is None else known).select("lower_price", "upper_price", "slope")
    return with_row(lines, bounds, "_m")


# From here on a double has no fraction, and may be too large for a long.
WHOLE = float(2**53)


def whole_quantity(wanted: Column) -> Column:
    """The quantity in whole units, one at least."""
    return F.greatest(F.when(wanted < WHOLE, F.floor(F.least(wanted, F.lit(WHOLE))).cast("double")).otherwise(wanted), F.lit(1.0))


def scenario_rows(ol: DataFrame, steps: int = 100, demand: str = "power", mode: str = "unit") -> DataFrame:
    """What-if freight prices, one row per line and price step; lines with a negative quantity are kept.

    Step ``a`` offers ``lower + a / (steps - 1) * (upper - lower)``. The grid is
    generated next to its line: no join and no shuffle.
    """
    step = F.col("step").cast("double") / F.lit(float(max(steps - 1, 1)))
    candidate = F.col("_m.lower_price") + step * (F.col("_m.upper_price") - F.col("_m.lower_price"))
    # A returned or empty line has no unit price to react to: its demand stays as it is.
    unit_price = F.try_divide(F.col("new_price"), F.col("_q"))
    response = F.when(F.col("_q") > 0, demand_response(unit_price, F.col("_ref"), F.col("_m.slope"), demand)).otherwise(1.0)
    wanted = F.col("_q") * response
    return (
        scenario_lines(ol, mode)
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
        .withColumn("new_price", F.greatest(candidate * F.col("_scale"), F.lit(0.01)))
        .withColumn("new_quantity", whole_quantity(wanted))
        .select(
            LINE_KEY,
            "step",
            "new_price",
            "new_quantity",
            ((F.col("new_price") - F.col("_c")) / F.col("new_price")).alias("margin_rate"),
            (F.try_divide(F.col("new_price") - F.col("_c"), F.col("_q")) * F.col("new_quantity")).alias("profit"),
        )
    )


def _offer(step: int, last: float, demand: str, q, c, ref, scale, low, high, slope) -> tuple[np.ndarray, ...]:
    """Price, quantity, margin rate and profit of one price step for arrays of lines; the profit of an empty line is NaN."""
    price = np.maximum((low + step / last * (high - low)) * scale, 0.01)
    with np.errstate(all="ignore"):
        if demand == "exp":
            response = np.where(q > 0, np.exp(-slope * (price / q)), 1.0)
        else:
            response = np.where((q > 0) & (ref > 0), np.power(price / q / ref, slope), 1.0)
        quantity = np.maximum(np.floor(q * response), 1.0)
        profit = np.where(q != 0, (price - c) / q * quantity, np.nan)
    return price, quantity, (price - c) / price, profit


SCENARIO_INPUTS = ("_q", "_c", "_ref", "_scale", "_m.lower_price", "_m.upper_price", "_m.slope")


def scenario_summary(ol: DataFrame, steps: int = 100, demand: str = "power", mode: str = "unit") -> DataFrame:
    """Mean margin rate, total quantity and mean profit of each price step over all lines.

    The figures of ``scenario_rows``; a task adds up its lines a step at a time and hands on one row a step, so no line
    is multiplied.
    """
    last = float(max(steps - 1, 1))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((steps, 5))
        for batch in batches:
            columns = [batch[c].to_numpy(dtype=float) for c in batch.columns]
            for step in range(steps):
                _, quantity, rate, profit = _offer(step, last, demand, *columns)
                known = ~np.isnan(profit)
                total[step] += len(rate), rate.sum(), quantity.sum(), known.sum(), profit[known].sum()
        if total[0, 0]:
            out = pd.DataFrame(total, columns=["n", "rate", "quantity", "known", "profit"])
            out.insert(0, "step", np.arange(steps, dtype=np.int32))
            yield out

    lines = scenario_lines(ol, mode).select(*(F.col(c).alias(f"x{i}") for i, c in enumerate(SCENARIO_INPUTS)))
    parts = lines.mapInPandas(summed, "step int, n double, rate double, quantity double, known double, profit double")
    return parts.groupBy("step").agg(
        (F.sum("rate") / F.sum("n")).alias("avg_margin_rate"),
        F.sum("quantity").alias("total_quantity"),
        F.try_divide(F.sum("profit"), F.sum("known")).alias("avg_profit"),
    )


def price_scenarios(
    ol: DataFrame, steps: int = 100, demand: str = "power", mode: str = "unit", known: DataFrame | None = None
) -> DataFrame:
    """Scenario with the most profit for every line (lowest step on ties).

    Same grid as ``scenario_rows``, but searched a step at a time on Arrow
    batches, so the grid's rows are neither built nor shuffled.
    """
    last = float(max(steps - 1, 1))

    @F.pandas_udf("step int, new_price double, new_quantity double, margin_rate double, profit double")
    def best(
        q: pd.Series, c: pd.Series, ref: pd.Series, scale: pd.Series, low: pd.Series, high: pd.Series, slope: pd.Series
    ) -> pd.DataFrame:
        columns = [s.to_numpy(dtype=float) for s in (q, c, ref, scale, low, high, slope)]
        found = None
        for step in range(steps):
            price, quantity, rate, profit = _offer(step, last, demand, *columns)
            offer = np.stack([np.full_like(price, step), price, quantity, rate, profit])
            found = offer if found is None else np.where(profit > found[4], offer, found)
        out = pd.DataFrame(found.T, columns=["step", "new_price", "new_quantity", "margin_rate", "profit"])
        return out.astype({"step": "int32"})

    return (
        scenario_lines(ol, mode, known)
        .select(LINE_KEY, best(*SCENARIO_INPUTS).alias("_s"))
        .select(LINE_KEY, "_s.step", "_s.new_price", "_s.new_quantity", "_s.margin_rate", "_s.profit")
    )


def dataset_stats(ol: DataFrame) -> DataFrame:
    """Mean and deviation of profit, mean quantity and freight cost, as one row."""
    return ol.agg(
        F.avg("total_profit").alias("avg_profit"),
        F.stddev_samp("total_profit").alias("std_profit"),
        F.avg("line_quantity").alias("avg_quantity"),
        F.avg("line_freight_cost").alias("avg_freight_price"),
    )


def segment_multipliers(ol: DataFrame, segments: DataFrame, segment: str = "customer_segment") -> DataFrame:
    """Mean delivered margin per customer segment.

    Lines are summed per customer before the segment is joined.
    """
    customers = grouped(ol, "customer_name").agg(
        F.sum("delivered_margin").alias("_margin"), F.count("delivered_margin").alias("_rows")
    )
    return (
        customers.join(segments.select("customer_name", segment), "customer_name")
        .groupBy(segment)
        .agg(ratio(F.sum("_margin"), F.sum("_rows")).alias("segment_multiplier"))
    )


def month_multipliers(ol: DataFrame) -> DataFrame:
    """Mean margin of each month number relative to the overall mean."""
    months = grouped(ol.withColumn("month", F.month("order_date")), "month").agg(
        F.avg("delivered_margin").alias("_mean")
    )
    overall = ol.agg(F.avg("delivered_margin").alias("mean"))
    return with_row(months, overall, "_all").select(
        "month", ratio("_mean", "_all.mean").alias("month_multiplier")
    )


def scenario_score(
    ol: DataFrame,
    scored: DataFrame,
    segments: DataFrame,
    segment: str = "customer_segment",
    limit: float = 10.0,
) -> DataFrame:
    """Unit-less score of a price per line.

    ``scored`` carries the line key, ``customer_name``, ``month``, ``new_price``
    and the model outputs ``predicted_profit``, ``predicted_quantity`` and
    ``predicted_margin``. Unknown segments count as 1.
    """
    large = len(sliced(scored, LINE_KEY)) > 1

    def once(table: DataFrame) -> DataFrame:
        """A table that all slices read."""
        return written(table, "scenario-means") if large else table

    with shuffles_cleared(ol.sparkSession):
        segments = once(segments.select("customer_name", segment))
        means = once(dataset_stats(ol).select("avg_profit", "avg_quantity"))
        by_segment, by_month = once(segment_multipliers(ol, segments, segment)), once(month_multipliers(ol))
    base = ratio("predicted_profit", F.col("_mean.avg_profit")) * ratio(
        "predicted_quantity", F.col("_mean.avg_quantity")
    )
    adjusted = 1.0 + ratio(F.col("predicted_margin") - F.col("new_price"), "new_price")
    score = base * adjusted * F.coalesce("segment_multiplier", F.lit(1.0)) * F.col("month_multiplier")

    def multiplied(part: DataFrame) -> DataFrame:
        with_segment = attach(part, segments, ["customer_name"])
        joined = attach(attach(with_segment, by_segment, [segment]), by_month, ["month"])
        return with_row(joined, means, "_mean").select(LINE_KEY, clipped(score, -limit, limit).alias("score"))

    # Much is written by now, so little is left for the shuffles.
    return in_slices(scored, LINE_KEY, multiplied, "scenario-scores", most=2 * MOST_SLICES)
