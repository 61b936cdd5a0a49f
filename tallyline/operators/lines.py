"""Per-line projections: margins, totals, ratios and the cleaned fact table."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import clipped, cost, margin_pct, ratio, ratio_or_zero, revenue, season
from tallyline.schema import LINE_KEY, ORDER_LINES, require_columns


def with_margins(df: DataFrame) -> DataFrame:
    """Product, freight and delivered margin of each line, in percent."""
    return df.withColumns(
        {
            "product_margin": margin_pct("line_product_revenue", "line_product_cost"),
            "freight_margin": margin_pct("line_freight_revenue", "line_freight_cost"),
            "delivered_margin": margin_pct(revenue(), cost()),
        }
    )


def with_totals(df: DataFrame) -> DataFrame:
    """Revenue (also the order value), cost and profit of each line."""
    return df.withColumns(
        {
            "total_revenue": revenue(),
            "total_cost": cost(),
            "total_profit": revenue() - cost(),
        }
    )


def enriched_lines(df: DataFrame) -> DataFrame:
    """All order lines with their margins, totals and unit price; what a missing value makes unknown is NULL."""
    require_columns(df, ORDER_LINES.names)
    return with_totals(with_margins(df)).withColumn("avg_price", ratio("line_product_revenue", "line_quantity"))


def clean_lines(df: DataFrame) -> DataFrame:
    """Enrich the order lines and keep those without any missing value.

    A zero quantity makes ``avg_price`` NULL, so such lines are dropped too.
    """
    enriched = enriched_lines(df)
    # One predicate per column, not ``dropna``: each can be pushed to the scan or
    # dropped when the column cannot be NULL, and unused columns stay pruned.
    for name in (*ORDER_LINES.names, "avg_price"):
        enriched = enriched.filter(F.col(name).isNotNull())
    return enriched


def line_margins(ol: DataFrame) -> DataFrame:
    return ol.select(LINE_KEY, "product_margin", "freight_margin", "delivered_margin")


def line_totals(ol: DataFrame) -> DataFrame:
    return ol.select(
        LINE_KEY,
        "total_revenue",
        "total_cost",
        "total_profit",
        F.col("total_revenue").alias("order_value"),
        F.col("total_profit").alias("profit"),
        "avg_price",
    )


def margin_fraction(income: Column, outlay: Column) -> Column:
    """Margin as a fraction in [-1, 1]; n/0 gives the sign of n, missing gives 0."""
    raw = F.when(income == 0, F.signum(income - outlay)).otherwise((income - outlay) / income)
    return F.coalesce(clipped(raw, -1.0, 1.0), F.lit(0.0))


def line_margins_fraction(df: DataFrame) -> DataFrame:
    return df.select(
        LINE_KEY,
        margin_fraction(F.col("line_product_revenue"), F.col("line_product_cost")).alias("product_margin"),
        margin_fraction(F.col("line_freight_revenue"), F.col("line_freight_cost")).alias("freight_margin"),
        margin_fraction(revenue(), cost()).alias("delivered_margin"),
    )


def with_calendar(df: DataFrame) -> DataFrame:
    """Month number, weekday (Monday = 0), weekend flag and season."""
    weekday = F.weekday("order_date")
    return df.withColumns(
        {
            "month": F.month("order_date"),
            "day_of_week": weekday,
            "is_weekend": weekday.isin(5, 6).cast("int"),
            "season": season("order_date"),
        }
    )


def line_calendar(ol: DataFrame) -> DataFrame:
    return with_calendar(ol).select(
        LINE_KEY,
        "month",
        "day_of_week",
        "is_weekend",
        "season",
        F.trunc("order_date", "MM").alias("month_start"),
        F.last_day("order_date").alias("month_end"),
    )


def with_ratios(df: DataFrame) -> DataFrame:
    """Ratio features; each is skipped when one of its inputs is absent."""
    wanted = {
        "revenue_to_cost_ratio": (
            ("line_product_revenue", "line_product_cost"),
            lambda n, d: clipped(ratio_or_zero(n, d), 0.0, 10.0),
        ),
        "freight_to_product_cost_ratio": (
            ("line_freight_cost", "line_product_cost"),
            lambda n, d: clipped(ratio_or_zero(n, d), 0.0, 10.0),
        ),
        "volume_to_margin_ratio": (("line_volume_cbm", "delivered_margin"), ratio_or_zero),
    }
    present = set(df.columns)
    return df.withColumns(
        {name: fn(*inputs) for name, (inputs, fn) in wanted.items() if present.issuperset(inputs)}
    )


def line_ratios(ol: DataFrame) -> DataFrame:
    return with_ratios(ol).select(
        LINE_KEY, "revenue_to_cost_ratio", "freight_to_product_cost_ratio", "volume_to_margin_ratio"
    )


def with_freight_price(df: DataFrame) -> DataFrame:
    """Freight revenue proxy and its unit price.

    Lines without a freight cost are priced at 15 % of product revenue.
    """
    proxy = F.when(F.col("line_freight_cost") != 0, F.col("line_freight_revenue")).otherwise(
        F.col("line_product_revenue") * 0.15
    )
    return df.withColumn("freight_revenue", proxy).withColumn(
        "price", ratio("freight_revenue", "line_quantity")
    )


def line_freight_price(ol: DataFrame) -> DataFrame:
    return with_freight_price(ol).select(LINE_KEY, "freight_revenue", "price")


class MarginColumns(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``with_margins`` as an ML pipeline stage."""

    @keyword_only
    def __init__(self):
        super().__init__()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return with_margins(dataset)


IDENTIFIERS = ("order_number", "order_date", LINE_KEY, "customer_name", "customer_agreement")


def model_inputs(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The order lines without identifiers, dates and customers."""
    return df.drop(*(c for c in IDENTIFIERS if c not in keep))
