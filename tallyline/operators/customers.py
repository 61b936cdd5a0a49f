"""Customer tables and value tertiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.columns import exact_sum, ratio, sums
from tallyline.operators.grouping import attach, exact_quantiles, with_lookback, with_row
from tallyline.operators.profile import grouped
from tallyline.schema import LINE_KEY
from tallyline.sources.scratch import written

CUSTOMER_FEATURES = (
    "order_count",
    "total_product_revenue",
    "total_freight_revenue",
    "total_volume",
    "avg_order_value",
    "purchase_frequency",
    "clv",
)


def customer_features(ol: DataFrame) -> DataFrame:
    """Lines, revenue, volume, lifetime and lifetime value per customer.

    ``order_count`` counts lines.
    """
    totals = grouped(ol, "customer_name").agg(
        F.count("order_number").alias("order_count"),
        exact_sum("line_product_revenue").alias("total_product_revenue"),
        exact_sum("line_freight_revenue").alias("total_freight_revenue"),
        exact_sum("line_volume_cbm").alias("total_volume"),
        (F.datediff(F.max("order_date"), F.min("order_date")) + 1).alias("customer_lifetime_days"),
    )
    revenue = F.col("total_product_revenue") + F.col("total_freight_revenue")
    rates = totals.withColumn("avg_order_value", ratio(revenue, "order_count")).withColumn(
        "purchase_frequency", ratio("order_count", "customer_lifetime_days")
    )
    value = F.col("avg_order_value") * F.col("purchase_frequency") * F.col("customer_lifetime_days")
    return rates.withColumn("clv", F.when(value < 0, 0.0).otherwise(value))


def customer_totals(ol: DataFrame) -> DataFrame:
    return grouped(ol, "customer_name").agg(
        exact_sum("total_revenue").alias("customer_total_value"), F.count(F.lit(1)).alias("order_lines")
    )


def customer_total_value(ol: DataFrame) -> DataFrame:
    """Every line with the total value of its customer.

    Aggregate and join instead of a window: lines of a hot customer are never
    gathered in one task.
    """
    totals = customer_totals(ol).drop("order_lines")
    return attach(ol.select(LINE_KEY, "customer_name"), totals, ["customer_name"], "inner")


def with_value_group(df: DataFrame, value: Column, edges: DataFrame) -> DataFrame:
    first, second = F.col("_edges.quantiles")[0], F.col("_edges.quantiles")[1]
    group = F.when(value <= first, "Low Value").when(value <= second, "Medium Value").otherwise("High Value")
    return with_row(df, edges, "_edges").withColumn("customer_group", group).drop("_edges")


def tertile_edges(totals: DataFrame, split_rows: int | None = None) -> DataFrame:
    """Tertile edges of customer value over lines: each customer weighs its lines."""
    return exact_quantiles(
        totals, "customer_total_value", [1 / 3, 2 / 3], weight=F.col("order_lines"), split_rows=split_rows
    )


def value_tertiles(ol: DataFrame) -> DataFrame:
    """Low / Medium / High Value group of each customer (right-closed edges)."""
    totals = written(customer_totals(ol), "customers")
    return with_value_group(totals, F.col("customer_total_value"), tertile_edges(totals))


def customer_group_channel(ol: DataFrame) -> DataFrame:
    """Lines, mean order value and mean margin per value tertile and channel.

    Lines are reduced to (customer, channel) first; everything after works on
    that table, so neither a join nor a window touches the lines.
    """
    cells = written(
        grouped(ol, "customer_name", "order_channel").agg(
            F.count(F.lit(1)).alias("order_lines"),
            exact_sum("total_revenue").alias("value"),
            F.sum("delivered_margin").alias("margin"),
        ),
        "customer-channel",
    )
    # At most one row per channel in each window.
    customer = Window.partitionBy("customer_name")
    totals = cells.groupBy("customer_name").agg(
        exact_sum("value").alias("customer_total_value"), F.sum("order_lines").alias("order_lines")
    )
    valued = cells.withColumn("customer_total_value", exact_sum("value", over=customer))
    placed = with_value_group(valued, F.col("customer_total_value"), tertile_edges(totals))
    return placed.groupBy("customer_group", "order_channel").agg(
        F.sum("order_lines").alias("order_count"),
        ratio(exact_sum("value"), F.sum("order_lines")).alias("avg_order_value"),
        ratio(F.sum("margin"), F.sum("order_lines")).alias("avg_delivered_margin"),
    )


def rolling_7(
    ol: DataFrame,
    columns: tuple[str, ...] = ("line_product_revenue", "line_freight_cost"),
    rows: int = 7,
    split_rows: int | None = None,
) -> DataFrame:
    """Mean over the last ``rows`` lines of the customer, by date and line key."""
    lines = ol.select("customer_name", "order_date", LINE_KEY, *columns).filter(
        F.col("customer_name").isNotNull() & F.col("order_date").isNotNull()
    )
    cut = with_lookback(lines, ["customer_name"], ["order_date", LINE_KEY], rows - 1, split_rows)
    last = Window.partitionBy("customer_name", "_part").orderBy("order_date", LINE_KEY).rowsBetween(1 - rows, 0)
    return (
        cut.withColumns({f"avg_{c}_7d": F.avg(c).over(last) for c in columns})
        .filter(~F.col("_halo"))
        .select(LINE_KEY, "customer_name", "order_date", *(f"avg_{c}_7d" for c in columns))
    )


def segment_features(ol: DataFrame, prediction: str) -> DataFrame:
    """Inputs of the customer segmentation; ``prediction`` is a per-line margin estimate."""
    return grouped(ol, "customer_name").agg(
        *sums("total_revenue", "line_quantity"),
        F.avg("delivered_margin").alias("avg_delivered_margin"),
        F.avg(prediction).alias("avg_predicted_margin"),
    )
