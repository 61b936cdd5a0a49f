"""Descriptive tables over the order lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import means, sums
from tallyline.operators.grouping import table_quantiles, top_per_group, with_row
from tallyline.schema import CATEGORY_COLUMNS

KEY_METRICS = (
    "line_volume_cbm",
    "line_quantity",
    "line_product_revenue",
    "line_product_cost",
    "line_freight_revenue",
    "line_freight_cost",
    "product_margin",
    "freight_margin",
    "delivered_margin",
)


def grouped(df: DataFrame, *keys: str):
    """``groupBy`` without NULL keys."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df.groupBy(*keys)


def long_form(df: DataFrame, columns: Sequence[str], name: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column): several groupings in one pass over the data."""
    narrow = df.select(*keep, *columns)
    return narrow.unpivot(list(keep), list(columns), name, value).filter(F.col(value).isNotNull())


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum."""
    row = df.agg(
        F.array(
            *(
                F.struct(
                    F.lit(c).alias("metric"),
                    F.count(c).alias("count"),
                    F.avg(c).cast("double").alias("mean"),
                    F.stddev_samp(c).alias("std"),
                    F.min(c).cast("double").alias("min"),
                    F.max(c).cast("double").alias("max"),
                )
                for c in columns
            )
        ).alias("_rows")
    )
    moments = row.select(F.inline("_rows"))
    quartiles = table_quantiles(
        df.select(*(F.col(c).cast("double").alias(c) for c in columns)), columns, [0.25, 0.5, 0.75]
    )
    return moments.join(quartiles, "metric", "left").select(
        "metric",
        "count",
        "mean",
        "std",
        "min",
        F.col("quantiles")[0].alias("p25"),
        F.col("quantiles")[1].alias("p50"),
        F.col("quantiles")[2].alias("p75"),
        "max",
    )


def key_metric_summary(ol: DataFrame) -> DataFrame:
    return describe(ol, KEY_METRICS)


def order_line_counts(ol: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent values of each category column."""
    counts = (
        long_form(ol, CATEGORY_COLUMNS, "category_column", "category_value")
        .groupBy("category_column", "category_value")
        .agg(F.count(F.lit(1)).alias("order_lines"))
    )
    return top_per_group(counts, ["category_column"], [F.desc("order_lines"), F.asc("category_value")], top)


def channel_region_counts(ol: DataFrame, top_regions: int = 10) -> DataFrame:
    """Lines of every channel, and of the regions with most lines."""

    def counts(dimension: str) -> DataFrame:
        return (
            grouped(ol, dimension)
            .agg(F.count(F.lit(1)).alias("order_lines"))
            .select(F.lit(dimension).alias("dimension"), F.col(dimension).alias("value"), "order_lines")
        )

    regions = counts("order_region").orderBy(F.desc("order_lines"), "value").limit(top_regions)
    return counts("order_channel").unionByName(regions)


def daily_totals(ol: DataFrame) -> DataFrame:
    """Sums and mean margins per calendar day."""
    return (
        grouped(ol, "order_date")
        .agg(
            *sums(
                "line_volume_cbm",
                "line_product_revenue",
                "line_freight_revenue",
                "line_product_cost",
                "line_freight_cost",
                "total_revenue",
                "total_cost",
            ),
            *means(
                avg_product_margin="product_margin",
                avg_freight_margin="freight_margin",
                avg_delivered_margin="delivered_margin",
            ),
        )
    )


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """``bin, bin_start, bin_end, rows`` of all equal-width bins between the column's minimum and maximum, empty ones too.

    The last bin holds its end. With one value all rows are in the first bin; without values there are no bins.
    """
    bounds = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    low, high, x = F.col("_bounds.low"), F.col("_bounds.high"), F.col(column)
    number = F.when(low == high, 1).otherwise(
        F.least(F.width_bucket(x, low, high, F.lit(bins)).cast("int"), F.lit(bins))
    )
    known = with_row(df.select(column), bounds, "_bounds").filter(x.isNotNull())
    counts = known.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    # At most ``bins`` rows on both sides.
    every = bounds.filter("low IS NOT NULL").select("low", "high", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    edge = lambda k: F.col("low") + (F.col("high") - F.col("low")) * (k / F.lit(float(bins)))
    return every.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        edge(F.col("bin") - 1).alias("bin_start"),
        edge(F.col("bin")).alias("bin_end"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


DAILY_METRICS = (
    "line_volume_cbm",
    "line_product_revenue",
    "line_freight_revenue",
    "line_product_cost",
    "line_freight_cost",
    "total_revenue",
    "total_cost",
    "avg_product_margin",
    "avg_freight_margin",
    "avg_delivered_margin",
)


def daily_summary(ol: DataFrame) -> DataFrame:
    """Description of all daily figures."""
    return describe(daily_totals(ol), DAILY_METRICS)
