"""Price and freight elasticity between neighbouring prices of an item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.columns import exact_sum, ratio
from tallyline.operators.grouping import exact_quantiles, heavy_keys, with_lookback
from tallyline.operators.profile import grouped


def neighbour_elasticity(
    ol: DataFrame, numerator: str, alias: str, split_rows: int | None = None
) -> DataFrame:
    """Median of -(change of quantity) / (change of price) per item.

    Lines are summed to one row per (item, unit price) before anything is
    ordered, and all items are handled in one job. Unchanged and infinite steps
    are skipped; items without a valid step are left out.
    """
    priced = ol.filter(F.col("item_number").isNotNull()).select(
        "item_number",
        F.when(F.col("line_quantity") != 0, F.col(numerator) / F.col("line_quantity")).otherwise(0.0).alias("price"),
        "line_quantity",
    )
    ladder = (
        priced.filter(F.col("price").isNotNull())
        .groupBy("item_number", "price")
        .agg(exact_sum("line_quantity").alias("quantity"))
    )
    # An item has at most as many prices, and price steps, as lines.
    heavy = heavy_keys(priced, ["item_number"], split_rows)
    cut = with_lookback(ladder, ["item_number"], ["price"], 1, heavy=heavy)
    along = Window.partitionBy("item_number", "_part").orderBy("price")

    def change(c: str):
        before = F.lag(c).over(along)
        return ratio(c, before) - 1.0

    steps = (
        cut.withColumn("_price_change", change("price"))
        .withColumn("_quantity_change", change("quantity"))
        .filter(~F.col("_halo"))
        .filter((F.col("_price_change") != 0) & (F.col("_quantity_change") != 0))
        .select("item_number", (-F.col("_quantity_change") / F.col("_price_change")).alias("_elasticity"))
    )
    return exact_quantiles(steps, "_elasticity", [0.5], ["item_number"], heavy=heavy).select("item_number", F.col("quantiles")[0].alias(alias))


def price_elasticity(ol: DataFrame, split_rows: int | None = None) -> DataFrame:
    return neighbour_elasticity(ol, "line_product_revenue", "price_elasticity", split_rows)


def freight_elasticity(ol: DataFrame, split_rows: int | None = None) -> DataFrame:
    return neighbour_elasticity(ol, "line_freight_revenue", "freight_revenue_elasticity", split_rows)


def _with_margin(ol: DataFrame, elasticities: DataFrame) -> DataFrame:
    margins = grouped(ol, "item_number").agg(F.avg("delivered_margin").alias("avg_delivered_margin"))
    return elasticities.join(margins, "item_number")


def elasticity_with_margin(ol: DataFrame) -> DataFrame:
    return _with_margin(ol, price_elasticity(ol))


def freight_elasticity_with_margin(ol: DataFrame) -> DataFrame:
    return _with_margin(ol, freight_elasticity(ol))


def elasticity_extremes(ol: DataFrame, n: int = 10) -> DataFrame:
    """Elasticities of the items with the highest and lowest mean margin."""
    table = elasticity_with_margin(ol)
    ends = [
        table.orderBy(order("avg_delivered_margin"), "item_number").limit(n).withColumn("end", F.lit(name))
        for name, order in (("top", F.desc), ("bottom", F.asc))
    ]
    return ends[0].unionByName(ends[1])


def freight_elasticity_bottom(ol: DataFrame, n: int = 10) -> DataFrame:
    return freight_elasticity_with_margin(ol).orderBy("avg_delivered_margin", "item_number").limit(n)


def top_revenue_elasticity(ol: DataFrame, n: int = 10) -> DataFrame:
    """Elasticities of the items with most product revenue (NULL when undefined)."""
    best = (
        grouped(ol, "item_number")
        .agg(exact_sum("line_product_revenue").alias("line_product_revenue"))
        .orderBy(F.desc("line_product_revenue"), "item_number")
        .limit(n)
    )
    # ``n`` keys: always small enough to broadcast.
    lines = ol.join(F.broadcast(best.select("item_number")), "item_number", "left_semi")
    return best.join(price_elasticity(lines), "item_number", "left")
