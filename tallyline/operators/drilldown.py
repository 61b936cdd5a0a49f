"""Loss-making orders and per-category drill-downs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.columns import exact_mean, sums
from tallyline.operators.grouping import top_per_group
from tallyline.operators.products import MONEY
from tallyline.operators.profile import grouped, long_form
from tallyline.schema import CATEGORY_COLUMNS

ITEM_MEMBERS = ("order_region", "customer_agreement", "customer_name")
AGREEMENT_MEMBERS = ("item_number",)
ORDER_MEMBERS = (*CATEGORY_COLUMNS, "item_number")


def negative_margin_lines(ol: DataFrame) -> DataFrame:
    """All lines of every order that has a line with a negative margin."""
    bad = ol.filter(F.col("delivered_margin") < 0).select("order_number").distinct()
    return ol.join(bad, "order_number", "left_semi")


def members(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Distinct member values of each group, one per row (``member_column``, ``member``)."""
    return long_form(df, columns, "member_column", "member", keep=keys).distinct()


def totals_and_members(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str], totals: Sequence[Column], columns: Sequence[str]
) -> DataFrame:
    """Per group one row of ``totals`` over ``measures`` (``member_column`` and ``member`` null) and a row for each distinct member.

    Totals and members are two aggregations at every size, so a member's row carries no sums through the shuffle. Both
    are combined before it, and no group's members ever meet in one place. Missing members are left out.
    """
    found = df.groupBy(*keys).agg(*totals)
    own = [f for f in found.schema if f.name not in keys]
    return _totals_with_members(found, members(df, keys, columns), keys, own)


def _totals_with_members(totals: DataFrame, found: DataFrame, keys: Sequence[str], own: Sequence[T.StructField]) -> DataFrame:
    """One table of both: a row of totals has no member, a member's row has no totals."""
    nothing = [F.lit(None).cast("string").alias(c) for c in ("member_column", "member")]
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in own]
    return totals.select(*keys, *nothing, *(f.name for f in own)).unionAll(found.select(*keys, "member_column", "member", *empty))


def with_text_lists(drilldown: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row a group for files: the totals, and the members of each column as sorted text.

    The one place where a group's members meet; only for tables whose cells are meant to hold them.
    """
    place = drilldown.columns.index("member_column")
    keys, totals = drilldown.columns[:place], drilldown.columns[place + 2 :]
    lists = (F.array_sort(F.collect_list(F.when(F.col("member_column") == c, F.col("member")))) for c in columns)
    return drilldown.groupBy(*keys).agg(
        *(F.max(c).alias(c) for c in totals), *(F.array_join(x, ", ").alias(c) for c, x in zip(columns, lists))
    )


def loss_orders(ol: DataFrame) -> DataFrame:
    """Orders with a negative-margin line: a row of sums and the mean margin, and a row for each category and item in it."""
    measures = ["line_quantity", "line_volume_cbm", *MONEY, "delivered_margin"]
    totals = [
        *sums("line_quantity", "line_volume_cbm", *MONEY),
        F.avg("delivered_margin").alias("avg_delivered_margin"),
    ]
    return totals_and_members(negative_margin_lines(ol), ["order_number"], measures, totals, ORDER_MEMBERS)


def loss_order_count(ol: DataFrame) -> DataFrame:
    return ol.filter(F.col("delivered_margin") < 0).agg(F.count_distinct("order_number").alias("order_count"))


def mean_margin_by(ol: DataFrame, dim: str) -> DataFrame:
    return grouped(ol, dim).agg(F.avg("delivered_margin").alias("avg_delivered_margin"))


def bottom_categories(ol: DataFrame, n: int = 5) -> DataFrame:
    """Values with the lowest mean margin in each category column."""
    table = (
        long_form(ol, CATEGORY_COLUMNS, "category_column", "category_value", keep=["delivered_margin"])
        .groupBy("category_column", "category_value")
        .agg(F.avg("delivered_margin").alias("avg_delivered_margin"))
    )
    return top_per_group(
        table, ["category_column"], [F.asc("avg_delivered_margin"), F.asc("category_value")], n
    )


def _by_category(
    ol: DataFrame, keep: Sequence[str], categories: dict[str, Sequence[str]] | None
) -> DataFrame:
    """Lines once per category column, limited to the asked values before they are multiplied."""
    if categories is None:
        return long_form(ol, CATEGORY_COLUMNS, "category_column", "category_value", keep=keep)
    asked = F.lit(False)
    for column, values in categories.items():
        asked = asked | F.col(column).isin(list(values))
    long = long_form(ol.filter(asked), list(categories), "category_column", "category_value", keep=keep)
    wanted = F.lit(False)
    for column, values in categories.items():
        wanted = wanted | (
            (F.col("category_column") == column) & F.col("category_value").isin(list(values))
        )
    return long.filter(wanted)


def _drilldown(
    ol: DataFrame, key: str, columns: Sequence[str], categories: dict[str, Sequence[str]] | None
) -> DataFrame:
    measures = ["delivered_margin", "line_volume_cbm", *MONEY]
    long = _by_category(ol.filter(F.col(key).isNotNull()), [key, *measures, *columns], categories)
    totals = [
        F.avg("delivered_margin").alias("delivered_margin"),
        F.avg("line_volume_cbm").alias("line_volume_cbm"),
        *sums(*MONEY),
    ]
    return totals_and_members(long, ["category_column", "category_value", key], measures, totals, columns)


def item_drilldown(ol: DataFrame, categories: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Per category value and item: a row of mean margin and volume and sums, and a row for each region, agreement and customer.

    ``categories`` limits the work to some values per category column; all
    values are handled in one job either way.
    """
    return _drilldown(ol, "item_number", ITEM_MEMBERS, categories)


def agreement_drilldown(ol: DataFrame, categories: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Per category value and agreement: a row of mean margin and volume and sums, and a row for each item."""
    return _drilldown(ol, "customer_agreement", AGREEMENT_MEMBERS, categories)


def category_values(ol: DataFrame, key: str = "item_number") -> DataFrame:
    """Category columns and values that a drill-down by ``key`` has."""
    return _by_category(ol.filter(F.col(key).isNotNull()), [], None).distinct()


def item_drilldown_members(ol: DataFrame, categories: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The item drill-down's members alone."""
    keys = ["category_column", "category_value", "item_number"]
    long = _by_category(ol.filter(F.col("item_number").isNotNull()), ["item_number", *ITEM_MEMBERS], categories)
    return members(long, keys, ITEM_MEMBERS)


def category_overall_margin(ol: DataFrame) -> DataFrame:
    """Mean delivered margin of each category value, as number and text."""
    return (
        long_form(ol, CATEGORY_COLUMNS, "category_column", "category_value", keep=["delivered_margin"])
        .groupBy("category_column", "category_value")
        .agg(F.avg("delivered_margin").alias("avg_delivered_margin"))
        .withColumn(
            "overall_margin", F.format_string("Overall delivered margin: %.2f%%", "avg_delivered_margin")
        )
    )


def _totals(drilldown: DataFrame) -> DataFrame:
    """The rows of totals, of a drill-down or of one read from files."""
    return drilldown.filter("member_column IS NULL") if "member_column" in drilldown.columns else drilldown


def lowest_items(drilldown: DataFrame, n: int = 10) -> DataFrame:
    """Items with the lowest margin of each category value."""
    return top_per_group(
        _totals(drilldown).select("category_column", "category_value", "item_number", "delivered_margin"),
        ["category_column", "category_value"],
        [F.asc("delivered_margin"), F.asc("item_number")],
        n,
    )


def lowest_members(drilldown: DataFrame, member: str, n: int = 10) -> DataFrame:
    """Agreements or regions with the lowest mean of item margins in each category value.

    ``drilldown`` comes from :func:`item_drilldown`, or from files, where the members are comma-separated text.
    """
    keys = ["category_column", "category_value", "item_number"]
    margins = _totals(drilldown)
    if "member_column" in drilldown.columns:
        own = drilldown.filter(F.col("member_column") == member).select(*keys, F.col("member").alias(member))
        table = own.join(margins.select(*keys, "delivered_margin"), keys)
    else:
        table = margins.select(*keys, "delivered_margin", F.explode(F.split(member, ",")).alias(member))
        table = table.withColumn(member, F.trim(member))
    table = table.groupBy("category_column", "category_value", member).agg(
        exact_mean("delivered_margin").alias("avg_delivered_margin")
    )
    return top_per_group(
        table,
        ["category_column", "category_value"],
        [F.asc("avg_delivered_margin"), F.asc(member)],
        n,
    )
