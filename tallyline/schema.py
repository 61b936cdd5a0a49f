"""The one input table: flat e-commerce order lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE_KEY = "unique_identifier_for_this_line"

DIMENSIONS = (
    "category_1",
    "category_2",
    "category_3",
    "order_channel",
    "order_region",
    "item_number",
    "customer_name",
    "customer_agreement",
)
CATEGORY_COLUMNS = ("category_1", "category_2", "category_3")
MEASURES = (
    "line_quantity",
    "line_volume_cbm",
    "line_product_revenue",
    "line_product_cost",
    "line_freight_revenue",
    "line_freight_cost",
)

ORDER_LINES = T.StructType(
    [
        T.StructField(LINE_KEY, T.StringType()),
        T.StructField("order_number", T.StringType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("customer_name", T.StringType()),
        T.StructField("customer_agreement", T.StringType()),
        T.StructField("order_channel", T.StringType()),
        T.StructField("order_region", T.StringType()),
        T.StructField("category_1", T.StringType()),
        T.StructField("category_2", T.StringType()),
        T.StructField("category_3", T.StringType()),
        T.StructField("item_number", T.StringType()),
        *(T.StructField(name, T.DoubleType()) for name in MEASURES),
    ]
)


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Fail early, naming every column that is missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def fill_missing_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Add absent model inputs as 0.0, leaving present columns untouched."""
    absent = [name for name in names if name not in df.columns]
    return df.withColumns({name: F.lit(0.0) for name in absent}) if absent else df
