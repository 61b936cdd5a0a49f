"""Readers that yield the flat ``order_lines`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.columns import finite
from tallyline.schema import LINE_KEY, MEASURES, ORDER_LINES, require_columns


def normalise(df: DataFrame) -> DataFrame:
    """Check names, cast to the fixed schema, parse dates, drop NaN/inf values."""
    require_columns(df, ORDER_LINES.names)
    return df.select(
        *(
            F.to_date("order_date").alias("order_date")
            if f.name == "order_date"
            else finite(F.col(f.name).cast("double")).alias(f.name)
            if f.name in MEASURES
            else F.col(f.name).cast("string").alias(f.name)
            for f in ORDER_LINES
        )
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Order lines from CSV with a header; columns may come in any order.

    The header fixes the column order, the types come from the schema, so no
    inference pass over the data is needed.
    """
    return normalise(spark.read.option("header", True).csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalise(spark.read.parquet(path))


def star_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as an inner star join over the test tables (see FIXTURES.md).

    No join hints: file sizes and AQE's measured sizes decide what is
    broadcast, and AQE splits hot join keys. Parts come last, so their texts
    are not shuffled with the lines to the orders.
    """
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax",
    )
    orders = table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customers = table("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nations = table("nation").select("n_nationkey", "n_name")
    parts = table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")

    joined = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(nations, customers.c_nationkey == nations.n_nationkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
    )
    volume = F.col("p_size") * F.col("l_quantity") * F.lit(0.001)
    price = F.col("l_extendedprice")
    return joined.select(
        F.concat_ws(
            "|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            price.cast("decimal(18,2)").cast("string"),
        ).alias(LINE_KEY),
        F.col("l_orderkey").cast("string").alias("order_number"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("c_name").alias("customer_name"),
        F.concat(F.col("c_mktsegment"), F.lit("-"), F.col("n_name")).alias("customer_agreement"),
        F.col("o_orderpriority").alias("order_channel"),
        F.col("n_name").alias("order_region"),
        F.col("p_type").alias("category_1"),
        F.col("p_brand").alias("category_2"),
        F.col("p_name").alias("category_3"),
        F.col("l_partkey").cast("string").alias("item_number"),
        F.col("l_quantity").alias("line_quantity"),
        volume.alias("line_volume_cbm"),
        (price * (F.lit(1.0) - F.col("l_discount"))).alias("line_product_revenue"),
        (F.lit(0.6) * F.col("p_retailprice") * F.col("l_quantity")).alias("line_product_cost"),
        (F.col("l_tax") * price).alias("line_freight_revenue"),
        (F.lit(50.0) + F.lit(2500.0) * volume + F.lit(0.005) * price).alias("line_freight_cost"),
    )
