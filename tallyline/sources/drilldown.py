"""Drill-down results as CSV, partitioned by category column and value."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.operators.drilldown import AGREEMENT_MEMBERS, ITEM_MEMBERS, with_text_lists
from tallyline.operators.products import MONEY

PARTITIONS = ("category_column", "category_value")


def _schema(key: str, members: tuple[str, ...]) -> T.StructType:
    doubles = ("delivered_margin", "line_volume_cbm", *MONEY)
    return T.StructType(
        [T.StructField(key, T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in doubles]
        + [T.StructField(c, T.StringType()) for c in members]
        + [T.StructField(c, T.StringType()) for c in PARTITIONS]
    )


ITEM_SCHEMA = _schema("item_number", ITEM_MEMBERS)
AGREEMENT_SCHEMA = _schema("customer_agreement", AGREEMENT_MEMBERS)


def write_drilldown(drilldown: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """One folder per category column and value; the members of a group become comma-separated text.

    The rebalance hint gathers small categories into one file each and splits
    large ones over several tasks. With ``mode="append"`` the files join those of other items.
    """
    members = ITEM_MEMBERS if "item_number" in drilldown.columns else AGREEMENT_MEMBERS
    (
        with_text_lists(drilldown, members)
        .hint("rebalance", *PARTITIONS)
        .write.mode(mode)
        .partitionBy(*PARTITIONS)
        .option("header", True)
        .option("compression", compression)
        .csv(path)
    )


# What a partition folder's name holds as %XX besides control characters, and the name that stands for none.
ESCAPED = "\"#%'*/:=?\\{[]^\x7f"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def partition_folder(column: str, value: str) -> str:
    """Name of the folder that Spark writes a partition value to."""
    shown = "".join(f"%{ord(c):02X}" if c in ESCAPED or ord(c) < 32 else c for c in value)
    return f"{column}={shown or NO_VALUE}"


def read_drilldown(
    spark: SparkSession,
    path: str,
    category_column: str | None = None,
    category_value: str | None = None,
    schema: T.StructType = ITEM_SCHEMA,
) -> DataFrame:
    """Read back a drill-down; only the folder of the asked category is listed and read.

    A category without results, or a folder that does not exist, gives an empty table.
    """
    asked = [(c, v) for c, v in zip(PARTITIONS, (category_column, category_value)) if v is not None]
    folder = path
    if category_column is not None:
        folder = "/".join([path, *(partition_folder(c, v) for c, v in asked)])
    try:
        df = spark.read.schema(schema).option("header", True).option("basePath", path).csv(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    for column, value in asked:
        df = df.filter(F.col(column) == value)
    return df


def drilldown_catalog(drilldown: DataFrame) -> DataFrame:
    """Category columns and their values, sorted."""
    return drilldown.select(*PARTITIONS).distinct().orderBy(*PARTITIONS)


def write_overall_margin(overall: DataFrame, path: str) -> None:
    """The overall margin text of each category value, in the same folder layout."""
    (
        overall.select(*PARTITIONS, "overall_margin")
        .hint("rebalance", *PARTITIONS)
        .write.mode("overwrite")
        .partitionBy(*PARTITIONS)
        .text(path)
    )
