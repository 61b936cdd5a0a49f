"""A filter of bounded size before a join: drops most rows that surely have no partner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 18


def _marked(rows: DataFrame, keys: DataFrame, column: str, words: int) -> DataFrame:
    """``rows`` with ``_possible``: false for those that surely are not among the keys."""
    hashed = F.xxhash64(column)
    word = F.pmod(hashed, F.lit(words)).cast("int")
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(_hash, 40), 64) as int))")
    masks = (
        keys.where(F.col(column).isNotNull())
        .select(hashed.alias("_hash"), word.alias("_word"))
        .select("_word", bit.alias("_bit"))
        .groupBy("_word")
        .agg(F.bit_or("_bit").alias("_mask"))
    )
    possible = F.coalesce(F.col("_mask").bitwiseAND(F.col("_bit")) != 0, F.lit(False)) & F.col(column).isNotNull()
    return (
        rows.withColumn("_hash", hashed)
        .withColumn("_word", word)
        .withColumn("_bit", bit)
        .join(F.broadcast(masks), "_word", "left")
        .withColumn("_possible", possible)
        .drop("_hash", "_word", "_bit", "_mask")
    )


def with_possible_partner(rows: DataFrame, keys: DataFrame, column: str, words: int = WORDS) -> DataFrame:
    """The rows whose ``column`` may be among ``keys[column]``: all that are, and few others.

    The keys' hashes set bits of a table of ``words`` 64-bit words, so at most ``words`` rows (4 MB) are broadcast whatever
    the number of keys. With very many keys the filter only gets less sharp. Null keys have no partner.
    """
    return _marked(rows, keys, column, words).where("_possible").drop("_possible")


def surely_without_partner(rows: DataFrame, keys: DataFrame, column: str, words: int = WORDS) -> DataFrame:
    """The rest of the rows: together with :func:`with_possible_partner` every row once."""
    return _marked(rows, keys, column, words).where("NOT _possible").drop("_possible")
