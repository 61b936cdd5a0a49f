"""Benchmark items inside documents: size-partitioned MinHash containment search with exact verification.

DataFrame functions only. An item with q distinct five-word shingles is inside a document that has at least
``containment * q`` of them, so at most ``q - ceil(containment * q)`` are missing: of any one more, one is there. Items are
partitioned by size (powers of two); in a partition every item is searched by its bottom-m MinHash sketch, the m least
hash values, with m from the partition's upper size, so no containing document is missed. A document is
only probed by the partitions whose least item fits into its own size. What a sketch finds is verified on full sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.own_columns import packed, unpacked
from tallyline.llm.prefilter import surely_without_partner, with_possible_partner
from tallyline.sources.scratch import written

SHINGLE = 5
PERCENT = 80


def with_shingles(texts: DataFrame) -> DataFrame:
    """Adds ``shingles``: distinct 64-bit hashes of five-word shingles; words are runs of letters and digits, lower-cased.

    With fewer words all of them are one shingle; a null text, or one without words, has none. Explode them with
    ``explode_outer``: the filter that ``explode`` implies would be pushed to the scan and work them out twice.
    """
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def sets(h: Column) -> Column:
        rolled = F.transform(
            F.sequence(F.lit(0), F.size(h) - SHINGLE),
            lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SHINGLE))),
        )
        short = F.array(F.xxhash64(F.size(h), *(F.get(h, F.lit(k)) for k in range(SHINGLE))))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) >= SHINGLE, F.array_distinct(rolled)).when(F.size(h) > 0, short).otherwise(none)

    # Bound by a lambda, the words are worked out once a text, wherever the optimizer moves the expression.
    return texts.withColumn("shingles", F.get(F.transform(F.array(hashes), sets), F.lit(0)))


def _needed(size: Column, percent: int) -> Column:
    """The least number of shared shingles for containment: ceil(percent * size / 100)."""
    return F.floor((size * percent + 99) / 100).cast("int")


def _partition(size: Column) -> Column:
    return F.floor(F.log2(size.cast("double"))).cast("int")


def sketched_items(items: DataFrame, percent: int) -> DataFrame:
    """``item_id, item_key, n_item, needed, part, shingles, sketch`` of the items that have words."""
    found = written(with_shingles(items.select("item_id", "text").distinct()), "contained-shingles")
    found = found.withColumn("n_item", F.size("shingles")).where("n_item > 0")
    found = found.withColumn("part", _partition(F.col("n_item"))).withColumn("needed", _needed(F.col("n_item"), percent))
    upper = F.pow(F.lit(2.0), F.col("part") + 1).cast("int") - 1
    length = upper - _needed(upper, percent) + 1
    return found.select(
        "item_id",
        F.xxhash64("item_id", "text").alias("item_key"),
        "n_item",
        "needed",
        "part",
        "shingles",
        F.slice(F.array_sort("shingles"), F.lit(1), length).alias("sketch"),
    )


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_key, item_id, n_item, n_shared, containment``: every item with at least ``percent`` % of its shingles
    in a document's text.

    ``text_key`` is a hash of the text, which tells rows of one doc_id apart. Repeated rows of either table give one
    result; of several texts of one item_id the best contained counts. Null ids are kept as they are; null and empty texts, and
    items without words, match nothing; empty tables give an empty result. Further columns are ignored.
    """
    probes = written(sketched_items(items, percent), "contained-items")
    keyed = docs.select(F.col("doc_id").cast("long"), "text").withColumn("text_key", F.xxhash64("text"))
    posts = probes.select("item_key", "part", "needed", F.explode_outer("sketch").alias("shingle"))
    probed = (
        with_shingles(keyed)
        .withColumn("doc_part", F.coalesce(_partition(F.size("shingles")), F.lit(-1)))
        .select("text_key", "doc_part", F.explode_outer("shingles").alias("shingle"))
    )
    least_part = _partition(F.col("needed"))
    candidates = written(
        with_possible_partner(probed, posts, "shingle")
        .join(posts, "shingle")
        .where(F.col("doc_part") >= least_part)
        .select("text_key", "item_key")
        .distinct(),
        "contained-candidates",
    )
    full = with_shingles(with_possible_partner(keyed, candidates, "text_key").dropDuplicates(["doc_id", "text_key"]))
    # One text of a key is enough; which doc_ids have it is joined in at the end.
    own = full.select("text_key", F.explode_outer("shingles").alias("shingle")).distinct()
    asked = candidates.join(probes.select("item_key", F.explode_outer("shingles").alias("shingle")), "item_key")
    shared = asked.join(own, ["text_key", "shingle"]).groupBy("text_key", "item_key").agg(
        F.count(F.lit(1)).cast("int").alias("n_shared")
    )
    verified = shared.join(probes.select("item_key", "item_id", "n_item", "needed"), "item_key").where(
        "n_shared >= needed"
    )
    holders = with_possible_partner(keyed.select("doc_id", "text_key"), candidates, "text_key").distinct()
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item"))
    return (
        holders.join(verified, "text_key")
        .groupBy("doc_id", "text_key", "item_id")
        .agg(best.alias("best"))
        .select("doc_id", "text_key", "item_id", "best.n_item", "best.n_shared", "best.containment")
    )


def without_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text contains no item."""
    bad = written(contained_items(docs, items, percent).select("text_key").distinct(), "contained-texts")
    keyed = packed(docs).withColumn("text_key", F.xxhash64("text"))
    clean = surely_without_partner(keyed, bad, "text_key").union(
        with_possible_partner(keyed, bad, "text_key").join(bad, "text_key", "left_anti").select(keyed.columns)
    )
    return clean.select(*unpacked(docs.columns))
