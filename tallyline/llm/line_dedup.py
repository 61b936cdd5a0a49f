"""Lines that many sites share: one HyperLogLog sketch of sites per line hash, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.prefilter import surely_without_partner, with_possible_partner
from tallyline.sources.scratch import written

MIN_SITES = 5
REGISTERS_LOG2 = 8
BAND_ERRORS = 4


def _lines(docs: DataFrame) -> DataFrame:
    """``text_key, site, place, line, check`` of every line that is not blank; line and check are two hashes of it."""
    lines = docs.select("text_key", "site", F.posexplode(F.split("text", "\n")).alias("place", "content"))
    trimmed = F.trim("content")
    return lines.where(trimmed != "").select(
        "text_key", "site", "place", F.xxhash64(trimmed).alias("line"), F.hash(trimmed).alias("check")
    )


def shared_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``line, check`` of the lines on at least ``min_sites`` distinct sites (null is no site).

    Each task sketches the lines it reads; sketches of one line merge by aggregation. Where the estimate is within
    four standard errors (and one site at least) of the threshold, the sites are counted exactly.
    """
    sketched = written(
        lines.groupBy("line", "check")
        .agg(F.hll_sketch_agg("site", F.lit(REGISTERS_LOG2)).alias("sites"))
        .select("line", "check", F.hll_sketch_estimate("sites").alias("sites"))
        .where(F.col("sites") > (1 if min_sites > 1 else 0)),
        "line-sites",
    )
    band = max(1.0, BAND_ERRORS * 1.04 / 2 ** (REGISTERS_LOG2 / 2) * min_sites)
    near = sketched.where(F.abs(F.col("sites") - min_sites) <= band).select("line", "check")
    exact = (
        with_possible_partner(lines, near, "line")
        .join(near, ["line", "check"])
        .select("line", "check", "site")
        .distinct()
        .groupBy("line", "check")
        .agg(F.count("site").alias("n"))
        .where(F.col("n") >= min_sites)
    )
    return sketched.where(F.col("sites") - min_sites > band).select("line", "check").union(exact.select("line", "check"))


def without_shared_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``doc_id, n_lines, n_removed, clean_text``: the text without the lines that ``min_sites`` sites share.

    Lines are cut at line feeds and compared without outer spaces; blank lines stay. A null text stays null, with 0
    lines; an empty one has one line. Rows that repeat are kept each; a null site counts as none; an empty table gives an empty
    result. Further columns are ignored.
    """
    keyed = docs.select("doc_id", F.col(site).alias("site"), "text", F.xxhash64("text").alias("text_key"))
    lines = _lines(keyed)
    shared = written(shared_lines(lines, min_sites), "line-shared")
    # What goes from a text depends on the text alone, so copies share one list of places.
    gone = written(
        with_possible_partner(lines, shared, "line")
        .join(shared, ["line", "check"])
        .groupBy("text_key")
        .agg(F.collect_set("place").alias("gone")),
        "line-places",
    )
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda _, i: ~F.array_contains("gone", i))
    # One way to join the texts at every size; a hot text is split by the join itself.
    touched = (
        with_possible_partner(keyed, gone, "text_key")
        .join(gone.hint("merge"), "text_key", "left")
        .withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
        .select(
            "doc_id",
            F.size(parts).alias("n_lines"),
            F.size("gone").alias("n_removed"),
            F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"),
        )
    )
    untouched = surely_without_partner(keyed, gone, "text_key").select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
        F.lit(0).alias("n_removed"),
        F.col("text").alias("clean_text"),
    )
    return touched.union(untouched)
