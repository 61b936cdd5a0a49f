"""Merkle trees over a table by slot pivots: digests of rows, of groups and of the whole, with a proof for every row.

A level is one aggregation: conditional aggregates spread the children of each parent into ``FANOUT`` columns. All
columns side by side make the parent's digest; all but the own one are a node's siblings. Levels are written to the
shared folder, so each is computed once; the proofs are put together from the top down, a join a level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.sources.scratch import written

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SLOTS = [f"child{k}" for k in range(FANOUT)]
NO_STEPS = "CAST(array() AS array<struct<before: string, after: string>>)"


def digest(parts: list[Column]) -> Column:
    """Lower-case hex SHA-256 of texts one after another; absent ones (null) add nothing."""
    return F.sha2(F.concat_ws("", *parts), 256)


def row_digest(values: list[Column]) -> Column:
    """Digest of a row: each value as ``-`` if null, else its UTF-8 byte count, ``:`` and the value itself."""
    texts = [v.cast("string") for v in values]
    return digest(
        [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, by ``order`` within ``tree``) and ``size`` (rows of the tree), written.

    The rows are dealt by ranges of (tree, order), so one tree may fill many tasks; a row's place is its place in its
    task's part plus the sizes of the tree's parts before. Rows alike in all of ``order`` are told apart by their
    place in the input, which keeps them from meeting in one task. ``rows`` should be a written table: it is read
    twice.
    """
    keys = ["tree", *order, "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = written(dealt.drop("tie").withColumn("at", F.monotonically_increasing_id()), "merkle-dealt")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    parts = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("begin"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    parts = parts.select("tree", "part", (F.col("begin") - before).alias("shift"), F.sum("n").over(tree).alias("size"))
    found = dealt.join(parts, ["tree", "part"]).withColumn("place", F.col("at") - F.col("shift"))
    return written(found.drop("at", "part", "shift"), "merkle-placed")


def _parent(place: str) -> Column:
    return F.floor(F.col(place) / FANOUT).cast("long")


def _levels(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Per level ``tree, place`` of each parent with its children's digests and the level's size; then ``tree, digest``."""
    nodes = leaves.select("tree", "place", "size", "digest")
    left = leaves.agg(F.max("size")).first()[0] or 0
    levels = []
    while left > 1:
        slot = F.col("place") % FANOUT
        children = [F.max(F.when(slot == k, F.col("digest"))).alias(c) for k, c in enumerate(SLOTS)]
        pivot = nodes.groupBy("tree", _parent("place").alias("parent")).agg(F.max("size").alias("size"), *children)
        level = written(pivot.withColumnRenamed("parent", "place"), "merkle-level")
        levels.append(level)
        # A tree whose one node is left waits for the larger ones.
        joined = F.when(F.col("size") > 1, digest([F.col(c) for c in SLOTS])).otherwise(F.col(SLOTS[0]))
        size = F.ceil(F.col("size") / FANOUT).cast("long")
        nodes = level.select("tree", "place", size.alias("size"), joined.alias("digest"))
        left = -(-left // FANOUT)
    return levels, nodes.select("tree", "digest")


def _stepped(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``children`` with ``steps``: the siblings before and after the node on each level, its own level first."""
    parents = parents.select("tree", F.col("place").alias("_parent"), F.col("size").alias("_size"), "steps",
                             *(F.col(c).alias(f"_{c}") for c in SLOTS))
    joined = children.withColumn("_parent", _parent("place")).join(parents, ["tree", "_parent"])
    slot = F.col("place") % FANOUT

    def side(there) -> Column:
        return F.concat_ws("", *(F.when(there(slot, k), F.col(f"_{c}")) for k, c in enumerate(SLOTS)))

    own = F.struct(side(lambda s, k: s > k).alias("before"), side(lambda s, k: s < k).alias("after"))
    steps = F.when(F.col("_size") > 1, F.concat(F.array(own), F.col("steps"))).otherwise(F.col("steps"))
    return joined.select(*children.columns, steps.alias("steps"))


def with_proofs(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves(tree, place, size, digest, ...)`` with ``steps`` to the top of their tree, and ``tree, digest`` of the tops."""
    levels, tops = _levels(leaves)
    if not levels:
        return leaves.withColumn("steps", F.expr(NO_STEPS)), tops
    above = reduce(lambda upper, level: _stepped(level, upper), levels[-2::-1], levels[-1].withColumn("steps", F.expr(NO_STEPS)))
    return _stepped(leaves, above), tops


def folded(leaf: Column, steps: Column) -> Column:
    """The top that a leaf gives with its siblings, level by level."""
    return F.aggregate(steps, leaf, lambda h, s: digest([s["before"], h, s["after"]]))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def merkle_manifest(docs: DataFrame, received: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, steps, folded_root, verified`` for every row of ``docs``.

    A leaf is the digest of ``FIELDS``. A source's leaves in ascending order of doc_id form a tree of fanout 3 with the top
    ``subroot``; the subroots in order of source (null first, then bytewise) form the tree with the top ``root``.
    ``received`` is the text as someone else holds it (by default the same): ``folded_root`` follows from the leaf of
    the row with that text and the original siblings, ``verified`` says whether it is the root.

    Nulls have a digest of their own in every field; a null source is one source; null doc_ids come first; rows with one doc_id
    are ordered by leaf, and rows alike get a place each. Texts of any length are hashed whole. A single row is its
    own subroot and root, with an empty proof. An empty table gives an empty result. Further columns are left out.
    """
    received = F.col("text") if received is None else received
    leaf = row_digest([F.col(c) for c in FIELDS])
    other = row_digest([received if c == "text" else F.col(c) for c in FIELDS])
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    rows = docs.select("doc_id", tree.alias("tree"), leaf.alias("digest"), other.alias("other"))
    leaves, subroots = with_proofs(placed(written(rows, "merkle-leaves"), ["doc_id", "digest"]))
    sources = written(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), "merkle-subroots")
    sources, roots = with_proofs(placed(sources, ["source"]))
    sources = sources.join(roots.select("tree", F.col("digest").alias("root")), "tree").select(
        F.col("source").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("steps").alias("upper")
    )
    steps = F.concat("steps", "upper")
    found = leaves.join(sources, "tree").withColumn("steps", steps)
    found = found.withColumn("folded_root", folded(F.col("other"), F.col("steps")))
    verified = F.col("folded_root") == F.col("root")
    return found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "steps", "folded_root", verified.alias("verified")
    )
