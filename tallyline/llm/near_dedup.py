"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. Documents with the same shingle set form a class; only one row of a class goes on.
2. Each class is posted under its (coordinate, value) tokens that other classes share. Two classes that agree in at
   least T of the coordinates agree in one of the ``coords - T + 1`` rarest tokens of either, so only this prefix
   is posted; the long lists of frequent tokens are skipped.
3. In each posting list every member is compared with one centre, the member whose tokens are the most shared, so
   the work is linear in the list. Links are confirmed on full sets; each comparison also yields the
   member's difference from the centre.
4. Where a centre's list still holds several components, the pairs between them are compared exactly from those
   differences, in blocks. Links that the centre misses are found here, whatever the size of the list.

T is the largest number of agreeing coordinates that a pair at the threshold reaches but for ``miss`` (1e-6).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.components import connected_components
from tallyline.llm.own_columns import packed, unpacked
from tallyline.llm.prefilter import with_possible_partner
from tallyline.llm.words import shingle_sets, slices
from tallyline.sources.scratch import written

COORDS = 64
MISS = 1e-6
BLOCK = 512
COLUMNS = 4096
HOT_SHARE = 1000

_U = np.uint64
_FACTORS = np.random.default_rng(2024).integers(1, 2**62, COORDS, dtype=np.uint64) * _U(2) + _U(1)


def match_threshold(similarity: Fraction, coords: int = COORDS, miss: float = MISS) -> int:
    """The largest T with P(fewer than T of ``coords`` agree | similarity) <= miss."""
    p, tail = float(similarity), 0.0
    for t in range(coords + 1):
        tail += comb(coords, t) * p**t * (1 - p) ** (coords - t)
        if tail > miss:
            return max(1, t)
    return coords


def signature(shingles: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Least 32-bit value of the set under each of ``coords`` multiplicative hashes; in pieces, for long texts."""
    least = np.full(coords, 0xFFFFFFFF, np.uint64)
    for start in range(0, len(shingles), 8192):
        piece = shingles[None, start : start + 8192] * _FACTORS[:coords, None]
        np.minimum(least, (piece >> _U(32)).min(axis=1), out=least)
    return least


def _set_key(shingles: np.ndarray) -> bytes:
    """128-bit key of a set: two order-free sums with different mixings."""
    twist = (shingles ^ (shingles >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return np.array([shingles.sum(dtype=_U) + _U(len(shingles)), twist.sum(dtype=_U)], _U).tobytes()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, row = TaskContext.get().partitionId() << 33, 0
    for piece in slices(batches):
        sizes, keys, values = [], [], []
        for shingles in shingle_sets(piece.column("text")):
            sizes.append(len(shingles))
            keys.append(_set_key(shingles) if len(shingles) else None)
            values.append(signature(shingles).astype(np.uint32).view(np.int32) if len(shingles) else None)
        n = piece.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(part + row, part + row + n)),
                piece.column("doc_id"),
                piece.column("text"),
                pa.array(sizes, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array(values, pa.list_(pa.int32())),
                *piece.columns[2:],
            ],
            names=["row", "doc_id", "text", "n_shingles", "set_key", "signature", *piece.schema.names[2:]],
        )
        row += n


def sketches(docs: DataFrame, keep: str | None = None) -> DataFrame:
    """One row per document: a row number, id, text, set size, set key and signature; written to the shared folder.

    The column ``keep`` is passed on.
    """
    schema = "row long, doc_id long, text string, n_shingles long, set_key binary, signature array<int>"
    if keep:
        schema += f", {keep} {docs.schema[keep].dataType.simpleString()}"
    read = docs.select(F.col("doc_id").cast("long"), "text", *([keep] if keep else []))
    return written(read.mapInArrow(_sketched, schema), "near-sketches")


def postings(classes: DataFrame, matches: int, coords: int = COORDS) -> DataFrame:
    """``token, node, shared``: each class under the rarest ``coords - matches + 1`` of its tokens, if others have them.

    ``shared`` adds up how many classes share the node's tokens. A token that no other class has is the rarest of
    all: it takes a place of the prefix and needs no list.
    """
    tokens = classes.select(F.col("row").alias("node"), F.posexplode("signature").alias("coord", "value")).select(
        "node", (F.shiftleft(F.col("coord").cast("long"), 32) + F.col("value").cast("long")).alias("token")
    )
    common = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-common")
    lists = (
        with_possible_partner(tokens, common, "token")
        .join(common.hint("merge"), "token")
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    )
    places = F.lit(coords - matches + 1) - (F.lit(coords) - F.size("tokens"))
    return lists.where(places > 0).select(
        "node",
        F.aggregate("tokens", F.lit(0).cast("long"), lambda s, t: s + t["n"]).alias("shared"),
        F.explode(F.transform(F.slice("tokens", 1, places), lambda t: t["token"])).alias("token"),
    )


def _delta_compared(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Compare each text with its centre's: linked or not, set sizes, and the shingles that only one of them has."""
    centre_key, centre_set = None, np.empty(0, _U)
    for batch in batches:
        for piece in slices(slices([batch], "text"), "centre_text"):
            linked, sizes, centre_sizes, deltas = [], [], [], []
            centres, members = piece.column("centre").to_pylist(), piece.column("text")
            for k, own in enumerate(shingle_sets(members)):
                if centres[k] != centre_key:
                    centre_key = centres[k]
                    centre_set = next(iter(shingle_sets(piece.column("centre_text").slice(k, 1))))
                delta = np.setxor1d(own, centre_set, assume_unique=True)
                both = (len(own) + len(centre_set) - len(delta)) // 2
                linked.append(den * both >= num * (len(own) + len(centre_set) - both))
                sizes.append(len(own))
                centre_sizes.append(len(centre_set))
                deltas.append(delta.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("centre"),
                    piece.column("node"),
                    pa.array(linked),
                    pa.array(sizes, pa.int64()),
                    pa.array(centre_sizes, pa.int64()),
                    pa.array(deltas, pa.binary()),
                ],
                names=["centre", "node", "linked", "n", "centre_n", "delta"],
            )


def _cross_links(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Links between different components among two blocks of one centre's members, from their differences.

    |A & B| = (|A| + |B| - |A ^ B|) / 2, and A ^ B is the symmetric difference of both deltas. Pairs that became connected
    through a link found before are passed over.
    """
    blocks = sorted(pdf["block"].unique())
    left = pdf[pdf["block"] == blocks[0]]
    right = pdf[pdf["block"] == blocks[-1]]
    left_items = [np.frombuffer(x, _U) for x in left["delta"]]
    right_items = [np.frombuffer(x, _U) for x in right["delta"]]
    common = np.intersect1d(
        np.concatenate([*left_items, np.empty(0, _U)]), np.concatenate([*right_items, np.empty(0, _U)])
    )
    both = np.zeros((len(left), len(right)), np.float32)

    def places(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(items)), [len(x) for x in items])
        flat = np.concatenate([*items, np.empty(0, _U)])
        at = np.searchsorted(common, flat)
        known = at < len(common)
        known[known] = common[at[known]] == flat[known]
        return rows[known], at[known]

    (lr, lc), (rr, rc) = places(left_items), places(right_items)
    for start in range(0, len(common), COLUMNS):
        a = np.zeros((len(left), COLUMNS), np.float32)
        b = np.zeros((len(right), COLUMNS), np.float32)
        use = (lc >= start) & (lc < start + COLUMNS)
        a[lr[use], lc[use] - start] = 1
        use = (rc >= start) & (rc < start + COLUMNS)
        b[rr[use], rc[use] - start] = 1
        both += a @ b.T
    ln, rn = left["n"].to_numpy(), right["n"].to_numpy()
    ld = np.array([len(x) for x in left_items])
    rd = np.array([len(x) for x in right_items])
    differing = ld[:, None] + rd[None, :] - 2 * both.astype(np.int64)
    inter = (ln[:, None] + rn[None, :] - differing) // 2
    lcomp, rcomp = left["component"].to_numpy(), right["component"].to_numpy()
    link = (den * inter >= num * (ln[:, None] + rn[None, :] - inter)) & (lcomp[:, None] != rcomp[None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    found = []
    lnode, rnode = left["node"].to_numpy(), right["node"].to_numpy()
    for i, j in zip(*np.nonzero(link)):
        x, y = find(int(lcomp[i])), find(int(rcomp[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            found.append((int(lnode[i]), int(rnode[j])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def similar_classes(rows: DataFrame, similarity: Fraction) -> tuple[DataFrame, DataFrame]:
    """The classes of equal sets (``set_key, row, least_id, n_rows``) and ``node, component`` of those with links.

    ``rows`` is the table of :func:`sketches`; a node is the row that stands for its class.
    """
    num, den = similarity.numerator, similarity.denominator
    classes = written(
        rows.where("set_key IS NOT NULL")
        .groupBy("set_key")
        .agg(
            F.min("row").alias("row"),
            F.min("doc_id").alias("least_id"),
            F.count(F.lit(1)).alias("n_rows"),
            F.first("signature").alias("signature"),
        ),
        "near-classes",
    )
    posted = written(postings(classes.select("row", "signature"), match_threshold(similarity)), "near-postings")
    centres = posted.groupBy("token").agg(
        F.max_by("node", F.struct("shared", -F.col("node"))).alias("centre"), F.count(F.lit(1)).alias("n")
    )
    stars = posted.join(centres.where("n > 1"), "token").where("node <> centre").select("centre", "node").distinct()
    stars = written(stars, "near-stars")
    needed = stars.select(F.col("node").alias("row")).union(stars.select(F.col("centre").alias("row"))).distinct()
    # The texts outweigh all else here, so they are sorted to the pairs at every size, not broadcast.
    texts = written(with_possible_partner(rows.select("row", "text"), needed, "row"), "near-texts")
    compared = written(
        stars.join(texts.select(F.col("row").alias("node"), "text").hint("merge"), "node")
        .join(texts.select(F.col("row").alias("centre"), F.col("text").alias("centre_text")).hint("merge"), "centre")
        .select("centre", "node", "text", "centre_text")
        .mapInArrow(
            lambda batches: _delta_compared(batches, num, den),
            "centre long, node long, linked boolean, n long, centre_n long, delta binary",
        ),
        "near-compared",
    )
    links = compared.where("linked").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    first = written(connected_components(links), "near-first")
    members = (
        compared.select("centre", "node", "n", "centre_n", "delta")
        .join(first, "node", "left")
        .select("centre", "node", "n", "delta", F.coalesce("component", "node").alias("component"))
    )
    open_lists = (
        members.groupBy("centre")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size"))
        .where("x <> y")
        .select("centre", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    dealt = members.join(open_lists, "centre").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    )
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    crossed = dealt.groupBy("centre", "low", "high").applyInPandas(
        lambda pdf: _cross_links(pdf, num, den), "a long, b long"
    )
    all_links = written(links.union(crossed), "near-links")
    return classes, connected_components(all_links)


def near_duplicates(docs: DataFrame, similarity: Fraction = Fraction(85, 100)) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document; ``row`` numbers the rows, ``text`` is passed on.

    Documents are linked when the Jaccard similarity of their five-word shingle sets is at least ``similarity``.
    ``component_id`` is the least doc_id reachable. A null or empty text, or one without words, has an empty set
    and is linked with nothing. Rows that repeat a document are members of one class and share its component; a null
    doc_id never names a component unless the component has no other. An empty table gives an empty result. Further
    columns of ``docs`` are ignored.
    """
    rows = sketches(docs)
    classes, linked = similar_classes(rows, similarity)
    named = classes.join(linked.withColumnRenamed("node", "row"), "row", "left").select(
        "set_key", "n_rows", "least_id", F.coalesce("component", "row").alias("component")
    )
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.sum("n_rows").alias("size"))
    # Only classes that share their component with another row need a join; the hot ones, at most HOT_SHARE by
    # their size, are broadcast.
    shared = written(
        named.join(least.where("size > 1"), "component").select("set_key", "n_rows", "component_id"), "near-shared"
    )
    limit = rows.count() // HOT_SHARE + 1
    plain = rows.select("row", "doc_id", "text", "n_shingles", "set_key")
    hot, cold = shared.where(F.col("n_rows") > limit), shared.where(F.col("n_rows") <= limit)
    hot = F.broadcast(hot.select("set_key", "component_id"))
    joined = plain.join(hot, "set_key").union(
        plain.join(hot, "set_key", "left_anti")
        .join(cold.select("set_key", "component_id"), "set_key", "left")
        .select("set_key", "row", "doc_id", "text", "n_shingles", F.coalesce("component_id", "doc_id"))
    )
    return joined.select(
        "row",
        "doc_id",
        "text",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def one_of_each(docs: DataFrame, similarity: Fraction = Fraction(85, 100)) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near duplicates: of each component the row with the least
    (doc_id, row number) stays, and every document with an empty set."""
    rows = sketches(packed(docs), keep="own")
    classes, linked = similar_classes(rows, similarity)
    named = classes.join(linked.withColumnRenamed("node", "row"), "row", "left").select(
        "set_key", F.coalesce("component", "row").alias("component"), F.struct("least_id", "row").alias("first")
    )
    # One row of a class is known by its number; the component keeps its class with the least id.
    kept = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    stays = with_possible_partner(rows, kept, "row").join(kept, "row", "left_semi")
    whole = stays.unionByName(rows.where("set_key IS NULL"))
    return whole.select(*unpacked(docs.columns))
