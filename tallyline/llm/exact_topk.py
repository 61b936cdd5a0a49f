"""Exact top-k inner products by columnar branch-and-bound.

Vectors become integers and are packed into blocks in vertical layout: one row of a block holds one dimension of all its
vectors. Query blocks meet a candidate block in one task, where scores grow dimension block by dimension block. What
the remaining dimensions can still add is bounded by the product of both remaining norms; candidates whose upper
bound is below a query's k-th best lower bound are dropped, and the survivors are compacted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.sources.scratch import written

CANDIDATES = 8192
QUERIES = 256
QUERY_BLOCKS = 16
MOST_TASKS = 2000
DIMENSIONS = 8
DENSE_SHARE = 0.25
EXACT_DOUBLE = float(2**53)
FOUND = pa.schema([(n, pa.int64()) for n in ("query_row", "query_id", "vec_id", "score")])


def _integer_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """``row, vec_id, v``: vectors that take part, as whole numbers floor(scale * component)."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
    )


def _narrowest(least: int | None, most: int | None) -> np.dtype:
    """The integers that hold all components."""
    kinds = (np.dtype(k) for k in (np.int16, np.int32, np.int64))
    return next(k for k in kinds if np.iinfo(k).min <= (least or 0) and (most or 0) <= np.iinfo(k).max)


def _packed(table: pa.Table, width: int, kind: np.dtype) -> pa.Table:
    """One block: ids and a (dimension x row) matrix; short vectors end in zeros."""
    lists = table.column("v").combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    matrix = np.zeros((len(lists), width), kind)
    matrix[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
    return pa.table(
        {
            "part": table.column("part")[:1],
            "ids": [table.column("vec_id").to_numpy().tobytes()],
            "own": [table.column("row").to_numpy().tobytes()],
            "matrix": [np.ascontiguousarray(matrix.T).tobytes()],
        }
    )


def _blocks(rows: DataFrame, parts: int, width: int, kind: np.dtype) -> DataFrame:
    """``part, ids, own, matrix``: the rows in ``parts`` blocks of about equal size."""
    part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    return (
        rows.withColumn("part", part)
        .groupBy("part")
        .applyInArrow(lambda table: _packed(table, width, kind), "part int, ids binary, own binary, matrix binary")
    )


def block_topk(
    queries: np.ndarray, q_rows: np.ndarray, candidates: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of one block for each query of another: positions of query and candidate, scores.

    ``queries`` and ``candidates`` are (dimension x row); equal row numbers are the same row and no pair. Scores are exact:
    sums below 2^53 are added as doubles, larger ones as 64-bit integers.
    """
    width = len(queries)
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, width)
    kind = np.float64 if largest < EXACT_DOUBLE else np.int64
    q, c = queries.astype(kind), candidates.astype(kind)
    # Heavy dimensions first, so that the remaining mass falls fast.
    order = np.argsort(-np.square(c.astype(np.float64)).sum(axis=1), kind="stable")
    q, c = q[order], c[order]

    def remaining(m: np.ndarray) -> np.ndarray:
        mass = np.cumsum(np.square(m.astype(np.float64))[::-1], axis=0)[::-1]
        return np.sqrt(np.vstack((mass, np.zeros((1, m.shape[1]))))) * (1 + 1e-9)

    q_left, c_left = remaining(q), remaining(c)
    same = q_rows[:, None] == c_rows[None, :]
    partial = np.zeros(same.shape, kind)
    pairs_q = pairs_c = scores = None
    for start in range(0, width, DIMENSIONS):
        stop = min(start + DIMENSIONS, width)
        if pairs_q is None:
            partial += q[start:stop].T @ c[start:stop]
            slack = q_left[stop][:, None] * c_left[stop][None, :]
            lower = np.where(same, -np.inf, partial - slack)
            best = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] > k else np.full(len(lower), -np.inf)
            alive = (partial + slack >= best[:, None] - 1e-6) & ~same
            if alive.mean() <= DENSE_SHARE and stop < width:
                pairs_q, pairs_c = np.nonzero(alive)
                scores = partial[pairs_q, pairs_c]
        else:
            for d in range(start, stop):
                scores = scores + q[d, pairs_q] * c[d, pairs_c]
            slack = q_left[stop][pairs_q] * c_left[stop][pairs_c]
            best = _kth_of_groups(pairs_q, scores - slack, k, len(q_rows))
            keep = scores + slack >= best[pairs_q] - 1e-6
            pairs_q, pairs_c, scores = pairs_q[keep], pairs_c[keep], scores[keep]
    if pairs_q is None:
        pairs_q, pairs_c = np.nonzero(alive if width else ~same)
        scores = partial[pairs_q, pairs_c]
    by = np.lexsort((c_ids[pairs_c], -scores, pairs_q))
    pairs_q, pairs_c, scores = pairs_q[by], pairs_c[by], scores[by]
    first = np.searchsorted(pairs_q, pairs_q, "left")
    top = np.arange(len(pairs_q)) - first < k
    return pairs_q[top], pairs_c[top], scores[top].astype(np.int64)


def _kth_of_groups(groups: np.ndarray, values: np.ndarray, k: int, n: int) -> np.ndarray:
    """Per group its k-th largest value, or minus infinity where it has fewer; ``groups`` is sorted."""
    by = np.lexsort((-values, groups))
    starts = np.searchsorted(groups[by], np.arange(n))
    sizes = np.bincount(groups, minlength=n)
    found = np.full(n, -np.inf)
    enough = sizes >= k
    found[enough] = values[by][starts[enough] + k - 1]
    return found


def exact_topk(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose vec_id is divisible by ``every`` its ``k`` best others.

    The score is the integer inner product of floor(scale * component); ties go to the smaller vec_id. Rows with a null
    vec_id, a null vector, or null or non-finite components take no part; of vectors of unequal length the shorter
    counts as ending in zeros (an empty one scores 0). Rows that repeat a vec_id are candidates each, and each a
    query of its own; only a query's own row is no candidate. An empty table gives an empty result. Further columns are ignored.

    Every cell of a candidate block and up to ``QUERY_BLOCKS`` query blocks is one group, so memory is bounded by these
    blocks. Cells are always shuffled: their blocks are many times the tables they come from, so no broadcast may be
    chosen by those tables' sizes.
    """
    rows = written(
        _integer_rows(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "topk-integers"
    )
    sizes = rows.agg(
        F.max(F.size("v")), F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0), F.min(F.array_min("v")), F.max(F.array_max("v"))
    ).first()
    width, parts, query_parts, kind = sizes[0] or 0, sizes[1] // CANDIDATES + 1, sizes[2] // QUERIES + 1, _narrowest(*sizes[3:])
    candidates = written(_blocks(rows, parts, width, kind), "topk-candidates")
    queries = written(_blocks(rows.where(F.col("vec_id") % every == 0), query_parts, width, kind), "topk-queries")

    def matrix(block: dict) -> np.ndarray:
        return np.frombuffer(block["matrix"], kind).reshape(width, len(block["ids"]) // 8).astype(np.int64)

    def search(query_blocks: pa.Table, candidate_blocks: pa.Table) -> pa.Table:
        found = [FOUND.empty_table()]
        for y in candidate_blocks.to_pylist():
            c, ids, own = matrix(y), *(np.frombuffer(y[n], np.int64) for n in ("ids", "own"))
            for x in query_blocks.to_pylist():
                q_ids, q_own = (np.frombuffer(x[n], np.int64) for n in ("ids", "own"))
                at, place, scores = block_topk(matrix(x), q_own, c, own, ids, k)
                found.append(pa.table([q_own[at], q_ids[at], ids[place], scores], schema=FOUND))
        return pa.concat_tables(found)

    groups = -(-query_parts // QUERY_BLOCKS)
    tasks = min(parts * groups, MOST_TASKS)
    sent = queries.withColumn("queries", (F.col("part") % groups).cast("int"))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = candidates.withColumn("queries", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    by_cell = (t.repartition(tasks, "part", "queries").groupBy("part", "queries") for t in (sent, met))
    found = next(by_cell).cogroup(next(by_cell)).applyInArrow(search, "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
