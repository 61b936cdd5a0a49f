"""Alignment of two tokenizers' tokens over whole texts, with corpus-wide counts of the aligned pairs.

Where a token of A and one of B end at the same byte, the text is cut; the two tokens are linked. Most groups between cuts are
one token each with the same bytes: an array from A's ids to B's tells them, and they are counted in vectors of A's
vocabulary length. Only the pairs of the other groups go through a shuffle of pairs.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.token_counts import byte_letters
from tallyline.llm.token_shards import PieceEncoder
from tallyline.llm.words import slices
from tallyline.sources.scratch import written

#: Irregular pairs with more than this share of all links are looked up in the task, so there are fewer than its inverse.
FREQUENT_SHARE = 1 / (1 << 17)
MARK = "▁"

ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " same_ids array<int>, same_counts array<int>, odd_pairs array<long>, odd_counts array<int>"
)


def _parts(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


class Aligner:
    """A byte-level vocabulary of the tokenizers library (A) beside a sentencepiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor

        self.a = PieceEncoder(a_path)
        # Special tokens' strings in a text are plain text.
        self.a.tokenizer.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        vocabulary = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for name, k in vocabulary.items():
            plain = name in self.a.added or not all(c in byte_of for c in name)
            self.a_bytes[k] = name.encode() if plain else bytes(byte_of[c] for c in name)
        pieces = [(k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in pieces]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # Of two B ids with the same bytes the piece comes before the single byte.
        order = sorted(range(len(pieces)), key=lambda k: (not self.b.is_byte(k), -k))
        id_of = {self.b_bytes[k]: k for k in order}
        self.same = np.array([id_of.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        a_names, b_names = ([str(k) for k in range(n)] for n in (self.n_a, self.n_b))
        ended = ([f"{x}{end}".encode() for x in names] for names, end in (
            (a_names, ","), (a_names, "|"), (b_names, ","), (b_names, ";")
        ))
        self.names = list(chain.from_iterable(ended))

    def _encoded(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[list[int]]]:
        """Ids by A and B of each text; none where the tokens do not give back the text with a space before it."""
        spaced = [" " + t if t else "" for t in texts]
        a = self.a.encode(pa.array(spaced, pa.string()))
        b = self.b.encode([t or "" for t in texts], num_threads=1)
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for k, text in enumerate(spaced):
            whole = text.encode()
            if not whole or b"".join(map(a_bytes, a[k].tolist())) != whole or b"".join(map(b_bytes, b[k])) != whole:
                a[k], b[k] = a[k][:0], []
        return a, b

    def aligned(self, rows: pa.Array, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        """``ALIGNED`` for a slice of documents."""
        a_of, b_of = self._encoded(texts.to_pylist())
        a_counts, b_counts = (np.array([len(x) for x in found], np.int64) for found in (a_of, b_of))
        a = np.concatenate([np.empty(0, np.int64), *a_of]).astype(np.int64)
        b = np.fromiter(chain.from_iterable(b_of), np.int64, int(b_counts.sum()))
        del a_of, b_of
        # Both cover the same bytes in every document, so ends compare over the whole slice.
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        at = np.searchsorted(b_ends, a_ends)
        a_last = np.flatnonzero(b_ends[at] == a_ends)
        b_last = at[a_last]
        a_stops, b_stops = np.cumsum(a_counts), np.cumsum(b_counts)
        document = np.searchsorted(a_stops, a_last, "right")
        groups = np.bincount(document, minlength=len(texts))

        left, right = a[a_last], b[b_last]
        single = (np.diff(a_last, prepend=-1) == 1) & (np.diff(b_last, prepend=-1) == 1)
        same = single & (self.same[left] == right)
        digests = self._digests(a, b, a_last, b_last, a_stops + b_stops)
        same_ids = self._counted(document[same], left[same], len(texts), self.n_a)
        odd_pairs = self._counted(document[~same], (left * self.n_b + right)[~same], len(texts), self.n_a * self.n_b)
        columns = [
            rows, ids, pa.array(a_counts), pa.array(b_counts), pa.array(groups, pa.int64()), pa.array(groups, pa.int64()),
            pa.array(digests, pa.string()), _parts(same_ids[0], same_ids[2], pa.int32()),
            _parts(same_ids[1], same_ids[2], pa.int32()), _parts(odd_pairs[0], odd_pairs[2], pa.int64()),
            _parts(odd_pairs[1], odd_pairs[2], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ALIGNED.split(", ")])

    @staticmethod
    def _counted(document: np.ndarray, keys: np.ndarray, documents: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct keys of each document, their numbers, and where each document's begin and end."""
        found, counts = np.unique(document * limit + keys, return_counts=True)
        return found % limit, counts, np.searchsorted(found, np.arange(documents + 1) * limit)

    def _digests(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, stops: np.ndarray) -> list[str]:
        """Digest of each document's groups, written as ids with the sign that follows them."""
        names = np.empty(len(a) + len(b), np.int64)
        a_group = np.searchsorted(a_last, np.arange(len(a)))
        b_group = np.searchsorted(b_last, np.arange(len(b)))
        b_before = np.concatenate(([0], b_last + 1))[:-1] if len(b_last) else b_last
        a_codes, b_codes = a.copy(), 2 * self.n_a + b
        a_codes[a_last] += self.n_a
        b_codes[b_last] += self.n_b
        names[np.arange(len(a)) + b_before[a_group]] = a_codes
        names[np.arange(len(b)) + a_last[b_group] + 1] = b_codes
        found, begin = [], 0
        for stop in stops.tolist():
            text = b"".join(map(self.names.__getitem__, names[begin:stop].tolist()))
            found.append(hashlib.sha256(text[:-1]).hexdigest() if text else "")
            begin = stop
        return found


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def aligned_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``ALIGNED`` for every row, written: counts of groups, their digest, and per document the numbers of its pairs."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for piece in slices(batches):
            yield both.aligned(piece.column("row"), piece.column("doc_id"), piece.column("text"))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return written(rows.mapInArrow(found, ALIGNED), "aligned")


def pair_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``a_id, b_id, n, same, best``: links of each pair over all texts, whether it is of the array from A's ids to B's, and
    whether no other A id has more links with this B id; written."""

    def same_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        total = np.zeros(both.n_a, np.int64)
        for batch in batches:
            keys, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("same_ids", "same_counts"))
            total += np.bincount(keys, counts, both.n_a).astype(np.int64)
        a = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, both.same[a], total[a])], names=["a_id", "b_id", "n"])

    n_b = aligner(a_path, b_path).n_b
    same = aligned.select("same_ids", "same_counts").mapInArrow(same_counts, "a_id long, b_id long, n long")
    odd = aligned.select(F.explode(F.arrays_zip("odd_pairs", "odd_counts")).alias("x"))
    odd = odd.groupBy(F.col("x.odd_pairs").alias("pair")).agg(F.sum(F.col("x.odd_counts").cast("long")).alias("n"))
    odd = odd.select(F.expr(f"pair div {n_b}").alias("a_id"), (F.col("pair") % n_b).alias("b_id"), "n")
    both = same.withColumn("same", F.lit(True)).union(odd.withColumn("same", F.lit(False)))
    both = both.groupBy("a_id", "b_id").agg(F.sum("n").alias("n"), F.max("same").alias("same"))
    pairs = written(both, "alignment-pairs")
    # At most a row per id of B's vocabulary.
    highest = pairs.groupBy("b_id").agg(F.max("n").alias("highest"))
    best = (F.col("n") == F.col("highest")).alias("best")
    return written(pairs.join(F.broadcast(highest), "b_id").select("a_id", "b_id", "n", "same", best), "alignment-counts")


def aligned_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    ``a_path`` is a byte-level vocabulary of the tokenizers library, ``b_path`` a sentencepiece model that puts a space
    before a text; every executor has both. A link is an A and a B token that end at the same byte, ``n_best`` of a
    document's links have the corpus-wide highest count of their B id, ties included, and ``count_sum`` adds up their
    counts. A null or empty text, and one that the tokens do not give back byte by byte, has zeros and an empty digest. Rows
    that repeat are aligned and counted each; a null doc_id stays null; an empty table gives an empty result; further
    columns are left out. A text longer than a slice is held alone.
    """
    aligned = aligned_texts(docs, a_path, b_path)
    pairs = pair_counts(aligned, a_path, b_path)
    n_a, n_b = aligner(a_path, b_path).n_a, aligner(a_path, b_path).n_b
    links = pairs.agg(F.sum("n")).first()[0] or 0
    pairs = pairs.withColumn("pair", F.col("a_id") * n_b + F.col("b_id"))
    # The driver sees a row per id of A's vocabulary, and the pairs above the share: both of a size that no corpus exceeds.
    known = pairs.where(F.col("same") | (F.col("n") > links * FREQUENT_SHARE)).select("a_id", "pair", "n", "best", "same")
    known = known.toArrow().sort_by("pair")
    pair, count, best = (known.column(c).to_numpy() for c in ("pair", "n", "best"))
    own = known.filter(known.column("same"))
    same_count, same_best = np.zeros(n_a, np.int64), np.zeros(n_a, np.int64)
    same_count[own.column("a_id").to_numpy()] = own.column("n").to_numpy()
    same_best[own.column("a_id").to_numpy()] = own.column("best").to_numpy()

    def summed(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        return total[offsets[1:]] - total[offsets[:-1]]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for keys, counts in (("same_ids", "same_counts"), ("odd_pairs", "odd_counts")):
                lists = batch.column(keys)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                keys, counts = (c.flatten().to_numpy().astype(np.int64) for c in (lists, batch.column(counts)))
                sums.append((offsets - offsets[0], keys, counts))
            (same_at, ids, same_n), (odd_at, odd, odd_n) = sums
            place = np.minimum(np.searchsorted(pair, odd), max(len(pair) - 1, 0))
            there = pair[place] == odd if len(pair) else np.zeros(len(odd), bool)
            odd_count, odd_best = (np.where(there, x[place], 0) if len(pair) else np.zeros(len(odd), np.int64) for x in (count, best))
            rest_at = np.concatenate(([0], np.cumsum(~there)))[odd_at]
            columns = [
                *(batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")),
                pa.array(summed(same_at, same_best[ids] * same_n) + summed(odd_at, odd_best * odd_n)),
                pa.array(summed(same_at, same_count[ids] * same_n) + summed(odd_at, odd_count * odd_n)),
                _parts(odd[~there], rest_at, pa.int64()), _parts(odd_n[~there], rest_at, pa.int64()),
            ]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rest", "rest_n"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = (
        "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
        " n_best long, count_sum long, rest array<long>, rest_n array<long>"
    )
    found = written(aligned.mapInArrow(looked_up, schema), "alignment-known")
    rare = found.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select("row", "x.rest", "x.rest_n")
    rare = rare.join(pairs.select(F.col("pair").alias("rest"), "n", "best"), "rest").groupBy("row").agg(
        F.sum(F.col("rest_n") * F.col("n")).alias("more_sum"),
        F.sum(F.when(F.col("best"), F.col("rest_n")).otherwise(0)).alias("more_best"),
    )
    more = lambda own, other: (F.col(own) + F.coalesce(F.col(other), F.lit(0))).alias(own)
    return found.drop("rest", "rest_n").join(rare, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256"
    )
