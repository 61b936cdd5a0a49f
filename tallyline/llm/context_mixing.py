"""Log probabilities of texts by online logistic context mixing, with a smoothed unigram score beside it.

A text is a sequence of pieces: a run of bytes up to and with one white-space byte or the end of the text, cut
every ``LONG`` bytes. A cut follows from the bytes before it, so coding the pieces one after another codes the text. Each byte is
coded as binary decisions: the bits of its code in a Huffman tree of the training bytes (the end of a text is a byte that UTF-8
never holds). Predictors of a decision are the counts of its two outcomes under hashed contexts: the last 1 to 4 bytes of the
piece, and the whole piece so far. All are gathered from all training texts in a table that grows with them. Their log odds are
added with weights; the gate, how often training texts had the piece so far, selects the weights.

The weights are learned from the training texts by blocks: each block takes steps from the starting weights on its own pieces,
every occurrence predicted from the counts without itself, and blocks are merged by their curvatures.
A text is predicted by several sharpnesses of these weights at once. Their shares start equal and are refined after each bit by how
well each has predicted this very text, so a text unlike the training texts soon is predicted more cautiously. The product
of the predictions of such a mix is the mean of the products of its parts, so one sum a sharpness gives it exactly.

The spelling of a piece costs the same in every text, so Spark scores each distinct piece once and joins the costs to the texts.
Every occurrence is then predicted from its spelling and from contexts across pieces: the pieces before it in training texts and in
its own text (``histories``). Their weights start from what the training texts taught and move within each text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.histories import GATES as HISTORY_GATES
from tallyline.llm.histories import OWN_CONTEXTS, Occurrences, Runs, merged_shares, numbered, spelled_logs
from tallyline.llm.words import mixed, slices, string_hashes
from tallyline.sources.scratch import bucketed, dropped, shuffles_cleared, written

END, START = 255, 256
ORDERS = (1, 2, 3, 4)
PREDICTORS = len(ORDERS) + 1
LONG = 24
# The first byte of a key: a piece with its whole word, a part of a longer one, such a longer word itself.
WORD, PART, LONG_WORD = 0, 1, 2
BLOCK_PIECES, CHUNK_PIECES, CHUNK_ENTRIES = 1 << 16, 1 << 14, 1 << 18
PRIOR_COUNT = 0.4
FIRST_WEIGHT = 0.3
GATES, STEPS, RIDGE = 12, 3, 1.0
SHARPNESSES = (0.7, 1.0, 1.2)
FREQUENT, FREQUENT_BYTES = 1 << 20, 64
SMOOTH = 0.1
# A part of the runs has about so many at most.
PART_RUNS = 1 << 22
# A bucket of slices has about so many pieces and long words.
BUCKET_KEYS = 1 << 22
DEALT_BYTES = 4 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SYMBOL = _U(0xFF)


class Code:
    """A prefix code of bytes: per symbol the tree nodes on its path, and the bits taken there."""

    def __init__(self, counts: np.ndarray):
        ticket, heap, parent = count(), [], {}
        for symbol in range(END + 1):
            heapq.heappush(heap, (int(counts[symbol]) + 1, next(ticket), symbol))
        for node in range(END):
            (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a], parent[b] = (node, 0), (node, 1)
            heapq.heappush(heap, (n + m, next(ticket), ~node))
        paths = []
        for symbol in range(END + 1):
            path, at = [], symbol
            while at in parent:
                node, bit = parent[at]
                path.append((node, bit))
                at = ~node
            paths.append(path[::-1])
        self.lengths = np.array([len(p) for p in paths])
        self.first = np.cumsum(self.lengths) - self.lengths
        self.nodes = np.array([node for p in paths for node, _ in p], np.uint64)
        self.bits = np.array([bit for p in paths for _, bit in p], np.uint8)

    def paths(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``nodes`` and ``bits`` of all decisions of ``symbols``, one after another; decisions a symbol."""
        lengths = self.lengths[symbols]
        starts = np.cumsum(lengths) - lengths
        return np.arange(int(lengths.sum())) + np.repeat(self.first[symbols] - starts, lengths), lengths


def keys_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Keys of all pieces and long words of some texts (A-Z lower-cased; null: empty), and the number of each one's text."""
    texts = pc.fill_null(pc.ascii_lower(texts), "").cast(pa.binary())
    if not len(texts):
        return pa.array([], pa.binary()), np.empty(0, np.int64)
    data = np.frombuffer(b"\xff".join(texts.to_pylist()) + b"\xff", np.uint8)
    stops = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)) | (data == END)) + 1
    starts = np.concatenate(([0], stops[:-1]))
    parts = -(-(stops - starts) // LONG)
    run = np.repeat(np.arange(len(starts)), parts)
    begin = starts[run] + LONG * (np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts))
    is_long = parts > 1
    begin = np.concatenate((begin, starts[is_long]))
    stop = np.concatenate((np.minimum(begin[: len(run)] + LONG, stops[run]), stops[is_long] - 1))
    mark = np.concatenate((np.where(is_long[run], PART, WORD), np.full(int(is_long.sum()), LONG_WORD)))
    sizes = stop - begin + 1
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    joined = data[np.arange(offsets[-1]) + np.repeat(begin - 1 - offsets[:-1], sizes)]
    joined[offsets[:-1]] = mark
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(joined)]
    keys = pa.Array.from_buffers(pa.binary(), len(sizes), buffers)
    return keys, np.searchsorted(np.flatnonzero(data == END), begin)


class Places:
    """All bytes of some pieces: the piece, the symbol, and for each predictor the pair of context and symbol."""

    def __init__(self, keys: pa.Array):
        pieces = keys.to_pylist()
        sizes = np.array([len(p) - 1 for p in pieces], np.int64)
        pad = max(ORDERS)
        table = np.full((len(pieces), pad + LONG), START, np.uint64)
        inside = np.arange(LONG) < sizes[:, None]
        table[:, pad:][inside] = np.frombuffer(b"".join(p[1:] for p in pieces), np.uint8)
        self.piece, at = np.nonzero(inside)
        self.symbols = table[:, pad:][inside].astype(np.int64)
        rolled, contexts = np.zeros(len(at), _U), []
        for back in range(1, pad + 1):
            rolled = mixed(rolled * _BASE + table[self.piece, pad + at - back] + _U(1))
            if back in ORDERS:
                contexts.append(rolled)
        whole = np.zeros((len(pieces), LONG), _U)
        for k in range(1, LONG):
            whole[:, k] = mixed(whole[:, k - 1] * _BASE + table[:, pad + k - 1] + _U(1))
        contexts.append(whole[inside])
        symbols = self.symbols.astype(_U)
        self.pairs = [mixed(c + _U(k + 1 << 56)) & ~_SYMBOL | symbols for k, c in enumerate(contexts)]

    def edge_contexts(self) -> np.ndarray:
        """Contexts of the whole piece so far that pieces of other blocks may have: those of the first and the last."""
        edge = (self.piece == 0) | (self.piece == self.piece[-1])
        return np.unique(self.pairs[-1][edge] >> _U(8))


def summed_pairs(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, number = numbered(pairs)
    return distinct, np.bincount(number, n, len(distinct))


class Block:
    """What is known about each decision of a block's pieces: how often each predictor's context saw a 0 and a 1 there."""

    def __init__(self, pieces: pa.Table, found: pa.Table, code: Code):
        self.code = code
        self.keys = pieces.column("key").combine_chunks()
        self.times = pieces.column("c").to_numpy().astype(np.float64)
        self.places = places = Places(self.keys)
        parts = [numbered(pairs) for pairs in places.pairs]
        own, number = parts[-1]
        inner = ~np.isin(own >> _U(8), places.edge_contexts())
        own_n = np.bincount(number, self.times[places.piece], len(own))
        sizes = pc.list_value_length(found.column("symbols")).to_numpy()
        context = np.repeat(found.column("context").to_numpy().view(np.uint64), sizes) << _U(8)
        symbol = pc.list_flatten(found.column("symbols")).to_numpy().astype(_U)
        n = pc.list_flatten(found.column("counts")).to_numpy().astype(np.float64)
        pairs = np.concatenate((own[inner], context | symbol))
        self._table(pairs, np.concatenate((own_n[inner], n)))
        self.first, self.pair_of, self.bits, self.zeros, self.ones = [], [], [], [], []
        for distinct, number in parts:
            path, lengths = code.paths((distinct & _SYMBOL).astype(np.int64))
            nodes = np.repeat(distinct & ~_SYMBOL, lengths) | code.nodes[path]
            zeros, ones = self._counts(nodes)
            self.first.append(np.cumsum(lengths) - lengths)
            self.pair_of.append(number)
            self.bits.append(code.bits[path])
            self.zeros.append(zeros)
            self.ones.append(ones)

    def _table(self, pairs: np.ndarray, n: np.ndarray) -> None:
        path, lengths = self.code.paths((pairs & _SYMBOL).astype(np.int64))
        self.nodes, number = np.unique(np.repeat(pairs & ~_SYMBOL, lengths) | self.code.nodes[path], return_inverse=True)
        times = np.repeat(n, lengths)
        self.node_ones = np.bincount(number, times * self.code.bits[path], len(self.nodes))
        self.node_all = np.bincount(number, times, len(self.nodes))

    def _counts(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.nodes):
            return np.zeros(len(nodes)), np.zeros(len(nodes))
        where = np.minimum(np.searchsorted(self.nodes, nodes), len(self.nodes) - 1)
        seen = self.nodes[where] == nodes
        ones = np.where(seen, self.node_ones[where], 0.0)
        return np.where(seen, self.node_all[where], 0.0) - ones, ones

    def chunks(self, without_own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(decision x predictor) log odds, the bits, the gates and the pieces of the decisions, some pieces at a time.

        ``without_own``: only pieces of training texts, each predicted from the counts less one occurrence of itself.
        """
        odds = []
        gate = np.empty(len(self.bits[-1]), np.int8)
        for k, (bits, all_zeros, all_ones) in enumerate(zip(self.bits, self.zeros, self.ones)):
            odds.append(np.empty(len(bits), np.float32))
            for start in range(0, len(bits), CHUNK_ENTRIES):
                at = slice(start, start + CHUNK_ENTRIES)
                zeros, ones = all_zeros[at], all_ones[at]
                if without_own:  # pairs that only other texts have are not asked for
                    ones, zeros = np.maximum(ones - bits[at], 0), np.maximum(zeros - (1 - bits[at]), 0)
                odds[k][at] = np.log((ones + PRIOR_COUNT) / (zeros + PRIOR_COUNT))
                if k == PREDICTORS - 1:
                    gate[at] = np.minimum(np.log2(ones + zeros + 1).astype(np.int64), GATES - 1)
        for start in range(0, len(self.keys), CHUNK_PIECES):
            a, b = np.searchsorted(self.places.piece, (start, start + CHUNK_PIECES))
            at = np.arange(a, b)
            if without_own:
                at = at[self.times[self.places.piece[at]] > 0]
            path, lengths = self.code.paths(self.places.symbols[at])
            depth = np.arange(len(path)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            x = np.empty((len(path), PREDICTORS), np.float32)
            for k in range(PREDICTORS):
                where = np.repeat(self.first[k][self.pair_of[k][at]], lengths) + depth
                x[:, k] = odds[k][where]
            yield x, self.code.bits[path], gate[where], np.repeat(self.places.piece[at], lengths)

    def learned(self) -> tuple[np.ndarray, np.ndarray]:
        """Per gate the curvature at the block's own weights, and its product with these weights."""
        parts = [[] for _ in range(GATES)]
        for x, bits, gates, piece in self.chunks(without_own=True):
            order = np.argsort(gates.astype(np.uint8), kind="stable")
            cuts = np.searchsorted(gates[order], np.arange(GATES + 1))
            for part, a, b in zip(parts, cuts[:-1], cuts[1:]):
                at = order[a:b]
                part.append((x[at], bits[at], self.times[piece[at]].astype(np.float32)))
        weights = np.full((GATES, PREDICTORS), FIRST_WEIGHT)
        bends = np.zeros((GATES, PREDICTORS, PREDICTORS))
        for gate, part in enumerate(parts):
            for _ in range(STEPS):
                bend, slope = RIDGE * np.eye(PREDICTORS), RIDGE * (FIRST_WEIGHT - weights[gate])
                for x, bits, times in part:
                    p = 1 / (1 + np.exp(-(x @ weights[gate].astype(np.float32))))
                    slope += (times * (bits - p)) @ x
                    bend += (x * (times * p * (1 - p))[:, None]).T @ x
                weights[gate] += np.clip(np.linalg.solve(bend, slope), -0.5, 0.5)
            bends[gate] = bend - RIDGE * np.eye(PREDICTORS)
        return bends, np.einsum("gij,gj->gi", bends, weights)

    def costs(self, weights: np.ndarray) -> np.ndarray:
        """(piece x sharpness) bits."""
        spent = np.zeros((len(self.keys), len(SHARPNESSES)))
        for x, bits, gates, piece in self.chunks(without_own=False):
            margin = np.einsum("ij,ij->i", x, weights.astype(np.float32)[gates]) * (bits * np.float32(2) - np.float32(1))
            for k, sharpness in enumerate(SHARPNESSES):
                cost = np.log1p(np.exp(-np.clip(margin * sharpness, -30, 30)))
                spent[:, k] += np.bincount(piece, cost, len(self.keys))
        return spent / np.log(2)


def merged_weights(bend: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Weights of all blocks together; a gate that no block has met keeps the starting weights."""
    start = np.full((GATES, PREDICTORS), FIRST_WEIGHT)
    return np.linalg.solve(bend + RIDGE * np.eye(PREDICTORS), (product + RIDGE * start)[..., None])[..., 0]


def counted_keys(held: DataFrame) -> DataFrame:
    """``key, n, c``: pieces and long words, how often all texts have them and how often the training texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            keys, text_of = keys_of(piece.column("text"))
            coded = keys.dictionary_encode()
            number = coded.indices.to_numpy()
            train = ~piece.column("held_out").to_numpy(zero_copy_only=False)
            c = np.bincount(number, train[text_of], len(coded.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"key": coded.dictionary, "n": np.bincount(number), "c": c})

    found = held.select("text", "held_out").mapInArrow(counted, "key binary, n long, c long")
    return found.groupBy("key").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def symbol_counts(pieces: DataFrame) -> np.ndarray:
    """How often each byte, and the end, occur in the training texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            times = np.repeat(batch.column("c").to_numpy(), [len(k) - 1 for k in keys])
            n = np.bincount(np.frombuffer(b"".join(k[1:] for k in keys), np.uint8), times, END + 1)
            yield pa.RecordBatch.from_pydict({"symbol": np.arange(END + 1, dtype=np.int32), "n": n.astype(np.int64)})

    found = pieces.select("key", "c").mapInArrow(counted, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    counts = np.zeros(END + 1, np.int64)
    for row in found.collect():  # a row a byte
        counts[row["symbol"]] = row["n"]
    return counts


def in_blocks(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``block``: ``BLOCK_PIECES`` that follow each other in byte order, so that they share their beginnings."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            block = (np.arange(row, row + batch.num_rows) // BLOCK_PIECES) + (TaskContext.get().partitionId() << 33)
            row += batch.num_rows
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | {"block": block})

    spelled = F.expr("substring(key, 2)")
    ordered = pieces.repartitionByRange(spelled, "key").sortWithinPartitions(spelled, "key")
    kinds = ", ".join(f"{c} {kind}" for c, kind in pieces.dtypes)
    return written(ordered.mapInArrow(dealt, f"{kinds}, block long"), "mixing-blocks")


def _shared(places: Places) -> Iterator[tuple[int, np.ndarray]]:
    """Per predictor the places whose contexts other blocks may have too."""
    for k in range(PREDICTORS - 1):
        yield k, np.arange(len(places.symbols))
    yield PREDICTORS - 1, np.flatnonzero(np.isin(places.pairs[-1] >> _U(8), places.edge_contexts()))


def context_counts(blocks: DataFrame) -> DataFrame:
    """``context, symbols, counts``: what followed each context in the training texts, and how often.

    A row a context that pieces of several blocks can have, so the table grows with the texts; a block counts the others itself.
    """

    def gathered(pieces: pa.Table) -> pa.Table:
        places, times = Places(pieces.column("key").combine_chunks()), pieces.column("c").to_numpy()
        pairs, n = zip(*(summed_pairs(places.pairs[k][at], times[places.piece[at]]) for k, at in _shared(places)))
        pairs, n = np.concatenate(pairs), np.concatenate(n).astype(np.int64)
        context, symbol = (pairs >> _U(8)).astype(np.int64), (pairs & _SYMBOL).astype(np.int16)
        return pa.table({"context": context, "symbol": symbol, "n": n}).filter(pa.array(n > 0))

    rows = blocks.select("block", "key", "c").groupBy("block").applyInArrow(gathered, "context long, symbol short, n long")
    # One shuffle: both aggregations are over rows dealt by context.
    pairs = rows.repartition("context").groupBy("context", "symbol").agg(F.sum("n").alias("n"))
    lists = pairs.groupBy("context").agg(F.collect_list(F.struct("symbol", "n")).alias("x"))
    return lists.select("context", F.col("x.symbol").alias("symbols"), F.col("x.n").alias("counts"))


def block_contexts(blocks: DataFrame) -> DataFrame:
    """``block, context``: the contexts of each block that others may share, each once."""

    def needed(pieces: pa.Table) -> pa.Table:
        places = Places(pieces.column("key").combine_chunks())
        found = np.concatenate([np.unique(places.pairs[k][at] >> _U(8)) for k, at in _shared(places)]).astype(np.int64)
        return pa.table({"block": np.full(len(found), pieces.column("block")[0].as_py()), "context": found})

    return blocks.select("block", "key").groupBy("block").applyInArrow(needed, "block long, context long")


def piece_costs(blocks: DataFrame, code: Code) -> DataFrame:
    """``key, bits``: what each piece takes under each sharpness."""
    spark = blocks.sparkSession
    contexts = written(context_counts(blocks), "mixing-contexts")
    found = block_contexts(blocks).join(contexts, "context").select("block", "context", "symbols", "counts")
    found = written(found, "mixing-found")
    sent = spark.sparkContext.broadcast(code)

    def learn(pieces: pa.Table, found: pa.Table) -> pa.Table:
        bend, product = Block(pieces, found, sent.value).learned()
        values = np.concatenate((bend.ravel(), product.ravel()))
        return pa.table({"number": np.arange(len(values), dtype=np.int32), "value": values})

    def both(columns: str):
        return blocks.select(*columns.split()).groupBy("block").cogroup(found.groupBy("block"))

    sums = both("block key c").applyInArrow(learn, "number int, value double").groupBy("number").agg(F.sum("value").alias("v"))
    values = np.zeros(GATES * PREDICTORS * (PREDICTORS + 1))
    for row in sums.collect():  # a row a coefficient
        values[row["number"]] = row["v"]
    bends = GATES * PREDICTORS**2
    bend = values[:bends].reshape(GATES, PREDICTORS, PREDICTORS)
    weights = merged_weights(bend, values[bends:].reshape(GATES, PREDICTORS))

    def cost(pieces: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(pieces, found, sent.value)
        bits = pa.FixedSizeListArray.from_arrays(pa.array(block.costs(weights).ravel().astype(np.float32)), len(SHARPNESSES))
        lists = bits.cast(pa.list_(pa.float32()))
        return pa.table({"key": block.keys, "word_c": pieces.column("word_c"), "n": pieces.column("n"), "c": pieces.column("c"), "bits": lists})

    return both("block key c word_c n").applyInArrow(cost, "key binary, word_c long, n long, c long, bits array<float>")


@dataclass(frozen=True)
class PieceModel:
    """All pieces and long words with their costs, and the sums of the training texts' words."""

    costs: DataFrame
    often: Column
    all_n: int
    train_texts: int
    train_tokens: int
    divisor: float

    def frequent(self) -> pa.Table:
        """The entries looked up where a text is read, 2^20 at most."""
        return self.costs.where(self.often).toArrow().combine_chunks()


def held_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text, held_out``."""
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    return docs.select(F.col("doc_id").cast("long"), "text", (remainder == 0).alias("held_out"))


def piece_model(held: DataFrame) -> PieceModel:
    """``key, word_c, n, c, bits`` of every piece and long word of some texts, written, with what belongs to them."""
    mark = F.expr("substring(key, 1, 1)")
    word = F.when(mark == F.lit(bytes([WORD])), F.expr("substring(key, 2, length(key) - 2)")).when(
        mark == F.lit(bytes([LONG_WORD])), F.expr("substring(key, 2)")
    )
    entries = written(counted_keys(held).withColumn("word", F.when(F.length(word) > 0, word)), "mixing-keys")
    words = written(entries.where("word IS NOT NULL").groupBy("word").agg(F.sum("c").alias("word_c")), "mixing-words")
    is_piece = mark != F.lit(bytes([LONG_WORD]))
    ends = is_piece & (F.expr("substring(key, -1, 1)") == F.lit(bytes([END])))
    all_n, train_texts = entries.agg(F.sum("n"), F.sum(F.when(ends, F.col("c")).otherwise(0))).first()
    n, v = words.where("word_c > 0").agg(F.sum("word_c"), F.count(F.lit(1))).first()
    all_n, train_texts = all_n or 0, train_texts or 0
    n, v = (n or 0) + train_texts, v + (train_texts > 0)
    divisor = n + SMOOTH * (v + 1)
    known = entries.join(words, "word", "left").drop("word")
    code = Code(symbol_counts(entries.where(is_piece & (F.col("c") > 0))))
    costs = piece_costs(in_blocks(known.where(is_piece)), code)
    free = F.array_repeat(F.lit(0.0).cast("float"), len(SHARPNESSES))
    costs = written(costs.unionByName(known.where(~is_piece).select("key", "word_c", "n", "c", free.alias("bits"))), "mixing-costs")
    often = (F.col("n") > all_n / FREQUENT) & (F.length("key") <= FREQUENT_BYTES)
    return PieceModel(costs, often, all_n, train_texts, n, divisor)


SLICES = (
    "slice long, doc_id array<long>, held_out array<boolean>, n_bytes array<long>, keys array<binary>, rare_at array<int>, "
    "numbers binary, lengths binary, longs binary, long_lengths binary"
)


def _numbers(column: pa.ChunkedArray, kind: type = np.int32) -> np.ndarray:
    """All numbers that the rows hold as bytes, one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2^48 as all lowest bytes, then all second ones, ...: the upper ones are mostly 0 and take no room."""
    return values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unplaned(row: bytes) -> np.ndarray:
    values = np.zeros((len(row) // 6, 8), np.uint8)
    values[:, :6] = np.frombuffer(row, np.uint8).reshape(6, -1).T
    return values.view(np.uint64).ravel()


def dealt_texts(held: DataFrame, frequent: Broadcast, buckets: int) -> tuple[str, str]:
    """Slices of texts, a row each: the distinct keys, which of them ``frequent`` lacks, and the numbers of each text's keys."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, slice_ = _often(frequent.value), TaskContext.get().partitionId() << 33
        for piece in slices(batches, limit=DEALT_BYTES):
            found, text_of = keys_of(piece.column("text"))
            coded = found.dictionary_encode()
            keys, number = coded.dictionary, coded.indices.to_numpy().astype(np.int32)
            is_long = _marks(keys)[number] == LONG_WORD
            lengths, long_lengths = (np.bincount(text_of[x], minlength=piece.num_rows) for x in (~is_long, is_long))
            rare_at = np.flatnonzero(pc.is_null(pc.index_in(keys, value_set=often)).to_numpy(zero_copy_only=False))
            columns = {
                "slice": pa.array([slice_]),
                "doc_id": _row(piece.column("doc_id")),
                "held_out": _row(piece.column("held_out")),
                "n_bytes": _row(pc.fill_null(pc.binary_length(piece.column("text")), 0).cast(pa.int64())),
                "keys": _row(keys),
                "rare_at": _row(pa.array(rare_at.astype(np.int32))),
                "numbers": pa.array([number[~is_long].tobytes()]),
                "lengths": pa.array([lengths.astype(np.int32).tobytes()]),
                "longs": pa.array([number[is_long].tobytes()]),
                "long_lengths": pa.array([long_lengths.astype(np.int32).tobytes()]),
            }
            slice_ += 1
            yield pa.RecordBatch.from_pydict(columns)

    return bucketed(held.mapInArrow(dealt, SLICES), "mixing-slices", "slice", buckets)


def _row(values: pa.Array) -> pa.Array:
    """One row, the list of all ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _often(frequent: pa.Table) -> pa.Array:
    return frequent.column("key").combine_chunks() if frequent.num_rows else pa.array([], pa.binary())


def _marks(keys: pa.Array) -> np.ndarray:
    """The first byte of each key."""
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys)]
    return np.frombuffer(keys.buffers()[2], np.uint8)[offsets] if len(keys) else np.empty(0, np.uint8)


def _plain(column: pa.ChunkedArray) -> pa.Array:
    """The keys of a slice's only row."""
    return pa.concat_arrays([column.chunk(k).flatten() for k in range(column.num_chunks)])


def run_totals(dealt: DataFrame, history: int, parts: int) -> DataFrame:
    """``slice, part, totals``: how often all training texts have the runs of each part of a slice.

    The runs of a part go in ascending order, as differences.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (pa.Table.from_batches([batch.slice(k, 1)]) for k in range(batch.num_rows)):
                lengths, numbers = _numbers(row.column("lengths")), _numbers(row.column("numbers"))
                runs = Runs(string_hashes(_plain(row.column("keys")))[numbers], lengths, history + 1, parts)
                train = ~_plain(row.column("held_out")).to_numpy(zero_copy_only=False)
                counts = runs.counts(np.repeat(train, lengths).astype(np.float64))
                bounds = list(zip(runs.cuts[:-1].tolist(), runs.cuts[1:].tolist()))
                columns = {
                    "slice": pa.array(row.column("slice").to_pylist() * len(bounds), pa.int64()),
                    "part": pa.array(runs.parts, pa.int32()),
                    "hashes": pa.array([_planes(np.diff(runs.distinct[a:b], prepend=_U(0))) for a, b in bounds], pa.binary()),
                    "counts": pa.array([_planes(counts[a:b]) for a, b in bounds], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    def summed(rows: pa.Table) -> pa.Table:
        hashes = [np.cumsum(_unplaned(row), dtype=np.uint64) for row in rows.column("hashes").to_pylist()]
        counts = [_unplaned(row) for row in rows.column("counts").to_pylist()]
        distinct, number = numbered(np.concatenate(hashes))
        totals = np.bincount(number, np.concatenate(counts), len(distinct))[number]
        cut = [_planes(t) for t in np.split(totals, np.cumsum([len(h) for h in hashes])[:-1])]
        columns = {"slice": rows.column("slice"), "part": rows.column("part"), "totals": pa.array(cut, pa.binary())}
        return pa.table(columns)

    runs = dealt.select("slice", "held_out", "keys", "numbers", "lengths").mapInArrow(
        cut, "slice long, part int, hashes binary, counts binary"
    )
    return runs.groupBy("part").applyInArrow(summed, "slice long, part int, totals binary")


class Slice:
    """The texts of a slice with all that was found about their keys and runs."""

    def __init__(self, row: pa.Table, found: pa.Table, frequent: pa.Table, history: int, parts: int, train_texts: int):
        self.doc_id, self.held_out, self.n_bytes = (_plain(row.column(c)) for c in ("doc_id", "held_out", "n_bytes"))
        self.keys = keys = _plain(row.column("keys"))
        at = pc.fill_null(pc.index_in(keys, value_set=_often(frequent)), -1).to_numpy()
        here = np.flatnonzero(at >= 0)
        self.word_c, c, bits = np.full(len(keys), np.nan), np.zeros(len(keys)), np.zeros((len(keys), len(SHARPNESSES)))
        rare = found.filter(pc.is_valid(found.column("at")))
        for entries, places in ((frequent.take(pa.array(at[here])), here), (rare, rare.column("at").to_numpy())):
            self.word_c[places] = entries.column("word_c").to_numpy().astype(np.float64)
            c[places] = entries.column("c").to_numpy()
            bits[places] = pc.list_flatten(entries.column("bits")).to_numpy().reshape(-1, len(SHARPNESSES))
        self.numbers, self.lengths, self.longs, self.long_lengths = (
            _numbers(row.column(name)) for name in ("numbers", "lengths", "longs", "long_lengths")
        )
        spelled = spelled_logs(bits[self.numbers], self.lengths)
        self.pieces = Occurrences(spelled, self.numbers, self.lengths)
        if history:
            runs = Runs(string_hashes(keys)[self.numbers], self.lengths, history + 1, parts)
            totals = found.filter(pc.is_valid(found.column("totals"))).sort_by("part").column("totals").to_pylist()
            totals = np.concatenate([_unplaned(row) for row in totals]).astype(np.float64)
            self.pieces.add_contexts([c[self.numbers], *(totals[number] for number in runs.numbers)], runs.numbers[0], train_texts)

    def words(self, divisor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text its words, the known ones of them, and their base score, all without the end."""
        texts, marks = len(self.lengths), _marks(self.keys)
        number = np.concatenate((self.numbers, self.longs))
        text_of = np.concatenate([np.repeat(np.arange(texts), n) for n in (self.lengths, self.long_lengths)])
        token = (marks == LONG_WORD) | ((marks == WORD) & (pc.binary_length(self.keys).to_numpy() > 2))
        base = np.where(token, np.log10((np.nan_to_num(self.word_c) + SMOOTH) / divisor), 0.0)
        return tuple(np.bincount(text_of, x[number], texts) for x in (token, self.word_c > 0, base))


def scored_texts(docs: DataFrame, history: int = 0) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte`` per row.

    Texts whose crc32(doc_id) is not divisible by 10 are learned from; all are scored, A-Z lower-cased. ``base_score``
    is the smoothed unigram log10 probability of words and end, ``score`` the model's log10 probability of the text. A
    null text is empty; an empty text has the end only; a null doc_id counts as id text '' and is held out. Rows that
    repeat are learned from and scored each. Without training texts all counts are 0. An empty table gives an empty result.
    Further columns are ignored. Memory is bounded by a slice of texts, by one text where that is longer, by a block of pieces,
    and by a part of the runs.

    ``history``: of how many pieces before a piece its longest context consists; 0 predicts each from its spelling alone.

    Pieces and words of at most ``FREQUENT_BYTES`` with more than 1/2^20 of all occurrences (so at most 2^20 of them) are
    looked up where a text is read; all others are joined.
    """
    with shuffles_cleared(docs.sparkSession):
        return _scored(docs, history)


def _scored(docs: DataFrame, history: int) -> DataFrame:
    spark, held = docs.sparkSession, held_texts(docs)
    model = piece_model(held)
    train_texts, train_tokens, divisor = model.train_texts, model.train_tokens, model.divisor
    frequent = spark.sparkContext.broadcast(model.frequent())
    parts, buckets = 1 + model.all_n * history // PART_RUNS, 1 + model.all_n // BUCKET_KEYS
    slices_name, _ = dealt_texts(held, frequent, buckets)
    dealt = spark.table(slices_name)
    places = F.arrays_zip(F.transform("rare_at", lambda i: F.col("keys")[i]).alias("key"), F.col("rare_at").alias("at"))
    rare = dealt.select("slice", F.explode(places).alias("x")).select("slice", F.col("x.key").alias("key"), F.col("x.at").alias("at"))
    found = rare.join(model.costs.where(~model.often).drop("n"), "key").drop("key")
    if history:
        found = found.unionByName(run_totals(dealt, history, parts), allowMissingColumns=True)
    else:
        found = found.selectExpr("*", "int(null) AS part", "binary(null) AS totals")
    found_name, _ = bucketed(found.repartition(buckets, "slice"), "mixing-found", "slice", buckets)
    both = dealt.drop("rare_at").groupBy("slice").cogroup(spark.table(found_name).groupBy("slice"))

    def learn(row: pa.Table, found: pa.Table) -> pa.Table:
        mine = Slice(row, found, frequent.value, history, parts, train_texts)
        sums = mine.pieces.learned(~mine.held_out.to_numpy(zero_copy_only=False)).ravel()
        return pa.table({"number": np.arange(len(sums), dtype=np.int32), "value": sums})

    contexts = history + OWN_CONTEXTS if history else 0
    values = np.zeros(2 * contexts * HISTORY_GATES)
    if history:
        for row in both.applyInArrow(learn, "number int, value double").groupBy("number").agg(F.sum("value").alias("v")).collect():
            values[row["number"]] = row["v"]  # a row a context length and gate
    shares = merged_shares(values.reshape(2, contexts, HISTORY_GATES))
    end_known, end_base = int(train_texts > 0), float(np.log10((train_texts + SMOOTH) / divisor))

    def score(row: pa.Table, found: pa.Table) -> pa.Table:
        mine = Slice(row, found, frequent.value, history, parts, train_texts)
        n_tokens, known, base = mine.words(divisor)
        logs = mine.pieces.logs(shares)
        n_bytes = mine.n_bytes.to_numpy()
        return pa.table(
            {
                "doc_id": mine.doc_id,
                "held_out": mine.held_out,
                "n_tokens": n_tokens.astype(np.int64) + 1,
                "n_known": known.astype(np.int64) + end_known,
                "train_tokens": np.full(len(logs), train_tokens, np.int64),
                "base_score": base + end_base,
                "score": logs / np.log(10),
                "n_bytes": n_bytes,
                "bits_per_byte": -logs / np.log(2) / np.maximum(n_bytes, 1),
            }
        )

    scores = both.applyInArrow(
        score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
        "n_bytes long, bits_per_byte double",
    )
    scores = written(scores, "mixing-scores")
    dropped(spark, (slices_name, found_name))
    return scores
