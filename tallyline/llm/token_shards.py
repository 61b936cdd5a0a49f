"""Token ids of whole documents in shard files, in ascending doc_id order; see :mod:`tallyline.llm.wavelet`."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.llm.wavelet import WaveletShard, encode
from tallyline.llm.words import slices
from tallyline.sources.scratch import scratch_dir, written

SHARD_TOKENS = 4 << 20
TASK_BYTES = 8 << 20
REMEMBERED = 600_000
# Where a byte-level pre-tokenizer surely begins a new piece: at a single space between two characters that are not
# white space, between a letter or digit and punctuation, and around a single line feed. Only letters of old
# standing are named, so it doesn't matter which Unicode version a pattern library knows.
CUT = "\x01"
SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOUCHING = rf"[{SPACE}] | [{SPACE}]|{CUT}"
LETTER = r"0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
BEFORE_PUNCTUATION = rf"([{LETTER}])([!-&(-/:-@\[-`{{-~])"
AROUND_LINE_FEED = r"([!-~\x{c0}-\x{24f}])\n([!-~\x{c0}-\x{24f}])"


class PieceEncoder:
    """Encodes texts with a byte-level vocabulary of the tokenizers library.

    Texts are cut where its pre-tokenizer begins a new piece for sure, and every distinct piece of a slice is encoded
    once; texts with added tokens in them, or with spaces next to white space, are encoded as they are.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.remembered = remembered
        # Pieces seen of late, and those before them: frequent ones pass from one to the other.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), self.kind, int(sizes.sum())), sizes

    def _pieces(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.remembered // 2:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = [x for x in names if x not in known]
        known.update([(x, before[x]) for x in new if x in before])
        new = [x for x in new if x not in known]
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            ids, sizes = self._library(part)
            data, ends = ids.tobytes(), (np.cumsum(sizes) * ids.itemsize).tolist()
            for name, begin, end in zip(part, [0, *ends], ends):
                known[name] = data[begin:end]
        found = [known[x] for x in names]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.kind).itemsize
        return np.frombuffer(b"".join(found), self.kind), sizes

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null text has none."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, TOUCHING).to_numpy(zero_copy_only=False)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(texts.filter(pa.array(~whole)), " ", CUT + " ")
        cut = pc.replace_substring_regex(cut, BEFORE_PUNCTUATION, rf"\1{CUT}\2")
        parts = pc.split_pattern(pc.replace_substring_regex(cut, AROUND_LINE_FEED, "\\1" + CUT + "\n" + CUT + "\\2"), CUT)
        offsets = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets -= offsets[0]
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy()
        ids, sizes = self._pieces(coded.dictionary.to_pylist())
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat_ids = ids[np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(total)]
        bounds = np.concatenate(([0], ends))[offsets]
        fast = iter(np.split(flat_ids, bounds[1:-1]) if len(cut) else [])
        if not whole.any():
            return list(fast)
        ids, sizes = self._library(texts.filter(pa.array(whole)).to_pylist())
        slow = iter(np.split(ids, np.cumsum(sizes)[:-1]))
        return [next(slow) if w else next(fast) for w in whole]


@cache
def piece_encoder(path: str, remembered: int) -> PieceEncoder:
    return PieceEncoder(path, remembered)


def _put(folder: str, name: str, content: bytes) -> None:
    """Write a file under another name and move it, so a retried or doubled task leaves one whole file."""
    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    context = TaskContext.get()
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{context.taskAttemptId()}"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, f"{path}/{name}")


def write_shards(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, shard_tokens: int = SHARD_TOKENS, remembered: int = REMEMBERED
) -> DataFrame:
    """Encode all texts and write them to ``folder``; the manifest (``part, shard, name, documents, tokens``) comes back.

    Rows are dealt by ranges of doc_id (nulls first; rows that share an id by a hash of the text, so a hot id is spread),
    about 8 MB of text a task, so shards follow one another in doc_id order. A task closes a shard at ``shard_tokens``
    ids; a document is never cut. Files go to any store that Arrow's file systems reach. A worker keeps the ids of up to
    ``remembered`` pieces (about 200 bytes each).
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("text")]
    dealt = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(int(size // TASK_BYTES) + 1, F.col("doc_id").asc_nulls_first(), "tie")
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = piece_encoder(vocabulary, remembered), TaskContext.get().partitionId(), 0
        pending: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []

        def close() -> pa.RecordBatch:
            name, tokens = f"{part:08d}-{shard:05d}.wvm", sum(lengths)
            _put(folder, name, encode(np.concatenate(pending), doc_ids, lengths))
            row = {"part": [part], "shard": [shard], "name": [name], "documents": [len(doc_ids)], "tokens": [tokens]}
            return pa.RecordBatch.from_pydict(row)

        end = np.array([end_id], encoder.kind)
        for piece in slices(batches):
            for doc_id, ids in zip(piece.column("doc_id").to_pylist(), encoder.encode(piece.column("text"))):
                pending += [ids, end]
                doc_ids.append(doc_id)
                lengths.append(len(ids) + 1)
            if sum(lengths) >= shard_tokens:
                yield close()
                shard, pending, doc_ids, lengths = shard + 1, [], [], []
        if doc_ids:
            yield close()

    return written(
        dealt.mapInArrow(write, "part long, shard long, name string, documents long, tokens long"), "shard-manifest"
    )


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, shard`` of every document, from the files alone.

    ``start`` counts the ids of all documents before it; it needs one running sum over the manifest, a row per shard.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                shard = WaveletShard(content.as_py())
                ids = shard.tokens().astype("<u4")
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "name": [path.rsplit("/", 1)[-1]] * len(sums),
                        "doc_id": pa.array(shard.doc_ids, pa.int64()),
                        "within": starts,
                        "n_tokens": shard.lengths,
                        "ids_crc32": pa.array(sums, pa.int64()),
                    }
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("path", "content")
    found = files.mapInArrow(read, "name string, doc_id long, within long, n_tokens long, ids_crc32 long")
    ordered = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    before = manifest.select("name", F.coalesce(F.sum("tokens").over(ordered), F.lit(0)).alias("before"))
    return found.join(before, "name").select(
        "doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", F.col("name").alias("shard")
    )


def token_shards(
    docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, remembered: int = REMEMBERED
) -> DataFrame:
    """Write the shards of ``docs`` (to a new shared folder, unless one is given) and read the documents back.

    A null or empty text has the end id only. Rows that share a doc_id, null too, are written one after another in an
    order that their texts fix. An empty table writes no file and gives an empty result. Further columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark, "token-shards")
    manifest = write_shards(docs, folder, vocabulary, end_id, remembered=remembered)
    if manifest.isEmpty():
        schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string"
        return spark.createDataFrame([], schema)
    return read_documents(spark, folder, manifest)
