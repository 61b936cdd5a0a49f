"""A wavelet matrix of token ids in one compressed file.

The ids' bits are stored as planes, highest bit first; below each plane the ids are parted stably into those with a
zero and those with a one. A plane is cut into blocks of 65,536 bits, compressed one by one; a directory keeps each
block's place and the ones before it, so access, rank, select and counting read one or two blocks per plane.

File: ``WVM1``, length of the header (uint32), header (JSON), sizes of blocks (uint32, plane by plane), ones
before each block (uint64), document ids (int64), null flags of ids (uint8), document lengths (int64), then the blocks. All
little-endian; the block sizes and the four arrays after them are one compressed section each.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa

MAGIC = b"WVM1"
BLOCK_BITS = 1 << 16
CODEC = "zstd"


def _compress(data: bytes) -> bytes:
    return pa.compress(data, codec=CODEC, asbytes=True)


def encode(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of one shard: ids of all its documents in order, with the documents' ids and lengths."""
    values = np.ascontiguousarray(ids)
    n, planes = len(values), max(1, int(values.max()).bit_length()) if len(values) else 1
    zeros, ones_before, blocks = [], [], []
    for plane in range(planes - 1, -1, -1):
        mask = (values & values.dtype.type(1 << plane)) != 0
        packed = np.packbits(mask, bitorder="little")
        starts = np.arange(0, len(packed), BLOCK_BITS // 8)
        ones = np.add.reduceat(np.bitwise_count(packed), starts, dtype=np.uint64) if n else np.empty(0, np.uint64)
        ones_before.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(ones)))[:-1].astype("<u8"))
        step = BLOCK_BITS // 8
        blocks += [_compress(packed[i : i + step].tobytes()) for i in range(0, len(packed), step)]
        low = values.compress(~mask)
        zeros.append(len(low))
        values = np.concatenate((low, values.compress(mask)))
    sections = [
        np.array([len(b) for b in blocks], "<u4").tobytes(),
        b"".join(x.tobytes() for x in ones_before),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array(lengths, "<i8").tobytes(),
    ]
    packed_sections = [_compress(s) for s in sections]
    header = json.dumps(
        {
            "tokens": n,
            "planes": planes,
            "documents": len(doc_ids),
            "zeros": zeros,
            "block_bits": BLOCK_BITS,
            "codec": CODEC,
            "sections": [[len(p), len(s)] for p, s in zip(packed_sections, sections)],
        }
    ).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *packed_sections, *blocks])


class WaveletShard:
    """Reads a shard's file; blocks are decompressed when they are needed."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack_from("<I", content, 4)
        head = json.loads(content[8 : 8 + size])
        at, parts = 8 + size, []
        for packed, plain in head["sections"]:
            parts.append(pa.decompress(content[at : at + packed], plain, codec=head["codec"], asbytes=True))
            at += packed
        self.content, self.codec, self.block_bits = content, head["codec"], head["block_bits"]
        self.n, self.planes, self.zeros = head["tokens"], head["planes"], head["zeros"]
        self.per_plane = -(-self.n // self.block_bits)
        sizes = np.frombuffer(parts[0], "<u4").astype(np.int64)
        self.places = at + np.concatenate(([0], np.cumsum(sizes)))
        self.ones_before = np.frombuffer(parts[1], "<u8").astype(np.int64).reshape(self.planes, -1)
        nulls = np.frombuffer(parts[3], "u1")
        self.doc_ids = [None if gone else int(d) for d, gone in zip(np.frombuffer(parts[2], "<i8"), nulls)]
        self.lengths = np.frombuffer(parts[4], "<i8")
        self._block = lru_cache(maxsize=4 * self.planes)(self._read_block)

    def _read_block(self, level: int, block: int) -> np.ndarray:
        k = level * self.per_plane + block
        bits = min(self.block_bits, self.n - block * self.block_bits)
        raw = pa.decompress(
            self.content[self.places[k] : self.places[k + 1]], -(-bits // 8), codec=self.codec, asbytes=True
        )
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=bits, bitorder="little")

    def _plane(self, level: int) -> np.ndarray:
        found = [self._read_block(level, k) for k in range(self.per_plane)]
        return np.concatenate([*found, np.empty(0, np.uint8)]).view(bool)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, inside = divmod(i, self.block_bits)
        if block == self.per_plane:
            return self.n - self.zeros[level]
        before = int(self.ones_before[level, block])
        return before + int(np.count_nonzero(self._block(level, block)[:inside])) if inside else before

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.planes):
            block, inside = divmod(i, self.block_bits)
            bit = int(self._block(level, block)[inside])
            ones = self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, value: int, stop: int) -> tuple[int, int]:
        """Below the last plane: where the occurrences of ``value`` begin, and end for those before ``stop``."""
        if value < 0 or value >> self.planes:
            return 0, 0
        start = 0
        for level in range(self.planes):
            low, high = self._ones(level, start), self._ones(level, stop)
            if value >> (self.planes - 1 - level) & 1:
                start, stop = self.zeros[level] + low, self.zeros[level] + high
            else:
                start, stop = start - low, stop - high
        return start, stop

    def rank(self, value: int, i: int) -> int:
        """How often ``value`` occurs before position ``i``."""
        start, stop = self._range(value, min(max(i, 0), self.n))
        return stop - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _select_bit(self, level: int, bit: int, j: int) -> int:
        """Position of the ``j``-th (from 0) bit of this kind in a plane."""
        before = self.ones_before[level]
        if not bit:
            before = np.arange(self.per_plane) * self.block_bits - before
        block = int(np.searchsorted(before, j, "right")) - 1
        places = np.flatnonzero(self._block(level, block) == bit)
        return block * self.block_bits + int(places[j - int(before[block])])

    def select(self, value: int, j: int) -> int:
        """Position of the ``j``-th (from 0) occurrence of ``value``."""
        start, stop = self._range(value, self.n)
        if not 0 <= j < stop - start:
            raise IndexError(j)
        at = start + j
        for level in range(self.planes - 1, -1, -1):
            bit = value >> (self.planes - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, j) for j in range(self.count(value))]

    def tokens(self) -> np.ndarray:
        """All ids in order: the parting of each plane is undone, from the lowest up."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for level in range(self.planes - 1, -1, -1):
            mask, zeros = self._plane(level), self.zeros[level]
            merged = np.empty_like(values)
            merged[np.flatnonzero(mask)] = values[zeros:] | kind(1 << (self.planes - 1 - level))
            merged[np.flatnonzero(~mask)] = values[:zeros]
            values = merged
        return values
