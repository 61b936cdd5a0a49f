"""Whole texts as arrays of words inside a task: splitting, numbering, 64-bit hashes, shingle sets.

Every function works on one slice of an Arrow batch, so memory is bounded by ``SLICE_BYTES`` of text
(or by one text, where a single text is longer).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
SHINGLE = 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(12345).integers(1, 2**63, 256, dtype=np.uint64)
_SHINGLE_CODES = np.random.default_rng(54321).integers(1, 2**62, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` one after another, and where each text's words begin and end.

    A null text has no words. ``lower`` maps A-Z to a-z.
    """
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = parts.values, parts.offsets.to_numpy().astype(np.int64)
    flat = flat.slice(offsets[0], offsets[-1] - offsets[0])
    offsets -= offsets[0]
    keep = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not keep.all():
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        flat = flat.filter(pa.array(keep))
    return flat, offsets


def numbered_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Per word its number, the distinct words, and where each text's words begin and end."""
    flat, offsets = split_words(texts, lower)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, offsets


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hash of each string's bytes, the same in every task."""
    if not len(strings):
        return np.empty(0, _U)
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    first, last = ends[0], ends[-1]
    codes = _BYTE_CODES[np.frombuffer(data, np.uint8)[first:last]] if last > first else np.empty(0, _U)
    ends = ends - first
    powers = np.multiply.accumulate(np.full(len(codes) + 1, _BASE))
    total = np.concatenate((np.zeros(1, _U), np.cumsum(codes * powers[: len(codes)], dtype=_U)))
    back = np.multiply.accumulate(np.full(len(codes) + 1, _INVERSE))
    starts, stops = ends[:-1], ends[1:]
    return mixed((total[stops] - total[starts]) * back[starts] + (stops - starts).astype(_U) * _BASE)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per text its sorted distinct hashes of five-word shingles, of lower-cased (A-Z) words.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    codes, distinct, offsets = numbered_words(texts)
    words = string_hashes(distinct)[codes]
    n = len(words)
    if n >= SHINGLE:
        rolled = np.zeros(n - SHINGLE + 1, _U)
        for k in range(SHINGLE):
            rolled += words[k : n - SHINGLE + 1 + k] * _SHINGLE_CODES[k]
        rolled = mixed(rolled)
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if stop - start >= SHINGLE:
            yield np.unique(rolled[start : stop - SHINGLE + 1])
        elif stop > start:
            short = words[start:stop] * _SHINGLE_CODES[: stop - start]
            yield mixed(np.array([short.sum(dtype=_U) + _U(stop - start)], _U))
        else:
            yield np.empty(0, _U)
