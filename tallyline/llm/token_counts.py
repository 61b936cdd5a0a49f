"""Token counts of whole texts by rank-synchronous array merging.

A slice of texts is normalised and pre-tokenised as Arrow arrays; its distinct pieces are looked up in a bounded
per-worker memory of counts. What is new is held as one ragged array of symbols, on which every round applies each
sequence's lowest-rank pair at all its places at once, until no pair is left.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyline.llm.words import numbered_words, slices

REMEMBERED = 400_000
NO_RANK = np.int32(2**31 - 1)

# White space that a byte-wise \\s does not know, and the pattern's parts that no letter or digit run can hold.
WIDE_SPACE = r"\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
OTHER_SPACE = rf"\x{{1c}}-\x{{1f}}{WIDE_SPACE}"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SEPARATE = rf"('s|'t|'re|'ve|'m|'ll|'d|[^\s\pL\pN{WIDE_SPACE}]+)"
ONE_PIECE = rf"^(\pL+|\pN|[^\s\pL\pN{OTHER_SPACE}]+)$"


@cache
def unsure_letters() -> str:
    """A pattern of the characters that libraries with different Unicode versions take differently.

    These are the ones that no version here has assigned, and those whose class or lower case differs between them.
    """
    characters = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    kinds = [unicodedata.category(c) for c in characters]
    assigned = [k != "Cn" for k in kinds]
    known = pa.array([c for c, a in zip(characters, assigned) if a])
    joined = "".join(known.to_pylist())
    differs = np.zeros(len(known), bool)
    for kind in "LN":
        here = np.array([k[0] == kind for k, a in zip(kinds, assigned) if a])
        theirs = pc.match_substring_regex(known, rf"\p{kind}").to_numpy(zero_copy_only=False)
        others = set(regex.findall(rf"\p{{{kind}}}", joined))
        differs |= (here != theirs) | (here != np.array([c in others for c in joined]))
    low = pc.utf8_lower(known).to_pylist()
    differs |= np.array([c.lower() != x and c != "\u0130" for c, x in zip(joined, low)])
    unsure = np.ones(len(characters), bool)
    unsure[np.flatnonzero(assigned)] = differs
    codes = np.array([ord(c) for c in characters])[unsure]
    runs = np.split(codes, np.flatnonzero(np.diff(codes) != 1) + 1)
    return "[" + "".join(rf"\x{{{r[0]:x}}}-\x{{{r[-1]:x}}}" for r in runs) + "]"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free letter from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(free)
            free += 1
    return [letters[b] for b in range(256)]


class PairRanks:
    """Rank and product of a pair of symbols, looked up for whole arrays: a hash table whose chains are levels."""

    BITS = 18

    def __init__(self, pairs: list[tuple[int, int]], products: list[int]):
        keys = np.array([(a << 32) | b for a, b in pairs], np.uint64)
        slots = self._slots(keys)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.products = np.array([*products, 0], np.int32)
        left = np.arange(len(keys))
        while len(left):
            _, first = np.unique(slots[left], return_index=True)
            here = left[first]
            table_keys = np.full(1 << self.BITS, 2**64 - 1, np.uint64)
            table_ranks = np.full(1 << self.BITS, NO_RANK, np.int32)
            table_keys[slots[here]], table_ranks[slots[here]] = keys[here], here
            self.levels.append((table_keys, table_ranks))
            left = np.setdiff1d(left, here)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots = self._slots(keys)
        found = np.full(len(keys), NO_RANK, np.int32)
        for table_keys, table_ranks in self.levels:
            found = np.where(table_keys[slots] == keys, table_ranks[slots], found)
        return found


class MergeCounter:
    """Counts the tokens that a byte-level merge vocabulary with word ends gives."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        pattern = split["pattern"]["Regex"] if split["type"] == "Split" else None
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or pattern != PATTERN:
            raise ValueError(f"{path} is not a lower-casing merge vocabulary with the known split pattern")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = PairRanks([(vocab[a], vocab[b]) for a, b in merges], [vocab[a + b] for a, b in merges])
        letters = byte_letters()
        self.byte_of = {letter: byte for byte, letter in enumerate(letters)}
        self.library = Tokenizer.from_file(path)
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int32)
        self.pattern = regex.compile(pattern)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special_strings = special
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def count_sequences(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each nonempty byte sequence after all merges."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        counts, owner = sizes.copy(), np.arange(len(words))
        while len(symbols):
            starts = ends - sizes
            ranks = np.full(len(symbols), NO_RANK, np.int32)
            ranks[:-1] = self.pairs.ranks(symbols[:-1], symbols[1:])
            ranks[ends - 1] = NO_RANK
            lowest = np.minimum.reduceat(ranks, starts)
            merge = ranks == np.repeat(lowest, sizes)
            merge[ends - 1] = False
            merge &= ranks != NO_RANK
            # Of overlapping places (a run of one symbol) every second one counts, from the left.
            at = np.flatnonzero(merge)
            if len(at):
                new_run = np.concatenate(([True], np.diff(at) != 1))
                run_start = at[np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))]
                at = at[(at - run_start) % 2 == 0]
            symbols[at] = self.pairs.products[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            live = lowest != NO_RANK
            counts[owner] -= np.add.reduceat(~keep, starts)
            keep &= np.repeat(live, sizes)
            symbols = symbols[keep]
            owner = owner[live]
            sizes = counts[owner]
            ends = np.cumsum(sizes)
        return counts

    def _pieces(self, text: str) -> tuple[int, list[bytes]]:
        """Number of special strings in a text, and the library's pieces of what lies between them."""
        parts = self.special.split(text) if self.special else [text]
        found = []
        for part in parts:
            normal = self.library.normalizer.normalize_str(part)
            for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                found.append(bytes(self.byte_of[c] for c in piece))
        return len(parts) - 1, found

    def count_chunks(self, chunks: pa.Array) -> np.ndarray:
        """Tokens of each normalised chunk: one piece, or several that the pattern tells apart."""
        whole = pc.match_substring_regex(chunks, ONE_PIECE).to_numpy(zero_copy_only=False)
        names = chunks.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        parts = {c: self.pattern.findall(c) for c, one in zip(names, whole.tolist()) if not one and c not in known}
        unseen = {c for c, one in zip(names, whole.tolist()) if one and c not in known}
        unseen.update(p for pieces in parts.values() for p in pieces if p not in known)
        if unseen:
            new = list(unseen)
            known.update(zip(new, self.count_sequences([p.encode() for p in new]).tolist()))
        known.update([(c, sum(known[p] for p in pieces)) for c, pieces in parts.items()])
        return np.fromiter(map(known.__getitem__, names), np.int64, len(names))

    def count_texts(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, unsure_letters()).to_numpy(zero_copy_only=False)
        for token in self.special_strings:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        counts = np.zeros(len(texts), np.int64)
        for k in np.flatnonzero(odd):
            special, pieces = self._pieces(texts[k].as_py())
            counts[k] = special + (int(self.count_sequences(pieces).sum()) if pieces else 0)
        if odd.any():
            texts = pc.if_else(pa.array(odd), "", texts)
        # Below U+0300 there is nothing to compose.
        high = pc.match_substring_regex(texts, r"[\x{300}-\x{10ffff}]")
        if pc.any(high).as_py():
            composed = [unicodedata.normalize("NFC", t) for t in texts.filter(high).to_pylist()]
            texts = pc.replace_with_mask(texts, high, pa.array(composed, texts.type))
        # Lower case letter by letter; this letter alone becomes two.
        low = pc.utf8_lower(pc.replace_substring(texts, "\u0130", "i\u0307"))
        codes, distinct, offsets = numbered_words(pc.replace_substring_regex(low, SEPARATE, r" \1 "), lower=False)
        per_word = self.count_chunks(distinct)[codes]
        total = np.concatenate(([0], np.cumsum(per_word)))
        return np.where(odd, counts, total[offsets[1:]] - total[offsets[:-1]])


@cache
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, without begin and end tokens.

    ``vocabulary`` is a tokenizer file that every executor has under this path. A null or empty text has 0 bytes
    and 0 tokens; rows that repeat are counted each; a null doc_id stays null; an empty table gives an empty result. Further columns
    are ignored. One row is read at a time beyond ``SLICE_BYTES`` of text.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merge_counter(vocabulary)
        for piece in slices(batches):
            texts = piece.column("text")
            counts = counter.count_texts(texts)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), sizes, pa.array(counts), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
