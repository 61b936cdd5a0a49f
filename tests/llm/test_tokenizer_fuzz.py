"""Seeded random texts against the tokenizers library."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyline.llm.token_counts import merge_counter, unsure_letters
from tallyline.llm.token_shards import PieceEncoder

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SPACES = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2009",
          "\u200a", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\u200b", "\ufeff", "\u180e"]
MARKS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "'LL", "'", "\u2019s", ".", "!?", "<|endoftext|>", "<|startoftext|>", "<|end", "|>", "_", "-", "\x00"]
WORDS = ["the", "cat", "It", "Isn", "we", "12", "3", "\u00bd", "\u00e9", "e\u0301", "\u0130stanbul", "\u03a3\u03af\u03c3\u03c5\u03c6\u03bf\u03a3", "\u4f60\u597d",
         "\U0001f389", "\ua7cb", "\ua7cc", "\ua7dc", "\u1c89", "\U00010d50", "\U0001c000", "\u01c5", "\ufb01", "\u0345", "\u1f80", "\u212a", "\u212b", "\u1e9e",
         "\u0e01\u0e33", "\uac00\u1100\u1161", "\u0660", "\u2167", "\u24b6", "\U0001d400", "\u0378", "\ue000", "\U0010ffff", "\ufffd"]


def texts(seed, n):
    pick = random.Random(seed)
    for _ in range(n):
        parts = [pick.choice(pick.choice((SPACES, MARKS, WORDS, WORDS))) for _ in range(pick.randint(1, 12))]
        if pick.random() < 0.5:
            parts.insert(pick.randint(0, len(parts)), "".join(chr(pick.choice((pick.randint(1, 0x2FF), pick.randint(0x300, 0xD7FF), pick.randint(0xE000, 0x2FFFF)))) for _ in range(3)))
        yield "".join(parts)


@pytest.mark.parametrize("seed", range(4))
def test_counts(seed):
    library, found = Tokenizer.from_file(WORD_VOCABULARY), list(texts(seed, 12_000))
    counts = merge_counter(WORD_VOCABULARY).count_texts(pa.array(found)).tolist()
    wanted = [len(e.ids) for e in library.encode_batch(found, add_special_tokens=False)]
    assert [(t, a, b) for t, a, b in zip(found, counts, wanted) if a != b] == []


@pytest.mark.parametrize("text", ["the\u00a0's cat", "\u00a0're", "it!\u00a0's", "\ua7cb<|endoftext|>", "\ua7cc'll", "x\x0b'll", "\x1c"])
def test_known_counts(text):
    library = Tokenizer.from_file(WORD_VOCABULARY)
    assert merge_counter(WORD_VOCABULARY).count_texts(pa.array([text])).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("seed", range(2))
def test_ids(seed, plain):
    library, found, encoder = Tokenizer.from_file(BYTE_VOCABULARY), list(texts(100 + seed, 12_000)), PieceEncoder(BYTE_VOCABULARY)
    library.encode_special_tokens = encoder.tokenizer.encode_special_tokens = plain
    ids = encoder.encode(pa.array(found))
    wanted = [e.ids for e in library.encode_batch(found, add_special_tokens=False)]
    assert [t for t, a, b in zip(found, ids, wanted) if a.tolist() != b] == []


def test_common_letters_are_sure():
    import regex

    assert not regex.search(regex.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), unsure_letters()), "éßñçüΣЖ你好가ا१🎉\u2019\u00a0")
