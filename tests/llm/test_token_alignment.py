from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from llm_fixtures import SF, edge_rows, make_docs  # noqa: F401
from tallyline.llm import token_alignment
from tallyline.llm.token_alignment import aligned_tokens, aligner

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def expected(rows):
    """Token by token, with sets of ends."""
    a, b, letters = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_of()
    a.encode_special_tokens = True
    names = {k: v for v, k in a.get_vocab().items()}
    found, links = [], Counter()
    for doc_id, text in rows:
        ids = a.encode(" " + text, add_special_tokens=False).ids if text else []
        other = b.encode(text) if text else []
        left = [bytes(letters[c] for c in names[k]) for k in ids]
        right = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in other]
        if not text or b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            found.append((doc_id, 0, 0, [], ""))
            continue
        groups, pairs, i, j = [], [], 0, 0
        while i < len(ids):
            x, y, sizes = [], [], [0, 0]
            while not x or sizes[0] != sizes[1]:
                if sizes[0] <= sizes[1]:
                    x.append(ids[i])
                    sizes[0] += len(left[i])
                    i += 1
                else:
                    y.append(other[j])
                    sizes[1] += len(right[j])
                    j += 1
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            pairs.append((x[-1], y[-1]))
        links.update(pairs)
        found.append((doc_id, len(ids), len(other), pairs, sha256(";".join(groups).encode()).hexdigest()))
    highest = defaultdict(int)
    for (_, y), n in links.items():
        highest[y] = max(highest[y], n)
    return Counter(
        (d, n, m, len(pairs), len(pairs), sum(links[p] == highest[p[1]] for p in pairs), sum(links[p] for p in pairs), digest)
        for d, n, m, pairs, digest in found
    )


MORE = [
    (20, "two  spaces, \t\ttabs\n\n\nlines  nbsp"), (21, "a mark ▁ stands here"), (22, "<s></s><unk><0x41> <|endoftext|>x"), (23, "é́ ﬁ ½ ǅ 你好 ​﻿"),
    (24, "e" * 500 + "ee" * 77), (25, " lead and trail "), (26, "\x00\x01\x7f"), (27, "ﷺ𓀀𝔘🏳️‍🌈"), (28, "\r\n\r\n"),
]


@pytest.mark.parametrize("share", [token_alignment.FREQUENT_SHARE, 0.01, 1.0])
def test_edge_rows(make_docs, edge_rows, monkeypatch, share):
    monkeypatch.setattr(token_alignment, "FREQUENT_SHARE", share)
    rows = edge_rows + MORE
    assert Counter(map(tuple, aligned_tokens(make_docs(rows), A, B).collect())) == expected(rows)


def test_real_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = aligned_tokens(docs, A, B)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, found.collect())) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty_table(make_docs, edge_rows):
    assert aligned_tokens(make_docs(edge_rows).limit(0), A, B).collect() == []
    assert [r["n_a"] for r in aligned_tokens(make_docs([(1, None), (2, "")]), A, B).collect()] == [0, 0]


def test_same_bytes_go_to_the_piece_not_the_single_byte():
    both = aligner(A, B)
    for k, x in enumerate(both.a_bytes):
        if both.same[k] >= 0:
            assert both.b_bytes[both.same[k]] == x
    letter = both.a_bytes.index(b"e")
    assert not both.b.is_byte(int(both.same[letter]))
