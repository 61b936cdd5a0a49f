import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_fixtures import edge_rows, make_docs  # noqa: F401
from tokenizers import Tokenizer

from tallyline.llm.token_shards import PieceEncoder, token_shards, write_shards
from tallyline.llm.wavelet import WaveletShard, encode

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n, top, kind", [(0, 1, np.uint16), (1, 1, np.uint16), (200_000, 50_257, np.uint16), (70_000, 90_000, np.uint32)])
def test_round_trip_and_queries(n, top, kind):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), top - 1).astype(kind)
    shard = WaveletShard(encode(ids, [5, None], [n, 0]))
    assert (shard.tokens() == ids).all() and shard.doc_ids == [5, None]
    for value in {*ids[:3].tolist(), 1, 17, top + 5}:
        places = np.flatnonzero(ids == value)
        assert shard.count(value) == len(places)
        assert shard.rank(value, n // 2) == (places < n // 2).sum()
        for j in {0, len(places) // 2, len(places) - 1} & set(range(len(places))):
            assert shard.select(value, j) == places[j]
        with pytest.raises(IndexError):
            shard.select(value, len(places))
    for i in {0, n // 3, n - 1} & set(range(n)):
        assert shard.access(i) == ids[i]


def test_pieces_are_encoded_as_the_library_does():
    texts = ["", " a", "a ", "a  b", "a \n b", "x\n\ny", "a.\nb", "I'll don't 'tis x's's", "1,234.5 (a)b", "é,è\nß", "a\x01b c",
             "<|endoftext|> a<|endoftext|>b", "tab\there", "a b  c d", "z" * 5000, None, "!?\n\n", "a's, b'd."]
    expected = Tokenizer.from_file(VOCABULARY).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [x.tolist() for x in PieceEncoder(VOCABULARY).encode(pa.array(texts))] == [e.ids for e in expected]


def test_documents_in_order(make_docs, edge_rows):
    library = Tokenizer.from_file(VOCABULARY)
    found = token_shards(make_docs(edge_rows), VOCABULARY, 2).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10]
    at = 0
    for row, (_, text) in zip(found, edge_rows):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)


def test_a_hot_id_and_small_shards(make_docs, tmp_path):
    docs = make_docs([(1, f"text number {k}") for k in range(50)])
    manifest = write_shards(docs, f"file://{tmp_path}/shards", VOCABULARY, 2, shard_tokens=10)
    assert manifest.agg({"documents": "sum"}).first()[0] == 50
    assert not [p for p in (tmp_path / "shards").iterdir() if p.name.startswith("_")]


def test_no_documents(make_docs):
    assert token_shards(make_docs([]), VOCABULARY, 2).count() == 0
