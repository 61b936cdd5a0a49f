import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import log10
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_fixtures import SF, edge_rows, make_docs  # noqa: F401
from tallyline.llm import context_mixing, near_dedup
from tallyline.llm.components import connected_components
from tallyline.llm.context_mixing import FIRST_WEIGHT, GATES, LONG, ORDERS, Block, Code, keys_of, scored_texts
from tallyline.llm.decontamination import contained_items, without_items
from tallyline.llm.line_dedup import without_shared_lines
from tallyline.llm.mixing import fitted_rates, mixed_documents, with_rates
from tallyline.llm.near_dedup import near_duplicates, one_of_each
from tallyline.llm.token_counts import token_counts
from tallyline.llm.toxicity import toxicity
from tallyline.llm.words import shingle_sets

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z))


def words(prefix, n):
    return " ".join(f"{prefix}{k}" for k in range(n))


def shingles(text):
    w = split(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


# token counts


def test_token_counts_are_the_library_s(make_docs, edge_rows):
    library = Tokenizer.from_file(WORD_VOCABULARY)
    more = [(20, "'s''T x'll!'re 12a3 é́ ﬁ ½ ǅ á b"), (21, "<|startoftext|>A<|ENDOFTEXT|>"), (22, "ab" * 2000)]
    rows = edge_rows + more
    found = token_counts(make_docs(rows), WORD_VOCABULARY, 50).collect()
    expected = Counter()
    for d, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected[(d, len((t or "").encode()), n, n > 50)] += 1
    assert Counter(map(tuple, found)) == expected


def test_token_counts_of_real_texts(spark):
    library = Tokenizer.from_file(WORD_VOCABULARY)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in token_counts(docs, WORD_VOCABULARY).collect():
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)


# near duplicates


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, k) for k in range(201, 230)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {found[k] for k in range(41)} == {0} and found[101] == 100 and {found[k] for k in range(200, 230)} == {200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(rows, percent):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        ids[find(k)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return [(d, len(s), least[find(k)], d == least[find(k)]) for k, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 4])
def test_near_duplicates_by_brute_force(make_docs, edge_rows, monkeypatch, block):
    """Families of copies of a text around the threshold, so that many links are not with the centre."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = list(edge_rows)
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(120)]
        for copy in range(25):
            text = list(base)
            for place in rng.integers(0, 120, copy % 4):
                text[place] = f"new{rng.integers(1 << 40)}"
            rows.append((1000 + 100 * family + copy, " ".join(text)))
    found = near_duplicates(make_docs(rows), Fraction(85, 100)).select("doc_id", "n_shingles", "component_id", "kept")
    assert Counter(map(tuple, found.collect())) == Counter(brute_components(rows, 85))


def test_one_of_each_keeps_columns_and_unlinked_rows(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    kept = one_of_each(docs, Fraction(80, 100))
    assert kept.columns == docs.columns
    # 6 (twice) repeats 5; 7 has one word more.
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8, 9, 10]
    assert near_duplicates(make_docs([])).count() == one_of_each(make_docs([])).count() == 0


def test_match_threshold():
    t = near_dedup.match_threshold(Fraction(85, 100))
    assert 36 <= t <= 42 and near_dedup.match_threshold(Fraction(1)) == 64


def test_shingle_sets_are_those_of_the_words(edge_rows):
    found = list(shingle_sets(pa.array([t for _, t in edge_rows])))
    for a, (_, x) in zip(found, edge_rows):
        for b, (_, y) in zip(found, edge_rows):
            assert len(np.intersect1d(a, b)) == len(shingles(x) & shingles(y))


# decontamination


def test_contained_items_by_brute_force(spark, make_docs, edge_rows):
    item = words("bench", 40)
    most = " ".join(w if k != 20 else "other" for k, w in enumerate(item.split()))
    few = " ".join(w if k % 7 else "other" for k, w in enumerate(item.split()))
    rows = edge_rows + [(30, words("a", 9000) + " " + item.upper() + " " + words("b", 9000)), (31, most), (32, few), (33, item), (33, item)]
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "Four little words here"), (5, words("w", 12)), (None, words("long", 17))]
    frame = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, shingles int")

    def letters(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    expected = set()
    for d, t in rows:
        for i, x in items:
            s = letters(x)
            if s and 100 * len(s & letters(t)) >= 80 * len(s):
                expected.add((d, i, len(s), len(s & letters(t))))
    docs = make_docs(rows)
    found = contained_items(docs, frame).select("doc_id", "item_id", "n_item", "n_shared").collect()
    assert len(found) == len(set(found)) and set(map(tuple, found)) == expected and (30, 1, 36, 36) in expected
    bad = {d for d, *_ in expected}
    clean = without_items(docs, frame)
    assert clean.columns == docs.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(d for d, _ in rows if d not in bad)
    assert contained_items(make_docs([]), frame).count() == 0
    assert contained_items(docs, frame.limit(0)).count() == 0


# lines


def test_shared_lines_by_brute_force(spark):
    rows = [(k, f"site{k % 9}" if k % 11 else None, f"own {k}\n  footer line \n\nrare {k % 3}\nmid {k % 20}") for k in range(60)]
    rows += [(100, "site1", None), (101, "site2", ""), (101, "site2", ""), (None, "site3", "footer line")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, text string, gone int")
    sites = defaultdict(set)
    for _, site, text in rows:
        for line in (text or "").split("\n"):
            if site:
                sites[line.strip(" ")].add(site)
    for least in (1, 2, 5, 9):
        expected = Counter()
        for d, _, text in rows:
            lines = text.split("\n") if text is not None else []
            kept = [x for x in lines if not (x.strip(" ") and len(sites[x.strip(" ")]) >= least)]
            expected[(d, len(lines), len(lines) - len(kept), "\n".join(kept) if text is not None else None)] += 1
        assert Counter(map(tuple, without_shared_lines(docs, "source", least).collect())) == expected
    assert without_shared_lines(docs.limit(0)).count() == 0


# context mixing


def test_base_scores_and_code_lengths(make_docs, edge_rows):
    rows = edge_rows + [(100 + k, f"common words and word{k % 5} again and again {k}") for k in range(60)]
    found = scored_texts(make_docs(rows)).collect()
    held = {d: crc32(str(d).encode() if d is not None else b"") % 10 == 0 for d, _ in rows}
    counts = Counter(w for d, t in rows if not held[d] for w in [*split(t), ""])
    total, size = sum(counts.values()), len(counts)
    expected = Counter()
    for d, t in rows:
        w = [*split(t), ""]
        base = sum(log10((counts[x] + 0.1) / (total + 0.1 * (size + 1))) for x in w)
        expected[(d, held[d], len(w), sum(counts[x] > 0 for x in w), total, round(base, 6))] += 1
    assert Counter((*r[:5], round(r["base_score"], 6)) for r in found) == expected
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert scored_texts(make_docs([])).count() == 0


def pieces_of(text):
    """Plainly: up to and with a white-space byte or the end, 24 bytes at most."""
    found = [b""]
    for x in (text or "").translate(A_TO_Z).encode() + b"\xff":
        found[-1] += bytes([x])
        if x in b" \t\n\v\f\r\xff" or len(found[-1]) == LONG:
            found.append(b"")
    return [f for f in found if f]


def contexts_of(piece, i):
    padded = (256,) * max(ORDERS) + tuple(piece)
    return [(k, padded[i + max(ORDERS) - k : i + max(ORDERS)]) for k in ORDERS] + [("piece", piece[:i])]


def subtrees(code):
    paths = defaultdict(set)
    for symbol in range(256):
        for j in range(code.first[symbol], code.first[symbol] + code.lengths[symbol]):
            paths[int(code.nodes[j]), int(code.bits[j])].add(symbol)
    return paths


def test_keys_spell_the_texts(edge_rows):
    texts = [t for _, t in edge_rows] + ["a" * 23 + " b", "a" * 24 + "\n", "é" * 40, " \t x  "]
    keys, text_of = keys_of(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        mine = [key.as_py() for key, t in zip(keys, text_of) if t == k]
        assert sorted(key[1:] for key in mine if key[0] < 2) == sorted(pieces_of(text))
        whole = [key[1:-1].decode() for key in mine if key[0] == 0 and len(key) > 2]
        assert Counter(whole + [key[1:].decode() for key in mine if key[0] == 2]) == Counter(split(text))


def block_of(counts, code):
    """One block of all pieces, with the counts of the contexts that other blocks may share."""
    keys = [b"\x00" + p for p in sorted(counts)]
    pieces = pa.table({"key": pa.array(keys, pa.binary()), "c": [counts[k[1:]] for k in keys]})
    places = context_mixing.Places(pieces.column("key").combine_chunks())
    rows = defaultdict(Counter)
    for k, at in context_mixing._shared(places):
        for pair, piece in zip(places.pairs[k][at].tolist(), places.piece[at].tolist()):
            rows[pair >> 8][pair & 255] += counts[keys[piece][1:]]
    found = pa.table(
        {
            "context": pa.array(list(rows), pa.int64()),
            "symbols": pa.array([list(r) for r in rows.values()], pa.list_(pa.int16())),
            "counts": pa.array([list(r.values()) for r in rows.values()], pa.list_(pa.int64())),
        }
    )
    return Block(pieces, found, code)


def test_model_is_a_probability_and_learns():
    rng = np.random.default_rng(3)
    counts = Counter(bytes(rng.choice(list(b"abc"), rng.integers(1, 5)).tolist()) + b" " for _ in range(400))
    code = Code(np.bincount(list(b"".join(counts.elements())), minlength=256))
    assert sum(2.0 ** -code.lengths) == 1.0
    weights = rng.normal(0.3, 0.2, (GATES, len(ORDERS) + 1))
    # Pieces without an occurrence: every byte that may follow a beginning.
    for begin in (b"", b"ab", b"zz"):
        trial = Counter(counts)
        trial.update({begin + bytes([x]): 0 for x in range(256)} | {begin: 0} if begin else {bytes([x]): 0 for x in range(256)})
        block = block_of(trial, code)
        cost = {k.as_py()[1:]: c for k, c in zip(block.keys, block.costs(weights))}
        before = cost[begin] if begin else 0
        assert np.allclose(sum(2.0 ** (before - cost[begin + bytes([x])]) for x in range(256)), 1)
    block = block_of(counts, code)
    learned = context_mixing.merged_weights(*block.learned())

    def left_out(weights):
        total = 0
        for x, bits, gates, piece in block.chunks(without_own=True):
            margin = (x * weights[gates]).sum(axis=1) * (bits * 2.0 - 1)
            total += (block.times[piece] * np.log1p(np.exp(-margin))).sum()
        return total

    assert left_out(learned) < 0.98 * left_out(np.full(learned.shape, FIRST_WEIGHT))


def test_scores_are_the_plain_ones(make_docs, edge_rows, monkeypatch):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(60)]
    # The text of 30,000 different words takes the plain way too long.
    rows = [r for r in edge_rows if r[0] != 8]
    rows += [(100 + k, " ".join(rng.choice(vocabulary, 15))) for k in range(40)] + [(300, "x" * 60), (301, "x" * 50)]
    weights = rng.normal(0.3, 0.1, (GATES, len(ORDERS) + 1))
    # Many small blocks, so that beginnings of pieces are shared between blocks; weights as given.
    monkeypatch.setattr(context_mixing, "BLOCK_PIECES", 20)
    monkeypatch.setattr(context_mixing, "merged_weights", lambda *_: weights)
    held = {d: crc32(str(d).encode() if d is not None else b"") % 10 == 0 for d, _ in rows}
    seen, symbols = defaultdict(Counter), Counter()
    for d, t in rows:
        for piece in [] if held[d] else pieces_of(t):
            for i, symbol in enumerate(piece):
                symbols[symbol] += 1
                for context in contexts_of(piece, i):
                    seen[context][symbol] += 1
    code = Code(np.array([symbols[x] for x in range(256)]))
    under = subtrees(code)
    known = {}

    def bits(piece):
        if piece not in known:
            total = np.zeros(len(context_mixing.SHARPNESSES))
            for i, symbol in enumerate(piece):
                for j in range(code.first[symbol], code.first[symbol] + code.lengths[symbol]):
                    node, bit = int(code.nodes[j]), int(code.bits[j])
                    n = [[sum(seen[c][x] for x in under[node, b]) for b in (0, 1)] for c in contexts_of(piece, i)]
                    gate = min(int(np.log2(sum(n[-1]) + 1)), GATES - 1)
                    odds = sum(w * np.log((one + 0.4) / (zero + 0.4)) for w, (zero, one) in zip(weights[gate], n))
                    total += [np.log2(1 + np.exp(-s * odds * (2 * bit - 1))) for s in context_mixing.SHARPNESSES]
            known[piece] = total
        return known[piece]

    expected = Counter()
    for d, t in rows:
        total = sum(bits(p) for p in pieces_of(t))
        expected[(d, round(float(np.log10(np.mean(2.0 ** (total.min() - total))) - total.min() * np.log10(2)), 3))] += 1
    assert Counter((r["doc_id"], round(r["score"], 3)) for r in scored_texts(make_docs(rows)).collect()) == expected


def test_seen_texts_score_better(make_docs):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(30)]
    rows = [(k, " ".join(rng.choice(vocabulary, 40))) for k in range(200)]
    rows += [(1000 + k, "".join(rng.choice(list("abcdefgh "), 280))) for k in range(40)]
    found = {r["doc_id"]: r for r in scored_texts(make_docs(rows)).collect()}
    like = [found[k]["bits_per_byte"] for k in range(200) if found[k]["held_out"]]
    unlike = [found[1000 + k]["bits_per_byte"] for k in range(40) if found[1000 + k]["held_out"]]
    assert np.mean(like) < 1.2 < np.mean(unlike)


# toxicity


def test_toxic_documents_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = labels.where("doc_id % 3 <> 0")
    found = toxicity(docs, known).join(labels.where("doc_id % 3 = 0"), "doc_id").groupBy("toxic", "rejected").count()
    n = {(r["toxic"], r["rejected"]): r["count"] for r in found.collect()}
    assert n.get((0, True), 0) <= 0.01 * n[(0, False)]
    # Two in five toxic labels here are on texts without any telling word.
    assert n.get((1, True), 0) >= 0.55 * (n.get((1, True), 0) + n.get((1, False), 0))


def test_toxicity_edges(spark, make_docs, edge_rows):
    labels = spark.createDataFrame([(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = make_docs(edge_rows).withColumn("p_toxic", F.lit("old"))
    found = toxicity(docs, labels)
    assert found.count() == len(edge_rows) and found.where("rejected").count() == 0
    assert toxicity(docs.limit(0), labels).count() == 0


# mixing


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(8)
    p = rng.beta(0.4, 0.4, 400)
    rows = [(k, 1 + k % 3, float(rng.integers(1, 900)), float(x), float(1 - x)) for k, x in enumerate(p)]
    texts = spark.createDataFrame(rows, "text_key long, m long, n double, p0 double, p1 double")
    shares = []
    for least in (0.0, 1.0):
        got = fitted_rates(texts, [0.8, 0.2], least).toPandas()
        mass = got.m * got.n * got.rate
        tokens = np.array([(mass * got.p0).sum(), (mass * got.p1).sum()])
        shares.append(tokens[0] / tokens.sum())
        assert got.rate.min() >= least
    # Rates of one at least leave less room than rates of zero.
    assert abs(shares[0] - 0.8) < 1e-3 and 0.7 < shares[1] < 0.81


@pytest.mark.parametrize(
    "posterior, targets, least",
    [
        ((4.0, 2.0), (0.5, 0.5), 0.0),
        ((4.0, 2.0), (0.3, 0.7), 0.0),
        ((6.0, 2.0, 0.05), (0.88, 0.11, 0.01), 0.0),
        ((6.0, 2.0, 0.05), (0.88, 0.12, 0.0), 0.0),
        ((4.0, 2.0, 0.5), (0.2, 0.4, 0.4), 1.0),
        ((40.0, 20.0), (0.1, 0.9), 0.0),
    ],
)
def test_rates_of_soft_rare_and_zero_domains(spark, posterior, targets, least):
    rng = np.random.default_rng(9)
    p = rng.dirichlet(posterior, 1500)
    rows = [(k, 1 + k % 3, float(rng.integers(1, 900)), *map(float, x)) for k, x in enumerate(p)]
    schema = "text_key long, m long, n double, " + ", ".join(f"p{k} double" for k in range(len(targets)))
    got = fitted_rates(spark.createDataFrame(rows, schema), list(targets), least).toPandas()
    p = got[[f"p{k}" for k in range(len(targets))]].to_numpy()
    mass, rate = (got.m * got.n).to_numpy(), got.rate.to_numpy()
    total, have = mass.sum(), mass @ p
    size = max([total, *(least * h / t for h, t in zip(have, targets) if t > 0)])
    goals = np.array(targets) * size
    tokens = (mass * rate) @ p
    if least == 0 and posterior[0] < 10:
        assert np.abs(tokens - goals).max() < 2e-3 * total
    # At the optimum no rate can move: the slope is 0, or above 0 where the rate is at its least.
    slope = p @ ((tokens - goals) / np.maximum(goals, 0.01 * size)) + 1e-5 * (rate - 1)
    assert np.abs(slope[rate > least + 1e-6]).max() < 2e-5 and slope.min() > -2e-5


def test_mixing_edges(spark, make_docs, edge_rows):
    labels = spark.createDataFrame([(5, "a"), (8, "b"), (9, None), (4, "other")], "doc_id long, domain string")
    docs = make_docs(edge_rows).withColumn("rate", F.lit("old"))
    rated = with_rates(docs, labels, {"a": 0.7, "b": 0.3}).collect()
    assert len(rated) == len(edge_rows) and all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in rated)
    mixed = mixed_documents(docs, labels, {"a": 0.7, "b": 0.3}, least=1.0)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) >= Counter(d for d, _ in edge_rows)
    assert with_rates(docs.limit(0), labels, {"a": 1.0}).count() == 0
    assert with_rates(docs, labels.limit(0), {"a": 0.5, "b": 0.5}).count() == len(edge_rows)
