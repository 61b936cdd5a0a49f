from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyline.llm.merkle import merkle_manifest, proof_digest

SCHEMA = "doc_id long, text string, source string, lang string, n_chars int, tree string, digest long, steps string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(leaves):
    """The top, and each leaf's siblings (before, after) a level."""
    steps, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 3] for k in range(0, len(nodes), 3)]
        for k, place in enumerate(at):
            run, slot = runs[place // 3], place % 3
            steps[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        nodes, at = [h(*run) for run in runs], [place // 3 for place in at]
    return nodes[0], steps


def expected(rows, change):
    groups = defaultdict(list)
    for d, t, s, lang, n in rows:
        groups[s].append((d is not None, d or 0, leaf(d, s, lang, n, t), leaf(d, s, lang, n, change(d, t)), d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order]
    root, upper = tree([top for top, _ in trees])
    found = Counter()
    for s, (top, steps), above in zip(order, trees, upper):
        for (_, _, own, other, d), way in zip(sorted(groups[s], key=lambda x: x[:3]), steps):
            way, folded = way + above, other
            for before, after in way:
                folded = h(before, folded, after)
            proof = h(*(a + b for a, b in way))
            found[(d, own, top, root, proof, folded, folded == root)] += 1
    return found


def found(spark, rows, received):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    out = merkle_manifest(docs.repartition(5), received)
    columns = ["doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")), "folded_root", "verified"]
    return Counter(map(tuple, out.select(*columns).collect()))


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, "é": 4, None: 28, "": 2, "Z": 1}, {f"s{k}": 1 + k % 3 for k in range(11)}])
def test_trees_of_many_sizes(spark, sizes):
    rows = [(k, f"text {k}\n{s}" * (k % 4), s, "en", k) for s, n in sizes.items() for k in range(n)]
    assert found(spark, rows, None) == expected(rows, lambda d, t: t)


def test_nulls_ties_repeats_long_texts_and_a_changed_text(spark):
    rows = [
        (1, "a\nb", "s", None, 3), (1, "a\nb", "s", None, 3), (1, "other\n", "s", "en", 3), (None, "n\n", "s", "en", None),
        (None, None, None, None, None), (2, None, "s", "en", 0), (3, "", "s", "en", 0), (-4, "\n" * 200_000, "s", "en", 1),
    ] + [(7, "copy\n", "s", "en", 5)] * 40
    received = F.when(F.col("doc_id") != 7, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    change = lambda d, t: t.replace("\n", "") if d not in (7, None) and t else t
    assert found(spark, rows, received) == expected(rows, change)


def test_a_proof_fails_only_for_the_changed_row(spark):
    rows = [(k, f"line {k}\n", f"s{k % 4}", "en", k) for k in range(50)]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    out = merkle_manifest(docs, F.when(F.col("doc_id") == 17, F.lit("forged")).otherwise(F.col("text"))).collect()
    assert [r["doc_id"] for r in out if not r["verified"]] == [17]


def test_empty_table(spark):
    assert merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []
