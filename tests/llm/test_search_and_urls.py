from math import inf, nan

import numpy as np
import pytest

from llm_fixtures import SF
from tallyline.llm.exact_topk import block_topk, exact_topk
from tallyline.llm.queries import URL_RULES
from tallyline.llm.urls import url_verdicts, viterbi


@pytest.mark.parametrize("width, n, top", [(0, 5, 3), (3, 4, 5), (64, 700, 5), (96, 3000, 1)])
@pytest.mark.parametrize("large", [False, True])
def test_block_by_brute_force(width, n, top, large):
    rng = np.random.default_rng(width + n)
    scale = rng.geometric(0.2, width)[:, None] * (2**27 if large else 1)
    c = np.clip((rng.normal(0, 30, (width, n)) * scale).astype(np.int64), -(2**28), 2**28)
    q, ids = c[:, :20].copy(), rng.permutation(n).astype(np.int64)
    rows = np.arange(n)
    at, found, scores = block_topk(q, rows[: q.shape[1]], c, rows, ids, top)
    for k in range(q.shape[1]):
        full = (q[:, k] @ c).tolist()
        best = sorted(((-full[j], int(ids[j])) for j in range(n) if j != k))[:top]
        mine = [(-int(s), int(ids[j])) for a, j, s in zip(at, found, scores) if a == k]
        assert mine == best


def test_topk_edges(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [0.5]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]),
            (None, [9.0, 9.0]), (5, []), (6, [1.0, 2.0]), (7, [-0.001, 0.0])]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, row string, v string")
    found = exact_topk(frame, k=3)
    got = sorted(map(tuple, found.collect()))
    both = 256 * 256 * 5
    assert got == sorted(
        2 * [(0, 1, 0, both), (0, 2, 6, both), (0, 3, 50, 256 * 128)]
        + [(50, 1, 0, 256 * 128), (50, 2, 0, 256 * 128), (50, 3, 6, 256 * 128)]
    )
    assert exact_topk(frame.limit(0)).count() == 0


def test_topk_of_several_blocks_is_never_broadcast(spark, monkeypatch):
    from tallyline.llm import exact_topk as module

    monkeypatch.setattr(module, "CANDIDATES", 16)
    monkeypatch.setattr(module, "QUERIES", 4)
    monkeypatch.setattr(module, "QUERY_BLOCKS", 2)
    vectors = np.random.default_rng(3).integers(-(2**17), 2**17, (90, 6))
    frame = spark.createDataFrame([(i, [x / 256 for x in v.tolist()]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = exact_topk(frame, every=5, k=3)
    scores = (vectors @ vectors.T).tolist()
    wanted = [sorted((-scores[q][j], j) for j in range(90) if j != q)[:3] for q in range(0, 90, 5)]
    expected = [(5 * n, r, j, -s) for n, best in enumerate(wanted) for r, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, found.collect())) == expected
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_viterbi_takes_the_likelier_cut():
    words = {"free": 50, "bets": 20, "the": 900, "ring": 30, "thering": 1}
    assert viterbi("freebets", words, 1001) == ["free", "bets"]
    assert viterbi("thering", words, 1001) == ["the", "ring"]
    assert "".join(viterbi("qqqq", words, 1001)) == "qqqq" and viterbi("", words, 1001) == []


def test_rules_and_edges(spark):
    urls = [
        ("http://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://shop.com/de/", "shop.com", "/de/", "com/de/", "block"),
        ("http://shop.com/fr/?u=http://x.org/", "shop.com", "/fr/", "com/fr/", "allow"),
        ("ftp://x.net?q=/de/", "x.net", "", None, None),
        ("no scheme/de/", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
        ("http://" + "longhost" * 40 + ".net/a", "longhost" * 40 + ".net", "/a", None, None),
    ]
    rows = [(k, u[0], "<p>shop free bets the", "c") for k, u in enumerate(urls)] + [(None, "http://y.net/", None, "c"), (0, urls[0][0], "", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = url_verdicts(pages, URL_RULES).collect()
    assert len(found) == len(rows) and {r["verdict"] for r in found} == {"allow", "block"}
    by_id = {r["page_id"]: r for r in found}
    for k, (_, host, path, rule, verdict) in enumerate(urls):
        assert (by_id[k]["host"], by_id[k]["path"], by_id[k]["rule"]) == (host, path, rule)
        assert verdict in (None, by_id[k]["verdict"])
    assert url_verdicts(pages.limit(0), URL_RULES).count() == 0


def test_bayes_learns_the_rules_verdicts(spark):
    """Of the pages that a rule labels, left to the method alone, most get the rule's verdict, though a rule may ask for
    host and path together, which naive Bayes cannot."""
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    found = url_verdicts(pages, URL_RULES).where("rule IS NOT NULL").toPandas()
    agrees = (found.score > 0) == (found.verdict == "block")
    assert agrees.mean() > 0.7
