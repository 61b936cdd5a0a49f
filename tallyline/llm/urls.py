"""URL verdicts: rules by host and path, else naive Bayes over segmented host words and path tokens.

Hosts are cut into words by unigram Viterbi over word counts of the pages' own text; the rules' verdicts label the
pages that the multinomial naive Bayes is trained on, and it decides where no rule fits.
"""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.prefilter import with_possible_partner
from tallyline.sources.scratch import written

WORD_LENGTH = 20
BUCKETS = 1 << 16
SMOOTHING = 1.0
HOT_SHARE = 1000

Rule = tuple[str, str, str]  # host, path with its leading slash, verdict

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``; both are empty for a null url or one without ``://``."""
    rest = F.when(F.col("url").contains("://"), F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    located = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    host = F.regexp_extract("_rest", r"^([^/?#]*)", 1)
    path = F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)
    return located.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path).drop("_rest")


def rule_columns(rules: list[Rule]) -> tuple[Column, Column]:
    """``rule`` and its verdict: the longest rule that fits host (or a subdomain) and path, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, decision in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def word_counts(pages: DataFrame) -> DataFrame:
    """``word, n``: letter words of all pages' text, lower-cased; only words of up to ``WORD_LENGTH`` letters can be
    part of a host."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^a-z0-9]+")).alias("word"))
    return words.where((F.col("word") != "") & (F.length("word") <= WORD_LENGTH)).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    )


def viterbi(label: str, words: dict[str, int], total: int) -> list[str]:
    """The likeliest cut of a label into words; an unknown piece costs as one unseen occurrence tenfold a letter."""
    unknown = log(0.1 / (total + 1))
    best, back = [0.0] + [-np.inf] * len(label), [0] * (len(label) + 1)
    for stop in range(1, len(label) + 1):
        for start in range(max(0, stop - WORD_LENGTH), stop):
            n = words.get(label[start:stop])
            gain = log(n / total) if n else unknown - log(10) * (stop - start)
            if best[start] + gain > best[stop]:
                best[stop], back[stop] = best[start] + gain, start
    cut, stop = [], len(label)
    while stop:
        cut.append(label[back[stop] : stop])
        stop = back[stop]
    return cut[::-1]


def segmented_labels(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """``label, words`` for distinct host labels: their substrings meet the word counts in a join, so the lexicon
    may be of any size; what one label gathers is bounded by its own length."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    runs = F.filter(F.split("label", r"[^a-z0-9]+"), lambda w: w != "")
    pieces = labels.select("label", F.explode(runs).alias("run"))
    starts = pieces.select("label", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start"), "run")
    ends = F.sequence(F.lit(1), F.least(F.lit(WORD_LENGTH), F.length("run") - F.col("start") + 1))
    subs = starts.select("label", "start", "run", F.explode(ends).alias("size"))
    subs = subs.select("label", F.substring(F.col("run"), F.col("start"), F.col("size")).alias("word")).distinct()
    known = (
        subs.join(with_possible_partner(counts, subs, "word"), "word")
        .groupBy("label")
        .agg(F.collect_list("word").alias("found"), F.collect_list("n").alias("counts"))
    )

    @F.pandas_udf("array<string>")
    def cut(runs: pd.Series, found: pd.Series, counts: pd.Series) -> pd.Series:
        def one(parts, words, ns):
            lexicon = dict(zip(words, ns)) if words is not None else {}
            return [w for part in parts for w in viterbi(part, lexicon, total)]

        return pd.Series([one(*x) for x in zip(runs, found, counts)])

    return labels.join(known, "label", "left").select("label", cut(runs, "found", "counts").alias("words"))


def _bucket(kind: str, token: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(kind), token), F.lit(BUCKETS)).cast("int")


def _path_tokens() -> Column:
    return F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def url_verdicts(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every page; score is the log odds of ``block`` by naive Bayes.

    A null url has an empty host and path and is judged like one. Rows that repeat are judged each. Without any page
    that a rule labels, or with labels of one kind only, the smoothed odds of the labels decide (``allow`` at a tie). An
    empty table gives an empty result. Further columns are ignored but ``html``, whose words make the lexicon; it may
    be null.

    The Bayes table is hashed into ``BUCKETS`` places, so it is of a fixed size whatever the number of tokens. Host
    words are scored once a host and joined to the pages; hosts with over a thousandth of all pages are
    broadcast (a thousand at most).
    """
    rule, decision = rule_columns(rules)
    located = with_host_and_path(pages.select("page_id", "url"))
    judged = written(
        located.select("page_id", "host", "path", rule.alias("rule"), decision.alias("decision")), "url-judged"
    )
    hosts = written(
        judged.groupBy("host").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("decision") == "block").alias("block"),
            F.count_if(F.col("decision") == "allow").alias("allow"),
        ),
        "url-hosts",
    )
    labels = hosts.select(F.explode(F.split("host", r"\.")).alias("label")).where("label <> ''").distinct()
    counts = written(word_counts(pages), "url-words")
    words = written(segmented_labels(labels, counts), "url-labels")
    host_tokens = (
        hosts.select("host", "block", "allow", F.explode(F.split("host", r"\.")).alias("label"))
        .join(words, "label")
        .select("host", "block", "allow", F.explode("words").alias("word"))
        .select("host", "block", "allow", _bucket("host", F.col("word")).alias("bucket"))
    )
    path_tokens = judged.select("decision", F.explode(_path_tokens()).alias("word")).where("decision IS NOT NULL")
    seen = (
        path_tokens.select(
            _bucket("path", F.col("word")).alias("bucket"),
            (F.col("decision") == "block").cast("long").alias("block"),
            (F.col("decision") == "allow").cast("long").alias("allow"),
        )
        .union(host_tokens.select("bucket", "block", "allow"))
        .groupBy("bucket")
        .agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    )
    seen = written(seen, "url-seen")
    totals = seen.agg(F.sum("block"), F.sum("allow")).first()
    block_total, allow_total = (float(x or 0) + SMOOTHING * BUCKETS for x in totals)
    docs = hosts.agg(F.sum("block"), F.sum("allow")).first()
    prior = log(((docs[0] or 0) + SMOOTHING) / ((docs[1] or 0) + SMOOTHING))
    unseen = log(allow_total / block_total)
    odds = seen.select(
        "bucket", (F.log((F.col("block") + SMOOTHING) / (F.col("allow") + SMOOTHING)) + unseen).alias("odds")
    )
    host_scores = (
        host_tokens.join(F.broadcast(odds), "bucket", "left")
        .groupBy("host")
        .agg(F.sum(F.coalesce("odds", F.lit(unseen))).alias("host_score"))
    )
    scored_hosts = written(hosts.select("host", "n").join(host_scores, "host", "left"), "url-host-scores")
    # At most BUCKETS numbers; a page's tokens are summed where it is read, so no token is shuffled.
    by_bucket = {r["bucket"]: r["odds"] for r in odds.collect()}
    sent = judged.sparkSession.sparkContext.broadcast(
        np.array([by_bucket.get(k, unseen) for k in range(BUCKETS)], np.float64)
    )

    @F.pandas_udf("double")
    def path_score(buckets: pd.Series) -> pd.Series:
        return pd.Series([float(sent.value[np.asarray(b, np.int64)].sum()) for b in buckets])

    scored = judged.withColumn("path_score", path_score(F.transform(_path_tokens(), lambda w: _bucket("path", w))))
    limit = judged.count() // HOT_SHARE + 1
    hot = F.broadcast(scored_hosts.where(F.col("n") > limit).select("host", "host_score"))
    cold = scored_hosts.where(F.col("n") <= limit).select("host", "host_score")
    joined = scored.join(hot, "host").unionByName(scored.join(hot, "host", "left_anti").join(cold, "host"))
    score = F.lit(prior) + F.col("path_score") + F.coalesce("host_score", F.lit(0.0))
    return joined.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("decision", F.when(score > 0, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )
