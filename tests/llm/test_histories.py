from collections import Counter, defaultdict

import numpy as np

from llm_fixtures import make_docs  # noqa: F401
from tallyline.llm import context_mixing, histories
from tallyline.llm.context_mixing import scored_texts
from tallyline.llm.histories import BLOCK, GATES, RATE, Occurrences


def plain_log(text, spelled, shares, pairs, texts):
    """The log probability of one text, a piece after another."""
    follow = defaultdict(Counter)
    for (a, b), n in pairs.items():
        follow[a][b] += n
    moved, steps, total, so_far, own = np.zeros(3), np.zeros(3), 0.0, Counter(), defaultdict(Counter)
    for t, x in enumerate(text):
        if t % BLOCK == 0:
            moved, steps = moved + RATE * steps, np.zeros(3)
        last = text[t - 1] if t else None
        counts = [so_far, follow[last], own[last]]
        share, predicted = np.zeros(3), np.zeros(3)
        for k, seen in enumerate(counts):
            n = texts if k == 1 and not t else sum(seen.values()) if t else 0
            if n:
                start = shares[k, min(int(np.ceil(np.log2(n + 1))), GATES - 1)]
                share[k] = 1 / (1 + np.exp(-np.log(start / (1 - start)) - moved[k]))
                predicted[k] = seen[x] / n
        mixes = [spelled[x]]
        for s, p in zip(share, predicted):
            mixes.append(s * p + (1 - s) * mixes[-1])
        rest = 1 / mixes[-1]
        for k in (2, 1, 0):
            steps[k] += rest * share[k] * predicted[k] - share[k] * rest * mixes[k + 1]
            rest *= 1 - share[k]
        total += np.log(mixes[-1])
        so_far[x] += 1
        if t:
            own[last][x] += 1
    return total


def logs_of(texts, spelled, shares, pairs, n):
    lengths = np.array([len(t) for t in texts])
    before = [a for t in texts for a in [None, *t[:-1]]]
    numbers = np.array([x for t in texts for x in t])
    after = np.array([pairs[p] for p in zip(before, numbers.tolist())], float)
    seen = Counter()
    for (a, _), c in pairs.items():
        seen[a] += c
    found = Occurrences(np.log(spelled[numbers]), numbers, lengths)
    pair = np.array([len(spelled) if a is None else a for a in before]) * (len(spelled) + 1) + numbers
    found.add_contexts([np.array([seen[x] for x in numbers.tolist()], float), after], pair, n)
    return found.logs(shares)


def test_mix_is_the_plain_one_and_a_probability():
    rng = np.random.default_rng(4)
    spelled = rng.dirichlet(np.ones(6))
    shares = np.where(np.arange(GATES) > 0, rng.uniform(0.1, 0.9, (3, GATES)), 0)
    train = [rng.choice(5, rng.integers(1, 9)).tolist() for _ in range(30)]
    pairs = Counter(p for t in train for p in zip([None, *t[:-1]], t))
    texts = [rng.choice(6, n).tolist() for n in (1, 3, 16, 17, 40, 80, 16, 33)]
    found = logs_of(texts, spelled, shares, pairs, 30)
    assert np.allclose(found, [plain_log(t, spelled, shares, pairs, 30) for t in texts])
    for t in ([], texts[4], texts[5][:32]):
        more = logs_of([t + [x] for x in range(6)], spelled, shares, pairs, 30)
        before = logs_of([t], spelled, shares, pairs, 30)[0] if t else 0.0
        assert np.isclose(np.exp(more - before).sum(), 1)


def test_contexts_go_past_the_piece(make_docs, monkeypatch):
    names = [f"word{k}" for k in range(20)]
    rows = [(k, " ".join(names[k % 20 :] + names[: k % 20])) for k in range(200)]
    rows += [(1000 + k, " ".join(names[::-1])) for k in range(40)]
    found = {r["doc_id"]: r for r in scored_texts(make_docs(rows), history=1).collect()}
    held = [k for k in range(200) if found[k]["held_out"]]
    backwards = [(k, " ".join(t.split()[::-1]) if k in held else t) for k, t in rows]
    other = {r["doc_id"]: r for r in scored_texts(make_docs(backwards[:200]), history=1).collect()}
    assert all(found[k]["bits_per_byte"] < 0.5 * other[k]["bits_per_byte"] for k in held)
    # Slices, parts and buckets change nothing.
    monkeypatch.setattr(context_mixing, "merged_shares", lambda sums: histories.merged_shares(np.zeros_like(sums)))
    whole = sorted((r["doc_id"], round(r["score"], 3)) for r in scored_texts(make_docs(rows), history=2).collect())
    for name, value in (("PART_RUNS", 300), ("BUCKET_KEYS", 1000), ("DEALT_BYTES", 500)):
        monkeypatch.setattr(context_mixing, name, value)
    assert sorted((r["doc_id"], round(r["score"], 3)) for r in scored_texts(make_docs(rows), history=2).collect()) == whole


def test_repeats_in_a_text_cost_less(make_docs):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    rows = [(k, " ".join(rng.choice(words, 40))) for k in range(200)]
    rows += [(300 + k, " ".join([*rng.choice(words, 10)] * 4)) for k in range(40)]
    found = [r for r in scored_texts(make_docs(rows), history=1).collect() if r["held_out"]]
    mean = [np.mean([r["bits_per_byte"] for r in found if (r["doc_id"] < 300) == plain]) for plain in (True, False)]
    assert mean[1] < 0.7 * mean[0]
