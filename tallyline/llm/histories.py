"""Mixing what follows the last pieces of a text, in numpy: hashes of runs of pieces, learned shares, online steps.

A piece is predicted by its spelling, by how often this text had it before, by how often training texts had it after the same 1, 2,
... pieces, and by how often this text had it after the last piece. Each of these contexts takes a share of the probability and
leaves the rest to those before. The log odds of a share are a weight by how often the context was seen, learned from the training
texts, plus the gradient steps that the pieces before in this very text have made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tallyline.llm.words import mixed

GATES, STEPS = 16, 3
# Weights move after every so many pieces of a text, by so much of the gradient.
BLOCK, RATE = 16, 0.05
CHUNK = 1 << 17
LEAST_SHARE = 1e-4
LEAST_SPELLED = -600.0

_U = np.uint64
OWN_CONTEXTS = 2
_BASE = _U(0x9E3779B97F4A7C15)
_START = _U(0x5851F42D4C957F2D)


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and the number of each one's place."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def places_of(lengths: np.ndarray) -> np.ndarray:
    """Places in their texts of texts of some lengths, one after another."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def run_hashes(hashes: np.ndarray, lengths: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the runs of 2 to ``longest`` pieces that end at each piece; before a text lies its start."""
    place, rolled, found = places_of(lengths), np.zeros(len(hashes), _U), []
    for back in range(longest):
        before = np.full(len(hashes), _START)
        before[back:] = hashes[: len(hashes) - back]
        before[place < back] = _START
        rolled = mixed(rolled * _BASE + before + _U(1))
        if back:
            found.append(rolled)
    return found


class Runs:
    """The distinct runs of some texts in ascending order, so by part, and for each length the number of the run at each place."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, longest: int, parts: int):
        distinct, self.numbers, n = [], [], 0
        for found in run_hashes(hashes, lengths, longest):
            own, number = numbered(found)
            distinct.append(own)
            self.numbers.append(number + n)
            n += len(own)
        # 48 bits of a hash are kept; the upper ones of them tell the part.
        distinct = np.concatenate(distinct) >> _U(16)
        order = np.argsort(distinct, kind="stable")
        self.distinct = distinct[order]
        part = ((self.distinct >> _U(16)) * _U(parts) >> _U(32)).astype(np.int32)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.numbers = [rank[number] for number in self.numbers]
        self.cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [n])) if n else np.zeros(1, np.int64)
        self.parts = part[self.cuts[:-1]]

    def counts(self, times: np.ndarray) -> np.ndarray:
        """How often each distinct run occurs, by the times of its last piece."""
        found = np.zeros(len(self.distinct))
        for number in self.numbers:
            found += np.bincount(number, times, len(found))
        return found.astype(np.int64)


def spelled_logs(bits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log probability of each piece by its spelling; ``bits`` is (piece x sharpness).

    The sharpnesses share it by how well they have predicted the text before.
    """
    spent = np.cumsum(bits, axis=0) - bits
    spent -= np.repeat(spent[np.cumsum(lengths) - lengths], lengths, axis=0)
    with_piece, least = spent + bits, spent.min(axis=1)
    all_least = with_piece.min(axis=1)
    before = np.exp2(least[:, None] - spent).sum(axis=1)
    after = np.exp2(all_least[:, None] - with_piece).sum(axis=1)
    return np.log(after / before) - np.log(2) * (all_least - least)


def chained(shares: list[np.ndarray], gains: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The mix of all contexts; per context the part of it that it gives, and that it and the shorter ones give.

    ``gains`` are the contexts' probabilities over that of the spelling.
    """
    mixes = [np.ones(len(shares[0]))]
    for share, gain in zip(shares, gains):
        mixes.append(share * gain + (1 - share) * mixes[-1])
    rest, given, reached = 1 / mixes[-1], [], []
    for share, gain, mix in zip(shares[::-1], gains[::-1], mixes[:0:-1]):
        given.append(rest * share * gain)
        reached.append(rest * mix)
        rest = rest * (1 - share)
    return mixes[-1], given[::-1], reached[::-1]


def earlier(lengths: np.ndarray, number: np.ndarray) -> np.ndarray:
    """How often each place's number came before in its text."""
    key = np.repeat(np.arange(len(lengths)), lengths) * (int(number.max(initial=0)) + 1) + number
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.diff(key[order], prepend=-1))
    found = np.empty(len(key), np.int64)
    found[order] = np.arange(len(key)) - np.repeat(new, np.diff(new, append=len(key)))
    return found


class Occurrences:
    """All pieces of some texts: their spelling, and per context how often it was seen, and with this piece after it."""

    def __init__(self, spelled: np.ndarray, numbers: np.ndarray, lengths: np.ndarray):
        self.spelled, self.numbers, self.lengths = spelled, numbers, lengths
        self.seen, self.after, self.own = [], [], []

    def add_contexts(self, runs: list[np.ndarray], pair: np.ndarray, train_texts: int) -> None:
        """``runs``: how often training texts have the run of 1, 2, ... pieces that ends at each piece; ``pair`` numbers those of 2."""
        first = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]

        def before(values: np.ndarray, at_start: int) -> np.ndarray:
            moved = np.concatenate((values[:1], values[:-1]))
            moved[first] = at_start
            return moved

        pieces = earlier(self.lengths, self.numbers)
        self.seen = [places_of(self.lengths), *(before(run, train_texts) for run in runs[:-1]), before(pieces, 0)]
        self.after = [pieces, *runs[1:], earlier(self.lengths, pair)]
        # The text itself only counts what came before; the training texts have the piece as well.
        self.own = [0, *[1] * (len(runs) - 1), 0]

    def _gated(self, at: np.ndarray | slice, train: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per context the gates (0: never seen) and the gains; ``train``: from the counts without the piece itself."""
        over = np.exp(-np.maximum(self.spelled[at], LEAST_SPELLED))
        gates, gains = [], []
        for seen, after, own in zip(self.seen, self.after, self.own):
            n = seen[at] - own * train
            gates.append(np.minimum(np.ceil(np.log2(n + 1)), GATES - 1).astype(np.int8))
            gains.append((after[at] - own * train) / np.maximum(n, 1) * over)
        return gates, gains

    def learned(self, train: np.ndarray) -> np.ndarray:
        """(2 x context x gate): what each context gives, and what it and the shorter ones give, over the training texts.

        Each piece is predicted from the counts of the contexts less its own occurrence.
        """
        at = np.flatnonzero(np.repeat(train, self.lengths))
        k = len(self.seen)
        parts = [self._gated(at[a : a + CHUNK], True) for a in range(0, len(at), CHUNK)]
        sums = np.zeros((2, k, GATES))
        shares = merged_shares(sums)
        for _ in range(STEPS):
            sums = np.zeros((2, k, GATES))
            for gates, gains in parts:
                _, given, reached = chained([shares[j][g] for j, g in enumerate(gates)], gains)
                for j, gate in enumerate(gates):
                    sums[0, j] += np.bincount(gate, given[j], GATES)
                    sums[1, j] += np.bincount(gate, reached[j], GATES)
            shares = merged_shares(sums)
        return sums

    def logs(self, shares: np.ndarray) -> np.ndarray:
        """Log probability of each text; its weights start from ``shares`` and move with its pieces."""
        texts = len(self.lengths)
        found = np.bincount(np.repeat(np.arange(texts), self.lengths), self.spelled, texts)
        if not self.seen:
            return found
        # Blocks of all texts, the first ones first and texts with many blocks first among them.
        by_length = np.argsort(-self.lengths, kind="stable")
        lengths = self.lengths[by_length]
        blocks = -(-lengths // BLOCK)
        owner, number = np.repeat(np.arange(texts), blocks), places_of(blocks)
        order = np.argsort(number, kind="stable")
        owner, number = owner[order], number[order]
        starts = (np.cumsum(self.lengths) - self.lengths)[by_length]
        begin = starts[owner] + BLOCK * number
        sizes = np.minimum(BLOCK, lengths[owner] - BLOCK * number)
        at = np.repeat(begin, sizes) + places_of(sizes)
        gates, gains = self._gated(at, False)
        weights = np.log(np.maximum(shares, LEAST_SHARE)) - np.log1p(-shares)
        text = np.repeat(owner, sizes)
        ends = np.cumsum(sizes)[np.flatnonzero(np.diff(number, append=-1))]
        moved, more = np.zeros((len(self.seen), texts)), np.zeros(texts)
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            mine, n = text[a:b], int(text[b - 1]) + 1
            now = [1 / (1 + np.exp(-w[g[a:b]] - m[mine])) * (g[a:b] > 0) for w, g, m in zip(weights, gates, moved)]
            mix, given, reached = chained(now, [gain[a:b] for gain in gains])
            more[:n] += np.bincount(mine, np.log(mix), n)
            for j, share in enumerate(now):
                moved[j, :n] += RATE * np.bincount(mine, given[j] - share * reached[j], n)
        found[by_length] += more
        return found


def merged_shares(sums: np.ndarray) -> np.ndarray:
    """(context x gate) shares from summed ``learned``; half, where nothing was met, and none without a context."""
    shares = np.clip((sums[0] + 0.5) / (sums[1] + 1), LEAST_SHARE, 1 - LEAST_SHARE)
    shares[:, 0] = 0
    return shares
