"""Suffix arrays over the token streams of pages, with their longest common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions in order of their suffixes, and how many tokens each shares with the one before it.

    Prefix doubling: each round orders by twice as many tokens, and only positions that aren't yet alone in
    their group are sorted again. The groups of every round then give the common prefixes, from the longest
    step down. Whatever the length of a repeat, it is found whole.
    """
    n = len(tokens)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sa = np.argsort(tokens, kind="stable")
    ordered = tokens[sa]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    # A position's rank is where its group begins, so ranks stay valid while groups are split.
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels = [rank.copy()]
    step = 1
    while True:
        alone = first & np.concatenate([first[1:], [True]])
        open_ = np.nonzero(~alone)[0]
        if not len(open_):
            break
        at = sa[open_]
        key = (rank[at].astype(np.int64) << 32) + rank[np.minimum(at + step, n)] + 1
        turn = np.argsort(key, kind="stable")
        sa[open_], key = at[turn], key[turn]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first[open_] = new
        start = np.maximum.accumulate(np.where(new, open_, 0))
        rank[sa[open_]] = start
        levels.append(rank.copy())
        step *= 2
    lcp = np.zeros(n, np.int64)
    i, j = sa[1:].copy(), sa[:-1].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = np.nonzero(levels[k][i] == levels[k][j])[0]
        lcp[same + 1] += 1 << k
        i[same] = np.minimum(i[same] + (1 << k), n)
        j[same] = np.minimum(j[same] + (1 << k), n)
    return sa, lcp


def groups(lcp: np.ndarray, length: int) -> np.ndarray:
    """For each place in the suffix array the number of its interval: neighbours that share at least length tokens."""
    return np.cumsum(np.concatenate([[False], lcp[1:] < length])) if len(lcp) else np.empty(0, np.int64)


def distinct_owners(group: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each group the number of distinct owners in it."""
    if not len(group):
        return np.empty(0, np.int64)
    pair = np.unique(group.astype(np.int64) * (int(owner.max()) + 1) + owner)
    return np.bincount(pair // (int(owner.max()) + 1), minlength=int(group.max()) + 1)


def covered(sa: np.ndarray, lcp: np.ndarray, owner: np.ndarray, length: int, least: int) -> np.ndarray:
    """Which positions lie in a substring of at least length tokens that at least `least` owners have.

    Every such substring, however long, is the union of its pieces of `length` tokens, which occur wherever
    it does; so the intervals of the array at that depth cover all of it.
    """
    n = len(sa)
    group = groups(lcp, length)
    hit = sa[distinct_owners(group, owner[sa])[group] >= least] if n else sa
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, np.minimum(hit + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def whole_supports(sa: np.ndarray, lcp: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each of some substrings (start, size; each ends in a token that occurs nowhere inside of one) the number
    of distinct owners that have it whole."""
    if not len(starts):
        return np.empty(0, np.int64)
    which = np.full(len(sa), -1, np.int64)
    which[starts] = np.arange(len(starts))
    places = np.nonzero(which[sa] >= 0)[0]
    item = which[sa[places]]
    # The least common prefix of the places between two of them is what those two share.
    shared = np.minimum.reduceat(np.append(lcp, 0), np.ravel(np.column_stack([places[:-1] + 1, places[1:] + 1])))[::2] if len(places) > 1 else np.empty(0, np.int64)
    group = np.cumsum(np.concatenate([[False], shared < sizes[item[1:]]]))
    out = np.empty(len(starts), np.int64)
    out[item] = distinct_owners(group, owner[item])[group]
    return out
