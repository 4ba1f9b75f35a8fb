"""Suffix sorting in blocks with a difference cover, in numpy, for texts that fit a task.

The suffixes of one block (a range of leading bytes) are sorted at a time, by their first V bytes. Suffixes that tie are
told apart by a sample that was ranked beforehand: positions whose residue modulo V is in the cover. For any two
positions there is a shift below V that brings both into the sample, so a long tie costs one comparison of ranks, and
memory is bounded by the block and the sample."""

from __future__ import annotations

import numpy as np

#: The period, and a cover of its residues: every difference modulo 16 is one of two members.
V = 16
COVER = (0, 1, 2, 3, 4, 8, 12)

#: Suffixes sorted at a time, and the leading bytes that equal runs share.
SUFFIXES, DEPTH = 500_000, 50

_IN = np.isin(np.arange(V), COVER)
#: _SHIFT[a, b]: the least shift that brings residues a and b both into the cover.
_SHIFT = np.array([[next(d for d in range(V) if _IN[(a + d) % V] and _IN[(b + d) % V]) for b in range(V)] for a in range(V)], np.int64)


def words_at(text: bytes) -> np.ndarray:
    """The 8 bytes from every position on as a big-endian number; past the end follow zeros."""
    padded = np.frombuffer(text + bytes(DEPTH + 64), np.uint8)
    n, out = len(padded) - 8, None
    for k in range(8):
        part = padded[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
        out = part if out is None else np.bitwise_or(out, part, out=out)
    return out


def sample_ranks(words: np.ndarray) -> np.ndarray:
    """Ranks of the sample positions (others: 0), all different: by 16 bytes first; those that tie are told apart by the
    rank 16, 32, 64, ... bytes further on, which is in the sample too."""
    n = len(words)
    at = np.flatnonzero(_IN[np.arange(n - 8) % V])
    rank = np.zeros(n + V, np.int64)
    at = at[np.lexsort((words[at + 8], words[at]))]
    new = np.ones(len(at), bool)
    new[1:] = (words[at[1:]] != words[at[:-1]]) | (words[at[1:] + 8] != words[at[:-1] + 8])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(at)))
    rank[at] = np.repeat(start, size) + 1
    tied, step = at[np.repeat(size, size) > 1], V
    while len(tied):
        far = tied + step
        beyond = np.where(far < n, rank[np.minimum(far, n)], n - far)  # past the end the shorter suffix goes first
        order = np.lexsort((beyond, rank[tied]))
        tied, beyond = tied[order], beyond[order]
        group = rank[tied]
        first, new = np.ones(len(tied), bool), np.ones(len(tied), bool)
        first[1:] = group[1:] != group[:-1]
        new[1:] = first[1:] | (beyond[1:] != beyond[:-1])
        index = np.arange(len(tied))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(tied)))
        rank[tied] = group + np.repeat(start, size) - np.maximum.accumulate(np.where(first, index, 0))
        tied = tied[np.repeat(size, size) > 1]
        step *= 2
    return rank


def _before(i: np.ndarray, j: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether suffix i goes before suffix j, for suffixes with V equal leading bytes."""
    d = _SHIFT[i % V, j % V]
    return rank[i + d] < rank[j + d]


def _merged(s: np.ndarray, start: np.ndarray, size: np.ndarray, rank: np.ndarray) -> None:
    """Sorts each tied run of ``s`` in place: all runs are merge-sorted side by side, with binary searches by rank."""
    if not len(start):
        return
    run = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    base, length = start[run], size[run]
    half, longest = 1, int(size.max())
    while half < longest:
        mine = base + place
        pair = place // (2 * half) * (2 * half)
        right = place % (2 * half) >= half
        other = np.where(right, pair, pair + half)
        low, high = other.copy(), np.minimum(other + half, length)
        high = np.maximum(low, high)
        x = s[mine]
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo]) // 2
            y, z = s[base[todo] + mid], x[todo]
            r = right[todo]
            # an element of the right half goes after equals of the left one
            after = np.where(r, ~_before(z, y, rank), _before(y, z, rank))
            low[todo[after]] = mid[after] + 1
            high[todo[~after]] = mid[~after]
        s[base + pair + (place % half if half > 1 else 0) + (low - other)] = x
        half *= 2


def sorted_suffixes(words: np.ndarray, at: np.ndarray, block: int = SUFFIXES):
    """Yields the positions ``at`` in suffix order, one block after another; equal leading bytes never cross blocks."""
    if not len(at):
        return
    rank = sample_ranks(words)
    lead = words[at]
    edges = np.unique(np.sort(lead)[block::block]) if len(at) > block else np.empty(0, np.uint64)
    part = np.searchsorted(edges, lead, "right")
    for k in range(len(edges) + 1):
        s = at[part == k] if len(edges) else at
        if not len(s):
            continue
        s = s[np.lexsort((words[s + 8], words[s]))]
        new = np.ones(len(s), bool)
        new[1:] = (words[s[1:]] != words[s[:-1]]) | (words[s[1:] + 8] != words[s[:-1] + 8])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(s)))
        _merged(s, start[size > 1], size[size > 1], rank)
        yield s


def equal_runs(words: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Starts of runs of sorted suffixes that share DEPTH leading bytes."""
    new = np.ones(len(s), bool)
    a, b = s[1:], s[:-1]
    same = words[a + DEPTH - 8] == words[b + DEPTH - 8]
    for k in range(0, DEPTH - 8, 8):
        same &= words[a + k] == words[b + k]
    new[1:] = ~same
    return np.flatnonzero(new)
