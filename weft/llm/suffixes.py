"""Suffix arrays by induced sorting, and permuted longest common prefixes.

``suffix_array`` sorts a string of small numbers: suffixes are classified, the leftmost-smaller (LMS) ones are put in the
order of the substrings up to the next of them by inducing from them unsorted, equal substrings get equal names, the
string of names is sorted by the same steps unless all differ, and all suffixes are induced from the sorted LMS ones.
Every level does so in time linear in its length, in numpy: the buckets of symbols that do not induce each other are
read together, about the square root of a string's length of them. Strings that would need too many such steps, such as
long falling ones, are induced place by place, with the same result.
"""

from __future__ import annotations

import numpy as np

#: Strings are induced in ranges if there are at least so many places for each, which is where that begins to be faster.
FEW_PLACES = 48


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end of the string is smaller than all."""
    n = len(t)
    run = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    up = np.zeros(len(run), bool)
    up[:-1] = t[run[:-1]] < t[run[1:]]
    return np.repeat(up, np.diff(run, append=n))


def _ranges(low: np.ndarray) -> list[int]:
    """Cuts that part symbols, in the order of a pass, into ranges in which no symbol is induced from another; ``low`` is
    the nearest symbol that each one induces. A symbol that induces itself is a range of its own."""
    cuts, least = [0], len(low)
    for c, far in enumerate(low.tolist()):
        if far < least:
            least = far
        if least <= c:
            if c > cuts[-1]:
                cuts.append(c)
            least = far
            if far == c:
                cuts.append(c + 1)
                least = len(low)
    if cuts[-1] < len(low):
        cuts.append(len(low))
    return cuts


def _nearest(t: np.ndarray, of: np.ndarray, symbols: int, flip: bool) -> np.ndarray:
    """For each symbol the nearest one that it induces, ``symbols`` if none: suffixes ``of`` are induced from the next."""
    to, source = t[of].astype(np.int64), t[of + 1].astype(np.int64)
    if flip:
        to, source = symbols - 1 - to, symbols - 1 - source
    low = np.full(symbols, symbols, np.int64)
    np.minimum.at(low, source, to)
    return low


def _passes(t: np.ndarray, small: np.ndarray) -> tuple[list[int], list[int]] | None:
    """The ranges of symbols of both passes; None if they are too many to be worth it."""
    symbols, kind = int(t.max()) + 1, small[:-1]
    up = _ranges(_nearest(t, np.flatnonzero(~kind), symbols, False))
    down = _ranges(_nearest(t, np.flatnonzero(kind), symbols, True))
    return None if len(up) + len(down) > len(t) // FEW_PLACES else (up, down)


def _by_range(t: np.ndarray, small: np.ndarray, lms: np.ndarray, up: list[int], down: list[int]) -> np.ndarray:
    """Both inducing passes, a range of buckets at a time: what a range holds is known once the ranges before it are done.

    ``lms`` are the LMS suffixes, of each first symbol in the order that is to be induced from.
    """
    n = len(t)
    symbols = int(t.max()) + 1
    start = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=symbols))])
    sa = np.full(n, -1, np.int64)

    count = np.arange(n)

    def deal(found: np.ndarray, at: np.ndarray, step: int) -> None:
        """Append suffixes to their buckets in the order given, from the front (step 1) or the back (step -1)."""
        order = t[found].argsort(kind="stable")
        found = found[order]
        c, k = t[found], count[: len(found)]
        first = np.zeros(len(c), np.int64)
        first[1:] = k[1:] * (c[1:] != c[:-1])
        place = at[c] + step * (k - np.maximum.accumulate(first))
        sa[place] = found
        at[c] = place + step  # the last of a bucket counts

    def induce(lo: int, hi: int, step: int, wanted: np.ndarray, at: np.ndarray) -> None:
        """Deal the suffixes to the left of those at places lo to hi, if they are of the wanted type."""
        batch = sa[lo:hi][::step] - 1
        batch = batch[wanted[batch]]
        if len(batch) == 1:
            c = t[batch[0]]
            sa[at[c]] = batch[0]
            at[c] += step
        elif len(batch):
            deal(batch, at, step)

    if len(lms):
        deal(lms[::-1], start[1:] - 1, -1)  # to the ends of their buckets, where the first pass finds them
    none = np.zeros(2, bool)  # an empty place, and the first suffix, have none to their left
    large, small = np.concatenate([~small, none]), np.concatenate([small, none])
    head = start[:-1].copy()
    deal(np.array([n - 1]), head, 1)
    for a, b in zip(up[:-1], up[1:]):
        done, end = int(start[a]), int(start[b])
        while b - a == 1 and done < head[a]:  # a bucket may grow while it is read
            done, last = int(head[a]), done
            induce(last, done, 1, large, head)
        induce(done, end, 1, large, head)
    tail = start[1:] - 1
    for a, b in zip(down[:-1], down[1:]):
        a, b = symbols - b, symbols - a
        done, end = int(start[b]), int(start[a])
        while b - a == 1 and done > tail[a] + 1:
            done, last = int(tail[a]) + 1, done
            induce(done, last, -1, small, tail)
        induce(end, done, -1, small, tail)
    return sa


def _one_by_one(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As ``_by_range``, a place at a time."""
    n = len(t)
    ends = np.cumsum(np.bincount(t))
    s, is_small = t.tolist(), small.tolist()
    sa = [0] * (n + 1)  # one more than the suffix; 0 is an empty place
    tail = ends.tolist()
    for i in lms[::-1].tolist():
        c = s[i]
        tail[c] -= 1
        sa[tail[c]] = i + 1
    head = [0, *ends[:-1].tolist()]
    c = s[n - 1]
    sa[head[c]] = n
    head[c] += 1
    for k in range(n):
        i = sa[k] - 2
        if i >= 0 and not is_small[i]:
            c = s[i]
            sa[head[c]] = i + 1
            head[c] += 1
    tail = ends.tolist()
    for k in range(n - 1, -1, -1):
        i = sa[k] - 2
        if i >= 0 and is_small[i]:
            c = s[i]
            tail[c] -= 1
            sa[tail[c]] = i + 1
    return np.array(sa[:n], np.int64) - 1


def _differ(t: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each LMS substring differs from the one before it in the order given; ``size`` tells how long they are,
    0 for the last of the string, which differs from all."""
    new = np.ones(len(lms), bool)
    pair = np.flatnonzero((size[1:] == size[:-1]) & (size[1:] > 0)) + 1
    if len(pair):
        n = size[pair]
        at = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(at, n)
        same = t[np.repeat(lms[pair], n) + step] == t[np.repeat(lms[pair - 1], n) + step]
        new[pair] = ~np.logical_and.reduceat(same, at)
    return new


def suffix_array(t: np.ndarray, *, one_by_one: bool = False) -> np.ndarray:
    """The starts of all suffixes of a string of small non-negative symbols, in order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    small = _types(t)
    ranges = None if one_by_one else _passes(t, small)

    def induce(lms: np.ndarray) -> np.ndarray:
        return _by_range(t, small, lms, *ranges) if ranges else _one_by_one(t, small, lms)

    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return induce(lms)
    place = np.full(n, -1, np.int64)
    place[lms] = np.arange(len(lms))
    first = induce(lms)
    number = place[first]
    number = number[number >= 0]  # LMS suffixes by their substrings
    size = np.append(np.diff(lms) + 1, 0)
    new = _differ(t, lms[number], size[number])
    names = np.empty(len(lms), np.int64)
    names[number] = np.cumsum(new) - 1
    order = number if new.all() else suffix_array(names, one_by_one=one_by_one)
    return induce(lms[order])


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int, begins: np.ndarray | None = None) -> np.ndarray:
    """For each start, the length it shares with the suffix before it in order, counted up to ``most`` symbols.

    Only irreducible ones, whose preceding symbols differ, are compared; each other one is its left neighbour's less 1.
    Those at ``begins`` are compared too: then lengths are exact up to ``most`` less the distance from the last of them.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    left = np.where((i > 0) & (before > 0), t[np.maximum(before - 1, 0)] == t[np.maximum(i - 1, 0)], False)
    # A reducible one needs its left neighbour's predecessor to be just left of its own.
    left[1:] &= before[:-1] + 1 == before[1:]
    if begins is not None:
        left[begins] = False
    todo = np.flatnonzero(~left & (before >= 0))
    pad = np.concatenate([t, np.zeros(most + 1, t.dtype)])
    length = np.zeros(n, np.int64)
    ends = n - np.maximum(todo, before[todo])
    a, b = todo, before[todo]
    got = np.zeros(len(todo), np.int64)
    live = np.arange(len(todo))
    step = 0
    while len(live) and step < most:
        same = pad[a[live] + step] == pad[b[live] + step]
        live = live[same]
        step += 1
        got[live] = step
    length[todo] = np.minimum(got, ends)
    # The nearest irreducible start to the left.
    mark = np.maximum.accumulate(np.where(~left, i, 0))
    return np.where(left, np.maximum(length[mark] - (i - mark), 0), length)
