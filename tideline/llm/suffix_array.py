"""Suffix arrays by induced sorting, with the common prefixes of neighbours, in numpy.

Suffixes are classified as smaller (S) or larger (L) than the next one. The leftmost S
positions (LMS) start substrings that are sorted by induction and named; equal names are
told apart by sorting the string of names, a third as long; and the order of all suffixes is
induced from that of the LMS suffixes (Nong, Zhang and Chan 2009). An induction scans the
array once. It goes letter by letter, and within a letter in rounds: all suffixes that a round
placed put those before them into their buckets together, in order, so a round is a few
array operations however long it is. The string of names has too many letters for rounds,
so it is sorted by doubling, each round only among names that are still equal.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order; the text is uint16 and ends with its only 0."""
    count = len(text)
    if count < 2:
        return np.arange(count)
    smaller = _smaller(text)
    starts = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sizes = np.bincount(text, minlength=int(text.max()) + 1)
    ranked = _induced(text, smaller, sizes, starts)
    ranked = ranked[_member(ranked, starts, count)]
    names = _names(text, ranked, starts)
    if names[-1] + 1 < len(starts):
        string = np.empty(count, dtype=np.int64)
        string[ranked] = names
        ranked = starts[_sorted_names(string[starts])]
    return _induced(text, smaller, sizes, ranked)


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; runs of a letter go with what follows them."""
    ends = np.flatnonzero(text[1:] != text[:-1])
    kinds = text[ends] < text[ends + 1]
    smaller = np.repeat(kinds, np.diff(ends, prepend=-1))
    return np.append(smaller, np.ones(len(text) - len(smaller), dtype=bool))


def _member(positions: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
    marks = np.zeros(count, dtype=bool)
    marks[of] = True
    return marks[positions]


def _appended(array: np.ndarray, free: np.ndarray, text: np.ndarray, found: np.ndarray, step: int) -> None:
    """Puts positions into the next free places of their letters' buckets, upwards or downwards."""
    letters = text[found]
    order = np.argsort(letters, kind="stable")
    letters = letters[order]
    firsts = np.flatnonzero(np.concatenate([[True], letters[1:] != letters[:-1]]))
    sizes = np.diff(np.append(firsts, len(letters)))
    which = letters[firsts]
    rank = np.arange(len(letters)) - np.repeat(firsts, sizes)
    array[np.repeat(free[which], sizes) + step * rank] = found[order]
    free[which] += step * sizes


def _induced(text: np.ndarray, smaller: np.ndarray, sizes: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """The array that LMS positions in the order ``ranked`` induce."""
    count = len(text)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    array = np.full(count, -1, dtype=np.int32)
    free = heads.copy()
    letters = text[ranked]
    grouped = np.argsort(letters, kind="stable")
    own = ranked[grouped]
    own_ends = np.cumsum(np.bincount(letters, minlength=len(sizes)))
    used = np.flatnonzero(sizes)
    for letter in used:
        at = int(heads[letter])
        while at < free[letter]:
            placed = array[at : free[letter]]
            at = int(free[letter])
            before = placed[placed > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _appended(array, free, text, before, 1)
        mine = own[own_ends[letter - 1] if letter else 0 : own_ends[letter]]
        before = mine[mine > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            _appended(array, free, text, before, 1)
    larger_end = free
    free = ends - 1
    array[0] = count - 1  # the final 0
    free[0] -= 1
    for letter in used[::-1]:
        at = int(ends[letter])
        while at - 1 > free[letter]:
            placed = array[free[letter] + 1 : at][::-1]
            at = int(free[letter]) + 1
            before = placed[placed > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _appended(array, free, text, before, -1)
        placed = array[heads[letter] : larger_end[letter]][::-1]
        before = placed[placed > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _appended(array, free, text, before, -1)
    return array


def _names(text: np.ndarray, ranked: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Names of the sorted LMS substrings, equal for equal substrings."""
    ends = np.empty(len(text), dtype=np.int64)
    ends[starts] = np.append(starts[1:], len(text) - 1)
    lengths = ends[ranked] - ranked + 1
    equal = lengths[1:] == lengths[:-1]
    pairs = np.flatnonzero(equal)
    if len(pairs):
        many = lengths[pairs]
        firsts = np.cumsum(many) - many
        offset = np.arange(int(many.sum())) - np.repeat(firsts, many)
        alike = text[np.repeat(ranked[pairs], many) + offset] == text[np.repeat(ranked[pairs + 1], many) + offset]
        equal[pairs] = np.logical_and.reduceat(alike, firsts)
    return np.concatenate([[0], np.cumsum(~equal)])


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, whose last name occurs once."""
    count = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(count, dtype=np.int64)
    rank[order] = np.searchsorted(names[order], names[order])
    width = 1
    while True:
        sorted_ranks = rank[order]
        tied = np.zeros(count, dtype=bool)
        same = sorted_ranks[1:] == sorted_ranks[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        open_ = order[places]
        following = np.where(open_ + width < count, rank[np.minimum(open_ + width, count - 1)] + 1, 0)
        turn = np.lexsort((following, rank[open_]))
        open_, following = open_[turn], following[turn]
        order[places] = open_
        own = rank[open_]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (following[1:] != following[:-1])])
        # A group keeps the rank of its first place.
        rank[open_] = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        width *= 2


def permuted_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each position, the length of the common prefix with the suffix before it in the array.

    A value is the one before less one unless the letters in front of the two suffixes
    differ; only where they do (irreducible values, whose sum is small) is text compared
    (Kärkkäinen, Manzini and Puglisi 2009).
    """
    count = len(text)
    before = np.empty(count, dtype=np.int64)
    before[array[1:]] = array[:-1]
    before[array[0]] = -1
    front = np.arange(count) - 1
    open_ = (before > 0) & (front >= 0)
    follows = np.zeros(count, dtype=bool)
    follows[open_] = text[front[open_]] == text[before[open_] - 1]
    starts = np.flatnonzero(~follows)
    direct = np.zeros(len(starts), dtype=np.int64)
    active = np.flatnonzero(before[starts] >= 0)
    padded = np.concatenate([text, np.zeros(_STEP, dtype=text.dtype)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, _STEP)
    while len(active):
        mine, other = starts[active] + direct[active], before[starts[active]] + direct[active]
        differ = windows[mine] != windows[other]
        whole = ~differ.any(axis=1)
        direct[active] += np.where(whole, _STEP, differ.argmax(axis=1))
        active = active[whole]
    since = np.diff(np.append(starts, count))
    return np.repeat(direct, since) - (np.arange(count) - np.repeat(starts, since))


_STEP = 16
