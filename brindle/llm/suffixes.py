"""Sorting chosen suffixes of a text, bucket by bucket, with a difference cover's ranks for long ties.

The cover modulo V holds, for any two residues, a shift that takes both into
it. The suffixes at the cover's places are ranked first, by doubling: V symbols,
then twice as many, until a window is reached. Of a bucket's suffixes, those that
begin with the same V symbols are then ordered without comparing long strings: for
each pair of residues the cover's ranks at their shift say which comes first. So
equal beginnings show as neighbours.

Memory: the ranks of the cover's places (a fixed share of the text) and one
pack of buckets' keys. Callers bound the text.
"""

from __future__ import annotations

import numpy as np

#: Any residue is a difference of two of the cover's, once.
V, COVER = 7, (0, 1, 3)
SHIFT = np.array([[next(d for d in range(V) if (i + d) % V in COVER and (j + d) % V in COVER) for j in range(V)] for i in range(V)])


def _dense(first: np.ndarray, then: np.ndarray | None = None) -> np.ndarray:
    """The rank of each pair of numbers from -1 on (of each number), equal ones alike."""
    key = first if then is None else first.astype(np.int64) * (int(then.max(initial=0)) + 2) + then + 1
    return np.unique(key, return_inverse=True)[1].reshape(-1)


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([values[by:], np.full(min(by, len(values)), -1, values.dtype)])


def _heads(text: np.ndarray) -> np.ndarray:
    """The V symbols from each place on as a number that sorts like them."""
    if text.dtype == np.uint8:
        padded, out = np.concatenate([text, np.zeros(V, np.uint8)]), np.zeros(len(text), np.int64)
        for i in range(V):
            out = (out << 8) | padded[i : i + len(text)]
        return out
    two = _dense(text, _ahead(text, 1))
    four = _dense(two, _ahead(two, 2))
    return _dense(four, _ahead(four, 3))


class CoverRanks:
    """last[p]: the rank of width symbols or more at p among the cover's places; part: of the longest that ends within a window from any shift."""

    def __init__(self, text: np.ndarray, width: int) -> None:
        n, self.width = len(text), width
        self.head = _heads(text)
        place = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
        last = np.full(n + 2 * width, -1, np.int64)
        last[place] = _dense(self.head[place])
        length = V
        while length < width:
            if length + V <= width:
                self.part, self.length = last, length
            nxt = np.full(n + 2 * width, -1, np.int64)
            nxt[place] = _dense(last[place], last[place + length])
            last, length = nxt, 2 * length
        self.last = last

    def order(self, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The order of suffixes by bucket (small numbers), then text.

        Each counts the smaller ones of every residue: those of a smaller bucket or
        beginning, and those whose rank at the pair's shift is less.
        """
        head = _dense(self.head[at])
        group = _dense(bucket * (int(head.max(initial=0)) + 1) + head)
        width = int(self.last.max(initial=0)) + 2
        places = [np.flatnonzero(at % V == r) for r in range(V)]
        smaller = np.zeros(len(at), np.int64)
        for r, mine in enumerate(places):
            for q, theirs in enumerate(places):
                d = SHIFT[r, q]
                keys = np.sort(group[theirs] * width + self.last[at[theirs] + d])
                smaller[mine] += np.searchsorted(keys, group[mine] * width + self.last[at[mine] + d])
        return np.argsort(smaller, kind="stable")

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the width symbols at a and at b are equal: the first and last V, and two runs of the cover's that meet between."""
        d = SHIFT[a % V, b % V]
        far = d + (self.width - self.length - d) // V * V
        same = (self.head[a] == self.head[b]) & (self.head[a + self.width - V] == self.head[b + self.width - V])
        return same & (self.part[a + d] == self.part[b + d]) & (self.part[a + far] == self.part[b + far])


def repeated(contexts: list[bytes], group: np.ndarray, anchor: np.ndarray, width: int, symbol: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of width symbols of some contexts those that another context of the group has at the same place from its anchor.

    group: small numbers; anchor: the anchor's place in each context. Returns the
    context and the start of each such window, by class of equal windows, and the number of its class.
    """
    text = np.frombuffer(b"".join(contexts), symbol)
    if symbol != np.uint8:
        text = _dense(text)
    sizes = np.array([len(c) for c in contexts], np.int64) // np.dtype(symbol).itemsize
    base = np.cumsum(sizes) - sizes
    ranks = CoverRanks(text, width)
    count = np.maximum(sizes - width + 1, 0)
    which = np.repeat(np.arange(len(contexts)), count)
    start = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    place = base[which] + start
    bucket = group[which] * np.int64(2 * width) + (anchor[which] - start)
    # A window that no other agrees with in its first and its last symbols is alone.
    ends = _dense(_dense(bucket, _dense(ranks.head[place])), _dense(ranks.head[place + width - V]))
    some = np.flatnonzero(np.bincount(ends)[ends] > 1) if len(ends) else np.empty(0, np.int64)
    order = some[ranks.order(place[some], bucket[some])]
    new = np.ones(len(order), bool)
    a, b = order[:-1], order[1:]
    new[1:] = (bucket[a] != bucket[b]) | ~ranks.equal(place[a], place[b])
    number = np.cumsum(new) - 1
    hit = np.bincount(number)[number] > 1 if len(number) else np.empty(0, bool)
    found = order[hit]
    return which[found], start[found], number[hit]
