"""Anchors: places of a text chosen by what stands there, so that equal passages choose alike.

A text is a sequence of symbols: its bytes, or its words. Each window has as its
anchor the leftmost of its grams (shorter strings) with the smallest hash. Equal
windows, wherever they are, have equal grams at their anchors, at the same place in
the window; so a window can only repeat if its anchor's gram does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

#: Symbols of text handled at once.
_CHUNK = 1 << 20
_PLACE = np.uint64(21)
_BLANK = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Kind:
    """Symbols of a window and of a gram, and how a symbol is kept; number: 0 or 1."""

    number: int
    window: int
    gram: int
    symbol: np.dtype

    @property
    def size(self) -> int:
        return self.symbol.itemsize


BYTES = Kind(0, 400, 200, np.dtype(np.uint8))
#: Words are known by their XXH64.
WORDS = Kind(1, 51, 13, np.dtype(np.uint64))
KINDS = (BYTES, WORDS)


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def symbols(text: bytes, kind: Kind) -> bytes:
    """The text as symbols of a kind, as bytes."""
    if kind is BYTES:
        return text
    if len(text) <= _CHUNK:
        return _hashed(text.split()).tobytes()
    parts, lo = [], 0
    while lo < len(text):
        # A part ends where a word does.
        hi = lo + _CHUNK
        while hi < len(text) and text[hi : hi + 1] not in _BLANK:
            hi += 1
        parts.append(_hashed(text[lo:hi].split()).tobytes())
        lo = hi
    return b"".join(parts)


class Hasher:
    """Hashes of substrings of up to a chunk and a window, from running sums modulo 2**64."""

    def __init__(self) -> None:
        rng = np.random.default_rng(7)
        base = int(rng.integers(0, 2**62)) * 2 + 1
        size = _CHUNK + max(k.window for k in KINDS) + 1
        self.values = rng.integers(1, 2**63, 256, np.uint64)
        self.powers = np.cumprod(np.full(size, base, np.uint64))
        self.inverse = np.cumprod(np.full(size, pow(base, -1, 2**64), np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        values = self.values[data] if data.dtype == np.uint8 else data
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * self.powers[: len(data)])))

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (sums[stop] - sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each span consecutive values, by running minima within blocks from both sides."""
    n = len(values)
    blocks = -(-n // span)
    grid = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = values
    grid = grid.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - span + 1], ahead[span - 1 : n])


def anchors(texts: list[bytes], hasher: Hasher, kind: Kind) -> tuple[np.ndarray, ...]:
    """Of all windows of some texts (symbols as bytes): text, place, first, last, gram.

    A row is an anchor and the windows (first to last, by where they start) that
    chose it; gram is its string's hash, the lowest bit of which is the kind's number.
    """
    found: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            found.append(_chunk(held, hasher, kind))
        held, size = [], 0

    for i, text in enumerate(texts):
        data = np.frombuffer(text, kind.symbol)
        # Parts of a long text overlap so that each window is in one of them.
        for lo in range(0, max(1, len(data) - kind.window + 1), _CHUNK):
            part = data[lo : lo + _CHUNK + kind.window - 1]
            if len(part) < kind.window:
                continue
            if size + len(part) > _CHUNK + kind.window:
                flush()
            held.append((i, lo, part))
            size += len(part)
    flush()
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(5))


def _chunk(held: list[tuple[int, int, np.ndarray]], hasher: Hasher, kind: Kind) -> tuple[np.ndarray, ...]:
    data = np.concatenate([p for _, _, p in held])
    sizes = np.array([len(p) for _, _, p in held])
    begin = np.cumsum(sizes) - sizes
    sums = hasher.sums(data)
    places = np.arange(len(data) - kind.gram + 1)
    grams = hasher.of(sums, places, places + kind.gram)
    least = _least((grams >> _PLACE) << _PLACE | places.astype(np.uint64), kind.window - kind.gram + 1)
    anchor = (least & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    start = np.concatenate([np.arange(b, b + s - kind.window + 1) for b, s in zip(begin.tolist(), sizes.tolist(), strict=True)])
    chosen = anchor[start]
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1))))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    at = chosen[new]
    which = np.searchsorted(begin, first, side="right") - 1
    text = np.array([i for i, _, _ in held])[which]
    base = np.array([lo for _, lo, _ in held])[which] - begin[which]
    return text, at + base, first + base, last + base, grams[at] >> np.uint64(1) << np.uint64(1) | np.uint64(kind.number)
