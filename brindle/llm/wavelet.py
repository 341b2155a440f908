"""A wavelet matrix in one file: token access, counting and occurrence lookup by range reads.

Level 0 holds each token's highest bit in text order. The next level's order is
that of a stable partition by it, zeros first; and so on to the lowest bit. Each
level's bits are cut into blocks of BLOCK bits, each compressed on its own (or
stored, where that is shorter), with the ones before it in a directory. So a
token is found by reading one block a level, and a rank likewise.

Layout: the blocks of all levels and the extra section one after another; then
the header (zlib'd JSON and directories), its length (8 bytes, little-endian),
and MAGIC. A reader starts from the end.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable

import numpy as np
import zstandard

MAGIC, BLOCK = b"BWMX0001", 1 << 17
Read = Callable[[int, int], bytes]


def encode(ids: np.ndarray, levels: int, extra: bytes = b"") -> bytes:
    """The file for some ids below 2**levels; extra: bytes of the caller's, kept compressed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    body, at = [], 0
    zeros, ones, lengths = [], [], []
    now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    for level in range(levels):
        bit = (now >> now.dtype.type(levels - 1 - level)) & now.dtype.type(1)
        plane = bit.astype(bool)
        raw = np.packbits(plane)
        before = 0
        for lo in range(0, len(plane), BLOCK):
            block = raw[lo // 8 : (lo + BLOCK) // 8].tobytes()
            short = pack(block)
            kept = short if len(short) < len(block) else block
            ones.append(before)
            lengths.append(len(kept))
            body.append(kept)
            before += int(np.count_nonzero(plane[lo : lo + BLOCK]))
        zeros.append(len(plane) - before)
        now = np.concatenate([now[~plane], now[plane]])
    tail = pack(extra)
    body.append(tail)
    at = sum(map(len, body))
    head = json.dumps({"n": len(ids), "levels": levels, "zeros": zeros, "extra": [at - len(tail), len(tail)]}).encode()
    directory = np.array(lengths, "<u4").tobytes() + np.array(ones, "<u8").tobytes()
    header = pack(struct.pack("<I", len(head)) + head + directory)
    return b"".join([*body, header, struct.pack("<Q", len(header)), MAGIC])


class WaveletFile:
    """Queries over a file of encode(); read(offset, length) gives its bytes, size is its length."""

    def __init__(self, read: Read, size: int) -> None:
        self.read = read
        tail = read(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a wavelet file")
        (length,) = struct.unpack("<Q", tail[:8])
        raw = zstandard.ZstdDecompressor().decompress(read(size - 16 - length, length))
        (n,) = struct.unpack_from("<I", raw)
        self.head = json.loads(raw[4 : 4 + n])
        self.n, self.levels, self.zeros = self.head["n"], self.head["levels"], self.head["zeros"]
        self.per_level = -(-self.n // BLOCK)
        blocks = self.per_level * self.levels
        self.lengths = np.frombuffer(raw, "<u4", blocks, 4 + n).astype(np.int64)
        self.ones = np.frombuffer(raw, "<u8", blocks, 4 + n + 4 * blocks).astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self._held: dict[int, np.ndarray] = {}

    def extra(self) -> bytes:
        at, length = self.head["extra"]
        return zstandard.ZstdDecompressor().decompress(self.read(at, length))

    def _bits_of(self, data: bytes, k: int) -> np.ndarray:
        """Block k of a level's, unpacked."""
        bits = min(BLOCK, self.n - k * BLOCK)
        size = (bits + 7) // 8
        raw = data if len(data) == size else zstandard.ZstdDecompressor().decompress(data)
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=bits)

    def _block(self, level: int, k: int) -> np.ndarray:
        b = level * self.per_level + k
        if b not in self._held:
            if len(self._held) > 64:
                self._held.clear()
            self._held[b] = self._bits_of(self.read(int(self.offsets[b]), int(self.lengths[b])), k)
        return self._held[b]

    def _rank1(self, level: int, i: int) -> int:
        """The ones among the first i bits of a level."""
        k, rest = divmod(i, BLOCK)
        if k == self.per_level:
            return self.n - self.zeros[level]
        before = int(self.ones[level * self.per_level + k])
        return before + (int(np.count_nonzero(self._block(level, k)[:rest])) if rest else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = int(self._block(level, i // BLOCK)[i % BLOCK])
            ones = self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if token >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a token occurs at lo <= i < hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of that value in a level."""
        part = slice(level * self.per_level, (level + 1) * self.per_level)
        before = self.ones[part] if bit else np.arange(self.per_level) * BLOCK - self.ones[part]
        b = int(np.searchsorted(before, k, side="right")) - 1
        return b * BLOCK + int(np.flatnonzero(self._block(level, b) == bit)[k - int(before[b])])

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of a token."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, level by level from the last: each stable partition undone."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            lo = level * self.per_level
            data = self.read(int(self.offsets[lo]), int(self.offsets[lo + self.per_level] - self.offsets[lo])) if self.n else b""
            cut = self.offsets[lo : lo + self.per_level + 1] - self.offsets[lo]
            plane = np.concatenate([np.empty(0, np.uint8), *(self._bits_of(data[cut[k] : cut[k + 1]], k) for k in range(self.per_level))]).astype(bool)
            up = np.empty_like(now)
            up[~plane] = now[: self.zeros[level]]
            up[plane] = now[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            now = up
        return now
