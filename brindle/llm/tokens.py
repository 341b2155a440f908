"""Token ids of whole texts, one wavelet matrix per shard file.

1. Documents are range-partitioned by doc_id and sorted; a task encodes its
   range and writes a file per SHARD ids into the shared folder, whole or not at
   all, under a name that a second attempt uses too.
2. The manifest (a row per file) gives each range's ids; their running total is
   the only thing that all ranges share.
3. The files are read back, one a task, and everything returned comes from them.

Encoding: a byte-level BPE tokenizer cuts a text into pieces (words with the
blank before them, numbers, runs of signs, white space) and encodes each piece
on its own. The cuts are found for many texts at once by character classes; the
library's model encodes each distinct piece, once per worker while it is remembered.
Pieces are told apart by 64-bit hashes. Texts with characters beyond the
scripts whose classes are long settled, or with a special token's string, go
through the library whole; so do all texts where the tokenizer's file asks for
anything else than byte-level pieces (a normalizer, a blank put before texts,
another pre-tokenizer, model or rule of truncation).

Defined results: null and empty texts have the end id alone; very long texts are
encoded whole, by the library if they are beyond a chunk; null doc_ids come
first; rows of one doc_id are ordered by a hash of their text, ties among them are
equal rows; repeated rows give a row each; an empty table gives none; extra columns
are not read.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import blobs, wavelet
from brindle.llm.shared import scratch, written

END = 0
#: Ids of a file, characters cut at once, pieces that a worker remembers, and the longest of them.
SHARD, _CHARS, _PIECES, _LONG = 1 << 21, 1 << 19, 1 << 19, 200
_L, _N, _O, _S, _UNSURE = range(5)
# Endings that an apostrophe takes with it.
_ONE, _TWO = ("s", "t", "m", "d"), ("re", "ve", "ll")
#: The ranges of characters whose classes the cuts rely on.
_SETTLED = ((0x00, 0x1B), (0x20, 0x052F), (0x2000, 0x206F), (0x20A0, 0x20BF))


def _classes() -> np.ndarray:
    out = np.full(1 << 16, _UNSURE, np.uint8)
    chars = "".join(chr(c) for lo, hi in _SETTLED for c in range(lo, hi + 1))
    for kind, pattern in ((_O, r"[^\p{Cn}]"), (_L, r"\p{L}"), (_N, r"\p{N}"), (_S, r"\p{White_Space}")):
        out[[ord(c) for c in regex.findall(pattern, chars)]] = kind
    return out


class Encoder:
    def __init__(self, path: str) -> None:
        # Spark's tasks are the parallelism; the library's threads would each hold memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.levels = max(1, (self.library.get_vocab_size() - 1).bit_length())
        self.by_pieces = self._is_plain(json.loads(self.library.to_str()))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.classes = _classes()
        rng = np.random.default_rng(20)
        self.mix = rng.integers(0, 2**64, 1 << 16, np.uint64)
        base = int(rng.integers(0, 2**62)) * 2 + 1
        self.powers = np.cumprod(np.full(2 * _CHARS, base, np.uint64))
        self.inverse = np.cumprod(np.full(2 * _CHARS, pow(base, -1, 2**64), np.uint64))
        self.names = self._byte_names() if self.by_pieces else {}
        self._forget()

    @staticmethod
    def _is_plain(file: dict) -> bool:
        """Whether texts are cut as cuts() does and each piece goes to the model alone."""
        cutter, model = file.get("pre_tokenizer") or {}, file["model"]
        return (
            not any(file.get(k) for k in ("normalizer", "truncation", "padding"))
            and (cutter.get("type"), cutter.get("add_prefix_space"), cutter.get("use_regex", True)) == ("ByteLevel", False, True)
            and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "fuse_unk"))
        )

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.used = self.n = 0
        self.at = np.zeros(1 << 16, np.int64)

    def _byte_names(self) -> dict[int, str]:
        """The character that the library's model has for each byte of UTF-8, asked of its own cutter."""
        out: dict[int, str] = {}
        # Every first byte with every second byte, at least once: one to four bytes long.
        for c in [*range(0x800), *range(0x800, 0xD800, 0x40), *range(0xE000, 0x110000, 0x1000)]:
            raw = chr(c).encode()
            found = self.library.pre_tokenizer.pre_tokenize_str(chr(c))[0][0]
            if len(found) == len(raw):
                out.update(zip(raw, found, strict=True))
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces by the library's model and appends their ids.

        A piece is one cut already, so the model is asked directly, in its
        characters for bytes; the way through the whole library costs four times as much.
        """
        tokenize, names = self.library.model.tokenize, self.names
        found = [[t.id for t in tokenize(p.encode().decode("latin-1").translate(names))] for p in pieces]
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        ends = np.cumsum([len(f) for f in found]) + self.used
        if self.n + len(ends) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(max(len(self.at), len(ends)), np.int64)])
        self.at[self.n + 1 : self.n + 1 + len(ends)] = ends
        self.n += len(ends)
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, END after each, and the number of each text's (END included)."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        lo = size = 0
        for hi, text in enumerate(texts, 1):
            size += len(text)
            if size >= _CHARS or hi == len(texts):
                parts.append((self._chunk if self.by_pieces else self._by_library)(texts[lo:hi]))
                lo, size = hi, 0
        if not parts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        cps = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(cps) > len(self.powers):  # one very long text
            return self._by_library(texts)
        odd = (cps >= 1 << 16) | (self.classes[np.minimum(cps, (1 << 16) - 1)] == _UNSURE)
        slow = np.zeros(len(texts), bool)
        if odd.any():
            slow[np.searchsorted(ends, np.flatnonzero(odd), side="right")] = True
        slow |= np.array([any(s in t for s in self.special) for t in texts])
        if slow.any():
            out, counts = [], np.zeros(len(texts), np.int64)
            for kind in (False, True):
                some = np.flatnonzero(slow == kind)
                if len(some):
                    got, n = (self._by_library if kind else self._by_pieces)([texts[i] for i in some])
                    counts[some] = n
                    out += list(zip(some.tolist(), np.split(got, np.cumsum(n)[:-1]), strict=True))
            out.sort(key=lambda x: x[0])
            return np.concatenate([x[1] for x in out]), counts
        return self._by_pieces(texts, whole, cps, ends)

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.append(np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32), np.uint32(END)) for t in texts]
        return np.concatenate(found), np.array([len(f) for f in found], np.int64)

    def cuts(self, cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces start, of texts that end at ends; a rule for each class of run.

        Of white space before something else the last character stands apart: a
        blank goes to what follows, anything else is a piece. A lone apostrophe
        takes the letters of an English contraction with it.
        """
        n = len(cps)
        kind = self.classes[cps]
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        opens = np.zeros(n + 1, bool)
        opens[0] = opens[ends] = True
        new |= opens[:n]
        start = np.flatnonzero(new)
        end = np.append(start[1:], n)
        what = kind[start]
        followed = ~opens[end]
        blank = (what == _S) & followed & (cps[end - 1] == 32)
        # White space: its run, unless it is one blank that goes to what follows.
        space = (what == _S) & ~(blank & (end - start == 1))
        apart = (what == _S) & followed & ~blank & (end - start > 1)
        takes = np.concatenate(([False], blank[:-1]))
        solid = what != _S
        at = start - takes
        lone = np.flatnonzero((what == _O) & ~takes & (end - start == 1) & (cps[start] == 39) & followed)
        lone = lone[what[lone + 1] == _L] if len(lone) else lone
        if len(lone):
            letters = np.concatenate([cps, np.zeros(2, cps.dtype)])
            a, b = letters[start[lone] + 1], letters[start[lone] + 2]
            room = end[lone + 1] - start[lone + 1] > 1
            two = room & np.any([(a == ord(x)) & (b == ord(y)) for x, y in _TWO], axis=0)
            one = np.isin(a, [ord(x) for x in _ONE])
            k = np.where(one, 1, np.where(two, 2, 0))
            at[lone + 1] += k
            gone = lone[(k > 0) & (at[lone + 1] >= end[lone + 1])] + 1
            solid[gone] = False
        marks = np.zeros(n, bool)
        marks[start[space]] = True
        marks[end[apart] - 1] = True
        marks[at[solid]] = True
        return np.flatnonzero(marks)

    def _by_pieces(self, texts: list[str], whole: str | None = None, cps: np.ndarray | None = None, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        if whole is None:
            whole = "".join(texts)
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            cps = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if not len(cps):
            return np.full(len(texts), END, np.uint32), np.ones(len(texts), np.int64)
        if len(self.known) > _PIECES:
            self._forget()
        start = self.cuts(cps, ends)
        stop = np.append(start[1:], len(cps))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.mix[cps] * self.powers[: len(cps)])))
        hashes = (sums[stop] - sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64) * self.mix[1]
        which, keys = pd.factorize(hashes)
        first = np.empty(len(keys), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        get = self.known.get
        place = np.fromiter((get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            a, b = start[first[missing]].tolist(), stop[first[missing]].tolist()
            base = self.n
            self._learn([whole[i:j] for i, j in zip(a, b, strict=True)])
            place[missing] = base + np.arange(len(missing))
            self.known.update((k, p) for k, p, i, j in zip(keys[missing].tolist(), place[missing].tolist(), a, b, strict=True) if j - i <= _LONG)
        at = self.at
        begin = at[place][which]
        size = (at[place + 1] - at[place])[which]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        # Pieces never run over a text's end.
        upto = total[np.searchsorted(start, ends)]
        counts = np.diff(upto, prepend=0) + 1
        out = np.full(len(ids) + len(texts), END, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(counts) - 1] = False
        out[keep] = ids
        return out, counts


_HELD: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The process's encoder of a file: tasks that follow on a worker find the pieces that it knows."""
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = Encoder(path)
    return _HELD[path]


_MANIFEST = "range_no int, file_no int, path string, before long, n_docs long, n_ids long"


def _writer(folder: str, tokenizer: str):  # noqa: ANN202
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        counts: list[np.ndarray] = []
        held = before = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, names, counts, held, before, number
            path = f"{folder}/{part:06d}-{number:06d}.bwm"
            docs = np.array([0 if d is None else d for d in names], "<i8").tobytes() + np.concatenate(counts).astype("<i8").tobytes() + np.packbits([d is None for d in names]).tobytes()
            blobs.write(path, wavelet.encode(np.concatenate(ids), encoder.levels, docs))
            row = pa.RecordBatch.from_pydict({"range_no": pa.array([part], pa.int32()), "file_no": pa.array([number], pa.int32()), "path": [path], "before": [before], "n_docs": [len(names)], "n_ids": [held]})
            before, number = before + held, number + 1
            ids, names, counts, held = [], [], [], 0
            return row

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            total = np.cumsum(sizes)
            lo = 0
            while lo < len(sizes):
                # A few texts at a time leave Arrow's memory.
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] - sizes[lo] + _CHARS)))
                got, n = encoder.encode([t or "" for t in batch.column("text").slice(lo, hi - lo).to_pylist()])
                ids.append(got.astype(np.uint16) if encoder.levels <= 16 else got)
                counts.append(n)
                names += batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                held += len(got)
                lo = hi
                if held >= SHARD:
                    yield flush()
        if names:
            yield flush()

    return write


def write_shards(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files; their manifest, a row each: range_no and file_no (their order), path, before (ids of the range's files ahead), n_docs, n_ids."""
    folder = scratch(docs.sparkSession, "tokens")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(ordered.mapInArrow(_writer(folder, tokenizer), _MANIFEST), "manifest")


def read_file(path: str) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, the number of ids of each document, and all ids of a file."""
    with blobs.Reader(path) as read:
        file = wavelet.WaveletFile(read, read.size)
        extra, ids = file.extra(), file.decode()
    # 16 bytes a document and a bit for a null doc_id.
    n = next(k for k in range(max(0, len(extra) // 17 - 1), len(extra) // 16 + 1) if 16 * k + (k + 7) // 8 == len(extra))
    names, counts = np.frombuffer(extra, "<i8", n), np.frombuffer(extra, "<i8", n, 8 * n)
    null = np.unpackbits(np.frombuffer(extra, np.uint8, offset=16 * n), count=n)
    return [None if z else d for d, z in zip(names.tolist(), null.tolist(), strict=True)], counts, ids


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            names, counts, ids = read_file(row["path"])
            ends = np.cumsum(counts)
            data = ids.astype("<u4").tobytes()
            crcs = [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(names, pa.int64()), "range_no": pa.array([row["range_no"]] * len(names), pa.int32()), "within": pa.array(ends - counts + row["before"], pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())}
            )


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    # A row per range: as many as tasks wrote.
    ranges = manifest.groupBy("range_no").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("range_no", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    files = manifest.repartition(max(1, min(manifest.count(), 20_000)))
    rows = files.mapInArrow(_read, "doc_id long, range_no int, within long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(starts), "range_no").select("doc_id", (F.col("ahead") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer))
