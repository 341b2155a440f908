"""Repeated strings: every byte that a repeated string of 400 bytes covers goes; passages of over 50 words that documents share are told.

Both are windows of symbols (see anchors.py), 400 bytes or 51 words, and go the
same way together. A window of bytes repeats if it starts anywhere else; one of
words if another document has it.

1. Each window has an anchor, so a window can only repeat if its anchor's gram
   does: grams that occur once go.
2. An anchor's windows together are its context. A context that occurs twice or
   more (by 128 bits of its symbols, beside its gram's 63) repeats whole, and one
   of it is enough from here on.
3. A gram with several contexts is a suffix bucket: its distinct contexts' symbols
   are fetched, and the bucket's suffixes are sorted at once, long ties by a
   difference cover's ranks (see suffixes.py), in packs of PACK bytes. Windows
   equal to a neighbour in that order repeat; this comparison is exact.
4. A bucket of over HOT contexts would be too much for one task. Its contexts are
   cut in two, by where windows have the anchor, and dealt again by the longer
   string that each half's windows share, with step 2 for the halves. The range
   of places halves each time, to one place in the end: windows that are equal.
5. Covered symbols are the windows' union; each text drops its own.

Anchors are two hashes and three places for each 100 bytes of text; only they
and the symbols of distinct contexts of shared grams are shuffled, besides the
texts that are read again by key. Keys that many rows have are met by a broadcast
table of at most SHARES of them, so that no task holds more than that part.

Defined results: a null text is empty; texts shorter than a window keep all;
very long texts are cut in overlapping parts for their anchors only, and come
out whole; repeated rows give a row each, and their windows repeat (but as one
document); ties do not arise; a null doc_id is a value like any other; empty
tables give none; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.anchors import BYTES, KINDS, Hasher, anchors, symbols
from brindle.llm.shared import removed, written
from brindle.llm.suffixes import repeated

#: Contexts of one bucket that a task may hold; bytes of contexts that are sorted at once; bytes of texts that are cut at once.
HOT, PACK, SLICE = 8192, 4 << 20, 4 << 20
#: A key with over one in SHARES of all rows (LEAST rows at least) does not go to a task of its own.
SHARES, LEAST = 10_000, 1000
_ANCHORS = "doc_id long, th long, gram long, context binary, place long, first long, last long"
#: done: its spans are known; base: where it starts; anchor: the anchor's place in it; near, far: places that a window may have the anchor at.
_CONTEXTS = "gram long, done boolean, doc_id long, th long, base long, anchor int, near int, far int, symbols binary"
_SPANS = "kind int, doc_id long, th long, lo long, hi long"
_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long"


def _columns(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]


def _table(schema: str, *columns: object) -> pa.RecordBatch:
    named = _columns(schema)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, named, strict=True)], [n for n, _ in named])


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    return _table(schema, *([r[k] for r in rows] for k in range(len(_columns(schema)))))


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [b or b"" for b in batch.column("text").cast(pa.binary()).to_pylist()]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about SLICE bytes of text."""
    ends = np.cumsum([len(b) for b in _bytes(batch)])
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE)))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in (part for whole in batches for part in _slices(whole)):
        data = _bytes(batch)
        for kind in KINDS:
            own = [symbols(b, kind) for b in data]
            text, place, first, last, gram = anchors(own, hasher, kind)
            size = kind.size
            digests = [
                xxhash.xxh3_128_digest(own[t][size * f : size * (e + kind.window)], seed=p - f)
                for t, p, f, e in zip(text.tolist(), place.tolist(), first.tolist(), last.tolist(), strict=True)
            ]
            pick = pa.array(text, pa.int64())
            yield _table(_ANCHORS, batch.column("doc_id").take(pick), batch.column("th").take(pick), gram.view(np.int64), digests, place, first, last)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for doc_id, th, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), _bytes(batch), batch.column("wanted").to_pylist(), strict=True):
            own: dict[int, bytes] = {}
            for w in wanted:
                kind = KINDS[w["gram"] & 1]
                if kind.number not in own:
                    own[kind.number] = symbols(text, kind)
                part = own[kind.number][kind.size * w["first"] : kind.size * (w["last"] + kind.window)]
                rows.append((w["gram"], w["done"], doc_id, th, w["first"], w["place"] - w["first"], 0, kind.window - kind.gram, part))
                size += len(part)
                if size > SLICE:
                    yield _rows(_CONTEXTS, rows)
                    rows, size = [], 0
        yield _rows(_CONTEXTS, rows)


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    """Covered spans of the contexts that are not done, from a pack of whole buckets of one kind."""
    kind = KINDS[rows[0][0] & 1]
    grams = np.array([r[0] for r in rows], np.int64)
    done = np.array([r[1] for r in rows], bool)
    group = np.cumsum(np.concatenate(([0], grams[1:] != grams[:-1])))
    which, start, number = repeated([r[8] for r in rows], group, np.array([r[5] for r in rows], np.int64), kind.window, kind.symbol)
    if kind is not BYTES and len(which):
        # A passage is one that two documents have; what is done is.
        known: dict[tuple, int] = {}
        who = np.array([known.setdefault((r[2], r[3]), len(known)) for r in rows])[which]
        size = int(number[-1]) + 1
        first, last = np.full(size, len(known)), np.full(size, -1)
        np.minimum.at(first, number, who)
        np.maximum.at(last, number, who)
        shared = (first < last) | (np.bincount(number, done[which], size) > 0)
        which, start = which[shared[number]], start[shared[number]]
    which, start = which[~done[which]], start[~done[which]]
    if not len(which):
        return _rows(_SPANS, [])
    order = np.lexsort((start, which))
    which, start = which[order], start[order]
    new = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1))))
    ends = np.append(new[1:], len(start)) - 1
    own = [rows[w] for w in which[new].tolist()]
    base = np.array([r[4] for r in own], np.int64)
    return _table(_SPANS, np.full(len(own), kind.number), [r[2] for r in own], [r[3] for r in own], base + start[new], base + start[ends] + kind.window)


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix buckets, one pack of them after another; rows come sorted by kind and gram."""
    pack: list[tuple] = []
    bucket: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c, _ in _columns(_CONTEXTS)), strict=True):
            if bucket and bucket[0][0] != row[0]:
                pack += bucket
                if size >= PACK or (bucket[0][0] ^ row[0]) & 1:
                    yield _pack(pack)
                    pack, size = [], 0
                bucket = []
            bucket.append(row)
            size += len(row[8])
    if pack or bucket:
        yield _pack(pack + bucket)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts cut by the place that windows have the anchor at, under the string that each half's windows share."""
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(batch.column(c).to_pylist() for c, _ in _columns(_CONTEXTS)), strict=True):
            gram, done, doc_id, th, base, anchor, near, far, data = row
            kind = KINDS[gram & 1]
            size, window = kind.size, kind.window
            middle = (near + far + 1) // 2
            for x, y in ((near, middle - 1), (middle, far)):
                lo, hi = max(0, anchor - y), min(len(data) // size - window, anchor - x)
                if lo > hi:
                    continue
                part, at = data[size * lo : size * (hi + window)], anchor - lo
                share = xxhash.xxh3_64_intdigest(part[size * (at - x) : size * (at - y + window)], seed=x << 16 | y)
                digest = xxhash.xxh3_128_digest(part, seed=at)
                out.append(((share >> 1 << 1 | kind.number) - 2**63, done, doc_id, th, base + lo, at, x, y, part, digest))
        yield _rows(f"{_CONTEXTS}, context binary", out)


def _same_text(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["__d"]) & (left["th"] == right["__t"])


def _is_bytes() -> Column:
    return F.col("gram").bitwiseAND(F.lit(1)) == 0


def _met(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows that have a key of keys, with the columns of keys; keys.n: the rows that have it.

    Keys of over one in SHARES of the rows are SHARES at most: they are broadcast, and their rows not dealt.
    """
    total = keys.agg(F.sum("n").alias("n")).first()["n"] or 0
    bound = max(LEAST, total // SHARES)
    hot = F.broadcast(keys.filter(F.col("n") > bound))
    usual = rows.join(F.broadcast(keys.filter(F.col("n") > bound).select(*on)), on, "left_anti").join(keys.filter(F.col("n") <= bound), on)
    return rows.join(hot, on).unionByName(usual)


def _settled(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of contexts (gram, context, doc_id, th, done, lo, hi and what else is kept) the spans of those that repeat whole, and those to go on.

    One of each that repeats goes on, done; with d: the distinct contexts of its gram, two at least.
    """
    kept = [c for c in rows.columns if c not in ("gram", "context", "done")]
    who = F.xxhash64("doc_id", "th")
    stats = rows.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(who).alias("w"), F.max(who).alias("x"), F.max("done").alias("any_done"), F.first(F.struct(*kept)).alias("one"))
    whole = (_is_bytes() & (F.col("n") > 1)) | (~_is_bytes() & (F.col("w") != F.col("x"))) | F.col("any_done")
    stats = written(stats.withColumn("whole", whole), f"{name}-stats")
    spans = _met(rows, stats.filter("whole and n > 1").select("gram", "context", "n"), ["gram", "context"]).filter(~F.col("done"))
    spans = spans.select((~_is_bytes()).cast("int").alias("kind"), "doc_id", "th", "lo", "hi")
    going = F.when(F.col("whole"), 1).otherwise(F.col("n"))
    several = written(stats.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.sum(going).alias("d")).filter("n > 1"), f"{name}-several")
    ones = _met(stats.withColumnRenamed("n", "k"), several, ["gram"])
    # Of words, one document's own repeats are each to be covered.
    single = ones.filter("whole or k = 1").select("gram", "context", F.col("whole").alias("done"), "d", "one.*")
    own = ones.filter("not whole and k > 1").select("gram", "context", F.col("k").alias("n"), "d")
    return spans, single.unionByName(_met(rows, own, ["gram", "context"]).select("gram", "context", "done", "d", *kept))


def _of_kind(of_bytes: int, of_words: int) -> Column:
    return F.when(_is_bytes(), of_bytes).otherwise(of_words)


def covered_spans(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """kind (0: in bytes, 1: in words), doc_id, th (a hash of the text), lo, hi: spans that repeated windows cover; spans may overlap."""
    hot = HOT if hot is None else hot
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = written(texts.mapInArrow(_find, _ANCHORS), "anchors")
    who = F.xxhash64("doc_id", "th")
    often = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min(who).alias("w"), F.max(who).alias("x"))
    often = written(often.filter((_is_bytes() & (F.col("n") > 1)) | (~_is_bytes() & (F.col("w") != F.col("x")))).select("gram", "n"), "often")
    shared = _met(found, often, ["gram"]).drop("n")
    shared = written(shared.withColumns({"done": F.lit(False), "lo": F.col("first"), "hi": F.col("last") + _of_kind(*(k.window for k in KINDS))}), "shared")
    removed(found, often)
    spans, rest = _settled(shared, "contexts")
    spans = [spans]
    # Each text gives its contexts' symbols once.
    wanted = rest.groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).agg(F.collect_list(F.struct("gram", "done", "place", "first", "last", "d")).alias("wanted"))
    wanted = written(wanted, "wanted")
    pieces = texts.join(wanted, _same_text(texts, wanted)).select("doc_id", "th", "text", "wanted").mapInArrow(_fetch, _CONTEXTS)
    crowded = wanted.select(F.explode("wanted").alias("w")).filter(F.col("w.d") > hot).select("w.gram", F.col("w.d").alias("n")).distinct()
    while not crowded.isEmpty():
        pieces = written(pieces, "pieces")
        some = _met(pieces, crowded, ["gram"]).select(pieces.columns).mapInArrow(_deal, f"{_CONTEXTS}, context binary")
        size = F.octet_length("symbols") / _of_kind(*(k.size for k in KINDS))
        dealt = written(some.withColumns({"lo": F.col("base"), "hi": F.col("base") + size.cast("long")}), "dealt")
        covered, rest = _settled(dealt, "halves")
        rest = written(rest, "rest")
        spans += [covered, _sorted(_others(pieces, crowded))]
        pieces, crowded = rest.select(pieces.columns), rest.filter(F.col("d") > hot).select("gram", F.col("d").alias("n")).distinct()
    spans.append(_sorted(pieces))
    whole = spans[0]
    for more in spans[1:]:
        whole = whole.unionByName(more)
    return whole.distinct()


def _others(pieces: DataFrame, crowded: DataFrame) -> DataFrame:
    return pieces.join(crowded.select("gram"), "gram", "left_anti")


def _sorted(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("gram").sortWithinPartitions(F.col("gram").bitwiseAND(F.lit(1)), "gram").mapInArrow(_sort, _SPANS)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for data, spans in zip(_bytes(batch), batch.column("spans").to_pylist(), strict=True):
            runs, passages = (_merged([(s["lo"], s["hi"]) for s in spans or () if s["kind"] == k.number]) for k in KINDS)
            kept, at = hashlib.sha256(), 0
            for lo, hi in runs:
                kept.update(data[at:lo])
                at = hi
            kept.update(data[at:])
            out.append((len(data), sum(hi - lo for lo, hi in runs), len(runs), kept.hexdigest(), len(passages), sum(hi - lo for lo, hi in passages)))
        yield _table(_DIGEST, batch.column("doc_id"), *([o[k] for o in out] for k in range(6)))


def substring_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_words: one row per row.

    n_passages: runs of over 50 words that other documents have too (each window of 51 in one at least), and their words.
    """
    spans = covered_spans(docs).groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).agg(F.collect_list(F.struct("kind", "lo", "hi")).alias("spans"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    joined = texts.join(spans, _same_text(texts, spans), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, _DIGEST)
