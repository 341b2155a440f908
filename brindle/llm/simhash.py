"""SimHash near-duplicates: BK-trees over shards that share a band of the fingerprint.

1. A document's fingerprint has a bit for each of 64 that is set in over half of
   its shingles' hashes.
2. Equal fingerprints are one: each keeps its smallest doc_id.
3. Fingerprints that differ in at most RADIUS bits agree on one of RADIUS + 1
   bands of bits at least, so each is dealt to that many shards, by band and
   its value. A shard over HOT fingerprints is dealt again by bands of the bits
   that its members need not share. After LEVELS deals at most 13 bits are
   open, so that a shard cannot exceed 8192 fingerprints whatever the data.
4. Each shard's BK-tree (children keyed by their Hamming distance to the parent)
   is built and searched in one task, along edges within the radius only. The
   trees of all shards grow with the corpus, so each goes to the task that
   holds its shard's queries rather than to all.
5. A shard gives a spanning forest of its links, not all pairs; the components
   of these edges are the result.

keep_one_similar() is for pipelines: near copies by the share of common five-word
shingles. Equal shingle sets are one; each set is dealt to shards by its smallest
hash under a few mixings, the shard's BK-tree gives the pairs whose fingerprints
(of the distinct shingles) are near enough, a sketch of the sets passes those that
may be similar and so puts the shard's sets into groups, and within a group the sets
themselves decide: a set meets those that are in no component yet. Pairs never leave a task.

Defined results: a null text is an empty one and has fingerprint zero, which
links like any other; very long texts are hashed whole, a block of hashes at a time;
repeated rows give a row each; ties in a component go to the smallest doc_id, and of
equal rows one stays; an empty table gives none; a null doc_id belongs to
the group of its fingerprint, whose component is null if no doc_id is known;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.graph import components
from brindle.llm.shared import row_key, written

BITS, RADIUS, SEED, SHINGLE = 64, 2, 42, 3
HOT, LEVELS = 4096, 4
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Hashes whose bits are counted at once.
_BLOCK = 1 << 15
#: Fingerprints that walk the trees side by side, and pairs that are looked at together, about.
_QUERIES, _PAIRS = 1024, 1 << 20


def shingle_hashes(text: str | None, n: int = SHINGLE) -> list[int]:
    """Of all shingles, repeats included. Words are runs of anything but ASCII white space, which is what bytes.split() cuts at."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: list[int] | np.ndarray) -> int:
    """The number whose bits are those that are set in over half the hashes; 0 for none."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = np.array(hashes[at : at + _BLOCK], np.uint64).astype("<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Unsigned."""
    return majority(shingle_hashes(text, n))


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        values = np.fromiter(map(fingerprint, batch.pop("text")), np.uint64, len(batch))
        yield batch.assign(fp=values.view(np.int64))


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """docs without text, but with fp: its fingerprint as a signed long."""
    kept = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    return docs.select(*kept.names, "text").mapInPandas(_fingerprints, kept.add("fp", T.LongType()))


def _deal(bits: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.array_split(bits, parts)


def _extract(fp: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The values of some bits, packed."""
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits.tolist()):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def open_bits(path: str) -> np.ndarray:
    """The bits that the members of a shard need not share; path: the band taken at each deal, as digits."""
    bits = np.arange(BITS)
    for band in path:
        taken = _deal(bits, RADIUS + 1)[int(band)]
        bits = np.setdiff1d(bits, taken)
    return bits


def _dealer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each fingerprint of a shard (path, key) into its shards of the next deal."""
    for batch in batches:
        for path, rows in batch.groupby("path", sort=False):
            fp = rows["fp"].to_numpy(np.int64)
            key = rows["key"].to_numpy(np.int64).view(np.uint64)
            for i, band in enumerate(_deal(open_bits(path), RADIUS + 1)):
                # Shards of one path differ in key; the value of the new band is mixed in, not appended, so keys stay long.
                value = _extract(fp.view(np.uint64), band)
                mixed = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (value + np.uint64((i + 1) * 0xD1B54A32D192ED03 % 2**64))
                yield pd.DataFrame({"path": path + str(i), "key": mixed.view(np.int64), "fp": fp})


def pairs_within(shard: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of places (a later, an earlier) of a shard's fingerprints within the radius, in parts; and whether all of the
    later ones' pairs are out. shard: sorted numbers.

    All shards' BK-trees grow side by side: in each round every fingerprint
    not yet placed moves one edge down, and the first to come along an edge
    becomes its node. The search walks all (query, node) pairs likewise.
    """
    n = len(fp)
    if not n:
        return
    first = np.r_[True, shard[1:] != shard[:-1]]
    parent, edge = np.full(n, -1), np.zeros(n, np.int64)
    node = np.flatnonzero(first)[np.cumsum(first) - 1]
    left = np.flatnonzero(~first)
    root = node
    at = node[left]
    while len(left):
        d = np.bitwise_count(fp[left] ^ fp[at]).astype(np.int64)
        key = at * (BITS + 1) + d
        taken, where = np.unique(key, return_index=True)
        parent[left[where]], edge[left[where]] = at[where], d[where]
        child = left[where][np.searchsorted(taken, key)]
        rest = np.ones(len(left), bool)
        rest[where] = False
        left, at = left[rest], child[rest]
    # Children of a node by edge: sorted keys, searched by range.
    kids = np.flatnonzero(parent >= 0)
    keys = parent[kids] * (BITS + 1) + edge[kids]
    order = np.argsort(keys)
    kids, keys = kids[order], keys[order]
    # Wide searches meet most of a shard, so fewer go side by side in large ones.
    width = int(np.clip(_PAIRS // np.diff(np.append(np.flatnonzero(first), n)).max(), 16, _QUERIES))
    for lo in range(0, n, width):
        query = np.arange(lo, min(n, lo + width))
        at = root[query]
        while len(query):
            d = np.bitwise_count(fp[query] ^ fp[at]).astype(np.int64)
            near = (d <= radius) & (at < query)
            a, b = query[near], at[near]
            yield a, b, False
            base = at * (BITS + 1)
            begin = np.searchsorted(keys, base + np.maximum(d - radius, 0))
            count = np.searchsorted(keys, base + np.minimum(d + radius, BITS), side="right") - begin
            query = np.repeat(query, count)
            at = kids[np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
        yield np.empty(0, np.int64), np.empty(0, np.int64), True


def _top(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = label[x]
        if (up == x).all():
            return x
        x = up


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Joins the trees of pairs in label; the pairs that did it."""
    links = []
    while len(a):
        ra, rb = _top(label, a), _top(label, b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        # One hook per root and round, on the smaller root, so that no cycle forms.
        big, small = np.maximum(ra, rb), np.minimum(ra, rb)
        roots, one = np.unique(big, return_index=True)
        label[roots] = small[one]
        links.append(np.stack([a[one], b[one]], axis=1))
    return links


def forest_links(shard: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Spanning links (pairs of places) of each shard's fingerprints; shard: sorted numbers."""
    label = np.arange(len(fp))
    links = [pair for a, b, _ in pairs_within(shard, fp, radius) for pair in _hook(label, a, b)]
    return np.concatenate(links) if links else np.empty((0, 2), np.int64)


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of the shards of a partition that is sorted by shard; a shard may run over several batches."""
    held: pd.DataFrame | None = None

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["path", "key", "fp"]].drop_duplicates()
        names = rows["path"].to_numpy(object), rows["key"].to_numpy(np.int64)
        new = np.r_[True, (names[0][1:] != names[0][:-1]) | (names[1][1:] != names[1][:-1])]
        fp = rows["fp"].to_numpy(np.int64)
        pairs = forest_links(np.cumsum(new), fp.view(np.uint64))
        return pd.DataFrame({"x": fp[pairs[:, 0]], "y": fp[pairs[:, 1]]})

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = (rows["path"] == rows["path"].iloc[-1]) & (rows["key"] == rows["key"].iloc[-1])
        held = rows[last]
        yield found(rows[~last]) if (~last).any() else pd.DataFrame({"x": [], "y": []}, dtype="int64")
    if held is not None:
        yield found(held)


def links(distinct: DataFrame) -> DataFrame:
    """Spanning links x, y of all pairs within the radius; distinct: fp."""
    shards = "path string, key long, fp long"
    rest = distinct.select(F.lit("").alias("path"), F.lit(0).cast("long").alias("key"), "fp")
    edges = None
    for level in range(LEVELS):
        dealt = rest.mapInPandas(_dealer, shards)
        dealt = written(dealt, "shards") if level else dealt
        sizes = dealt.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = written(dealt.join(sizes, ["path", "key"]), "sized")
        small = sized if level == LEVELS - 1 else sized.filter(F.col("n") <= HOT)
        got = written(small.repartition("path", "key").sortWithinPartitions("path", "key").select("path", "key", "fp").mapInPandas(_search, "x long, y long"), "links")
        edges = got if edges is None else edges.unionByName(got)
        rest = sized.filter(F.col("n") > HOT).select("path", "key", "fp")
        if rest.isEmpty():
            break
    return edges


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, and what else is to be kept) without text: one row per row, with fp and component_id."""
    prints = written(with_fingerprint(docs), "prints")
    least = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    edges = links(least.select("fp"))
    # Fingerprints, signed, are the nodes; the smallest doc_id of a component is found afterwards.
    groups = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    grouped = least.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    grouped = written(grouped, "grouped")
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(ids, "component").select("fp", "component", "component_id")
    return prints.join(named, "fp")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hexadecimal, component_id."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- copies by similarity


@dataclass(frozen=True)
class Near:
    """What counts as a near copy: words of a shingle and the least share of common shingles (Jaccard);
    slack: taken off for the error of the estimate, before the sets are compared (four deviations); radius: in bits, beyond which no such pair lies (four deviations
    above the mean for 0.8); keys: shards of a document; more: those of a crowded shard's documents in the next deal."""

    shingle: int = 5
    similarity: float = 0.8
    slack: float = 0.072
    radius: int = 22
    keys: int = 6
    more: int = 6


_BINS = 512
#: Hashes of a block of a group of sets; two blocks meet in a task.
BLOCK = 1 << 20


def _smallest(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of some distinct hashes under n further mixings."""
    out = np.empty(n, np.uint64)
    for i in range(n):
        mixed = (values ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64((2 * i + 1) * 0xD6E8FEB86659FD93 % 2**64 | 1)
        out[i] = (mixed ^ (mixed >> np.uint64(31))).min()
    return out


def sketch(values: np.ndarray) -> bytes:
    """For each of _BINS parts of the hashes a byte of its smallest, from 1 on; 0 for a part without any.

    The share of equal bytes among parts that either has is an estimate of the
    share of common hashes: nearly exact for few hashes, within 0.018 (one
    deviation) for many.
    """
    out = np.zeros(_BINS, np.uint8)
    if len(values):
        part = (values % np.uint64(_BINS)).astype(np.int64)
        order = np.lexsort((values, part))
        first = order[np.concatenate(([True], part[order][1:] != part[order][:-1]))]
        out[part[first]] = (values[first] // np.uint64(_BINS) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out.tobytes()


def _features(near: Near, levels: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = near.keys + near.more * levels
        for batch in batches:
            rows = []
            for text in batch.pop("text"):
                values = np.unique(np.array(shingle_hashes(text, near.shingle), np.uint64))
                whole = xxhash.xxh64_intdigest(values.tobytes(), 1)
                keys = _smallest(values, n) if len(values) else np.zeros(n, np.uint64)
                rows.append((whole - 2**63, np.uint64(majority(values)).astype(np.int64), keys.view(np.int64), sketch(values), len(values)))
            yield batch.assign(**{name: pd.Series([r[k] for r in rows], dtype=object if k in (2, 3) else "int64", index=batch.index) for k, name in enumerate(("same", "fp", "keys", "sketch", "n"))})

    return run


def _groups(near: Near, block: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Members (team, same) of the groups that a partition's shards (rows sorted by key and same; a shard may run over several batches) fall into.

    A group is what the shard's BK-tree and then the sketch link, of sets whose components are apart, so a set is in
    one of a shard's groups at most. Equal groups of several shards are equal rows. A group of more than block hashes
    in all is cut into parts, and any two of these are a team.
    """
    least = near.similarity - near.slack

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        key, same, component, n = (rows[c].to_numpy(np.int64) for c in ("key", "same", "component", "n"))
        marks = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, _BINS)
        label = np.arange(len(key))
        for a, b, done in pairs_within(np.cumsum(np.r_[True, key[1:] != key[:-1]]), rows["fp"].to_numpy(np.int64).view(np.uint64), near.radius):
            # What is in one group already need not be looked at; a part at a time, as that grows.
            for at in range(0, len(a), 8192):
                x, y = a[at : at + 8192], b[at : at + 8192]
                apart = (component[x] != component[y]) & (_top(label, x) != _top(label, y))
                x, y = x[apart], y[apart]
                one, other = marks[x], marks[y]
                share = ((one == other) & (one > 0)).sum(axis=1) / np.maximum(((one > 0) | (other > 0)).sum(axis=1), 1)
                _hook(label, x[share >= least], y[share >= least])
            if done:
                label = _top(label, label)
        group = _top(label, label)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        teams, members = [], []
        for own in np.split(order, cuts):
            if len(own) < 2:
                continue
            part = np.cumsum(n[own]) // block
            parts = [own[part == i] for i in np.unique(part)]
            for team in [own] if len(parts) == 1 else (np.concatenate(two) for two in combinations(parts, 2)):
                teams.append(np.full(len(team), xxhash.xxh64_intdigest(np.sort(same[team]).tobytes()) - 2**63, np.int64))
                members.append(same[team])
        none = [np.empty(0, np.int64)]
        return pd.DataFrame({"team": np.concatenate(teams or none), "same": np.concatenate(members or none)})

    return _by_key(found, "key")


def _by_key(found: Callable[[pd.DataFrame], pd.DataFrame], key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """found() on whole keys of a partition that is sorted by them; a key may run over several batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            last = batch[key] == batch[key].iloc[-1]
            if held and held[0][key].iloc[0] == batch[key].iloc[-1]:
                held.append(batch)
                continue
            if len(rows := pd.concat([*held, batch[~last]], ignore_index=True)):
                yield found(rows)
            held = [batch[last]]
        if held:
            yield found(pd.concat(held, ignore_index=True))

    return run


def _values(near: Near) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of texts (same, text) the sorted hashes of their shingle sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                sets = [np.unique(np.array(shingle_hashes(t, near.shingle), np.uint64)).tobytes() for t in part["text"]]
                yield pd.DataFrame({"same": part["same"].to_numpy(), "hashes": pd.Series(sets, dtype=object)})

    return run


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning links (pairs of places) of the similar among some sets of distinct hashes.

    Each set in turn meets those that no component has yet, so what is linked is not met again: sets that are all
    alike cost one round, those of which none are alike all pairs, a set's at once.
    """
    if len(sets) == 2:
        one, other = sets
        both = len(np.intersect1d(one, other, assume_unique=True))
        return [(0, 1)] if both >= similarity * (len(one) + len(other) - both) - 1e-9 else []
    # An empty set is like no other.
    order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: len(sets[i]))
    if not order:
        return []
    size = np.array([len(sets[i]) for i in order])
    names, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    at = np.cumsum(size) - size
    # Those without a component, by size; all their ids, and where each one's begin.
    left, left_ids, left_at = np.arange(len(size)), ids, at
    mark, links, front = np.zeros(len(names), np.int32), [], []
    while len(left):
        if not front:
            first = int(left[0])
            front, left, left_ids, left_at = [first], left[1:], left_ids[size[first] :], left_at[1:] - size[first]
        x = front.pop()
        # Sets of other sizes cannot be that similar.
        lo, hi = np.searchsorted(size[left], [similarity * size[x] - 1e-6, size[x] / similarity + 1e-6])
        if lo >= hi:
            continue
        own = ids[at[x] : at[x] + size[x]]
        mark[own] = 1
        end = left_at[hi] if hi < len(left) else len(left_ids)
        both = np.add.reduceat(mark[left_ids[left_at[lo] : end]], left_at[lo:hi] - left_at[lo])
        mark[own] = 0
        good = np.flatnonzero(both >= similarity * (size[x] + size[left[lo:hi]] - both) - 1e-9) + lo
        if len(good):
            links += [(order[x], order[y]) for y in left[good].tolist()]
            front += left[good].tolist()
            stay = np.ones(len(left), bool)
            stay[good] = False
            left_ids = left_ids[np.repeat(stay, size[left])]
            left = left[stay]
            left_at = np.cumsum(size[left]) - size[left]
    return links


def _linked(near: Near) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links x, y of the teams (rows sorted by team and same, with their hashes) of a partition: from the smallest of a team's component to
    each other, so that teams of the same sets give the same links and stars of them need few rounds."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        team, same = rows["team"].to_numpy(np.int64), rows["same"].to_numpy(np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
        cuts = [0, *(np.flatnonzero(np.diff(team)) + 1).tolist(), len(team)]
        pairs = [(lo + x, lo + y) for lo, hi in zip(cuts, cuts[1:], strict=False) for x, y in similar_forest(sets[lo:hi], near.similarity)]
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        label = np.arange(len(team))
        _hook(label, a, b)
        # Places in a team are in the order of same.
        label = _top(label, label)
        on = np.flatnonzero(label != np.arange(len(team)))
        return pd.DataFrame({"x": same[label[on]], "y": same[on]})

    return _by_key(found, "team")


def _tiles(rows: DataFrame, met: Column) -> DataFrame:
    """rows (key, same, component, block; met: the blocks to meet) by the two blocks of each meeting."""
    each = rows.withColumn("other", F.explode(met))
    return each.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "same", "component")


def _blocks(n: Column, hot: int) -> Column:
    return F.ceil(2 * n / hot)


def _block(n: Column, hot: int) -> Column:
    return F.pmod(F.xxhash64("same", F.lit(1)), _blocks(n, hot))


def first_tiles(crowded: DataFrame, hot: int) -> DataFrame:
    """Of shards over hot (key, same, component) tiles of about hot sets: the first of a shard's blocks with each of the others."""
    sized = crowded.join(crowded.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    met = F.when(F.col("block") > 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), _blocks(F.col("n"), hot) - 1))
    return _tiles(sized.withColumn("block", _block(F.col("n"), hot)), met)


def other_tiles(crowded: DataFrame, hot: int) -> DataFrame:
    """Of the same shards tiles in which any two sets of different components meet: the blocks of the largest component do not meet each other."""
    counts = crowded.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"))
    top = top.select("key", F.col("top.component").alias("largest"), F.col("top.n").alias("n"), (F.col("n") - F.col("top.n")).alias("others")).filter("others > 0")
    rows = crowded.join(top, "key").withColumn("in", F.col("component") == F.col("largest"))
    begin = _blocks(F.col("n"), hot)
    rows = rows.withColumn("block", F.when(F.col("in"), _block(F.col("n"), hot)).otherwise(begin + _block(F.col("others"), hot)))
    met = F.sequence(F.when(F.col("in"), begin).otherwise(F.lit(0).cast("long")), begin + _blocks(F.col("others"), hot) - 1)
    return _tiles(rows, F.array_remove(met, F.col("block")))


def similar_links(sets: DataFrame, texts: Callable[[DataFrame], DataFrame], near: Near, hot: int, levels: int) -> DataFrame:
    """Spanning links x, y of the similar among distinct shingle sets; sets: same, fp, keys, sketch, n (hashes of the set); texts: gives
    same and a text of each set of a table (same).

    Sets of that similarity share the smallest hash under one of a few mixings
    (6 at 0.8: all but one in 15,000), so each goes to a shard by each of them.
    A shard over hot sets is dealt again by further mixings. Shards give groups, and these spanning links; pairs
    never leave a task. A shard still over hot goes into tiles, blocks of hot / 2 sets that meet two by two: each meets
    the first, and where that leaves more than one component, the others.
    """

    def keyed(rows: DataFrame, first: int, n: int) -> DataFrame:
        """rows (key, same, keys) by the keys from first on."""
        each = F.posexplode(F.slice("keys", first + 1, n)).alias("i", "value")
        return rows.select("key", "same", "keys", each).select(F.xxhash64("key", "i", "value").alias("key"), "same", "keys")

    def linked(shards: DataFrame) -> DataFrame:
        """shards: key, same, component."""
        rows = shards.join(sets.select("same", "fp", "sketch", "n"), "same")
        dealt = rows.repartition("key").sortWithinPartitions("key", "same").select("key", "same", "fp", "sketch", "n", "component")
        teams = written(dealt.mapInPandas(_groups(near, BLOCK), "team long, same long"), "teams").distinct()
        members = written(texts(written(teams.select("same").distinct(), "needed")).mapInPandas(_values(near), "same long, hashes binary"), "members")
        met = teams.join(members, "same").repartition("team").sortWithinPartitions("team", "same").select("team", "same", "hashes")
        return written(met.mapInPandas(_linked(near), "x long, y long"), "links")

    rest, shards, crowded = keyed(sets.select(F.lit(0).cast("long").alias("key"), "same", "keys"), 0, near.keys), None, None
    for level in range(levels + 1):
        rest = written(rest, "dealt")
        sizes = written(rest.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
        sized = written(rest.join(sizes, "key"), "sized")
        small = sized.filter(F.col("n") <= hot).select("key", "same")
        shards = small if shards is None else shards.union(small)
        crowded = sized.filter(F.col("n") > hot)
        if level == levels or crowded.isEmpty():
            break
        rest = keyed(crowded.select("key", "same", "keys"), near.keys + near.more * level, near.more)
    shards = shards.withColumn("component", F.col("same"))
    if crowded.isEmpty():
        return linked(shards)
    crowded = crowded.select("key", "same").withColumn("component", F.col("same"))
    edges = linked(shards.unionByName(first_tiles(crowded, hot)))
    groups = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")), 1).select(F.col("node").alias("same"), "component")
    crowded = crowded.select("key", "same").join(groups, "same", "left").withColumn("component", F.coalesce("component", "same"))
    return edges.union(linked(other_tiles(written(crowded, "crowded"), hot)))


def near_copies(docs: DataFrame, near: Near | None = None, hot: int = HOT, levels: int = 2) -> DataFrame:
    """docs (doc_id, text, and what else is to be kept) without text, with same (the shingle set) and component.

    Documents with equal shingle sets are one; sets whose similarity is near.similarity or more are linked.
    """
    near = near or Near()
    made = ("same", "fp", "keys", "sketch", "n", "__text")
    kept = T.StructType([f for f in docs.schema.fields if f.name not in ("text", *made)])
    schema = T.StructType([*kept.fields, T.StructField("__text", T.LongType()), T.StructField("same", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("n", T.LongType())])
    hashed = F.xxhash64("text").alias("__text")
    found = written(docs.select(*kept.names, hashed, "text").mapInPandas(_features(near, levels), schema), "features")
    sets = written(found.dropDuplicates(["same"]).select("same", "__text", "fp", "keys", "sketch", "n"), "sets")

    def texts(needed: DataFrame) -> DataFrame:
        named = needed.join(sets.select("same", "__text"), "same")
        return docs.select(hashed, "text").join(named, "__text").dropDuplicates(["same"]).select("same", "text")

    edges = similar_links(sets, texts, near, hot, levels)
    groups = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")), 1).select(F.col("node").alias("same"), "component")
    return found.drop("__text", "fp", "keys", "sketch", "n").join(groups, "same", "left").withColumn("component", F.coalesce("component", "same"))


def _one_each(keyed: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """Of the rows of keyed one for each component of groups (doc_id, __key, component): the smallest doc_id (a null one last), then key."""
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__key")).alias("first"))
    kept = first.select(F.col("first.__key").alias("__key"))
    return keyed.join(kept, "__key").dropDuplicates(["__key"]).select(*(F.col(f"`{n}`") for n in names))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near_duplicates()."""
    keyed = docs.withColumn("__key", row_key(docs))
    return _one_each(keyed, near_duplicates(keyed.select("doc_id", "__key", "text")), docs.columns)


def keep_one_similar(docs: DataFrame, near: Near | None = None) -> DataFrame:
    """docs with one row of each group of near_copies()."""
    keyed = docs.withColumn("__key", row_key(docs))
    return _one_each(keyed, near_copies(keyed.select("doc_id", "__key", "text"), near), docs.columns)
