"""Approximate nearest neighbours by cosine: an HNSW graph per shard, shard results merged.

1. Equal vectors are one entry that keeps its K + 1 smallest ids (a query may be
   one of them), cut down before any shuffle; so copies, however many, cost one
   node and ties come out right.
2. Entries are dealt at random to shards of what SHARD_BYTES hold, so that their
   number grows slowly: a query meets every shard. Each shard's graph is a
   hierarchy: a node is in layer l with probability FAN ** -l. In a layer a node's
   candidates are the nearest of its cells (the rows nearest to one of its CELLS
   nearest pivots, of CELL rows about; a layer of that size is one cell, whose
   candidates are exact); of these it keeps those that are nearer to it than to any
   neighbour kept before (and the links back to it, chosen likewise, up to DEGREE,
   twice that in layer 0), which is the choice an insertion makes. The work of a
   row does not depend on the size of its shard. Neighbours are flat int32 arrays.
3. Queries are packed into blocks. A task holds one shard's graph and takes one
   block after another: greedy descent through the upper layers, then a beam of
   EF in layer 0, for all queries of the block side by side.
4. Scores are worked out again in double precision from the vectors as given,
   and the best of all shards merged.

Defined results: vectors that are null, zero, empty, or hold a null or
non-finite component, and rows without an id, take no part; repeated rows count
once as candidates (all rows with the query's own id are its own); vectors
of another length than most take part among their like; very long vectors make
smaller shards; fewer candidates than K give fewer rows, empty tables none; ties go
to the smaller id; extra columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.shared import written

#: Neighbours returned; bytes of a shard's vectors and graph; queries of a block; blocks that a graph is sent for.
K, SHARD_BYTES, BLOCK, GROUP = 5, 16 << 20, 512, 32
#: Rows of a cell, about, and cells of a row.
CELL, CELLS = 2048, 3
#: Links of a node in an upper layer, candidates it chooses from, beam of a search, one node in FAN is in the next layer.
DEGREE, CANDIDATES, EF, FAN = 16, 64, 256, 16
#: Nodes of a beam whose links are followed at once.
STEP = 4
QUERY_EVERY = 50


# ---------------------------------------------------------------- one shard's graph


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def shard_rows(dim: int) -> int:
    """The vectors (as given and of length one) and the links of so many rows are SHARD_BYTES."""
    return max(64, SHARD_BYTES // (8 * dim + 8 * DEGREE + 16))


def _cells(unit: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Sets of rows of CELL to about twice that; each row is in CELLS of those around it."""
    n = len(unit)

    def dealt(rows: np.ndarray, near: int) -> list[np.ndarray]:
        if len(rows) <= 2 * CELL:
            return [rows]
        m = -(-len(rows) * near // CELL)
        pivots = unit[rng.permutation(rows)[:m]]
        owner = np.empty((len(rows), near), np.int64)
        for lo in range(0, len(rows), 4096):
            sim = unit[rows[lo : lo + 4096]] @ pivots.T
            owner[lo : lo + 4096] = np.argpartition(-sim, near - 1, axis=1)[:, :near]
        flat, member = owner.reshape(-1), np.repeat(rows, near)
        order = np.argsort(flat, kind="stable")
        parts = np.split(member[order], np.cumsum(np.bincount(flat, minlength=m))[:-1])
        # Where one pivot draws most rows, its cell is dealt again; rows that no pivots part are cut by place.
        out: list[np.ndarray] = []
        for part in parts:
            if len(part) >= 0.9 * len(rows):
                out += np.array_split(part, -(-len(part) // CELL))
            elif len(part):
                out += dealt(part, 1)
        return out

    return dealt(np.arange(n), CELLS)


def _among(unit: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """Each row's k nearest others of its cells, nearest first; -1 where there are fewer."""
    n = len(unit)
    cells = _cells(unit, np.random.default_rng(seed))
    if len(cells) == 1:
        return _nearest(unit, k)
    ids, sims = np.full((n, k), -1, np.int32), np.full((n, k), -np.inf, np.float32)
    for cell in cells:
        found = _nearest(unit[cell], k)
        there = found >= 0
        new = np.where(there, cell[np.maximum(found, 0)], -1).astype(np.int32)
        sim = np.where(there, np.einsum("nd,nkd->nk", unit[cell], unit[np.maximum(new, 0)]), -np.inf)
        both, value = np.concatenate([ids[cell], new], axis=1), np.concatenate([sims[cell], sim], axis=1)
        # Of an id that two cells gave the second goes.
        order = np.argsort(both, axis=1, kind="stable")
        both, value = np.take_along_axis(both, order, 1), np.take_along_axis(value, order, 1)
        value[:, 1:][both[:, 1:] == both[:, :-1]] = -np.inf
        best = np.argsort(-value, axis=1, kind="stable")[:, :k]
        ids[cell], sims[cell] = np.take_along_axis(both, best, 1), np.take_along_axis(value, best, 1)
    ids[sims == -np.inf] = -1
    return ids


def _nearest(unit: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest others, nearest first; -1 where there are fewer."""
    n = len(unit)
    out = np.full((n, k), -1, np.int32)
    take = min(k, n - 1)
    if take <= 0:
        return out
    for lo in range(0, n, 1024):
        sim = unit[lo : lo + 1024] @ unit.T
        rows = np.arange(len(sim))
        sim[rows, lo + rows] = -np.inf
        best = np.argpartition(-sim, take - 1, axis=1)[:, :take]
        order = np.argsort(-np.take_along_axis(sim, best, 1), axis=1, kind="stable")
        out[lo : lo + 1024, :take] = np.take_along_axis(best, order, 1)
    return out


def _diverse(unit: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1: none) those nearer to it than to one kept before, then the nearest of the rest."""
    n, width = near.shape
    out = np.full((n, degree), -1, np.int32)
    for lo in range(0, n, 2048):
        block = near[lo : lo + 2048]
        vec = unit[block]
        own = np.einsum("nd,nkd->nk", unit[lo : lo + 2048], vec)
        among = vec @ vec.transpose(0, 2, 1)
        valid = block >= 0
        kept = np.zeros(block.shape, bool)
        for j in range(width):
            shaded = (kept & (among[:, j, :] > own[:, j, None])).any(axis=1)
            kept[:, j] = valid[:, j] & ~shaded & (kept.sum(axis=1) < degree)
        # Kept ones first, then others by nearness, to fill the row.
        rank = np.where(kept, 0, np.where(valid, width, 3 * width)) + np.arange(width)
        order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
        chosen = np.take_along_axis(block, order, 1)
        out[lo : lo + 2048, : chosen.shape[1]] = chosen
    return out


def _layer(unit: np.ndarray, degree: int) -> np.ndarray:
    """Flat neighbour arrays of one layer: links out and links back, at most 2 * degree each."""
    n = len(unit)
    forward = _diverse(unit, _among(unit, min(CANDIDATES, max(1, n - 1))), degree)
    src = np.repeat(np.arange(n, dtype=np.int64), forward.shape[1])
    dst = forward.reshape(-1).astype(np.int64)
    src, dst = src[dst >= 0], dst[dst >= 0]
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    pairs = np.unique(a * n + b)
    a, b = pairs // n, pairs % n
    sim = np.einsum("nd,nd->n", unit[a], unit[b])
    order = np.lexsort((b, -sim, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    # A hub's links back are chosen anew if they are too many, the nearest CANDIDATES * 2 standing for all.
    width = min(CANDIDATES * 2, int(place.max(initial=0)) + 1)
    wide = np.full((n, width), -1, np.int32)
    inside = place < width
    wide[a[inside], place[inside]] = b[inside]
    if width <= 2 * degree:
        return wide
    return _diverse(unit, wide, 2 * degree)


def build(vectors: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """The graph of some vectors as flat arrays: unit, and for each layer its nodes and links (places among its nodes)."""
    unit = _unit(vectors)
    rng = np.random.default_rng(seed)
    graph = {"unit": unit}
    nodes, layer = np.arange(len(unit), dtype=np.int32), 0
    while True:
        graph[f"nodes{layer}"] = nodes
        graph[f"links{layer}"] = _layer(unit[nodes], DEGREE)
        if len(nodes) <= FAN:
            return graph
        chosen = np.sort(rng.permutation(len(nodes))[: max(1, len(nodes) // FAN)])
        nodes, layer = nodes[chosen], layer + 1


def _beam(unit: np.ndarray, links: np.ndarray, query: np.ndarray, enter: np.ndarray, ef: int) -> np.ndarray:
    """For each query the ef best nodes (places, best first, -1: none) that a beam search from enter (queries x entries) meets.

    All queries go side by side; a step follows the links of each one's STEP best nodes that are still to be looked at.
    """
    q, n = len(query), len(unit)
    seen, last = np.zeros((q, n), bool), np.empty((q, n), np.int32)
    ids, sims, done = np.full((q, ef), -1, np.int32), np.full((q, ef), -np.inf, np.float32), np.ones((q, ef), bool)

    def merge(new: np.ndarray, who: np.ndarray) -> None:
        """new: places, -1 where none; who: the queries of its rows."""
        r, c = np.nonzero(new >= 0)
        at, row = new[r, c], who[r]
        fresh = ~seen[row, at]
        r, c, at, row = r[fresh], c[fresh], at[fresh], row[fresh]
        # Of a place met twice in one step the last counts.
        number = np.arange(len(at), dtype=np.int32)
        last[row, at] = number
        once = last[row, at] == number
        r, c, at, row = r[once], c[once], at[once], row[once]
        seen[row, at] = True
        sim, found = np.full(new.shape, -np.inf, np.float32), np.full(new.shape, -1, np.int32)
        sim[r, c] = np.einsum("nd,nd->n", query[row], unit[at])
        found[r, c] = at
        all_sims = np.concatenate([sims[who], sim], axis=1)
        best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        ids[who] = np.take_along_axis(np.concatenate([ids[who], found], axis=1), best, 1)
        done[who] = np.take_along_axis(np.concatenate([done[who], found < 0], axis=1), best, 1)
        sims[who] = np.take_along_axis(all_sims, best, 1)

    merge(enter, np.arange(q))
    step = min(STEP, ef)
    while True:
        who = np.flatnonzero(~done.all(axis=1))
        if not len(who):
            order = np.argsort(-sims, axis=1, kind="stable")
            return np.take_along_axis(ids, order, 1)
        waiting = np.where(done[who], -np.inf, sims[who])
        pick = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
        real = np.take_along_axis(waiting, pick, 1) > -np.inf
        rows = np.repeat(who, step).reshape(-1, step)
        done[rows[real], pick[real]] = True
        near = links[np.take_along_axis(ids[who], pick, 1)]
        near[~real] = -1
        merge(near.reshape(len(who), -1), who)


def search(graph: dict[str, np.ndarray], queries: np.ndarray, ef: int = EF) -> np.ndarray:
    """For each query (a row) the places of the ef best vectors met, best first, -1 where there are fewer."""
    unit, query = graph["unit"], _unit(queries)
    top = max(int(k[5:]) for k in graph if k.startswith("nodes"))
    nodes = graph[f"nodes{top}"]
    sim = query @ unit[nodes].T
    # A graph of one layer is small enough to be looked at whole.
    enter = nodes[np.argsort(-sim, axis=1, kind="stable")[:, : 4 if top else ef]].astype(np.int64)
    for layer in range(top - 1, -1, -1):
        nodes = graph[f"nodes{layer}"]
        inner = np.searchsorted(nodes, enter)
        found = _beam(unit[nodes], graph[f"links{layer}"], query, inner, ef if layer == 0 else 8)
        enter = np.where(found >= 0, nodes[np.maximum(found, 0)], -1).astype(np.int64)
    return enter


# ---------------------------------------------------------------- over a table


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("entry")
    vectors = np.stack(pdf["vec"].to_numpy())
    ids = list(pdf["ids"])
    flat = np.concatenate(ids).astype(np.int64)
    ends = np.cumsum([len(i) for i in ids])
    data = _packed(vectors=vectors, flat=flat, ends=ends, **build(vectors))
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "graph": [data]})


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id")
    data = _packed(ids=pdf["vec_id"].to_numpy(np.int64), vectors=np.stack(pdf["vec"].to_numpy()))
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "queries": [data]})


def _found(graph: dict[str, np.ndarray], block: dict[str, np.ndarray]) -> pd.DataFrame:
    """The K best of a shard for each query of a block, with exact scores; equal vectors share theirs."""
    places_of = search(graph, block["vectors"])
    vectors, queries = graph["vectors"].astype(np.float64), block["vectors"].astype(np.float64)
    length = np.sqrt(np.einsum("nd,nd->n", vectors, vectors))
    begin = np.concatenate(([0], graph["ends"][:-1]))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for own, query, places in zip(block["ids"].tolist(), queries, places_of, strict=True):
        at = places[places >= 0]
        score = vectors[at] @ query / (length[at] * np.sqrt(query @ query))
        size = graph["ends"][at] - begin[at]
        ids = graph["flat"][np.repeat(begin[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
        score = np.repeat(score, size)
        ids, score = ids[ids != own], score[ids != own]
        best = np.lexsort((ids, -score))
        # An id whose vectors score alike is one result.
        new = np.ones(len(best), bool)
        new[1:] = (ids[best[1:]] != ids[best[:-1]]) | (score[best[1:]] != score[best[:-1]])
        best = best[new][:K]
        out.append((np.full(len(best), own), ids[best], score[best]))
    return pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})


def _answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted: a shard's graph, then the blocks that are asked of it; one graph and one block are held at a time."""
    graph: dict[str, np.ndarray] = {}
    for batch in batches:
        for is_block, data in zip(batch["is_block"], batch["data"], strict=True):
            if is_block:
                yield _found(graph, _unpacked(data))
            else:
                graph = _unpacked(data)


def usable(table: DataFrame) -> DataFrame:
    """vec_id, vec (floats), dim of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = table.select("vec_id", "embedding").filter("vec_id is not null and embedding is not null").filter(finite & F.exists("embedding", lambda x: x != 0))
    return rows.select("vec_id", F.col("embedding").alias("vec"), F.size("embedding").alias("dim"))


def nearest(table: DataFrame, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the K nearest of each row whose vec_id is divisible by every."""
    rows = usable(table)
    # Of each vector the K + 1 smallest ids, each once: the filter on the row number works before the shuffle too.
    first = rows.dropDuplicates(["vec_id", "vec"]).withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).filter(F.col("n") <= K + 1)
    entries = written(first.groupBy("vec", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    counts = {r["dim"]: r["n"] for r in entries.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = F.lit(1)
    for dim, n in counts.items():
        shards = F.when(F.col("dim") == dim, -(-n // shard_rows(dim))).otherwise(shards)
    dealt = entries.select("*", F.xxhash64("vec").alias("entry"), shards.alias("shards")).withColumn("shard", F.pmod("entry", "shards").cast("int"))
    graphs = written(dealt.groupBy("dim", "shard").applyInPandas(_index, "dim int, shard int, graph binary"), "graphs")
    asked = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vec"])
    n = asked.count()
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // BLOCK)))).cast("int"))
    blocks = written(blocked.groupBy("dim", "block").applyInPandas(_pack, "dim int, block int, queries binary"), "blocks")
    # Each block meets each shard. A graph is sent once for GROUP blocks, which then cost as much to send as the graph.
    n_groups = max(1, -(-n // (BLOCK * GROUP)))
    asks = blocks.withColumn("shards", shards).select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.floor(F.col("block") / GROUP).cast("int").alias("part"), F.lit(True).alias("is_block"), F.col("queries").alias("data"))
    held = graphs.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("part"), F.lit(False).alias("is_block"), F.col("graph").alias("data"))
    tasks = max(1, sum(-(-c // shard_rows(d)) for d, c in counts.items()) * n_groups)
    met = held.unionByName(asks).repartition(min(tasks, 4096), "dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "is_block")
    found = met.mapInPandas(_answer, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # A query row given twice, or with two vectors, is asked once by id.
    return found.distinct().withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")
