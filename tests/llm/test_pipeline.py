"""Near copies by similarity, and the pipeline's stages together."""

import collections
import itertools
import random

import pytest

import corpus_pipeline
from brindle.llm import simhash
from brindle.llm.shared import table


def shingles(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


@pytest.mark.parametrize("hot", [4096, 8])
def test_near_copies(spark, hot):
    rng = random.Random(hot)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    common = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 60, 300, 900]))]
        texts.append(" ".join(base) + " " + common)
        for _ in range(rng.randint(0, 6)):
            copy = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.004, 0.02, 0.1]) else w for w in base]
            texts.append(" ".join(copy).upper() + "  " + common)
    texts += ["", None, " \t", "one two", "One  two", "x y"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3])]
    found = {r.doc_id: r.component for r in simhash.near_copies(spark.createDataFrame([(*r, "z", 1, b"own", 2) for r in rows], "doc_id long, text string, same string, fp long, sketch binary, __text long"), hot=hot).collect()}
    sets = [shingles(t) for t in texts]
    loose = list(range(len(texts)))

    def top(x):
        while loose[x] != x:
            x = loose[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        s = similarity(sets[a], sets[b])
        if s >= 0.82:
            assert found[a] == found[b], (a, b, s)
        if s >= 0.68:
            x, y = top(a), top(b)
            loose[max(x, y)] = min(x, y)
    groups = collections.defaultdict(set)
    for i in range(len(texts)):
        groups[found[i]].add(top(i))
    assert all(len(g) == 1 for g in groups.values())
    assert found[None] == found[0]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in simhash.keep_one_similar(df).collect()]
    assert len(kept) == len(groups) and None not in kept


def test_repeated_lines_count_once(spark):
    rng = random.Random(7)
    texts = []
    for i in range(24):
        base, line = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)) for n in (300, 10))
        texts += [f"{base} {line}", base + f" {line}" * (20, 50, 100)[i % 3]]
    found = {r.doc_id: r.component for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i in range(0, len(texts), 2):
        assert similarity(shingles(texts[i]), shingles(texts[i + 1])) > 0.95
        assert found[i] == found[i + 1]
    assert len(set(found.values())) == len(texts) // 2


def test_the_sets_decide(spark):
    rng = random.Random(11)
    texts = []
    for i in range(120):
        # One long text, and another that shares its first part: just at, or just below the similarity.
        words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(1204)]
        both = 1068 if i % 2 else 1062
        tail = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(1200 - both)]
        texts += [" ".join(words), " ".join(words[: both + 4] + tail)]
    found = {r.doc_id: r.component for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i in range(0, len(texts), 2):
        s = similarity(shingles(texts[i]), shingles(texts[i + 1]))
        assert abs(s - 0.8) < 0.01 and (found[i] == found[i + 1]) == (s >= 0.8), s


def test_near_copies_of_nothing(spark):
    assert simhash.keep_one_similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_estimates():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, share in itertools.product((20, 400, 5000), (0.3, 0.8)):
        both = int(2 * n * share / (1 + share))
        pool = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
        a, b = (np.frombuffer(simhash.sketch(np.unique(v)), np.uint8) for v in (pool[:n], pool[n - both :]))
        estimate = ((a == b) & (a > 0)).sum() / ((a > 0) | (b > 0)).sum()
        assert abs(estimate - both / (2 * n - both)) < 0.09


def test_one_large_group_in_blocks(spark):
    """Copies that share nearly everything, far more than a shard holds, and others that only share a line."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(400)], []
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(400), 3):
            copy[at] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(base[:60] + [word() for _ in range(300)]) for _ in range(60)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component for r in simhash.near_copies(df, hot=16).collect()}
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if similarity(sets[a], sets[b]) >= 0.8:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    groups = collections.defaultdict(set)
    for i in range(len(texts)):
        groups[found[i]].add(top(i))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({top(i) for i in range(len(texts))})


def test_forest_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 40, 40, 40):
        base, sets = rng.integers(0, 2**63, 50).astype(np.uint64), [np.empty(0, np.uint64)]
        for _ in range(n):
            own = base[: rng.integers(30, 51)].copy()
            odd = rng.random(len(own)) < rng.choice([0, 0.05, 0.1])
            own[odd] = rng.integers(0, 2**63, odd.sum()).astype(np.uint64)
            sets.append(np.unique(own))
        up = list(range(len(sets)))

        def top(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        links = simhash.similar_forest(sets, 0.8)
        for a, b in links:
            assert top(a) != top(b) and similarity(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.8
            up[max(top(a), top(b))] = min(top(a), top(b))
        for a, b in itertools.combinations(range(len(sets)), 2):
            assert top(a) == top(b) or similarity(set(sets[a].tolist()), set(sets[b].tolist())) < 0.8


@pytest.mark.parametrize("hot", [4096, 24])
def test_rows_of_a_group_do_not_grow_with_its_square(spark, monkeypatch, hot):
    """A group of which no two are links though all may be, copies of one of them, and one that joins two components."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    base, texts = [word() for _ in range(300)], []
    for _ in range(120):
        # Two share 252 of their 296 shingles, a similarity of 0.741.
        texts.append(" ".join([word() for _ in range(22)] + base[22:278] + [word() for _ in range(22)]))
    for a, b in ((0, 1), (2, 3)):
        one, other = texts[a].split(), texts[b].split()
        texts.append(" ".join(one[:150] + other[150:]))
        texts.append(" ".join(one[:290] + [word() for _ in range(10)]))
    counts, write = {}, simhash.written

    def counted(df, name):
        out = write(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    found = {r.doc_id: r.component for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot=hot).collect()}
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if similarity(sets[a], sets[b]) >= 0.8:
            up[max(top(a), top(b))] = min(top(a), top(b))
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert (found[a] == found[b]) == (top(a) == top(b))
    assert len(set(found.values())) == 118
    if hot == 4096:
        assert max(counts.values()) <= 6 * len(texts), counts


@pytest.mark.parametrize("joined", [0, 150, 300])
def test_tiles(spark, joined):
    """Small tiles in which all meet that have to; joined: sets of one component."""
    df = spark.createDataFrame([(k, i, 0 if i < joined else i) for k in (1, 2) for i in range(300)], "key long, same long, component long")
    first, other = (collections.defaultdict(set), collections.defaultdict(set))
    for tiles, held in ((simhash.first_tiles(df, 64), first), (simhash.other_tiles(df, 64), other)):
        for r in tiles.collect():
            held[r.key].add(r.same)
    assert max(map(len, [*first.values(), *other.values()])) < 100
    assert sum(map(len, first.values())) < 2 * 2 * 300
    met = {p for own in other.values() for p in itertools.combinations(sorted(own), 2)}
    assert all((a, b) in met for a, b in itertools.combinations(range(300), 2) if b >= joined)
    assert joined < 300 or not other


def test_groups_in_parts():
    import numpy as np
    import pandas as pd

    n = 20
    marks = simhash.sketch(np.arange(1, 5000, 7).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rows = pd.DataFrame({"key": 5, "same": np.arange(n), "fp": 0, "sketch": [marks] * n, "n": 100, "component": np.arange(n)})
    halves = iter([rows.iloc[:7], rows.iloc[7:]])
    teams = pd.concat(simhash._groups(simhash.Near(), 500)(halves)).groupby("team")["same"].apply(list)
    assert teams.map(len).max() <= 10
    assert {p for own in teams for p in itertools.combinations(sorted(own), 2)} == set(itertools.combinations(range(n), 2))
    whole = pd.concat(simhash._groups(simhash.Near(), 1 << 20)(iter([rows])))
    assert whole["team"].nunique() == 1 and sorted(whole["same"]) == list(range(n))


ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, component long, same string, fp long, size string, score string, tier int, copies int, place int, hash long, item long, th long"


def test_pipeline_of_odd_rows(spark, small):
    """Nulls in every column, empty and very long texts, repeats, ties, columns with names that stages use themselves."""
    rng = random.Random(31)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(150_000))
    texts = [(1, None), (2, ""), (None, None), (3, "one two three four five six"), (3, "one two three four five six"), (4, "ONE two three four five six"), (5, long), (None, long), (6, long + " end"), (7, "é𝔘 \n\t\x0b x"), (8, "x")]
    own = (None, 5, "a", 7, "b", "c", 1, 9, 2, 3, 4, 6)
    rows = [(i, t, None, None if k % 2 else "s", *own) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, ODD_COLUMNS)
    names, given = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = simhash.written(stage(spark, docs, small), "test")
        assert docs.columns == names
        given.append(docs)
    assert given[1].count() == len(rows)
    # Of each group the smallest doc_id stays: no words at all, the six words, the long text, and two others.
    assert sorted(r.doc_id for r in given[2].collect()) == [1, 3, 5, 7, 8]
    assert given[3].count() == 5
    assert {r.doc_id for r in given[4].collect()} <= {3, 5, 7, 8} and all(tuple(r)[5:] == own[1:] for r in given[4].collect())
    final = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert final.count() == docs.count()
    docs = given[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = simhash.written(stage(spark, docs, small), "test")
        assert docs.count() == 0


def test_pipeline_against_brute_force(spark, small):
    """The stages that decide, each against a plain version on its own input."""
    from brindle.llm import decontamination, toxicity

    docs = table(spark, small, "documents")
    stages = dict(corpus_pipeline.STAGES)
    labels = table(spark, small, "labels")
    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.with_toxicity(docs.select("doc_id", "text"), model).collect()}
    kept = simhash.written(stages["toxicity"](spark, docs, small), "test")
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < 0.5}
    rows = {r.doc_id: r.text for r in kept.collect()}
    sets = {i: shingles(t) for i, t in rows.items()}
    up = {i: i for i in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = collections.defaultdict(list)
    for i, own in sets.items():
        for s in own:
            holders[s].append(i)
    pairs = {p for ids in holders.values() for p in itertools.combinations(sorted(ids), 2)}
    for a, b in pairs:
        if similarity(sets[a], sets[b]) >= 0.8:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    one_each = simhash.written(stages["near copies"](spark, kept, small), "test")
    assert {r.doc_id for r in one_each.collect()} == {top(i) for i in rows}
    items = table(spark, small, "benchmark")
    clean = {r.doc_id for r in stages["decontamination"](spark, one_each, small).collect()}
    hits = {r.doc_id for r in decontamination.contaminated(one_each, items).collect()}
    assert clean == {r.doc_id for r in one_each.collect()} - hits
    assert not any(b.text in rows[i] for b in items.collect() for i in clean)


def test_pipeline(spark):
    small = "/root/testdata/sf0.01"
    docs = table(spark, small, "documents")
    names, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == names
        docs = simhash.written(docs, "test")
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and sizes[4] > 0
    benchmark = [r.text for r in table(spark, small, "benchmark").collect()]
    assert not any(b in r.text for r in docs.collect() for b in benchmark)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert final.count() == docs.count() and final.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
