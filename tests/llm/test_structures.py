"""SimHash, substrings, token shards, nearest neighbours, WARC: against brute force, round trips and odd rows."""

import collections
import hashlib
import io
import json
import random
import re
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyarrow import fs
from tokenizers import Tokenizer

from brindle.llm import anchors, ann, blobs, graph, shared, simhash, substrings, suffixes, tokens, warc, wavelet

TEXTS = "doc_id long, text string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def near(prints, radius=2):
    return [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]


def test_simhash_rows(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcÀé") for _ in range(4)) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts += [" ".join(rng.choice(words) for _ in range(8_000))]
    texts += [t.upper() for t in texts[:5]] + [texts[7], texts[7] + " x", "", None, "\t \n", "one", "one two", "A b c d"] + [texts[9].replace(" ", "\x0b")]
    for k in range(20):
        w = texts[10].split()
        if w:
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows.append(rows[4])
    clashing = [(*r, 1, "x", 2, b"k", None) for r in [*rows, (None, texts[3])]]
    found = simhash.simhash_digest(spark.createDataFrame(clashing, TEXTS + ", fp long, path string, component_id long, key binary, fingerprint string").repartition(5)).collect()
    prints = [plain_fingerprint(t) for t in texts]
    group = classes(len(prints), near(prints))
    expected = collections.Counter((i * 3, f"{p:016x}", g * 3) for i, (p, g) in enumerate(zip(prints, group, strict=True)))
    expected.update([(12, f"{prints[4]:016x}", group[4] * 3), (None, f"{prints[3]:016x}", group[3] * 3)])
    assert collections.Counter(map(tuple, found)) == expected
    kept = simhash.keep_one(spark.createDataFrame(rows, TEXTS))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g * 3 for g in group})
    assert simhash.simhash_digest(spark.createDataFrame([], TEXTS)).count() == 0


@pytest.mark.parametrize("hot", [4096, 20])
def test_dense_clusters(spark, hot, monkeypatch):
    """Thousands within a few bits of each other, and shards that have to be dealt again."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(hot)
    points = set()
    for base in rng.integers(0, 2**63, 12).tolist():
        for _ in range(60):
            x = base
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << bit
            points.add(x)
    points = sorted(points)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in points]
    edges = simhash.links(spark.createDataFrame(signed, "fp long").repartition(3)).collect()
    place = {p: i for i, (p,) in enumerate(signed)}
    assert classes(len(points), [(place[e.x], place[e.y]) for e in edges]) == classes(len(points), near(points))


def test_bk_forest():
    rng = np.random.default_rng(3)
    points = np.unique(rng.integers(0, 2**12, 600).astype(np.uint64))
    shard = np.sort(rng.integers(0, 5, len(points)))
    found = simhash.forest_links(shard, points)
    expected = [(i, j) for i, j in near(points.tolist()) if shard[i] == shard[j]]
    assert classes(len(points), found.tolist()) == classes(len(points), expected)
    assert len(found) <= len(points)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 60)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (0, 1)]
    expected = classes(2300, pairs)
    found = graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {x: expected[x] for p in pairs if p[0] != p[1] for x in p}
    assert len(found) == len({r.node for r in found})


# ---------------------------------------------------------------- substrings


def brute(rows, width=400, words=51):
    seen = collections.Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[k : k + width] for k in range(len(b) - width + 1))
    owners = collections.defaultdict(set)
    cut = [(i, b, b.split()) for i, b in data]
    for i, b, w in cut:
        for k in range(len(w) - words + 1):
            owners[tuple(w[k : k + words])].add((i, b))
    out = collections.Counter()
    for i, b, w in cut:
        covered, told = bytearray(len(b)), bytearray(len(w))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                covered[k : k + width] = b"\1" * width
        for k in range(len(w) - words + 1):
            if len(owners[tuple(w[k : k + words])]) > 1:
                told[k : k + words] = b"\1" * words
        runs, passages = (sum(1 for j in range(len(c)) if c[j] and (j == 0 or not c[j - 1])) for c in (covered, told))
        out[(i, len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest(), passages, sum(told))] += 1
    return out


@pytest.mark.parametrize(("hot", "shares"), [(8192, 10_000), (1, 10)])
def test_substrings(spark, hot, shares, monkeypatch):
    """Whole buckets, and such as are dealt again down to single windows; hot keys by broadcast."""
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARES", shares)
    monkeypatch.setattr(substrings, "LEAST", 5)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(rng.randint(40, 130)) for _ in range(6)]
    rows = []
    for i in range(100):
        parts = [text(rng.randint(5, 80))]
        for _ in range(rng.randint(0, 3)):
            x = rng.choice(shared)
            if rng.random() < 0.6:
                x = x[rng.randint(0, len(x) // 3) : len(x) - rng.randint(0, 60)]
            if rng.random() < 0.3:
                x = x.replace(rng.choice(words), rng.choice(words), 1)
            parts += [x, text(rng.randint(0, 30))]
        rows.append((i, " ".join(parts)))
    twice = text(70)
    rows += [rows[3], (900, rows[5][1]), (901, None), (902, ""), (903, "a" * 3000), (904, "ab" * 700), (None, "xy" * 201), (905, "a" * 399), (906, f"{twice} z {twice} y {twice}"), (907, "the " * 300), (908, "The the " * 30 + "the " * 60)]
    df = spark.createDataFrame([(*r, 5, 6, b"own") for r in rows], TEXTS + ", th long, gram long, symbols binary")
    assert collections.Counter(map(tuple, substrings.substring_digest(df.repartition(5)).collect())) == brute(rows)
    assert substrings.substring_digest(df.limit(0)).count() == 0


def test_substrings_of_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(anchors, "_CHUNK", 20_000)
    rng = random.Random(12)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(30_000))
    rows = [(1, text), (2, "x " + text[50_000:53_000] + " y"), (3, text[19_000:21_000] + text[:600])]
    df = spark.createDataFrame(rows, TEXTS)
    # In the process of the tests, where the parts are made small.
    found = [r for batch in substrings._find(iter(df.selectExpr("doc_id", "doc_id as th", "text").toArrow().to_batches())) for r in batch.to_pylist()]
    covered = {kind: {1: set(), 2: set(), 3: set()} for kind in (0, 1)}
    for r in found:
        covered[r["gram"] & 1][r["doc_id"]].update(range(r["first"], r["last"] + 1))
    for i, t in rows:
        assert covered[0][i] == set(range(len(t) - 399)) and covered[1][i] == set(range(len(t.split()) - 50))
    expected = brute(rows)
    assert collections.Counter(map(tuple, substrings.substring_digest(df).collect())) == expected


def test_difference_cover_and_suffix_order():
    assert sorted((a - b) % suffixes.V for a in suffixes.COVER for b in suffixes.COVER if a != b) == list(range(1, suffixes.V))
    rng = np.random.default_rng(2)
    for kind, width in ((np.uint8, 400), (np.int64, 51)):
        text = rng.integers(97, 99, 3000).astype(kind)
        text[1000:1700] = text[100:800]
        ranks = suffixes.CoverRanks(text, width)
        at = rng.permutation(2400)[:1200]
        bucket = at % 3
        order = ranks.order(at, bucket)
        raw = [(b, text[i : i + width].tolist()) for i, b in zip(at.tolist(), bucket.tolist(), strict=True)]
        assert [raw[i] for i in order.tolist()] == sorted(raw)
        a, b = rng.integers(0, 2400, 5000), rng.integers(0, 2400, 5000)
        b[:400] = rng.integers(100, 400, 400)
        a[:400] = b[:400] + 900
        assert ranks.equal(a, b).tolist() == [text[i : i + width].tolist() == text[j : j + width].tolist() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert ranks.equal(a, b).sum() >= 200


# ---------------------------------------------------------------- token shards


def test_encoder_equals_the_library():
    library, encoder, rng = Tokenizer.from_file(VOCABULARY), tokens.Encoder(VOCABULARY), random.Random(1)
    letters = "abst'  \n\t.,1é'sremdll—“x  日<|>𝔘ὠ0\x85\xa0 \x1c"
    for _ in range(800):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3)] + ["", "don't we'll <|endoftext|> x", " 's 'S it's"]
        ids, counts = encoder.encode(texts)
        for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert got.tolist() == [*library.encode(t, add_special_tokens=False).ids, 0], t


@pytest.mark.parametrize("change", [{"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}]}}])
def test_other_tokenizers_go_through_the_library(tmp_path, change):
    file = json.loads(Tokenizer.from_file(VOCABULARY).to_str()) | change
    (tmp_path / "other.json").write_text(json.dumps(file))
    library, encoder = Tokenizer.from_file(str(tmp_path / "other.json")), tokens.Encoder(str(tmp_path / "other.json"))
    texts = ["Hello World 2024", " don't", "", "A1b2\n\nC"]
    ids, counts = encoder.encode(texts)
    assert not encoder.by_pieces and tokens.Encoder(VOCABULARY).by_pieces
    for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == [*library.encode(t, add_special_tokens=False).ids, 0]


def test_token_shards(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD", 2000)
    rng = random.Random(6)
    rows = [(rng.randrange(500), " ".join(rng.choice(["the", "cat's", "naïve", "12", "--", "\n", "𝔘"]) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    rows += [(None, "a b"), (None, None), (7, ""), (8, "word " * 20_000), rows[0]]
    found = tokens.token_digest(spark.createDataFrame([(d, t, 1, 2) for d, t in rows], TEXTS + ", start long, n_tokens long").repartition(6), VOCABULARY).collect()
    library = Tokenizer.from_file(VOCABULARY)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    expected = collections.Counter((d, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for d, t in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    named = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert named == sorted(named, key=lambda d: -1 if d is None else d)
    assert tokens.token_digest(spark.createDataFrame([], TEXTS), VOCABULARY).count() == 0


@pytest.mark.parametrize("n", [0, 1, 8, 300_001])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.4, 7, rng.integers(0, 50_257, n)).astype(np.uint32)
    data = wavelet.encode(ids, 16, b"more")
    file = wavelet.WaveletFile(blobs.from_bytes(data), len(data))
    assert (file.decode() == ids).all() and file.extra() == b"more" and file.count(7) == int((ids == 7).sum())
    for i in rng.integers(0, n, 5).tolist() if n else ():
        token = int(ids[i])
        before = int((ids[:i] == token).sum())
        assert file.access(i) == token and file.rank(token, i) == before and file.select(token, before) == i
    with pytest.raises(IndexError):
        file.access(n)
    assert file.count(60_000) == 0


# ---------------------------------------------------------------- nearest neighbours


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "shard_rows", lambda dim: 700)
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 32))
    vectors = (centres[rng.integers(0, 30, 3000)] + 0.6 * rng.normal(size=(3000, 32))).astype(np.float32)
    vectors[100:400] = vectors[50]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    hits = 0
    assert set(found) == set(range(0, 3000, 50))
    for q, got in found.items():
        score = unit @ unit[q]
        best = np.lexsort((np.arange(3000), -np.round(score, 12)))
        best = best[best != q][:5]
        hits += len({v for v, _ in got} & set(best.tolist()))
        assert all(abs(score[v] - s) < 1e-12 for v, s in got)
    assert hits >= 0.9 * 5 * len(found)
    assert [v for v, _ in found[50]] == [100, 101, 102, 103, 104]


def test_cells_hold_most_neighbours(monkeypatch):
    monkeypatch.setattr(ann, "CELL", 150)
    rng = np.random.default_rng(5)
    spread, lump = rng.normal(size=(1500, 16)), np.ones((900, 16)) + 1e-4 * rng.normal(size=(900, 16))
    unit = ann._unit(np.concatenate([spread, lump]).astype(np.float32))
    cells = ann._cells(unit, np.random.default_rng(1))
    assert len(cells) > 8 and max(map(len, cells)) <= 300 and set(np.concatenate(cells).tolist()) == set(range(2400))
    found, exact = ann._among(unit[:1500], 10), ann._nearest(unit[:1500], 10)
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) for a, b in zip(found, exact, strict=True)]) >= 6
    assert all(i not in row.tolist() and len(set(row.tolist()) - {-1}) == (row >= 0).sum() for i, row in enumerate(found))
    graph = ann.build(np.concatenate([spread, lump]).astype(np.float32))
    got = ann.search(graph, spread[:200].astype(np.float32))
    best = np.argsort(-(unit[:200] @ unit.T), axis=1)[:, :6]
    assert np.mean([len(set(a[:6].tolist()) & set(b.tolist())) for a, b in zip(got, best, strict=True)]) >= 5.7


def test_neighbours_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (50, [0.0, 1.0]), (None, [1.0, 1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, 1.0]), (7, []), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, shard int, score double")
    found = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1), (0, 2, 6), (0, 3, 50), (50, 1, 6), (50, 2, 0), (50, 3, 1)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_repeated_neighbours_count_once(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.1])] * 6 + [(i, [1.0, 0.1]) for i in (2, 3)] + [(4, [1.0, 0.2]), (4, [2.0, 0.4])] * 4 + [(5, [1.0, 0.5]), (6, [0.0, 1.0])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert [r.vec_id for r in found.orderBy("rank").collect()] == [1, 2, 3, 4, 5]


# ---------------------------------------------------------------- WARC


@pytest.mark.parametrize("wide", [False, True])
def test_zip_packages(wide):
    data = warc.zip_stored([("a/x", b"hello"), ("ü", b""), ("b", bytes(range(256)) * 40)], wide)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.read("a/x") == b"hello" and z.namelist() == ["a/x", "ü", "b"]
    held = warc.ZipPackage(blobs.from_bytes(data), len(data))
    assert held.whole("a/x") == b"hello" and held.range("b", 255, 3) == b"\xff\x00\x01"
    with pytest.raises(ValueError, match="outside"):
        held.range("a/x", 3, 9)


def test_zip_of_others():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("stored"), b"PK\5\6 in the data")
        z.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\5\6 inside"
    held = warc.ZipPackage(blobs.from_bytes(out.getvalue()), len(out.getvalue()))
    assert held.whole("stored") == b"PK\5\6 in the data"
    with pytest.raises(ValueError, match="compressed"):
        held.range("packed", 0, 1)
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.ZipPackage(blobs.from_bytes(b"no zip" * 9), 54)


def test_records_are_read_in_ranges():
    records = [(i, f"http://x/{i}\r\nevil: 1", warc.page_record(i, f"http://x/{i}\r\nevil: 1", "é" * i, hashlib.sha256(("é" * i).encode()).hexdigest(), None)) for i in range(200)]
    data = warc.package(records)
    calls = []

    def read(offset, length):
        calls.append(length)
        return data[offset : offset + length]

    pages = list(warc.read_package(read, len(data)))
    assert [p["payload_bytes"] for p in pages] == [2 * i for i in range(200)]
    assert len(calls) >= 200 and max(calls[3:-200] or [0]) < len(data)
    broken = data.replace(records[9][2][20:40], b"\0" * 20)
    with pytest.raises((OSError, EOFError, ValueError, zlib.error)):
        list(warc.read_package(blobs.from_bytes(broken), len(broken)))


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE", 3000)
    rng = random.Random(8)
    kinds = ["x" * 99, "x" * 100, "é" * 50, "é" * 49, "", None, *("".join(rng.choice("abc") for _ in range(300)) for _ in range(5))]
    rows = [(i, rng.choice(["http://a", None, ""]), rng.choice(kinds)) for i in range(200)]
    found = warc.warc_digest(spark.createDataFrame([(*r, "own", 3) for r in rows], "page_id long, url string, html string, digest string, size long").repartition(5)).collect()
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100:
            first.setdefault(h, i)
    expected = {(i, len(b := (h or "").encode()), hashlib.sha256(b).hexdigest(), "response" if first.get(h, i) == i else "revisit", None if first.get(h, i) == i else first[h]) for i, _, h in rows}
    assert {tuple(r) for r in found} == expected and len(found) == len(rows)


def test_index_and_ids_of_records():
    pages = [(2, "https://www.Example.com:443/b?q=1", "x"), (1, "http://a.example.com/ü x", "y"), (None, None, "z"), (3, "http://u@example.com:8080", "w")]
    data = warc.package([(i, u, warc.page_record(i, u, h, hashlib.sha256(h.encode()).hexdigest(), None)) for i, u, h in pages])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        lines = z.read(warc.INDEX).decode().splitlines()
    assert [line.split(" ")[0] for line in lines] == [")/", "com,example)/b?q=1", "com,example,a)/ü%20x", "com,example:8080)/"] and lines == sorted(lines)
    for line in lines:
        _, stamp, rest = line.split(" ", 2)
        assert re.fullmatch("[0-9]{14}", stamp) and {"url", "filename", "offset", "length"} <= set(json.loads(rest))
    headers, _ = warc.parse(warc.page_record(7, "http://x", "", hashlib.sha256(b"").hexdigest(), 5))
    assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", headers["warc-record-id"]) and headers["warc-refers-to"] == warc.record_id(5)
    assert sorted(p["page_id"] or 0 for p in warc.read_package(blobs.from_bytes(data), len(data))) == [0, 1, 2, 3]


def test_a_large_payload(spark):
    text = "".join(random.Random(4).choice("abcé ") for _ in range(1_500_000))
    found = warc.warc_digest(spark.createDataFrame([(1, "u", text), (2, "v", text)], "page_id long, url string, html string")).collect()
    raw = text.encode()
    assert {tuple(r) for r in found} == {(1, len(raw), hashlib.sha256(raw).hexdigest(), "response", None), (2, len(raw), hashlib.sha256(raw).hexdigest(), "revisit", 1)}


def test_files_where_a_name_is_taken(tmp_path, monkeypatch):
    """A second attempt of a task, on a file system that refuses to rename onto a file."""

    class Refusing:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def move(self, a, b):
            if self.inner.get_file_info(b).type == fs.FileType.File:
                raise FileExistsError(b)
            self.inner.move(a, b)

    system = Refusing(fs.LocalFileSystem())
    monkeypatch.setattr(blobs, "_at", lambda uri: (system, uri))
    path = str(tmp_path / "d" / "x")
    blobs.write(path, b"same")
    blobs.write(path, b"same")
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["x"]
    with pytest.raises(FileExistsError):
        blobs.write(path, b"another length")


def test_scratch_needs_a_shared_folder():
    class Spark:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            class getConf:  # noqa: N801
                get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared.shared_dir(Spark())


def test_warc_odd_rows(spark):
    big = "é" * 60
    rows = [(1, "u", big), (1, "u", big), (2, None, big), (None, "z", big), (None, "q", None), (5, "a", "")]
    found = warc.warc_digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert collections.Counter((r.page_id, r.record_type, r.refers_to) for r in found) == collections.Counter([(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "revisit", 1), (None, "response", None), (5, "response", None)])
    assert warc.warc_digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
