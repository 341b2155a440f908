"""Toxicity: a linear-chain conditional random field tags toxic tokens.

Training, on a bounded sample of labelled rows (SAMPLE per class):
1. Labels mark documents, not tokens. Features (words and word beginnings) that
   toxic documents hold many times as often as others mark the tokens of toxic
   documents that have them; all other tokens are clean.
2. The field has two states. A token's emission is the sum of its features'
   weights; weights and transitions are fitted by gradient ascent on the
   conditional likelihood, whose gradient the forward-backward marginals give.
3. A logistic curve over a document's marginals (the largest, and their sum)
   is fitted to the documents' labels.

Scoring reads each whole text once. With two states the forward and backward
messages are ratios, and a step is a Moebius map x -> (A x + B) / (C x + D);
all tokens of a batch are one chain that starts anew with each document, cut
into segments whose maps are first multiplied side by side. So no loop runs
over tokens, whatever the texts' lengths.

Inputs of a score are the text's words only. Defined results: null and empty
texts get the curve's value for no toxic token; very long texts are scored whole; a null doc_id is in the held-out
fold; repeated rows give a row each; conflicting labels of a doc_id count as
toxic; without labels of both classes every score is 0; a score of 0.5 counts as toxic;
an empty table gives no rows. Extra columns are kept
by filter_toxic(), not read by the rest.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents of each class that are sampled for training, at most; folds; rounds of gradient ascent.
SAMPLE, FOLDS, ROUNDS = 1500, 5, 30
#: A feature is known if so many documents hold it; it marks toxic tokens if toxic documents hold it so many times as
#: often as clean ones, and with that log-likelihood ratio (20: by chance for one feature of 100,000).
LEAST_DOCS, LIFT, EVIDENCE = 3, 10.0, 20.0
#: Tokens scored and trained on at once, steps of a segment, words whose emissions a task remembers.
_TOKENS, _BLOCK, _STEPS, _WORDS = 1 << 18, 1 << 17, 256, 1 << 19
_PART = re.compile(r"[^\W_]+")
_FAR = 30.0


def features(word: str) -> list[str]:
    """Of a lower-case word: itself and its beginnings of 4 to 6 letters."""
    return ["=" + word, *(word[:n] for n in (4, 5, 6) if len(word) >= n)]


@dataclass
class Model:
    """weights: by feature; bias: of every emission; trans: log weights [0->1, 1->0, 1->1] (0->0 has 0); start: log odds;
    curve: of a document's score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -_FAR
    trans: tuple[float, float, float] = (0.0, 0.0, 0.0)
    start: float = 0.0
    curve: tuple[float, float, float] = (-_FAR, 0.0, 0.0)


class Emissions(dict):
    """The emission of each raw token (a run of anything but white space), worked out once."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def of(self, part: str) -> float:
        get = self.model.weights.get
        return self.model.bias + sum(get(f, 0.0) for f in features(part))

    def __missing__(self, raw: str) -> float:
        if len(self) >= _WORDS:
            self.clear()
        value = self[raw] = max((self.of(p) for p in _PART.findall(raw.lower())), default=self.model.bias)
        return value


def _scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x_t = (a_t x + b_t) / (c_t x + d_t) along the arrays, from x = 1; all are positive or zero."""
    n = len(a)
    cols = max(1, -(-n // _STEPS))
    pad = cols * _STEPS - n

    def cut(v: np.ndarray, fill: float) -> np.ndarray:
        return np.concatenate([v, np.full(pad, fill)]).reshape(cols, _STEPS).T.copy()

    a, b, c, d = cut(a, 1.0), cut(b, 0.0), cut(c, 0.0), cut(d, 1.0)
    p, q, r, s = np.ones(cols), np.zeros(cols), np.zeros(cols), np.ones(cols)
    for t in range(_STEPS):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        scale = 1.0 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    x, at = np.ones(cols), 1.0
    for k, (pk, qk, rk, sk) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        x[k] = at
        at = (pk * at + qk) / (rk * at + sk)
    out = np.empty((_STEPS, cols))
    for t in range(_STEPS):
        x = (a[t] * x + b[t]) / (c[t] * x + d[t])
        out[t] = x
    return out.T.reshape(-1)[:n]


def messages(emit: np.ndarray, first: np.ndarray, trans: tuple[float, float, float], start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ratios (state 1 to state 0) of the forward and backward messages, and the emissions as factors."""
    psi = np.exp(np.clip(emit, -_FAR, _FAR))
    t01, t10, t11 = np.exp(trans)
    one, zero = np.ones_like(psi), np.zeros_like(psi)
    go = ~first
    fore = _scan(np.where(go, psi * t11, zero), np.where(go, psi * t01, psi * np.exp(start)), np.where(go, t10, zero), one)
    nxt = np.append(psi[1:], 1.0)
    on = np.append(go[1:], False)
    back = _scan(np.where(on, nxt * t11, zero)[::-1], np.where(on, t10, one)[::-1], np.where(on, nxt * t01, zero)[::-1], one)[::-1]
    return fore, back, psi


def marginals(emit: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Log odds that each token is toxic; first: where documents start."""
    fore, back, _ = messages(emit, first, model.trans, model.start)
    return np.log(np.maximum(fore, 1e-300)) + np.log(np.maximum(back, 1e-300))


def _document_features(odds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document the largest log odds (within 12 of 0) and the log of 1 + the expected toxic tokens."""
    most, some = np.full(len(counts), -12.0), np.zeros(len(counts))
    full = np.flatnonzero(counts)
    if len(full):
        at = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        most[full] = np.clip(np.maximum.reduceat(odds, at), -12, 12)
        some[full] = np.log1p(np.add.reduceat(1 / (1 + np.exp(-np.clip(odds, -_FAR, _FAR))), at))
    return most, some


def _curve(model: Model, most: np.ndarray, some: np.ndarray) -> np.ndarray:
    c0, c1, c2 = model.curve
    return 1 / (1 + np.exp(-np.clip(c0 + c1 * most + c2 * some, -_FAR, _FAR)))


def _apart(texts: list[str]) -> list[int]:
    """The places of the texts that share at most a fifth of their five-word strings with those before them.

    Copies would let every word of one document stand for its label. One string in eight, by its hash, is compared.
    """
    seen: set[int] = set()
    out = []
    for i, text in enumerate(texts):
        raw = text.split()
        own = {h for k in range(max(1, len(raw) - 4)) if not (h := zlib.crc32(" ".join(raw[k : k + 5]).encode("utf-8", "surrogatepass"))) & 7}
        own = own or {zlib.crc32(text.encode("utf-8", "surrogatepass"))}
        if len(own & seen) <= 0.2 * len(own):
            seen |= own
            out.append(i)
    return out


def train(texts: list[str], labels: list[int]) -> Model:
    """A model from whole texts and their labels (0 or 1)."""
    apart = _apart(texts)
    texts, labels = [texts[i] for i in apart], [labels[i] for i in apart]
    words: dict[str, int] = {}
    docs = [np.array([words.setdefault(p, len(words)) for p in _PART.findall(t.lower())], np.int32) for t in texts]
    y = np.array(labels, bool)
    if not y.any() or y.all():
        return Model()
    # A row of feature numbers for each word, -1 where it has fewer.
    place: dict[str, int] = {}
    table = np.full((len(words) + 1, 4), -1, np.int32)
    for w, word in enumerate(words):
        found = [place.setdefault(f, len(place)) for f in features(word)]
        table[w, : len(found)] = found
    in_docs = np.zeros((2, len(place)), np.int64)
    for ids, toxic in zip(docs, y, strict=True):
        held = np.unique(table[np.unique(ids)])
        in_docs[int(toxic), held[held >= 0]] += 1
    (n0, n1), (k0, k1) = (int((~y).sum()), int(y.sum())), in_docs
    share = n1 / (n1 + n0)
    k = np.maximum(k0 + k1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = 2 * (np.where(k1 > 0, k1 * np.log(k1 / (k * share)), 0) + np.where(k0 > 0, k0 * np.log(k0 / (k * (1 - share))), 0))
    marks = ((k1 + 0.5) / (n1 + 1) >= LIFT * (k0 + 0.5) / (n0 + 1)) & (evidence >= EVIDENCE)
    known = np.flatnonzero(k0 + k1 >= LEAST_DOCS)
    number = np.full(len(place) + 1, -1, np.int64)
    number[known] = np.arange(len(known))
    marked = (np.append(marks, False)[table] & (table >= 0)).any(axis=1)
    kept = np.where(table >= 0, number[table], -1)
    of_word, column = np.nonzero(kept >= 0)
    of_feature = kept[of_word, column]
    names = [f for f, ok in zip(place, k0 + k1 >= LEAST_DOCS, strict=True) if ok]

    # Blocks of whole documents, so that a round's arrays stay small.
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held_ids: list[np.ndarray] = []
    held_toxic: list[bool] = []
    size = 0
    full = [i for i, d in enumerate(docs) if len(d)]
    for n, i in enumerate(full, 1):
        held_ids.append(docs[i])
        held_toxic.append(bool(y[i]))
        size += len(docs[i])
        if size >= _BLOCK or n == len(full):
            counts = np.fromiter(map(len, held_ids), np.int64, len(held_ids))
            tokens = np.concatenate(held_ids)
            first = np.zeros(len(tokens), bool)
            first[np.cumsum(counts) - counts] = True
            blocks.append((tokens, first, (np.repeat(held_toxic, counts) & marked[tokens]).astype(float)))
            held_ids, held_toxic, size = [], [], 0

    # Adam on the log likelihood per document, with a small pull to zero.
    x = np.zeros(len(known) + 5)
    x[-5] = -3.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, ROUNDS + 1):
        weights, bias, trans, start = x[:-5], x[-5], tuple(x[-4:-1]), x[-1]
        per_word = bias + np.bincount(of_word, weights[of_feature], len(table))
        by_word, rest = np.zeros(len(table)), np.zeros(5)
        t01, t10, t11 = np.exp(trans)
        for tokens, first, truth in blocks:
            fore, back, psi = messages(per_word[tokens], first, trans, start)
            miss = truth - fore * back / (1 + fore * back)
            by_word += np.bincount(tokens, miss, len(table))
            pair = ~first[1:]
            was, now = truth[:-1][pair], truth[1:][pair]
            ahead, before = (psi * back)[1:][pair], fore[:-1][pair]
            joint = np.stack([t01 * ahead, t10 * before, t11 * before * ahead])
            joint /= 1 + joint.sum(axis=0)
            seen = np.array([((1 - was) * now).sum(), (was * (1 - now)).sum(), (was * now).sum()])
            rest += np.concatenate([[miss.sum()], seen - joint.sum(axis=1), [miss[first].sum()]])
        grad = np.concatenate([np.bincount(of_feature, by_word[of_word], len(known)) - 0.05 * weights, rest]) / len(full)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        x = x + 0.4 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        x[-4:] = np.clip(x[-4:], -4.0, 4.0)
    model = Model({f: float(w) for f, w in zip(names, x[:-5], strict=True) if abs(w) > 1e-4}, float(x[-5]), tuple(map(float, x[-4:-1])), float(x[-1]))

    # The curve: logistic regression by Newton's method, kept from running off where classes part cleanly.
    emissions = Emissions(model)
    most, some = _score_features(texts, emissions)
    z = np.stack([np.ones(len(y)), most / 12, some], axis=1)
    beta = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -_FAR, _FAR)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(3)
        beta = beta + np.linalg.solve(hess, z.T @ (y - p) - 0.1 * beta)
    model.curve = (float(beta[0]), float(beta[1] / 12), float(beta[2]))
    return model


def _score_features(texts: list[str], emissions: Emissions) -> tuple[np.ndarray, np.ndarray]:
    most, some = np.full(len(texts), -12.0), np.zeros(len(texts))
    held: list[np.ndarray] = []
    lo = size = 0
    for hi, text in enumerate(texts, 1):
        raw = text.split()
        held.append(np.fromiter(map(emissions.__getitem__, raw), float, len(raw)))
        size += len(raw)
        if size >= _TOKENS or hi == len(texts):
            counts = np.fromiter(map(len, held), np.int64, len(held))
            emit = np.concatenate(held)
            first = np.zeros(len(emit), bool)
            begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
            first[begin[counts > 0]] = True
            odds = marginals(emit, first, emissions.model) if len(emit) else emit
            most[lo:hi], some[lo:hi] = _document_features(odds, counts)
            lo, size, held = hi, 0, []
    return most, some


def toxic_spans(text: str, emissions: Emissions) -> list[tuple[int, int, float]]:
    """The tokens likelier toxic than not: start, end (code points, end exclusive), marginal."""
    places = [m.span() for m in re.finditer(r"\S+", text)]
    if not places:
        return []
    emit = np.array([emissions[text[a:b]] for a, b in places])
    odds = marginals(emit, np.arange(len(emit)) == 0, emissions.model)
    return [(a, b, float(1 / (1 + np.exp(-o)))) for (a, b), o in zip(places, np.clip(odds, -_FAR, _FAR), strict=True) if o > 0]


def with_toxicity(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """docs without text, with score and, if asked for, spans (the offending tokens)."""
    kept = T.StructType([f for f in docs.schema.fields if f.name != "text"]).add("score", T.DoubleType())
    if spans:
        one = T.StructType().add("start", T.LongType()).add("end", T.LongType()).add("marginal", T.DoubleType())
        kept = kept.add("spans", T.ArrayType(one))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        emissions = Emissions(model)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.pop("text")]
            most, some = _score_features(texts, emissions)
            out = batch.assign(score=_curve(model, most, some))
            if spans:
                out["spans"] = [[{"start": a, "end": b, "marginal": p} for a, b, p in toxic_spans(t, emissions)] if m > 0 else [] for t, m in zip(texts, most, strict=True)]
            yield out

    return docs.select(*(f for f in kept.names if f not in ("score", "spans")), "text").mapInPandas(score, kept)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled rows outside fold 0: of each class the first by a hash, so many at most."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = None
    for label in (0, 1):
        some = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        drawn = some if drawn is None else drawn.unionByName(some)
    # At most 2 * SAMPLE ids, so they may be broadcast; their texts go to one task, which trains, and the model to the driver.
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    found = rows.repartition(1).mapInPandas(_train_rows, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else Model()


def _train_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = sorted((r for batch in batches for r in zip(batch["doc_id"].tolist(), batch["text"].tolist(), batch["toxic"].tolist(), strict=True)))
    model = train([r[1] for r in rows], [int(r[2]) for r in rows])
    yield pd.DataFrame({"model": [pickle.dumps(model)]})


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = with_toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows scored 0.5 or more."""
    names = docs.columns
    fields = docs.schema

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        emissions = Emissions(model)
        for batch in batches:
            most, some = _score_features(["" if t is None else t for t in batch["text"]], emissions)
            yield batch[_curve(model, most, some) < 0.5]

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInPandas(keep, fields)

