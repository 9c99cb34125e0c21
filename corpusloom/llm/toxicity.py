"""Toxicity: a linear-chain conditional random field over tokens.

Labels say which documents are toxic; tokens that occur in toxic documents far
beyond chance get the tag 1 there, all others 0. A CRF learns from all tokens
of the labelled texts (emissions by hashed token and shape, and transitions).
Forward and backward passes over every whole text give each token's marginal; a document's
score is a logistic function of their sum, maximum and density, and tokens of
marginal one half or more are reported with their offsets.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labels import consumed, fitted, held_out, training_texts
from .shared import slices, trimmed

TOKENS, SHAPES = 1 << 16, 4
MODULUS, HELD, CUT = 4, 2, 0.3
SAMPLE, CHARACTERS = 12_000, 64_000_000
#: Bytes of the texts that are scored together, and tokens whose places a task remembers.
CHUNK, REMEMBERED = 4_000_000, 1 << 17
#: Tokens of a training chain; cells of a block of chains that are tagged side by side, and the chains below which one goes alone.
PIECE, CELLS, FEW = 64, 1 << 18, 8
#: How far the gain of a tagged type may lie below what the best of all types reaches by chance (chosen on a fold of the training rows).
LENIENT = 4
#: Marginals that count in a text's sum.
FLOOR = 0.02
_EDGE = ".,;:!?()[]\"'%*#$&|"


class Places(dict):
    """Tokens to the places of their features: a hash of the bare lower-case form, and a shape."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bare = token.strip(_EDGE)
        shape = 0 if bare.islower() else 1 if bare.istitle() else 2 if bare.isupper() else 3
        self[token] = at = zlib.crc32(bare.lower().encode("utf-8", "surrogatepass")) % TOKENS * SHAPES + shape
        return at

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))


def marginals(odds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(tag 1) of each step (rows) of each chain (columns).

    ``odds``: exp of the emission's advantage of tag 1; ``moves``: exp of the
    four transition scores. Both passes keep the odds of tag 1 alone.
    """
    steps, chains = odds.shape
    (m00, m01), (m10, m11) = moves
    forth = np.empty_like(odds)
    r = np.ones(chains)
    for t in range(steps):
        r = (m01 + m11 * r) / (m00 + m10 * r) * odds[t] if t else odds[t]
        forth[t] = r
    q = np.ones(chains)
    for t in range(steps - 1, -1, -1):
        forth[t] *= q
        x = odds[t] * q
        q = (m10 + m11 * x) / (m00 + m01 * x)
    return forth / (1 + forth)


@dataclass
class Chain:
    emission: np.ndarray = field(default_factory=lambda: np.full(TOKENS * SHAPES, -7.0))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))
    bias: float = 0.0
    tagged: int = 0

    def tag(self, documents: list[np.ndarray]) -> list[np.ndarray]:
        """Marginals of each document's tokens, exact at any length."""
        out = [np.empty(0)] * len(documents)
        for d, p in self.tagged_blocks(documents):
            out[d] = p
        return out

    def tagged_blocks(self, documents: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """Place and marginals of each document, block by block.

        Documents of like length run side by side; where too few would, each
        runs alone through the same recursion in plain floats.
        """
        order = sorted(range(len(documents)), key=lambda d: len(documents[d]))
        moves, table = np.exp(self.moves), np.exp(np.clip(self.emission, -30, 30))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(documents[order[end]]) <= CELLS:
                end += 1
            some = order[at:end]
            at = end
            if len(some) < FEW:
                for d in some:
                    yield d, alone(table[documents[d]].tolist(), moves.tolist())
                continue
            ends = np.array([len(documents[d]) for d in some])
            odds = np.full((int(ends[-1]), len(some)), 1e-13)
            for k, d in enumerate(some):
                odds[: ends[k], k] = table[documents[d]]
            p = marginals_padded(odds, ends, moves)
            for k, d in enumerate(some):
                yield d, p[: ends[k], k]

    def score(self, p: np.ndarray) -> float:
        x = float(summary(p) @ self.weights) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def marginals_padded(odds: np.ndarray, ends: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """As :func:`marginals` for chains of different lengths, sorted by length."""
    steps, chains = odds.shape
    (m00, m01), (m10, m11) = moves
    forth = np.empty_like(odds)
    first = np.searchsorted(ends, np.arange(steps), side="right")  # chains that still run at each step
    r = np.ones(chains)
    for t in range(steps):
        k = first[t]
        r[k:] = (m01 + m11 * r[k:]) / (m00 + m10 * r[k:]) * odds[t, k:] if t else odds[t, k:]
        forth[t] = r
    q = np.ones(chains)
    for t in range(steps - 1, -1, -1):
        k = first[t]
        forth[t, k:] *= q[k:]
        x = odds[t, k:] * q[k:]
        q[k:] = (m10 + m11 * x) / (m00 + m01 * x)
    return forth / (1 + forth)


def alone(odds: list[float], moves: list[list[float]]) -> np.ndarray:
    """As :func:`marginals` for one chain."""
    (m00, m01), (m10, m11) = moves
    forth, r = [], None
    for o in odds:
        r = o if r is None else (m01 + m11 * r) / (m00 + m10 * r) * o
        forth.append(r)
    q = 1.0
    for t in range(len(odds) - 1, -1, -1):
        forth[t] *= q
        x = odds[t] * q
        q = (m10 + m11 * x) / (m00 + m01 * x)
    found = np.array(forth)
    return found / (1 + found)


def summary(p: np.ndarray) -> np.ndarray:
    """Sum, maximum and density of the marginals; those below the floor, of which a long text has many, don't add up."""
    if not len(p):
        return np.zeros(3)
    total = float(p[p > FLOOR].sum())
    return np.array([math.log1p(total), float(p.max()), math.log1p(100 * total / len(p))])


def toxic_types(documents: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Token types that toxic documents hold far beyond chance.

    The log-likelihood ratio of a type's share of toxic documents must come near
    what the best of all types would reach by chance (the chain unlearns tags
    that clean texts speak against), and most of the documents that hold it must
    be toxic.
    """
    rate = label.mean() if len(label) else 0.0
    if not 0 < rate < 1:
        return np.array([], np.int64)
    every, toxic = Counter(), Counter()
    for x, y in zip(documents, label, strict=True):
        types = np.unique(x // SHAPES).tolist()
        every.update(types)
        if y:
            toxic.update(types)
    kinds = np.array(list(toxic), np.int64)
    n, k = np.array([every[i] for i in kinds], float), np.array([toxic[i] for i in kinds], float)
    share = k / n
    gain = k * np.log(share / rate) + np.where(n > k, (n - k) * np.log(np.maximum((1 - share) / (1 - rate), 1e-12)), 0)
    return kinds[(share > 0.5) & (gain > math.log(len(every)) - LENIENT)]


def fit(texts: Iterable[str], label: np.ndarray, seed: int = 7, rounds: int = 6) -> Chain:
    """A chain from whole labelled texts.

    Every token of every text trains, in chains of ``PIECE``; a clean text that
    holds a tagged type speaks against that type.
    """
    rng, places, model = np.random.default_rng(seed), Places(), Chain()
    documents, by_content = [], {}
    for i, (text, y) in enumerate(zip(texts, label, strict=True)):
        tokens = text.split()
        documents.append(places.of(tokens))
        by_content[hashlib.sha256("\n".join(tokens).encode("utf-8", "surrogatepass")).digest(), y] = i
    places.clear()
    bad = np.zeros(TOKENS, bool)
    # copies of one toxic text would make all its words look toxic; copies (equal in every token) of one label count once
    once = list(by_content.values())
    bad[toxic_types([documents[i] for i in once], label[once])] = True
    model.tagged = int(bad.sum())
    rate = float(np.clip(label.mean() if len(label) else 0.1, 0.02, 0.98))
    model.bias = math.log(rate / (1 - rate))
    if not model.tagged:
        return model
    lengths = np.array([min(PIECE, len(x) - a) for x in documents for a in range(0, len(x), PIECE)])
    xs, ys = np.zeros((PIECE, len(lengths)), np.int32), np.zeros((PIECE, len(lengths)), bool)
    pieces = ((x[a : a + PIECE], y) for x, y in zip(documents, label, strict=True) for a in range(0, len(x), PIECE))
    for k, (x, y) in enumerate(pieces):
        xs[: len(x), k], ys[: len(x), k] = x, bad[x // SHAPES] & bool(y)
    token, shape = np.full(TOKENS, -4.0), np.full(SHAPES, -3.0)
    grown_t, grown_s, grown_m = np.full(TOKENS, 1e-4), np.full(SHAPES, 1e-4), np.full((2, 2), 1e-4)
    for _ in range(rounds):
        order = rng.permutation(xs.shape[1])
        step = max(64, min(1024, len(order) // 32))
        for at in range(0, len(order), step):
            some = order[at : at + step]
            some = some[np.argsort(lengths[some], kind="stable")]
            x, y, ends = xs[:, some], ys[:, some], lengths[some]
            inside = np.arange(PIECE)[:, None] < ends
            odds = np.exp(np.clip(token[x // SHAPES] + shape[x % SHAPES], -30, 30))
            moves = np.exp(model.moves)
            p = marginals_padded(odds, ends, moves)
            g = np.where(inside, y - p, 0.0) / len(some)
            slope = np.bincount((x // SHAPES).ravel(), g.ravel(), TOKENS)
            slope_s = np.bincount((x % SHAPES).ravel(), g.ravel(), SHAPES)
            slope_m = np.zeros((2, 2))
            pair = pair_marginals(odds, moves, ends)
            for i in (0, 1):
                for j in (0, 1):
                    seen = (y[:-1] == i) & (y[1:] == j) & inside[1:]
                    slope_m[i, j] = (seen.sum() - pair[i][j]) / len(some)
            slope_m[0, 0] = 0.0  # the reference the others are measured against
            for weights, slope_, grown in ((token, slope, grown_t), (shape, slope_s, grown_s), (model.moves, slope_m, grown_m)):
                grown += slope_ * slope_
                weights += 0.7 * slope_ / np.sqrt(grown)
    model.emission = (token[:, None] + shape[None, :]).ravel()
    del xs, ys
    found = np.zeros((len(documents), 3))
    for d, p in model.tagged_blocks(documents):
        found[d] = summary(p)
    fit_summary(model, found, label)
    return model


def pair_marginals(odds: np.ndarray, moves: np.ndarray, ends: np.ndarray | None = None) -> list[list[float]]:
    """Expected counts of the four transitions, summed over all chains; those of a chain stop at its end."""
    steps = len(odds)
    alpha = np.empty((steps, 2, odds.shape[1]))
    beta = np.ones((steps, 2, odds.shape[1]))
    alpha[0, 0], alpha[0, 1] = 1.0, odds[0]
    for t in range(1, steps):
        a = alpha[t - 1] / alpha[t - 1].sum(0)
        alpha[t, 0] = a[0] * moves[0, 0] + a[1] * moves[1, 0]
        alpha[t, 1] = (a[0] * moves[0, 1] + a[1] * moves[1, 1]) * odds[t]
    for t in range(steps - 2, -1, -1):
        b0, b1 = beta[t + 1, 0], beta[t + 1, 1] * odds[t + 1]
        beta[t, 0] = moves[0, 0] * b0 + moves[0, 1] * b1
        beta[t, 1] = moves[1, 0] * b0 + moves[1, 1] * b1
        beta[t] /= beta[t].sum(0)
        if ends is not None:
            beta[t][:, ends <= t + 1] = 1.0
    out = [[alpha[:-1, i] * moves[i, j] * beta[1:, j] * (odds[1:] if j else 1.0) for j in (0, 1)] for i in (0, 1)]
    total = sum(out[i][j] for i in (0, 1) for j in (0, 1))
    within = True if ends is None else np.arange(1, steps)[:, None] < ends
    return [[float(np.where(within, out[i][j] / total, 0.0).sum()) for j in (0, 1)] for i in (0, 1)]


def fit_summary(model: Chain, x: np.ndarray, label: np.ndarray) -> None:
    """Logistic regression on the documents' summaries, shifted so that the best cut scores 0.3."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, w, b = (x - mean) / scale, np.zeros(x.shape[1]), model.bias
    for _ in range(500):
        g = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - label
        w -= 0.5 * (z.T @ g / len(z) + 1e-3 * w)
        b -= 0.5 * g.mean()
    model.weights, model.bias = w / scale, b - float((w / scale) @ mean)
    cut = f1_cut(x @ model.weights + model.bias, label)
    model.bias += math.log(CUT / (1 - CUT)) - cut


def f1_cut(margins: np.ndarray, label: np.ndarray) -> float:
    """The margin above which calling documents toxic has the best F1."""
    order = np.argsort(-margins, kind="stable")
    m, hits = margins[order], np.cumsum(label[order])
    gain = 2 * hits / (np.arange(1, len(m) + 1) + label.sum())
    gain[:-1][m[:-1] == m[1:]] = -1
    best = int(gain.argmax())
    return float((m[best] + m[min(best + 1, len(m) - 1)]) / 2)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def scorer(model: Chain, inside: int | None = None):
    """``inside``: the text's place in the row's struct, where it doesn't travel as a column of its own."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in batches:
            column = batch.column("text") if inside is None else batch.column("_row").field(inside)
            for part in slices(column, CHUNK):  # bounded by bytes, not rows
                texts = [x or "" for x in column[part].to_pylist()]
                scores, spans = [0.0] * len(texts), [[]] * len(texts)
                for d, q in model.tagged_blocks([places.of(t.split()) for t in texts]):
                    scores[d] = model.score(q)
                    hit = set(np.flatnonzero(q >= 0.5).tolist())
                    found = [m.span() for i, m in enumerate(re.finditer(r"\S+", texts[d])) if i in hit] if hit else []
                    spans[d] = [{"start": a, "end": b, "p": float(v)} for (a, b), v in zip(found, q[sorted(hit)], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part].cast(pa.int64()), batch.column("_row")[part], pa.array(scores, pa.float64()), pa.array(spans, _SPAN)], ["doc_id", "_row", "score", "spans"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = MODULUS, held: int = HELD, most: int = SAMPLE, characters: int = CHARACTERS, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans (character offsets) of every row.

    With ``carry``, ``_row`` holds the row's columns as a struct, whatever their
    names. Null text counts as empty; texts of any length are read whole; null
    ids are held out; repeated rows and equal texts score alike; without labels
    of both classes, or without any token that tells them apart, the score is
    the base rate. An empty table gives an empty result.
    """
    model = Chain(**fitted(training_texts(docs, labels, label, modulus, held, most, characters), lambda texts, y: vars(fit(consumed(texts), y))))
    if carry:  # the text travels once, in its row
        inside = (docs.columns if "text" in docs.columns else [c.lower() for c in docs.columns]).index("text")
        rows = docs.select("doc_id", F.struct(*docs.columns).alias("_row"))
    else:
        inside, rows = None, docs.select("doc_id", "text", F.lit(None).cast("int").alias("_row"))
    made = T._parse_datatype_string("doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")
    rows = rows.mapInArrow(trimmed(scorer(model, inside)), T.StructType([made["doc_id"], rows.schema["_row"], made["score"], made["spans"]]))
    rows = rows.select("doc_id", "_row", held_out(F.col("doc_id"), modulus, held).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "spans")
    return rows if carry else rows.drop("_row")
