"""Quality classifier: a factorisation machine over hashed words, structure and size.

score = sigmoid(w0 + w.x + sum over pairs of <v_i, v_j> x_i x_j); the pairs are
summed in linear time as half of (sum of v x) squared minus the sum of (v x)
squared. The model is fitted on a bounded labelled sample in one task; every
whole text is scored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import fitted, held_out, training_texts
from .shared import texts_of

WORDS, BINS, RANK = 1 << 13, 16, 8
MODULUS, HELD, CUT = 5, 0, 0.3
SAMPLE, CHARACTERS, EPOCHS, BATCH, STEP = 12_000, 64_000_000, 8, 256, 0.01
_UPPER, _DIGIT = slice(65, 91), slice(48, 58)
_STOPS = [ord(c) for c in ".,;:?'\"-()"]
_OTHER = [i for i in range(33, 127) if not chr(i).isalnum() and i not in _STOPS]


def structure(text: str, words: list[str]) -> list[float]:
    """Shares and sizes, each between 0 and 1."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = text.split("\n")
    count = max(len(words), 1)
    after = sum(map(str.__eq__, words, words[1:]))
    return [
        seen[_OTHER].sum() / n, seen[_STOPS].sum() / n, seen[33] / n, seen[_UPPER].sum() / n, seen[_DIGIT].sum() / n, seen[124] / n,
        seen[128:].sum() / n, min(1.0, seen[32] / n * 4), min(1.0, len(lines) / count * 4),
        1 - len(set(words)) / count, 1 - len(set(lines)) / len(lines), after / count,
        min(1.0, n / count / 32), min(1.0, math.log2(count) / 16), min(1.0, math.log2(n) / 20),
    ]


N_STATS = len(structure("", []))
WIDTH = WORDS + N_STATS * BINS


class Places(dict):
    """Words to their hashed places; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 19:
            self.clear()
        self[word] = at = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return at


def features(text: str, places: Places) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: words with unit length together, and one bin for each statistic."""
    words = text.split()
    found = np.bincount(np.fromiter(map(places.__getitem__, words), np.int64, len(words)), minlength=WORDS)
    at = np.flatnonzero(found)
    value = np.log1p(found[at])
    value /= math.sqrt(float(value @ value)) or 1.0
    # square roots spread the small shares over more bins
    bins = [WORDS + i * BINS + min(BINS - 1, int(math.sqrt(x) * BINS)) for i, x in enumerate(structure(text, words))]
    return np.concatenate([at, bins]), np.concatenate([value, np.full(N_STATS, 0.5)]).astype(np.float32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    shift: float = 0.0

    def margin(self, at: np.ndarray, value: np.ndarray) -> float:
        each = self.factors[at] * value[:, None]
        total = each.sum(0)
        return float(self.bias + self.linear[at] @ value + 0.5 * (total @ total - np.einsum("ij,ij->", each, each)))

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(at, value) + self.shift))))


def balanced_cut(margins: np.ndarray, label: np.ndarray) -> float:
    """The margin that best separates the classes, both counting alike; 0 if there is but one."""
    order = np.argsort(margins, kind="stable")
    m, y = margins[order], label[order]
    if not 0 < y.sum() < len(y):
        return 0.0
    gain = np.cumsum(1 - y) / (1 - y).sum() - np.cumsum(y) / y.sum()  # what a cut above each margin gains
    gain[:-1][m[:-1] == m[1:]] = -1
    best = np.flatnonzero(gain >= gain.max() - 1e-12)[0]
    return float((m[best] + m[min(best + 1, len(m) - 1)]) / 2)


def fit(texts: list[str], label: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Logistic loss, minibatches, Adam. A fifth of the rows sets the cut and is not trained on."""
    rng, places = np.random.default_rng(seed), Places()
    rate = float(np.clip(label.mean() if len(label) else 0.5, 0.02, 0.98))
    model = Machine(math.log(rate / (1 - rate)), np.zeros(WIDTH, np.float32), rng.normal(0, 0.02, (WIDTH, RANK)).astype(np.float32))
    if not 0 < label.sum() < len(label):
        return model
    rows = [features(t, places) for t in texts]
    grown = [np.zeros_like(model.linear), np.zeros_like(model.linear), np.zeros_like(model.factors), np.zeros_like(model.factors)]
    steps = 0

    def train(ids: np.ndarray, rounds: int) -> None:
        nonlocal steps
        for _ in range(rounds):
            ids = rng.permutation(ids)
            for at in range(0, len(ids), BATCH):
                some = ids[at : at + BATCH]
                x = np.zeros((len(some), WIDTH), np.float32)
                for i, j in enumerate(some):
                    x[i, rows[j][0]] = rows[j][1]
                used = np.flatnonzero(x.any(0))
                x = x[:, used]
                v, x2 = model.factors[used], x * x
                total = x @ v
                margin = model.bias + x @ model.linear[used] + 0.5 * (total * total - x2 @ (v * v)).sum(1)
                g = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[some]) / len(some)).astype(np.float32)
                steps += 1
                model.bias -= STEP * float(g.sum())
                slopes = (x.T @ g + 1e-5 * model.linear[used], x.T @ (g[:, None] * total) - (x2.T @ g)[:, None] * v + 1e-4 * v)
                for weights, slope, mean, square in ((model.linear, slopes[0], *grown[:2]), (model.factors, slopes[1], *grown[2:])):
                    mean[used] = 0.9 * mean[used] + 0.1 * slope
                    square[used] = 0.99 * square[used] + 0.01 * slope * slope
                    weights[used] -= STEP * mean[used] / (1 - 0.9**steps) / (np.sqrt(square[used] / (1 - 0.99**steps)) + 1e-6)

    ids = rng.permutation(len(rows))
    kept, rest = ids[: len(ids) // 5], ids[len(ids) // 5 :]
    train(rest, max(epochs, min(40, 24_000 // max(len(rest), 1))))
    cut = balanced_cut(np.array([model.margin(*rows[j]) for j in kept]), label[kept])
    model.shift = math.log(CUT / (1 - CUT)) - cut
    return model


def scorer(model: Machine):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in batches:
            found = [model.score(*features(t, places)) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.float64())], ["doc_id", "score"])

    return score


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = MODULUS, held: int = HELD, most: int = SAMPLE, characters: int = CHARACTERS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null text counts as empty and is scored like any; texts of any length are
    read whole; null ids are held out; repeated rows and equal texts get equal
    scores; without labels of both classes every score is the base rate; an
    empty table gives an empty result. Only doc_id and text are read, so names
    of other columns don't matter.
    """
    model = Machine(**fitted(training_texts(docs, labels, label, modulus, held, most, characters), lambda texts, y: vars(fit(texts, y.astype(np.float32)))))
    rows = docs.select("doc_id", "text").mapInArrow(scorer(model), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id"), modulus, held).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
