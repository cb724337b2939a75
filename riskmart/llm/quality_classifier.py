"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is a node with two states, good and bad. Its features are counts
of its own characters and words and those of the lines before and after it. Forward and
backward messages give each line's marginal; their mean, weighted by length, passed
through a two-parameter calibration, is the document's score.

Training uses a bounded sample of labelled rows (``Settings.max_train``), never rows of
the held-out fold, and every line of a row bears the row's label. All rows are scored
in one pass without a shuffle, whole texts at a time.

Defined results: NULL, empty and blank texts count as one line without words. Labels
that are NULL are not used; of repeated labels the larger counts. Without labels of
both kinds the score is the share of good labels (0.5 without any). Repeated ids and
rows are scored one by one. Rows without an id are never held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import pieces, table
from riskmart.llm.toxicity import fold, logistic, training_rows

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b"#*$%&|<>@^~_=+\\/{}[]"
ENDS = (b".", b"!", b"?", b":", b'"')
N_OWN = 11


@dataclass(frozen=True)
class Settings:
    max_train: int = 3000
    steps: int = 150
    rate: float = 0.1
    ridge: float = 1e-3


def line_features(line: bytes, seen: set[bytes]) -> list[float]:
    """The features of a line; ``seen`` holds the earlier lines of its text."""
    words = line.split()
    n, size = max(1, len(words)), max(1, len(line))
    share = lambda characters: (size - len(line.translate(None, characters))) / size
    alike = sum(map(bytes.__eq__, words[1:], words))
    again = line in seen
    seen.add(line)
    return [
        np.log1p(len(words)), share(MARKS), line.count(b"|") / n, line.count(b"!") / n,
        share(UPPER), share(DIGITS), len(set(words)) / n, alike / n, min(3.0, size / n / 8),
        float(line.rstrip().endswith(ENDS)), float(again)]


def document(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x 3 * N_OWN: own, line before, line after) and line lengths."""
    data = (text or "").encode("utf-8", "surrogatepass")
    lines = [x for x in data.split(b"\n") if x.split()] or [b""]
    seen: set[bytes] = set()
    own = np.array([line_features(x, seen) for x in lines])
    edge = np.zeros((1, N_OWN))
    return (np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])]),
            np.array([max(1, len(x)) for x in lines], float))


class Padded:
    """Chains side by side, the longest first; step t touches the chains longer than t."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        self.starts, self.lengths = starts[self.order], lengths[self.order]
        longest = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(longest), "left")

    def messages(self, unary: np.ndarray, pair: np.ndarray, backward: bool) -> np.ndarray:
        """The log odds that reach each node from its earlier (or later) side."""
        t = pair.T if backward else pair
        out = np.zeros(len(unary))
        for step in range(1, len(self.active)):
            k = self.active[step]
            here = self.starts[:k] + (self.lengths[:k] - 1 - step if backward else step)
            before = here + 1 if backward else here - 1
            r = unary[before] + out[before]
            out[here] = np.logaddexp(t[0, 1], r + t[1, 1]) - np.logaddexp(t[0, 0], r + t[1, 0])
        return out


def marginals(unary: np.ndarray, pair: np.ndarray, chains: Padded) -> tuple[np.ndarray, ...]:
    """Log odds of state 1 at every node, and the messages from both sides."""
    ahead, behind = chains.messages(unary, pair, False), chains.messages(unary, pair, True)
    return unary + ahead + behind, ahead, behind


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, settings: Settings):
    """Weights (bias last) and the 2 x 2 scores of neighbouring states by gradient ascent
    on the likelihood (Adam)."""
    chains = Padded(lengths)
    first = np.zeros(len(x), bool)
    first[np.concatenate(([0], np.cumsum(lengths)))[:-1]] = True
    right = np.flatnonzero(~first)
    left = right - 1
    x = np.hstack([x, np.ones((len(x), 1))])
    theta = np.zeros(x.shape[1] + 4)
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), len(x)
    index = (y[left] * 2 + y[right]).astype(int)
    observed = np.bincount(index, minlength=4) if len(left) else np.zeros(4)
    for step in range(1, settings.steps + 1):
        unary, pair = x @ theta[:-4], theta[-4:].reshape(2, 2)
        odds, ahead, behind = marginals(unary, pair, chains)
        gradient = np.zeros_like(theta)
        gradient[:-4] = x.T @ (y - sigmoid(odds)) / n
        a, b = unary[left] + ahead[left], unary[right] + behind[right]
        joint = np.stack([np.zeros_like(a), b, a, a + b]) + theta[-4:, None]
        if len(left):
            joint = np.exp(joint - joint.max(0))
            gradient[-4:] = (observed - (joint / joint.sum(0)).sum(1)) / n
        gradient -= settings.ridge * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient ** 2
        theta += settings.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pair: np.ndarray
    slope: float
    offset: float

    def raw(self, x: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of the lines of each document."""
        unary = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        good = sigmoid(marginals(unary, self.pair, Padded(lengths))[0])
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        return np.add.reduceat(good * sizes, starts) / np.add.reduceat(sizes, starts)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        docs = [document(t) for t in texts]
        lengths = np.array([len(s) for _, s in docs])
        q = self.raw(np.vstack([x for x, _ in docs]), np.concatenate([s for _, s in docs]), lengths)
        return sigmoid(self.slope * _logit(q) + self.offset)


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def train(documents: DataFrame, labels: DataFrame, keep: Column,
          settings: Settings = Settings(), label: str = "quality") -> Model:
    rows = training_rows(documents, labels, label, keep, settings.max_train)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            docs = [document(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([x.astype("<f4").tobytes() for x, _ in docs], pa.binary()),
                pa.array([s.tobytes() for _, s in docs], pa.binary()), batch.column(1)],
                ["x", "sizes", "label"])

    sample = rows.mapInArrow(read, "x binary, sizes binary, label int").collect()
    y = np.array([float(r.label > 0) for r in sample])
    width = 3 * N_OWN
    if len(set(y)) < 2:
        share = np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999)
        return Model(np.zeros(width), np.ones(width), np.zeros(width + 1), np.zeros((2, 2)),
                     0.0, float(np.log(share / (1 - share))))
    x = np.vstack([np.frombuffer(r.x, "<f4").reshape(-1, width) for r in sample]).astype(float)
    sizes = [np.frombuffer(r.sizes) for r in sample]
    lengths = np.array([len(s) for s in sizes])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    weights, pair = fit_chain((x - mean) / scale, np.repeat(y, lengths), lengths, settings)
    draft = Model(mean, scale, weights, pair, 1.0, 0.0)
    q = _logit(draft.raw(x, np.concatenate(sizes), lengths))
    slope, offset = logistic(q[:, None], y, 1.0)
    return Model(mean, scale, weights, pair, float(slope), float(offset))


def score(documents: DataFrame, model: Model, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    slim = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {documents.schema[id_col].dataType.simpleString()}, score double"

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()))],
                ["doc_id", "score"])

    return slim.mapInArrow(rate, schema)


def query(spark, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(documents, labels, fold(F.col("doc_id"), 3) != 1)
    return score(documents, model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
