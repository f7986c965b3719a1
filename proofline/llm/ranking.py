"""Operator 1: quality scores by Bradley-Terry ranking of preference pairs.

Method. Every pair of a document labelled 1 and one labelled 0 says that the first is preferred. Weights of text features
are learnt by logistic loss on the pair's feature differences (a Bradley-Terry model whose log-strengths are linear in
the features). The strength at the quantile that the label-0 share of the sample marks becomes the threshold; scores are
squeezed into 0 to 1 so that the threshold lies at 0.3.

The fit uses at most `sample_rows` labelled rows outside the held-out fold and `pairs` pairs drawn from them with a fixed
seed; every document is scored from its whole text and from nothing else.

Defined cases: a null text is scored as an empty one; repeated rows give a row each; an empty table gives none; without
labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm import labelled
from proofline.llm._common import rows_of, sized
from proofline.llm.textstats import SLICE_CHARS, count

SAMPLE_ROWS = 4000
PAIRS = 40_000
THRESHOLD = 0.3
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def features(texts: list[str | None]) -> np.ndarray:
    """A row of numbers for each text: sizes, shares of repeated words and lines, and shares of byte values."""
    c = count(texts)
    n, chars = np.maximum(c.n_words, 1), np.maximum(c.n_chars, 1)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hist = np.stack([np.bincount(np.frombuffer(r, np.uint8), minlength=256) for r in raw]) if raw else np.zeros((0, 256))
    share = hist / np.maximum(hist.sum(1), 1)[:, None]
    ascii_ = share[:, 32:127]
    groups = [share[:, 65:91].sum(1), share[:, 97:123].sum(1), share[:, 48:58].sum(1), share[:, 128:].sum(1), share[:, list(b"!?")].sum(1), share[:, list(b".,;:")].sum(1)]
    distinct = c.n_distinct / n
    stats = [
        np.log1p(c.n_words), np.log1p(c.n_chars), c.word_chars / n, c.n_symbols / chars, c.n_symbols / n, distinct, np.where(c.n_words == 0, 0, distinct / np.maximum(np.log1p(c.n_words), 1)),
        c.n_repeat_words / n, (c.n_repeat_words / n) ** 2, c.n_dup_lines / np.maximum(c.n_lines, 1), c.n_lines / n, (c.n_words < 20).astype(float), (c.n_words == 0).astype(float), share.max(1) if len(raw) else np.zeros(0),
    ]
    dense = np.stack([*stats, *groups], 1) if raw else np.zeros((0, len(stats) + len(groups)))
    return np.concatenate([dense, np.sqrt(ascii_)], 1)


@dataclass
class Ranking:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float  # the strength at the quantile
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = np.clip((x - self.centre) / self.spread, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (strength - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD)), -60, 60)))


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = 300, l2: float = 1e-3, seed: int = 7) -> Ranking:
    """Weights from preference pairs, and the threshold from the quantile of the strengths."""
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - centre) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)
    w, velocity = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(steps):
        part = rng.integers(0, pairs, 4000)
        difference = z[better[part]] - z[worse[part]]
        p = 1 / (1 + np.exp(np.clip(difference @ w, -60, 60)))  # of the wrong order
        velocity = 0.9 * velocity + (difference.T @ p / len(part) - l2 * w)
        w = w + 0.05 * velocity
    strength = z @ w
    cut = float(np.quantile(strength, np.mean(y == 0)))
    slopes = np.geomspace(0.02, 20, 60)
    logit = np.log(THRESHOLD / (1 - THRESHOLD))
    loss = [np.mean(np.logaddexp(0, -np.where(y == 1, 1, -1) * (s * (strength - cut) + logit))) for s in slopes]
    return Ranking(centre, spread, w, cut, float(slopes[int(np.argmin(loss))]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, pairs: int = PAIRS) -> Ranking | None:
    """Fit on a bounded sample of labelled rows; None without labels of both kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sized(rows_of(batches, "h", "text", "y"), lambda r: len(r[1]), SLICE_CHARS):
            x = features([r[1] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["h", "y", "x"])

    rows = labelled.sample(docs, labels, label, sample_rows).mapInArrow(run, "h long, y int, x binary").orderBy("h", "y", "x").limit(sample_rows).collect()
    y = np.array([r.y for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return bradley_terry(np.stack([np.frombuffer(r.x, np.float64) for r in rows]), y, pairs)


def score(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs(doc_id, text)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sized(rows_of(batches, "doc_id", "text"), lambda r: len(r[1] or ""), SLICE_CHARS):
            s = model.score(features([r[1] for r in rows])) if model else np.full(len(rows), 0.5)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], schema=SCORES)

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
