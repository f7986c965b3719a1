"""Operator 7: quality rules and a classifier over hashed word and character n-grams.

Method. A logistic regression over hashed word unigrams and bigrams and character trigrams, each as its share of the text's
n-grams, is fitted on at most `sample_rows` labelled rows outside the held-out fold; a second, disjoint part of the sample
calibrates its probability (Platt scaling). Texts are scored in Arrow batches against fixed thresholds: the base rules
(fewer than 50 words; more than half of the words in repeated 3-word windows) and a probability of quality.

Defined cases: a null text has no words and fails the base rules; repeated rows give a row each; an empty table gives
none; without labels of both kinds the classifier keeps every text that passes the base rules.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm import labelled
from proofline.llm._common import from_text, rows_of, sized
from proofline.llm.textstats import SLICE_CHARS, Counts, count

BINS = 1 << 13  # of characters; as many of words
SCALE = 30.0
SAMPLE_ROWS = 3000
MIN_QUALITY = 0.3
MIN_WORDS = 50
MAX_REPEATED = 50  # percent
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def grams(texts: list[str | None], counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins of character trigrams with the text of each, and of word unigrams and bigrams with the text of each."""
    held = [t or "" for t in texts]
    data = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(held), dtype=np.int32), [len(t) for t in held])
    h = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)
    inside = of[:-2] == of[2:]
    chars, chars_of = (h >> np.uint32(19)).astype(np.int32)[inside], of[:-2][inside]
    crc = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in counts.vocabulary], np.uint32)
    w = crc[counts.ids] if len(crc) else np.zeros(0, np.uint32)
    w_of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(counts.ends, prepend=0))
    pair = (w[:-1] * np.uint32(0x85EBCA77)) ^ w[1:]
    both = w_of[:-1] == w_of[1:]
    mixed = np.concatenate([w * np.uint32(0x9E3779B1), pair[both] * np.uint32(0xC2B2AE3D)])
    return chars, chars_of, BINS + (mixed >> np.uint32(19)).astype(np.int32), np.concatenate([w_of, w_of[:-1][both]])


def shares(bins: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The weight of each n-gram: SCALE over the count of its text's n-grams."""
    return (SCALE / np.maximum(np.bincount(of, minlength=n), 1)).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray  # float32, 2 * BINS
    bias: float
    slope: float
    shift: float

    def score(self, texts: list[str | None], counts: Counts) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        g = grams(texts, counts)
        for bins, of in (g[:2], g[2:]):
            z += np.bincount(of, self.weights[bins], len(texts)) * shares(bins, of, len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -60, 60)))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed features of labelled texts: distinct bins and their shares."""
    for rows in sized(rows_of(batches, "h", "text", "y"), lambda r: len(r[1]), SLICE_CHARS):
        texts = [r[1] for r in rows]
        g = grams(texts, count(texts))
        bins, of = np.concatenate([g[0], g[2]]), np.concatenate([g[1], g[3]])
        value = np.concatenate([shares(*g[:2], len(rows))[g[1]], shares(*g[2:], len(rows))[g[3]]])
        key, inverse = np.unique(of.astype(np.int64) * (2 * BINS) + bins, return_inverse=True)
        value = np.bincount(inverse, value, len(key)).astype(np.float32)
        cut = np.searchsorted(key, np.arange(len(rows) + 1) * (2 * BINS))
        out = [(h, y, (key[a:b] % (2 * BINS)).astype(np.uint16).tobytes(), value[a:b].tobytes()) for (h, _, y), a, b in zip(rows, cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_pylist([dict(zip(("h", "y", "bins", "shares"), o, strict=True)) for o in out], schema=pa.schema([("h", pa.int64()), ("y", pa.int32()), ("bins", pa.binary()), ("shares", pa.binary())]))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * z + shift) a probability (Newton's method, softened targets)."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        r, v = p - target, np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[np.sum(v * z * z) + 1e-3, np.sum(v * z)], [np.sum(v * z), np.sum(v) + 1e-3]])
        step = np.linalg.solve(hessian, [np.sum(r * z) + 1e-3 * (a - 1), np.sum(r)])
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, steps: int = 120, l2: float = 1e-4) -> Model:
    """Fit on at most `sample_rows` labelled rows: two thirds for the weights, one third for the calibration."""
    features = labelled.sample(docs, labels, label, sample_rows).mapInArrow(_sparse, "h long, y int, bins binary, shares binary")
    rows = features.orderBy("h", "y", F.xxhash64("bins", "shares")).limit(sample_rows).collect()
    y = np.array([r.y for r in rows], np.float64)
    model = Model(np.zeros(2 * BINS, np.float32), 0.0, 1.0, 5.0)
    if len(set(y.tolist())) < 2:
        return model
    bins = [np.frombuffer(r.bins, np.uint16).astype(np.int32) for r in rows]
    value = [np.frombuffer(r.shares, np.float32) for r in rows]
    train = np.arange(len(rows)) % 3 != 2
    at = np.flatnonzero(train)
    of = np.repeat(np.arange(len(at)), [len(bins[i]) for i in at])
    b, v = np.concatenate([bins[i] for i in at]), np.concatenate([value[i] for i in at])
    t = y[at]
    weight = np.where(t == 1, 0.5 / max(t.sum(), 1), 0.5 / max((1 - t).sum(), 1))
    w, bias, vel, vb = np.zeros(2 * BINS), 0.0, np.zeros(2 * BINS), 0.0
    for _ in range(steps):  # Nesterov's method
        look, look_b = w + 0.9 * vel, bias + 0.9 * vb
        z = np.bincount(of, v * look[b], len(at)) + look_b
        r = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - t)
        vel = 0.9 * vel - 0.5 * (np.bincount(b, v * r[of], 2 * BINS) + l2 * look)
        vb = 0.9 * vb - 0.5 * r.sum()
        w, bias = w + vel, bias + vb
    z = np.array([float(w[i] @ x) + bias for i, x in zip(bins, value, strict=True)])
    rest = ~train if len(set(y[~train].tolist())) == 2 else train
    slope, shift = platt(z[rest], y[rest])
    return Model(w.astype(np.float32), float(bias), slope, shift)


def score(docs: DataFrame, model: Model, min_quality: float = MIN_QUALITY) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality and kept.

    Input columns of those names are replaced; all others stay.
    """

    def measure(texts: list[str | None]) -> list:
        c = count(texts)
        q = model.score(texts, c)
        failed = (c.n_words < MIN_WORDS) | (100 * c.n_repeat_words > MAX_REPEATED * c.n_words)
        return [*(getattr(c, k) for k in COLUMNS), failed, q, ~failed & (q >= min_quality)]

    return from_text(docs, [*((c, "long") for c in COLUMNS), ("base_failed", "boolean"), ("quality", "double"), ("kept", "boolean")], measure, SLICE_CHARS)
