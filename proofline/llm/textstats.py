"""Counts over whole texts, a slice of documents at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from proofline.llm._common import WS
from proofline.llm.vocab import words

SYMBOLS = "#*$%&|<>"
SLICE_CHARS = 1_000_000


class Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


@dataclass
class Counts:
    """Arrays with one entry a text, and the word ids that they were counted from."""

    n_chars: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_lines: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    n_distinct: np.ndarray
    ids: np.ndarray  # of all texts, one after the other
    ends: np.ndarray  # where each text's ids end
    vocabulary: list[str]


def repeated(ids: np.ndarray, size: int, window: int = 3) -> int:
    """Words that lie in a window of `window` words found at least twice."""
    if len(ids) < window:
        return 0
    code = ids[: len(ids) - window + 1]
    for i in range(1, window):
        if size > 2_000_000:  # codes would overflow: number the windows so far anew
            code = np.unique(code, return_inverse=True)[1]
        code = code * size + ids[i : len(ids) - window + 1 + i]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(code), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(ids), bool)
    for i in range(window):
        covered[i : len(ids) - window + 1 + i] |= twice
    return int(covered.sum())


def count(texts: list[str | None]) -> Counts:
    """Counts of a slice of texts; null counts as empty."""
    numbers, n = Numbers(), len(texts)
    get = numbers.__getitem__
    out = {k: np.zeros(n, np.int64) for k in ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")}
    parts = []
    for i, text in enumerate(texts):
        if not text:
            parts.append(np.zeros(0, np.int64))
            continue
        own = words(text)
        parts.append(np.fromiter(map(get, own), np.int64, len(own)))
        lines = [x for x in text.split("\n") if x.strip(WS)]
        out["n_chars"][i] = len(text)
        out["n_words"][i] = len(own)
        out["word_chars"][i] = len(text) - sum(map(text.count, WS))
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    repeat = np.array([repeated(p, len(numbers)) for p in parts], np.int64)
    distinct = np.array([len(np.unique(p)) for p in parts], np.int64)
    return Counts(**out, n_repeat_words=repeat, n_distinct=distinct, ids=np.concatenate(parts) if parts else np.zeros(0, np.int64), ends=np.cumsum([len(p) for p in parts]), vocabulary=list(numbers))
