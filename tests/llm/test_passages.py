"""The pipeline's substring stage against brute force by bytes and by words."""

import re

import numpy as np

import corpus_pipeline as P
from proofline.llm import substring_dedup


def brute(rows):
    """(texts left by id, how many passages 400 bytes do not reach): later copies of 400 bytes, and of 51 words of an earlier document, go."""
    bytes_seen, words_seen, want, shorter = {}, {}, {}, 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = t.encode()
        gone, whole = np.zeros(len(b), bool), np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if bytes_seen.setdefault(b[p : p + 400], (d, p)) != (d, p):
                gone[p : p + 400] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2)
        for x, y in edges:
            x, y = substring_dedup.inside_characters(b, int(x), int(y))
            whole[x:y] = True
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        for i in range(len(words) - 50):
            if words_seen.setdefault(tuple(w for _, _, w in words[i : i + 51]), d) != d:
                shorter += not whole[words[i][0] : words[i + 50][1]].all()
                whole[words[i][0] : words[i + 50][1]] = True
        want[d] = bytes(np.frombuffer(b, np.uint8)[~whole]).decode()
    return want, shorter


def test_stage_by_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000").dropDuplicates(["text"])
    want, shorter = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert shorter  # passages that 400 bytes do not reach
    assert {r.doc_id: r.text for r in P.substring_stage(spark, docs, sf).collect()} == want
