"""Operator 6 against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from proofline.llm import substring_dedup


def brute(rows, size):
    places = defaultdict(list)
    for n, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            places[b[p : p + size]].append((n, p))
    gone = [np.zeros(len((t or "").encode()), bool) for _, t in rows]
    for where in places.values():
        if len(where) > 1:
            for n, p in where:
                gone[n][p : p + size] = True
    out = Counter()
    for (d, t), g in zip(rows, gone, strict=True):
        b = (t or "").encode()
        out[d, len(b), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~g])).hexdigest()] += 1
    return out


def corpus(size):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéfgh ") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (size // 5, size // 4, size, size // 8)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(1, size // 3))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 3)
            parts += [p[a : len(p) - rng.randrange(len(p) // 3)], prose(rng.randrange(1, 40))]
        rows.append((i, " ".join(parts)))
    whole = prose(size)
    rows += [(100, whole), (101, whole), (101, whole), (102, whole + "x"), (103, whole[5:]), (None, whole), (104, None), (105, ""), (106, "a" * (size + 7)), (107, "ab" * size), (108, "short"), (108, "short"), (109, "a" * size), (110, "é" * size)]
    return rows


@pytest.mark.parametrize("size,gram", [(40, 20), (400, 200), (50, 11)])
def test_removed_bytes(spark, size, gram, monkeypatch):
    rows = corpus(size)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, substring_dedup.digest(df, size, gram).collect())) == brute(rows, size)


def test_join_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", -1)
    rows = corpus(40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, substring_dedup.digest(df, 40, 20).collect())) == brute(rows, 40)
    assert substring_dedup.digest(df.limit(0), 40, 20).count() == 0


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.where("length(text) < 4000").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substring_dedup.digest(df).collect())) == brute(rows, 400)


def test_keep_first(spark):
    """Every window of the input is still there once: nothing is lost but later copies."""
    size, rows = 40, corpus(40)
    rows = [(i, t, t) for i, (_, t) in enumerate(rows)]  # ids in order
    df = spark.createDataFrame(rows, "doc_id long, text string, whole string").repartition(3)
    got = {r.doc_id: r.text for r in substring_dedup.dedup(df, size, 20).collect()}
    first = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - size + 1):
            if first.setdefault(b[p : p + size], (i, p)) != (i, p):
                gone[p : p + size] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2)
        runs = [substring_dedup.inside_characters(b, int(x), int(y)) for x, y in edges]
        want = substring_dedup._kept(b, np.array(runs, int).reshape(-1, 2)).decode()
        assert got[i] == (want if t is not None else None)


def test_passages_by_words(spark):
    """Passages of 51 words under 400 bytes: later documents lose them, shorter or own repeats stay, each passage stays once."""
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    p, q, short, own = prose(51), prose(70), prose(50), prose(60)
    assert max(map(len, (p, q, own))) < 400
    texts = {1: f"{prose(9)} {p} {prose(8)}", 2: f"é {p}", 3: f"{prose(5)} {p.replace(' ', chr(10))} x {p} {short}", 4: short + " tail", 5: f"{own} a {own} b", 6: q, 7: q, 8: f"{prose(4)} {q} end", 9: None}
    want = dict(texts) | {2: "é ", 3: texts[3].split(" ", 5)[:5], 7: "", 8: texts[8].replace(q, "")}
    want[3] = " ".join(want[3]) + "  x  " + short
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in substring_dedup.dedup(df, words=51).collect()} == want
    assert {r.doc_id: r.text for r in substring_dedup.dedup(df.coalesce(1), words=51).collect()} == want
    assert {r.doc_id: r.text for r in substring_dedup.dedup(df).collect()} == texts


def test_keep_first_with_repeated_rows(spark):
    """Rows that repeat id and text count as one document: both keep what no earlier document holds."""
    a, b, c = ("".join(random.Random(n).choices("abcdefgh ", k=90)) for n in range(3))
    rows = [(1, a), (1, a), (2, b), (2, b), (3, b), (None, c), (None, c), (4, a + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for words in (None, 5):
        got = Counter((r.doc_id, r.text.strip()) for r in substring_dedup.dedup(df, 40, 20, words=words).collect())
        assert got == Counter([(1, a.strip()), (1, a.strip()), (2, b.strip()), (2, b.strip()), (3, ""), (None, c.strip()), (None, c.strip()), (4, "tail")])


def test_smallest_in_texts_beyond_the_position_bits(monkeypatch):
    monkeypatch.setattr(substring_dedup, "POSITION_BITS", 6)
    rng = np.random.default_rng(1)
    for n in (0, 6, 7, 63, 64, 65, 122, 123, 1000):
        grams = rng.integers(0, 9, n).astype(np.uint64) << np.uint64(40)
        want = [i + int(np.argmin(grams[i : i + 7])) for i in range(n - 6)]
        assert substring_dedup.smallest(grams, 7).tolist() == want


@pytest.mark.parametrize("keep_first,across", [(True, False), (False, False), (True, True), (False, True)])
def test_previous_factors(keep_first, across):
    """Each suffix against all others, symbol by symbol."""
    rng, size, gram = random.Random(7), 12, 5
    members, shared = [], bytes(rng.choices(b"ab", k=40))
    for document in range(12):
        for _ in range(3):
            a, b = rng.randrange(0, 8), rng.randrange(0, 8)
            text = bytearray(bytes(rng.choices(b"ab", k=8)) + b"-" * gram + bytes(rng.choices(b"ab", k=7)))
            if rng.random() < 0.6:
                text[:8], text[8 + gram :] = shared[:8], shared[8:15]
            members.append((document, bytes(text[8 - a : 8]), bytes(text[8 : 8 + gram + b])))
    hit, lead = substring_dedup.previous_factors([m[1][::-1] for m in members], [m[2] for m in members], np.array([m[0] for m in members]), size, gram, 1, keep_first, across)
    runs = defaultdict(list)
    for n, (_, left, right) in enumerate(members):
        for d in range(len(left) + 1):
            if d + len(right) >= size:
                runs[d, (left[len(left) - d :] + right)[:size]].append(n)
    want, first = np.zeros_like(hit), np.zeros_like(lead)
    for (d, _), own in runs.items():
        for n in own:
            others = [m for m in own if (m < n if keep_first else m != n) and (not across or members[m][0] != members[n][0])]
            want[n, d] = bool(others)
            first[n, d] = members[n][0] == members[own[0]][0] if across else n == own[0]
    assert want.any() and (hit == want).all() and (lead == first).all()


def test_hot_passages_in_groups(spark, monkeypatch):
    """Groups of blocks are reduced first; the result is the same."""
    monkeypatch.setattr(substring_dedup, "FAN_BLOCKS", 1)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 500)
    rows = corpus(40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert Counter(map(tuple, substring_dedup.digest(df, 40, 20).collect())) == brute(rows, 40)


def test_periodic_text(spark):
    rows = [(1, "a" * 300_000), (2, "xyz" * 50_000 + "é"), (3, "xyz" * 300)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 300_000, 2: 150_000, 3: 900}


@pytest.mark.parametrize("keep_first", [False, True])
def test_shared_words(spark, keep_first):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    p, own, copy = prose(60), prose(55), prose(52)
    texts = {1: f"{prose(9)} {p}", 2: f"{p[: p.rindex(' ')]}\n{prose(7)}", 3: f"{own} x {own}", 4: prose(300), 5: copy, 6: copy, 7: None, 8: prose(20) + " " + " ".join(p.split()[5:55])}
    got = {r.doc_id: r.n_shared_words for r in substring_dedup.digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), words=51, keep_first=keep_first).collect()}
    assert got == {1: 0 if keep_first else 59, 2: 59, 3: 0, 4: 0, 5: 0 if keep_first else 52, 6: 52, 7: 0, 8: 0}
