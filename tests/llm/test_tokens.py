"""Operators 2, 8 and 9 against the tokenizers library itself."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from proofline.llm import bpe, packing, sstable

ODD = [None, "", " ", "\n\n", "a", "It's  I'LL\tdon't\x1cx\x85y z", "<|endoftext|> x<|startoftext|>", "İstanbul ﬁ ①② 日本語 é", "  lead trail  ", "a\n\nb \n c\n", "word " * 5000, "x" * 9000, "a", "123 45.6 --- !!", " wide　space", "a\0b \0"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    odd = spark.createDataFrame([(None if i == 3 else 10_000 + i // 2, t, i) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens int")
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").withColumn("n_tokens", F.lit(1)).unionByName(odd)


def word_ids(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t, lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encode_and_decode(spark, docs):
    t, ids = word_ids("word_bpe_49k.json")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((r.doc_id or -1, len(i := ids(r.text)), sha(" ".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False)), i) for r in docs.collect())
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in bpe.encode(docs, "word_bpe_49k.json", block_chars=50_000).collect())
    assert got == want
    assert bpe.encode(docs.limit(0), "word_bpe_49k.json").count() == 0
    shuffled = docs.repartition(5).orderBy(F.rand()).repartition(3)  # another order each time that it is read
    got = shuffled.transform(bpe.encode, "word_bpe_49k.json", True, 30_000).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == [w[:4] for w in want]


def test_packing(spark, docs):
    _, ids = word_ids("word_bpe_49k.json")
    rows = packing.pack(docs.repartition(3), "word_bpe_49k.json", keep_ids=True).collect()
    want = sorted(np.array(ids(r.text) + [2], "<u4").tobytes() for r in docs.collect())
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length * 4 == len(r.ids)
        of[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r.length for r in rows) == sum(len(x) // 4 for x in want)
    unique = {k: v for k, v in of.items() if sum(x.length for x in v) == k[1]}
    joined = {b"".join(x.ids for x in sorted(v, key=lambda x: x.start)) for v in unique.values()}
    assert joined <= set(want) and len(joined) > 180
    padding = 1 - sum(r.length for r in rows) / (4096 * len(sequences))
    assert padding < 0.12  # three small workers, each with one open sequence
    assert packing.pack(docs.limit(0), "word_bpe_49k.json").count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 100, 1365, 1366, 2000, 2049, 4095, 4096, 4097, 10_000])
def test_cuts_cover_a_document_once(n):
    at = 0
    for start, length, k in packing.cuts(n, 4096, 0.02):
        assert start == at and 0 < length * k <= 4096
        at += length
    assert at == n


def test_sstable(spark, docs):
    _, ids = word_ids("byte_bpe_50k.json")
    manifest = sstable.write(docs, "byte_bpe_50k.json", shards=4)
    rows = sstable.read(manifest, keep_ids=True).orderBy("start").collect()
    want = sorted((-(10**9) if r.doc_id is None else r.doc_id, np.array(ids(r.text) + [2], "<u4").tobytes()) for r in docs.collect())
    assert sorted((-(10**9) if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in rows) == want
    at, last = 0, -(10**9)
    for r in rows:
        assert r.start == at and r.n_tokens * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids) and (r.doc_id or -(10**9) * (r.doc_id is None)) >= last
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else last
    assert sorted(sstable.lookup(manifest, 10_000)) == sorted(x for k, x in want if k == 10_000)
    assert len(sstable.lookup(manifest, None)) == 1 and sstable.lookup(manifest, 999_999) == []
    assert sstable.write(docs.limit(0), "byte_bpe_50k.json").count() == 0
