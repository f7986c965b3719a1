"""Each stage of the pipeline against a brute-force version on the stage's own input."""

from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from proofline.llm import quality_rules, secrets
from proofline.llm._common import materialise
from tests.llm.test_passages import brute as passages
from tests.llm.test_shingle_join import brute, variants

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS)
    near = [(5000 + i, t) for i, t in enumerate(variants(1, 120, 6, 2))] + [(5000, variants(1, 120, 6, 2)[0])]
    odd = [(None, variants(2, 90, 0, 0)[0] + " password=abcdefgh1"), (6001, None), (6002, ""), (6003, variants(3, 300, 0, 0)[0]), (6004, "x y " * 30 + variants(3, 300, 0, 0)[0][:900] + " " + variants(4, 100, 0, 0)[0])]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in near + odd], docs.schema))
    steps = [materialise(docs, "in")]
    for name, stage in P.STAGES:
        steps.append(materialise(stage(spark, steps[-1], sf), name))
        if name != "packing":
            assert steps[-1].columns == COLUMNS and steps[-1].dtypes == docs.dtypes
    rows = [[tuple(r) for r in s.collect()] for s in steps]

    model = quality_rules.fit(steps[0], spark.read.parquet(f"{sf}/labels.parquet"))
    assert Counter(rows[1]) == Counter(tuple(r) for r in quality_rules.score(steps[0], model).where("kept").select(*COLUMNS).collect())
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").join(quality_rules.score(steps[0], model).where("not base_failed"), "doc_id")
    assert good.where("kept").count() >= 0.97 * good.count()

    component = brute([r[:2] for r in rows[1]])
    assert len(rows[2]) == len({c for _, n, c in component if n} - {"None"}) + sum(c == "None" for _, n, c in component if n) + sum(n == 0 for _, n, _ in component)
    assert Counter(rows[2]) <= Counter(rows[1]) and sum(r[0] in range(5000, 5007) for r in rows[2]) == len({c for d, _, c in component if d.isdigit() and 5000 <= int(d) < 5007})

    want, _ = passages([r[:2] for r in rows[2]])
    assert {r[0]: r[1] for r in rows[3]} == want and all(r[4] == len(r[1]) for r in rows[3]) and len(rows[3]) == len(rows[2])

    for before, after in zip(sorted(rows[3], key=str), sorted(rows[4], key=str), strict=True):
        assert before[0] == after[0] and after[4] == len(after[1])
        assert (before[1] == after[1]) == (not secrets.scan(before[1])[1]) and not secrets.base(after[1])

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {r[0]: len(t.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows[4]}
    got = defaultdict(int)
    for r in steps[5].collect():
        got[r.doc_id] += r.length
        assert r.doc_tokens == tokens[r.doc_id]
    assert got == tokens


CLASHING = ["__t", "__id", "__th", "__bytes", "__words", "__own_0", "kept", "quality", "n_words", "base_failed", "root", "cls", "starts", "whole", "Kept_by", "spans"]


def test_clashing_columns_come_back(spark, sf):
    """Columns with the names that stages use themselves stay as they were; what the stages decide does not change."""
    text = variants(9, 150, 3, 2)
    rows = [(i, t) for i, t in enumerate([*text, text[0], None, "", "x password=abcdefgh1 " + variants(8, 90, 0, 0)[0]])] + [(0, text[0]), (None, text[1])]
    plain = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    tagged = plain.select("doc_id", *(F.concat_ws("|", F.lit(c), "doc_id", F.md5("text")).alias(c) for c in CLASHING), "text", "n_chars")
    for name, stage in P.STAGES[:-1]:
        a, b = stage(spark, plain, sf), stage(spark, tagged, sf)
        assert b.columns == tagged.columns and b.dtypes == tagged.dtypes
        got = b.collect()
        assert Counter((r.doc_id, r.text, r.n_chars) for r in got) == Counter(tuple(r) for r in a.collect()), name
        known = {tuple(r[c] for c in CLASHING) for r in tagged.collect()}
        assert all(tuple(r[c] for c in CLASHING) in known and r["__th"].split("|")[0] == "__th" for r in got)
    pieces = P.packing_stage(spark, tagged, sf)
    assert pieces.select("doc_id", "length").exceptAll(P.packing_stage(spark, plain, sf).select("doc_id", "length")).count() == 0


def test_run(spark, sf):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "shingle_join", "substring_dedup", "secrets", "packing"]
    out = P.run(spark, sf)
    assert out.agg(F.countDistinct("doc_id")).first()[0] > 100


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs
