"""Outputs in parts, the cache, and JSON split level by level."""

import glob
import json

import pytest

from proofline.sources import published
from proofline.sources.json_tables import records


def content(path):
    parts = json.load(open(f"{path}/manifest.json"))["parts"]
    return b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/{parts}/part-*")))


def test_bytes_do_not_depend_on_partitions(spark, tmp_path):
    rows = [(i * 37 % 400 // 3, f"é {i}" if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, text string")
    held = []
    for n in (1, 5, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        assert published.publish(df.repartition(n), f"{tmp_path}/{n}", ["id"])
        held.append(content(f"{tmp_path}/{n}"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert held[0] == held[1] == held[2] and held[0].count(b"\n") == 400
    assert [json.loads(x)["id"] for x in held[0].splitlines()] == sorted(r[0] for r in rows)
    assert not published.publish(df.limit(3), f"{tmp_path}/1", ["id"]) and content(f"{tmp_path}/1") == held[0]
    assert published.published(spark, f"{tmp_path}/64").count() == 400
    with pytest.raises(FileNotFoundError):
        published.published(spark, f"{tmp_path}/none")


def test_first_writer_wins(spark, tmp_path):
    path = str(tmp_path / "cache")
    one = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "3"), (None, "x")], "k string, v string")
    assert {tuple(r) for r in published.put(one, path, "k", "v").collect()} == {("a", "1"), ("b", "3")}
    two = spark.createDataFrame([("a", "9"), ("c", "4")], "k string, v string")
    assert {tuple(r) for r in published.put(two, path, "k", "v").collect()} == {("c", "4")}
    assert {tuple(r) for r in published.cached(spark, path).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    assert published.create(spark, f"{path}/x", "1") and not published.create(spark, f"{path}/x", "2") and published.read_small(spark, f"{path}/x") == "1"
    assert published.cached(spark, str(tmp_path / "other")) is None


def walk(value, path, cap, top=False):
    text = json.dumps(value, ensure_ascii=False, sort_keys=True)
    if top and isinstance(value, dict) and value or len(text) > cap and isinstance(value, dict | list) and value:
        kids = [(f"{path}.{k}", v) for k, v in sorted(value.items())] if isinstance(value, dict) else [(f"{path}[{i}]", v) for i, v in enumerate(value)]
        return [x for p, v in kids for x in walk(v, p, cap)]
    return [(path, text)]


def test_json_records(spark):
    values = [{"a": 1, "b": {"c": ["x, y: z", 'q"\\u', None, True], "d": {}}, "e": [{"k": i, "t": "ü" * i, "l": [i, {"m": [i] * 30}]} for i in range(20)]}, [1, 2, {"long": "w" * 200}], {}, "text", 5, [[["deep" * 30] * 3] * 2]]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(90, "{broken"), (91, None), (92, "")]
    got = records(spark.createDataFrame(rows, "s int, text string").repartition(3), "s", cap=60).collect()
    for i, v in enumerate(values):
        mine = sorted((r for r in got if r.s == i), key=lambda r: r.place)
        assert [(r.path, r.text) for r in mine] == walk(v, "$", 60, True)
    assert {(r.s, r.reason) for r in got if r.reason} == {(90, "not valid JSON"), (92, "not valid JSON")} and not [r for r in got if r.s == 91]
    flat = records(spark.createDataFrame([(1, '{"r": {"a": 1, "b": null, "c": "x", "d": true}, "n": {"a": [1]}}')], "s int, text string"), "s").collect()
    assert {r.path: r.fields for r in flat} == {"$.r": {"a": "1", "c": "x", "d": "true"}, "$.n": None}
