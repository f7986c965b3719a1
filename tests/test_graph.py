"""Loops and columns against a walk written out."""

import random

from proofline.operators import graph


def walk(links):
    """Links that close no loop, by a recursive walk in depth."""
    after, nodes = {}, sorted({n for e in links for n in e})
    for a, b in links:
        after.setdefault(a, set()).add(b)
    fed = {b for _, b in links}
    state, kept = {}, set()

    def visit(n):
        state[n] = 1
        for m in sorted(after.get(n, ())):
            if state.get(m) == 1:
                continue
            kept.add((n, m))
            if m not in state:
                visit(m)
        state[n] = 2

    for n in [n for n in nodes if n not in fed] + [n for n in nodes if n in fed]:
        if n not in state:
            visit(n)
    return kept


def test_loops(spark):
    rng = random.Random(2)
    links = {(g * 10 + rng.randrange(7), g * 10 + rng.randrange(7)) for g in range(6) for _ in range(12)}
    df = spark.createDataFrame(sorted(links), "a long, b long")
    nodes = spark.createDataFrame([(n,) for n in range(70)], "node long")
    kept = walk(links)
    assert {tuple(r) for r in graph.without_loops(df).collect()} == kept
    level = {n: 0 for n in range(70)}
    for _ in range(70):
        for a, b in kept:
            level[b] = max(level[b], level[a] + 1)
    assert {r.node: r.column for r in graph.columns(df, nodes).collect()} == level
    assert graph.columns(df.limit(0), nodes).where("column <> 0").count() == 0


def test_numbered(spark):
    from proofline.operators.skew import numbered

    rows = [(i * 37 % 101,) for i in range(101)]
    got = numbered(spark.createDataFrame(rows, "x long").repartition(5), "x").collect()
    assert sorted((r.x, r.number) for r in got) == [(i, i + 1) for i in range(101)]


def test_blocks_are_walked_in_streams(spark):
    """No group of its own for each block: very many small blocks share a task, and a block may span batches."""
    rng = random.Random(5)
    links = {(g * 20 + rng.randrange(15), g * 20 + rng.randrange(15)) for g in range(40) for _ in range(25)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = graph.without_loops(spark.createDataFrame(sorted(links), "a long, b long"))
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
        assert {tuple(r) for r in got.collect()} == walk(links)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_first_links_follow_the_order_of_the_sql(spark, tmp_path):
    """Line numbers over 9, and keys of more than 12 digits: the order is that of l_orderkey * 10 + l_linenumber."""
    import duckdb

    from proofline.plans import QUERIES, SQL

    rows = [(1, 1, 15, 4), (2, 1, 1, 3), (9, 2, 1, 7), (10, 2, 1, 6), (10**13, 3, 1, 2), (2 * 10**12, 3, 1, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = {(r.node, r.root) for r in QUERIES["entity_components_veto"](spark, str(tmp_path)).collect()}
    assert got == {tuple(r) for r in con.execute(SQL["entity_components_veto"]).fetchall()}


def test_links_without_a_place_come_last(spark, tmp_path):
    """An order key or line number that is null is no first one: the SQL's arg_min passes over it."""
    import duckdb

    from proofline.plans import QUERIES, SQL

    rows = [(None, 4, 1, 8), (7, 4, 1, 2), (3, 5, None, 2), (9, 5, 2, 8)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = {(r.node, r.root) for r in QUERIES["entity_components_veto"](spark, str(tmp_path)).collect()}
    assert got == {tuple(r) for r in con.execute(SQL["entity_components_veto"]).fetchall()}
