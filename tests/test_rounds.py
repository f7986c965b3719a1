"""Order-dependent operators that work in rounds, against the same rules walked one by one."""

import random
import re

import pytest

from proofline.operators import coverage, dependency, graph, skew
from proofline.operators.dependency import Model

TAG = "^[A-Z]-[0-9]+$"


def ordered_union(links):
    parent, tag = {}, {}

    def top(x):
        if x not in parent:
            parent[x], tag[x] = x, bool(re.search(TAG, x))
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b in sorted((o, a, b) for a, b, o in links):
        x, y = sorted((top(a), top(b)))
        if x != y and not (tag[x] and tag[y]):
            parent[y], tag[x] = x, tag[x] or tag[y]
    return {n: top(n) for n in parent}


@pytest.mark.parametrize("seed", [0, 5])
def test_veto(spark, seed):
    rng = random.Random(seed)
    names = [f"T-{i}" for i in range(8)] + [f"n{i}" for i in range(40)]
    links = [(rng.choice(names), rng.choice(names), rng.randrange(30 if seed % 2 else 10**6)) for _ in range(45 + 15 * seed)]
    if seed == 5:
        links += [(f"n{i}", "T-0", 5) for i in range(40)] + [(f"T-{i}", f"n{i}", 4) for i in range(8)]
    df = spark.createDataFrame(links, "a string, b string, ord long")
    got = graph.components_with_veto(df, TAG).collect()
    want = ordered_union(links)
    assert len(got) == len(want)
    # The root is the smallest node of the component, which the walk's may not be.
    smallest = {}
    for n, r in want.items():
        smallest[r] = min(n, smallest.get(r, n))
    assert {r.node: r.root for r in got} == {n: smallest[r] for n, r in want.items()}


def test_veto_of_a_chain_takes_few_rounds(spark, monkeypatch):
    """A path whose links come in order would take a round a link if only the first link of all was decided."""
    rounds = []
    real = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, what: (rounds.append(what), real(df, what))[1])
    links = [(f"n{i:03}", f"n{i + 1:03}", i) for i in range(200)] + [("n100", "T-1", 500), ("n199", "T-2", 501)]
    got = graph.components_with_veto(spark.createDataFrame(links, "a string, b string, ord long"), TAG).collect()
    assert {r.node: r.root for r in got} == {**{f"n{i:03}": "T-1" for i in range(201)}, "T-1": "T-1", "T-2": "T-2"}
    assert rounds.count("open-links") < 10
    assert graph.components_with_veto(spark.createDataFrame([], "a string, b string, ord long"), TAG).count() == 0


def greedy(reference, produced):
    free = {k: set(v) for k, v in produced.items()}
    out = set()
    for r in sorted(reference):
        if r in free:
            out.add((r, r, "id"))
            del free[r]
    for r in sorted(set(reference) - {o[0] for o in out}):
        hit = next((p for p in sorted(free) if free[p] & set(reference[r])), None)
        if hit:
            out.add((r, hit, "alias"))
            del free[hit]
    return out


@pytest.mark.parametrize(("block", "hot"), [(10**6, False), (6, True)])
def test_greedy(spark, monkeypatch, block, hot):
    monkeypatch.setattr(coverage, "BLOCK_ROWS", block)
    rng = random.Random(block + hot)
    keys = lambda n: {f"k{rng.randrange(n)}" for _ in range(rng.randrange(4))}
    reference = {f"r{i:03}" if i % 9 else f"same{i}": keys(25) for i in range(60)}
    produced = {f"p{i:03}" if i % 9 else f"same{i}": keys(25) for i in range(60)}
    if hot:
        reference |= {f"h{i:03}": {"hot", "other name"} for i in range(70)}
        produced |= {f"q{i:03}": {"hot", "other name"} for i in range(50)}

    def frame(rows):
        return spark.createDataFrame([("part", i, sorted(k)) for i, k in rows.items()], "category string, id string, keys array<string>")

    got = coverage.greedy_pairs(frame(reference), frame(produced)).collect()
    assert {(r.reference, r.produced, r.by) for r in got} == greedy(reference, produced)
    assert len(got) == len(greedy(reference, produced))


def test_large_blocks_are_not_grouped(spark, monkeypatch):
    """A key that all rows hold is matched by rank; no group above the bound is made."""
    monkeypatch.setattr(coverage, "BLOCK_ROWS", 20)
    sizes = []
    real = coverage._walk
    monkeypatch.setattr(coverage, "_walk", lambda rows: (sizes.append(len(rows)), real(rows))[1])
    a = spark.createDataFrame([("c", f"r{i:04}", ["hot"]) for i in range(300)], "category string, id string, keys array<string>")
    b = spark.createDataFrame([("c", f"p{i:04}", ["hot"]) for i in range(250)], "category string, id string, keys array<string>")
    got = coverage.greedy_pairs(a, b).collect()
    assert {(r.reference, r.produced) for r in got} == {(f"r{i:04}", f"p{i:04}") for i in range(250)}


def placed(links, nodes):
    """Columns and rows of a layout, walked node by node."""
    after, fed = {}, {b for a, b in links if a != b}
    for a, b in links:
        if a != b:
            after.setdefault(a, set()).add(b)
    state, kept = {}, set()

    def visit(n):
        state[n] = 1
        for m in sorted(after.get(n, ())):
            if state.get(m) != 1:
                kept.add((n, m))
                if m not in state:
                    visit(m)
        state[n] = 2

    for n in sorted(nodes, key=lambda n: (n in fed, n)):
        if n not in state:
            visit(n)
    column = dict.fromkeys(nodes, 0)
    for _ in nodes:
        for a, b in kept:
            column[b] = max(column[b], column[a] + 1)
    row, out = {}, {}
    for c in range(max(column.values()) + 1):
        members = [n for n in nodes if column[n] == c]
        before = {n: [row[a] for a, b in kept if b == n] for n in members}
        for r, n in enumerate(sorted(members, key=lambda n: (sum(before[n]) / len(before[n]) if before[n] else 1e9, n))):
            row[n] = r
            out[n] = (c, r, c * 50, round(((len(members) - 1) / 2 - r) * 40))
    return out


@pytest.mark.parametrize("seed", [2])
def test_layout(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(25)]
    links = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(22 + 6 * seed)]
    df = spark.createDataFrame(links, "a string, b string")
    got = graph.layout(df, spark.createDataFrame([(n,) for n in nodes], "node string")).collect()
    assert {r.node: (r.column, r.row, r.x, r.y) for r in got} == placed(links, nodes)


def test_layout_follows_placed_rows(spark):
    links = [("a1", "b2"), ("a2", "b1"), ("b1", "c1"), ("b2", "c2")]
    got = graph.layout(spark.createDataFrame(links, "a string, b string"), spark.createDataFrame([(n,) for n in "a1 a2 b1 b2 c1 c2".split()], "node string"))
    assert {r.node: r.row for r in got.collect()} == {"a1": 0, "a2": 1, "b2": 0, "b1": 1, "c2": 0, "c1": 1}
    assert graph.layout(spark.createDataFrame([], "a string, b string"), spark.createDataFrame([], "node string")).count() == 0


def test_only_what_leads_to_loops_is_walked(spark):
    links = [(1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (6, 7), (7, 8)]
    assert {tuple(r) for r in graph.before_loops(spark.createDataFrame(links, "a long, b long")).select("a", "b").collect()} == {(1, 2), (2, 3), (3, 2)}


def test_numbered_within_keys(spark):
    rng = random.Random(1)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 7}", i, rng.choice([None, f"v{i}"]), i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, n long, v string, w long").repartition(9)
    got = {r.n: r for r in skew.running(skew.carried(skew.numbered(df, [F_desc("n")], "place", ["k"]), "v", ["n"], "last", ["k"]), "w", ["n"], "sum", ["k"]).collect()}
    assert len(got) == 400
    for k, n, _, _ in rows:
        mine = [r for r in rows if r[0] == k]
        assert got[n].place == sum(r[1] >= n for r in mine)
        held = [r[2] for r in mine if r[1] <= n and r[2] is not None]
        assert got[n]["last"] == (held[-1] if held else None)
        assert got[n]["sum"] == sum(r[3] for r in mine if r[1] <= n)
    assert skew.numbered(df.limit(0), ["n"], keys=["k"]).count() == 0


def F_desc(name):
    from pyspark.sql import functions as F

    return F.desc(name)


def test_gate_over_several_needs(spark):
    def frame(rows, shape):
        return spark.createDataFrame(rows, shape)

    model = Model(
        parts=frame([("p1", True, ["q1", "q2"]), ("p2", False, ["q3"]), ("p3", True, ["q4"])], "id string, traced boolean, ports array<string>"),
        connections=frame([("c1", True, "q1", "q4"), ("c2", True, "q1", "q3"), ("c3", False, "q3", "q1"), ("c4", True, "none", "q1")], "id string, traced boolean, from_port string, to_port string"),
        parameters=frame([("a1", True, "p1"), ("a2", True, "p2"), ("a3", True, "system"), ("a4", None, "p1")], "id string, traced boolean, owner string"),
        machines=frame(
            [("m1", True, "p1", ["q1", "a1"], ["t1"], ["s1"], True), ("m2", True, "p1", ["a2", "q1"], ["t2"], ["s2"], True), ("m3", True, "p2", [], [], [], True), ("m4", True, "p1", [], [], [], False), ("m5", False, "p2", [], [], [], False)],
            "id string, traced boolean, owner string, operands array<string>, timers array<string>, states array<string>, sound boolean",
        ),
        requirements=frame([("r1", True), ("r2", False)], "id string, traced boolean"),
        criteria=frame([("k1", True, ["a1", "s1"], True), ("k2", True, ["s2"], True), ("k3", False, None, True), ("k4", True, None, True), ("k5", True, ["a1"], False)], "id string, traced boolean, operands array<string>, sound boolean"),
        conflicts=frame([("f1", "a1"), ("f2", "a2")], "id string, subject string"),
        candidates=frame([("f1", "a1", 1), ("f1", "a4", 2), ("f1", None, 3), ("f2", "a1", 4)], "conflict string, element string, n int"),
        lists=frame([("r1", "satisfied_by", "p1"), ("r1", "satisfied_by", "m2"), ("u1", "affects", "c2"), ("u1", "affects", "k1")], "record string, what string, element string"),
    )
    got = dependency.gate(model)
    none, broken, end = dependency.UNTRACED, dependency.BROKEN, "an end belonged to a removed part"
    assert {(r.kind, r.id, r.reason) for r in got.rejected.collect()} == {
        ("part", "p2", none), ("connection", "c2", end), ("connection", "c3", none), ("connection", "c4", end), ("parameter", "a2", "its owner 'p2' was removed"), ("parameter", "a4", none), ("state machine", "m2", broken),
        ("state machine", "m3", broken), ("state machine", "m4", broken), ("state machine", "m5", none), ("requirement", "r2", none), ("acceptance criterion", "k3", "no trace"), ("conflict", "f2", "its subject 'a2' was removed"),
    }
    assert {(r.kind, r.id) for r in got.kept.collect()} == {("part", "p1"), ("part", "p3"), ("connection", "c1"), ("parameter", "a1"), ("parameter", "a3"), ("state machine", "m1"), ("requirement", "r1"), *(("acceptance criterion", f"k{i}") for i in (1, 2, 4, 5))}
    assert {(r.id, r.reason) for r in got.checks.collect()} == {("k1", None), ("k2", dependency.CLEARED), ("k4", None), ("k5", dependency.CLEARED)}
    assert {tuple(r) for r in got.lists.collect()} == {("r1", "satisfied_by", "p1"), ("u1", "affects", "k1")}
    assert {tuple(r) for r in got.conflicts.collect()} == {("f1", "a1")}
    assert {tuple(r) for r in got.candidates.collect()} == {("f1", "a1", 1), ("f1", None, 2), ("f1", None, 3)}


def test_removals_on_random_graphs(spark):
    rng = random.Random(4)
    elements = [(f"e{i}", "own" if rng.random() < 0.06 else None) for i in range(150)]
    needs = [(f"e{rng.randrange(150)}", None if rng.random() < 0.05 else f"e{rng.randrange(152)}", n, f"why {n}") for n in range(170)]
    gone = {i for i, r in elements if r} | {"e150", "e151"}
    while more := {i for i, n, *_ in needs if n in gone} - gone:
        gone |= more
    want = {i: r or min((o, w) for j, n, o, w in needs if j == i and n in gone)[1] for i, r in elements if i in gone}
    got = dependency.removals(spark.createDataFrame(elements, "id string, reason string"), spark.createDataFrame(needs, "id string, needed string, ord int, reason string"))
    assert {r.id: r.reason for r in got.collect()} == want


def test_needs_of_what_surely_stays_are_not_carried(spark, monkeypatch):
    """Rounds carry only needs that something removed, or something with needs of its own, can leave unmet."""
    from proofline.operators import dependency

    written = []

    def record(df, what):
        written.append((what, df.count()))
        return storage_materialise(df, what)

    storage_materialise = dependency.materialise
    monkeypatch.setattr(dependency, "materialise", record)
    elements = spark.createDataFrame([("top", None), ("bad", "r"), ("y", None), *((f"e{n}", None) for n in range(50))], "id string, reason string")
    needs = spark.createDataFrame([("y", "bad", 0, "a"), *((f"e{n}", "top", 0, "b") for n in range(50)), ("e7", "y", 1, "c")], "id string, needed string, ord int, reason string")
    got = dependency.removals(elements, needs)
    assert {tuple(r) for r in got.collect()} == {("bad", "r"), ("y", "a"), ("e7", "c")}
    assert [n for what, n in written if what == "needs"][-1] == 2  # y's and e7's of 52


def gated(m):
    """The gate's results by plain sets; m holds lists of rows, all ids differ."""
    none, broken = dependency.UNTRACED, dependency.BROKEN
    inside = [(q, p) for p, _, ports in m["parts"] for q in ports] + [(x, i) for i, _, _, _, timers, states, _ in m["machines"] for x in timers + states]
    reason = {i: None for i, _ in inside} | {i: None if t else none for rows in ("parts", "connections", "parameters", "requirements") for i, t, *_ in m[rows]}
    reason |= {i: None if t else "no trace" for i, t, *_ in m["criteria"]} | {i: none if not t else None if sound else broken for i, t, *_, sound in m["machines"]}
    needs = [(i, n, 0, "inside a removed element") for i, n in inside] + [(i, n, k, "an end belonged to a removed part") for i, _, *ends in m["connections"] for k, n in enumerate(ends)]
    needs += [(i, n, 0, f"its owner '{n}' was removed") for i, _, n in m["parameters"] if n != "system"] + [(i, n, k, broken) for i, _, owner, ops, *_ in m["machines"] for k, n in [(0, owner), *((1, o) for o in ops)]]
    needs = [n for n in needs if reason[n[0]] is None]
    gone = {i for i, r in reason.items() if r}
    while more := {i for i, n, *_ in needs if n in gone or n not in reason} - gone:
        gone |= more
    kinds = {"part": "parts", "connection": "connections", "parameter": "parameters", "state machine": "machines", "requirement": "requirements", "acceptance criterion": "criteria"}
    kind = {i: k for k, rows in kinds.items() for i, *_ in m[rows]}
    left = set(reason) - gone
    why = {i: reason[i] or min((o, w) for j, n, o, w in needs if j == i and (n in gone or n not in reason))[1] for i in gone}
    subjects = {f for f, s in m["conflicts"] if s in left}
    return {
        "rejected": {(kind[i], i, why[i]) for i in gone if i in kind} | {("conflict", f, f"its subject '{s}' was removed") for f, s in m["conflicts"] if s not in left},
        "kept": {(kind[i], i) for i in left if i in kind},
        "checks": {(i, dependency.CLEARED if ops is not None and (not sound or set(ops) - left) else None) for i, _, ops, sound in m["criteria"] if i in left},
        "lists": {r for r in m["lists"] if r[2] in left},
        "conflicts": {r for r in m["conflicts"] if r[1] in left},
        "candidates": {(f, e if e in left else None, n) for f, e, n in m["candidates"] if f in subjects},
    }


@pytest.mark.parametrize(("beginnings", "wild"), [(5_000, False), (5_000, True), (0, True)])
def test_gate_on_random_models(spark, monkeypatch, beginnings, wild):
    """Elements that nothing needs stay out of the rounds; where anything may need anything, the results are the same."""
    rng, written, write = random.Random(7), {}, dependency.materialise
    monkeypatch.setattr(dependency, "BEGINNINGS", beginnings, raising=False)
    monkeypatch.setattr(dependency, "KEPT_ROWS", 12, raising=False)

    def record(df, what, *codec):
        written[what] = df.count()
        return write(df, what, *codec)

    monkeypatch.setattr(dependency, "materialise", record)

    def sure(p=0.85):
        return rng.random() < p

    ports, fixed, machines = [f"q{i}" for i in range(20)], [f"a{i}" for i in range(12)], [f"m{i}" for i in range(60)]
    anything = [*ports, *fixed, "zz", *(machines + [f"s{i}" for i in range(60)] + [f"t{i}" for i in range(20)] if wild else [])]
    m = {
        "parts": [(f"p{i}", sure(), ports[4 * i : 4 * i + 4]) for i in range(5)],
        "connections": [(f"c{i}", sure(), rng.choice(anything), rng.choice(anything if wild else ports)) for i in range(20)],
        "parameters": [(a, sure(), rng.choice(["p0", "p1", "p2", "p3", "p4", "system"])) for a in fixed],
        "machines": [(x, sure(), f"p{rng.randrange(5)}", rng.sample(anything, rng.randrange(3)), [f"t{i}"] if i < 20 else [], [f"s{i}"], sure(0.9)) for i, x in enumerate(machines)],
        "requirements": [(f"r{i}", sure()) for i in range(3)],
        "criteria": [(f"k{i}", sure(), rng.choice([None, rng.sample(anything, 2)]), sure()) for i in range(20)],
        "conflicts": [(f"f{i}", rng.choice([*anything, *machines])) for i in range(8)],
        "candidates": [(f"f{rng.randrange(8)}", rng.choice([*anything, None]), n) for n in range(25)],
        "lists": [(f"r{rng.randrange(3)}", "affects", rng.choice([*anything, *machines, "k1"])) for _ in range(30)],
    }
    shapes = {
        "parts": "ports array<string>", "connections": "from_port string, to_port string", "parameters": "owner string", "machines": "owner string, operands array<string>, timers array<string>, states array<string>, sound boolean",
        "requirements": "", "criteria": "operands array<string>, sound boolean", "conflicts": "subject string", "candidates": "element string, n int", "lists": "what string, element string",
    }
    first = {"conflicts": "id string", "candidates": "conflict string", "lists": "record string"}
    got = dependency.gate(Model(**{k: spark.createDataFrame(rows, ", ".join(filter(None, [first.get(k, "id string, traced boolean"), shapes[k]]))) for k, rows in m.items()}))
    want = gated(m)
    assert {name: {tuple(r) for r in getattr(got, name).collect()} for name in want} == want
    assert wild or written["elements"] <= 20 + 12 + 5  # ports, parameters and parts, of 120 and the states
