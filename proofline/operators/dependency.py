"""The honesty gate over a whole model: what has no evidence goes, and with it whatever needs it, to a fixpoint.

Elements and their needs are two tables, so an element may need any number of others, of any kind, and chains may be of
any depth. All ids are in one namespace, as the model's are.

Most elements are needed by nothing. By the beginnings of ids, of which there are few, the gate tells those that something
may need (the core) from the leaves: only the core goes through rounds, a leaf's needs are looked up once in what the rounds left.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.storage import materialise

# The wording of the reasons, here and in `gate`.
UNTRACED = "no trace and no assumption"
BROKEN = "it refers to a removed element"
CLEARED = "its check referred to a removed element"

BROADCAST_ROWS = 20_000
KEPT_ROWS = 400_000  # so many ids of the core that stay are broadcast to the needs of leaves
BEGINNING, BEGINNINGS = 2, 5_000  # characters of an id that tell where it may be found; beyond so many beginnings all is core


def removals(elements: DataFrame, needs: DataFrame) -> DataFrame:
    """(id, reason) of the elements that go. elements(id, reason: null unless it goes by itself), needs(id, needed, ord, reason).

    A round follows the needs of what the last round removed; the first also those of what no element is. When nothing more
    goes, each element has its own reason, or that of its first need (by ord) that is not met. Cycles of needs stay, as long
    as nothing in them goes. A null `needed` is a need of nothing.
    """
    return _removals(materialise(elements.select("id", "reason"), "elements"), needs)


def _removals(elements: DataFrame, needs: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """`removals` of written elements, with all their columns. roots(id): elements that likely need nothing, so few that they may be broadcast."""
    needs = needs.where("needed is not null").select("id", "needed", "ord", "reason")
    own = elements.where("reason is not null").select("id")
    if roots is not None and roots.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        moving = needs.select("id").union(own).join(F.broadcast(roots), "id", "left_semi").distinct()
        stays = materialise(roots.join(F.broadcast(moving), "id", "left_anti"), "stays")
        needs = needs.join(F.broadcast(stays.select(F.col("id").alias("needed"))), "needed", "left_anti")
    needs = materialise(needs.select("id", "needed", "ord", "reason"), "needs")
    asked = materialise(needs.select(F.col("needed").alias("id")).distinct(), "needed")
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def within(ids: DataFrame) -> DataFrame:
        """Of ids, those that something needs; so few may be broadcast."""
        return F.broadcast(ids.join(F.broadcast(asked), "id", "left_semi").distinct()) if few else ids

    front = materialise(own.union(asked.join(within(elements.select("id")), "id", "left_anti")).distinct(), "removed")
    moving = within(needs.select("id").union(front)).select(F.col("id").alias("needed"))
    needs = materialise(needs.join(moving if few else moving.distinct(), "needed", "left_semi").select("id", "needed", "ord", "reason"), "needs")  # what else is needed surely stays
    gone, hits = [front], []
    while not front.isEmpty():
        hit = materialise(needs.join(within(front).select(F.col("id").alias("needed")), "needed").groupBy("id").agg(F.min(F.struct("ord", "reason")).alias("first")), "hits")
        hits.append(hit)
        front = materialise(reduce(lambda d, g: d.join(g, "id", "left_anti"), gone, hit.select("id")), "removed")
        gone.append(front)
    if not hits:
        return elements.where("false")
    none = F.lit(None).cast(hits[0].schema["first"].dataType).alias("first")
    marks = reduce(DataFrame.union, [*hits, *(g.select("id", none) for g in gone)]).groupBy("id").agg(F.min("first").alias("first"))
    return elements.join(marks, "id").withColumn("reason", F.coalesce("reason", "first.reason")).select(*elements.columns)


@dataclass
class Model:
    """Tables of a model; every element has id and traced (it has a trace or an assumption).

    parts(ports: array of ids), connections(from_port, to_port), parameters(owner), machines(owner, operands, timers, states,
    sound), requirements, criteria(operands, sound; null operands: no check), conflicts(id, subject), candidates(conflict,
    element), lists(record, what, element): what requirements are satisfied by and what assumptions and questions affect.
    operands are the names in guards, durations or a check; sound is false where an expression cannot be parsed or calls a
    timer or state that the machine does not have.
    """

    parts: DataFrame
    connections: DataFrame
    parameters: DataFrame
    machines: DataFrame
    requirements: DataFrame
    criteria: DataFrame
    conflicts: DataFrame
    candidates: DataFrame
    lists: DataFrame
    system: str = "system"


INSIDE = ("port", "timer", "state")


def _begins(ids: Column) -> Column:
    return F.coalesce(F.substring(ids, 1, BEGINNING), F.lit(""))


def _beginnings(columns: dict[str, DataFrame]) -> dict[str, set[str]] | None:
    """The beginnings of the ids in each of the tables of one column; None if there are too many."""
    each = [d.toDF("id").select(F.lit(name).alias("of"), _begins(F.col("id")).alias("begins")).distinct() for name, d in columns.items()]
    rows = reduce(DataFrame.union, each).distinct().limit(BEGINNINGS + 1).collect()
    if len(rows) > BEGINNINGS:
        return None
    found: dict[str, set[str]] = {name: set() for name in columns}
    for r in rows:
        found[r.of].add(r.begins)
    return found


@dataclass
class Need:
    """Needs of elements of a kind: rows(id, needed)."""

    kind: str
    rows: DataFrame
    ord: int
    reason: Column


class Gated:
    """What is left: kept(kind, id), rejected(kind, id, reason), criteria as checks(id, reason: why its check went), lists, conflicts,
    candidates. Each is planned when it is asked for, and looks only where the ids that it asks for may be."""

    def __init__(self, model: Model):
        self.model = model = replace(model, machines=materialise(model.machines, "machines", "zstd"))
        self.kinds = {"part": model.parts, "connection": model.connections, "parameter": model.parameters, "state machine": model.machines, "requirement": model.requirements, "acceptance criterion": model.criteria}
        self.inside = {k: d.select(F.explode(c).alias("id"), F.col("id").alias("needed")) for k, d, c in (("port", model.parts, "ports"), ("timer", model.machines, "timers"), ("state", model.machines, "states"))}
        holder = {"port": "part", "timer": "state machine", "state": "state machine"}

        def need(kind: str, needed: Column, ord_: int, reason: Column) -> Need:
            rows = self.kinds[kind].where(self.own(kind).isNull())  # what goes by itself keeps that reason
            return Need(kind, rows.select("id", needed.alias("needed")), ord_, reason)

        end = F.lit("an end belonged to a removed part")
        owner = F.when(F.col("owner") != model.system, F.col("owner"))
        self.needs = [
            need("connection", F.col("from_port"), 0, end),
            need("connection", F.col("to_port"), 1, end),
            need("parameter", owner, 0, F.concat(F.lit("its owner '"), "needed", F.lit("' was removed"))),
            need("state machine", F.col("owner"), 0, F.lit(BROKEN)),
            need("state machine", F.explode("operands"), 1, F.lit(BROKEN)),
        ]
        columns = {k: d.select("id") for k, d in (self.kinds | self.inside).items()}
        columns |= {f"need {i}": n.rows.select("needed").where("needed is not null") for i, n in enumerate(self.needs)}
        columns |= {"operands": model.criteria.select(F.explode("operands")), "candidates": model.candidates.select("element"), "lists": model.lists.select("element"), "conflicts": model.conflicts.select("subject")}
        self.begins = _beginnings(columns)
        # A port, timer or state that nothing refers to, and whose id no other element has, is in no result.
        asked = None if self.begins is None else set().union(*(b for name, b in self.begins.items() if name not in self.inside))
        self.core = None if self.begins is None else set().union(*(self.begins[f"need {i}"] for i in range(len(self.needs))))
        for kind in self.inside:
            if asked is not None:
                self.begins[kind] &= asked
                self.inside[kind] = self.inside[kind].where(self.among(asked)) if self.begins[kind] else self.inside[kind].where("false")
                self.core |= self.begins[holder[kind]] if self.begins[kind] else set()
            self.needs.append(Need(kind, self.inside[kind], 0, F.lit("inside a removed element")))
        elements = materialise(self.elements(self.core), "elements")
        self.core_gone = materialise(_removals(elements, self.needed(self.core), model.parts.select("id")), "rejected")
        self.core_left = materialise(elements.join(self.core_gone.select("id").distinct(), "id", "left_anti").select("kind", "id"), "kept")
        self.near = set() if self.begins is None else self._few()

    def _few(self) -> set[str]:
        """Beginnings of so few ids of the core that stay that all of these may be broadcast."""
        near, total = set(), 0
        for r in sorted(self.core_left.groupBy(_begins(F.col("id")).alias("begins")).agg(F.count("*").alias("n")).collect(), key=lambda r: (r.n, r.begins)):
            total += r.n
            if total > KEPT_ROWS:
                break
            near.add(r.begins)
        return near

    @staticmethod
    def own(kind: str) -> Column:
        traced = F.coalesce("traced", F.lit(False))
        if kind == "state machine":
            return F.when(~traced, UNTRACED).when(~F.coalesce("sound", F.lit(False)), BROKEN)
        return F.when(~traced, "no trace" if kind == "acceptance criterion" else UNTRACED)

    @staticmethod
    def among(begins: set[str] | None, column: str = "id") -> Column:
        return F.lit(True) if begins is None else _begins(F.col(column)).isin(sorted(begins))

    def held_by(self, kind: str, begins: set[str] | None) -> bool:
        return begins is None or bool(self.begins[kind] & begins)

    def elements(self, begins: set[str] | None) -> DataFrame:
        """(id, reason, kind) of the elements whose ids begin so, from the kinds that have such."""
        told = [d.select("id", self.own(k).alias("reason"), F.lit(k).alias("kind")) for k, d in self.kinds.items() if self.held_by(k, begins)]
        told += [d.select("id", F.lit(None).cast("string").alias("reason"), F.lit(k).alias("kind")) for k, d in self.inside.items() if self.held_by(k, begins)]
        every = told or [self.model.parts.select("id", F.lit(None).cast("string").alias("reason"), F.lit("part").alias("kind")).where("false")]
        return reduce(DataFrame.union, every).where(self.among(begins))

    def rule(self, column: str) -> Column:
        """ord or reason of a need by its number, `rule`."""
        found = F.when(F.lit(False), F.lit(None))
        for i, n in enumerate(self.needs):
            found = found.when(F.col("rule") == i, F.lit(n.ord) if column == "ord" else n.reason)
        return found.alias(column)

    def numbered(self, begins: set[str] | None) -> DataFrame:
        """(id, needed, rule): what the elements whose ids begin so need."""
        found = [n.rows.select("id", "needed", F.lit(i).alias("rule")) for i, n in enumerate(self.needs) if self.held_by(n.kind, begins)]
        every = found or [self.model.parts.select("id", F.col("id").alias("needed"), F.lit(0).alias("rule")).where("false")]
        return reduce(DataFrame.union, every).where(self.among(begins)).where("needed is not null")

    def needed(self, begins: set[str] | None) -> DataFrame:
        return self.numbered(begins).select("id", "needed", self.rule("ord"), self.rule("reason"))

    def leaves(self, begins: set[str] | None) -> tuple[DataFrame, DataFrame] | None:
        """The elements that nothing needs of those whose ids begin so, as (id, reason, kind), and marks(id, first) of what goes of them."""
        at = set() if self.begins is None else set().union(*(self.begins[k] for k in (*self.kinds, *self.inside))) - self.core
        at = at if begins is None else at & begins
        if not at:
            return None
        elements, needs, left = self.elements(at), self.numbered(at), self.core_left.select(F.col("id").alias("needed"))
        near = F.broadcast(left.where(self.among(self.near, "needed")))
        unmet = needs.where(self.among(self.near, "needed")).join(near, "needed", "left_anti")
        far = ~self.among(self.near, "needed")
        unmet = unmet.unionByName(needs.where(far).join(left.where(far), "needed", "left_anti"))
        first = unmet.select("id", F.struct(self.rule("ord"), self.rule("reason")).alias("first"))
        own = elements.where("reason is not null").select("id", F.lit(None).cast(first.schema["first"].dataType).alias("first"))
        return elements, first.union(own).groupBy("id").agg(F.min("first").alias("first"))

    def left(self, begins: set[str] | None) -> DataFrame:
        """(kind, id) of the elements that stay of those whose ids begin so."""
        core = self.core_left.where(self.among(begins))
        if (found := self.leaves(begins)) is None:
            return core
        elements, marks = found
        return core.unionByName(elements.where("reason is null or id is null").join(marks, "id", "left_anti").select("kind", "id"))

    def ids(self, asked: str, name: str) -> DataFrame:
        """The ids that stay among those that `asked` may name, as a column of that name."""
        return self.left(None if self.begins is None else self.begins[asked]).select(F.col("id").alias(name))

    @cached_property
    def kept(self) -> DataFrame:
        return self.left(None).where(~F.col("kind").isin(*INSIDE))

    @cached_property
    def rejected(self) -> DataFrame:
        gone = self.core_gone.select("kind", "id", "reason")
        if (found := self.leaves(None)) is not None:
            elements, marks = found
            gone = gone.unionByName(elements.where("reason is not null and id is not null").select("kind", "id", "reason"))
            gone = gone.unionByName(elements.where("reason is null").join(marks, "id").select("kind", "id", F.col("first.reason").alias("reason")))
        lost = self.model.conflicts.join(self.ids("conflicts", "subject"), "subject", "left_anti")
        return gone.where(~F.col("kind").isin(*INSIDE)).union(lost.select(F.lit("conflict"), "id", F.concat(F.lit("its subject '"), "subject", F.lit("' was removed"))))

    @cached_property
    def checks(self) -> DataFrame:
        checks = self.model.criteria.join(self.ids("acceptance criterion", "id"), "id", "left_semi")
        unmet = checks.select("id", F.explode("operands").alias("operand")).join(self.ids("operands", "operand"), "operand", "left_anti").select("id", F.lit(True).alias("unmet")).distinct()
        cleared = F.when(F.col("operands").isNotNull() & (F.coalesce("unmet", F.lit(False)) | ~F.coalesce("sound", F.lit(False))), CLEARED)
        return checks.join(unmet, "id", "left").select("id", cleared.alias("reason"))

    @cached_property
    def lists(self) -> DataFrame:
        return self.model.lists.join(self.ids("lists", "element"), "element", "left_semi").select(*self.model.lists.columns)

    @cached_property
    def conflicts(self) -> DataFrame:
        return self.model.conflicts.join(self.ids("conflicts", "subject"), "subject", "left_semi").select(*self.model.conflicts.columns)

    @cached_property
    def candidates(self) -> DataFrame:
        known = self.ids("candidates", "element").distinct().withColumn("known", F.lit(True))
        rows = self.model.candidates.join(self.conflicts.select(F.col("id").alias("conflict")), "conflict", "left_semi").join(known, "element", "left")
        return rows.withColumn("element", F.when(F.col("known"), F.col("element"))).select(*self.model.candidates.columns)


def gate(model: Model) -> Gated:
    """The honesty gate. A connection goes with either end, a parameter with its owner, a machine with its owner or any operand;
    a criterion stays, but its check goes with any operand; records lose what went, conflicts go with their subject."""
    return Gated(model)
