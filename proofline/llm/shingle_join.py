"""Operator 10: Jaccard self-join on 5-word shingles by parity sketches.

Method. A document's shingles are hashed to 64 bits. Documents with equal sets form a class (sets are told apart by 128
bits of hashes); from then on each class counts once. In a size band (sizes from 2**t) the shingles are dealt to m_t parts by their hash, and each part's hashes
are XORed to one word: the words are a parity sketch. A shingle that only one of two sets has changes one word at most,
so the number of words that differ (their Hamming distance) is a lower bound of the symmetric difference D. Two sets of
sizes a <= b have Jaccard similarity of at least 4/5 exactly if D <= (a + b) / 9, so all but h = (a + b) / 9 words agree.

Pigeonhole. The words that only one class has are found by counting words over the corpus. A class with more than h of
those has no partner. The others keep the h + 1 rarest of their words (with rarity as the common order, two partners
have one of those in common); words of one class alone then drop out. A class that has h words or fewer, so that the
argument fails, also takes part with its shingles in place of words, against others like it.

Verification. Classes that share a kept word make families. In a family of more than `block` classes a few members are
pivots first: every member is compared with them, and what a pivot links is connected, so the core of a family of copies
costs one comparison a member. From then on only members that are not connected yet meet. They are compared block by block:
a member goes to the blocks of the others of its family, the large connected core only to those of the rest. Within a pair of
blocks sizes, then the Hamming distance of bit sketches, then the sets themselves are compared, and only pairs that are not
connected. Each pair of blocks gives a spanning forest of its links, so no pair list is ever built.

Defined cases: null and empty texts have an empty set and link with nothing; a text of one to four words is one shingle;
repeated rows have equal sets and link; a null doc_id takes part, and a component's id is the smallest id that is not
null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm._common import Out, buckets, materialise, rows_of, sized, with_own_columns
from proofline.llm.bpe import expand, squeeze
from proofline.llm.textstats import SLICE_CHARS, Numbers
from proofline.operators.graph import components
from proofline.operators.skew import join_one

WORDS_A_SHINGLE = 5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BROADCAST_ROWS = 500_000  # of 24 bytes
BROADCAST_BYTES = 48 << 20
PIVOTS = 4
BUCKET_SHINGLES = 2_000_000  # words of so many shingles meet in one bucket
DEALT = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
SHARED = pa.schema([("cls", pa.int64()), ("scheme", pa.int32()), ("need", pa.int32()), ("total", pa.int32()), ("word", pa.int64()), ("classes", pa.int32())])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int = WORDS_A_SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    numbers, parts = Numbers(), []
    get = numbers.__getitem__
    for text in texts:
        own = (text or "").encode("utf-8", "surrogatepass").lower().split()
        parts.append(np.fromiter(map(get, own), np.int64, len(own)))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))
    out = []
    for ids in parts:
        if not len(ids):
            out.append(np.zeros(0, np.uint64))
            continue
        h, n = hashes[ids], min(width, len(ids))
        s = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            s = s * MULTIPLIER + h[i : len(h) - n + 1 + i]
        out.append(np.unique(mix(s + np.uint64(n))))
    return out


def key_of(shingles: np.ndarray, seed: int = 0, bits: int = 64) -> int:
    """A signed hash of a set."""
    return (xxhash.xxh3_64_intdigest(shingles.tobytes(), seed) >> (64 - bits)) - (1 << 63)


def class_of(shingles: np.ndarray, shared: frozenset[int] = frozenset(), bits: int = 64) -> int:
    """The 64-bit key of a set's class: its hash or, where different sets share that hash, one of that and a second hash."""
    first = key_of(shingles, bits=bits)
    return first if first not in shared else xxhash.xxh3_64_intdigest(b"%d %d" % (first, key_of(shingles, 1))) - (1 << 63)


def sketches(shingles: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(scheme, words needed, words) of a set: in its own band, and in the band below if a partner can lie there.

    Scheme t has the parity words of band t; scheme 1000 + t the shingles themselves, for sets whose words are too few.
    """
    a = len(shingles)
    out = []
    top = a.bit_length() - 1
    for t in (top, top - 1):
        if t < 0 or t < top and a * 4 > 5 * ((1 << top) - 1):
            continue
        h = (a + a * 5 // 4) // 9 if t == top else 2 * a // 9
        if h == 0:
            continue  # partners would be equal sets, which are one class
        m = np.uint64(max(1, round(0.7 * (1 << t))))
        part = shingles % m
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.diff(part[order], prepend=np.uint64(m)))
        words = mix(np.bitwise_xor.reduceat(shingles[order], cut) + part[order][cut] * MULTIPLIER + np.uint64(t + 1))
        out.append((t, h + 1, words))
        if len(words) <= h:
            out.append((1000 + t, h + 1, mix(shingles ^ np.uint64(t + 77))))
    return out


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= 80 * (len(x) + len(y) - common)


def links_of(ids: list[int], sets: list[np.ndarray], left: list[int], right: list[int] | None, groups: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of members, or within one; members of a group count as connected."""
    sizes = np.array([len(s) for s in sets])
    bits = np.stack([np.packbits((np.bincount((s & np.uint64(2047)).astype(np.int64), minlength=2048) & 1).astype(np.uint8)).view(np.uint64) for s in sets])
    head: dict[int, int] = {}
    parent = [head.setdefault(g, n) for n, g in enumerate(groups)]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for n, i in enumerate(left):
        others = np.array(left[n + 1 :] if right is None else right, int)
        if not len(others):
            continue
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[5 * small >= 4 * large]
        apart = np.bitwise_count(bits[others] ^ bits[i]).sum(1)
        for j in others[apart <= (sizes[others] + sizes[i]) // 9].tolist():
            a, b = root(i), root(j)
            if a != b and similar(sets[i], sets[j]):
                parent[a] = b
                found.append((ids[i], ids[j]))
    return found


def classes(docs: DataFrame, bits: int = 64) -> tuple[DataFrame, frozenset[int]]:
    """`docs(doc_id, text)` with th (the text's hash), n_shingles and cls (null for an empty set), written and read back; and the
    hashes that different sets share.

    Two hashes tell sets apart as one of 128 bits does. Few hashes are shared at any size: about n^2 / 2^65 of n sets, one
    in 6 billion documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sized(rows_of(batches, "doc_id", "th", "text"), lambda r: len(r[2] or ""), SLICE_CHARS):
            sets = shingle_sets([r[2] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([key_of(s, *how) if len(s) else None for s in sets], pa.int64()) for how in ((0, bits), (1,)))], names=["doc_id", "th", "n_shingles", "cls", "second"]
            )

    every = materialise(docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n_shingles long, cls long, second long"), "classes")
    apart = every.groupBy("cls").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a <> b")
    shared = frozenset(r.cls for r in apart.select("cls").collect())
    if shared:  # as class_of has them
        both = F.udf(lambda a, b: None if a is None else xxhash.xxh3_64_intdigest(b"%d %d" % (a, b)) - (1 << 63), "long")
        every = every.withColumn("cls", F.when(F.col("cls").isin(*shared), both("cls", "second")).otherwise(F.col("cls")))
    return every.drop("second"), shared


def candidates(docs: DataFrame, parts: int, key) -> DataFrame:
    """(cls, word) of the kept words that several classes share."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sized(rows_of(batches, "text"), lambda r: len(r[0] or ""), 4 * SLICE_CHARS):
            entities, words, of, seen = [], [], [], set()
            for s in shingle_sets([r[0] for r in rows]):
                cls = key(s)
                if len(s) and cls not in seen:
                    seen.add(cls)
                    for scheme, need, w in sketches(s):
                        of.append(np.full(len(w), len(entities), np.uint32))
                        entities.append((cls, scheme, need, len(w)))
                        words.append(w)
            if not words:
                continue
            w, o, e = np.concatenate(words), np.concatenate(of), np.array(entities, np.int64)
            bucket = (w >> np.uint64(40)) % np.uint64(parts)
            order = np.argsort(bucket, kind="stable")
            cut = np.append(np.searchsorted(bucket[order], np.arange(parts)), len(order))
            out = Out(DEALT)
            for b in range(parts):
                at = order[cut[b] : cut[b + 1]]
                if len(at):
                    used, index = np.unique(o[at], return_inverse=True)
                    out.add(b, squeeze(np.array([len(used), len(at)], "<i8").tobytes() + e[used].T.astype("<i8").tobytes() + w[at].tobytes() + index.astype("<u4").tobytes()))
            yield from out.ready(force=True)

    def shared(table: pa.Table) -> pa.Table:
        entities, words, of, at = [], [], [], 0
        for packed in table.column("packed"):
            data = expand(packed.as_py())
            n, k = np.frombuffer(data, "<i8", 2).tolist()
            entities.append(np.frombuffer(data, "<i8", 4 * n, 16).reshape(4, n))
            words.append(np.frombuffer(data, "<u8", k, 16 + 32 * n))
            of.append(np.frombuffer(data, "<u4", k, 16 + 32 * n + 8 * k) + np.uint32(at))
            at += n
        e, w, o = np.concatenate(entities, 1), np.concatenate(words), np.concatenate(of)
        order = np.argsort(w, kind="stable")
        same = w[order[1:]] == w[order[:-1]]
        twice = np.zeros(len(w), bool)
        twice[1:] |= same
        twice[:-1] |= same
        order = order[twice]  # of words with two rows at least
        w, o = w[order], o[order]
        cls = e[0, o]
        once = np.lexsort((cls, w))
        w, o, cls = w[once], o[once], cls[once]
        first = np.ones(len(w), bool)
        first[1:] = (w[1:] != w[:-1]) | (cls[1:] != cls[:-1])
        w, o, cls = w[first], o[first], cls[first]
        start = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, int)
        count = np.diff(np.append(start, len(w)))
        many = np.repeat(count, count)
        keep = many > 1
        return pa.table([pa.array(x) for x in (cls[keep], e[1, o][keep].astype(np.int32), e[2, o][keep].astype(np.int32), e[3, o][keep].astype(np.int32), w[keep].view(np.int64), many[keep].astype(np.int32))], schema=SHARED)

    rows = docs.select("text").mapInArrow(deal, "bucket int, packed binary").groupBy("bucket").applyInArrow(shared, "cls long, scheme int, need int, total int, word long, classes int")
    each = rows.groupBy("cls", "scheme").agg(F.first("need").alias("need"), F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("classes", "word"))).alias("words"))
    room = F.col("need") - (F.col("total") - F.size("words"))  # kept words beside those of this class alone
    return each.where(room > 0).select("cls", F.explode(F.slice("words", F.lit(1), room)).alias("w")).select("cls", F.col("w.word").alias("word")).distinct()


def hubs(links: DataFrame) -> DataFrame:
    """Links that connect what `links(a, b)` connect: each a to the smallest of its b, its hub, and each of its other b to that hub.

    Many a share their b and so those links among b: n members with k common b give about n + k links, not n * k.
    """
    each = links.groupBy("a").agg(F.min("b").alias("hub"), F.collect_set("b").alias("others"))
    own = F.struct("a", F.col("hub").alias("b"))
    rest = F.transform(F.filter("others", lambda b: b != F.col("hub")), lambda b: F.struct(b.alias("a"), F.col("hub").alias("b")))
    return each.select(F.inline(F.concat(F.array(own), rest))).distinct()


def _links(members: DataFrame, block: int) -> DataFrame:
    """Links (a, b) between the sets of members(root, cls, packed, members): enough of them to connect what is connected.

    members counts a root's classes. Families of one block are compared as they are.
    """
    sized_ = members.withColumn("large", F.col("members") > block)
    large = sized_.where("large")
    if large.isEmpty():
        return _blocks(sized_.withColumns({"core": F.lit(False), "group": F.col("cls"), "own": F.lit(0), "others": F.lit(1)}), block)
    first = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("cls"), "cls"))
    chosen = large.select("root", "cls").withColumn("place", first).where(F.col("place") <= PIVOTS).select("cls")
    pivots = materialise(large.join(chosen, "cls").select("root", F.col("cls").alias("pivot"), F.col("packed").alias("pivot_set")), "pivots")
    bytes_ = pivots.agg(F.sum(F.length("pivot_set"))).first()[0] or 0

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(LINK)
        for cls, packed, pivot, pivot_set in rows_of(batches, "cls", "packed", "pivot", "pivot_set"):
            if cls != pivot and similar(np.frombuffer(expand(packed), np.uint64), np.frombuffer(expand(pivot_set), np.uint64)):
                out.add(cls, pivot)
            yield from out.ready()
        yield from out.ready(force=True)

    star = large.join(F.broadcast(pivots) if bytes_ <= BROADCAST_BYTES else pivots, "root").select("cls", "packed", "pivot", "pivot_set").mapInArrow(near, "a long, b long")
    star = materialise(star, "star-links")
    core = components(hubs(star))
    grouped = large.join(core.select(F.col("node").alias("cls"), F.col("root").alias("group")), "cls", "left").withColumn("group", F.coalesce("group", "cls"))
    grouped = materialise(grouped, "family-groups")
    sizes = grouped.groupBy("root", "group").agg(F.count("*").alias("n"))
    per = sizes.groupBy("root").agg(F.max_by("group", "n").alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most"))
    per = per.where(F.col("all") > F.col("most")).select("root", F.col("largest"), F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("others"))
    rest = join_one(grouped, per, "root", "inner").withColumn("core", F.col("group") == F.col("largest")).drop("largest")
    rest = rest.withColumn("own", F.when(F.col("core"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("cls"), F.col("others")).cast("int")))
    little = sized_.where("not large").withColumns({"core": F.lit(False), "group": F.col("cls"), "own": F.lit(0), "others": F.lit(1)})
    return core.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_blocks(little.unionByName(rest.select(little.columns)), block))


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """Links between members(root, cls, packed, core, group, own, others) of different groups, by pairs of blocks.

    A root has `others` blocks of members outside its core; own is a member's block. The core is dealt to as many parts as it
    needs, and each part meets every block; so what is sent grows with the core's size times the number of those blocks.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("root", pa.int64()), ("cls", pa.int64()), ("group", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("own", pa.int32()), ("packed", pa.binary())]), 256)
        for root, cls, group, core, own, others, n, packed in rows_of(batches, "root", "cls", "group", "core", "own", "others", "members", "packed"):
            part = -1 - cls % max(1, n // block)
            for other in range(others):
                if core:
                    out.add(root, cls, group, part, other, part, packed)
                else:
                    out.add(root, cls, group, min(own, other), max(own, other), own, packed)
                yield from out.ready()
            if not core and n > block:
                for part in range(-1, -1 - max(1, n // block), -1):
                    out.add(root, cls, group, part, own, own, packed)
                    yield from out.ready()
        yield from out.ready(force=True)

    def solve(table: pa.Table) -> pa.Table:
        rows = {c: (o, g, p) for c, o, g, p in zip(*(table.column(n).to_pylist() for n in ("cls", "own", "group", "packed")), strict=True)}
        ids = sorted(rows)
        sets = [np.frombuffer(expand(rows[c][2]), np.uint64) for c in ids]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = ([n for n, c in enumerate(ids) if rows[c][0] == b] for b in (i, j))
        found = links_of(ids, sets, left, None if i == j else right, [rows[c][1] for c in ids])
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    sent = members.select("root", "cls", "group", "core", "own", "others", "members", "packed").mapInArrow(send, "root long, cls long, group long, i int, j int, own int, packed binary")
    return sent.groupBy("root", "i", "j").applyInArrow(solve, "a long, b long")


def join(docs: DataFrame, block: int = 256, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, cls (the key of its set), th and root (the key of its component) for each row of `docs(doc_id, text)`.

    bits: of the first hash of a set; fewer only test what happens where different sets share it."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    every, shared_keys = classes(docs, bits)

    def key(shingles: np.ndarray) -> int:
        return class_of(shingles, shared_keys, bits)

    parts = max(1, buckets(docs.sparkSession) // 2, -(-(every.agg(F.sum("n_shingles")).first()[0] or 0) // BUCKET_SHINGLES))
    kept = materialise(candidates(docs, parts, key), "kept-words")
    leaders = kept.groupBy("word").agg(F.min("cls").alias("leader"))
    family = components(hubs(kept.join(leaders, "word").where("cls <> leader").select(F.col("cls").alias("a"), F.col("leader").alias("b"))))
    sizes = family.groupBy("root").agg(F.count("*").alias("members"))
    members = join_one(family, sizes, "root", "inner").select(F.col("node").alias("cls"), "root", "members")
    texts = every.where("cls is not null").groupBy("cls").agg(F.min("th").alias("th"))
    wanted = materialise(members.join(texts, "cls").select("th", "cls", "root", "members"), "family-members")
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    chosen = docs.select("text").withColumn("th", F.xxhash64("text")).where("text is not null").join(F.broadcast(wanted) if small else wanted, "th").select("text", "cls", "root", "members")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("root", pa.int64()), ("cls", pa.int64()), ("members", pa.int64()), ("packed", pa.binary())]), 256)
        seen: set[int] = set()  # repeated texts of this task
        for rows in sized(rows_of(batches, "text", "cls", "root", "members"), lambda r: len(r[0]), SLICE_CHARS):
            fresh = list({r[1]: r for r in rows if r[1] not in seen}.values())
            seen.update(r[1] for r in fresh)
            for (_, cls, root, n), s in zip(fresh, shingle_sets([r[0] for r in fresh]), strict=True):
                if key(s) == cls:  # else another text with the same hash
                    out.add(root, cls, n, squeeze(s.tobytes()))
                    yield from out.ready()
            if len(seen) > 1_000_000:
                seen.clear()
        yield from out.ready(force=True)

    loaded = chosen.mapInArrow(load, "root long, cls long, members long, packed binary")
    loaded = materialise(loaded.dropDuplicates(["cls"]), "family-sets")
    roots = components(_links(loaded, block))
    per_class = every.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_id"))
    linked = materialise(per_class.join(roots, per_class.cls == roots.node, "left").select("cls", "first_id", F.coalesce("root", "cls").alias("root")), "linked")
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("component"))
    resolved = join_one(linked, lowest, "root", "inner").select("cls", "component", "root")
    return join_one(every, resolved, "cls").select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "cls", "th", "root")


def keep_one(docs: DataFrame, block: int = 256) -> DataFrame:
    """`docs` with one document of each component: the one with the smallest id, of rows that share it the smallest hash.

    Documents without words stay. All columns stay as they are, whatever their names.
    """
    return with_own_columns(docs, lambda d: _keep_one(d, block))


def _keep_one(docs: DataFrame, block: int) -> DataFrame:
    found = materialise(join(docs, block), "near-duplicates")
    first = found.where("cls is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("k")).select("root", F.col("k.doc_id").alias("keep_id"), F.col("k.th").alias("keep_th"))
    judged = join_one(found.where("cls is not null"), first, "root", "inner")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th"))
    dropped = materialise(judged.where(~stays).select(F.col("doc_id").alias("__id"), F.col("th").alias("__t")).distinct(), "dropped")
    repeated = materialise(judged.where(stays).groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__t")).count().where("count > 1").drop("count"), "repeated")

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df

    own = docs.withColumn("__th", F.xxhash64(F.col("text").cast("string")))
    same = (F.col("__th") == F.col("__t")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
    kept = own.join(small(dropped), same, "left_anti")
    if not repeated.isEmpty():  # of rows that repeat id and text, one
        some = small(repeated)
        kept = kept.join(some, same, "left_anti").union(kept.join(some, same, "left_semi").dropDuplicates(["doc_id", "__th"]))
    return kept.drop("__th")
