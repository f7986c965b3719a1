"""Operator 6: removal of repeated substrings of at least `size` bytes by longest previous factors.

Method. A position is a repeat if its longest previous factor (or, without order, any other factor) reaches `size` bytes.
That needs the suffix order only down to `size` bytes, and only for suffixes that have a partner at all; these are found by
two filters that lose nothing. Winnowing picks anchors: in each stretch of size - gram + 1 grams the smallest hash, so every
window of `size` bytes has one anchor, the same in every copy of it. Windows whose anchor gram occurs once are left out,
then windows whose own 64-bit hash occurs once. Hashes are dealt evenly, so a passage that a third of all documents hold
makes no hot key of the windows that only touch it.

What is left goes with its text: consecutive windows with one anchor are a segment, dealt by the anchor's gram, equal
segments of a block once. In a bucket the suffixes are put in order by their bytes, with common prefixes; previous and next
smaller positions in that order give the longest previous factor (`previous_factors`). So hashes decide nothing but what is
looked at. Rows go back by block, and the text's hash joins them to the text. Copies of a whole text are found by its
128-bit hash; one of them takes part for all. Blocks are cut in one pass and ordered by id, so no second pass has to agree.

`dedup` can judge by words as well: then the same steps run on the words' hashes in place of the bytes, and a window of
`words` words goes if an earlier document holds the same words, whatever white space stands between them.

Defined cases: a null text counts as empty; texts under `size` bytes lose nothing; repeated rows are copies of each
other (with keep_first, rows that repeat both id and text count as one document); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm._common import WS, Out, buckets, materialise, rows_of, sized, with_own_columns
from proofline.llm.bpe import expand, squeeze
from proofline.llm.shingle_join import mix

SIZE, GRAM = 400, 200
SPACE = np.isin(np.arange(256), list(WS.encode()))
POSITION_BITS = 28
BLOCK_BYTES = 4_000_000
BROADCAST_BYTES = 48 << 20
SENT = pa.schema([("part", pa.int32()), ("block", pa.binary()), ("packed", pa.binary())])
MARKED = pa.schema([("part", pa.int32()), ("block", pa.binary()), ("kind", pa.int32()), ("packed", pa.binary())])
SENT_SQL, MARKED_SQL = "part int, block binary, packed binary", "part int, block binary, kind int, packed binary"
PLACES = pa.schema([("th", pa.binary()), ("places", pa.binary())])
HITS, LAYOUT, SEGMENTS = range(3)  # kinds of rows: places that repeat, where a block's places lie, text that goes on
FAN_BLOCKS = 4096
BASE = 0xD6E8FEB86659FD93
LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hasher:
    """Rolling hashes of a text's bytes, for any window size."""

    symbol = 1  # bytes of a symbol
    _powers = powers(1 << 16)

    def __init__(self, data: np.ndarray):
        self.data = data
        self._add(LETTERS[data])

    def symbols(self) -> np.ndarray:
        return self.data

    def _add(self, letters: np.ndarray) -> None:
        if len(Hasher._powers[0]) <= len(letters):
            Hasher._powers = powers(2 * len(letters))
        self.up, down = Hasher._powers
        self.sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(letters * down[: len(letters)], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.up[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text's bytes start and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[data], [True]]).astype(np.int8)))
    return edges[::2], edges[1::2]


class Words(Hasher):
    """Rolling hashes of a text's words; a word counts as its 64-bit hash."""

    symbol = 8

    def __init__(self, data: np.ndarray):
        super().__init__(data)
        a, b = word_bounds(data)
        self.words = mix((self.sums[b] - self.sums[a]) * self.up[a])
        self._add(self.words)

    def symbols(self) -> np.ndarray:
        return self.words


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each stretch of `width` (block-wise prefix and suffix minima)."""
    n = len(x) - width + 1
    padded = np.append(x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, width)
    before = np.minimum.accumulate(padded, 1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def smallest(grams: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of `width` grams, where its smallest hash lies (the leftmost of equals)."""
    out, most, bits = [np.zeros(0, np.int64)], 1 << POSITION_BITS, np.uint64(POSITION_BITS)
    for start in range(0, len(grams) - width + 1, most - width + 1):  # longer texts in parts, each stretch whole in one
        part = grams[start : start + most]
        key = (part >> bits << bits) | np.arange(len(part), dtype=np.uint64)
        out.append((sliding_min(key, width) & np.uint64(most - 1)).astype(np.int64) + start)
    return np.concatenate(out)


def candidates(repeated: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Starts of the windows whose own anchor is repeated; own: the anchor of the window at each start."""
    known = np.zeros(max(own.max(initial=0), repeated.max(initial=0)) + 1, bool)
    known[repeated] = True
    return np.flatnonzero(known[own])


def covered(starts: np.ndarray, size: int) -> np.ndarray:
    """Maximal runs [a, b) of the bytes in windows with these sorted starts, as rows."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(starts) > size) + 1
    return np.stack([starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)] + size], 1)


def thin(x: np.ndarray) -> bytes:
    """Sorted whole numbers, packed."""
    return squeeze(np.diff(x, prepend=0).astype("<u4").tobytes())


def thick(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(expand(data), "<u4").astype(np.int64))


def _cuts(bucket: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries in the order of their buckets, and where each bucket ends."""
    by = np.argsort(bucket, kind="stable")
    return by, np.append(np.searchsorted(bucket[by], np.arange(parts)), len(by))


def _layout(out: Out, block: bytes, parts: int, found: list[tuple[bytes, np.ndarray]], again: np.ndarray, same: np.ndarray) -> None:
    """A block's texts, where their places end, which repeat for sure, and runs of places that share another run's fate."""
    ends = np.cumsum([len(f[1]) for f in found]).astype("<i8")
    positions = np.concatenate([f[1] for f in found]).astype("<u4")
    data = np.array([len(found), len(again), len(same)], "<u4").tobytes() + b"".join(f[0] for f in found) + ends.tobytes() + again.astype("<u4").tobytes() + same.astype("<u4").tobytes()
    out.add(parts + int.from_bytes(block[:4], "little") % parts, block, squeeze(data + np.diff(positions, prepend=np.uint32(0)).tobytes()))


def _places(table: pa.Table) -> pa.Table:
    """Positions by text from a block's layout and its hits."""
    out_th, out_places = [], []
    kinds, packed = table.column("kind").to_pylist(), table.column("packed")
    hits = [thick(packed[i].as_py()) for i, k in enumerate(kinds) if k == HITS]
    data = expand(packed[kinds.index(LAYOUT)].as_py())
    n, local, runs = np.frombuffer(data, "<u4", 3).tolist()
    ths = [data[12 + 16 * i : 28 + 16 * i] for i in range(n)]
    ends = np.frombuffer(data, "<i8", n, at := 12 + 16 * n)
    again = np.frombuffer(data, "<u4", local, at := at + 8 * n).astype(np.int64)
    same = np.frombuffer(data, "<u4", 3 * runs, at := at + 4 * local).reshape(-1, 3).astype(np.int64)
    positions = np.cumsum(np.frombuffer(data, "<u4", offset=at + 12 * runs), dtype=np.uint32)
    marked = np.zeros(len(positions), bool)
    marked[np.concatenate([again, *hits])] = True
    for own, other, length in same.tolist():
        marked[own : own + length] |= marked[other : other + length]
    index = np.flatnonzero(marked)
    cut = np.searchsorted(index, np.append(0, ends))
    for i, th in enumerate(ths):
        if len(at := index[cut[i] : cut[i + 1]]):
            out_th.append(th)
            out_places.append(thin(positions[at]))
    return pa.table({"th": pa.array(out_th, pa.binary()), "places": pa.array(out_places, pa.binary())}, schema=PLACES)


def _settled(marked: DataFrame, name: str) -> DataFrame:
    """(th, places) from rows of hits and layouts."""
    return materialise(marked.groupBy("block").applyInArrow(_places, "th binary, places binary").dropDuplicates(["th"]), name)


def _blocks(batches: Iterator[pa.RecordBatch], entries) -> Iterator[tuple[bytes, list[tuple]]]:
    """Blocks of texts as (key, [(th, doc_id, *entries(text bytes, extra))]), in the order of their ids; texts without entries are left out."""
    for rows in sized(rows_of(batches, "th", "doc_id", "text", "extra"), lambda r: len(r[2]), BLOCK_BYTES):
        found = []
        for th, doc_id, text, extra in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
            got = entries(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), extra)
            if len(got[0]):
                found.append((th, doc_id, *got))
        if found:
            yield hashlib.blake2b(b"".join(f[0] for f in found), digest_size=16).digest(), found


def _twice(table: pa.Table) -> pa.Table:
    """Of a bucket's keys, where those lie that several blocks sent; layouts pass."""
    parts, blocks = table.column("part"), table.column("block").to_pylist()
    if parts[0].as_py() < 0:
        return pa.table({"part": parts, "block": table.column("block"), "kind": pa.array([LAYOUT] * len(blocks), pa.int32()), "packed": table.column("packed")}, schema=MARKED)
    keys, index = [], []
    for packed in table.column("packed"):
        data = packed.as_py()
        k, a = np.frombuffer(data, "<u4", 2).tolist()
        index.append(thick(data[8 : 8 + a]))
        keys.append(np.frombuffer(data, "<u8", k, 8 + a))
    of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    keys, index = np.concatenate(keys), np.concatenate(index)
    by = np.argsort(keys, kind="stable")
    same = keys[by[1:]] == keys[by[:-1]]
    hit = np.zeros(len(keys), bool)
    hit[by[1:]] |= same
    hit[by[:-1]] |= same
    del keys, by, same
    out = Out(MARKED, 1 << 30)
    for n, block in enumerate(blocks):
        own = slice(*np.searchsorted(of, [n, n + 1]))
        if len(at := index[own][hit[own]]):
            out.add(0, block, HITS, thin(at))
    return pa.Table.from_batches(list(out.ready(force=True)), schema=MARKED)


def _repeated(texts: DataFrame, entries, parts: int, name: str) -> DataFrame:
    """(th, places) of the entries whose 64-bit key occurs at least twice; entries(text bytes, extra) gives positions and keys of a text.

    texts: (th, doc_id, text, extra). One pass gives a block's keys, each once, and its layout.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, found in _blocks(batches, entries):
            keys = np.concatenate([f[3] for f in found])
            by = np.argsort(keys, kind="stable")
            new = np.ones(len(keys), bool)
            new[1:] = keys[by[1:]] != keys[by[:-1]]
            again = np.sort(by[~new | np.append(~new[1:], False)])  # repeats within the block
            first = np.sort(by[new])
            del by, new
            out = Out(SENT, 1 << 30)
            _layout(out, block, parts, [(f[0], f[2]) for f in found], again, again[:0])
            keys = keys[first]
            by, cut = _cuts((keys >> np.uint64(40)) % np.uint64(parts), parts)
            for b in range(parts):
                if len(at := np.sort(by[cut[b] : cut[b + 1]])):
                    where = thin(first[at])
                    out.add(b, block, np.array([len(at), len(where)], "<u4").tobytes() + where + keys[at].tobytes())
            yield from out.ready(force=True)

    dealt = texts.mapInArrow(run, SENT_SQL).withColumn("part", F.when(F.col("part") >= parts, -1 - F.col("part")).otherwise(F.col("part")))
    return _settled(dealt.groupBy("part").applyInArrow(_twice, MARKED_SQL), name)


def ordered(strings: list[bytes], symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the strings, and the longest common prefix of each with the one before, in symbols (-1 for the first)."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    lcp = np.full(len(order), -1, np.int64)
    for at in range(0, len(order) - 1, 4096):
        part = [strings[i] for i in order[at : at + 4097]]
        lengths = np.array([len(s) for s in part])
        most = int(lengths.max())
        rows = np.frombuffer(b"".join([s.ljust(most + 1, b"\0") for s in part]), np.uint8).reshape(len(part), most + 1)
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(1), differ.argmax(1), most)
        lcp[at + 1 : at + len(part)] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1])) // symbol
    return np.array(order, np.int64), lcp


def previous_factors(left: list[bytes], right: list[bytes], document: np.ndarray, size: int, gram: int, symbol: int, keep_first: bool, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes have a factor of `size` symbols in common with another one, and which are the first with theirs.

    Members stand in the order of their positions. right[i] starts at member i's anchor, left[i] runs backwards from it; the
    suffix at offset d starts d symbols before the anchor. For each offset the suffixes are put in order by their text (left
    part, then right part, from the two suffix orders and their common prefixes); in a run of suffixes that agree in `size`
    symbols the order is that of positions, so the previous smaller position is the row before, and the next smaller one lies
    beyond the run and agrees in fewer. A suffix's longest previous factor reaches `size` if it is not the first of its run.
    Without keep_first any other member counts, with across only one of another document.
    """
    n, offsets = len(left), size - gram + 1
    reach_left, reach_right = (np.array([len(s) // symbol for s in x]) for x in (left, right))
    (by_left, lcp_left), (by_right, lcp_right) = ordered(left, symbol), ordered(right, symbol)
    hit, lead = np.zeros((n, offsets), bool), np.zeros((n, offsets), bool)
    own_left, own_right = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(offsets):
        at = np.flatnonzero((reach_left >= d) & (reach_right >= size - d))
        if not len(at):
            continue
        own_left[by_left] = np.cumsum(lcp_left < d)
        own_right[by_right] = np.cumsum(lcp_right < size - d)
        key = own_left[at] * (n + 1) + own_right[at]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        new = np.append(True, key[1:] != key[:-1])
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        first = document[at[starts]][run]
        last = document[at[np.append(starts[1:], len(at)) - 1]][run]
        if across:
            hit[at, d] = first != document[at] if keep_first else first != last
            lead[at, d] = first == document[at]
        else:
            hit[at, d] = ~new if keep_first else ~new | ~np.append(new[1:], True)
            lead[at, d] = new
    return hit, lead


class Segments:
    """Pieces of text around anchors: base (the number of a piece's first place in its block), left, right and document."""

    def __init__(self) -> None:
        self.base, self.before, self.after, self.document, self.ids, self.data = [], [], [], [], [], []

    def pack(self, chosen=None) -> bytes:
        chosen = range(len(self.base)) if chosen is None else chosen
        numbers = np.array([[x[i] for i in chosen] for x in (self.base, self.before, self.after, self.document)], "<u4")
        return squeeze(np.array([numbers.shape[1]], "<u4").tobytes() + numbers.tobytes() + np.array([self.ids[i] for i in chosen], "<i8").tobytes() + b"".join([self.data[i] for i in chosen]))

    @classmethod
    def unpack(cls, packed: bytes, symbol: int) -> Segments:
        data, own = expand(packed), cls()
        n = int(np.frombuffer(data, "<u4", 1)[0])
        own.base, own.before, own.after, own.document = np.frombuffer(data, "<u4", 4 * n, 4).reshape(4, n).tolist()
        own.ids, at = np.frombuffer(data, "<i8", n, 4 + 16 * n).tolist(), 4 + 24 * n
        for a, b in zip(own.before, own.after, strict=True):
            own.data.append(data[at : (at := at + (a + b) * symbol)])
        return own


def _factors(size: int, gram: int, symbol: int, keep_first: bool, across: bool, final: bool):
    """Of a bucket's segments, the places with a long enough factor elsewhere; if not final also the segments that go on. Layouts pass."""

    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        if table.column("part")[0].as_py() < 0:
            return pa.table({"part": table.column("part"), "block": table.column("block"), "kind": pa.array([LAYOUT] * len(blocks), pa.int32()), "packed": table.column("packed")}, schema=MARKED)
        held = [(block, Segments.unpack(packed.as_py(), symbol)) for block, packed in zip(blocks, table.column("packed"), strict=True)]
        members = sorted((s.ids[i], block, s.document[i], s.base[i], n, i) for n, (block, s) in enumerate(held) for i in range(len(s.base)))
        left, right, document, last = [], [], np.zeros(len(members), np.int64), None
        for m, (_, block, of, _, n, i) in enumerate(members):
            s = held[n][1]
            data, a = s.data[i], s.before[i] * symbol
            left.append(data[:a][::-1] if symbol == 1 else np.frombuffer(data[:a], "<u8")[::-1].tobytes())
            right.append(data[a:])
            document[m] = (0 if last is None else document[m - 1] + (last != (block, of)))
            last = (block, of)
        hit, lead = previous_factors(left, right, document, size, gram, symbol, keep_first, across)
        out, found, on = Out(MARKED, 1 << 30), [[] for _ in held], [[] for _ in held]
        for m, (_, _, _, base, n, i) in enumerate(members):
            d = np.flatnonzero(hit[m])
            if len(d):
                found[n].append(base + held[n][1].before[i] - d[::-1])
            if not final and lead[m].any():
                on[n].append(i)
        for n, (block, s) in enumerate(held):
            if found[n]:
                out.add(0, block, HITS, thin(np.sort(np.concatenate(found[n]))))
            if on[n]:
                out.add(table.column("part")[0].as_py(), block, SEGMENTS, s.pack(on[n]))
        return pa.Table.from_batches(list(out.ready(force=True)), schema=MARKED)

    return run


def _matched(texts: DataFrame, unit: type[Hasher], size: int, gram: int, keep_first: bool, across: bool, parts: int, name: str) -> DataFrame:
    """(th, places) of the windows whose longest previous (or other) factor reaches `size`, by the texts themselves.

    texts: (th, doc_id, text, extra), extra: the starts of the windows in question. Consecutive windows with one anchor are a
    segment; equal segments of a block are sent once, to the bucket of the anchor's gram. A passage that many blocks hold is
    reduced over groups of FAN_BLOCKS blocks first.
    """
    symbol, width = unit.symbol, size - gram + 1

    def entries(data: np.ndarray, places: bytes) -> tuple:
        hasher, starts = unit(data), thick(places)
        grams = hasher.windows(gram)
        anchors = smallest(grams, width)[starts]
        cut = np.flatnonzero((np.diff(starts) > 1) | (np.diff(anchors) > 0)) + 1
        low = np.append(0, cut)
        high = np.append(cut, len(starts)) - 1
        a = anchors[low]
        return starts, low, high, a - starts[low], starts[high] + size - a, grams[a], hasher.symbols()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, found in _blocks(batches, entries):
            seen: dict[tuple, list] = {}  # a segment's text: its first document, places, and whether these are marked
            again, same, base = np.zeros(sum(len(f[2]) for f in found), bool), [], 0
            dealt: dict[int, Segments] = {}
            for n, (_, doc_id, starts, low, high, before, after, keys, symbols) in enumerate(found):
                bucket = ((keys >> np.uint64(40)) % np.uint64(parts)).tolist()
                for since, x, y, a, b, part in zip(starts[low].tolist(), (low + base).tolist(), (high + base).tolist(), before.tolist(), after.tolist(), bucket, strict=True):
                    piece = symbols[since : since + a + b].tobytes()
                    first = seen.setdefault((a, piece), [n, x, y, False])
                    if first[1] == x:
                        s = dealt.setdefault(part, Segments())
                        for to, v in zip((s.base, s.before, s.after, s.document, s.ids, s.data), (x, a, b, n, -(1 << 63) if doc_id is None else doc_id, piece), strict=True):
                            to.append(v)
                    elif across and first[0] == n:
                        same.append((x, first[1], y - x + 1))
                    else:
                        again[x : y + 1] = True
                        if not keep_first and not first[3]:
                            first[3] = True
                            again[first[1] : first[2] + 1] = True
                base += len(starts)
            out = Out(SENT, 1 << 30)
            _layout(out, block, parts, [(f[0], f[2]) for f in found], np.flatnonzero(again), np.array(same, np.int64).reshape(-1, 3))
            for part, s in sorted(dealt.items()):
                out.add(part, block, s.pack())
            yield from out.ready(force=True)

    def factors(final: bool):
        return _factors(size, gram, symbol, keep_first, across, final)

    size_of_all = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    fan = -(-size_of_all // (BLOCK_BYTES * FAN_BLOCKS))
    dealt = texts.mapInArrow(run, SENT_SQL).withColumn("part", F.when(F.col("part") >= parts, -1 - F.col("part")).otherwise(F.col("part")))
    if fan <= 1:
        return _settled(dealt.groupBy("part").applyInArrow(factors(True), MARKED_SQL), name)
    salted = dealt.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(fan))).groupBy("part", "salt").applyInArrow(factors(False), MARKED_SQL)
    salted = materialise(salted, f"{name}-reduced")
    rest = salted.where(F.col("kind") == SEGMENTS).drop("kind").groupBy("part").applyInArrow(factors(True), MARKED_SQL)
    return _settled(salted.where(F.col("kind") != SEGMENTS).unionByName(rest), name)


def _by_text(texts: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """texts joined with a table keyed by th, which is broadcast only if its measured size is within BROADCAST_BYTES."""
    size = found.agg(F.sum(F.length("places") + 64)).first()[0] or 0
    return texts.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "th", how)


def spans(docs: DataFrame, size: int = SIZE, gram: int = GRAM, keep_first: bool = False, unit: type[Hasher] = Hasher) -> DataFrame:
    """`docs` with th (the text's hash), starts (packed starts of repeated windows) and whole (a copy that goes as a whole).

    size, gram and starts count bytes, or words if the unit is `Words`; then only other documents' windows count.
    """
    parts = buckets(docs.sparkSession)
    width = size - gram + 1
    every = docs.withColumn("th", F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))
    reaches = F.octet_length("text") >= size if unit is Hasher else F.col("text").rlike(f"^[{WS}]*+(?:[^{WS}]++[{WS}]++){{{size - 1}}}[^{WS}]")
    long = every.where(reaches)
    same = long.groupBy("th", F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("m")).groupBy("th")
    same = same.agg(F.sum("m").alias("n"), F.min("doc_id").alias("first_id"), F.coalesce(F.min_by("m", "doc_id"), F.max("m")).alias("m"))
    copies = materialise(same.where("n > 1").withColumn("places", F.lit(b"")), "copies")
    one = _by_text(long.select("th", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), copies, "left").where("n is null or first_id <=> doc_id")
    if not copies.where("m > 1").isEmpty():  # rows that repeat both id and text: one of them takes part
        one = one.where("m is null or m = 1").unionByName(one.where("m > 1").dropDuplicates(["th"]))
    one = one.drop("n", "m", "places", "first_id")

    def anchor_entries(data: np.ndarray, _) -> tuple[np.ndarray, np.ndarray]:
        grams = unit(data).windows(gram)
        at = np.unique(smallest(grams, width))
        return at, grams[at]

    def window_entries(data: np.ndarray, places: bytes) -> tuple[np.ndarray, np.ndarray]:
        hasher = unit(data)
        at = candidates(thick(places), smallest(hasher.windows(gram), width))
        return at, hasher.windows(size)[at]

    anchors = _repeated(one.withColumn("extra", F.lit(None).cast("binary")), anchor_entries, max(1, parts // 8), "anchors")
    windows = _repeated(_by_text(one, anchors, "inner").withColumnRenamed("places", "extra"), window_entries, parts, "windows")
    matched = _matched(_by_text(one, windows, "inner").withColumnRenamed("places", "extra"), unit, size, gram, keep_first, unit is Words, parts, "factors")
    joined = _by_text(every, matched, "left").withColumnRenamed("places", "starts")
    joined = _by_text(joined, copies.drop("n", "m"), "left")
    if keep_first:
        is_copy = F.col("places").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    else:
        is_copy = F.col("places").isNotNull()
    return joined.withColumn("whole", is_copy).drop("places", "first_id")


def removed(n: int, starts: bytes | None, whole: bool, size: int) -> np.ndarray:
    """Runs [a, b) to remove from a text of n bytes."""
    if whole:
        return np.array([[0, n]], np.int64)
    return covered(thick(starts), size) if starts else np.zeros((0, 2), np.int64)


def digest(docs: DataFrame, size: int = SIZE, gram: int = GRAM, keep_first: bool = False, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of `docs(doc_id, text)`.

    With words also n_shared_words: how many of a text's words stand in a window of so many words that another document
    holds too (an earlier one, with keep_first). It removes nothing.
    """
    shape = [("doc_id", "long"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), *([("n_shared_words", "long")] if words else [])]
    types = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([(n, types[t]) for n, t in shape]))
        for doc_id, text, starts, whole, word_starts, all_words in rows_of(batches, "doc_id", "text", "starts", "whole", "word_starts", "all_words"):
            data = (text or "").encode("utf-8", "surrogatepass")
            runs = removed(len(data), starts, whole, size)
            shared = []
            if words:
                shared = [len(data.split()) if all_words else int(np.diff(covered(thick(word_starts), words)).sum()) if word_starts else 0]
            out.add(doc_id, len(data), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(_kept(data, runs)).hexdigest(), *shared)
            yield from out.ready()
        yield from out.ready(force=True)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked = spans(plain, size, gram, keep_first)
    if words:
        found = spans(plain, words, words // 2, keep_first, Words).where("starts is not null or whole")
        found = found.select("th", F.col("doc_id").alias("__id"), F.coalesce("starts", F.lit(b"")).alias("places"), F.col("whole").alias("all_words"))
        found = materialise(found.dropDuplicates(["th", "__id"] if keep_first else ["th"]), "shared-words")
        size_ = found.agg(F.sum(F.length("places") + 64)).first()[0] or 0
        found = found.withColumnsRenamed({"th": "__th", "places": "word_starts"})
        same = (F.col("th") == F.col("__th")) & (F.col("doc_id").eqNullSafe(F.col("__id")) if keep_first else F.lit(True))
        marked = marked.join(F.broadcast(found) if size_ <= BROADCAST_BYTES else found, same, "left")
    else:
        marked = marked.withColumns({"word_starts": F.lit(None).cast("binary"), "all_words": F.lit(False)})
    return marked.select("doc_id", "text", "starts", "whole", "word_starts", "all_words").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in shape))


def _kept(data: bytes, runs: np.ndarray) -> bytes:
    bounds = [0, *runs.ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))


def inside_characters(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The run narrowed to whole characters."""
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while a < b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def word_runs(data: bytes, starts: bytes, words: int) -> np.ndarray:
    """Runs [a, b) of the bytes in windows of so many words that start at these words."""
    a, b = word_bounds(np.frombuffer(data, np.uint8))
    runs = covered(thick(starts), words)
    return np.stack([a[runs[:, 0]], b[runs[:, 1] - 1]], 1)


def united(runs: list[tuple[int, int]]) -> np.ndarray:
    """Runs that touch or overlap as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return np.array(out, np.int64).reshape(-1, 2)


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """`docs` with later repeats cut out of their texts (characters that a run only touches stay); other columns stay.

    A repeat has at least `size` bytes or, if words is given, so many words that an earlier document holds as well. Other
    columns stay whatever their names.
    """
    return with_own_columns(docs, lambda d: _dedup(d, size, gram, words))


def _dedup(docs: DataFrame, size: int, gram: int, words: int | None) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def marks_of(unit: type[Hasher], size: int, gram: int, starts: str) -> DataFrame:
        found = spans(plain, size, gram, True, unit).where("starts is not null or whole")
        return found.select("doc_id", "th", F.col("starts").alias(starts), F.col("whole").alias(f"{starts}_whole")).dropDuplicates(["doc_id", "th"])

    names = docs.columns
    joined = docs.withColumns({"__th": F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))})
    marks = [marks_of(Hasher, size, gram, "__bytes"), *([marks_of(Words, words, words // 2, "__words")] if words else [])]
    for m in marks:
        m = m.withColumnsRenamed({"doc_id": "__id", "th": "__t"})
        joined = joined.join(m, (F.col("__th") == F.col("__t")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__t", "__id")
    joined = joined.drop("__th")
    if not words:
        joined = joined.withColumns({"__words": F.lit(None).cast("binary"), "__words_whole": F.lit(False)})
    at = [joined.columns.index(c) for c in ("text", "__bytes", "__bytes_whole", "__words", "__words_whole")]

    def cut(text: str | None, starts: bytes | None, whole: bool | None, word_starts: bytes | None, word_whole: bool | None) -> str | None:
        if text is None or not (starts or whole or word_starts or word_whole):
            return text
        data = text.encode("utf-8", "surrogatepass")
        runs = [inside_characters(data, a, b) for a, b in removed(len(data), starts, bool(whole or word_whole), size).tolist()]
        if word_starts:
            runs = united([*runs, *map(tuple, word_runs(data, word_starts, words).tolist())])
        return _kept(data, np.array(runs, np.int64).reshape(-1, 2)).decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [cut(*(v.as_py() for v in row)) for row in zip(*(batch.column(i) for i in at), strict=True)]
            columns = [pa.array(new, pa.string()) if i == at[0] else c for i, c in enumerate(batch.columns) if i not in at[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
