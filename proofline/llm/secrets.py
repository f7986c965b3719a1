"""Operator 4: secret scan with a recursive decoding worklist.

Method. Every text is scanned with the base patterns. Then a worklist takes layers: URL and Unicode escapes are decoded
where they stand (in form data a plus is a space), base64 runs are unwrapped from all four phases, and each new layer is
scanned and searched for further layers, until no new one appears. All patterns are ASCII, so decoded bytes are read as
Latin-1, whatever they are. Where a compressed stream starts in decoded or expanded bytes (gzip, zlib, bzip2, xz, zstd,
a deflated ZIP member; a bare deflate stream only as the whole of a base64 run), it is expanded piece by piece, with all
that follows it, and the pieces are scanned in their turn. A layer that was seen before at the same place, or a stream inside itself (by their contents'
hash), is not taken again, which ends cycles. Each character of a layer knows the span of the
original text that it came from; a match counts only if it covers a decoded character, and gets the original's span.

Defined cases: a null text counts as empty; repeated rows give a row each; an empty table gives none. A match in
compressed data gets the span of the whole stream.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from proofline.llm._common import from_text

# The base patterns, the kinds in the order in which they are listed, and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so the least length can be part of the pattern
KINDS = ("assign", "access", "hex")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
FORM, FORM_PART = re.compile(r"[!-~]++"), re.compile(r"\+|(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"%u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})(?:\\u([0-9A-Fa-f]{4}))?|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
ALPHABET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")
# A secret has at least 14 characters (`token=` and eight), so its base64 form has at least 18, whatever the phase.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{18,}+={0,2}")
LINE_END = re.compile(r"\n[ \t]*+[A-Za-z0-9+/_-]")
LINES = re.compile(r"(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
BREAK = re.compile(r"[\r\n\t ]+")

# The first bytes of gzip, bzip2, xz, zstd (also its skippable frames) and zlib streams.
ZLIB = [bytes([c, f]) for c in range(0x08, 0x80, 16) for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 32]
MAGIC = re.compile(rb"\x1f\x8b\x08|PK\x03\x04.{4}\x08\0|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0|\x28\xb5\x2f\xfd|[\x50-\x5f]\x2a\x4d\x18|" + b"|".join(map(re.escape, ZLIB)), re.S)
# Without one of these, decoded bytes hold neither a match nor a further layer, compressed ones aside.
TELLING = re.compile(rb"(?i:passw(?:or)?d|secret|token|api_?key)|AKIA|[0-9a-f]{32}|%[0-9A-Fa-fu]|\\[uUx]|[A-Za-z0-9+/_-](?:[\r\n\t ]*[A-Za-z0-9+/_-]){17}")
PIECE, SLICE, ZSTD_SLICE, WINDOW = 1 << 20, 1 << 16, 256, 4096
CUT = re.compile(rb"""(?s).*(?:[^A-Za-z0-9+/=_.\-"':%\\{}\s]|\n|(?<=[^%\\]{63}[^%\\:=\s"'}])\x20(?=[^%\\:=\s"']))""")
ENCODED, TAIL = re.compile(rb"[A-Za-z0-9+/_-]+"), re.compile(rb"[A-Za-z0-9+/_-]*\Z")

Span = tuple[int, int, int]  # start, kind's number, end


def base(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost and not overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text and, for each of its characters, where it comes from: start and end in the original, and whether it was decoded."""

    __slots__ = ("text", "starts", "ends", "decoded", "end")  # end: where the run that was decoded ends, padding included

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, decoded: np.ndarray):
        self.text, self.starts, self.ends, self.decoded = text, starts, ends, decoded
        self.end: int | None = None

    @classmethod
    def whole(cls, text: str) -> Layer:
        at = np.arange(len(text), dtype=np.int64)
        return cls(text, at, at + 1, np.zeros(len(text), bool))

    def key(self) -> bytes:
        h = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        h.update(b"%d:%d" % ((int(self.starts.min()), int(self.ends.max())) if len(self.text) else (0, 0)))
        return h.digest()

    def replaced(self, parts: list[tuple[int, int, str, np.ndarray, np.ndarray]]) -> Layer:
        """This layer with each [a, b) replaced by a text whose characters come from [a + from, a + to)."""
        texts, starts, ends, decoded, at = [], [], [], [], 0
        for a, b, new, since, until in parts:
            texts += [self.text[at:a], new]
            starts += [self.starts[at:a], self.starts[a + since]]
            ends += [self.ends[at:a], self.ends[a + until - 1]]
            decoded += [self.decoded[at:a], np.ones(len(new), bool)]
            at = b
        return Layer("".join([*texts, self.text[at:]]), np.concatenate([*starts, self.starts[at:]]), np.concatenate([*ends, self.ends[at:]]), np.concatenate([*decoded, self.decoded[at:]]))

    def inner(self, text: str, since: np.ndarray, until: np.ndarray) -> Layer:
        """A layer of its own whose characters come from [since, until) of this one."""
        return Layer(text, self.starts[since], self.ends[until - 1], np.ones(len(text), bool))


class Source:
    """Bytes that arrive in slices: those held and not yet used, and how many were used."""

    def __init__(self, slices: Iterable[bytes]):
        self.slices, self.held, self.used = iter(slices), b"", 0

    def more(self) -> bool:
        new = next(self.slices, None)
        self.held += new or b""
        return new is not None

    def take(self, n: int) -> bytes:
        part, self.held = self.held[:n], self.held[n:]
        self.used += len(part)
        return part

    def put_back(self, rest: bytes) -> None:
        self.held = rest + self.held
        self.used -= len(rest)


def sliced(data: bytes, start: int = 0) -> Iterator[bytes]:
    return (data[i : i + SLICE] for i in range(start, len(data), SLICE))


class Member:
    """A decoder of a deflated ZIP member, which starts with its local header."""

    def __init__(self) -> None:
        self.head, self.body = b"", zlib.decompressobj(-15)

    def decompress(self, data: bytes, most: int) -> bytes:
        if self.head is not None:
            self.head += data
            size = 30 + sum(int.from_bytes(self.head[i : i + 2], "little") for i in (26, 28)) if len(self.head) >= 30 else 30
            if len(self.head) < size or size == 30 == len(self.head):
                return b""
            data, self.head = self.head[size:], None
        return self.body.decompress(data, most)

    eof = property(lambda self: self.body.eof)
    unused_data = property(lambda self: self.body.unused_data)
    unconsumed_tail = property(lambda self: self.body.unconsumed_tail)


def bare(data: bytes) -> bool:
    """Whether the bytes start with a whole deflate stream that has neither header nor checksum."""
    try:
        zlib.decompressobj(-15).decompress(data[:256], 64)  # nearly all other bytes fail here
        d, at = zlib.decompressobj(-15), 0
        while at < len(data) and not d.eof:
            part, at = data[at : at + SLICE], at + SLICE
            while part and not d.eof:
                d.decompress(part, PIECE)
                part = d.unconsumed_tail
        while not d.eof and d.decompress(b"", PIECE):
            pass
    except zlib.error:
        return False
    return d.eof and len(data) - len(d.unused_data) >= 8


def decoder(head: bytes):
    """A new decoder for the stream that starts with these bytes, or None."""
    if (m := MAGIC.match(head)) is None:
        return None
    if m[0].startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    if m[0].startswith(b"\xfd"):
        return lzma.LZMADecompressor()
    if m[0].endswith((b"\x2f\xfd", b"\x2a\x4d\x18")):
        import zstandard

        return zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
    if m[0].startswith(b"PK"):
        return Member()
    return zlib.decompressobj(31 if m[0].startswith(b"\x1f\x8b") else 15)


def expanded(source: Source, first=None) -> Iterator[bytes]:
    """What the compressed streams at the start of the source hold, one after the other, in pieces; first: the first one's decoder."""
    while True:
        while len(source.held) < 10 and source.more():
            pass
        padding = len(source.held) - len(source.held.lstrip(b"\0")) if source.used else 0
        if padding:  # zeros may stand between streams
            source.take(padding)
            continue
        d, first = first or decoder(source.held), None
        if d is None:
            return
        small = type(d).__module__.startswith("zstandard")  # has no bound on what a call gives, so it gets little at a time
        try:
            while not d.eof:
                if not source.held and not source.more():
                    return
                part = source.take(ZSTD_SLICE if small else SLICE)
                if small:
                    yield d.decompress(part)
                elif hasattr(d, "needs_input"):
                    yield d.decompress(part, PIECE)
                    while not d.needs_input and not d.eof:
                        yield d.decompress(b"", PIECE)
                else:
                    out = d.decompress(part, PIECE)
                    yield out
                    while not d.eof and (d.unconsumed_tail or len(out) == PIECE):
                        out = d.decompress(d.unconsumed_tail, PIECE)
                        yield out
        except Exception:  # not such a stream, or damaged from here on: what came before counts
            return
        source.put_back(d.unused_data)


def segments(pieces: Iterable[bytes]) -> Iterator[str]:
    """The pieces as texts, a character a byte, cut so that each match and each encoded run is whole in one of them.

    A cut stands behind a character that no match holds, in a space that no match can hold, or at a line's end; then
    the lines of an encoded run that end there are repeated in the next text. Memory is bounded by the longest run.
    """
    held = b""
    for piece in pieces:
        held += piece
        if len(held) < PIECE:
            continue
        if (m := CUT.match(held)) is None:
            continue
        end = since = m.end()
        if held[end - 1 : end] == b"\n":
            while since:
                line = held.rfind(b"\n", 0, since - 1) + 1
                part = held[line:since].strip()
                if part and not ENCODED.fullmatch(part):
                    since -= len(held[line:since].lstrip()) - TAIL.search(part).start()
                    break
                if not part:
                    break
                since = line
        if since > 0:
            yield held[:end].decode("latin-1")
            held = held[since:]
    yield held.decode("latin-1")


def kinds_inside(make: Callable[[], Source], path: frozenset[bytes], first=None) -> set[int]:
    """The kinds of secrets in a compressed stream and in what it holds; path: hashes of the streams around it; first: makes its decoder."""
    h = hashlib.blake2b(digest_size=16)
    source = make()
    while source.held or source.more():
        h.update(source.take(SLICE))
    if h.digest() in path:
        return set()
    path |= {h.digest()}
    content = lambda: expanded(make(), first and first())
    found = {k for text in segments(content()) for _, k, _ in scan(text, path)[1]}
    for inner in streams_inside(content):
        found |= kinds_inside(inner, path)
    return found


def from_offset(pieces: Iterable[bytes], start: int) -> Iterator[bytes]:
    for piece in pieces:
        if start < len(piece):
            yield piece[start:]
        start = max(0, start - len(piece))


def probe(window: bytes) -> tuple[str, int]:
    """What a stream's first bytes come to: none, over (with the bytes it took), damaged, or open, which needs more of them."""
    d, out, part = decoder(window), 0, window
    if d is None:
        return "none", 0
    try:
        while not d.eof:
            got = d.decompress(part) if type(d).__module__.startswith("zstandard") else d.decompress(part, PIECE)
            out += len(got)
            part = getattr(d, "unconsumed_tail", b"")
            if not part and (not got or len(got) < PIECE):
                break
    except Exception:
        return ("damaged" if out else "none"), len(window)
    return ("over", len(window) - len(d.unused_data)) if d.eof else ("open", len(window))


def streams_inside(content: Callable[[], Iterator[bytes]]) -> Iterator[Callable[[], Source]]:
    """Sources of the compressed streams that start anywhere in the content.

    Most places that look like a start fail within a window, which is all that is read of them. A stream that goes on
    beyond is read from the content anew, so streams cost the square of their number where one holds very many large ones.
    """
    held, at, done = b"", 0, 0
    for piece in _and_none(content()):
        held += piece or b""
        stop = len(held) if piece is None else max(0, len(held) - WINDOW)
        for m in MAGIC.finditer(held):
            k = m.start()
            if k >= stop:
                break
            if at + k < done:
                continue
            window = held[k : k + WINDOW]
            state, used = probe(window)
            if state == "none" or state == "open" and piece is None and len(window) < 10:
                continue
            if state == "open" and (piece is not None or k + WINDOW < len(held)):
                make = lambda start=at + k: Source(from_offset(content(), start))
                source = make()
                if not sum(map(len, expanded(source))):
                    continue
                done = at + k + source.used
            else:
                make = lambda window=window: Source([window])
                done = at + k + (used if state == "over" else len(m[0]))
            yield make
        held, at = held[stop:], at + stop


def _and_none(pieces: Iterable[bytes]) -> Iterator[bytes | None]:
    yield from pieces
    yield None


def url_layer(layer: Layer) -> Layer | None:
    parts = []
    for m in URL.finditer(layer.text):
        at = np.arange(0, len(m[0]), 3)
        parts.append((m.start(), m.end(), bytes.fromhex(m[0].replace("%", "")).decode("latin-1"), at, at + 3))
    return layer.replaced(parts) if parts else None


def form_layer(layer: Layer) -> Layer | None:
    """Form data: in a run of printable characters that holds URL escapes, a plus is a space."""
    parts = []
    for run in FORM.finditer(layer.text) if "%" in layer.text and "+" in layer.text else ():
        if "+" in run[0] and URL.search(run[0]):
            for m in FORM_PART.finditer(run[0]):
                at = np.zeros(1, np.int64) if m[0] == "+" else np.arange(0, len(m[0]), 3)
                new = " " if m[0] == "+" else bytes.fromhex(m[0].replace("%", "")).decode("latin-1")
                parts.append((run.start() + m.start(), run.start() + m.end(), new, at, at + (1 if m[0] == "+" else 3)))
    return layer.replaced(parts) if parts else None


def unicode_layer(layer: Layer) -> Layer | None:
    parts = []
    for m in UNICODE.finditer(layer.text):
        if m[3]:
            first, second = int(m[3], 16), int(m[4], 16) if m[4] else None
            if second is not None and 0xD800 <= first < 0xDC00 <= second < 0xE000:
                new, size = chr(0x10000 + ((first - 0xD800) << 10) + second - 0xDC00), [(0, 12)]
            elif second is not None:
                new, size = chr(first) + chr(second), [(0, 6), (6, 12)]
            else:
                new, size = chr(first), [(0, 6)]
        else:
            code = int(m[1] or m[2] or m[5] or m[6], 16)
            if code > 0x10FFFF:
                continue
            new, size = chr(code), [(0, m.end() - m.start())]
        at = np.array(size, np.int64)
        parts.append((m.start(), m.end(), new, at[:, 0], at[:, 1]))
    return layer.replaced(parts) if parts else None


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Where runs of base64 characters stand: on one line, and over lines of any width."""
    for m in BASE64.finditer(text):
        yield m.span()
    done = 0
    for m in LINE_END.finditer(text) if "\n" in text else ():
        a = m.start() - (text[m.start() - 1 : m.start()] == "\r")
        if m.start() < done or a < 1 or text[a - 1] not in ALPHABET:
            continue
        first = a
        while a and text[a - 1] in ALPHABET:
            a -= 1
        done = LINES.match(text, first).end()
        yield a, done


def base64_layers(layer: Layer) -> list[Layer]:
    """The bytes of runs, a character a byte, from each of the four places where a group of characters can start."""
    found, text = [], layer.text
    for a, b in runs(text):
        run = text[a:b].rstrip("=")
        where = None
        if "\n" in run:
            where = np.array([i for i, c in enumerate(run) if c in ALPHABET], np.int64)
            run = BREAK.sub("", run)
        if len(run) < 18:
            continue
        run = run.replace("-", "+").replace("_", "/")
        for phase in range(4):
            part = run[phase : len(run) - ((len(run) - phase) % 4 == 1)]
            data = binascii.a2b_base64(part + "=" * (-len(part) % 4))
            if not (TELLING.search(data) or MAGIC.search(data) or bare(data)):
                continue
            at = np.arange(len(data), dtype=np.int64)
            since, until = phase + at * 8 // 6, phase + (at * 8 + 13) // 6
            since, until = (since, until) if where is None else (where[since], where[until - 1] + 1)
            inner = layer.inner(data.decode("latin-1"), a + since, a + until)
            inner.end = int(layer.ends[b - 1])
            found.append(inner)
    return found


def compressed(layer: Layer, path: frozenset[bytes]) -> Iterator[Span]:
    """Spans of the compressed streams in a layer's decoded bytes, with each kind that they hold."""
    data, done = layer.text.encode("latin-1", "replace"), 0
    if layer.end is not None and bare(data):
        kinds = kinds_inside(lambda: Source(sliced(data)), path, lambda: zlib.decompressobj(-15))
        yield from ((int(layer.starts.min()), kind, layer.end) for kind in kinds)
    for m in MAGIC.finditer(data):
        k = m.start()
        if k < done or not layer.decoded[k]:
            continue
        source = Source(sliced(data, k))
        if not sum(map(len, expanded(source))):
            continue
        last = k + source.used
        kinds = kinds_inside(lambda: Source(sliced(data[:last], k)), path)  # noqa: B023
        done = last
        end = layer.end if last == len(data) and layer.end is not None else int(layer.ends[k:last].max())
        yield from ((int(layer.starts[k:last].min()), kind, end) for kind in kinds)


def scan(text: str | None, path: frozenset[bytes] = frozenset()) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: those and the ones found in decoded layers. path: hashes of the streams around the text."""
    if not text:
        return [], []
    plain = base(text)
    found, seen, work = set(plain), set(), deque([Layer.whole(text)])
    while work:
        layer = work.popleft()
        if layer.decoded.any():
            if (key := layer.key()) in seen:
                continue
            seen.add(key)
            for a, kind, b in base(layer.text):
                if layer.decoded[a:b].any():
                    found.add((int(layer.starts[a:b].min()), kind, int(layer.ends[a:b].max())))
            found.update(compressed(layer, path))
        work.extend(x for x in (url_layer(layer), form_layer(layer), unicode_layer(layer)) if x is not None)
        work.extend(base64_layers(layer))
    return plain, sorted(found)


def digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """`docs` with n_assign, n_access, n_hex and base_sha256 of the base spans, and spans: all of them."""

    def measure(texts: list[str | None]) -> list:
        both = [scan(t) for t in texts]
        counts = [[sum(k == kind for _, k, _ in plain) for plain, _ in both] for kind in range(3)]
        return [*counts, [hashlib.sha256(digest(plain).encode()).hexdigest() for plain, _ in both], [digest(every) for _, every in both]]

    return from_text(docs, [("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string")], measure)


def mask(docs: DataFrame, with_: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of its text replaced; overlapping spans count as one. Null texts stay null."""

    def hide(text: str | None) -> str | None:
        spans = scan(text)[1]
        if not spans:
            return text
        parts, at = [], 0
        for a, _, b in spans:
            if a >= at:
                parts += [text[at:a], with_]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    return from_text(docs, [], lambda texts: [[hide(t) for t in texts]], replace_text=True)
