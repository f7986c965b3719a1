"""Operator 4 on layers whose secrets and spans are known."""

import base64
import bz2
import gzip
import hashlib
import io
import lzma
import random
import re
import urllib.parse
import zipfile
import zlib

import pytest
import zstandard

from proofline.llm import secrets

SECRET = "password=hunter2hunter2"
b64 = lambda b: base64.b64encode(b).decode()


def brute(text):
    """The base rules, straight from their wording."""
    out = []
    patterns = (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
    for kind, (p, least, group, flags) in enumerate(zip(patterns, (8, 16, 32), (2, 0, 0), (re.I | re.A, 0, 0), strict=True)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(p, text, flags) if len(m[group]) >= least]
    return sorted(out)


@pytest.mark.parametrize("text", ["", "token: abc", 'Secret = "abcdefgh"', "API_KEY:abcdefghi", "token=\"secret: abcdefgh\"", "AKIAAKIA1234AKIA99 AKIA123", "0" * 31 + "g" + "a" * 32, "paſſword=abcdefgh", "token=abc\u0130 passwd:'xyzxyzxyz'", "é secret==========="])
def test_base(text):
    assert secrets.scan(text)[0] == brute(text)


def span(text, part):
    return (text.index(part), 0, text.index(part) + len(part))


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: b64(s.encode()), lambda s: b64(gzip.compress(s.encode())), lambda s: b64(zlib.compress(s.encode())), lambda s: b64(bz2.compress(s.encode())), lambda s: b64(lzma.compress(s.encode())),
        lambda s: b64(b64(s.encode()).encode()), lambda s: "".join(f"%{b:02X}" for b in s.encode()), lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: urllib.parse.quote(b64(("x " + s + " y").encode()), safe=""), lambda s: b64(gzip.compress(b64(gzip.compress(s.encode())).encode())), lambda s: "".join(f"%{b:02X}" for b in "".join(f"%{b:02X}" for b in s.encode()).encode()),
    ],
)
def test_layers(wrap):
    inner = wrap(SECRET)
    text = f"né clean words {inner} end"
    plain, every = secrets.scan(text)
    a, b = text.index(inner), text.index(inner) + len(inner)
    new = [x for x in every if x not in plain]
    assert new and all(a <= s and e <= b for s, _, e in new)


def test_spans_map_back():
    text = "go token%3Dabcdefgh9 end"
    assert secrets.scan(text)[1] == [(3, 0, 20)]
    inner = b64(("some text before " + SECRET).encode())
    text = "aa " + inner + " bb"
    [(a, _, b)] = secrets.scan(text)[1]
    assert base64.b64decode(inner)[(a - 3) * 6 // 8 : (b - 3) * 6 // 8].decode().strip().endswith(SECRET[-5:]) and a > 3 + 20
    assert secrets.scan("clean prose with %41 and \\u0041 and aGVsbG8gd29ybGQgaGVsbG8gd29ybGQ=")[1] == []


def test_table(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x " + SECRET, "c"), (4, "z" * 200_000 + " AKIA" + "B" * 16, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.spans): r for r in secrets.find(df).collect()}
    assert set(got) == {(1, ""), (2, ""), (None, f"assign:2:{2 + len(SECRET)}"), (4, "access:200001:200021")}
    assert got[1, ""].base_sha256 == hashlib.sha256(b"").hexdigest() and got[4, "access:200001:200021"].n_access == 1
    assert secrets.find(df).count() == 5 and secrets.find(df.limit(0)).count() == 0
    masked = {r.doc_id: r.text for r in secrets.mask(df).collect()}
    assert masked[None] == "x [SECRET]" and masked[1] is None and masked[2] == ""


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_whole_streams(pack, monkeypatch):
    """All members are read, and content beyond a piece is scanned without splitting a match or an encoded run."""
    text = "aa " + b64(pack(b"a header, clean\n") + pack(SECRET.encode())) + " bb"
    assert secrets.scan(text)[1][0] == (3, 0, len(text) - 3)
    for piece in (16, 100, 1000):
        monkeypatch.setattr(secrets, "PIECE", piece)
        for content in ("some words, and more\n" * 50 + SECRET, "k=v\n" * 99 + b64(SECRET.encode()) + "\n" + "k=v\n" * 99, "word " * 200 + SECRET + " word" * 200, "a.b\n" + "\n".join(re.findall(".{1,76}", b64(b"x" * 400 + SECRET.encode()))) + "\nc.d\n" * 50):
            text = "aa " + b64(pack(content.encode())) + " bb"
            assert [k for _, k, _ in secrets.scan(text)[1]] and secrets.scan(text)[1][0] == (3, 0, len(text) - 3)


@pytest.mark.parametrize("inner", [b"\x1b[31m" + SECRET.encode(), b"caf\xe9 " + SECRET.encode(), b"\0\x7f " + SECRET.encode() + b" \xff", "é ".encode("latin-1") * 9 + SECRET.encode()])
def test_layers_that_are_not_clean_text(inner):
    for text in ("aa " + b64(inner) + " bb", "aa " + b64(gzip.compress(inner)) + " bb"):
        [(a, kind, b)] = secrets.scan(text)[1]
        assert kind == 0 and 3 <= a < b <= len(text) - 3


@pytest.mark.parametrize("before", ["https://host.example/path/", "key:v1/", "a-", "ab_", "abc", "abcd/"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress])
def test_runs_out_of_phase(before, pack):
    text = "see " + before + b64(pack(SECRET.encode())) + " end"
    spans = secrets.scan(text)[1]
    assert spans and all(len(text) - 4 >= b > a >= 4 + len(before) for a, _, b in spans)


@pytest.mark.parametrize("width", [4, 10, 20, 59, 76])
@pytest.mark.parametrize("line", ["\n", "\r\n", "\n  "])
def test_wrapped_lines(width, line):
    for data in (SECRET.encode(), gzip.compress(SECRET.encode() + bytes(range(256)))):
        assert secrets.scan("head:" + line + line.join(re.findall(f".{{1,{width}}}", b64(data))) + "\n.")[1]


def test_compressed_bytes_in_escapes():
    data = gzip.compress(SECRET.encode())
    for inner in ("".join(f"%{b:02X}" for b in data), urllib.parse.quote(data), "".join(f"\\x{b:02x}" for b in data), "".join(f"\\u{b:04x}" for b in data)):
        assert secrets.scan("aa " + inner + " bb")[1] == [(3, 0, 3 + len(inner))]


def zipped(data: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("notes.txt", data)
    return out.getvalue()


def deflated(data: bytes) -> bytes:
    d = zlib.compressobj(9, zlib.DEFLATED, -15)
    return d.compress(data) + d.flush()


PACKS = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress, zipped]


@pytest.mark.parametrize("inner", PACKS)
@pytest.mark.parametrize("outer", [gzip.compress, zstandard.compress, zipped])
def test_streams_anywhere_in_expanded_data(inner, outer, monkeypatch):
    noise = bytes(random.Random(3).randbytes(9000)).replace(b"=", b"-")
    for before in (b"header text ", b"x" * 5000, noise):
        for content in (SECRET.encode(), b"clean words " * 3000 + SECRET.encode()):
            text = "aa " + b64(outer(before + inner(content) + b" tail " + noise[:50])) + " bb"
            end = 0 if outer is zipped else len(text) - 3  # a ZIP file goes on after its member
            assert any(a == 3 and k == 0 and b in (end or b, len(text) - 3) for a, k, b in secrets.scan(text)[1])
    monkeypatch.setattr(secrets, "WINDOW", 16)
    monkeypatch.setattr(secrets, "PIECE", 64)
    text = "aa " + b64(outer(b"header text " + inner(noise[:300] + SECRET.encode()) + inner(b"AKIA" + b"B" * 16))) + " bb"
    assert {k for _, k, _ in secrets.scan(text)[1]} == {0, 1}
    assert secrets.scan("aa " + b64(outer(b"header " + inner(b"clean words") + noise[:200])) + " bb")[1] == []


def test_members_and_bare_streams():
    for pack in (zipped, deflated):
        for content in (SECRET.encode(), b"clean " * 40_000 + SECRET.encode()):
            text = "aa " + b64(pack(content)) + " bb"
            assert any(a == 3 and k == 0 and (b == len(text) - 3 or pack is zipped) for a, k, b in secrets.scan(text)[1])
    assert secrets.scan("aa " + urllib.parse.quote(b64(deflated(SECRET.encode())), safe="") + " bb")[1]
    assert secrets.scan("aa " + b64(deflated(b"clean words, nothing else")) + " bb")[1] == []


def test_forms_and_percent_u():
    assert secrets.scan("go secret+%3A+abcdefgh1234 end")[1] == [(3, 0, 26)]
    assert secrets.scan("go %u0073ecret=abcdefgh1 end")[1] == [(3, 0, 24)]
    assert secrets.scan("a+b %41 secret + : + abcdefgh1234")[1] == []


def test_stream_that_holds_itself():
    """A gzip file whose content is itself ends at once."""
    quine = bytes.fromhex("1f8b0800000000000003")
    secrets.scan("aa " + b64(quine + gzip.compress(quine)) + " bb")


def worklist(text):
    """All spans of URL, form, Unicode and base64 layers, on lists of (character, from, to, decoded), one step at a time."""
    found, seen, work = set(), set(), [[(c, i, i + 1, False) for i, c in enumerate(text)]]
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    while work:
        layer = work.pop()
        key = tuple(layer)
        if key in seen:
            continue
        seen.add(key)
        s = "".join(c[0] for c in layer)
        for a, k, b in brute(s):
            if s == text and not any(c[3] for c in layer) or any(c[3] for c in layer[a:b]):
                found.add((min(c[1] for c in layer[a:b]), k, max(c[2] for c in layer[a:b])))
        whole = lambda part, new: [(new, min(c[1] for c in part), max(c[2] for c in part), True)]
        for form in (False, True):
            out, i = [], 0
            inside = [False] * len(s)
            for m in re.finditer(r"[!-~]+", s):
                if form and "+" in m[0] and re.search("%[0-9A-Fa-f]{2}", m[0]):
                    inside[m.start() : m.end()] = [True] * len(m[0])
            while i < len(s):
                if (not form or inside[i]) and re.match("%[0-9A-Fa-f]{2}", s[i : i + 3]):
                    out += whole(layer[i : i + 3], chr(int(s[i + 1 : i + 3], 16)))
                    i += 3
                elif inside[i] and s[i] == "+":
                    out += whole(layer[i : i + 1], " ")
                    i += 1
                else:
                    out.append(layer[i])
                    i += 1
            if out != layer and (not form or any(inside)):
                work.append(out)
        out, i = [], 0
        while i < len(s):
            if m := re.match(r"(?:\\u|%u)([0-9A-Fa-f]{4})", s[i:]):
                out += whole(layer[i : i + 6], chr(int(m[1], 16)))
                i += 6
            else:
                out.append(layer[i])
                i += 1
        if out != layer:
            work.append(out)
        for m in re.finditer(r"[A-Za-z0-9+/_-]{18,}", s):
            run, own = m[0].replace("-", "+").replace("_", "/"), layer[m.start() : m.end()]
            for phase in range(4):
                bits = "".join(f"{alphabet.index(c):06b}" for c in run[phase:])
                n = len(bits) // 8
                part = [(chr(int(bits[8 * i : 8 * i + 8], 2)), own[phase + 8 * i // 6][1], own[phase + (8 * i + 7) // 6][2], True) for i in range(n)]
                if part and sum(c[0].isascii() for c in part) > 0.9 * len(part):  # others hold no secret here
                    work.append(part)
    return sorted(found)


@pytest.mark.parametrize("seed", range(12))
def test_exact_spans_of_nested_layers(seed):
    rng = random.Random(seed)
    wraps = [
        lambda s: b64(s.encode()), lambda s: urllib.parse.quote(s, safe=""), lambda s: urllib.parse.quote_plus("x: " + s + " +"), lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: "".join(f"%u{ord(c):04X}" if rng.random() < 0.3 else c for c in s), lambda s: b64(("some words " + s).encode()), lambda s: "".join(f"%{b:02x}" for b in s.encode()),
    ]
    inner = rng.choice([SECRET, "token: abcdefgh99", "AKIA" + "Q7" * 8, "key " + "0a" * 17])
    for _ in range(rng.randrange(1, 4)):
        inner = rng.choice(wraps)(inner)
    text = "né words " + inner + " and secret=plainplain end"
    assert secrets.scan(text)[1] == worklist(text)
