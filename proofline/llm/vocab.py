"""Token ids of the public tokenizers, with a bounded cache of words.

Both vocabularies split text at white space before they merge, so a text's ids are its chunks' ids in order.
A chunk of plain Latin letters, digits and punctuation is merged by tiktoken over the same merge ranks (it is
several times faster on single words); every other chunk goes to the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[!-~À-ÖØ-öø-ÿ]+")
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^0-9{LETTER}]+")
BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^ 0-9{LETTER}]+")
#: White space that str.split() knows beyond the six ASCII separators.
EXOTIC = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
ASCII_SPACE = re.compile("[\t-\r ]+")
#: A space between two characters that are surely not white space: the byte-level vocabulary splits there.
INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Any white space but the space and the line feed, or the mark that spaced() cuts at.
ODD_SPACE = re.compile(r"[^\S \n]|\0")
LETTERS = re.compile(rf"[{LETTER}]+")
SIMPLE = re.compile(rf"( ?[{LETTER}]+)([.,;:!?]*)")
HELD = 400_000  # chunks of a generation of the cache, some 200 bytes each
END = b"\xff"  # stands for the end of a word; no UTF-8 text holds it


def words(text: str) -> list[str]:
    """The maximal runs of characters other than \\x20 and \\x09-\\x0D."""
    if not EXOTIC.search(text):
        return text.split()
    return [w for w in ASCII_SPACE.split(text) if w]


def _byte_letters() -> dict[str, int]:
    """The public byte-to-letter rule of byte-level vocabularies: printable bytes stand for themselves, the rest from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """ids(chunk) as little-endian unsigned 32-bit bytes, from a cache of two generations of at most `held` chunks."""

    def __init__(self, path: str, held: int = HELD):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path, self.held = path, held
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = json.load(open(path, encoding="utf-8"))["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self._merges(model)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _merges(self, model: dict) -> None:
        """Merge ranks for tiktoken: a token's id is its rank, as ids follow the order of the merges (checked here)."""
        import tiktoken

        letters, end, vocab = _byte_letters(), self.suffix, model["vocab"]

        def raw(token: str) -> bytes:
            if end and token.endswith(end) and len(token) > len(end):
                return bytes(letters[c] for c in token[: -len(end)]) + END
            return bytes(letters[c] for c in token)

        joined = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        singles = {raw(c): vocab[c] for c in letters} | ({raw(c + end): vocab[c + end] for c in letters if letters[c] < 255} if end else {})
        if joined != sorted(set(joined)) or max(singles.values()) > joined[0]:
            raise ValueError(f"{self.path}: ids do not follow the merges")
        ranks = singles | {raw("".join(m if isinstance(m, list) else m.split(" "))): i for m, i in zip(model["merges"], joined, strict=True)}
        self.piece = tiktoken.Encoding("ranks", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _core(self, piece: str) -> bytes:
        return array("I", self.piece(piece.encode() + END if self.suffix else piece.encode())).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """ids of a chunk that the vocabulary's own splitting never joins with its neighbours."""
        found = self.old.get(chunk)
        if found is None:
            found = self._encode(chunk)
        if len(chunk) <= 64:
            if len(self.new) >= self.held:
                self.old = self.new.copy()
                self.new.clear()
            self.new[chunk] = found
        return found

    def _encode(self, chunk: str) -> bytes:
        if chunk.isalpha() and LETTERS.fullmatch(chunk):
            return self._core(chunk.lower() if self.suffix else chunk)
        if simple := SIMPLE.fullmatch(chunk):
            letters, marks = simple.groups()
            if marks:
                return self.chunk(letters) + self.chunk(marks)
            return self._core(letters)
        if PLAIN.fullmatch(chunk, chunk[:1] == " ") and "<|" not in chunk:
            return b"".join(map(self._core, PIECES.findall(chunk.lower()) if self.suffix else BYTE_PIECES.findall(chunk)))
        return array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()

    def text(self, text: str | None) -> bytes:
        """ids of a whole text; null counts as empty."""
        if not text:
            return b""
        get, chunk = self.new.get, self.chunk
        return b"".join([get(p) or chunk(p) for p in (words(text) if self.suffix else spaced(text))])


def spaced(text: str) -> list[str]:
    """Chunks of a text for the byte-level vocabulary, each word with its leading space."""
    if ODD_SPACE.search(text) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        first, *rest = INNER_SPACE.split(text)
        return [first, *[" " + x for x in rest]]
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


@lru_cache(maxsize=4)
def codec(path: str, held: int = HELD) -> Codec:
    """One codec a worker process and file."""
    return Codec(path, held)


def public_path(name: str) -> str:
    """Where a public tokenizer file lies, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def resolve(path: str) -> str:
    """A vocabulary path, or the name of a public one."""
    return path if os.sep in path else public_path(path)


@lru_cache(maxsize=4)
def pieces(path: str) -> list[str]:
    """The id-to-piece table of a vocabulary file; its size is the vocabulary's."""
    library = codec(path).library
    return [library.id_to_token(i) or "" for i in range(max(library.get_vocab(True).values(), default=-1) + 1)]
