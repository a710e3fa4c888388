"""Token ids of whole texts, by the tokenizers library, with a memo of words.

The vocabulary's normaliser and splitter never join characters across a blank or a line feed, and never across the end
of a run of letters before a full stop or comma. So a text's ids are those of its chunks, put together; chunks repeat,
and each is encoded once for as long as the memo holds it. `tests/llm/test_tokens.py` holds this against the library's
own encoding of whole texts. A tokenizer file whose normaliser or splitter is another goes to the library text by text.

A worker keeps its memo from task to task, bounded in bytes, where the task isn't one that leaves nothing (packing): most
words of a task are new, so a kept memo saves little.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from struct import Struct

from calibrium.llm.common import keeps

TOKENIZER = "word_bpe_49k.json"
#: Bytes of a worker's memo, and of an entry besides its chunk and ids.
MEMO_BYTES, ENTRY_BYTES = 96 << 20, 190
LONGEST_HELD = 64
#: What the splitting into chunks takes for granted of a tokenizer file.
NORMALISER = ["NFC", "Replace", "Lowercase"]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_MARKS = ".,;:!?"
PACK = [Struct(f"<{n}I").pack for n in range(16)]
_TOKENIZERS: dict[str, tuple] = keeps({})


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _loaded(path: str) -> tuple:
    """This worker's tokenizer, and whether texts may be encoded chunk by chunk."""
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        steps = [x["type"] for x in (said.get("normalizer") or {}).get("normalizers", [])]
        first = (((said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern") or {}).get("Regex")
        special = all(x["content"].startswith("<|") for x in said.get("added_tokens", []))
        _TOKENIZERS[path] = Tokenizer.from_file(path), steps == NORMALISER and first == SPLITTER and special
    return _TOKENIZERS[path]


class Memo(dict):
    """ids of chunks in two generations: when the younger holds half of the bytes allowed it becomes the older one, whose
    chunks come back as they are met again."""

    def __init__(self, encoded, limit: int = MEMO_BYTES):
        self.encoded, self.limit, self.held, self.older = encoded, limit // 2, 0, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.encoded(chunk)
            if len(chunk) > LONGEST_HELD:
                return ids
        self.held += len(chunk) + len(ids) + ENTRY_BYTES
        if self.held > self.limit:
            self.older, self.held = dict(self), 0
            self.clear()
        self[chunk] = ids
        return ids


class WordEncoder:
    """ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, limit: int = MEMO_BYTES):
        self.tokenizer, self.by_chunk = _loaded(path)
        self.model = self.tokenizer.model
        self.chars = dict(enumerate(_byte_chars()))
        self.memo = Memo(self.chunk, limit)

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, piece: str) -> bytes:
        """A lower-case run that the splitter leaves whole."""
        if not piece.isascii() or not piece.isprintable():
            piece = piece.encode().decode("latin-1").translate(self.chars)
        found = self.model.tokenize(piece)
        return PACK[len(found)](*[t.id for t in found]) if len(found) < len(PACK) else array("I", [t.id for t in found]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """ids of a chunk without blanks and line feeds."""
        if chunk.isascii():
            if chunk.isalpha():
                return self._word(chunk.lower())
            if not chunk:
                return b""
            core = chunk.rstrip(_MARKS)
            if len(core) < len(chunk) and core.isalpha():
                return self.memo[core.lower()] + self.memo[chunk[len(core) :]]
            if "<|" in chunk or not chunk.isprintable():  # perhaps a special token
                return self.library(chunk)
            return b"".join(map(self._word, _ASCII_PIECES.findall(chunk.lower())))
        core = chunk.rstrip(_MARKS)
        if core.isalpha() and max(core) < "Ā" and "\xaa" not in core and "\xba" not in core and "\xb5" not in core:  # composed letters that only lower-casing changes
            return self._word(core.lower()) if len(core) == len(chunk) else self.memo[core.lower()] + self.memo[chunk[len(core) :]]
        return self.library(chunk)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk:
            return self.library(text)
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()  # so that fewer chunks differ; these letters have one lower form each
            except UnicodeEncodeError:
                pass
        return b"".join(map(self.memo.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, WordEncoder] = keeps({})


def encoder(path: str) -> WordEncoder:
    """This worker's encoder: kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
