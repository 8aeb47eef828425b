"""Token ids of whole texts by the tokenizers library, remembered by word.

Where a tokenizer's normalizer and pre-tokenizer drop white space and never look across it, the ids
of a text are the ids of its white-space-free chunks, one after the other. Chunks repeat far more
often than texts, so each task keeps a bounded memo of them. Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa

#: The scheme under which ids don't depend on what stands beyond white space.
_NORMALIZERS = ("NFC", "Replace", "Lowercase")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A chunk of Latin-1 letters between marks: three pre-tokens at most, unchanged by NFC.
_PLAIN = re.compile("([!-&(-/:-@\\[-`{-~]*)([a-zA-ZÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")


def version(path: str) -> str:
    """Digest of a tokenizer: its file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class Encoder:
    """encode(text) -> the ids as little-endian unsigned 32-bit integers.

    keep: chunks in a generation of the memo; two generations are held at most, so memory is bounded.
    """

    def __init__(self, path: str, keep: int = 250_000):
        from tokenizers import Tokenizer

        self.tok, self.keep = Tokenizer.from_file(path), keep
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_chunk = (
            tuple(s["type"] for s in steps) == _NORMALIZERS
            and steps[1].get("pattern") == {"Regex": r"\s+"}
            and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
            and pre[0].get("pattern") == {"Regex": _SPLIT}
            and not pre[1].get("add_prefix_space")
            and not pre[1].get("use_regex")
        )
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        # the byte-level alphabet of each Latin-1 letter, asked of the library itself
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, 0x100) if chr(c).isprintable() and unicodedata.is_normalized("NFC", chr(c))}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _miss(self, chunk: bytes) -> bytes:
        if (got := self.old.get(chunk)) is None:
            got = self._chunk(chunk)
        if len(self.young) >= self.keep:
            self.old = dict(self.young)
            self.young.clear()  # the same object: encode() holds its get
        self.young[chunk] = got
        return got

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if not (m := _PLAIN.fullmatch(text)):
            return self._whole(text)
        ids: list[int] = []
        for piece in m.groups():
            if piece:
                ids += [t.id for t in self.tok.model.tokenize(piece.lower().translate(self.alphabet))]
        return array("I", ids).tobytes()

    def encode(self, text: bytes | None) -> bytes:
        """ids of a text given as UTF-8; nothing for a null or empty one."""
        if not text:
            return b""
        if not self.by_chunk or any(s in text for s in self.special) or b"<|" in text:
            return self._whole(text.decode())
        get, miss = self.young.get, self._miss
        return b"".join([get(w) or miss(w) for w in text.lower().split()])


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker, kept for its next tasks."""
    if path not in _held:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _held.clear()
        _held[path] = Encoder(path)
    return _held[path]


def utf8(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    """The column's texts as bytes, one after the other: no second copy of all is made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return (x.as_py() for x in column.cast(kind))
