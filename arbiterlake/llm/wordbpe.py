"""Word-level BPE with end-of-word symbols: the ids that the tokenizer file's own library gives, faster.

Texts split at blanks into chunks, chunks into pieces by the file's pattern, pieces into tokens. Chunks and
pieces are memoised, so most of a text is dictionary look-ups. Very long pieces, chunks with letters beyond
Latin and texts that hold an added token of the file are left to the library itself.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np
import regex

from .common import hold


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable Latin-1, else the next from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [hidden.get(b, chr(b)) for b in range(256)]


class WordBpe:
    """Encoder over the contents of a tokenizer file. ``encode(text)`` gives little-endian unsigned 32-bit ids as bytes."""

    END = "</w>"
    #: Entries of the two memos (about 200 bytes each) before they start anew, characters of what they keep, and bytes of a very long piece.
    CHUNKS, PIECES, KEPT, LONG = 300_000, 800_000, 64, 200

    def __init__(self, contents: str):
        from tokenizers import Tokenizer

        spec = json.loads(contents)
        self.library = Tokenizer.from_str(contents)
        assert not any(t["normalized"] for t in spec["added_tokens"]), "added tokens must be found in the text as it is"
        self.added = [t["content"] for t in spec["added_tokens"]]
        vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = {vocab[a + b]: i for i, (a, b) in enumerate(pairs)}
        assert list(order) == sorted(order), "merged ids must follow the merge order"
        #: pair of ids (first << 32 | second) -> id of the merged token; a lower id is an earlier merge
        self.merged = {vocab[a] << 32 | vocab[b]: vocab[a + b] for a, b in reversed(pairs)}
        self.pattern = regex.compile(next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"])
        self.inner = [vocab[c] for c in byte_symbols()]
        self.final = [vocab[c + self.END] for c in byte_symbols()]
        self.pieces: dict[str, bytes] = {}
        outer = self

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                made = outer._chunk(chunk)
                if len(chunk) <= outer.KEPT:
                    if len(self) >= outer.CHUNKS:
                        self.clear()
                    self[chunk] = made
                return made

        self.chunks = Chunks()

    def encode(self, text: str | None) -> bytes:
        if text and any(map(text.__contains__, self.added)):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" "))) if text else b""

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if not chunk.isascii():
            if max(chunk) > "ɏ":
                return np.array(self.library.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
            chunk = unicodedata.normalize("NFC", chunk)
        chunk, known = chunk.lower(), self.pieces
        if chunk.isalpha():  # what the pattern would find, without it
            found = (chunk,)
        elif chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            found = (chunk[:-1], chunk[-1])
        else:
            found = self.pattern.findall(chunk)
        return b"".join([known.get(piece) or self._piece(piece) for piece in found])

    def _piece(self, piece: str) -> bytes:
        """Merge the lowest-ranked adjacent pair, leftmost first, until none is left."""
        raw = piece.encode("utf-8")
        if len(raw) > self.LONG:
            return np.array(self.library.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
        find, none = self.merged.get, 1 << 40
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        pairs = [find(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while pairs and (token := min(pairs)) < none:
            at = pairs.index(token)
            ids[at] = token
            del ids[at + 1], pairs[at]
            if at < len(pairs):
                pairs[at] = find(token << 32 | ids[at + 1], none)
            if at:
                pairs[at - 1] = find(ids[at - 1] << 32 | token, none)
        made = array("I", ids).tobytes()
        if len(piece) <= self.KEPT:
            if len(known := self.pieces) >= self.PIECES:
                known.clear()
            known[piece] = made
        return made


_encoders: dict[int, WordBpe] = {}


def encoder(contents: str) -> WordBpe:
    """One encoder a process for the same file contents: memos live across tasks."""
    hold("wordbpe", _encoders.clear)
    key = hash(contents)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordBpe(contents)
    return _encoders[key]
