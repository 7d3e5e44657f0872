"""Byte-level BPE encoding and decoding by longest match with backtracking.

Token bytes are mapped to Latin-1, one character a byte, so that an Aho-Corasick automaton over all tokens
finds every token that starts at a place. From left to right the longest one is taken if it is compatible
with the token before it: merging the bytes of the two from scratch gives exactly the two. Otherwise the
next shorter token starting there is tried, and when none is left the previous token gives way; places
found dead are not entered again, so the work is linear in the text. Whether two tokens are compatible is
memoised, as are whole pieces. The result is that of applying the merges by rank.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import ahocorasick
import regex
from pyspark.sql import DataFrame

from .common import hold, map_arrow


def parse_ranks(contents: str) -> dict[bytes, int]:
    """Token bytes to rank from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in contents.splitlines() if line.strip())}


class ByteBpe:
    """Codec of a rank table and a pattern that cuts texts into pieces."""

    #: Entries of the memos of pieces and of pairs before they start anew; characters of a piece that is kept.
    PIECES, PAIRS, LONG = 400_000, 1_000_000, 64

    def __init__(self, contents: str, pattern: str):
        self.rank = parse_ranks(contents)
        self.token = {i: t for t, i in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.text = {i: str(i) for i in self.token}
        self.single = [self.rank[bytes([b])] for b in range(256)]
        self.shorter = {i: next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), None) for t, i in self.rank.items()}
        self.size = {i: len(t) for t, i in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        outer = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                made = tuple(outer.piece(piece.encode("utf-8")))
                if len(piece) <= outer.LONG:
                    if len(self) >= outer.PIECES:
                        self.clear()
                    self[piece] = made
                return made

        self.pieces = Pieces()

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text)))) if text else []

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def piece(self, raw: bytes) -> list[int]:
        if (whole := self.rank.get(raw)) is not None:
            return [whole]
        n, size, shorter = len(raw), self.size, self.shorter
        longest = [0] * n
        for end, i in self.automaton.iter(raw.decode("latin-1")):
            longest[end - size[i] + 1] = i  # matches come by end, so the last one of a start is its longest
        made: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while at < n:
            if token is not None and (at + size[token] in dead or made and not self.compatible(made[-1], token)):
                token = shorter[token]
            elif token is None:
                dead.add(at)
                token = made.pop()
                at -= size[token]
                token = shorter[token]
            else:
                made.append(token)
                at += size[token]
                if at < n:
                    token = longest[at]
        return made

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= self.PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.token[left] + self.token[right]) == [left, right]
        return known

    def merge(self, raw: bytes) -> list[int]:
        """The merges from scratch, for the bytes of two tokens: lowest rank first, leftmost first."""
        find, none = self.rank.get, 1 << 40
        parts = [raw[i : i + 1] for i in range(len(raw))]
        ranks = [find(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = find(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = find(parts[i - 1] + parts[i], none)
        return [self.rank[p] for p in parts]


_codecs: dict[int, ByteBpe] = {}


def codec(contents: str, pattern: str) -> ByteBpe:
    """One codec a process for the same vocabulary: memos live across tasks."""
    hold("bytebpe", _codecs.clear)
    key = hash((contents, pattern))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = ByteBpe(contents, pattern)
    return _codecs[key]


def encode_documents(df: DataFrame, contents: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) for every row.

    A null or empty text has none; very long texts are encoded whole; null ids pass through; repeated rows
    correspond one to one; other columns are not read; an empty table gives an empty result.
    """
    id_type = dict(df.dtypes)[id_col]

    def run(batch):
        encode = codec(contents, pattern).encode
        return {id_col: batch.column(id_col), "ids": [encode(t) for t in batch.column(text_col).to_pylist()]}

    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {id_type}, ids array<int>")


def decode_documents(df: DataFrame, contents: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``raw`` (the decoded bytes) for every row.

    A null or empty ``ids_col`` decodes to nothing; very long ones are decoded whole; nulls in ``id_col`` pass
    through; repeated rows correspond one to one; other columns are not read; an empty table gives an empty result.
    """
    id_type = dict(df.dtypes)[id_col]

    def run(batch):
        decode = codec(contents, pattern).decode
        return {id_col: batch.column(id_col), "raw": [decode(i or ()) for i in batch.column(ids_col).to_pylist()]}

    return map_arrow(df.select(id_col, ids_col), run, f"`{id_col}` {id_type}, raw binary")


def digest_documents(df: DataFrame, contents: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` and SHA-256 of the ids (decimal, joined by blanks) and of the bytes they decode to.

    Encodes and decodes every whole text where it is, so that neither ids nor bytes leave the task. A null or
    empty text has no tokens and the digests of nothing; very long texts are taken whole; null ids pass through; repeated rows correspond one
    to one; other columns are not read; an empty table gives an empty result.
    """
    id_type = dict(df.dtypes)[id_col]

    def run(batch):
        own = codec(contents, pattern)
        count, ids_sha, raw_sha = [], [], []
        for text in batch.column(text_col).to_pylist():
            ids = own.encode(text)
            count.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(own.text.__getitem__, ids)).encode()).hexdigest())
            raw_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return {id_col: batch.column(id_col), "n_tokens": count, "ids_sha256": ids_sha, "decoded_sha256": raw_sha}

    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
