"""Byte-level BPE by ranks: longest matches and backtracking, in linear time.

Bytes are written as Latin-1 characters, so that an Aho-Corasick automaton over the
vocabulary finds every token that starts at a position.  A sequence of tokens is what the
merges give exactly when every two neighbours are compatible, that is when merging their
joined bytes gives the two back.  So the longest token is taken; if it is not compatible
with the one before, the next shorter prefix; if none is left, the last token is undone.
A position that led nowhere is never entered again, which bounds the work by the length.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import batches, give_back, keep_only, kept
from listforge.llm.pieces import Generations, PieceEncoder, in_groups, joined
from listforge.session import ship_package


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class RankBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._memo = Generations()
        # a token that its own merges do not give back never stands in a result
        sound = {b: i for b, i in ranks.items() if len(b) == 1 or self._merge(b, whole=False) == [i]}
        self._automaton = ahocorasick.Automaton()
        for b, i in sound.items():
            self._automaton.add_word(b.decode("latin-1"), (len(b), i))
        self._automaton.make_automaton()
        self._shorter: dict[int, int] = {}
        for b, i in sound.items():
            for n in range(len(b) - 1, 0, -1):
                if b[:n] in sound:
                    self._shorter[i] = sound[b[:n]]
                    break

    def _merge(self, raw: bytes, whole: bool = True) -> list[int]:
        """Lowest rank first, leftmost on ties: the definition, for short strings."""
        if whole and raw in self.ranks:
            return [self.ranks[raw]]
        parts = [raw[i:i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        got = self._memo.get(key)
        if got is None:
            got = self._merge(self.bytes_of[a] + self.bytes_of[b], whole=False) == [a, b]
            self._memo.put(key, got)
        return got

    def encode_piece(self, raw: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        direct = self.ranks.get(raw)
        if direct is not None:
            return [direct]
        n = len(raw)
        longest: list[tuple[int, int] | None] = [None] * n
        for end, hit in self._automaton.iter(raw.decode("latin-1")):
            start = end - hit[0] + 1
            if longest[start] is None or hit > longest[start]:
                longest[start] = hit
        alive, out, pos = bytearray(b"\1") * (n + 1), [], 0
        bytes_of, compatible = self.bytes_of, self._compatible
        token = longest[0][1]
        while pos < n:
            end = pos + len(bytes_of[token])
            if alive[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                pos = end
                if pos < n:
                    token = longest[pos][1]
                continue
            shorter = self._shorter.get(token)
            while shorter is None:
                alive[pos] = 0
                token = out.pop()
                pos -= len(bytes_of[token])
                shorter = self._shorter.get(token)
            token = shorter
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class RankDecoder:
    """Ids as uint32 little-endian bytes -> the bytes they stand for; no more than a table of the tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        of = {i: b for b, i in ranks.items()}
        self._ids = np.array(sorted(of), dtype=np.int64)
        self._tokens = pa.array([of[i] for i in self._ids.tolist()], pa.large_binary())
        self._dense = bool(len(of)) and self._ids[0] == 0 and self._ids[-1] == len(of) - 1

    def decode(self, ids: bytes) -> bytes:
        at = given = np.frombuffer(ids, "<u4")
        if not self._dense:
            at = np.searchsorted(self._ids, given)
        known = at < len(self._ids)
        if not known.all() or not np.array_equal(self._ids[at], given):
            raise KeyError("an id that no token has")
        offsets, raw = joined(self._tokens.take(pa.array(at)))
        return raw[:offsets[-1]].tobytes()


_CODECS: dict[tuple[str, str], tuple[RankBpe, PieceEncoder]] = kept()
_DECODERS: dict[str, RankDecoder] = kept()


def codec(path: str, pattern: str) -> tuple[RankBpe, PieceEncoder]:
    """One per worker, vocabulary file and pattern."""
    keep_only(_CODECS, _DECODERS)
    if (path, pattern) not in _CODECS:
        bpe, split = RankBpe(load_ranks(path)), regex.compile(pattern).findall

        def encode_many(pieces: list[str]) -> list[bytes]:
            found: dict[str, bytes] = {}  # a match that several of the pieces have is encoded once

            def ids_of(match: str) -> bytes:
                got = found.get(match)
                if got is None:
                    ids = bpe.encode_piece(match.encode())
                    got = found[match] = struct.pack(f"<{len(ids)}I", *ids)
                return got

            return [b"".join(map(ids_of, split(p))) for p in pieces]

        _CODECS[path, pattern] = bpe, PieceEncoder(encode_many)
    return _CODECS[path, pattern]


def decoder(path: str) -> RankDecoder:
    """One per worker and vocabulary file."""
    keep_only(_CODECS, _DECODERS)
    if path not in _DECODERS:
        _DECODERS[path] = RankDecoder(load_ranks(path))
    return _DECODERS[path]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, uint32 little-endian): one row per input row, null text as empty.

    No special tokens: their strings are ordinary text.  Null ids and repeated rows are
    encoded like others; other columns are not looked at.
    """
    ship_package(docs.sparkSession)

    def encode(rows):
        make = batches({"doc_id": pa.int64(), "ids": pa.binary()})
        _, encoder = codec(ranks_path, pattern)
        for batch in rows:
            texts = zip(batch.column(0).to_pylist(), (t.as_py() or "" for t in batch.column(1)), strict=True)
            for group in in_groups(texts):
                names, texts_of = zip(*group, strict=True)
                del group
                yield make(list(zip(names, encoder.encode_all(texts_of), strict=True)))
                del names, texts_of
                give_back()
            del batch

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encode_documents`` rows."""
    ship_package(encoded.sparkSession)

    def decode(rows):
        make = batches({"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(),
                        "decoded_sha256": pa.string()})
        ranks = decoder(ranks_path)
        for batch in rows:
            out = []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = ids.as_py()
                out.append((name, len(raw) // 4, hashlib.sha256(raw).hexdigest(),
                            hashlib.sha256(ranks.decode(raw)).hexdigest()))
                del ids, raw
            del batch
            yield make(out)
            give_back()

    return encoded.mapInArrow(
        decode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
