"""Cutting texts where a byte-level tokenizer cuts anyway, so that pieces can be cached.

Both tokenizers of this subpackage split a text by the same pattern before merging.  A
blank that has a non-white character on either side always starts a new match there, so
the text between two such blanks can be encoded on its own and its ids reused.  What many
texts miss in the cache is gathered and encoded in one call.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TIGHT = re.compile(r"\s \s")
_SAFE = re.compile(r"(?<=\S)(?= )")
MAX_CACHED = 48           # longer pieces are encoded each time
MAX_ENTRIES = 300_000     # of one generation of a cache
GATHER_CHARS = 2_000_000  # texts whose misses are gathered; a longer text is alone
_TEXT, _IDS = pa.large_string(), pa.large_binary()


def joined(values: pa.Array) -> tuple[np.ndarray, memoryview]:
    """The bytes of a whole ``large_binary`` array in a row, and where each value begins (and the last one ends)."""
    if not len(values):
        return np.zeros(1, np.int64), memoryview(b"")
    _, offsets, raw = values.buffers()
    return np.frombuffer(offsets, np.int64, len(values) + 1, 8 * values.offset), memoryview(raw or b"")


def _listed(values: pa.Array) -> list:
    """``to_pylist`` without a scalar object for every value."""
    return values.to_numpy(zero_copy_only=False).tolist()


class Generations:
    """A bounded map that forgets what was not asked for lately.

    Entries go to the young generation, and old ones that are asked for again move there; a
    full young generation becomes the old one.
    """

    def __init__(self):
        self.young, self.old = {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value) -> None:
        self.young[key] = value
        if len(self.young) >= MAX_ENTRIES:
            self.young, self.old = {}, self.young


class PieceCache:
    """Generations of pieces and their ids as Arrow arrays, asked for many pieces at a time.

    An entry takes its text, its ids and two offsets, without an object of its own: several
    workers share an executor's memory and keep their caches between tasks.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], blank: str):
        self._encode_many, self._blank = encode_many, blank
        self.young, self._young_ids = pa.array([], _TEXT), pa.array([], _IDS)
        self.old, self._old_ids = self.young, self._young_ids

    def ids_of(self, pieces: pa.Array) -> pa.Array:
        """The ids of every piece, in order; what no generation has is encoded in one call."""
        coded = pieces.dictionary_encode()
        return self._learn(coded.dictionary).take(coded.indices)

    def _learn(self, keys: pa.Array) -> pa.Array:
        at = pc.index_in(keys, value_set=self.young)
        missing = keys.filter(at.is_null())
        old = pc.index_in(missing, value_set=self.old)
        again, new = missing.filter(old.is_valid()), missing.filter(old.is_null())
        encoded = self._encode_many([self._blank + x for x in _listed(new)]) if len(new) else []
        ids = pa.concat_arrays([self._young_ids, self._old_ids.take(old.drop_null()), pa.array(encoded, _IDS)])
        # those found in the old generation stand behind the young ones, the new ones behind them
        first = len(self.young)
        moved = old.is_valid().to_numpy(zero_copy_only=False)
        behind = np.where(moved, first + np.cumsum(moved) - 1, first + len(again) + np.cumsum(~moved) - 1)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[at.is_null().to_numpy(zero_copy_only=False)] = behind
        self._keep(pa.concat_arrays([again, new]), ids)
        return ids.take(pa.array(place))

    def _keep(self, added: pa.Array, ids: pa.Array) -> None:
        short = pc.less_equal(pc.utf8_length(added), MAX_CACHED)
        first = len(self.young)
        self.young = pa.concat_arrays([self.young, added.filter(short)])
        self._young_ids = pa.concat_arrays([self._young_ids, ids.slice(first).filter(short)])
        if len(self.young) >= MAX_ENTRIES:
            self.old, self._old_ids = self.young, self._young_ids
            self.young, self._young_ids = pa.array([], _TEXT), pa.array([], _IDS)


class PieceEncoder:
    """texts -> ids as uint32 little-endian bytes, by ``encode_many`` over distinct pieces."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]]):
        self._heads, self._rest = PieceCache(encode_many, ""), PieceCache(encode_many, " ")

    @staticmethod
    def _cut(texts: Iterable[str]) -> tuple[list[str], pa.Array]:
        """Of every text the first piece, and the list of the others without their blank."""
        heads, tails, tight = [], [], {}
        for i, text in enumerate(texts):
            if _TIGHT.search(text):
                head, *rest = _SAFE.split(text)
                tight[i] = [x[1:] for x in rest]
                tails.append(None)
            else:
                head, blank, tail = text.partition(" ")
                tails.append(tail if blank else None)
            heads.append(head)
        split = pc.split_pattern(pa.array(tails, _TEXT), " ")
        if tight:
            split = pc.coalesce(split, pa.array([tight.get(i) for i in range(len(tails))], split.type))
        return heads, split

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        heads, split = self._cut(texts)
        first = _listed(self._heads.ids_of(pa.array(heads, _TEXT)))
        offsets, raw = joined(self._rest.ids_of(split.flatten()))
        at = offsets[np.cumsum(split.value_lengths().fill_null(0).to_numpy())].tolist()
        return [head + raw[a:b] for head, a, b in zip(first, [0, *at], at, strict=False)]


def in_groups(rows: Iterable[tuple[object, str]]) -> Iterator[list[tuple[object, str]]]:
    """(key, text) rows in groups of about ``GATHER_CHARS`` characters."""
    group, size = [], 0
    for row in rows:
        group.append(row)
        size += len(row[1])
        if size >= GATHER_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group
