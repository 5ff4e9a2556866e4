"""Token ids in binary shards with Elias-Fano document boundaries.

A shard is one byte string: a header, the document ids, the document ends as an
Elias-Fano sequence (low bits packed, high parts in unary), a select directory and the
concatenated token ids (two bytes an id when the vocabulary allows it).  With n documents
over u ids the boundaries take about n (2 + log2(u/n)) bits instead of 64 n.  Shards are
rows of a Parquet table, ordered by (part, shard); ``start`` of a document is the total of
all ids before it.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import batches, give_back, keep_only, kept, small
from listforge.llm.pieces import PieceEncoder, in_groups
from listforge.session import scratch_path, ship_package

END_ID = 2
SHARD_IDS = 500_000     # a shard is closed once it holds this many ids
_MAGIC = b"EFT1"
_HEADER = struct.Struct("<4sBBHQQQ")   # magic, id bytes, low bits, select step, docs, ids, high bytes
_SELECT_STEP = 64


class EliasFano:
    """A non-decreasing sequence below 2**62 in near-minimal space, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        bits = max(0, int(universe // n).bit_length() - 1) if n else 0
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel())
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary), ones[::_SELECT_STEP].astype("<u8"))

    def _low(self, i: int, j: int) -> np.ndarray:
        b = self.low_bits
        if not b:
            return np.zeros(j - i, dtype=np.int64)
        first = i * b // 8
        raw = np.unpackbits(self.low[first:(j * b + 7) // 8])
        own = raw[i * b - first * 8: j * b - first * 8].reshape(j - i, b)
        return own.astype(np.int64) @ (np.int64(1) << np.arange(b, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value: from the sampled one bit before it, count ones forward."""
        at, left = int(self.samples[i // _SELECT_STEP]), i % _SELECT_STEP
        byte = at // 8
        skip, width = at - byte * 8, 16
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte:byte + width])[skip:])
            if len(ones) > left:
                return int(((at + int(ones[left]) - i) << self.low_bits) + self._low(i, i + 1)[0])
            width *= 2

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high))[:self.n]
        return ((ones - np.arange(self.n)) << self.low_bits) + self._low(0, self.n)


def pack_shard(doc_ids: list, ends: list[int], ids: bytes, id_bytes: int) -> bytes:
    """ids: uint32 little-endian; doc_ids may hold null."""
    ef = EliasFano.build(np.array(ends, dtype=np.uint64), ends[-1] if ends else 0)
    tokens = np.frombuffer(ids, dtype="<u4")
    null = np.packbits(np.array([d is None for d in doc_ids], dtype=np.uint8))
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    head = _HEADER.pack(_MAGIC, id_bytes, ef.low_bits, _SELECT_STEP, ef.n, len(tokens), len(ef.high))
    body = tokens.astype("<u2") if id_bytes == 2 else tokens
    return b"".join(x if isinstance(x, bytes) else x.tobytes() for x in
                    (head, names, null, ef.low, ef.high, ef.samples, body))


def unpack_shard(blob: bytes) -> tuple[list, EliasFano, np.ndarray]:
    """(document ids, ends, token ids) of a shard."""
    magic, width, low_bits, step, n, total, high_bytes = _HEADER.unpack_from(blob)
    if magic != _MAGIC or step != _SELECT_STEP:
        raise ValueError("not a token shard")
    at = _HEADER.size

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(blob, dtype=kind, count=count, offset=at)
        at += got.nbytes
        return got

    names, null = take(n, "<i8"), np.unpackbits(take((n + 7) // 8, "u1"))[:n]
    low, high = take((n * low_bits + 7) // 8, "u1"), take(high_bytes, "u1")
    ef = EliasFano(n, low_bits, low, high, take((n + step - 1) // step, "<u8"))
    ids = take(total, f"<u{width}")
    return [None if x else int(d) for d, x in zip(names, null, strict=True)], ef, ids


#: what every tokenizer takes for white (Python alone adds U+001C to U+001F)
_WHITE_END = re.compile(r"(?<![^\S\x1c-\x1f])[^\S\x1c-\x1f]+\Z")


class TextEncoder:
    """texts -> ids as uint32 little-endian bytes, as the library encodes them with no tokens added.

    The library takes the added tokens of its file out of a text first and encodes what
    stands between them by itself: so the text is cut there before it is cut into pieces,
    and white space before such a token, or at the end, is one match.
    """

    def __init__(self, pieces: PieceEncoder, whole, added: dict[str, int], simple: bool):
        self._pieces, self._whole, self._simple = pieces, whole, simple
        self._ids = {word: struct.pack("<I", i) for word, i in added.items()}
        longest = sorted(filter(None, added), key=len, reverse=True)
        self._added = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def encode_all(self, texts) -> list[bytes]:
        runs: list[str] = []  # what the piece encoder is asked, in order
        out = [self._parts(text, runs) for text in texts]
        ids = iter(self._pieces.encode_all(runs))
        return [b"".join([next(ids) if part is None else part for part in parts]) for parts in out]

    def _parts(self, text: str, runs: list[str]) -> list[bytes | None]:
        """The text's ids in parts; None stands for the next of ``runs``."""
        if self._added is None or not self._added.search(text):
            return self._between(text, runs)
        if not self._simple:
            return [self._whole(text)]
        return [part for i, x in enumerate(self._added.split(text))
                for part in ([self._ids[x]] if i % 2 else self._between(x, runs))]

    def _between(self, text: str, runs: list[str]) -> list[bytes | None]:
        end = _WHITE_END.search(text) if text[-1:].isspace() else None
        runs.append(text[:end.start()] if end else text)
        return [None, self._whole(end[0])] if end else [None]


_ENCODERS: dict[str, TextEncoder] = kept()


def _library_encoder(path: str) -> TextEncoder:
    """The tokenizers library behind a piece cache; one per worker and file."""
    keep_only(_ENCODERS)
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        added = list(tok.get_added_tokens_decoder().items())
        # tokens that take white space along, stand for whole words only or hold white space: the library's business
        simple = tok.normalizer is None and not any(
            t.lstrip or t.rstrip or t.single_word or any(map(str.isspace, t.content)) for _, t in added)
        blank = "Ġ"  # how byte-level vocabularies write a blank
        starts = np.zeros(tok.get_vocab_size() + 1, dtype=bool)
        for word, i in tok.get_vocab().items():
            if word.startswith(blank):
                starts[i] = True

        def ids_of(texts: list[str]) -> list[np.ndarray]:
            return [np.array(e.ids, dtype="<u4") for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

        def encode_many(pieces: list[str]) -> list[bytes]:
            out: list[bytes | None] = [None] * len(pieces)
            # pieces of the form " x..." with x not white are one text, cut at their blanks
            plain = [i for i, p in enumerate(pieces) if simple and len(p) > 1 and p[0] == " " and not p[1].isspace()]
            parts = [plain[lo:lo + 100] for lo in range(0, len(plain), 100)]
            for part, ids in zip(parts, ids_of(["".join([pieces[i] for i in part]) for part in parts]), strict=True):
                cuts = np.flatnonzero(starts[ids])
                if len(cuts) != len(part):
                    continue  # a vocabulary that writes blanks otherwise: one by one below
                ends = [*(cuts[1:] * 4).tolist(), len(ids) * 4]
                raw = ids.tobytes()
                for i, a, b in zip(part, (cuts * 4).tolist(), ends, strict=True):
                    out[i] = raw[a:b]
            single = [i for i, x in enumerate(out) if x is None]
            for i, ids in zip(single, ids_of([pieces[i] for i in single]), strict=True):
                out[i] = ids.tobytes()
            return out

        _ENCODERS[path] = TextEncoder(PieceEncoder(encode_many), lambda text: ids_of([text])[0].tobytes(),
                                      {t.content: i for i, t in added}, simple)
    return _ENCODERS[path]


def largest_id(path: str, *others: int) -> int:
    from tokenizers import Tokenizer

    return max([*Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), *others])


_SHARD_COLUMNS = {"part": pa.int32(), "shard": pa.int32(), "n_docs": pa.int64(), "n_ids": pa.int64(),
                  "blob": pa.binary()}


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int = END_ID, id_bytes: int | None = None,
                      shard_ids: int = SHARD_IDS) -> None:
    """Encode every text (null: empty), append ``end_id``, write shards in ascending id order.

    The string of an added token, special or not, gives that token's id, as in the library.
    Null ids come first; rows that repeat an id follow the hash of their text.  A text of
    any length stays whole in one shard.  Other columns of the input are not looked at.
    ``id_bytes`` is 2 where every id of the vocabulary and ``end_id`` fit, else 4; a given 2 that
    does not hold them is refused with ValueError.
    """
    ship_package(docs.sparkSession)
    needed = 2 if largest_id(tokenizer_path, end_id) < 1 << 16 else 4
    if id_bytes is not None and id_bytes < needed:
        raise ValueError(f"ids of {tokenizer_path} do not fit {id_bytes} bytes")
    id_bytes = id_bytes or needed

    def shards(part_rows):
        make, encoder, end = batches(_SHARD_COLUMNS), _library_encoder(tokenizer_path), struct.pack("<I", end_id)
        part = shard = 0
        names, ends, chunks, size = [], [], [], 0

        def close():
            nonlocal names, ends, chunks, size, shard
            blob = pack_shard(names, ends, b"".join(chunks), id_bytes)
            row = make([(part, shard, len(names), size, blob)])
            names, ends, chunks, size, shard = [], [], [], 0, shard + 1
            return row

        for batch in part_rows:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
            texts = zip(batch.column(1).to_pylist(), (t.as_py() or "" for t in batch.column(2)), strict=True)
            for group in in_groups(texts):
                own, texts_of = zip(*group, strict=True)
                for name, ids in zip(own, encoder.encode_all(texts_of), strict=True):
                    size += len(ids) // 4 + 1
                    names.append(name)
                    ends.append(size)
                    chunks.append(ids + end)
                    if size >= shard_ids:
                        yield close()
            del batch
            give_back()
        if names:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select(
        F.spark_partition_id().alias("part"), "id", "text")
    ordered.mapInArrow(shards, "part int, shard int, n_docs long, n_ids long, blob binary").write.parquet(path)


def read_token_files(spark, path: str, digest=None) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, in file order by start.

    What is before a part is the sum over the parts before it: one number a part, which is
    what a task of the writer made, so the driver's list is bounded by its tasks.
    """
    files = spark.read.parquet(path)
    sizes = files.groupBy("part", "shard").agg(F.sum("n_ids").alias("n"))
    before_shard = F.sum("n").over(_before("part", "shard"))
    by_shard = sizes.select("part", "shard", F.coalesce(before_shard, F.lit(0)).alias("inside"))
    parts = sorted((r["part"], r["n"]) for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).collect())
    offsets, total = {}, 0
    for p, n in parts:
        offsets[p], total = total, total + n

    def documents(rows):
        make = batches({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()})
        for batch in rows:
            for part, inside, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                names, ef, ids = unpack_shard(blob.as_py())
                base, out, last = offsets[part.as_py()] + inside.as_py(), [], 0
                ids = ids.astype("<u4")
                for i, name in enumerate(names):
                    end = ef.select(i)
                    out.append((name, base + last, end - last, zlib.crc32(ids[last:end].tobytes())))
                    last = end
                yield make(out)

    rows = files.join(small(by_shard), ["part", "shard"]).select("part", "inside", "blob")
    return rows.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _before(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def token_files(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write to a fresh shared folder and read back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer_path, path, **options)
    return read_token_files(docs.sparkSession, path)
