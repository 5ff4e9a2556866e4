"""Token files and rank BPE against the libraries."""

import base64
import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from helpers import DOCS, edge_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from listforge.llm import rank_bpe, token_files
from listforge.llm.token_files import EliasFano

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
TEXT = st.text(st.sampled_from(list("  \n\t'abcdeSTlimr019.!é漢\u00a0\u2003\U0001f600<|endoftext|>")), max_size=60)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_pieces_give_the_library_ids(library, text):
    got = token_files._library_encoder(JSON).encode_all([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == library(text)


@pytest.fixture(scope="module")
def unmodified():
    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.one_of(TEXT, st.sampled_from(
    ["<|endoftext|>", " ", "  ", "   ", "\n", " \n ", "\u00a0", "\x1c", "\x1f ", "a", "!", "<|endof", "text|>"])), max_size=12))
def test_ids_are_those_of_the_unmodified_library(unmodified, parts):
    text = "".join(parts)
    got = token_files._library_encoder(JSON).encode_all([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == unmodified(text)


def test_token_files_hold_added_tokens(spark, unmodified):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "one  <|endoftext|>two<|endoftext|><|endoftext|>  \n three  ", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, start = [], 0
    for i, t in enumerate(texts):
        ids = unmodified(t) + [token_files.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert 50256 in unmodified(texts[0])
    assert sorted(map(tuple, token_files.token_files(docs, JSON).collect())) == want


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_backtracking_gives_the_merges(tik, text):
    bpe, encoder = rank_bpe.codec(RANKS, P.PATTERN)
    ids = np.frombuffer(encoder.encode_all([text])[0], "<u4").tolist()
    assert ids == tik.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_long_runs_without_blanks(tik, library):
    for text in ("a" * 3000, "abc" * 1500, "漢字" * 700, "x" * 700 + " " * 500 + "y", "=" * 1001):
        _, encoder = rank_bpe.codec(RANKS, P.PATTERN)
        assert np.frombuffer(encoder.encode_all([text])[0], "<u4").tolist() == tik.encode_ordinary(text)
        assert np.frombuffer(token_files._library_encoder(JSON).encode_all([text])[0], "<u4").tolist() == library(text)


def test_more_pieces_than_the_cache_holds(monkeypatch, library, tik):
    from listforge.llm import pieces

    monkeypatch.setattr(pieces, "MAX_ENTRIES", 3)
    texts = [" ".join(f"word{(i + j) % 7} other{i}{j}" for i in range(50)) for j in range(6)] + ["", " ", "word1"]
    for encode, want in ((token_files._library_encoder(JSON).encode_all, library),
                         (rank_bpe.codec(RANKS, P.PATTERN)[1].encode_all, tik.encode_ordinary)):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == list(map(want, texts))


def test_a_full_cache_keeps_what_is_asked_for(monkeypatch):
    from listforge.llm import pieces

    monkeypatch.setattr(pieces, "MAX_ENTRIES", 10)
    asked = []

    def encode_many(found):
        asked.extend(found)
        return [x.encode() for x in found]

    encoder = pieces.PieceEncoder(encode_many)
    for i in range(100):
        assert encoder.encode_all([f"head hot once{i}"]) == [f"head hot once{i}".encode()]
    assert asked.count(" hot") == asked.count("head") == 1 and len(asked) == 102
    assert len(encoder._rest.young) <= 10 and len(encoder._rest.old) <= 10


def test_ids_that_need_more_than_two_bytes(spark, tmp_path):
    import json

    from tokenizers import Tokenizer as T

    small = json.load(open(JSON))
    small["added_tokens"].append({"id": 70_000, "content": "<far>", "single_word": False, "lstrip": False,
                                  "rstrip": False, "normalized": False, "special": True})
    path = str(tmp_path / "far.json")
    json.dump(small, open(path, "w"))
    far = T.from_file(path)
    docs = spark.createDataFrame([(1, "a <far> b"), (2, "x")], "doc_id long, text string")
    top = token_files.largest_id(path)
    if top >= 1 << 16:
        with pytest.raises(ValueError):
            token_files.write_token_files(docs, path, str(tmp_path / "no"), id_bytes=2)
    got = sorted(map(tuple, token_files.token_files(docs, path, end_id=70_000).collect()))
    want, start = [], 0
    for i, t in ((1, "a <far> b"), (2, "x")):
        ids = far.encode(t, add_special_tokens=False).ids + [70_000]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    with pytest.raises(ValueError):
        token_files.write_token_files(docs, JSON, str(tmp_path / "no2"), end_id=70_000, id_bytes=2)


def test_caches_in_full_do_not_change_ids(monkeypatch, library):
    from listforge.llm import pieces

    monkeypatch.setattr(pieces, "MAX_ENTRIES", 3)
    text = " ".join(f"word{i % 7} other{i}" for i in range(50))
    assert np.frombuffer(token_files._library_encoder(JSON).encode_all([text])[0], "<u4").tolist() == library(text)


@settings(max_examples=200, deadline=None)
@given(steps=st.lists(st.integers(0, 5000), max_size=300), room=st.integers(0, 10 ** 6))
def test_elias_fano_returns_its_values(steps, room):
    values = np.cumsum(np.array(steps, dtype=np.uint64))
    ef = EliasFano.build(values, int(values[-1]) + room if len(values) else room)
    assert ef.values().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 20_000)).astype(np.uint64)
    ef = EliasFano.build(values, int(values[-1]))
    assert ef.low.nbytes + ef.high.nbytes + ef.samples.nbytes < 0.25 * 8 * len(values)


def test_shard_round_trip():
    ids = np.arange(10, dtype="<u4")
    names, ef, back = token_files.unpack_shard(token_files.pack_shard([None, 5, 9], [2, 2, 10], ids.tobytes(), 2))
    assert names == [None, 5, 9] and ef.values().tolist() == [2, 2, 10] and back.tolist() == list(range(10))


def test_token_files_of_edge_rows(spark, library):
    docs = edge_documents(spark)
    got = token_files.token_files(docs, JSON, shard_ids=40).orderBy("start").collect()
    want = {}
    for r in docs.collect():
        ids = library(r["text"] or "") + [token_files.END_ID]
        want.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have, start = {}, 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


def test_rank_bpe_of_edge_rows(spark, tik):
    docs = edge_documents(spark)
    got = rank_bpe.decode_documents(rank_bpe.encode_documents(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    want = []
    for r in docs.collect():
        ids = tik.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert token_files.token_files(none, JSON).count() == 0
    assert rank_bpe.decode_documents(rank_bpe.encode_documents(none, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0


def test_a_worker_drops_what_other_operators_kept():
    """Caches of one tokenizer do not stay beside those of the next, or beside other operators' sets."""
    import public_tokenizers

    from listforge.functions.memory import keep_only
    from listforge.llm import rank_bpe, token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    first = token_files._library_encoder(path)
    assert token_files._library_encoder(path) is first  # the same operator keeps its own
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = rank_bpe.codec(ranks, public_tokenizers.PATTERN)
    assert not token_files._ENCODERS and rank_bpe.codec(ranks, public_tokenizers.PATTERN) is codec
    keep_only()
    assert not rank_bpe._CODECS


def _python_peak(call):
    import tracemalloc

    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_words_that_repeat_become_no_python_objects():
    """The time of the token files went into one string, one look-up and one join a word."""
    from listforge.llm import pieces

    encoder = pieces.PieceEncoder(lambda found: [x.encode() for x in found])
    text = " ".join(f"repeated{i % 50}" for i in range(200_000))
    assert _python_peak(lambda: encoder.encode_all([text])) < 6 * len(text)
    assert encoder.encode_all([text, "a", "", " ", "a  b c"]) == [text.encode(), b"a", b"", b" ", b"a  b c"]


def test_a_cache_of_pieces_is_compact():
    """Two workers a core keep it beside the JVM of their executor."""
    import pyarrow as pa

    from listforge.llm import pieces

    n, before = 50_000, pa.total_allocated_bytes()
    encoder = pieces.PieceEncoder(lambda found: [struct.pack("<3I", *[len(x)] * 3) for x in found])

    def fill():
        import tracemalloc

        encoder.encode_all([" ".join(f"piece{i}x{i}" for i in range(n))])
        return tracemalloc.get_traced_memory()[0]

    kept = []
    _python_peak(lambda: kept.append(fill()))
    assert len(encoder._rest.young) == n - 1
    assert kept[0] + pa.total_allocated_bytes() - before < 80 * n


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(TEXT, max_size=8))
def test_texts_of_one_call_keep_their_ids(texts, library):
    got = token_files._library_encoder(JSON).encode_all(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == list(map(library, texts))


def test_decoding_needs_no_more_than_the_tokens():
    """A worker that decodes holds a table of the tokens, not the automaton and the caches of the encoder."""
    from listforge.functions.memory import keep_only

    keep_only()
    decoder = rank_bpe.decoder(RANKS)
    assert not rank_bpe._CODECS and rank_bpe.decoder(RANKS) is decoder
    bpe, encoder = rank_bpe.codec(RANKS, P.PATTERN)
    assert rank_bpe.decoder(RANKS) is decoder and rank_bpe.codec(RANKS, P.PATTERN)[0] is bpe
    for text in ("", "a", "one two  three\n 漢字 \U0001f600" * 30):
        ids = encoder.encode_all([text])[0]
        assert decoder.decode(ids) == text.encode() == bpe.decode(np.frombuffer(ids, "<u4").tolist())
    for ranks in ({b"a": 0, b"b": 1}, {b"a": 3, b"b": 2**31}, {}):
        own = rank_bpe.RankDecoder(ranks)
        known = sorted(ranks.values())
        assert own.decode(np.array(known, "<u4").tobytes()) == b"".join(sorted(ranks))
        for bad in (2, 2**32 - 1):
            with pytest.raises(KeyError):
                own.decode(np.array([*known, bad], "<u4").tobytes())


def test_decoding_lets_go_of_a_batch_before_the_next(spark):
    import gc
    import weakref

    import pyarrow as pa

    seen = []

    class Rows:
        def select(self, *_):
            return self

        sparkSession = spark

        def mapInArrow(self, run, _schema):
            return run

    def batches_of():
        for i in range(3):
            gc.collect()
            assert all(ref() is None for ref in seen)
            ids = pa.array([np.array([i], "<u4").tobytes()], pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array([i]), ids], names=["doc_id", "ids"])
            seen.append(weakref.ref(batch))
            yield batch
            del batch

    run = rank_bpe.decode_documents(Rows(), RANKS, P.PATTERN)
    assert [out.column(1).to_pylist() for out in run(batches_of())] == [[1]] * 3
