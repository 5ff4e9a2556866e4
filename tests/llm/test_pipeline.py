"""The pipeline's stages: each against a brute-force version on what the one before kept."""

import hashlib
import importlib
import os
import sys

import public_tokenizers as P
from helpers import DOCS, edge_documents, jaccard_rows

from listforge.llm import queries, rank_bpe

corpus_pipeline = importlib.import_module("corpus_pipeline")


def _plain(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def _check(spark, docs, sf_dir):
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}-{os.urandom(4).hex()}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        new = docs.collect()
        if name == "language_id":
            gone = set(map(str, rows)) - set(map(str, new))
            kept_texts = {r["text"] for r in new}
            assert all(any(c.isalpha() for c in t) for t in kept_texts)
            assert sum(1 for r in rows if any(c.isalpha() for c in r["text"] or "")) <= len(new) + 0.01 * len(rows), gone
        elif name == "exact_dedup":
            best = {}  # text -> largest id, -1 for none
            for r in rows:
                best[_plain(r["text"])] = max(best.get(_plain(r["text"]), -1), -1 if r["doc_id"] is None else r["doc_id"])
            assert sorted(_plain(r["text"]) for r in new) == sorted(best)
            assert all((-1 if r["doc_id"] is None else r["doc_id"]) == best[_plain(r["text"])] for r in new)
        elif name == "jaccard_join":
            own = jaccard_rows([(r["doc_id"], r["text"]) for r in rows])
            want = {d for d, _, c, _ in own if d == c}
            assert sorted(str(r["doc_id"]) for r in new) == sorted(str(r["doc_id"]) for r in rows
                                                                   if r["doc_id"] is None or r["doc_id"] in want)
        else:
            assert sorted(map(str, new)) == sorted(map(str, rows))
        rows = new
    bpe, encoder = rank_bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    want = sorted((str(r["doc_id"]), len(encoder.encode_all([r["text"] or ""])[0]) // 4,
                   hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["decoded_sha256"]) for r in last) == want
    return last


def test_stages_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    last = _check(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert len(last) == corpus_pipeline.run(spark, sf).count()


def test_the_mix_reaches_the_result_over_several_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(
        edge_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")).repartition(7)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/test-mix-{os.urandom(4).hex()}"
    corpus_pipeline.mixed(spark, docs, "unused").repartition(5).write.parquet(path)
    got = corpus_pipeline.encoded(spark, spark.read.parquet(path), "unused").collect()
    want = [(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest())
            for r in corpus_pipeline.mixed(spark, docs, "unused").collect()]
    got.sort(key=lambda r: (r["slot"], r["pos"]))
    assert [(r["doc_id"], r["decoded_sha256"]) for r in got] == want


def test_stages_on_edge_rows_and_empty_table(spark):
    _check(spark, edge_documents(spark), "unused")
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "unused").count() == 0


def test_names():
    assert [n for n in queries.QUERIES if n.startswith("op")] and set(queries.ORACLE) <= set(queries.QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and "listforge.llm" in sys.modules
