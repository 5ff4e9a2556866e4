"""Exact dedup, Jaccard join, mixing and language ID against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, edge_documents, jaccard_rows
from pyspark.sql import functions as F

from listforge.llm import exact_dedup, langid, mixing, partenum
from listforge.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def _norm(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def _groups(rows):
    ids, n = {}, Counter()
    for d, t in rows:
        k = _norm(t)
        n[k] += 1
        ids[k] = max((x for x in (ids.get(k), d) if x is not None), default=None)
    return sorted(((d, ids[_norm(t)], n[_norm(t)], d == ids[_norm(t)]) for d, t in rows), key=str)


@pytest.mark.parametrize("digest", [exact_dedup._digest, lambda c: F.length(c).cast("long"), lambda c: F.lit(1).cast("long")])
def test_exact_duplicates_compare_texts_whatever_the_digest(spark, digest):
    docs = edge_documents(spark)
    got = exact_dedup.exact_duplicates(docs, salts=3, digest=digest).collect()
    want = _groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=str) == want


def test_keep_one_of_each_keeps_one_row_of_repeated_ids(spark):
    docs = edge_documents(spark)
    got = exact_dedup.keep_one_of_each(docs)
    assert got.columns == docs.columns
    texts = [_norm(r["text"]) for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({_norm(r["text"]) for r in docs.collect()})


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.keep_one_of_each(none).count() == 0
    assert partenum.jaccard_components(none).count() == 0
    assert mixing.mixed_order(none).count() == 0
    model = langid.train(none, F.lit(True))
    assert langid.identify(none, model).count() == 0
    assert model.predict("some text") == ("und", 0.0)


def _near_copies(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    rows, n = [], 0
    for size in (1, 3, 4, 5, 6, 9, 30, 80, 200, 700):
        for _ in range(3):
            base = [rng.choice(words) for _ in range(size)]
            for edits in (0, 0, 1, size // 40, size // 15, size // 8, size // 4):
                t = list(base)
                for _ in range(edits):
                    t[rng.randrange(len(t))] = rng.choice(words)
                if rng.random() < 0.4:
                    t = t + passage
                rows.append((n, " ".join(t)))
                n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_components_match_all_pairs(spark, monkeypatch, small):
    if small:  # every family in several blocks, every group over the sketch limit
        monkeypatch.setattr(partenum, "BLOCK_SETS", 3)
        monkeypatch.setattr(partenum, "SKETCH_SETS", 2)
    rows = _near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in partenum.jaccard_components(df).select(
        "doc_id", "n_shingles", "component_id", "n_links").collect()), key=str)
    assert got == jaccard_rows(rows)


def test_jaccard_components_of_edge_rows(spark):
    docs = edge_documents(spark)
    got = sorted((tuple(r) for r in partenum.jaccard_components(docs).select(
        "doc_id", "n_shingles", "component_id", "n_links").collect()), key=str)
    assert got == jaccard_rows([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_similar_sets_share_a_signature_and_pass_the_sketch():
    rng = np.random.default_rng(1)
    hot = rng.integers(0, 4, 1 << partenum.HOT_BITS).astype(np.uint8)
    checked = 0
    for n in [*range(1, 30), 63, 64, 65, 255, 256, 257, 300, 399, 400, 410, 900, 1023, 1024, 1025, 1590, 1610, 6500]:
        for _ in range(12):
            s = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            gone = rng.random(len(s)) < rng.random() * 0.25
            new = rng.integers(0, 1 << 64, int(rng.random() * 0.3 * n), dtype=np.uint64)
            t = np.unique(np.concatenate((s[~gone], new)))
            both = len(np.intersect1d(s, t))
            if len(t) and 100 * both >= 75 * (len(s) + len(t) - both):
                checked += 1
                assert np.intersect1d(partenum.signatures(s, hot), partenum.signatures(t, hot)).size
                odd = [partenum.odd_sketches(s), partenum.odd_sketches(t)]
                assert len(partenum.may_link(np.array([len(s), len(t)]), odd, 75)[0]) == 1
    assert checked > 100
    far = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (200, 399, 401, 900, 1700, 6000) for _ in (0, 1)]
    for a, b in zip(far[::2], far[1::2], strict=True):
        assert not len(partenum.may_link(np.array([len(a), len(b)]), [partenum.odd_sketches(a), partenum.odd_sketches(b)], 75)[0])


def test_long_words_and_texts_hash_like_short_pieces(monkeypatch):
    text = "ab CD\tef " * 50 + "x" * 400 + " yz " + "q" * 90 + "\n12 34"
    whole = partenum.word_hashes(text)
    monkeypatch.setattr(partenum, "_TEXT_PIECE", 64)
    cut = partenum.word_hashes(text)
    assert len(whole) == len(cut) == len(text.split())
    short = [i for i, w in enumerate(text.split()) if len(w) < 60]
    assert (whole[short] == cut[short]).all()


def test_connected_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}


def _edf(parts):
    """Earliest deadline first over released blocks, slot by slot."""
    q, done, out = sum(p for _, p in parts), {s: 0 for s, _ in parts}, []
    for t in range(q):
        ready = [(-(-(done[s] + 1) * q // p), i, s) for i, (s, p) in enumerate(parts) if done[s] * q // p <= t]
        s = min(ready)[2]
        out.append(s)
        done[s] += 1
    return out


def test_period_schedule_is_earliest_deadline_first(spark):
    parts = [("a", 7), ("b", 1), ("c", 12), ("d", 4), ("e", 1)]
    got = mixing.period_schedule(spark.createDataFrame(parts, "_src string, parts int")).orderBy("slot").collect()
    want, q = _edf(parts), 25
    assert [r["_src"] for r in got] == want
    share = dict(parts)
    for t in range(1, q + 1):  # Pfair: less than one block from the ideal, at every time
        for s, p in share.items():
            assert abs(want[:t].count(s) - t * p / q) < 1
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)


def test_hundreds_of_sources_keep_the_schedule(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 300).alias("source"))
    docs = docs.unionByName(spark.range(3000).select((F.col("id") + 6000).alias("doc_id"), F.lit("hot").alias("source")))
    rows = mixing.interleave(docs, block_docs=1).select("_row.*", "_mix.*").collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 9000
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    assert len({r["slot"] for r in rows}) == len(rows)  # a block a slot


def test_rows_without_ids_meet_their_own_text_only(spark):
    rows = [(None, f"one two three four five six seven eight nine w{i}") for i in range(60)]
    rows += [(None, "one two three four five six seven eight nine w7")] * 3 + [(5, rows[9][1]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = partenum.jaccard_components(df, percent=70)
    # 5 of 7 shingles in common is 71 %
    assert [(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got.where("n_shingles > 0").collect()] == [
        (d, 6, 5, 63) for d in [r["doc_id"] for r in got.where("n_shingles > 0").select("doc_id").collect()]]
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_interleave_keeps_every_row_and_its_source_order(spark):
    docs = edge_documents(spark)
    more = spark.range(500).select((F.col("id") + 1000).alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"),
                                   F.concat(F.lit("s"), (F.col("id") % 4)).alias("source"), F.lit(1).cast("long").alias("n_chars"),
                                   F.lit("").alias("_t"), F.lit("").alias("key"))
    docs = docs.unionByName(more)
    got = mixing.interleave(docs, block_docs=3, buckets=5)
    rows = got.select("_row.*", "_mix.*").collect()
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(str(r["doc_id"]) for r in docs.collect())
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["block"], r["pos"], r["slot"]))
    for at in by.values():
        at.sort()
        assert [b * 3 + p for b, p, _ in at] == list(range(len(at)))
        assert [s for _, _, s in at] == sorted(s for _, _, s in at)
    assert len({(r["slot"], r["pos"]) for r in rows}) == len(rows)
    assert mixing.mixed_order(docs).columns == docs.columns


def test_language_score_is_the_softmax_of_averaged_grams(spark):
    """Every byte 2- to 4-gram looked up one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs, F.col("doc_id") % 3 != 0)
    muls = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)

    def plain(text):
        if text is None or not any(c.isalpha() for c in text):
            return "und", 0.0
        raw = [b if b > 127 or chr(b).isalpha() else 32 for b in f" {text.lower()} ".encode()]
        total, n = np.zeros(len(model.classes)), 0
        for size, mul in zip((2, 3, 4), muls, strict=True):
            for i in range(len(raw) - size + 1):
                h = raw[i] * 257 + raw[i + 1]
                for b in raw[i + 2:i + size]:
                    h = (h * 0x01000193 + b) % 2 ** 32
                total += model.logits[h * mul % 2 ** 32 >> 32 - model.bits]
                n += 1
        z = (total / n + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        return model.classes[int(p.argmax())], p.max()

    more = spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "12 !", None), (-4, "a", None), (-5, "日本語 é", None),
                                  (-6, "Ab" * 4000, None)], docs.schema)
    for r in langid.identify(docs.unionByName(more), model).collect():
        lang, score = plain(r["text"])
        assert r["_lang"]["lang_pred"] == lang and abs(r["_lang"]["score"] - score) < 1e-6
        assert r["_lang"]["rejected"] == (lang == "und" or r["_lang"]["score"] < model.reject_below)


def test_language_id_on_held_out_rows_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    rows = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).select("text", "lang").collect()
    right = [model.predict(r["text"])[0] == r["lang"] for r in rows if langid.has_letter(r["text"])]
    assert sum(right) / len(right) > 0.97
    got = {r["doc_id"]: r["_lang"] for r in langid.identify(edge_documents(spark), model).collect() if r["doc_id"]}
    for d in (4, 5, 6, 11):
        assert (got[d]["lang_pred"], got[d]["score"], got[d]["rejected"]) == ("und", 0.0, True)
    for d in (1, 7, 9, 13):
        assert got[d]["lang_pred"] in model.classes and 0 <= got[d]["score"] <= 1


def softmax_by_hand(model, text):
    """The score without any of the module's vector code: mean of the grams' logits, softmax."""
    grams = [int(b) for idx in langid.gram_buckets(text) for b in idx]
    z = [(sum(float(model.logits[g][k]) for g in grams) / len(grams) + float(model.bias[k])) / model.temperature
         for k in range(len(model.classes))]
    e = [math.exp(v - max(z)) for v in z]
    return max((v / sum(e), c) for v, c in zip(e, model.classes, strict=True))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_one_rejection_rule_at_every_size(spark, sf):
    """Prose stays; gibberish goes once there are answers enough to tell it by its score."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    model = langid.train(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    assert model.reject_below > 1 / len(model.classes)
    rows = [r for r in docs.collect() if langid.has_letter(r["text"])]
    scores = [model.predict(r["text"]) for r in rows]
    assert sum(s < model.reject_below for _, s in scores) <= 0.005 * len(rows)
    for text in ("zxqv wkjx qqzx vvkw xjqz kkwx " * 5, "bqxjzk vwqkhg zzxkqj wvxkq " * 4) if sf == "sf0.01" else ():
        assert model.predict(text)[1] < model.reject_below
    for r, (lang, score) in list(zip(rows, scores, strict=True))[:15]:
        text = r["text"][:2000]
        want = softmax_by_hand(model, text)
        assert abs(model.predict(text)[1] - want[0]) < 1e-4 and model.predict(text)[0] == want[1]


def test_one_unsure_answer_does_not_move_the_threshold():
    rng = np.random.default_rng(0)

    def row(k):
        idx = np.unique(rng.integers(1000 * k, 1000 * k + 400, 60))
        return idx.astype(np.int64), np.ones(len(idx), np.float32), "ab"[k]

    rows = [row(i % 2) for i in range(3000)]
    model = langid.fit(rows)
    odd = list(rows)
    odd[4] = (np.array([5, 1005]), np.ones(2, np.float32), rows[4][2])  # a held-out row of both languages
    assert abs(langid.fit(odd).reject_below - model.reject_below) < 0.02


def test_a_rare_language_is_in_the_sample(spark):
    rows = [(i, f"plain english words number {i} here", "en") for i in range(400)]
    rows += [(1000 + i, f"ein paar deutsche wörter nummer {i}", "de") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs, F.lit(True), sample_docs=40).classes == ["de", "en"]


def test_clashing_column_names(spark):
    names = ["_own_h", "_rows", "_k", "_h", "_id", "_row", "_lang", "_lang_", "_LANG__"]
    rows = [(1, "Same text", *names), (2, "same TEXT", *names), (2, "same TEXT", *names), (None, None, *names), (3, "", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = exact_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["_rows"], r["_lang"]) for r in kept.collect()), key=str) == [
        (2, "_rows", "_lang"), (3, "_rows", "_lang")]
    model = langid.train(spark.createDataFrame([], DOCS), F.lit(True))
    found = langid.identify(docs, model)
    assert found.columns == [*docs.columns, "_lang___"] and found.first()["_lang"] == "_lang"
    assert {r["_lang___"]["lang_pred"] for r in found.collect()} == {"und"}


def test_grams_of_pieces_equal_grams_of_the_whole(monkeypatch):
    text = "Straße über alles, né à Paris; " * 40
    whole = np.bincount(np.concatenate(list(langid.gram_buckets(text))), minlength=1 << langid.BUCKET_BITS)
    monkeypatch.setattr(langid, "_PIECE", 100)
    cut = np.bincount(np.concatenate(list(langid.gram_buckets(text))), minlength=1 << langid.BUCKET_BITS)
    assert (whole == cut).all()


def test_component_rounds_end_with_the_first_stars(spark, monkeypatch):
    from listforge.llm import components

    writes, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: writes.append(name) or write(df, name))

    def roots(edges):
        writes.clear()
        rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(rows) == len({r["node"] for r in rows})
        return {r["node"]: r["root"] for r in rows}

    # stars as given, either way round and repeated: no round
    assert roots([(1, 2), (3, 1), (1, 3), (2, 1), (7, 8), (None, 4), (5, 5)]) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert len(writes) == 1
    # a node with two edges, and a chain: one round each, and no second one to see that nothing moves
    assert roots([(1, 3), (2, 3)]) == {1: 1, 2: 1, 3: 1}
    assert len(writes) == 2
    assert roots([(1, 2), (2, 3)]) == {1: 1, 2: 1, 3: 1}
    assert len(writes) == 2


def test_language_sample_is_small_in_the_driver(spark, monkeypatch):
    texts = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + j % 26)}x{'abcdefgh'[j % 8]}" for j in range(3000)),
              "de" if i % 2 else "en") for i in range(20)]
    docs, seen, fit = spark.createDataFrame(texts, "doc_id long, text string, lang string"), [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda rows: seen.extend(rows) or fit(rows))
    langid.train(docs, F.lit(True))
    assert len(seen) == 20
    assert all(idx.nbytes + n.nbytes <= 4 * len(idx) for idx, n, _ in seen)  # 12 bytes a pair before
    want = {(i, lang): np.bincount(np.concatenate(list(langid.gram_buckets(t))), minlength=1 << langid.BUCKET_BITS)
            for i, t, lang in texts}
    got = sorted((lang, idx.tolist(), n.tolist()) for idx, n, lang in seen)
    assert got == sorted((lang, np.flatnonzero(c).tolist(), c[c > 0].tolist()) for (_, lang), c in want.items())
    idx, n = np.array([0, 1, 300, 16383]), np.array([1, 2**32 - 1, 70000, 3])
    back = langid.unpack(*langid.pack(idx, n))
    assert back[0].tolist() == idx.tolist() and back[1].tolist() == n.tolist()
