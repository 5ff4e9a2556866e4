"""Decontamination against a scan of every window at every place."""

import hashlib
import random
import re

import pytest
from helpers import edge_documents

from listforge.llm import positional_index as P

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOC = "doc_id long, text string, term string, row string, pos string"
ITEM = "item_id long, text string, term string, words string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for d, text in docs:
        w, hit, names = words(text), set(), set()
        for name, t in items:
            v = words(t)
            n = min(window, len(v))
            grams = {tuple(v[s:s + n]) for s in range(len(v) - n + 1)} if n else set()
            for s in range(len(w) - n + 1 if grams else 0):
                if tuple(w[s:s + n]) in grams:
                    hit |= set(range(s, s + n))
                    names.add("" if name is None else str(name))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, "t", "r", "p") for d, t in docs], DOC),
            spark.createDataFrame([(i, t, "t", "w") for i, t in items], ITEM))


def check(spark, docs, items, window=10):
    got = P.contamination(*frames(spark, docs, items), window=window)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, window)


def tables(rng, n_docs=60, n_items=25):
    """Few words, so windows meet often, also by halves; passages copied whole and cut."""
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "x1y", "的"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(rng.choice([i, i, 100 + i % 3, None]), text(rng.choice([0, 1, 2, 3, 4, 5, 9]))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        parts = [text(rng.randrange(8)) for _ in range(3)] + [t for _, t in rng.sample(items, 3)]
        rng.shuffle(parts)
        docs.append((rng.choice([i, i, 7, None]), rng.choice([" ", ", ", "\n"]).join(parts).upper()))
    return docs + docs[:3] + [(900, None), (901, ""), (902, " .,; ")], items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_scan_of_all_places(spark, seed):
    docs, items = tables(random.Random(seed))
    check(spark, docs, items, window=4)


def test_words_beyond_the_broadcast_sizes(spark, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(P, "small", lambda df, rows=0: df)
    docs, items = tables(random.Random(3))
    check(spark, docs, items, window=3)


def test_edges(spark):
    base = [(r["doc_id"], r["text"]) for r in edge_documents(spark).collect()]
    quote = " ".join(f"wort{i % 977}x{i}" for i in range(39_980, 40_000))
    items = [(1, quote), (2, "One two THREE four five six seven eight nine ten eleven"), (2, "solo"), (3, None), (4, "..."),
             (None, "one two three four five six seven eight nine zehn"), (5, "É É x")]
    check(spark, base, items)
    check(spark, base, [])
    check(spark, [], items)
    check(spark, base, [(1, None)])


def test_near_words_match_within_the_slack(spark):
    docs = [(1, "a b c d e"), (2, "a b x c d e"), (3, "a x x x b c d e"), (4, "e d c b a"), (5, "a b c d")]
    items = [(9, "a b c d e")]

    def found(slack):
        rows = P.proximity_matches(*frames(spark, docs, items), slack=slack, window=5).collect()
        return sorted({r["doc_id"] for r in rows})

    assert found(0) == [1]
    assert found(1) == [1, 2]
    assert found(3) == [1, 2, 3]
    assert found(7) == [1, 2, 3]
    assert found(8) == [1, 2, 3, 4]  # the rarest word is e


def test_slack_nothing_equals_the_phrases_and_any_slack_a_scan(spark):
    docs, items = tables(random.Random(4), 25, 10)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    items = [(i, t) for i, (_, t) in enumerate(items)]
    counts = {}
    for _, t in docs:
        for w in words(t):
            counts[w] = counts.get(w, 0) + 1
    for slack in (0, 2):
        want = set()
        for d, text in docs:
            w = words(text)
            for i, t in items:
                v = words(t)
                n = min(4, len(v))
                for s in range(len(v) - n + 1 if n else 0):
                    g = v[s:s + n]
                    if not all(x in counts for x in g):
                        continue
                    k0 = min(range(n), key=lambda k: (counts[g[k]], k))
                    for p, x in enumerate(w):
                        if x == g[k0] and all(any(0 <= p - k0 + k + o < len(w) and w[p - k0 + k + o] == g[k]
                                                  for o in range(-slack, slack + 1)) for k in range(n)):
                            want.add((d, str(i), s, p - k0 + 1))
        got = P.proximity_matches(*frames(spark, docs, items), slack=slack, window=4).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
