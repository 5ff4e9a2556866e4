"""Brute-force versions and small tables for the tests of the training-data operators."""

from __future__ import annotations

from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _t string, key string"

LONG = " ".join(f"wort{i % 977}x{i}" for i in range(40_000))


def edge_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [
        (1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, base + " sixteen", "en", None),
        (4, None, None, None), (5, "", "fr", "b"), (6, " \t\n ", "fr", "b"), (7, "solo", "de", "b"),
        (8, "SOLO", "de", "b"), (8, "SOLO", "de", "b"), (9, LONG, "en", "c"), (10, LONG + " end", "en", "c"),
        (None, base, "en", "a"), (None, None, None, None), (11, "12345 !!! 678", "en", "d"),
        (12, "É É\u00a0x \\ </turn> '\"", "fr", "d"), (13, "éÉ", "fr", "d"),
    ]
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "clash", "k")
                                  for i, t, lang, src in rows], DOCS)


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    n = min(words, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def jaccard_rows(rows):
    """[(doc_id, text)] -> sorted [(doc_id, n_shingles, component_id, n_links)], all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    smallest = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[root(i)].append(d)
    return sorted(((d, len(sets[i]), min(smallest[root(i)], default=None) if sets[i] else d, links[i])
                   for i, (d, _) in enumerate(rows)), key=str)
