"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and context windows.

1. The lexicon is learned from labelled rows: words, and stems that many words share, which
   toxic rows have far more often than the others.
2. A Levenshtein automaton (one edit for terms of five or more characters, two from nine)
   is intersected with the lexicon trie: states are sets of (trie node, edits), built as
   words need them.  It accepts a word that is a lexicon term, or starts with a stem,
   within the allowed edits.
3. Each match is weighed by its window: a match between quotation marks, or right after a
   word of reporting, counts as quotation; other matches near it make it heavier.  A
   logistic layer over these sums, fitted on the labelled rows, gives the score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import batches, column_of, free_name
from listforge.session import ship_package

WORD = re.compile(r"[^\W_]+(?:[*@$!][^\W_]+)*")  # st*pid, 1diot
SAMPLE_TOXIC, SAMPLE_OTHER = 3000, 6000   # expected rows the lexicon and the layer are fitted on
LEAST_G = 25.0
STEM = (3, 8)             # characters of a stem
WINDOW = 12               # words on either side of a match
MAX_CACHED = 200_000
_QUOTES = "\"'«»„“”‟‘’‹›「」"
_REPORTS = frozenset("said says wrote called quoted quote term word sagte schrieb nannte zitat wort "
                     "dit écrit appelé mot dijo escribió llamó palabra".split())


def _edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


NONE, EXACT, WORD_EDIT, STEM_EDIT = 0, 1, 2, 3


class LexiconAutomaton:
    """match(word) -> (kind, weight) of the best accepted term: exact before edited, then by weight."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self._next: list[dict[str, int]] = [{}]
        # (allowed edits, weight) of the word, or stem, that ends at a node
        self._word: list[tuple[int, float] | None] = [None]
        self._stem: list[tuple[int, float] | None] = [None]
        for terms, ends in ((words, self._word), (stems, self._stem)):
            for term, weight in terms.items():
                node = 0
                for ch in term:
                    if ch not in self._next[node]:
                        self._next[node][ch] = len(self._next)
                        self._next.append({})
                        self._word.append(None)
                        self._stem.append(None)
                    node = self._next[node][ch]
                ends[node] = (_edits(term), weight)
        # the most edits any term at or below a node allows: a state beyond it is dead
        self._room = [max((x[0] for x in (a, b) if x), default=-1) for a, b in zip(self._word, self._stem, strict=True)]
        for node in range(len(self._next) - 1, -1, -1):
            for child in self._next[node].values():
                self._room[node] = max(self._room[node], self._room[child])
        self._alphabet = {ch for n in self._next for ch in n}
        self._ids: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._steps: list[dict[str, int]] = []
        self._at_end: list[tuple[int, float]] = []
        self._inside: list[tuple[int, float]] = []
        self._start = self._state({(0, 0)})

    def _state(self, items: set) -> int:
        """The state of these (node, edits), closed under skipping a term's character."""
        best: dict[int, int] = {}
        todo = list(items)
        while todo:
            node, e = todo.pop()
            if e > self._room[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self._next[node].values()]
        key = frozenset(best.items())
        if key not in self._ids:
            self._ids[key] = len(self._sets)
            self._sets.append(key)
            self._steps.append({})
            self._at_end.append(_best(best, self._word, WORD_EDIT))
            self._inside.append(_best(best, self._stem, STEM_EDIT))
        return self._ids[key]

    def _step(self, state: int, ch: str) -> int:
        out = set()
        for node, e in self._sets[state]:
            out.add((node, e + 1))                                   # a character too many
            for own, child in self._next[node].items():
                out.add((child, e if own == ch else e + 1))          # the same, or another one
        return self._state(out)

    def match(self, word: str) -> tuple[int, float]:
        state, found = self._start, (NONE, 0.0)
        for ch in word:
            if ch not in self._alphabet:
                ch = ""
            after = self._steps[state].get(ch)
            if after is None:
                after = self._steps[state][ch] = self._step(state, ch)
            state = after
            if not self._sets[state]:
                return found
            found = _better(found, self._inside[state])
        return _better(found, self._at_end[state])


def _better(a: tuple[int, float], b: tuple[int, float]) -> tuple[int, float]:
    if not a[0] or not b[0]:
        return a if a[0] else b
    return min(a, b, key=lambda x: (x[0] != EXACT, -x[1]))


def _best(nodes: dict[int, int], ends: list, edited: int) -> tuple[int, float]:
    out = (NONE, 0.0)
    for node, e in nodes.items():
        if ends[node] and e <= ends[node][0]:
            out = _better(out, (edited if e else EXACT, ends[node][1]))
    return out


FEATURES = 8


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -4.0

    def __post_init__(self):
        self._setup()

    def _setup(self):
        self._automaton = LexiconAutomaton(self.words, self.stems)
        self._cache: dict[str, tuple[int, float] | int] = {}

    def __getstate__(self):
        return self.words, self.stems, self.weights, self.bias

    def __setstate__(self, state):
        self.words, self.stems, self.weights, self.bias = state
        self._setup()

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(FEATURES)
        if not text:
            return out
        low = text.lower()
        words = WORD.findall(low)
        hits = list(map(self._cache.get, words))
        if None in hits:
            match, cache = self._automaton.match, self._cache
            if len(cache) > MAX_CACHED:
                cache.clear()
            for i, h in enumerate(hits):
                if h is None:
                    h = match(words[i])
                    h = h if h[0] else 0
                    if len(words[i]) < 40:
                        cache[words[i]] = h
                    hits[i] = h
        if not any(hits):
            return out
        spans = [m.span() for m in WORD.finditer(low)]
        at = [i for i, h in enumerate(hits) if h]
        terms, near = {}, 0.0
        for n, i in enumerate(at):
            kind, weight = hits[i]
            quoted = _quoted(low, *spans[i]) or not _REPORTS.isdisjoint(words[max(0, i - 2):i])
            out[{EXACT: 2, WORD_EDIT: 3, STEM_EDIT: 3}[kind] if quoted else {EXACT: 0, WORD_EDIT: 1, STEM_EDIT: 4}[kind]] += weight
            if kind == EXACT:
                terms[words[i]] = weight
                near = max(near, sum(hits[j][1] for j in at[max(0, n - WINDOW):n + WINDOW + 1]
                                     if abs(j - i) <= WINDOW and hits[j][0] == EXACT))
        out[7] = 100 * (out[0] + out[2]) / len(words)
        out[5], out[6] = near, sum(terms.values())
        return np.log1p(out)

    def score(self, text: str | None) -> float:
        z = float(self.features(text) @ self.weights + self.bias)
        return 1 / (1 + np.exp(-max(-60.0, min(60.0, z))))


def _quoted(text: str, start: int, end: int) -> bool:
    """A quotation mark within the 60 characters before, and one within the 60 after."""
    before, after = text[max(0, start - 60):start], text[end:end + 60]
    return any(c in _QUOTES and not _inner(before, i) for i, c in enumerate(before)) and any(
        c in _QUOTES and not _inner(after, i) for i, c in enumerate(after))


def _inner(s: str, i: int) -> bool:
    """An apostrophe between letters is no quotation mark."""
    return 0 < i < len(s) - 1 and s[i - 1].isalpha() and s[i + 1].isalpha()


def _word_counts(parts):
    """Per task: in how many toxic and other rows a word occurs (the input is a bounded sample)."""
    make, seen = batches({"word": pa.string(), "toxic": pa.int64(), "other": pa.int64()}), {}
    for batch in parts:
        for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            for w in set(WORD.findall((text.as_py() or "").lower())):
                seen.setdefault(w, [0, 0])[1 - y] += 1
    out = []
    for w, (t, o) in seen.items():
        out.append((w, t, o))
        if len(out) == 20_000:
            yield make(out)
            out = []
    yield make(out)


def learn_lexicon(sample: DataFrame, toxic_rows: int, other_rows: int) -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) with their weights, from ``sample`` (text, y).

    A term is taken if its share of toxic rows is four times its share of the others and
    the two differ by a G statistic of LEAST_G; a stem also needs five different words in
    toxic rows.  The weight is the log of the ratio.  Terms are taken by falling G: a stem
    stands for the words and stems it covers, and counts without the words taken before.
    Every term that passes is taken; their number is bounded by the sample alone.
    """
    words = sample.mapInArrow(_word_counts, "word string, toxic long, other long").groupBy(
        F.col("word").alias("term")).agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    stems = words.select(F.explode(F.transform(
        F.sequence(F.lit(STEM[0]), F.lit(STEM[1])), lambda n: F.substring("term", F.lit(1), n))).alias("stem"),
        "term", "toxic", "other").where(F.length("stem") < F.length("term")).distinct().groupBy(
        F.col("stem").alias("term")).agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"),
                                         F.count_if(F.col("toxic") > 0).alias("words"))
    weight = F.log((F.col("toxic") / toxic_rows) / ((F.col("other") + 0.5) / (other_rows + 1)))
    t, o = F.least("toxic", F.lit(toxic_rows)).cast("double"), F.least("other", F.lit(other_rows)).cast("double")
    rows_, with_ = float(toxic_rows + other_rows), t + o
    g = F.lit(0.0)
    for seen, of, side in ((t, with_, toxic_rows), (o, with_, other_rows),
                           (toxic_rows - t, rows_ - with_, toxic_rows), (other_rows - o, rows_ - with_, other_rows)):
        g = g + F.when(seen > 0, 2 * seen * F.log(seen * rows_ / (of * side))).otherwise(0.0)

    def telling(df):
        # a little below the bounds, which _g and _ratio draw below
        return df.where((F.col("toxic") > 0) & (weight >= float(np.log(4)) - 1e-9) & (g >= LEAST_G - 1e-6)).collect()

    sums = (toxic_rows, other_rows)
    candidates = [(_g(r["toxic"], r["other"], *sums), len(r["term"]), r["term"], r["toxic"], r["other"], is_stem)
                  for is_stem, rows in ((False, telling(words)), (True, telling(stems.where("words >= 5")))) for r in rows]
    lengths = range(STEM[0], STEM[1] + 1)
    plain, kept, inside = {}, {}, set()    # inside: the starts of the stems kept
    below: dict[str, list] = {}            # start -> counts of the words taken
    for g, _, term, t, o, is_stem in sorted(candidates, key=lambda c: (-c[0], -c[1], c[2], c[5])):
        if g < LEAST_G or _ratio(t, o, *sums) < 4 or any(term[:n] in kept for n in lengths):
            continue
        if is_stem:
            if term in inside:
                continue
            own = below.get(term, [])
            t, o = t - sum(x[0] for x in own), o - sum(x[1] for x in own)
            if t <= 0 or _g(t, o, *sums) < LEAST_G or _ratio(t, o, *sums) < 4:
                continue
            kept[term] = min(6.0, float(np.log(_ratio(t, o, *sums))))
            inside.update(term[:n] for n in lengths)
        else:
            plain[term] = (min(6.0, float(np.log(_ratio(t, o, *sums)))), t, o)
            for start in {term[:n] for n in lengths if n <= len(term)}:
                below.setdefault(start, []).append((t, o))
    return {w: x[0] for w, x in plain.items()}, kept


def _ratio(t: float, o: float, toxic: int, other: int) -> float:
    return (t / toxic) / ((o + 0.5) / (other + 1))


def _g(t: float, o: float, toxic: int, other: int) -> float:
    """G statistic of the table (rows with and without the term) x (toxic, other)."""
    t, o = min(t, toxic), min(o, other)
    seen = np.array([[t, o], [toxic - t, other - o]], dtype=np.float64)
    expected = seen.sum(axis=1, keepdims=True) * seen.sum(axis=0) / seen.sum()
    return float(2 * np.sum(np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)))


def fit_layer(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.5,
              decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient descent, classes weighed by the root of their share."""
    w, b = np.zeros(x.shape[1]), 0.0
    share = max(y.mean(), 1e-6)
    cost = np.where(y == 1, 1 / np.sqrt(share), 1 / np.sqrt(max(1 - share, 1e-6)))
    cost /= cost.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60)))
        g = (p - y) * cost
        w -= rate * 10 * (x.T @ g + decay * w)
        b -= rate * 10 * g.sum()
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> ToxicityModel:
    """Fit on labelled rows for which ``usable`` (on the id) holds.

    The sample is bounded: of either class the rows whose id hash falls below a share of the
    range chosen so that SAMPLE_TOXIC and SAMPLE_OTHER rows are expected (all, if fewer).
    Labels other than 0 and 1, null texts, and rows with only one class give no lexicon.
    """
    ship_package(docs.sparkSession)
    marked = labels.where(usable & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(
        F.max(label_col).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return ToxicityModel()
    place = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity"), F.col(id_col)), 24)
    bound = {1: min(1.0, SAMPLE_TOXIC / n[1]), 0: min(1.0, SAMPLE_OTHER / n[0])}
    picked = marked.where(place < F.when(F.col("y") == 1, int(bound[1] * (1 << 40))).otherwise(int(bound[0] * (1 << 40))))
    sample = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(picked), id_col).select(  # a bounded sample
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), "y")
    from listforge.session import materialize

    sample = materialize(sample, "toxicity-sample")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return ToxicityModel()
    model = ToxicityModel(*learn_lexicon(sample.select("text", "y"), sizes[1], sizes[0]))

    def measure(parts):
        make = batches({"id": pa.int64(), "y": pa.int32(), "x": pa.list_(pa.float64())})
        for batch in parts:
            ids, texts, ys = (c.to_pylist() for c in batch.columns)
            yield make([(i, y, model.features(t).tolist()) for i, t, y in zip(ids, texts, ys, strict=True)])

    rows = sample.mapInArrow(measure, "id long, y int, x array<double>").collect()
    rows.sort(key=lambda r: (r["id"] is None, r["id"] or 0, r["x"]))
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], dtype=np.float64)
    model.weights, model.bias = fit_layer(x, y)
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The input with a double ``_toxicity`` (``_toxicity_`` and so on, if the input has that column)
    from 0 to 1, over the whole text.

    Null and empty texts have the score of a text without matches.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms of a bounded sample

    return docs.withColumn(free_name(docs, "_toxicity"), column_of(docs, text_col, lambda: shared.value.score, "double"))
