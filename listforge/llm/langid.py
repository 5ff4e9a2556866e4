"""Language of a text: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased, everything but letters becomes a blank, and its byte 2-, 3- and
4-grams are hashed into buckets.  Each bucket has an embedding; a text is the mean of its
grams' embeddings, a linear layer and a softmax give the classes.  Embeddings and layer are
trained by stochastic gradient descent in numpy on a bounded, documented sample of labelled
rows; a part of the sample that the descent does not see sets the softmax temperature and
the score below which a text is rejected.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import batches, column_of, free_name, give_back, keep_only
from listforge.session import ship_package

BUCKET_BITS = 14
DIM = 16
SAMPLE_DOCS = 4000       # expected size of the training sample
PRIOR = 20               # answers that weigh as much as knowing none: the threshold is then halfway to chance
UNSURE = 0.005           # of the right calibration answers are less sure than the one that sets the threshold
UNDETERMINED = "und"
_PIECE = 1 << 20         # bytes hashed at a time
_LETTER = re.compile(r"[^\W\d_]")
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def gram_buckets(text: str, bits: int = BUCKET_BITS):
    """Yield arrays of bucket numbers, for pieces of the whole text."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), dtype=np.uint8)
    shift = np.uint32(32 - bits)
    for lo in range(0, len(raw), _PIECE):
        a = _BLANKED[raw[lo:lo + _PIECE + 3]].astype(np.uint32)
        last = lo + _PIECE >= len(raw)
        h = a[:-1] * np.uint32(257) + a[1:]
        for n, mul in zip((2, 3, 4), _MUL, strict=True):
            if n > 2:
                h = h[:-1] * np.uint32(0x01000193) + a[n - 1:]
            own = h if last else h[:_PIECE]
            yield (own * mul) >> shift
            if len(h) < 2:
                break


@dataclass
class LanguageModel:
    classes: list[str]
    logits: np.ndarray          # bucket -> class: the embedding times the layer
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    bits: int = BUCKET_BITS

    def scores(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.classes)), 0
        for idx in gram_buckets(text, self.bits):
            counts = np.bincount(idx, minlength=len(self.logits)) if len(idx) > 4 * len(self.logits) else None
            total += counts @ self.logits if counts is not None else self.logits[idx].sum(axis=0, dtype=np.float64)
            n += len(idx)
        return _softmax((total / max(n, 1) + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); ``und`` with score 0 for no text, no letter or no classes."""
        if not self.classes or not has_letter(text):
            return UNDETERMINED, 0.0
        p = self.scores(text)
        k = int(np.argmax(p))
        return self.classes[k], float(min(1.0, max(0.0, p[k])))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def pack(buckets: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending buckets as deflated gaps, counts deflated in the fewest bytes that hold them all."""
    width = np.min_scalar_type(counts.max()).newbyteorder("<")
    return tuple(zlib.compress(a.tobytes(), 1) for a in (np.diff(buckets, prepend=0).astype("<u2"), counts.astype(width)))


def unpack(buckets: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, raw = np.frombuffer(zlib.decompress(buckets), "<u2"), zlib.decompress(counts)
    return np.cumsum(gaps, dtype=np.uint16).astype("<u2"), np.frombuffer(raw, f"<u{len(raw) // len(gaps)}")


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], dim: int = DIM, bits: int = BUCKET_BITS,
        epochs: int = 12, batch: int = 32, rate: float = 6.0, seed: int = 7) -> LanguageModel:
    """rows: (buckets, counts, label), in a fixed order."""
    classes = sorted({r[2] for r in rows})
    size = 1 << bits
    if not classes:
        return LanguageModel([], np.zeros((size, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    held, seen = [r for i, r in enumerate(rows) if i % 5 == 4], [r for i, r in enumerate(rows) if i % 5 != 4]
    emb = rng.normal(0, 0.1, (size, dim)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (dim, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32)
    label = {c: k for k, c in enumerate(classes)}

    def dense(part):
        x = np.zeros((len(part), size), dtype=np.float32)
        for i, (idx, n, _) in enumerate(part):
            n = n.astype(np.float32, copy=False)
            x[i, idx] = n / n.sum()
        return x

    steps, step = epochs * -(-len(seen) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(seen))
        for lo in range(0, len(seen), batch):
            part = [seen[i] for i in order[lo:lo + batch]]
            x, y = dense(part), np.array([label[r[2]] for r in part])
            h = x @ emb
            g = _softmax(h @ layer + bias)
            g[np.arange(len(part)), y] -= 1
            g /= len(part)
            lr = rate * (1 - step / steps)
            back = x.T @ (g @ layer.T)
            layer -= lr * (h.T @ g)
            bias -= 0.1 * lr * g.sum(axis=0)
            emb -= lr * back
            step += 1
    model = LanguageModel(classes, (emb @ layer).astype(np.float32), bias.astype(np.float64), bits=bits)
    if held:
        raw = np.concatenate([dense(held[i:i + 64]) @ model.logits for i in range(0, len(held), 64)]) + bias
        y = np.array([label[r[2]] for r in held])
        heat = [0.25 * 1.25 ** i for i in range(16)]
        loss = [-np.log(_softmax(raw / t)[np.arange(len(y)), y] + 1e-12).mean() for t in heat]
        model.temperature = float(heat[int(np.argmin(loss))])
        p = _softmax(raw / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        # rejected: below half the confidence, over chance, of an unsure right answer (by rank, so
        # one row does not decide), drawn towards chance as far as few answers support it
        chance = 1 / len(classes)
        unsure = np.quantile(right, UNSURE, method="lower") if len(right) else chance
        model.reject_below = float(chance + 0.5 * max(0.0, unsure - chance) * len(right) / (len(right) + PRIOR))
    return model


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Fit on labelled rows for which ``usable`` holds.

    The sample is bounded: of every language the rows whose id hash falls below a share of the
    range, chosen so that ``sample_docs`` are expected in all and as many of each language
    (all rows of a language that has fewer).  Whole texts are hashed in the tasks; the driver
    gets bucket counts, at most 2**14 pairs a row, packed (``pack``).
    """
    ship_package(docs.sparkSession)
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(
        F.count(F.lit(1)).alias("n")).collect()}  # a row a language: the classes of the model
    each = sample_docs / max(1, len(sizes))
    if any(n > each for n in sizes.values()):
        # the hash's upper 40 bits, as a share of their range
        place = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), F.col(id_col)), 24)
        share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, each / n) * (1 << 40)))])
        rows = rows.where(place < F.element_at(share, F.col(lang_col).cast("string")))

    def count(parts):
        keep_only()
        make = batches({"id": pa.string(), "lang": pa.string(), "buckets": pa.binary(), "counts": pa.binary()})
        for batch in parts:
            out = []
            for name, lang, value in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = value.as_py()
                if has_letter(text):
                    total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
                    for idx in gram_buckets(text):
                        total += np.bincount(idx, minlength=1 << BUCKET_BITS)
                    hit = np.flatnonzero(total)
                    out.append((name.as_py(), lang.as_py(), *pack(hit, total[hit])))
            yield make(out)
        give_back()

    got = rows.select(F.col(id_col).cast("string"), F.col(lang_col).cast("string"),
                      F.col(text_col).cast("string")).mapInArrow(
        count, "id string, lang string, buckets binary, counts binary").collect()
    sample = [(r["id"] or "", r["lang"], *unpack(r["buckets"], r["counts"])) for r in got]
    del got
    sample.sort(key=lambda r: (*r[:2], r[2].tobytes()))
    mixed = np.random.default_rng(11).permutation(len(sample))
    model = fit([(sample[i][2], sample[i][3], sample[i][1]) for i in mixed])
    del sample
    give_back()  # the driver lives on through all that follows
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The input with a struct ``_lang`` (``common.free_name``, if it has one): lang_pred, score, rejected.

    The whole text counts.  Null texts and texts without a letter are ``und``, score 0 and
    rejected; so is everything if no row was labelled.  Other texts get a learned language;
    ``rejected`` says that the calibrated score is below the model's threshold.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**14 buckets x classes: a parameter

    def predictor():
        m = shared.value

        def predict(text):
            lang, score = m.predict(text)
            return {"lang_pred": lang, "score": score, "rejected": lang == UNDETERMINED or score < m.reject_below}

        return predict

    return docs.withColumn(free_name(docs, "_lang"), column_of(docs, text_col, predictor,
                                              "struct<lang_pred: string, score: double, rejected: boolean>"))
