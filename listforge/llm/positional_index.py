"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The postings (document row, position) of every word that a benchmark item uses are written
once, sharded by document.  A window is sought from its two rarest words: their postings,
moved by the words' offsets, meet where a document may hold the item at that alignment.  Only
there the lists of the other words are intersected, word by word on (row, position), and runs
of enough consecutive words are the phrases.  ``proximity_matches`` does the same with places
that may be off by ``slack``.

A frequent word is looked up only beside a rarer one, every shuffle is keyed by document row
(and position), and tables made from the benchmark are broadcast only below a counted size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listforge.llm.common import BROADCAST_ROWS, lower_ascii, small
from listforge.session import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
BROADCAST_CHARS = 8_000_000  # a vocabulary of more is joined by a shuffle
SALTS = 64  # of a vocabulary that is too large to broadcast
_HEAD = ""  # no word is empty: the posting at 0 stands for the document


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def benchmark_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                    window: int = WINDOW) -> DataFrame:
    """(item, item_id, words, n: the words of its windows); items without words are left out."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"),
                        words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0).distinct()
    return materialize(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "words",
                                   F.least(F.lit(window), F.size("words")).alias("n")), "bench-items")


def positional_postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """The index, written: (row, pos from 1, term) of all words in ``terms``, in document order.

    Every document also has a posting of the empty term at position 0, which carries its id
    (``doc_id``) and ``n_words``.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       words_of(F.col(text_col)).alias("words"))
    rows = rows.select("row", "id", "words", F.size("words").alias("n"))
    each = rows.select("row", "id", "n", F.posexplode(F.concat(F.array(F.lit(_HEAD)), "words")).alias("pos", "term"))
    terms = terms.select("term").unionByName(terms.sparkSession.createDataFrame([(_HEAD,)], "term string"))
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    if size["n"] <= BROADCAST_ROWS and size["chars"] <= BROADCAST_CHARS:
        found = each.join(F.broadcast(terms), "term")
    else:  # a common word's occurrences meet it in ``SALTS`` places
        salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        place = F.pmod(F.col("row") + F.col("pos"), F.lit(SALTS)).cast("int")
        found = each.withColumn("salt", place).join(salted, ["term", "salt"])
    head = F.col("pos") == 0
    return materialize(found.select("row", "pos", "term", F.when(head, F.col("id")).alias("doc_id"),
                                    F.when(head, F.col("n").cast("long")).alias("n_words")), "bench-postings")


def rarest_words(items: DataFrame, postings: DataFrame, count: int) -> DataFrame:
    """(item, s, q, term, need): of every window from s on, the ``count`` words with the shortest
    lists, at item positions q (from 0).  Windows with a word that no document has are left out."""
    frequency = postings.where(F.col("term") != _HEAD).groupBy("term").agg(F.count(F.lit(1)).alias("f"))
    at = items.select("item", "n", F.size("words").alias("size"), F.posexplode("words").alias("q", "term"))
    at = at.join(frequency, "term", "left")
    windows = at.select("item", "n", "q", "term", "f", F.explode(F.sequence(
        F.greatest(F.col("q") - F.col("n") + 1, F.lit(0)), F.least(F.col("q"), F.col("size") - F.col("n")))).alias("s"))
    whole = Window.partitionBy("item", "s")
    ranked = windows.withColumn("known", F.count("f").over(whole)).withColumn(
        "rank", F.row_number().over(whole.orderBy("f", "q")))
    return ranked.where((F.col("known") == F.col("n")) & (F.col("rank") <= count)).select(
        "item", "s", "q", "term", F.least(F.lit(count), F.col("n")).alias("need"))


def phrase_runs(postings: DataFrame, items: DataFrame) -> DataFrame:
    """(row, item_id, first, last): maximal runs of document words that equal consecutive item
    words, at least as long as the item's windows."""
    anchors = small(materialize(rarest_words(items, postings, 2).select("item", "q", "term", "need").distinct(),
                                "bench-anchors"))
    moved = postings.join(anchors, "term").groupBy("row", "item", (F.col("pos") - F.col("q")).alias("at"), "need")
    aligned = moved.agg(F.collect_set("q").alias("qs")).where(F.size("qs") >= F.col("need"))
    aligned = materialize(aligned.select("row", "item", "at", "qs"), "bench-aligned")
    around = aligned.join(small(items.drop("item_id"), BROADCAST_ROWS // 10), "item").select(
        "row", "item", "at", "words", "n", F.explode(F.expr("""
            array_distinct(flatten(transform(qs, q -> sequence(greatest(q - n + 1, 0), least(q + n - 1, size(words) - 1)))))
        """)).alias("q"))
    wanted = around.select("row", "item", "at", "n", "q", (F.col("at") + F.col("q")).alias("pos"),
                           F.get("words", F.col("q")).alias("term")).where("pos >= 1")
    holders = aligned.select("row").distinct()
    lists = postings.select("row", "pos", "term")
    if holders.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        lists = lists.join(F.broadcast(holders), "row", "left_semi")
    met = wanted.join(lists, ["row", "pos", "term"])
    line = Window.partitionBy("row", "item", "at").orderBy("q")
    met = met.select("row", "item", "at", "n", "q", "pos", (F.col("q") - F.row_number().over(line)).alias("run"))
    runs = met.groupBy("row", "item", "at", "n", "run").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("long"))
    return runs.where(F.col("long") >= F.col("n")).join(small(items.select("item", "item_id")), "item").select(
        "row", "item_id", "first", "last")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word is hit inside any occurrence of ``window`` consecutive words of an item, or
    of a whole shorter item.  Null and empty texts have no words, so neither has hits.  Null and
    repeated document ids keep their rows, each judged by its own text.  Items that repeat an id
    count as one item, a null item id as the empty text; other columns are not looked at.  Empty
    tables give an empty result, or one without hits.
    """
    items = benchmark_items(benchmark, item_col, item_text_col, window)
    terms = items.select(F.explode("words").alias("term")).distinct()
    postings = positional_postings(docs, terms, id_col, text_col)
    runs = materialize(phrase_runs(postings, items), "bench-runs")
    before = Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(F.max("last").over(before), F.lit(0)))
    hits = runs.select("row", F.greatest(fresh, F.lit(0)).alias("fresh")).groupBy("row").agg(
        F.sum("fresh").cast("long").alias("n_hit"))
    names = runs.select("row", "item_id").distinct().groupBy("row").agg(
        F.array_sort(F.collect_list("item_id")).alias("names"))
    heads = postings.where(F.col("term") == _HEAD).select("row", "doc_id", "n_words")
    out = heads.join(hits.join(names, "row"), "row", "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("names", F.array().cast("array<string>"))
    return out.select(F.col("doc_id").alias(id_col), "n_words", n_hit.alias("n_hit"),
                      F.size(names).cast("long").alias("n_items"),
                      F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slack: int, id_col: str = "doc_id",
                      text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, s, pos): windows from item word s (from 0) whose words all stand near.

    ``pos`` (from 1) is where the window would begin, judged by an occurrence of its rarest word
    (ties: the first); each other word stands at most ``slack`` places from where it then would.
    With slack 0 these are the exact phrases.  Repeated words of a window may share a place.
    Nulls, repeated ids and empty tables as in ``contamination``.
    """
    items = benchmark_items(benchmark, item_col, item_text_col, window)
    terms = items.select(F.explode("words").alias("term")).distinct()
    postings = positional_postings(docs, terms, id_col, text_col)
    anchors = small(materialize(rarest_words(items, postings, 1), "near-anchors"))
    start = F.col("pos") - F.col("q") + F.col("s")
    aligned = postings.join(anchors, "term").select("row", "item", "s", start.alias("start"))
    width = 2 * slack + 1  # a place's neighbours lie in its own or an adjoining cell of this many places
    wanted = aligned.join(small(items, BROADCAST_ROWS // 10), "item").select(
        "row", "item", "item_id", "s", "start", "n",
        F.posexplode(F.slice("words", F.col("s") + 1, F.col("n"))).alias("k", "term"))
    wanted = wanted.withColumn("due", F.col("start") + F.col("k")).withColumn("cell", F.explode(F.array(
        *[F.floor(F.col("due") / width) + i for i in (-1, 0, 1)])))
    lists = postings.where(F.col("term") != _HEAD).select(
        "row", "term", "pos", F.floor(F.col("pos") / width).alias("cell"))
    met = wanted.join(lists, ["row", "term", "cell"]).where(F.abs(F.col("pos") - F.col("due")) <= slack)
    whole = met.groupBy("row", "item", "item_id", "s", "start", "n").agg(F.count_distinct("k").alias("k"))
    heads = postings.where(F.col("term") == _HEAD).select("row", "doc_id")
    return whole.where("k = n").join(heads, "row").select(
        F.col("doc_id").alias(id_col), "item_id", "s", F.col("start").alias("pos")).distinct()
