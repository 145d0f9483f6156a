"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

An item's windows are its runs of ``window`` consecutive words; a shorter item, if
it has words, is one window.  A window is a set of word shingles.  Because all of
them must occur in a document that contains the window, a prefix of one shingle is
enough for the join, and the rarest is taken: one pass counts the shingles of the
benchmark in all documents, each window keeps its rarest, and a window with a
shingle that no document has is dropped.  A second pass joins the documents'
shingles with these, applies the bounds on place and length, and verifies
the words of the window at their place.

Only DataFrame functions are used.  The benchmark's side of a join is broadcast
after a count; beyond ``broadcast_rows`` rows both sides are shuffled and the
words for the verification come from a second join on the document.

Defined cases: NULL and empty texts have no words and are clean; a NULL item id
makes words hit but is not listed or counted as an item; rows with equal
(doc_id, text) get equal results, one row each; items with equal ids are one item;
with an empty benchmark every document is clean; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.functions.names import unused

from .common import BROADCAST_ROWS, ascii_lower, materialize, small

#: Fixed value: what stands between words, after lower-casing A-Z.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def shingle_hashes(w: Column, size: int) -> Column:
    """Hashes of the ``size``-word shingles of a word array, in order of place."""
    at = lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, size)))
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - size + 1, F.lit(0))), at)


def item_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, window_words, n) of every distinct window."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (items.filter(F.size("w") > 0).withColumn("i", F.explode(starts))
            .select("item_id", F.slice("w", F.col("i"), window).alias("window_words"))
            .distinct().withColumn("n", F.size("window_words")))


def document_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(d, t, w, n_words, size, place, h): a row for each shingle of each document. The outer forms keep the optimizer
    from testing the arrays in a filter below, which would compute them again for each word."""
    sized = F.array(*[F.struct(F.lit(k).alias("size"), shingle_hashes(F.col("w"), k).alias("hashes")) for k in sizes])
    if len(sizes) == 1:
        one = docs.select("d", "t", "w", F.size("w").alias("n_words"), F.lit(sizes[0]).alias("size"),
                          shingle_hashes(F.col("w"), sizes[0]).alias("hashes"))
    else:
        one = docs.select("d", "t", "w", F.size("w").alias("n_words"), F.explode_outer(sized).alias("s")).select(
            "d", "t", "w", "n_words", "s.size", "s.hashes")
    return one.select("d", "t", "w", "n_words", "size", F.posexplode_outer("hashes").alias("place", "h"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, text): a document is known by its id and its text's hash."""
    return docs.select(F.col(id_col).alias("d"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(d, t, start, n, item_id): every place where a window of an item occurs; start counts words from 0."""
    windows = item_windows(benchmark, window, item_col, item_text_col)
    lengths = [r[0] for r in windows.select("n").distinct().collect()]  # at most ``window`` numbers
    sizes = sorted({min(shingle, n) for n in lengths}) or [shingle]
    of_window = windows.withColumn("size", F.least(F.col("n"), F.lit(shingle)))
    hashes = F.lit(None)
    for k in sizes:
        hashes = F.when(F.col("size") == k, shingle_hashes(F.col("window_words"), k)).otherwise(hashes)
    in_window = of_window.select("item_id", "window_words", "n", "size", F.posexplode(hashes).alias("offset", "h"))

    source = keyed(docs, id_col, text_col)
    worded = source.select("d", "t", words(F.col("text")).alias("w"))
    of_docs = document_shingles(worded, sizes)
    wanted = small(in_window.select("size", "h").distinct(), broadcast_rows)
    counts = of_docs.select("size", "h").join(wanted, ["size", "h"]).groupBy("size", "h").agg(
        F.count(F.lit(1)).alias("n_places"))
    rarest = materialize(in_window.join(counts, ["size", "h"], "left").groupBy("item_id", "window_words", "n", "size")
              .agg(F.min(F.struct(F.coalesce("n_places", F.lit(0)).alias("n_places"), "h", "offset")).alias("first"))
              .filter("first.n_places > 0")
              .select("item_id", "window_words", "n", "size", "first.h", "first.offset"), "decontam-rarest")
    bounds = (F.col("place") >= F.col("offset")) & (F.col("place") - F.col("offset") + F.col("n") <= F.col("n_words"))
    start = (F.col("place") - F.col("offset")).alias("start")
    same = lambda w: F.slice(w, F.col("start") + 1, F.col("n")) == F.col("window_words")
    if rarest.limit(broadcast_rows + 1).count() <= broadcast_rows:
        found = of_docs.join(F.broadcast(rarest), ["size", "h"]).filter(bounds).select(
            "d", "t", "w", start, "n", "item_id", "window_words").filter(same(F.col("w")))
    else:
        candidates = of_docs.drop("w").join(rarest, ["size", "h"]).filter(bounds).select(
            "d", "t", start, "n", "item_id", "window_words")
        once = worded.dropDuplicates(["d", "t"]).withColumnsRenamed({"d": "d2", "t": "t2"})
        found = candidates.join(once, F.col("d").eqNullSafe(F.col("d2")) & F.col("t").eqNullSafe(F.col("t2"))).filter(
            same(F.col("w")))
    return found.select("d", "t", "start", "n", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted array), n_items, contaminated, and t (the text's hash)."""
    found = occurrences(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    ends = found.groupBy("d", "t", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"),
                                                F.collect_set("item_id").alias("items"))
    before = Window.partitionBy("d", "t").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    hits = (ends.withColumn("new", F.greatest(new, F.lit(0))).groupBy("d", "t")
            .agg(F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            .withColumnsRenamed({"d": "d2", "t": "t2"}))
    source = keyed(docs, id_col, text_col)
    counted = source.select("d", "t", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(hits, F.col("d").eqNullSafe(F.col("d2")) & F.col("t").eqNullSafe(F.col("t2")), "left").select(
        F.col("d").alias(id_col), "t", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items")).withColumns({
            "n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns."""
    d, t = unused(docs.columns, "__d"), unused(docs.columns, "__t")
    bad = materialize(occurrences(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(
        F.col("d").alias(d), F.col("t").alias(t)).distinct(), "decontam-bad")
    return docs.join(small(bad), docs[id_col].eqNullSafe(F.col(d)) & F.xxhash64(docs[text_col]).eqNullSafe(F.col(t)), "left_anti")
