"""Quality rules: an isolation forest on rule statistics of documents.

A document's rule statistics are exact counts over its whole text.  The forest
isolates documents by random splits on ratios of them; a short mean path marks an
anomaly.  It is grown on the good ones of a bounded sample of labelled rows (the
``sample_rows`` rows with the smallest hash of their id), and the threshold is
calibrated on all labelled rows, losing at most ``max_good_loss`` of the good ones.

Defined cases: a NULL or empty text has no words and fails the word rule; a
repeated row gets a row each; without labelled good rows the forest gives no
verdict and only the base rules decide; labels with NULL quality are not used;
columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_schema, batches_of, lean_worker, small_batches

SAMPLE_ROWS = 6000
TREES = 120
TREE_ROWS = 256
MAX_GOOD_LOSS = 0.008
GOOD_WEIGHT = 20
#: Upper ends of the bins by which labelled rows are counted.
EDGES = np.arange(10_001) / 10_000
#: Standard deviations of the labelled sample by which cuts may lie outside a node's rows.
MARGIN = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SEED = 2025

SYMBOL = re.compile(rb"[#*$%&|<>]")
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Square roots of: code points a word, symbols a word, share of repeated lines, share of words in repeated windows.
RATIOS = ("word_length", "symbols", "dup_lines", "repeat_words")


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur at least twice in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    keys = ids[:n].copy()
    for i in range(1, size):
        keys = np.unique(keys, return_inverse=True)[1] * len(number) + ids[i:n + i]
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    steps = np.zeros(len(words) + 1, np.int64)
    hit = np.flatnonzero(counts[back] > 1)
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + size, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())




def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the RATIOS of a text."""
    data = (text or "").encode()
    words = data.split()  # on space and \x09-\x0D
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = len(SYMBOL.findall(data))
    lines = [x for x in data.split(b"\n") if x.split()]
    dups = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    d = max(n, 1)
    ratios = [math.sqrt(r) for r in (chars / d, symbols / d, dups / max(len(lines), 1), repeats / d)]
    return [n, chars, symbols, dups, repeats], ratios


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


class IsolationForest:
    """Trees of random splits; ``score`` is 2 ** (-mean path / expected path), higher for anomalies."""

    def __init__(self, x: np.ndarray, margin: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.expected = self.average_path(min(rows, len(x)))
        self.margin = margin
        self.trees = []
        for _ in range(trees):
            own = x[rng.choice(len(x), min(rows, len(x)), replace=False)]
            self.trees.append(self.grow(own, rng, math.ceil(math.log2(max(len(own), 2)))))

    @staticmethod
    def average_path(n: float) -> float:
        """Mean path of an unsuccessful search in a binary search tree of n rows."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(self, x: np.ndarray, rng, depth: int) -> list[np.ndarray]:
        """Arrays of a tree: column (-1 at a leaf), cut, left child (the right one follows it), path length at a leaf."""
        column, cut, child, path = [], [], [], []
        todo = [(x, 0, self.add(column, cut, child, path))]
        while todo:
            own, at, i = todo.pop()
            if at >= depth or len(own) < 2:
                path[i] = at + self.average_path(len(own))
                continue
            k = int(rng.integers(own.shape[1]))
            # Cuts also fall beyond the node's range, so that a value outside all of its rows parts early,
            # in columns that are constant among good rows too.
            column[i], cut[i] = k, rng.uniform(own[:, k].min() - self.margin[k], own[:, k].max() + self.margin[k])
            child[i] = self.add(column, cut, child, path)
            self.add(column, cut, child, path)
            left = own[:, k] < cut[i]
            for part, j in ((own[left], child[i]), (own[~left], child[i] + 1)):
                if len(part):
                    todo.append((part, at + 1, j))
                else:
                    path[j] = at + 1
        return [np.array(column), np.array(cut), np.array(child), np.array(path)]

    @staticmethod
    def add(column, cut, child, path) -> int:
        column.append(-1), cut.append(0.0), child.append(0), path.append(0.0)
        return len(column) - 1

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for column, cut, child, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := np.flatnonzero(column[at] >= 0)).size:
                node = at[inner]
                at[inner] = child[node] + (x[inner, column[node]] >= cut[node])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(self.expected, 1e-9))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, quality) of the ``rows`` labelled rows with the smallest hash of their id."""
    chosen = (labels.filter("quality is not null and doc_id is not null")
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows of two numbers


def calibrate(good: np.ndarray, bad: np.ndarray, max_good_loss: float) -> float:
    """The highest score to keep, from the numbers of good and bad rows by score bin: of the EDGES that lose at most
    ``max_good_loss`` of the good rows, the one with the least GOOD_WEIGHT * (share of good rows lost) + (share of bad rows kept)."""
    lost = 1 - np.cumsum(good) / good.sum()
    kept = np.cumsum(bad) / max(bad.sum(), 1)
    cost = np.where(lost <= max_good_loss, GOOD_WEIGHT * lost + kept, np.inf)
    return float(EDGES[np.argmin(cost)])


def scored_bins(docs: DataFrame, labels: DataFrame, forest) -> DataFrame:
    """(quality, bin, n): the labelled rows that pass the base rules by score; a score of bin i is at most EDGES[i]."""
    labelled = labels.filter("quality is not null and doc_id is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if labelled.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # else all are scored, as ids shuffle and texts do not
        texts = texts.join(F.broadcast(labelled.select("doc_id")), "doc_id", "left_semi")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, ratios = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                base, found = statistics(text.as_py())
                if not base_failed(base[0], base[4]):
                    ids.append(doc_id), ratios.append(found)
            if ids:
                bins = np.searchsorted(EDGES, np.minimum(forest.score(np.array(ratios, float)), 1.0))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bins.astype(np.int32))], names=["doc_id", "bin"])

    return texts.mapInArrow(run, "doc_id long, bin int").join(labelled, "doc_id").groupBy("quality", "bin").agg(
        F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_good_loss: float = MAX_GOOD_LOSS):
    """(forest, threshold), or None without labelled good rows. The forest grows on a sample, the threshold covers all
    labelled rows."""
    sample = labelled_sample(docs, labels, sample_rows)

    def run(batches):
        ddl = "quality int, " + ", ".join(f"{c} double" for c in RATIOS)

        def rows():
            for b in batches:
                for text, quality in zip(b.column(1), b.column(2).to_pylist()):
                    base, ratios = statistics(text.as_py())
                    if not base_failed(base[0], base[4]):
                        yield quality, *ratios

        yield from batches_of(rows(), arrow_schema(ddl))

    stats = sample.mapInArrow(run, "quality int, " + ", ".join(f"{c} double" for c in RATIOS))
    # Ids may repeat in documents; a bounded sample by hash grows the forest, whatever the order of rows.
    got = stats.orderBy(F.xxhash64(*stats.columns), *stats.columns).limit(4 * sample_rows).toPandas().sort_values(stats.columns)
    x = got[list(RATIOS)].to_numpy(float)
    good = x[(got["quality"] == 1).to_numpy()]
    if len(good) < 8:
        return None
    forest = IsolationForest(good, MARGIN * x.std(0) + 1e-9)
    counts = np.zeros((2, len(EDGES)))
    for r in scored_bins(docs, labels, forest).collect():  # at most two rows for each bin
        if r.quality in (0, 1):
            counts[r.quality, r.bin] += r.n
    return forest, calibrate(counts[1], counts[0], max_good_loss)


def judge(docs: DataFrame, model) -> DataFrame:
    """BASE, base_failed, score (NULL without a model) and kept of every document."""
    ddl = BASE + ", base_failed boolean, score double, kept boolean"

    def run(batches):
        def rows():
            for b in batches:
                ids = b.column(0).to_pylist()
                found = [statistics(t.as_py()) for t in b.column(1)]
                if not found:
                    continue
                scores, limit = [None] * len(ids), None
                if model:
                    forest, limit = model
                    scores = forest.score(np.array([r for _, r in found])).tolist()
                for doc_id, (base, _), score in zip(ids, found, scores):
                    failed = base_failed(base[0], base[4])
                    yield doc_id, *base, failed, score, not failed and (score is None or score <= limit)

        yield from batches_of(rows(), arrow_schema(ddl))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def keep_documents(docs: DataFrame, model) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        lean_worker()
        for b in batches:
            if not b.num_rows:
                continue
            found = [statistics(t.as_py()) for t in b.column(at)]
            kept = np.array([not base_failed(s[0], s[4]) for s, _ in found])
            if model:
                forest, limit = model
                kept &= forest.score(np.array([r for _, r in found])) <= limit
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
