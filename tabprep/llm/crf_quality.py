"""Document quality from a linear-chain conditional random field over lines.

Every line with a word gets statistics; a line's features are its own and those
of the lines beside it.  The field has two labels, good and bad, with
weights for features and for pairs of neighbouring labels.  Forward-backward gives
each line's probability of being good, and a document's quality is their mean
weighted by the lines' lengths, calibrated by a logistic curve.

Learning uses a bounded sample: the ``sample_rows`` labelled rows with the smallest
hash of their id, after those held out (crc32 of the id as text divisible by
``folds``) are left out.  Labels are given for documents; all lines of a good document are
good, and a line of a bad document is bad if a logistic model of single lines,
refitted on its own verdicts, says so or if it is that document's worst.

Only the text is an input of a score.  Defined cases: a NULL text is empty; a text
without lines scores as the share of good rows in the sample; without labelled
rows of both kinds every score is 0.5; a NULL id is not held out; repeated
rows get equal scores; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of

FOLDS = 5
SAMPLE_ROWS = 4000
THRESHOLD = 0.3
STEPS = 120
L2 = 1e-3

SYMBOLS = re.compile(r"[#*$%&|<>]")
MARKS = re.compile(r"[!?]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGITS = re.compile(r"[0-9]")
STATS = 13


def line_statistics(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, lengths) of the lines that have a word."""
    rows, lengths, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = line.split()
        if not words:
            continue
        n, chars = len(words), sum(map(len, words))
        key = hash(line)
        pairs = len(set(zip(words, words[1:])))
        rows.append((1.0, np.log1p(n), chars / n, min(len(SYMBOLS.findall(line)) / n, 4.0), min(len(MARKS.findall(line)) / n, 4.0),
                     len(UPPER.findall(line)) / chars, len(DIGITS.findall(line)) / chars, 1 - len(set(words)) / n,
                     1 - pairs / max(n - 1, 1), float(key in seen), float(words[-1][-1] in ".!?:;\"'"),
                     float(words[0][:1].isupper()), min(max(map(len, words)), 60) / 20))
        seen.add(key)
        lengths.append(chars)
    return np.array(rows, np.float32).reshape(-1, STATS), np.array(lengths, np.float64)


def with_neighbours(stats: np.ndarray) -> np.ndarray:
    """Features of each line: its statistics, and those of the line before and the line after (zeros at the ends)."""
    none = np.zeros((1, stats.shape[1]), stats.dtype)
    return np.hstack([stats, np.vstack([none, stats[:-1]]), np.vstack([stats[1:], none])])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 15, l2: float = L2) -> np.ndarray:
    """Weights of a logistic model by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) / len(x) - l2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x / len(x) + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class LineField:
    """The field: standardised features, weights of label 1 (good) against 0, and pair weights."""

    def __init__(self, mean, scale, w, pairs, curve, prior):
        self.mean, self.scale, self.w, self.pairs, self.curve, self.prior = mean, scale, w, pairs, curve, prior

    def features(self, stats: np.ndarray) -> np.ndarray:
        return with_neighbours((stats - self.mean) / self.scale)

    @staticmethod
    def marginals(emit: list[np.ndarray], pairs: np.ndarray):
        """(P(good) of every line, expected pair counts, log Z) of documents whose lines score ``emit`` for good. All documents
        advance together, longest first, so a step has only those that are that long."""
        order = sorted(range(len(emit)), key=lambda i: -len(emit[i]))
        sizes = np.array([len(emit[i]) for i in order])
        longest = int(sizes[0]) if len(sizes) else 0
        active = [int((sizes > t).sum()) for t in range(longest)]
        rows = [np.array([emit[i][t] for i in order[:active[t]]]) for t in range(longest)]
        forward = []
        for t in range(longest):
            now = np.zeros((active[t], 2))
            if t:
                before = forward[-1][:active[t]]
                now = np.logaddexp(before[:, :1] + pairs[0], before[:, 1:] + pairs[1])
            now = now.copy()
            now[:, 1] += rows[t]
            forward.append(now)
        good = [np.zeros(n) for n in sizes]
        expected, log_z = np.zeros((2, 2)), np.zeros(len(sizes))
        after = np.zeros((0, 2))
        for t in range(longest - 1, -1, -1):
            back = np.zeros((active[t], 2))
            k = len(after)
            if k:
                ahead = after.copy()
                ahead[:, 1] += rows[t + 1]
                back[:k] = np.logaddexp(ahead[:, :1] + pairs[:, 0], ahead[:, 1:] + pairs[:, 1])
            both = forward[t] + back
            z = np.logaddexp(both[:, 0], both[:, 1])
            if k:
                joint = forward[t][:k, :, None] + pairs[None] + ahead[:, None, :] - z[:k, None, None]
                expected += np.exp(joint).sum(0)
            p = np.exp(both[:, 1] - z)
            for i in range(active[t]):
                good[i][t] = p[i]
            log_z = z if t == 0 else log_z
            after = back
        out = [np.zeros(0)] * len(emit)
        for i, g in zip(order, good):
            out[i] = g
        return out, expected, float(log_z.sum()) if longest else 0.0

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Quality of documents given as (statistics, lengths)."""
        good, _, _ = self.marginals([self.features(s) @ self.w if len(s) else np.zeros(0) for s, _ in docs], self.pairs)
        mean = np.array([np.average(g, weights=n) if len(g) else np.nan for g, (_, n) in zip(good, docs)])
        curved = 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * mean)))
        return np.where(np.isnan(mean), self.prior, curved)

    @classmethod
    def fit(cls, docs: list[tuple[np.ndarray, np.ndarray]], quality: np.ndarray, steps: int = STEPS) -> "LineField":
        prior = float(quality.mean()) if len(quality) else 0.5
        held = [i for i, (s, _) in enumerate(docs) if len(s)]
        labels = quality[held]
        if not len(held) or labels.min() == labels.max():
            return cls(np.zeros(STATS), np.ones(STATS), np.zeros(3 * STATS), np.zeros((2, 2)), np.zeros(2), 0.5)
        docs = [docs[i] for i in held]
        lines = np.vstack([s for s, _ in docs])
        mean, scale = lines.mean(0), lines.std(0) + 1e-6
        mean[0], scale[0] = 0.0, 1.0  # the constant
        field = cls(mean, scale, np.zeros(3 * STATS), np.zeros((2, 2)), np.zeros(2), prior)
        x = [field.features(s).astype(np.float64) for s, _ in docs]
        flat, starts = np.vstack(x), np.cumsum([0] + [len(a) for a in x])
        of_doc = np.repeat(labels, np.diff(starts))
        y = of_doc.astype(float)
        for _ in range(3):
            share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
            p = 1 / (1 + np.exp(-np.clip(flat[:, :STATS] @ logistic(flat[:, :STATS], y, share), -30, 30)))
            y = np.where(of_doc == 1, 1.0, (p >= 0.5).astype(float))
            for i in np.flatnonzero(labels == 0):
                y[starts[i] + np.argmin(p[starts[i]:starts[i + 1]])] = 0.0
        told = np.zeros((2, 2))
        for i in range(len(x)):
            own = y[starts[i]:starts[i + 1]].astype(int)
            np.add.at(told, (own[:-1], own[1:]), 1)
        # Adam on the conditional likelihood of the line labels.
        theta = np.zeros(3 * STATS + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            w, pairs = theta[:-4], theta[-4:].reshape(2, 2)
            good, expected, _ = cls.marginals(np.split(flat @ w, starts[1:-1]), pairs)
            g = np.concatenate([flat.T @ (y - np.concatenate(good)), (told - expected).ravel()]) / len(flat) - L2 * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        field.w, field.pairs = theta[:-4], theta[-4:].reshape(2, 2)
        good, _, _ = cls.marginals([a @ field.w for a in x], field.pairs)
        quality_mean = np.array([np.average(g, weights=n) for g, (_, n) in zip(good, docs)])
        field.curve = logistic(np.column_stack([np.ones(len(docs)), quality_mean]), labels.astype(float), np.ones(len(docs)), 40, 1e-4)
        return field


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS) -> LineField:
    """Learns from the labelled rows that are not held out."""
    chosen = (labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id"), folds))
              .groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample_rows`` rows of two numbers
    ddl = "doc_id long, quality int, stats binary, lengths binary"

    def run(batches):
        def rows():
            for b in batches:
                for doc_id, text, quality in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                    stats, lengths = line_statistics(text.as_py())
                    yield doc_id, quality, stats.tobytes(), lengths.tobytes()

        yield from batches_of(rows(), arrow_schema(ddl), 200)

    got = sorted(sample.mapInArrow(run, ddl).collect())  # bounded by the sample
    pairs = [(np.frombuffer(r["stats"], np.float32).reshape(-1, STATS), np.frombuffer(r["lengths"], np.float64)) for r in got]
    return LineField.fit(pairs, np.array([r["quality"] for r in got], int))


def score(docs: DataFrame, field: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    ddl = "doc_id long, score double, predicted int"

    def run(batches):
        def rows():
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1)
                for at in range(0, len(ids), 500):
                    found = [line_statistics(t.as_py()) for t in texts[at:at + 500]]
                    for doc_id, p in zip(ids[at:at + 500], field.score(found).tolist()):
                        yield doc_id, p, int(p >= threshold)

        yield from batches_of(rows(), arrow_schema(ddl))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)
