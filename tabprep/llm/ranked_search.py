"""Ranked lexical search over a length-stratified index.

A term is a maximal run of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.  With N documents that
have a term, L terms in all, n terms in a document, df documents that hold a term and tf its occurrences in one,

    m = 10 + (90 * n * N) div L           the document's length normaliser
    w = floor(1000 * ln((2N + 2) / (2df + 1)))
    impact = (10**9 * tf) div (1000 * tf + 8 * m)
    score = sum of w * impact over the terms of the query, once each

*Index.*  Strata lie side by side in the order of m, each as long as the bytes of its documents; a document's place in its stratum is
its hash, and a task gets ``PART_BYTES`` of that line.  So equal m meet, a normaliser that a third of all documents have is
spread over many tasks, and long documents weigh what they hold.  A row of the written index is a segment: documents of one
stratum (equal m), at most ``SEGMENT_POSTINGS`` postings or one document.  Its postings are ordered by term and falling tf,
as runs of equal tf: within a stratum an impact depends on tf alone, so it is computed once for each run, and the first run of
a term bounds it.

*Search.*  A segment's bound for a query is the sum of w * (impact of the first run) over the query's terms in it.  The
segments with the highest bounds of the whole index are scored first and give each query a threshold: the score of
its k-th document there.  Then every task visits its segments in the order of their bounds, skips those below the
threshold, which rises as documents are found, and sends its k best; a window keeps the k best of all.  No document
that belongs to the result can be skipped: equal bounds are visited.

Queries go through the index in blocks of ``BLOCK_TERMS`` terms, so what a task holds of them is bounded whatever their number.

Defined cases: a NULL or empty text has no terms, counts in neither N nor L and is never found; rows with equal ids are
documents of their own; a NULL id ranks behind all ids of the same score (the id 2**63 - 1 is kept for it); rows of one
item_id, NULL among them, are one query with the terms of all; a query without a known term has no rows; an
empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabprep.session import release

from .common import arrow_schema, batches_of, materialize, small

#: Fixed values of the score.
UNIT, TF_WEIGHT, M_WEIGHT, M_BASE, M_SLOPE = 1_000_000_000, 1000, 8, 10, 90

SEGMENT_POSTINGS = 500_000
SEGMENT_DOCS = 0xFFFF
#: Postings, and bounds for queries, of the segments that a task orders at a time.
GROUP_POSTINGS = 1_000_000
GROUP_BOUNDS = 2_000_000
#: Bytes of distinct terms and counts that a task turns into segments.
PART_BYTES = 16_000_000
BLOCK_TERMS = 200_000
#: Segments scored first for each query, besides the k that are wanted.
SEEDS = 6
NO_ID = 2 ** 63 - 1

#: Bytes of terms are kept, A-Z lower-cased, and all others become spaces.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FORWARD = "doc_id long, n long, terms binary, tfs binary"
SEGMENT = ("segment long, m long, n_postings long, docs binary, terms binary, runs binary, run_tf binary, "
           "run_size binary, places binary")


def terms_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(TERM_BYTES).split()


def binary(column):
    """The values of a string column as bytes."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def forward(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """FORWARD of every document with a term: its distinct terms and how often it has each."""
    def run(batches):
        def rows():
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), binary(b.column(1))):
                    words = terms_of(text)
                    if words:
                        counts = Counter(words)
                        yield (NO_ID if doc_id is None else doc_id, len(words), b" ".join(counts),
                               np.fromiter(counts.values(), np.int32, len(counts)).tobytes())

        yield from batches_of(rows(), arrow_schema(FORWARD), 64)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FORWARD)


def values(batch):
    """The rows of an Arrow batch, one at a time."""
    return (tuple(v.as_py() for v in row) for row in zip(*batch.columns))


def segment_row(m: int, held: list) -> tuple:
    """SEGMENT of documents (doc_id, terms, tfs) of one stratum."""
    import xxhash

    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(t, len(number)) for _, terms, _ in held for t in terms.split(b" ")), np.int64)
    names = sorted(number)
    rank = np.empty(len(names), np.int64)
    rank[[number[t] for t in names]] = np.arange(len(names))
    tfs = [np.frombuffer(x, np.int32) for _, _, x in held]
    codes, tf = rank[codes], np.concatenate(tfs).astype(np.int64)
    place = np.repeat(np.arange(len(held)), [len(x) for x in tfs])
    order = np.lexsort((place, -tf, codes))
    codes, tf, place = codes[order], tf[order], place[order]
    first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (tf[1:] != tf[:-1])])
    size = np.diff(np.r_[first, len(codes)])
    docs = np.array([d for d, _, _ in held], np.int64).tobytes()
    return (xxhash.xxh3_64_intdigest(docs, seed=m % 2 ** 32) - 2 ** 63, m, len(codes), docs, b" ".join(names),
            np.bincount(codes[first], minlength=len(names)).astype(np.int32).tobytes(), tf[first].astype(np.int32).tobytes(),
            size.astype(np.int32).tobytes(), place.astype(np.uint16).tobytes())


def segments(batches):
    """SEGMENT rows from Arrow batches of (m, doc_id, terms, tfs) in the order of m."""
    def rows():
        now, held, total = None, [], 0
        for b in batches:
            for m, doc_id, terms, tfs in values(b):
                if held and (m != now or total + len(tfs) // 4 > SEGMENT_POSTINGS or len(held) >= SEGMENT_DOCS):
                    yield segment_row(now, held)
                    held, total = [], 0
                now = m
                held.append((doc_id, terms, tfs))
                total += len(tfs) // 4
        if held:
            yield segment_row(now, held)

    yield from batches_of(rows(), arrow_schema(SEGMENT), 4)


@dataclass
class Queries:
    """A block of queries as tasks hold it: the terms, their weights and the queries that have them."""

    ids: list
    number: dict[bytes, int]
    holders: list[np.ndarray]
    weights: np.ndarray
    terms: list[np.ndarray]

    @staticmethod
    def of(block: list[tuple]) -> Queries:
        number: dict[bytes, int] = {}
        terms = [np.array([number.setdefault(t.encode(), len(number)) for t in own], np.int64) for _, own in block]
        holders: list[list[int]] = [[] for _ in number]
        for i, own in enumerate(terms):
            for v in own:
                holders[v].append(i)
        return Queries([i for i, _ in block], number, [np.array(h, np.int64) for h in holders],
                       np.zeros(len(number), np.int64), terms)


class Segment:
    """An index row opened for a block of queries."""

    def __init__(self, row: dict, queries: Queries):
        self.id, self.m, self.n_postings = row["segment"], row["m"], row["n_postings"]
        self.docs = np.frombuffer(row["docs"], np.int64)
        self.places = np.frombuffer(row["places"], np.uint16)
        self.size = np.frombuffer(row["run_size"], np.int32)
        tf = np.frombuffer(row["run_tf"], np.int32).astype(np.int64)
        self.impact = UNIT * tf // (TF_WEIGHT * tf + M_WEIGHT * self.m)  # once for each run of equal tf
        runs = np.r_[0, np.cumsum(np.frombuffer(row["runs"], np.int32))]
        starts = np.r_[0, np.cumsum(self.size)]
        self.at: dict[int, tuple[int, int, int, int]] = {}
        self.bounds = np.zeros(len(queries.ids), np.int64)
        for i, term in enumerate(row["terms"].split(b" ")):
            v = queries.number.get(term)
            if v is not None:
                x, y = int(runs[i]), int(runs[i + 1])
                self.at[v] = x, y, int(starts[x]), int(starts[y])
                self.bounds[queries.holders[v]] += queries.weights[v] * self.impact[x]
        self.made: dict[int, tuple] = {}

    def postings(self, v: int, weight: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, points) of a term, kept for the next query that has it."""
        if v not in self.made:
            x, y, a, b = self.at[v]
            self.made[v] = self.places[a:b], np.repeat(weight * self.impact[x:y], self.size[x:y])
        return self.made[v]

    def scores(self, query: int, queries: Queries) -> np.ndarray:
        total = np.zeros(len(self.docs), np.int64)
        for v in queries.terms[query].tolist():
            if v in self.at:
                places, points = self.postings(v, queries.weights[v])
                total[places] += points
        return total


def opened(batches, queries: Queries):
    """Lists of Segments of at most GROUP_POSTINGS postings, or one segment. A list is emptied before the next one is read."""
    group, total = [], 0
    for b in batches:
        names = b.schema.names
        for row in values(b):
            segment = Segment(dict(zip(names, row)), queries)
            if not segment.at:
                continue
            if group and (total + segment.n_postings > GROUP_POSTINGS or len(group) * len(queries.ids) > GROUP_BOUNDS):
                yield group
                group.clear()
                total = 0
            group.append(segment)
            total += segment.n_postings
    if group:
        yield group


def best(scores: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, equal ones by ascending id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = scores >= least
        scores, docs = scores[kept], docs[kept]
    order = np.lexsort((docs, -scores))[:k]
    return scores[order], docs[order]


def visit(batches, queries: Queries, thresholds: np.ndarray, k: int):
    """(query, doc_id, score) of the k best documents of the segments for each query, but those below its threshold."""
    limit = np.maximum(thresholds, 1)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.ids]
    for group in opened(batches, queries):
        bounds = np.stack([s.bounds for s in group])
        order = np.argsort(-bounds, axis=0, kind="stable")
        for q in np.flatnonzero(bounds.max(0) >= limit).tolist():
            for i in order[:, q].tolist():
                if bounds[i, q] < limit[q]:
                    break
                scores = group[i].scores(q, queries)
                own = np.flatnonzero(scores >= limit[q])
                if len(own):
                    found[q] = best(np.r_[found[q][0], scores[own]], np.r_[found[q][1], group[i].docs[own]], k)
                    if len(found[q][0]) == k:
                        limit[q] = max(limit[q], found[q][0][-1])
    for q, (scores, docs) in enumerate(found):
        yield from ((q, d, s) for s, d in zip(scores.tolist(), docs.tolist()))


def ranked(rows: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """The k rows of highest ``score`` of each ``key``, with their rank."""
    order = Window.partitionBy(key).orderBy(F.desc(score), F.asc(tie))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@dataclass
class Index:
    """A written index: ``segments`` is a table of SEGMENT rows."""

    segments: DataFrame
    n_docs: int
    n_terms: int
    written: list[str] = field(default_factory=list)

    @staticmethod
    def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
        spark, passing, written = docs.sparkSession, [], []
        texts = materialize(forward(docs, id_col, text_col), "search-forward", passing)
        weight = F.length("terms") + F.length("tfs")
        total = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l"),
                          F.coalesce(F.sum(weight), F.lit(0)).alias("bytes")).first()
        texts = texts.withColumn("m", F.expr(f"{M_BASE} + ({M_SLOPE} * n * {total.n}L) div {max(total.l, 1)}L"))
        # One row for each m: at most as many as the longest document has words for its share of the average.
        strata = texts.groupBy("m").agg(F.sum(weight).alias("bytes")).withColumn("start", F.coalesce(F.sum("bytes").over(
            Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        parts = max(total.bytes // PART_BYTES + 1, spark.sparkContext.defaultParallelism)
        at = F.col("start") + F.pmod(F.xxhash64("doc_id", "terms"), "bytes")
        part = F.floor(at / F.lit(float(max(total.bytes, 1))) * parts)
        placed = texts.join(small(strata), "m").select("m", "doc_id", "terms", "tfs", F.least(
            part, F.lit(parts - 1)).cast("int").alias("part")).repartitionById(parts, "part").sortWithinPartitions("m")
        found = materialize(placed.select("m", "doc_id", "terms", "tfs").mapInArrow(segments, SEGMENT), "search-index", written)
        release(spark, passing)
        return Index(found, total.n, total.l, written)

    def release(self) -> None:
        """Delete the written index."""
        release(self.segments.sparkSession, self.written)

    def weights(self, queries: Queries) -> np.ndarray:
        """w of every term of the block; 0 for terms that no document holds."""
        number = queries.number

        def run(batches):
            df = np.zeros(len(number), np.int64)
            for b in batches:
                for terms, runs, sizes in zip(*(b.column(i).to_pylist() for i in range(3))):
                    ends = np.cumsum(np.frombuffer(runs, np.int32))
                    upto = np.r_[0, np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64)][np.r_[0, ends]]
                    own = [(i, number[t]) for i, t in enumerate(terms.split(b" ")) if t in number]
                    if own:
                        i, v = np.array(own).T
                        df[v] += upto[i + 1] - upto[i]
            yield from batches_of(((int(v), int(df[v])) for v in np.flatnonzero(df)), arrow_schema("v long, df long"))

        counts = self.segments.select("terms", "runs", "run_size").mapInArrow(run, "v long, df long")
        w = np.zeros(len(number), np.int64)
        for r in counts.groupBy("v").agg(F.sum("df").alias("df")).collect():  # at most one row for each term of the block
            w[r.v] = math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * r.df + 1)))
        return w

    def thresholds(self, queries: Queries, k: int) -> np.ndarray:
        """For each query the score of the k-th document in the segments with its highest bounds; 0 if they have fewer."""
        most = k + SEEDS

        def run(batches):
            size = len(queries.ids)
            ids, bounds = np.zeros((0, size), np.int64), np.zeros((0, size), np.int64)  # the best so far, a column a query
            for group in opened(batches, queries):
                ids = np.vstack([ids, np.repeat([[s.id] for s in group], size, axis=1)])
                bounds = np.vstack([bounds, *[s.bounds for s in group]])
                if len(ids) > most:
                    kept = np.argpartition(-bounds, most - 1, axis=0)[:most]
                    ids, bounds = np.take_along_axis(ids, kept, 0), np.take_along_axis(bounds, kept, 0)
            yield from batches_of(((q, i, b) for q in range(size) for i, b in zip(ids[:, q].tolist(), bounds[:, q].tolist()) if b > 0),
                                  arrow_schema("query int, segment long, bound long"))

        seeds = ranked(self.segments.mapInArrow(run, "query int, segment long, bound long"), "query", "bound", "segment", most)
        chosen = {r.segment for r in seeds.select("segment").distinct().collect()}  # at most ``most`` for each query
        out = np.zeros(len(queries.ids), np.int64)
        if chosen:
            rows = self.visited(queries, out, k, chosen)
            last = ranked(rows, "query", "score", "doc_id", k).filter(F.col("rank") == k).collect()  # a row for each query
            for r in last:
                out[r.query] = r.score
        return out

    def visited(self, queries: Queries, thresholds: np.ndarray, k: int, only: set | None = None) -> DataFrame:
        ddl = "query int, doc_id long, score long"

        def run(batches):
            import pyarrow as pa

            if only is not None:
                batches = (b.filter(pa.array([s in only for s in b.column(0).to_pylist()], pa.bool_())) for b in batches)
            yield from batches_of(visit(batches, queries, thresholds, k), arrow_schema(ddl))

        return self.segments.mapInArrow(run, ddl)

    def search(self, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """(item_id, rank, doc_id, score) of the k best documents of every item."""
        spark, results = self.segments.sparkSession, []
        for block in query_blocks(items, id_col, text_col):
            queries = Queries.of(block)
            queries.weights = self.weights(queries)
            rows = self.visited(queries, self.thresholds(queries, k), k)
            names = spark.createDataFrame(list(enumerate(queries.ids)), "query int, item_id long")
            results.append(materialize(ranked(rows, "query", "score", "doc_id", k).join(F.broadcast(names), "query").select(
                "item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"), "search-found"))
        return union_all(results, spark, "item_id long, rank int, doc_id long, score long")


def query_blocks(items: DataFrame, id_col: str, text_col: str):
    """Lists of (item_id, terms) with at most BLOCK_TERMS terms, or one item; one block is in the driver at a time."""
    def run(batches):
        yield from batches_of(((i, t.decode()) for b in batches for i, text in zip(b.column(0).to_pylist(), binary(b.column(1)))
                               for t in dict.fromkeys(terms_of(text))), arrow_schema("item_id long, term string"))

    terms = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "item_id long, term string")
    block, total = [], 0
    for r in terms.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")).orderBy("item_id").toLocalIterator():
        if block and total + len(r.terms) > BLOCK_TERMS:
            yield block
            block, total = [], 0
        block.append((r.item_id, r.terms))
        total += len(r.terms)
    if block:
        yield block


def union_all(parts: list[DataFrame], spark: SparkSession, ddl: str) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], ddl)
    for p in parts[1:]:
        out = out.union(p)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``Index.search`` over an index that is built for it and deleted."""
    index = Index.build(docs)
    found = index.search(items, k)
    index.release()
    return found
