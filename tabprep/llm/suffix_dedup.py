"""Exact-substring dedup: removes every byte covered by a string of ``length`` bytes that also starts in a document of
smaller id.

Whole copies of a text go first, by digest.  What is left is cut so that equal strings meet:

1. Every ``length``-byte window has an anchor, the smallest hash of the ``ANCHOR``-byte strings in it, so equal windows have
   equal anchors.  A segment is a run of windows with one anchor.  Each task sends each of its anchors once to a bucket of
   anchors, and the bucket answers which of them other documents have.
2. Segments whose anchor several documents have are sent, once for each distinct segment of a task, to a bucket of anchors: a
   shard.  The shard dedups them again, some whole anchors at a time, and for those with several different segments builds the
   suffix array of their concatenation by induced sorting, and its permuted common prefixes.  Neighbours that have ``length`` bytes in common are
   one string, and the smallest document id of each string goes back, as runs over the segment, to the tasks that sent it.
3. An anchor with more than ``hot`` different segments is a common string within unlike texts.  Its windows leave 1 and 2 and
   go through them apart, each with the hash of the whole window as its anchor, so they spread over all buckets, and only windows
   that several documents have are sent.
4. The runs of a document are merged and cut out of its text.

A passage that a third of all documents share is one segment of each task, wherever it goes.

Defined cases: a NULL text is empty; a document shorter than ``length`` bytes keeps all; rows with equal ids do not remove
each other's bytes; a row with a NULL id neither loses bytes nor removes any; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.session import release

from .common import arrow_schema, batches_of, lean_worker, materialize, small, small_batches, worker_state
from .suffix_array import common_prefixes, starts, suffix_array

LENGTH = 50
ANCHOR = 24
READ_BYTES = 1 << 18
CHUNK_ENTRIES = 1_500_000
CHUNK_BYTES = 24 << 20
CHUNK_DOCS = 60_000
#: Bytes of whole anchors that are deduped at a time, places of whole documents that are sent in a row and that runs are joined
#: to at a time, and bytes that a shard is sent. A suffix array takes 80 bytes of memory for each byte.
PART_BYTES = 1 << 19
PART_PLACES = 200_000
SHARD_BYTES = 24 << 20
HOT = 1_000
#: Parquet's writer looks at its sizes every 100 rows by default, and messages are rows of up to a MB: readers and writers
#: would hold pages and row groups of many MB in and outside the heap.
MESSAGES = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 8}
SHARED = 0xFFFF  # in place of a document's number: several documents of the chunk have the anchor
#: Odd multiplier of the rolling hash, its inverse modulo 2 ** 64, and the multipliers that mix a hash.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and INVERSE ** i modulo 2 ** 64 for i < n."""
    held = worker_state("suffix_powers")
    if len(held.get("up", ())) < n:
        for key, factor in (("up", BASE), ("down", INVERSE)):
            row = np.full(max(n, READ_BYTES + (1 << 18)), np.uint64(factor))
            row[0] = 1
            held[key] = np.multiply.accumulate(row)
    return held["up"][:n], held["down"][:n]


def hashes(data: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` bytes at each place."""
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    return mixed((sums[width:] - sums[:-width]) * down[:len(data) - width + 1])


def mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in zip((31, 29), MIX):
        h = (h ^ (h >> np.uint64(shift))) * factor
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """The anchor of the window at each place of the bytes."""
    h = hashes(data, anchor)
    size, width = length - anchor + 1, 1
    while 2 * width <= size:  # minimum of ``width`` neighbours
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[:len(h) - (size - width)], h[size - width:]) if size > width else h


def codes(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low 32 bits of anchors: what the bucket that judges an anchor knows of it."""
    return ((keys >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def segments(texts: list[bytes], length: int, anchor: int, hot: list[np.ndarray] | None = None, buckets: int = 1):
    """(document, start, end, anchor) of the segments of texts, as arrays; places count from the start of the document.
    With the codes of each document's hot anchors, the segments by whole windows of those windows that have one."""
    none = np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    found = anchors(data, length, anchor)
    doc = np.repeat(np.arange(len(texts)), sizes)[:len(found)]
    valid = np.arange(length, length + len(found)) <= ends[doc]
    if hot is not None:
        code = codes(found, buckets)
        for start, end, own in zip((ends - sizes).tolist(), ends.tolist(), hot):
            valid[start:end] &= np.isin(code[start:end], own)
        found = hashes(data, length)
    alike = np.zeros(len(found), bool)
    alike[1:] = valid[1:] & valid[:-1] & (found[1:] == found[:-1])
    first = np.flatnonzero(valid & ~alike)
    last = np.flatnonzero(valid & ~np.append(alike[1:], False))
    origin = (ends - sizes)[doc[first]]
    return doc[first], first - origin, last - origin + length, found[first]


def variants(texts: list[bytes], doc: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray):
    """(anchor, hash of anchor and segment) of the different segments."""
    sizes = np.array([len(t) for t in texts], np.int64)
    origin = (np.cumsum(sizes) - sizes)[doc]
    data = np.frombuffer(b"".join(texts), np.uint8)
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    both, at = np.unique(mixed((sums[origin + end] - sums[origin + start]) * down[origin + start]) ^ key, return_index=True)
    return key[at], both


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, text)"""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))


def later_copies(source: DataFrame) -> DataFrame:
    """(d, t) of the documents whose whole text a document of smaller id has."""
    known = source.filter("d is not null").select("d", "t", F.md5("text").alias("digest"))
    first = known.groupBy("digest").agg(F.min("d").alias("first"), F.max("d").alias("last")).filter("first < last")
    return known.join(small(first), "digest").filter("d > first").select("d", "t").distinct()


def grouped_reads(batches, length: int):
    """Lists of (d, t, text bytes, codes of hot anchors) of about READ_BYTES."""
    held, size = [], 0
    for b in batches:
        for d, t, text, hot in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            data = text.as_buffer().to_pybytes()
            if len(data) >= length:
                held.append((d, t, data, np.frombuffer(hot.as_py() or b"", np.uint64)))
                size += len(data)
                if size >= READ_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def split_by(keys: np.ndarray, buckets: int):
    """(order, places): order[places[i]:places[i + 1]] are the entries of bucket i."""
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint32))


def parts_of(groups: np.ndarray, weights: np.ndarray, size: int):
    """(start, end) of successive whole groups of equal neighbours that weigh ``size`` together, or are one group."""
    if not len(groups):
        return
    ends = np.append(np.flatnonzero(groups[1:] != groups[:-1]) + 1, len(groups))
    total, start, before = np.cumsum(weights)[ends - 1], 0, 0
    while start < len(groups):
        k = min(int(np.searchsorted(total, before + size)), len(ends) - 1)
        yield start, (end := int(ends[k]))
        start, before = end, int(total[k])


def expanded(first: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, place): entry i with each of the places first[i] .. first[i] + times[i] - 1."""
    entry = np.repeat(np.arange(len(times)), times)
    return entry, np.arange(len(entry)) - np.repeat(np.cumsum(times) - times - first, times)


def shared_anchors(source: DataFrame, length: int, anchor: int, buckets: int, written: list | None = None, most: int = HOT,
                   apart: bool = False) -> DataFrame:
    """(d, t, anchors, hot): the low 32 bits of the anchors that each document shares with another, sorted, and the codes of
    those with more than ``most`` different segments, beyond the first of each chunk. ``apart`` takes the windows of the hot
    anchors that ``source`` names, by whole windows. What the tasks send is written first, so that a chunk has one name and
    one content whatever is computed again; its path goes to ``written``."""
    ddl = "bucket int, chunk string, kind int, a binary, b binary"

    def send(batches):
        docs: list[tuple[int, int]] = []
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        kinds: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            chunk, key, owner = uuid.uuid4().hex, np.concatenate(keys), np.concatenate(owners)
            keys.clear(), owners.clear()
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            first = np.flatnonzero(starts(key))
            counts = np.diff(np.append(first, len(key)))
            inside = np.repeat(counts > 1, counts)  # shared inside the chunk
            own = b"".join((owner[inside].tobytes(), key[inside].astype(np.uint32).tobytes()))
            yield zlib.crc32(chunk.encode()) % buckets, chunk, 1, np.array(docs, np.int64).tobytes(), own
            unique, entry = key[first], np.where(counts > 1, np.uint16(SHARED), owner[first])
            del key, owner, order, first, counts, inside, own
            more = np.zeros(len(unique), np.int64)
            if kinds:
                both, of = (np.concatenate([x[i] for x in kinds]) for i in (1, 0))
                kinds.clear()
                order = np.argsort(both)
                of = np.sort(of[order[starts(both[order])]])  # the anchors of ``unique``, each once for each variant
                more = np.diff(np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))) - 1
                del both, of
            order, places = split_by(unique, buckets)
            low, entry, more = unique[order].astype(np.uint32), entry[order], more[order]
            del unique, order
            for i in range(buckets):
                x, y = places[i], places[i + 1]
                if y > x:
                    of = np.flatnonzero(more[x:y])  # few anchors have several segments
                    told = np.column_stack([of, more[x:y][of]]).astype(np.uint32)
                    yield i, chunk, 0, low[x:y].tobytes(), entry[x:y].tobytes() + told.tobytes()
            docs.clear()

        def rows():
            total = 0
            for read in grouped_reads(batches, length):
                texts = [x[2] for x in read]
                doc, start, end, key = segments(texts, length, anchor, [x[3] for x in read] if apart else None, buckets)
                if not apart:
                    kinds.append(variants(texts, doc, start, end, key))
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                new = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))[:len(doc)]
                keys.append(key[new]), owners.append((doc[new] + len(docs)).astype(np.uint16))
                docs.extend((d, t) for d, t, _, _ in read)
                total += len(keys[-1])
                if total >= CHUNK_ENTRIES or len(docs) >= CHUNK_DOCS - 40_000:
                    yield from flush()
                    total = 0
            if docs:
                yield from flush()

        yield from batches_of(rows(), arrow_schema(ddl), 16)
        lean_worker("suffix_powers")

    answer_ddl = "chunk string, kind int, a binary, b binary"

    def answer(table):
        """For each chunk the (owner, low 32 bits) of anchors that other chunks have, and the codes of hot ones."""
        import pyarrow as pa

        out, sent = [], []
        for bucket, chunk, kind, a, b in zip(*(table.column(c).to_pylist() for c in ("bucket", "chunk", "kind", "a", "b"))):
            if kind:
                out.append((chunk, 1, a, b))
            else:
                low = np.frombuffer(a, np.uint32)
                sent.append((chunk, low, np.frombuffer(b, np.uint16, len(low)), np.frombuffer(b[2 * len(low):], np.uint32).reshape(-1, 2)))
        if sent:
            _, back, counts = np.unique(np.concatenate([x[1] for x in sent]), return_inverse=True, return_counts=True)
            several, at = np.zeros(len(counts), np.int64), 0
            for _, low, _, told in sent:
                np.add.at(several, back[at + told[:, 0].astype(np.int64)], told[:, 1].astype(np.int64))
                at += len(low)
            hot, at = several > most, 0
            for chunk, low, entry, _ in sent:
                mine = back[at:at + len(low)]
                at += len(low)
                found = (counts[mine] > 1) & (entry != SHARED)
                if found.any():
                    out.append((chunk, 0, entry[found].tobytes() + low[found].tobytes(), b""))
                if (found := hot[mine]).any():
                    code = low[found].astype(np.uint64) | np.uint64(bucket << 32)
                    out.append((chunk, 2, code.tobytes(), b""))
        schema = arrow_schema(answer_ddl)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    def decide(table):
        import pyarrow as pa

        owners, lows, docs = [], [], None
        hot_codes = [np.zeros(0, np.uint64)]
        for kind, a, b in zip(*(table.column(c).to_pylist() for c in ("kind", "a", "b"))):
            if kind == 2:
                hot_codes.append(np.frombuffer(a, np.uint64))
                continue
            packed = b if kind else a
            n = len(packed) // 6
            owners.append(np.frombuffer(packed[:2 * n], np.uint16))
            lows.append(np.frombuffer(packed[2 * n:], np.uint32))
            docs = np.frombuffer(a, np.int64).reshape(-1, 2) if kind else docs
        owner, low = np.concatenate(owners), np.concatenate(lows)
        order = np.lexsort((low, owner))
        owner, low = owner[order], low[order]
        has = np.unique(owner)
        cuts = np.searchsorted(owner, np.append(has, 1 << 16))
        packed = [low[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
        # A hot anchor belongs to the documents that have its low bits: only those that share it matter.
        code = np.unique(np.concatenate(hot_codes))
        hot = [b""] * len(has)
        if len(code):
            code = code[np.argsort(code.astype(np.uint32), kind="stable")]
            first = np.searchsorted(code.astype(np.uint32), low)
            times = np.searchsorted(code.astype(np.uint32), low, "right") - first
            run = np.repeat(np.arange(len(low)), times)
            mine = code[np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times) + first[run]]
            edges = np.searchsorted(run, cuts)
            hot = [mine[x:y].tobytes() for x, y in zip(edges, edges[1:])]
        return pa.table([pa.array(docs[has, 0]), pa.array(docs[has, 1]), pa.array(packed, pa.binary()), pa.array(hot, pa.binary())],
                        names=["d", "t", "anchors", "hot"])

    if not apart:
        source = source.select("d", "t", "text", F.lit(b"").alias("hot"))
    sent = materialize(source.select("d", "t", "text", "hot").mapInArrow(send, ddl), "dedup-sent-anchors", written, MESSAGES)
    answers = sent.groupBy("bucket").applyInArrow(answer, answer_ddl)
    return answers.groupBy("chunk").applyInArrow(decide, "d long, t long, anchors binary, hot binary").groupBy("d", "t").agg(
        F.first("anchors").alias("anchors"), F.first("hot").alias("hot"))


def smallest_owners(parts: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For different segments and the smallest id that has each: the smallest id of the window at each of its places."""
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum(sizes)
    places = suffix_array(data.astype(np.int16))
    alike = common_prefixes(data, places, length)[places] >= length
    of = np.repeat(np.arange(len(parts)), sizes)[places]
    valid = places + length <= ends[of]
    group = np.cumsum(~alike) - 1  # of neighbours that have ``length`` bytes in common
    group, places, of = group[valid], places[valid], of[valid]
    least = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, owners[of])
    at = np.empty(len(data), np.int64)
    at[places] = least[group]
    return [at[e - n:e - length + 1] for e, n in zip(ends.tolist(), sizes.tolist())]


def runs_of_segments(parts: list[bytes], owners: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(segment, start, end, id) of the runs of places with one ``smallest_owners``, by segment and place."""
    ids = smallest_owners(parts, owners, length)
    sizes = np.array([len(x) for x in ids])
    base = np.cumsum(sizes) - sizes
    ids = np.concatenate(ids)
    new = starts(ids)
    new[base] = True
    start = np.flatnonzero(new)
    of = np.repeat(np.arange(len(sizes)), sizes)[start]
    return of, start - base[of], np.append(start[1:], len(ids)) - base[of], ids[start]


def told_segments(heads: list[np.ndarray], texts: list[memoryview], length: int) -> np.ndarray:
    """Rows (chunk, segment, start, end, id) by chunk, of all the segments that chunks sent a shard. The different segments are
    told apart some whole anchors at a time, and suffix arrays are built of about PART_BYTES."""
    head = np.concatenate(heads)
    counts = np.array([len(h) for h in heads])
    chunk = np.repeat(np.arange(len(heads), dtype=np.int32), counts)
    place = np.cumsum(head[:, 4]) - head[:, 4]
    place -= np.repeat(place[np.minimum(np.cumsum(counts) - counts, len(head) - 1)], counts)
    order = np.argsort(head[:, 3], kind="stable")
    told = [np.zeros((0, 5), np.int64)]
    parts: list[bytes] = []  # the different segments of anchors that have several
    owners: list[np.ndarray] = []
    meeting: list[tuple[np.ndarray, np.ndarray]] = []  # (entry, place in parts)

    def compare():
        of, start, end, least = runs_of_segments(parts, np.concatenate(owners), length)
        entry, number = (np.concatenate(x) for x in zip(*meeting))
        first = np.searchsorted(of, number)
        at, run = expanded(first, np.searchsorted(of, number, "right") - first)
        entry = entry[at]
        mine = least[run] < head[entry, 2]
        entry, run = entry[mine], run[mine]
        told.append(np.column_stack([chunk[entry], head[entry, 0], start[run], end[run], least[run]]))
        parts.clear(), owners.clear(), meeting.clear()

    size = 0
    for x, y in parts_of(head[order, 3], head[order, 4], PART_BYTES):
        entry = order[x:y]
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(texts[c][p:p + n].tobytes(), len(known))
                           for c, p, n in zip(chunk[entry].tolist(), place[entry].tolist(), head[entry, 4].tolist())])
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, number, head[entry, 1])
        key = np.empty(len(known), np.int64)
        key[number] = head[entry, 3]
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        several = times[back] > 1
        alone = (least[number] < head[entry, 2]) & ~several[number]
        own = entry[alone]
        told.append(np.column_stack([chunk[own], head[own, 0], np.zeros(len(own), np.int64), head[own, 4] - length + 1, least[number[alone]]]))
        if several.any():
            those, to = several[number], np.cumsum(several) - 1 + len(parts)
            meeting.append((entry[those], to[number[those]]))
            owners.append(least[several])
            new = [p for p, s in zip(known, several.tolist()) if s]
            parts += new
            size += sum(map(len, new))
            if size >= PART_BYTES:
                compare()
                size = 0
    if parts:
        compare()
    rows = np.concatenate(told)
    return rows[np.argsort(rows[:, 0], kind="stable")]


def smallest_runs(source: DataFrame, length: int, anchor: int, buckets: int, written: list | None = None,
                  apart: bool = False, shards: int | None = None) -> DataFrame:
    """(d, t, cuts) of the documents that lose bytes: int32 pairs (start, end), merged and sorted. ``apart`` takes the windows
    of hot anchors, else all others are taken. What the tasks send is written first, as in ``shared_anchors``, to ``shards``
    buckets; ``buckets`` is the number that the codes of hot anchors were made with."""
    shards = shards or buckets
    ddl = "bucket int, chunk string, kind int, a binary, b binary, c binary"

    def send(batches):
        docs: list[tuple[int, int]] = []
        known: dict[bytes, int] = {}
        keys = array("Q")
        at: list[np.ndarray] = []  # (segment, document, start), documents in order
        size = 0

        def flush():
            chunk = uuid.uuid4().hex
            ids = np.array(docs, np.int64)
            found = np.concatenate(at)
            owner = ids[found[:, 1], 0]
            low, high = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
            np.minimum.at(low, found[:, 0], owner)
            np.maximum.at(high, found[:, 0], owner)
            del owner
            parts, key = list(known), np.array(keys, np.uint64)
            order, places = split_by(key, shards)
            known.clear(), at.clear()
            del keys[:]
            for x, y in parts_of(found[:, 1], np.ones(len(found), np.int64), PART_PLACES):
                yield zlib.crc32(chunk.encode()) % shards, chunk, 1, ids.tobytes(), found[x:y].tobytes(), b""
            del found
            for i in range(shards):
                own = order[places[i]:places[i + 1]]
                if len(own):
                    head = np.column_stack([own, low[own], high[own], key[own].view(np.int64), [len(parts[k]) for k in own]])
                    yield i, chunk, 0, head.astype(np.int64).tobytes(), b"".join([parts[k] for k in own]), b""
            docs.clear()

        def rows():
            nonlocal size
            held, total = [], 0

            def take():
                nonlocal size
                doc, start, end, key = segments([x[2] for x in held], length, anchor, [x[4] for x in held] if apart else None, buckets)
                wanted = np.zeros(len(doc), bool)
                cuts = np.searchsorted(doc, np.arange(len(held) + 1))
                for i, (_, _, _, low, hot) in enumerate(held):
                    x, y = cuts[i], cuts[i + 1]
                    mine = key[x:y].astype(np.uint32)
                    place = np.minimum(np.searchsorted(low, mine), len(low) - 1)
                    wanted[x:y] = low[place] == mine
                    if len(hot) and not apart:
                        wanted[x:y] &= ~np.isin(codes(key[x:y], buckets), hot)
                rows_ = np.empty((int(wanted.sum()), 3), np.int32)
                numbers = []
                for i, a, b, k in zip(*(v[wanted].tolist() for v in (doc, start, end, key))):
                    part = held[i][2][a:b]
                    number = known.setdefault(part, len(known))
                    if number == len(keys):
                        keys.append(k)
                        size += len(part)
                    numbers.append(number)
                rows_[:, 0], rows_[:, 1], rows_[:, 2] = numbers, doc[wanted] + len(docs), start[wanted]
                at.append(rows_)
                docs.extend((x[0], x[1]) for x in held)
                held.clear()

            for b in batches:
                for d, t, text, low, hot in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4)):
                    data = text.as_buffer().to_pybytes()
                    held.append((d, t, data, np.frombuffer(low.as_py(), np.uint32), np.frombuffer(hot.as_py(), np.uint64)))
                    total += len(data)
                    if total >= READ_BYTES:
                        take()
                        total = 0
                        if size >= CHUNK_BYTES or len(docs) >= CHUNK_DOCS:
                            yield from flush()
                            size = 0
            if held:
                take()
            if docs:
                yield from flush()

        yield from batches_of(rows(), arrow_schema(ddl), 16)
        lean_worker("suffix_powers")

    answer_ddl = "chunk string, kind int, a binary, b binary"

    def answer(table):
        """For each chunk rows (segment, start, end, id): windows [start, end) of the segment also start in document id,
        the smallest, which is smaller than an id that the chunk has for the segment."""
        import pyarrow as pa

        chunk, kind, a, b = (table.column(c) for c in ("chunk", "kind", "a", "b"))
        kind, schema = kind.to_numpy(), arrow_schema(answer_ddl)
        out = [schema.empty_table(), *(table.slice(i, 1).select(schema.names).cast(schema) for i in np.flatnonzero(kind).tolist())]
        sent = np.flatnonzero(kind == 0).tolist()
        if sent:
            told = told_segments([np.frombuffer(a[i].as_buffer(), np.int64).reshape(-1, 5) for i in sent],
                                 [memoryview(b[i].as_buffer()) for i in sent], length)
            of, told = told[:, 0], told[:, 1:]
            cuts = np.flatnonzero(starts(of)).tolist()
            packed = [told[x:y].tobytes() for x, y in zip(cuts, [*cuts[1:], len(of)])]
            names = [chunk[sent[k]].as_py() for k in of[cuts].tolist()]
            out.append(pa.table([names, [0] * len(names), packed, [b""] * len(names)], schema=schema))
            del of, told, packed
        lean_worker("suffix_powers")
        return pa.concat_tables(out)

    def decide(table):
        import pyarrow as pa

        told, docs, parts = [np.zeros((0, 4), np.int64)], None, []
        for kind, a, b in zip(*(table.column(c) for c in ("kind", "a", "b"))):
            if kind.as_py():  # all places of some documents of the chunk
                docs = np.frombuffer(a.as_buffer(), np.int64).reshape(-1, 2)
                parts.append(np.frombuffer(b.as_buffer(), np.int32).reshape(-1, 3))
            else:
                told.append(np.frombuffer(a.as_buffer(), np.int64).reshape(-1, 4))
        runs = np.concatenate(told)
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        segment = np.ascontiguousarray(runs[:, 0])
        out = []
        for part in parts:
            part = part.astype(np.int64)
            first = np.searchsorted(segment, part[:, 0])
            place, run = expanded(first, np.searchsorted(segment, part[:, 0], "right") - first)  # every run at every place of its segment
            doc = part[place, 1]
            mine = docs[doc, 0] > runs[run, 3]
            run, place, doc = run[mine], place[mine], doc[mine]
            start = part[place, 2] + runs[run, 1]
            end = part[place, 2] + runs[run, 2] - 1 + length
            order = np.lexsort((start, doc))
            doc, start, end = doc[order], start[order], end[order]
            cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else []
            for i, j in zip(cuts, np.append(cuts[1:], len(doc))):
                reach = np.maximum.accumulate(end[i:j])
                new = np.append(True, start[i + 1:j] > reach[:-1])
                last = np.append(np.flatnonzero(new)[1:] - 1, j - i - 1)
                out.append((int(docs[doc[i], 0]), int(docs[doc[i], 1]),
                            np.column_stack([start[i:j][new], reach[last]]).astype(np.int32).tobytes()))
        schema = arrow_schema("d long, t long, cuts binary")
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    source = source.select("d", "t", "text", "anchors", "hot" if "hot" in source.columns else F.lit(b"").alias("hot"))
    sent = materialize(source.mapInArrow(send, ddl), "dedup-sent-segments", written, MESSAGES)
    answers = sent.groupBy("bucket").applyInArrow(answer, answer_ddl)
    return answers.groupBy("chunk").applyInArrow(decide, "d long, t long, cuts binary").groupBy("d", "t").agg(
        F.first("cuts").alias("cuts"))


def shards_for(shared: DataFrame, buckets: int, length: int) -> int:
    """Buckets for the segments of the anchors that documents share, each of about SHARD_BYTES: ``buckets`` at least."""
    n = shared.agg(F.sum(F.octet_length("anchors"))).first()[0] or 0
    return max(buckets, n // 4 * (length + 55) // SHARD_BYTES)  # a segment of one anchor is some bytes longer, and 40 go with it


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   anchor: int = ANCHOR, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """(d, t, cuts, whole) of the documents that lose bytes: binaries of int32 pairs (start, end), which may overlap between
    them. An anchor with more than ``hot`` different segments is taken apart by whole windows."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = buckets or max(64, 4 * docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = keyed(docs, id_col, text_col)
    copies = materialize(later_copies(source), "dedup-copies")
    firsts = source.filter("d is not null").join(small(copies), ["d", "t"], "left_anti")
    written: list[str] = []
    shared = materialize(shared_anchors(firsts, length, anchor, buckets, written, hot), "dedup-anchors")
    release(spark, written)
    meeting = firsts.join(shared, ["d", "t"])
    shards = shards_for(shared, buckets, length)
    cuts = materialize(smallest_runs(meeting, length, anchor, buckets, written, shards=shards), "dedup-cuts")
    release(spark, written)
    named = shared.filter("hot != X''")
    if named.head(1):
        held = materialize(firsts.join(named.select("d", "t", "hot"), ["d", "t"]), "dedup-hot", written)
        windows = materialize(shared_anchors(held, length, anchor, buckets, written, apart=True).drop("hot"), "dedup-windows", written)
        shards = shards_for(windows, buckets, length)
        more = materialize(smallest_runs(held.join(windows, ["d", "t"]), length, anchor, buckets, written, True, shards), "dedup-cuts")
        release(spark, written)
        cuts = cuts.unionByName(more)
    return cuts.groupBy("d", "t").agg(F.collect_list("cuts").alias("cuts"), F.lit(False).alias("whole")).unionByName(
        copies.select("d", "t", F.array().cast("array<binary>").alias("cuts"), F.lit(True).alias("whole")))


def merged(cuts: list[bytes]) -> list[list[int]]:
    """The maximal runs of several sorted lists of (start, end)."""
    out: list[list[int]] = []
    for x, y in sorted(pair for part in cuts for pair in np.frombuffer(part, np.int32).reshape(-1, 2).tolist()):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                  **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every document; kept holds the remaining bytes."""
    found = repeated_bytes(docs, id_col, text_col, length, **options)
    source = keyed(docs, id_col, text_col)
    joined = source.join(found, ["d", "t"], "left").select("d", F.col("text").cast("binary").alias("data"), "cuts",
                                                          F.coalesce("whole", F.lit(False)).alias("whole"))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def run(batches):
        def rows():
            for b in batches:
                for d, data, cuts, whole in zip(*(b.column(i) for i in range(4))):
                    data, cuts = data.as_py(), cuts.as_py()
                    spans = [(0, len(data))] if whole.as_py() and len(data) >= length else []
                    if cuts:
                        spans = merged(cuts)
                    at, kept = 0, []
                    for x, y in spans:
                        kept.append(data[at:x])
                        at = y
                    kept = b"".join([*kept, data[at:]])
                    yield d.as_py(), len(data), len(data) - len(kept), len(spans), kept

        yield from batches_of(rows(), arrow_schema(ddl), 500)

    return joined.mapInArrow(run, ddl)
