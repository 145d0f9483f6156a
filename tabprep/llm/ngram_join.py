"""N-gram Jaccard join: the components of documents that link because their sets of word n-grams are similar.

Two documents link if 100 * |intersection| >= percent * |union| of their sets.  A
vertex is a distinct set, so copies cost nothing after the first step.

1. *Screening.*  In the order of their hashes, similar sets share at least
   ``shared_needed`` of the first ``screen_length`` n-grams (the prefix filter with more than
   one n-gram).  Each task dedups its n-grams and sends one small entry for each
   to a bucket of n-grams; the bucket answers which of them other tasks have
   too.  Only sets with enough shared n-grams go on.  An n-gram that a third of all
   documents share costs one entry for each task.
2. *Rare-first prefixes.*  The n-grams of the sets that are left are counted exactly, again through
   buckets that each chunk of sets sends every n-gram to once, and a chunk orders its sets by the
   counts that come back, rarest first.  A set's prefix of n - ceil(t * n) + 1 n-grams is its posting list;
   n-grams that no other set has come first and join nothing.
3. *Joining.*  Sets that share a prefix n-gram are candidates if they pass the length filter, the
   positional filter and the suffix filter (an upper bound of the overlap from the sizes of the sets'
   parts).  To avoid all pairs within a large group, the first rounds pair sets
   with one leader of each posting list, and sets already in one component are not
   paired again; a last round pairs all that share a prefix n-gram and are still in different
   components, once for each pair, so no link between components is missed.  Every pair is verified once on the
   whole sets.

An n-gram is its 64-bit hash; a link could be wrong only if n-grams of
the two sets themselves collide.

Defined cases: NULL or wordless texts have an empty set and link with nothing; a text with fewer
than n words is one n-gram; rows with equal ids are separate documents; the component of a document is
the smallest non-NULL id in it; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.functions.names import unused

from .common import arrow_schema, batches_of, lean_worker, materialize, small, small_batches
from .components import components

SHINGLE = 5
PERCENT = 75
CHUNK_GRAMS = 600_000
CHUNK_SETS = 60_000
#: Documents with one set from which on the set's row is broadcast to them instead of shuffled with them.
HEAVY_COPIES = 1000
PARTS = 16
RECENT = 8
#: Leaders of a posting list in each turn, and how many of those that a set meets it is paired with. Sets that are still
#: unlinked are fewer in each turn.
LEADERS = (1, 8, 32, 64)
SHARED = 0xFFFF  # in place of a set's number: several sets of the chunk have the n-gram


def gram_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh3_64_intdigest
    if len(words) <= size:
        return np.array([digest(joined)], np.uint64)
    ends = list(accumulate(map(len, words)))
    first = [0, *(e + i + 1 for i, e in enumerate(ends[:-size]))]
    last = [e + i + size - 1 for i, e in enumerate(ends[size - 1:])]
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(first, last)], np.uint64))


def signature(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def overlap_needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set it links with: ceil(percent / 100 * n)."""
    return -(-percent * n // 100)


def screen_length(n: int, percent: int) -> int:
    return min(n, n - overlap_needed(n, percent) + max(1, n // 4))


def shared_needed(n: int, percent: int) -> int:
    """Prefixes lengthened by l n-grams share at least l; a partner has at least overlap_needed(n) n-grams."""
    return max(1, overlap_needed(n, percent) // 4)


def source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)


def by_bucket(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, places): the n-grams in ``order`` go bucket by bucket; bucket i has those from places[i] to places[i + 1]."""
    bucket = bucket_of(grams, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def sent_sets(docs: DataFrame, size: int, percent: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """What the tasks find in one pass over the texts: a row of kind 2 for each document (a is its signature), and for each
    chunk of distinct sets its n-grams by bucket (kind 0) and its sets (kind 1)."""
    ddl = "bucket int, chunk string, kind int, a binary, b binary, doc_id long, text_hash long, n int"

    def run(batches):
        held: dict[bytes, np.ndarray] = {}

        def flush():
            chunk = uuid.uuid4().hex
            sizes = np.array([len(g) for g in held.values()], np.int64)
            prefixes = [g[:screen_length(len(g), percent)] for g in held.values()]
            number = np.repeat(np.arange(len(held)), [len(p) for p in prefixes])
            grams, first, back, counts = np.unique(np.concatenate(prefixes), return_index=True, return_inverse=True,
                                                   return_counts=True)
            own = np.bincount(number[counts[back] > 1], minlength=len(held))  # shared inside the chunk
            entry = np.where(counts > 1, SHARED, number[first]).astype(np.uint16)
            order, places = by_bucket(grams, buckets)
            low, entry = grams[order].astype(np.uint32), entry[order]
            # A chunk's own sets travel with one of the buckets.
            yield (zlib.crc32(chunk.encode()) % buckets, chunk, 1, b"".join(held),
                   np.concatenate([sizes, own]).astype(np.int32).tobytes(), None, None, None)
            for i in np.flatnonzero(np.diff(places)).tolist():
                x, y = places[i], places[i + 1]
                yield i, chunk, 0, low[x:y].tobytes(), entry[x:y].tobytes(), None, None, None
            held.clear()

        def rows():
            total = 0
            lean_worker()
            for b in batches:
                for doc_id, text_hash, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    grams = gram_hashes(text.as_py(), size)
                    sig = signature(grams) if len(grams) else None
                    yield None, None, 2, sig, None, doc_id, text_hash, len(grams)
                    if sig is None or sig in held:
                        continue
                    held[sig] = grams
                    total += len(grams)
                    if total >= CHUNK_GRAMS or len(held) >= CHUNK_SETS:
                        yield from flush()
                        total = 0
            if held:
                yield from flush()
            lean_worker()

        yield from batches_of(rows(), arrow_schema(ddl), 1000)

    return source(docs, id_col, text_col).mapInArrow(run, ddl)


def screened(sent: DataFrame, percent: int) -> DataFrame:
    """(sig) of the sets that may have a link, besides some that have none, from the written ``sent_sets``: a
    chunk has one name and one content whatever is computed again."""
    answer_ddl = "chunk string, kind int, a binary, b binary"

    def answer(table):
        """For each chunk the numbers of its sets whose entries other chunks of the bucket have too."""
        import pyarrow as pa

        kinds, chunks = table.column("kind").to_pylist(), table.column("chunk").to_pylist()
        a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
        out = [(chunks[i], 1, a[i], b[i]) for i, k in enumerate(kinds) if k]
        sent = [i for i, k in enumerate(kinds) if not k]
        if sent:
            low = np.concatenate([np.frombuffer(a[i], np.uint32) for i in sent])
            entry = np.concatenate([np.frombuffer(b[i], np.uint16) for i in sent])
            sizes = [len(b[i]) // 2 for i in sent]
            _, back, counts = np.unique(low, return_inverse=True, return_counts=True)
            mask = (counts[back] > 1) & (entry != SHARED)
            at = 0
            for i, n in zip(sent, sizes):
                found = entry[at:at + n][mask[at:at + n]]
                at += n
                if len(found):
                    out.append((chunks[i], 0, found.tobytes(), b""))
        schema = arrow_schema(answer_ddl)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    def decide(table):
        import pyarrow as pa

        kinds, a, b = (table.column(c).to_pylist() for c in ("kind", "a", "b"))
        own = kinds.index(1)
        sizes, shared = np.frombuffer(b[own], np.int32).reshape(2, -1)
        shared = shared + np.bincount(np.frombuffer(b"".join(x for k, x in zip(kinds, a) if not k), np.uint16),
                                      minlength=len(sizes))
        kept = [a[own][16 * i:16 * i + 16] for i, n in enumerate(sizes.tolist()) if shared[i] >= shared_needed(n, percent)]
        return pa.table([pa.array(kept, pa.binary())], names=["sig"])

    messages = sent.filter("kind < 2").select("bucket", "chunk", "kind", "a", "b")
    answers = messages.groupBy("bucket").applyInArrow(answer, answer_ddl)
    return answers.groupBy("chunk").applyInArrow(decide, "sig binary").distinct()


def whole_sets(docs: DataFrame, classes: DataFrame, kept: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(vid, sig, n, grams, parts) of the screened sets, each read from one document that has it."""
    chosen = materialize(kept.join(classes, "sig").select(
        F.monotonically_increasing_id().alias("vid"), "sig", F.col("of_id").alias("d"), F.col("of_hash").alias("t")),
        "join-chosen")
    wanted = small(chosen)
    text = source(docs, id_col, text_col)
    rows = text.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).select(
        "vid", "sig", "text")
    ddl = "vid long, sig binary, n int, grams binary, parts binary"

    def run(batches):
        def out():
            for b in batches:
                for vid, sig, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    grams = gram_hashes(text.as_py(), size)
                    if signature(grams) == sig:
                        parts = np.bincount((grams >> np.uint64(60)).astype(np.int64), minlength=PARTS)
                        yield vid, sig, len(grams), grams.tobytes(), parts.astype(np.int32).tobytes()

        yield from batches_of(out(), arrow_schema(ddl), 500)

    return materialize(rows.mapInArrow(run, ddl).dropDuplicates(["vid"]), "join-sets")


def postings(sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(gram, vid, n, place, before): the prefix of each set in rare-first order, without n-grams of one set alone; ``before``
    are the RECENT n-grams of the prefix that precede it.

    Chunks of sets send every n-gram to its bucket once, with the number of their sets that have it; the bucket answers with the number
    of all. So an n-gram that all sets have is one entry for each chunk."""
    ddl = "bucket int, chunk string, kind int, a binary, b binary"

    def send(batches):
        held: list[tuple] = []

        def flush():
            chunk = uuid.uuid4().hex
            grams, counts = np.unique(np.concatenate([g for _, g in held]), return_counts=True)
            order, places = by_bucket(grams, buckets)
            grams, counts = grams[order], counts[order].astype(np.int32)
            for vid, g in held:
                yield None, chunk, 1, int(vid).to_bytes(8, "little", signed=True), g.tobytes()
            for i in np.flatnonzero(np.diff(places)).tolist():
                x, y = places[i], places[i + 1]
                yield i, chunk, 0, grams[x:y].tobytes(), counts[x:y].tobytes()
            held.clear()

        def rows():
            total = 0
            for b in batches:
                for vid, grams in zip(b.column(0).to_pylist(), b.column(1)):
                    held.append((vid, np.frombuffer(grams.as_py(), np.int64)))
                    total += len(held[-1][1])
                    if total >= CHUNK_GRAMS or len(held) >= CHUNK_SETS:
                        yield from flush()
                        total = 0
            if held:
                yield from flush()

        yield from batches_of(rows(), arrow_schema(ddl), 64)

    def answer(table):
        import pyarrow as pa

        grams, counts = ([np.frombuffer(v.as_buffer(), t) for v in table.column(c)] for c, t in (("a", np.int64), ("b", np.int32)))
        _, back = np.unique(np.concatenate(grams), return_inverse=True)
        df = np.bincount(back, np.concatenate(counts)).astype(np.int32)[back]
        ends = np.cumsum([len(g) for g in grams]).tolist()
        return pa.table([table.column("bucket"), table.column("chunk"), pa.array(np.zeros(len(ends), np.int32)),
                         pa.array([df[y - len(g):y].tobytes() for y, g in zip(ends, grams)], pa.binary()),
                         pa.nulls(len(ends), pa.binary())], names=["bucket", "chunk", "kind", "a", "b"])

    def order_sets(table):
        """The postings of a chunk's sets."""
        import pyarrow as pa

        kinds = np.array(table.column("kind").to_pylist(), np.int32)
        own = table.filter(pa.array(kinds == 1))
        vids = np.frombuffer(b"".join(own.column("a").to_pylist()), np.int64)
        each = [np.frombuffer(g.as_buffer(), np.int64) for g in own.column("b")]
        sizes, grams = np.array([len(g) for g in each], np.int64), np.concatenate(each)
        unique, back = np.unique(grams, return_inverse=True)
        order, places = by_bucket(unique, buckets)
        df = np.zeros(len(unique), np.int64)
        answers = table.filter(pa.array(kinds == 0))
        for bucket, found in zip(answers.column("bucket").to_pylist(), answers.column("a")):
            df[order[places[bucket]:places[bucket + 1]]] = np.frombuffer(found.as_buffer(), np.int32)
        df = df[back]
        owner = np.repeat(np.arange(len(vids)), sizes)
        shared = df > 1
        alone = sizes - np.bincount(owner[shared], minlength=len(vids))
        owner, grams, df = owner[shared], grams[shared], df[shared]
        sort = np.lexsort((grams, df, owner))
        owner, grams = owner[sort], grams[sort]
        starts = np.searchsorted(owner, np.arange(len(vids)))
        i = np.arange(len(owner)) - starts[owner]  # the place among the set's shared n-grams
        needed = -(-percent * sizes // 100)
        prefix = np.flatnonzero(i < (sizes - needed + 1 - alone)[owner])
        at, i = owner[prefix], i[prefix]
        few = np.minimum(i, RECENT)
        ends = np.cumsum(few)
        recent = np.repeat(prefix - few - (ends - few), few) + np.arange(int(few.sum()))
        before = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(grams[recent]))
        return pa.table([pa.array(grams[prefix]), pa.array(vids[at]), pa.array(sizes[at].astype(np.int32)),
                         pa.array((alone[at] + i).astype(np.int32)), before], names=["gram", "vid", "n", "place", "before"])

    sent = materialize(sets.select("vid", "grams").mapInArrow(send, ddl), "join-counted")
    answers = sent.filter("kind = 0").groupBy("bucket").applyInArrow(answer, ddl)
    both = answers.unionByName(sent.filter("kind = 1"))
    return materialize(both.groupBy("chunk").applyInArrow(
        order_sets, "gram long, vid long, n int, place int, before array<long>"), "join-postings")


def may_link(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Length filter, and positional filter for the first n-gram that two sets share."""
    needed = F.ceil((n1 + n2) * percent / (100 + percent))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (1 + F.least(n1 - p1 - 1, n2 - p2 - 1) >= needed)


def with_components(posted: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return posted.withColumn("comp", F.col("vid"))
    named = labels.withColumnsRenamed({"v": "vid", "component": "comp__"})
    return posted.join(named, "vid", "left").withColumn("comp", F.coalesce("comp__", "vid")).drop("comp__")


def leader_pairs(posted: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): sets with leaders of their posting lists that are in other components. In the first turn every list has one leader
    and a set takes the one that it shares most prefix n-grams with, which is enough for most. Later a list has more, drawn anew by
    hash each turn, and a set takes as many that it shares most with: a set that links with few of a large
    component finds one of them without being paired with all. There are at most LEADERS[turn] pairs for each set in a turn."""
    most = LEADERS[turn]
    drawn = F.col("vid") if turn == 0 else F.xxhash64(F.lit(turn), "vid")
    slot = F.pmod(F.xxhash64(F.lit(-turn), "vid"), F.lit(most)).alias("slot")
    mixed = posted.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("gram")
    leaders = posted.drop("before").join(mixed, "gram", "left_semi").groupBy("gram", slot).agg(
        F.min(F.struct(drawn.alias("draw"), "vid", "comp", "n", "place")).alias("l"))
    rows = posted.drop("before").join(leaders, "gram").filter((F.col("comp") != F.col("l.comp")) & may_link(
        F.col("n"), F.col("place"), F.col("l.n"), F.col("l.place"), percent))
    counted = rows.groupBy("vid", F.col("l.vid").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    if turn == 0:
        chosen = counted.groupBy("vid").agg(F.max_by("b", F.struct("k", "b")).alias("b"))
    else:
        best = Window.partitionBy("vid").orderBy(F.desc("k"), "b")  # at most ``most`` for each n-gram of a prefix
        chosen = counted.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most)
    return chosen.select(F.least("vid", "b").alias("a"), F.greatest("vid", "b").alias("b")).distinct()


def remaining_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """(a, b): all sets of different components that share a prefix n-gram and pass the filters."""
    mixed = posted.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("gram")
    own = posted.join(mixed, "gram", "left_semi")
    other = own.select("gram", *[F.col(c).alias(f"{c}2") for c in ("vid", "n", "place", "comp", "before")])
    # A pair counts at the first n-gram it shares. Where the n-grams just before have one in common, it is not the first.
    rows = own.join(other, "gram").filter((F.col("vid") < F.col("vid2")) & (F.col("comp") != F.col("comp2")) & may_link(
        F.col("n"), F.col("place"), F.col("n2"), F.col("place2"), percent) & ~F.arrays_overlap("before", "before2"))
    return rows.select(F.col("vid").alias("a"), F.col("vid2").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that link; the suffix filter first, then the whole sets."""
    side = lambda k: sets.select(F.col("vid").alias(k), F.col("grams").alias(f"grams_{k}"))
    part = lambda k: sets.select(F.col("vid").alias(k), F.col("n").alias(f"n_{k}"), F.col("parts").alias(f"parts_{k}"))

    def suffix(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            parts = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.int32).reshape(-1, PARTS) for i in (4, 5)]
            most, total = np.minimum(*parts).sum(1), sum(np.array(b.column(i).to_pylist()) for i in (2, 3))
            yield b.filter(pa.array(100 * most >= percent * (total - most))).select([0, 1])

    def verify(batches):
        import pyarrow as pa

        for b in batches:
            kept = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.filter(pa.array(kept, pa.bool_())).select([0, 1])

    near = pairs.join(part("a"), "a").join(part("b"), "b").select("a", "b", "n_a", "n_b", "parts_a", "parts_b").mapInArrow(
        suffix, "a long, b long")
    return near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "grams_a", "grams_b").mapInArrow(verify, "a long, b long")


def contracted(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """(v, component) after links are added: only the new links are followed, between the components found so far."""
    if labels is None:
        return components(new)
    named = lambda k: labels.select(F.col("v").alias(k), F.col("component").alias(f"{k}_label"))
    ends = new.join(named("a"), "a", "left").join(named("b"), "b", "left").select(
        F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    step = components(ends)
    moved = labels.join(step.select(F.col("v").alias("component"), F.col("component").alias("next")), "component", "left")
    return materialize(moved.select("v", F.coalesce("next", "component").alias("component")).unionByName(
        step.join(labels, "v", "left_anti").select("v", "component")), "join-labels")


def linked_sets(sets: DataFrame, percent: int, buckets: int) -> DataFrame | None:
    """(v, component) of the sets that have links; None if there are none."""
    posted = postings(sets, percent, buckets)
    tested, labels = None, None
    for turn in range(len(LEADERS) + 1):
        current = with_components(posted, labels)
        pairs = leader_pairs(current, turn, percent) if turn < len(LEADERS) else remaining_pairs(current, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "join-pairs")
        if not pairs.head(1):
            continue
        tested = pairs if tested is None else tested.union(pairs)
        new = materialize(verified(pairs, sets, percent), "join-links")
        if new.head(1):
            labels = contracted(labels, new)
    return labels


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                   percent: int = PERCENT, buckets: int | None = None) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = buckets or max(64, 4 * docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = materialize(sent_sets(docs, size, percent, buckets, id_col, text_col), "join-sent")
    members = sent.filter("kind = 2").select("doc_id", "text_hash", F.col("a").alias("sig"), "n")
    # One row for each set, combined before the shuffle: its smallest document, and how many have it.
    classes = materialize(members.filter("sig is not null").groupBy("sig").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("of"), F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")).select(
        "sig", "class_id", F.col("of.doc_id").alias("of_id"), F.col("of.text_hash").alias("of_hash"), "copies"), "join-classes")
    kept = materialize(screened(sent, percent), "join-kept")
    sets = whole_sets(docs, classes, kept, size, id_col, text_col)
    labels = linked_sets(sets, percent, buckets)
    if labels is not None:
        named = sets.select("sig", "vid").join(labels.withColumnRenamed("v", "vid"), "vid").select("sig", "component")
        linked = classes.join(named, "sig", "left")
        lowest = linked.filter("component is not null").groupBy("component").agg(F.min("class_id").alias("lowest"))
        classes = materialize(linked.join(lowest, "component", "left").select(
            "sig", F.coalesce("lowest", "class_id").alias("class_id"), "copies"), "join-named")
    # Documents without words, and those of sets with many copies, would meet in one task of a join on sig.
    answer = lambda d, component: d.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"),
                                           component.alias("component_id"))
    light = lambda c: c.select("sig", "class_id")
    heavy = small(light(classes.filter(F.col("copies") >= HEAVY_COPIES)))
    rare = light(classes.filter(F.col("copies") < HEAVY_COPIES))
    worded = members.filter("sig is not null")
    return answer(members.filter("sig is null"), F.col("doc_id")).unionByName(
        answer(worded.join(heavy, "sig"), F.col("class_id"))).unionByName(
        answer(worded.join(heavy.select("sig"), "sig", "left_anti").join(rare, "sig"), F.col("class_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` but those linked with a document of smaller id, directly or through others; of rows with
    one id, which a component may keep, all of the kept one's text stay."""
    found = join_documents(docs, id_col, text_col, **options)
    d, t = unused(docs.columns, "__d"), unused(docs.columns, "__t")
    gone = materialize(found.filter("component_id is not null and (doc_id is null or doc_id != component_id)").select(
        F.col("doc_id").alias(d), F.col("text_hash").alias(t)).distinct(), "join-gone")
    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(small(gone), docs[id_col].cast("long").eqNullSafe(F.col(d)) & (key == F.col(t)), "left_anti")
