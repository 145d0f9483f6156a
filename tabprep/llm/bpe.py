"""Byte-level BPE encoding and decoding.

A text is cut into units at single spaces between non-space characters: no
pre-token crosses such a place, so units are encoded on their own and their ids
are remembered by the worker.  A unit is split into pre-tokens by the pattern,
and each pre-token is merged with a priority queue of merge ranks over a doubly
linked list of symbols; an entry whose symbols have changed since it was pushed
is stale and is skipped.  Decoding concatenates the vocabulary's byte strings.

Defined cases: a NULL text is the empty text; an empty text has no ids; repeated
rows each give a row; an empty table gives an empty result; columns other than
the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, lean_worker, small_batches, worker_state

#: Fixed value: the pattern that the byte-level tokenizer files mean by ``use_regex``.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Units remembered by a worker; the memory is emptied when it is full.
CACHE_UNITS = 400_000
#: The same where a task returns the ids of whole documents and has to hold these besides.
CACHE_UNITS_LEAN = 80_000
CACHE_CHARS = 64


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 bytes stand for themselves, the others are numbered from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def merge_symbols(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Ids of one pre-token from its byte symbols. ``merges``: pair -> (rank, id of the merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    sym = list(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = []
    for i in range(n - 1):
        found = merges.get((sym[i], sym[i + 1]))
        if found:
            queue.append((found[0], i, sym[i], sym[i + 1], found[1]))
    heapq.heapify(queue)
    while queue:
        _, i, a, b, merged = heapq.heappop(queue)
        j = right[i]
        if sym[i] != a or j < 0 or sym[j] != b:  # stale
            continue
        sym[i], sym[j] = merged, -1
        k = right[i] = right[j]
        if k >= 0:
            left[k] = i
            found = merges.get((merged, sym[k]))
            if found:
                heapq.heappush(queue, (found[0], i, merged, sym[k], found[1]))
        h = left[i]
        if h >= 0:
            found = merges.get((sym[h], merged))
            if found:
                heapq.heappush(queue, (found[0], h, sym[h], merged, found[1]))
    return [s for s in sym if s >= 0]


def clean_edges(unit: str) -> bool:
    """True if the unit neither is empty nor begins or ends with any white space."""
    return bool(unit) and not unit[0].isspace() and not unit[-1].isspace() and "᠎" not in (unit[0], unit[-1])


class ByteBPE:
    """Encoder and decoder of a byte-level BPE file (the text of its JSON)."""

    def __init__(self, spec: str, cache_units: int = CACHE_UNITS):
        import regex

        self.cache_units = cache_units

        j = json.loads(spec)
        vocab, alphabet = j["model"]["vocab"], byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.bytes_to_id = [vocab[alphabet[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for text, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in text)
        for text, i in self.special.items():
            self.strings[i] = text.encode()
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.tokens: dict[str, tuple[int, ...]] = {}
        self.units: dict[str, array] = {}

    def pre_tokens(self, text: str) -> array:
        """Ids of a piece without special tokens."""
        out, known = array("i"), self.tokens
        for t in self.pattern.findall(text):
            ids = known.get(t)
            if ids is None:
                to_id = self.bytes_to_id
                ids = tuple(merge_symbols([to_id[b] for b in t.encode()], self.merges))
                if len(t) <= CACHE_CHARS:
                    if len(known) >= self.cache_units:
                        known.clear()
                    known[t] = ids
            out.extend(ids)
        return out

    def encode(self, text: str) -> array:
        if self.split_special and any(s in text for s in self.special):
            out = array("i")
            for piece in self.split_special.split(text):
                out.extend([self.special[piece]] if piece in self.special else self.pre_tokens(piece))
            return out
        parts = text.split(" ")
        if len(parts) < 2 or not all(map(clean_edges, (parts[0], parts[-1]))):
            return self.pre_tokens(text)
        units, out = self.units, self.pre_tokens(parts[0])
        for part in parts[1:]:
            ids = units.get(part)
            if ids is None:
                if not clean_edges(part):  # white space beside a space: the text is not cut
                    return self.pre_tokens(text)
                ids = self.pre_tokens(" " + part)
                if len(part) <= CACHE_CHARS:
                    if len(units) >= self.cache_units:
                        units.clear()
                    units[part] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


def worker_bpe(spec: str, cache_units: int = CACHE_UNITS) -> ByteBPE:
    held = worker_state("bpe")
    key = hashlib.sha1(spec.encode()).hexdigest(), cache_units
    if key not in held:
        held[key] = ByteBPE(spec, cache_units)
    return held[key]


def read_spec(vocab_path: str) -> str:
    with open(vocab_path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text; the vocabulary file is read on the driver and sent to the tasks."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocab_path))

    def run(batches):
        import pyarrow as pa

        bpe = worker_bpe(spec.value)
        for b in batches:
            ids = [bpe.encode(t or "").tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every id list; NULL ids decode to the empty text."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(vocab_path))

    def run(batches):
        import pyarrow as pa

        bpe = worker_bpe(spec.value)
        for b in batches:
            texts = [bpe.decode(ids or ()) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document, without moving the ids out of the task."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocab_path))
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        bpe = worker_bpe(spec.value)
        names = [str(i) for i in range(len(bpe.strings))]

        def rows():
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                    ids = bpe.encode(text.as_py() or "")
                    listed = ",".join([names[i] for i in ids])
                    yield (doc_id, len(ids), hashlib.sha256(listed.encode()).hexdigest(),
                           hashlib.sha256(bpe.decode(ids).encode()).hexdigest())

        yield from batches_of(rows(), arrow_schema(ddl))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def encode_documents(docs: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded) of every document; decoded tells whether the ids give the text back."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocab_path))
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        bpe = worker_bpe(spec.value, CACHE_UNITS_LEAN)
        lean_worker("bpe")
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                texts = [t.as_py() or "" for t in part.column(3)]
                ids = [bpe.encode(t) for t in texts]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.frombuffer(b"".join(i.tobytes() for i in ids), np.int32)
                same = [bpe.decode(i) == t for i, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(np.diff(offsets), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(same, pa.bool_())],
                    names=["doc_id", "lang", "source", "n_tokens", "ids", "decoded"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                         F.col("source").cast("string").alias("source"), "text")
    return chosen.mapInArrow(run, "doc_id long, lang string, source string, n_tokens long, ids array<int>, decoded boolean")
