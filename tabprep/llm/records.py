"""Token-id output: length-delimited binary records with a separate offset index.

Format of a shard ``*.rec``: records one after another, each framed as

    uint64 length | uint32 masked crc32 of the length | payload | uint32 masked crc32 of the payload

all little-endian.  A payload is one sequence: 1 byte id width (2 or 4), 1 byte
that is 1 if the document id is NULL, int64 document id, then the token ids.  The
width is 2 where the vocabulary has at most 65,536 ids.  ``*.idx`` holds the
uint64 offset of every record of the shard, for reads in any order.

Writing: documents are range-partitioned and sorted by id; each task writes
shards of about ``shard_bytes`` under names of its own attempt and returns a
manifest row for each.  The manifest, written as Parquet in the same folder, names
the shards of the attempts that won, so a repeated task leaves only unnamed files.

Defined cases: a NULL text is the empty text, whose sequence is the end id
alone; a NULL id sorts first; rows with one id are ordered by text; an empty
table gives an empty manifest and no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet, clean_edges, read_spec
from .common import arrow_schema, batches_of, filesystem, scratch_path, worker_state

#: Units that a worker remembers; when they are too many it keeps the first CORE_UNITS, among which are the common words.
CACHE_UNITS = 550_000
CORE_UNITS = 200_000
CACHE_CHARS = 64
#: New units that are encoded as one text; bytes of texts that are cut at once.
JOINED_UNITS = 1_000
SLICE_BYTES = 8 << 20
SHARD_BYTES = 64 << 20
READ_BYTES = 8 << 20

MANIFEST = ("part long, shard long, data_path string, index_path string, n_records long, n_tokens long, "
            "n_bytes long")


def masked_crc(data: bytes) -> int:
    """crc32 rotated right by 15 bits plus a constant (fixed value of the record format)."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(read, where: str = "") -> bytes | None:
    """The next payload from ``read(n)``; None at the end; ValueError for a damaged record."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
        raise ValueError(f"damaged record length {where}")
    n = struct.unpack("<Q", head[:8])[0]
    body = read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked_crc(body[:n]):
        raise ValueError(f"damaged record {where}")
    return body[:n]


def byte_set(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars.encode())] = True
    return found


#: Bytes that are, or may be, white space by themselves; that begin characters of which some are white space; ASCII letters;
#: punctuation that, unlike an apostrophe, never joins letters.
SPACES = byte_set("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")
SPACE_LEADS = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))
LETTERS = byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
PUNCTUATION = byte_set(".,;:!?%$&*#|")


def may_be_space(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether a character that ends in the bytes a, b, c may be white space."""
    return (SPACES[c] | ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0)))
            | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80)))


def pieces_at(raw: np.ndarray, texts_at: np.ndarray) -> np.ndarray:
    """Where the pieces of UTF-8 texts begin, that lie one after another, and where the last ends. Besides at the ends of
    texts, they are cut where the pattern cuts whatever lies around: before a space or line break that follows another
    character, after such a line break if it is not followed by white space, and between a Latin letter and punctuation."""
    def after(kind):
        """Places of a kind of byte that have a byte before them."""
        found = np.flatnonzero(kind)
        return found[1:] if len(found) and found[0] == 0 else found

    def follows_text(places):
        before = raw[places - 1]
        free = ~SPACES[before]
        wide = np.flatnonzero(before >= 0x80)  # these have a byte before them too
        at = places[wide]
        free[wide] = ~may_be_space(raw[at - 3], raw[at - 2], raw[at - 1])
        return places[free]

    mark = np.zeros(len(raw) + 1, bool)
    mark[texts_at] = True
    mark[follows_text(after(raw == 0x20))] = True
    breaks = follows_text(after(raw == 0x0A))
    mark[breaks] = True
    breaks = breaks[breaks + 1 < len(raw)] + 1
    mark[breaks[~(SPACES | SPACE_LEADS)[raw[breaks]]]] = True
    marks = after(PUNCTUATION[raw])
    b, c = raw[marks - 2], raw[marks - 1]
    latin = (c >= 0x80) & (c < 0xC0) & (((b == 0xC3) & (c != 0x97) & (c != 0xB7)) | ((b >= 0xC4) & (b <= 0xC8)) | ((b == 0xC9) & (c < 0x90)))
    mark[marks[LETTERS[c] | latin]] = True
    return np.flatnonzero(mark)


class UnitEncoder:
    """A tokenizers file whose results for pieces of texts are remembered as packed ids."""

    def __init__(self, spec: str, width: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "H" if width == 2 else "I"
        vocab, alphabet = self.tokenizer.get_vocab(), byte_alphabet()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)  # ids of strings that begin with a space
        self.spaced[[i for string, i in vocab.items() if string.startswith(alphabet[0x20])]] = True
        self.line_break = vocab[alphabet[0x0A]]
        self.joined = 1 if any(any(map(str.isspace, s)) for s in self.special) else JOINED_UNITS
        self.units: dict[str, bytes] = {}

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def whole(self, text: str) -> bytes:
        return array(self.kind, self.ids(text)).tobytes()

    def learn(self, units: list[str]) -> None:
        """Remembers the packed ids of units. Many are encoded as one text and told apart again: of a unit that has a space
        before it and none within, the first id, and no other, stands for a string that begins with a space; units without
        line breaks are joined by these."""
        after_space, plain, other = [], [], []
        for u in units:
            if u[0] == " ":
                (after_space if clean_edges(u[1:]) and " " not in u[1:] else other).append(u)
            else:
                (plain if clean_edges(u) and "\n" not in u else other).append(u)
        for some, glue in ((after_space, ""), (plain, "\n")):
            for k in range(0, len(some), self.joined):
                part = some[k:k + self.joined]
                ids = np.array(self.ids(glue + glue.join(part)), self.kind)
                at = np.flatnonzero(ids == self.line_break if glue else self.spaced[ids])
                if len(at) != len(part):  # a special token has taken white space
                    other += part
                    continue
                packed, at = ids.tobytes(), [*(at * ids.itemsize).tolist(), ids.nbytes]
                skip = ids.itemsize if glue else 0
                self.units.update(zip(part, [packed[i + skip:j] for i, j in zip(at, at[1:])]))
        self.units.update((u, self.whole(u)) for u in other)

    def packed(self, units: list[str]) -> list[bytes]:
        """Packed ids of different units."""
        new = [u for u in units if u not in self.units]
        if len(self.units) + len(new) > CACHE_UNITS:
            self.units = dict(islice(self.units.items(), CORE_UNITS))
            new = [u for u in units if u not in self.units]
        self.learn(new)
        out = list(map(self.units.__getitem__, units))
        for u in new:
            if len(u) > CACHE_CHARS:
                del self.units[u]
        return out

    def encode_texts(self, texts) -> list[bytes]:
        """Packed ids of every whole text of an Arrow array (NULL: empty). The different pieces of the texts are numbered by
        Arrow, and the ids of the pieces put in their places; a text with a special token is not cut."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.fill_null("").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if at[0] == at[-1]:
            return [b""] * len(texts)
        raw, at = np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]
        starts = pieces_at(raw, at)
        coded = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(raw)).dictionary_encode()
        placed = pa.array(self.packed(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        _, offsets, data = placed.buffers()
        ends = np.frombuffer(offsets, np.int64)[np.searchsorted(starts, at)].tolist()
        out = [data[i:j].to_pybytes() for i, j in zip(ends, ends[1:])]
        for s in self.special:
            for i in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist():
                out[i] = self.whole(texts[i].as_py())
        return out

    def encode(self, text: str) -> bytes:
        """Packed ids of the whole text."""
        import pyarrow as pa

        return self.encode_texts(pa.array([text], pa.large_string()))[0]


def slices(column, most: int = SLICE_BYTES):
    """The parts of an Arrow array of texts that begin where another ``most`` bytes are full."""
    import pyarrow.compute as pc

    filled = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(column)]
    for i, j in zip(cuts, cuts[1:]):
        yield column.slice(i, j - i)


def worker_encoder(spec: str, width: int) -> UnitEncoder:
    held = worker_state("unit_encoder")
    key = (zlib.crc32(spec.encode()), len(spec), width)
    if key not in held:
        held[key] = UnitEncoder(spec, width)
    return held[key]


def write_records(docs: DataFrame, vocab_path: str, folder: str | None = None, end_id: int = 2,
                  id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> str:
    """Writes the token ids of ``docs`` in ascending id order and returns the folder, whose
    ``manifest`` names the shards. The folder defaults to a new one in the shared checkpoint folder."""
    import json

    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-records")
    text = read_spec(vocab_path)
    model = json.loads(text)
    ids = [*model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens", [])), end_id]
    width = 2 if max(ids) < 1 << 16 else 4
    spec = spark.sparkContext.broadcast(text)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = filesystem(folder)
        encoder = worker_encoder(spec.value, width)
        end = array(encoder.kind, [end_id]).tobytes()
        shard, out, offsets, at, tokens = 0, None, array("Q"), 0, 0

        def close():
            out.close()
            with fs.open_output_stream(f"{name}.idx") as f:
                f.write(offsets.tobytes())
            return part, shard, f"{folder}/data/{stem}.rec", f"{folder}/data/{stem}.idx", len(offsets), tokens, at

        def rows():
            nonlocal shard, out, offsets, at, tokens, name, stem
            for b in batches:
                texts = (packed for some in slices(b.column(1)) for packed in encoder.encode_texts(some))
                for doc_id, packed in zip(b.column(0).to_pylist(), texts):
                    if out is None:
                        fs.create_dir(f"{base}/data", recursive=True)
                        stem = f"part-{part:06d}-{shard:04d}-{uuid.uuid4().hex[:8]}"
                        name = f"{base}/data/{stem}"
                        out, offsets, at, tokens = fs.open_output_stream(f"{name}.rec"), array("Q"), 0, 0
                    packed += end
                    record = frame(struct.pack("<BBq", width, doc_id is None, doc_id or 0) + packed)
                    out.write(record)
                    offsets.append(at)
                    at += len(record)
                    tokens += len(packed) // width
                    if at >= shard_bytes:
                        yield close()
                        shard, out = shard + 1, None
            if out is not None:
                yield close()

        name = stem = ""
        yield from batches_of(rows(), arrow_schema(MANIFEST), 1)

    ordered = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
               .repartitionByRange("id").sortWithinPartitions("id", "text"))
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every record; start counts the ids of all records before it.
    Each task reads whole shards, which are of bounded size."""
    order = Window.orderBy("part", "shard")  # one row for each shard
    manifest = spark.read.parquet(f"{folder}/manifest")
    placed = manifest.withColumn("before", F.sum("n_tokens").over(order) - F.col("n_tokens"))
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"
    n = max(1, manifest.count())

    def run(batches):
        def rows():
            for b in batches:
                for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    fs, place = filesystem(path)
                    with fs.open_input_stream(place, buffer_size=READ_BYTES) as f:
                        while (payload := unframe(f.read, path)) is not None:
                            width, null, doc_id = struct.unpack("<BBq", payload[:10])
                            ids = np.frombuffer(payload, f"<u{width}", offset=10)
                            yield (None if null else doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                            before += len(ids)

        yield from batches_of(rows(), arrow_schema(ddl))

    return placed.select("data_path", "before").repartition(n, "data_path").mapInArrow(run, ddl)


def read_at(folder_row, numbers) -> list[np.ndarray]:
    """The id sequences of the given record numbers of one shard (a manifest row), through its offset index."""
    fs, place = filesystem(folder_row["index_path"])
    with fs.open_input_stream(place) as f:
        offsets = np.frombuffer(f.read(), "<u8")
    fs, place = filesystem(folder_row["data_path"])
    out = []
    with fs.open_input_file(place) as f:
        for k in numbers:
            f.seek(int(offsets[k]))
            payload = unframe(f.read, place)
            out.append(np.frombuffer(payload, f"<u{payload[0]}", offset=10))
    return out
