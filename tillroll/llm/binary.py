"""Operator 13 - token ids as binary files with Elias-Fano document boundaries.

Documents are sorted by ``doc_id`` into ranges; each range becomes one file that
holds all its token ids, one after the other, and two Elias-Fano sequences: the
end of each document in the id array, and the documents' ids.  Both ascend, so a
value costs two bits and the logarithm of the mean gap instead of 64.  A document
is found by select: 32-bit samples of every 512th set bit lead near the value's
high part, its low part stands at a fixed place.

File (all numbers little-endian)::

    magic | token ids, 2 or 4 bytes each | Elias-Fano doc ids | Elias-Fano ends | trailer

A sequence is a header (count, low bits, bytes of the parts), the low parts packed, the
high parts in unary, and the samples.  The trailer says where the sequences start,
how many documents (the first of them with a null id) and ids there are, the smallest
doc id, and the checksum of the sequences.

Recovery: a task writes a file under a name of its own; Spark commits one manifest row
for each range, so files of lost or repeated tasks are never named and never read.
Each task holds one range's boundaries and a few MB of ids.  The sort has the text's
hash and the row's place as further keys, so rows of one ``doc_id`` or equal rows may
fill any number of files.

Special rows: null or empty text is the end id alone; null ``doc_id`` comes first;
repeated rows count each; an empty table gives no files and no rows; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm import common as C
from tillroll.session import shared_path

#: Public tokenizer of the query, as the package of vocabulary files names it.
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Scanned bytes of documents for each file (at least as many files as shuffle partitions).
FILE_BYTES = 128 << 20
#: Ids that a reader holds at a time; a longer document is read alone.
READ_IDS = 1 << 20
#: Set bits between two select samples.
SAMPLE = 512
MAGIC = b"EFTOKENS"
_SEQUENCE = struct.Struct("<QBxxxIII")
_TRAILER = struct.Struct("<QQQQQqBxxxI8s")


# ---- Elias-Fano -------------------------------------------------------------------

class EliasFano:
    """An ascending sequence of unsigned integers in 2 + log2(mean gap) bits a value."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        places = np.uint64(1) << np.arange(low_bits, dtype=np.uint64)
        low = np.packbits((values[:, None] & places != 0).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, bool)
        high[ones] = True
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def decode(self, a: int, b: int) -> np.ndarray:
        """Values a..b-1."""
        if a >= b:
            return np.zeros(0, np.uint64)
        first = int(self.samples[a // SAMPLE]) // 8
        last = int(self.samples[(b - 1) // SAMPLE + 1]) // 8 + 1 if (b - 1) // SAMPLE + 1 < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little")) + 8 * first
        # set bits of the sample's byte that belong to values before it
        skip = int(np.searchsorted(ones, int(self.samples[a // SAMPLE]))) + a % SAMPLE
        out = (ones[skip:skip + b - a] - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bit, end = a * self.low_bits, b * self.low_bits
            bits = np.unpackbits(self.low[bit // 8:-(-end // 8)], bitorder="little")[bit % 8:bit % 8 + end - bit]
            out |= bits.reshape(-1, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return out

    def select(self, i: int) -> int:
        """Value i."""
        return int(self.decode(i, i + 1)[0])

    def rank(self, value: int) -> int:
        """How many values are smaller."""
        a, b = 0, self.n
        while a < b:
            m = (a + b) // 2
            a, b = (m + 1, b) if self.select(m) < value else (a, m)
        return a

    def to_bytes(self) -> bytes:
        return b"".join([_SEQUENCE.pack(self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)),
                         self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> EliasFano:
        n, low_bits, a, b, c = _SEQUENCE.unpack_from(data, at)
        at += _SEQUENCE.size
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a),
                   np.frombuffer(data, "<u4", c, at + a + b))


# ---- one file ---------------------------------------------------------------------

class Writer:
    """Ids go out as they come; the boundaries stay until close()."""

    def __init__(self, out, width: int):
        self.out, self.kind, self.ends, self.docs, self.n_ids = out, np.dtype(f"<u{width}"), [], [], 0
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents in order; ids holds all of theirs, one after the other."""
        self.out.write(ids.astype(self.kind).tobytes())
        self.docs.append(doc_ids)
        self.ends.append(np.cumsum(lengths) + self.n_ids)
        self.n_ids += int(lengths.sum())

    def close(self) -> int:
        """Documents written."""
        docs, ends = np.concatenate([np.zeros(0, np.int64), *self.docs]), np.concatenate([np.zeros(0, np.int64), *self.ends])
        null = int(np.searchsorted(docs, C.NULL_ID, "right"))
        base = int(docs[null]) if null < len(docs) else 0
        keys = EliasFano.of(docs[null:].astype(np.uint64) - np.uint64(base & (1 << 64) - 1)).to_bytes()
        index = keys + EliasFano.of(ends).to_bytes()
        at = len(MAGIC) + self.n_ids * self.kind.itemsize
        self.out.write(index)
        self.out.write(_TRAILER.pack(at, at + len(keys), len(docs), null, self.n_ids, base, self.kind.itemsize, zlib.crc32(index), MAGIC))
        self.out.close()
        return len(docs)


class Reader:
    """Random access to one file (an object with read_at(bytes, offset) and size())."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        (at, ends, self.n_docs, self.null, self.n_ids, self.base, width, crc, magic) = _TRAILER.unpack(file.read_at(_TRAILER.size, size - _TRAILER.size))
        index = file.read_at(size - _TRAILER.size - at, at)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("not a whole file of token ids")
        self.kind = np.dtype(f"<u{width}")
        self.keys, self.ends = EliasFano.from_bytes(index), EliasFano.from_bytes(index, ends - at)

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Start of documents a..b-1 in the id array, and the last one's end."""
        return self.ends.decode(max(a - 1, 0), b).astype(np.int64) if a else np.concatenate([[0], self.ends.decode(0, b).astype(np.int64)])

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a..b-1 of the array."""
        return np.frombuffer(self.file.read_at((b - a) * self.kind.itemsize, len(MAGIC) + a * self.kind.itemsize), self.kind)

    def document(self, i: int) -> np.ndarray:
        """The ids of document i."""
        a, b = self.bounds(i, i + 1)
        return self.ids(int(a), int(b))

    def doc_ids(self, a: int, b: int) -> np.ndarray:
        """doc_id of documents a..b-1; NULL_ID stands for null."""
        values = self.keys.decode(max(a - self.null, 0), max(b - self.null, 0)) + np.uint64(self.base & (1 << 64) - 1)
        return np.concatenate([np.full(max(min(b, self.null) - a, 0), C.NULL_ID), values.astype(np.int64)])

    def document_at(self, position: int) -> int:
        """The document that holds an id of the array."""
        return self.ends.rank(position + 1)


# ---- encoding ---------------------------------------------------------------------

#: A space that may not be a boundary of pre-tokens: at an end of the text or beside anything but a letter, a number or
#: visible ASCII.  At all other spaces the pre-tokenizer cuts before the space, whatever else the text holds.
_UNSURE = r"^ | $| [^!-~\pL\pN]|[^!-~\pL\pN] "


class Encoder:
    """Whole texts to ids, by the tokenizers library, each different piece between spaces once.

    Byte-level pre-tokens never reach over a single space between visible characters, so ids of a
    text are those of its pieces (each with the space before it) in a row.  Pieces are kept between batches; beyond
    ``most`` ids those go that came in one batch only, and all if the others are more than half of ``most``.  Texts with
    unsure spaces are encoded whole.
    """

    def __init__(self, data: bytes, most: int = 1 << 22):
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_buffer(data), most
        vocabulary = self.tok.get_vocab()
        self.width = 2 if max(vocabulary.values(), default=0) < 1 << 16 else 4
        self.leads = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.leads[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True  # the byte-level form of a space
        self._forget()

    def _forget(self):
        self.known, self.flat, self.ends = defaultdict(count().__next__), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.again = np.zeros(0, bool)  # pieces that came in a later batch too

    def _forget_rare(self):
        keep = np.flatnonzero(self.again)
        size = np.diff(self.ends)[keep]
        if 2 * size.sum() > self.most:
            return self._forget()
        pieces = list(self.known)
        self.flat = self.flat[C.ranges(self.ends[keep], self.ends[keep + 1])]
        self.ends = np.concatenate([[0], np.cumsum(size)])
        self.known = defaultdict(count(len(keep)).__next__, zip([pieces[i] for i in keep.tolist()], range(len(keep))))
        self.again = np.zeros(len(keep), bool)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Where in self.flat the ids of each piece are; unknown ones are encoded in one go."""
        if len(self.flat) > self.most:
            self._forget_rare()
        old = len(self.again)
        places = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))  # new ones are numbered as they come
        fresh = places >= old
        self.again[places[~fresh]] = True
        if fresh.any():
            new = [pieces[i] for i in np.flatnonzero(fresh).tolist()]
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
            step = 1 << 14
            ids = np.concatenate([np.array(x, np.uint32) for x in self._whole(
                ["".join(" " + p for p in new[i:i + step]) for i in range(0, len(new), step)])])
            starts = np.flatnonzero(self.leads[ids])
            if len(starts) != len(new):
                self._forget()  # a worker may live longer than the task
                raise ValueError("the tokenizer joins ids over spaces")
            self.ends = np.concatenate([self.ends, len(self.flat) + np.append(starts[1:], len(ids))])
            self.flat = np.concatenate([self.flat, ids])
        return places

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each followed by the end id; their numbers with the end)."""
        n = len(texts)
        unsure = pc.match_substring_regex(texts, _UNSURE).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts.filter(pa.array(~unsure)), " ")
        offs = split.offsets.to_numpy().astype(np.int64)
        offs, flat = offs - offs[0], split.flatten()
        inner = np.ones(len(flat), bool)  # all but the first pieces, which have no space before them
        inner[offs[:-1]] = False
        coded = flat.filter(pa.array(inner)).dictionary_encode()
        places = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        lead = flat.take(pa.array(offs[:-1])).to_pylist()
        heads = iter(self._whole(lead))
        wholes = iter(self._whole(texts.filter(pa.array(unsure)).to_pylist()))
        own = [np.array(next(wholes if u else heads), np.uint32) for u in unsure]
        # a text is its head (or all of it), its other pieces and the end id; all of them lie in one array
        source = np.concatenate([self.flat, *own, np.array([end_id], np.uint32)])
        own_ends = len(self.flat) + np.cumsum([0, *map(len, own)])
        tails = np.zeros(n, np.int64)
        tails[~unsure] = np.diff(offs) - 1
        total = int(tails.sum()) + 2 * n
        first = np.cumsum(tails + 2) - (tails + 2)
        a, b = np.empty(total, np.int64), np.empty(total, np.int64)
        a[first], b[first] = own_ends[:-1], own_ends[1:]
        a[first + tails + 1], b[first + tails + 1] = len(source) - 1, len(source)
        at = C.ranges(first + 1, first + 1 + tails)
        a[at], b[at] = self.ends[places], self.ends[places + 1]
        lengths = np.add.reduceat(b - a, first) if n else np.zeros(0, np.int64)
        return source[C.ranges(a, b)], lengths


_ENCODERS: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    """One for each Python worker: what it knows serves later tasks too."""
    key = zlib.crc32(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def _file_system(path: str):
    # Hadoop writes file:/x where Arrow reads file:///x
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", path))


def _write(folder: str, vocabulary, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                shard, encoder = batch.column(0)[0].as_py(), _encoder(vocabulary.value)
                fs, top = _file_system(folder)
                fs.create_dir(top, recursive=True)
                name = f"ids-{shard:06d}-{uuid.uuid4().hex}.bin"
                writer = Writer(fs.open_output_stream(f"{top}/{name}"), encoder.width)
            docs, texts = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            offs = C.text_buffer(texts)[1]
            for i, j in C.steps(offs, 1 << 22):
                ids, lengths = encoder(texts.slice(i, j - i), end_id)
                writer.add(docs[i:j], ids, lengths)
        if writer is not None:
            n = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()),
                                              pa.array([writer.n_ids], pa.int64())], names=["shard", "path", "n_docs", "n_ids"])
    return run


def vocabulary_bytes(name: str = TOKENIZER) -> bytes:
    """A public tokenizer's file: a name of the vocabulary package, or a path."""
    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    with open(name, "rb") as f:
        return f.read()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                      file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode ``docs`` into files of ``folder``; the stored manifest (shard, path, n_docs, n_ids, base).

    ``base`` counts the ids of all files before.  The tokenizer's file (a few MB) is read on the driver and broadcast.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(vocabulary_bytes(tokenizer))
    keyed = C.keyed(docs)
    rows = (keyed.select("_d", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_m"))
            .repartitionByRange(C.bucket_count(keyed, file_bytes), "_d", "_h", "_m").sortWithinPartitions("_d", "_h", "_m"))
    manifest = C.stored(rows.select(F.spark_partition_id().alias("shard"), "_d", "text").mapInArrow(
        _write(folder, vocabulary, end_id), "shard int, path string, n_docs long, n_ids long"), "token-files")
    # one row for each file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fs, name = _file_system(path)
            with fs.open_input_file(name) as file:
                reader, i = Reader(file), 0
                while i < reader.n_docs:
                    bounds = reader.bounds(i, min(i + 4096, reader.n_docs))
                    bounds = bounds[:max(2, int(np.searchsorted(bounds, bounds[0] + READ_IDS, "right")))]
                    j = i + len(bounds) - 1
                    ids = reader.ids(int(bounds[0]), int(bounds[-1])).astype("<u4").tobytes()
                    at = 4 * (bounds - bounds[0])
                    docs = reader.doc_ids(i, j)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(docs, pa.int64(), mask=docs == C.NULL_ID), pa.array(base + bounds[:-1], pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()), pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:])], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    files = manifest.select("path", "base")
    return files.repartition(C.shuffle_partitions(manifest.sparkSession), "path").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(C.documents(spark, sf_dir), shared_path(spark, "token-ids")))
