"""Token ids in binary files: one shared zstandard dictionary, one frame per document, an index for short reads.

A file holds documents in ascending id order:

    magic "VXTK", version u16, bytes per id u16, SHA-256 of the dictionary (32 bytes)
    one zstandard frame per document, of its ids as little-endian unsigned integers
    index: per document id i64, frame offset u64, frame bytes u32, ids u32
    footer: index offset u64, documents u64, ids u64, magic "VXTK"

The dictionary lies next to the files under the name ``dictionary``.  Files are written under a temporary name
and renamed when complete, so a repeated task leaves the same file and nothing else.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialize
from .tokens import encoder

MAGIC, VERSION = b"VXTK", 1
HEAD, FOOT = struct.Struct("<4sHH32s"), struct.Struct("<QQQ4s")
INDEX = np.dtype([("id", "<i8"), ("offset", "<u8"), ("size", "<u4"), ("ids", "<u4")])
END_ID = 0
DICT_BYTES, DICT_DOCS, DICT_PART = 64 << 10, 2000, 16 << 10  # dictionary size; sampled documents; most bytes of each
LEVEL = 3
READ_BYTES = 4 << 20


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def train(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary over serialised id arrays; too few samples to train on are used as they are."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def train_dictionary(rows: DataFrame, path: str, blank_in_word: bool, width: int, docs: int = DICT_DOCS) -> bytes:
    """Dictionary from the ``docs`` documents (id, text) with the smallest hashes; the only step that looks at a sample."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = []
        for b in batches:
            for ids in encoder(path, blank_in_word).ids(b.column(0).to_pylist()):
                samples.append(np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()[:DICT_PART])
        yield pa.RecordBatch.from_arrays([pa.array([train(samples)], pa.binary())], names=["d"])

    picked = rows.select("text", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(docs).select("text")
    got = picked.coalesce(1).mapInArrow(fit, "d binary").collect()
    return bytes(got[0]["d"]) if got else b""


def _files(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


class ShardWriter:
    """One file of documents in ascending id order."""

    def __init__(self, folder: str, name: str, dictionary: bytes, width: int):
        self.fs, root = _files(folder)
        self.path, self.temp = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self.width = width
        d = _dictionary(dictionary)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=d) if d else zstandard.ZstdCompressor(level=LEVEL)
        self.out = self.fs.open_output_stream(self.temp)
        head = HEAD.pack(MAGIC, VERSION, width, hashlib.sha256(dictionary).digest())
        self.out.write(head)
        self.at, self.index, self.total = len(head), [], 0

    def add(self, key: int, ids: np.ndarray) -> None:
        frame = self.pack.compress(ids.astype(f"<u{self.width}").tobytes())
        self.out.write(frame)
        self.index.append((key, self.at, len(frame), len(ids)))
        self.at += len(frame)
        self.total += len(ids)

    def close(self) -> None:
        self.out.write(np.array(self.index, INDEX).tobytes())
        self.out.write(FOOT.pack(self.at, len(self.index), self.total, MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)


class ShardReader:
    """Index and documents of one file; a document costs one read of its frame."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        fs, root = _files(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        magic, version, self.width, digest = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        start, docs, self.total, tail = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or tail != MAGIC or version != VERSION:
            raise ValueError(f"{name} is not a token file of version {VERSION}")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self.index = np.frombuffer(self.file.read_at(docs * INDEX.itemsize, start), INDEX)
        self.end = start
        d = _dictionary(dictionary)
        self.unpack = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(frame), f"<u{self.width}").astype("<u4")

    def document(self, key: int) -> np.ndarray | None:
        at = int(np.searchsorted(self.index["id"], key))
        if at == len(self.index) or self.index["id"][at] != key:
            return None
        row = self.index[at]
        return self._ids(self.file.read_at(int(row["size"]), int(row["offset"])))

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        """(id, ids) of all documents, the file being read in blocks."""
        stops = self.index["offset"] + self.index["size"]
        a = 0
        while a < len(self.index):
            begin = int(self.index["offset"][a])
            b = max(a + 1, int(np.searchsorted(stops, begin + READ_BYTES, "right")))
            block = memoryview(self.file.read_at(int(stops[b - 1]) - begin, begin))
            for row in self.index[a:b]:
                lo = int(row["offset"]) - begin
                yield int(row["id"]), self._ids(block[lo: lo + int(row["size"])])
            a = b


def write_token_files(
    docs: DataFrame, folder: str, path: str, blank_in_word: bool, vocabulary: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the ids of every document, end id 0 appended, and return the manifest (part, name, docs, ids, low, high).

    Documents lie in ascending id order over the files taken by ``part``.  A null text is an empty text (the end
    id alone); rows that repeat an id are written one after the other; rows without an id are not written.
    Ids take two bytes each if ``vocabulary`` allows it, else four.  An empty table gives an empty manifest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    width = 2 if vocabulary <= 1 << 16 else 4
    dictionary = train_dictionary(rows, path, blank_in_word, width)
    fs, root = _files(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary") as f:
        f.write(dictionary)
    end = np.array([END_ID], "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, shard, low, high = f"part-{part:06d}.vxtk", None, None, None
        for b in batches:
            keys = b.column(0).to_pylist()
            if keys and shard is None:
                shard, low = ShardWriter(folder, name, dictionary, width), keys[0]
            for at in range(0, len(keys), 500):
                part_ids = encoder(path, blank_in_word).ids(b.column(1).slice(at, 500).to_pylist())
                for key, ids in zip(keys[at: at + 500], part_ids):
                    shard.add(key, np.concatenate((np.frombuffer(ids, "<u4"), end)))
                    high = key
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_pylist([
                {"part": part, "name": name, "docs": len(shard.index), "ids": shard.total, "low": low, "high": high}])

    sorted_rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    return materialize(sorted_rows.mapInArrow(write, "part long, name string, docs long, ids long, low long, high long"), "token-manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    dictionary = read_dictionary(folder)
    # one row per file: small enough for a running sum in one task
    starts = manifest.select("part", "name", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("start"))
    spread = starts.repartition(max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = []
                for key, ids in ShardReader(folder, name, dictionary):
                    out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    return spread.select("name", "start").mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in zip(*out)], names=["id", "start", "n_tokens", "ids_crc32"])


def read_dictionary(folder: str) -> bytes:
    fs, root = _files(folder)
    with fs.open_input_stream(f"{root}/dictionary") as f:
        return io.BytesIO(f.read()).getvalue()


def read_document(folder: str, manifest: DataFrame, key: int) -> np.ndarray | None:
    """The ids of one document: the file whose range holds it, its index, one frame."""
    row = manifest.filter((F.col("low") <= key) & (F.col("high") >= key)).select("name").first()
    return None if row is None else ShardReader(folder, row["name"], read_dictionary(folder)).document(key)
