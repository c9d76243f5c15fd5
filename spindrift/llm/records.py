"""Token sequences as length-delimited binary records, with an offset index for shuffled reads.

A shard (``shard-00007-31-2.rec``, by partition, attempt and place in it) is a run of records, each
    uint64 length of the payload | uint32 masked crc of those 8 bytes | payload | uint32 masked crc of the payload
with payload = uint8 flags (1: no id, 2: 4-byte ids) | int64 id | the sequence's ids as uint16 or uint32.
Its index (``shard-00007-31-2.idx``) is a run of (uint64 offset, uint64 ids) per record and a uint32 masked crc of them.
All numbers are little-endian; a masked checksum is the CRC-32 turned right by 15 bits plus 0xa282ead8.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, new_path, slices
from .wordbpe import WordBpe

MANIFEST = "shard string, records long, ids long, part int, roll int"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Bytes of records after which a task begins another shard, whatever the number of partitions.
SHARD_BYTES = 256 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and where the next one begins; ValueError if a checksum is wrong."""
    head = data[at : at + 8]
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"damaged record length at {at}")
    n = struct.unpack("<Q", head)[0]
    payload = data[at + 12 : at + 12 + n]
    if len(data) < at + 16 + n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"damaged record at {at}")
    return payload, at + 16 + n


def serialize(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return struct.pack("<Bq", (doc_id is None) + 2 * wide, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def deserialize(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)


class ShardWriter:
    """Writes one shard and its index under temporary names; both appear at once when it is closed.

    An attempt has names of its own, so no file is ever replaced; the manifest names the attempt that counts.
    """

    def __init__(self, folder: str, part: int, attempt: int, roll: int = 0):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.name = f"shard-{part:05d}-{attempt}-{roll}"
        self.final, self.temp = f"{root}/{self.name}", f"{root}/.{self.name}"
        self.out = self.fs.open_output_stream(f"{self.temp}.rec")
        self.index, self.at, self.ids = array("Q"), 0, 0

    def write(self, doc_id: int | None, ids: np.ndarray) -> None:
        record = frame(serialize(doc_id, ids))
        self.index.extend((self.at, len(ids)))
        self.out.write(record)
        self.at += len(record)
        self.ids += len(ids)

    def close(self) -> None:
        self.out.close()
        body = np.array(self.index, "<u8").tobytes()
        with self.fs.open_output_stream(f"{self.temp}.idx") as out:
            out.write(body + struct.pack("<I", masked(body)))
        for kind in ("idx", "rec"):
            self.fs.move(f"{self.temp}.{kind}", f"{self.final}.{kind}")


class ShardReader:
    """Reads a shard by its index: in order, or any record by its number."""

    def __init__(self, folder: str, shard: str):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.path = f"{root}/{shard}"
        with self.fs.open_input_file(f"{self.path}.idx") as f:
            data = f.read()
        if struct.unpack("<I", data[-4:])[0] != masked(data[:-4]):
            raise ValueError(f"damaged index of {shard}")
        self.index = np.frombuffer(data[:-4], "<u8").reshape(-1, 2)

    def __len__(self) -> int:
        return len(self.index)

    def read(self, order: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        with self.fs.open_input_file(f"{self.path}.rec") as f:
            if order is None:  # stretches of several records at a time
                size, bounds, i = f.size(), self.index[:, 0].astype(np.int64), 0
                while i < len(bounds):
                    j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + (4 << 20))))
                    end = int(bounds[j]) if j < len(bounds) else size
                    f.seek(int(bounds[i]))
                    data, at = f.read(end - int(bounds[i])), 0
                    for _ in range(i, j):
                        payload, at = unframe(data, at)
                        yield deserialize(payload)
                    i = j
            else:
                for k in order:
                    f.seek(int(self.index[k, 0]))
                    head = f.read(12)
                    yield deserialize(unframe(head + f.read(struct.unpack_from("<Q", head)[0] + 4))[0])


def write_records(df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Encode every text, append end_id, write all sequences in ascending id order; the manifest, a row per shard.

    Ids that are null come first; rows of one id are ordered by a hash of their texts.  Null and empty texts are the
    end id alone; a text of any length is one record.  A task begins another shard after ``shard_bytes``, so a shard and its
    index are bounded but for one text.  A task that runs again writes other shards of equal bytes, and the manifest names
    those of one attempt.  An empty df has no shards; other columns are ignored.
    """
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    names = [f.split()[0] for f in MANIFEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, writer, roll = WordBpe.load(tokenizer), TaskContext.get(), None, 0
        end = np.asarray([end_id], "<u4").tobytes()

        def closed() -> pa.RecordBatch:
            writer.close()
            rows = [[writer.name], [len(writer.index) // 2], [writer.ids], [task.partitionId()], [roll]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names)

        for batch in slices(batches, 1):
            for doc_id, ids in zip(batch.column(0).to_pylist(), bpe.encode_many(batch.column(1).to_pylist()), strict=True):
                writer = writer or ShardWriter(folder, task.partitionId(), task.taskAttemptId(), roll)
                writer.write(doc_id, np.frombuffer(ids + end, "<u4"))
                if writer.at >= shard_bytes:
                    yield closed()
                    writer, roll = None, roll + 1
        if writer:
            yield closed()

    docs = doc_texts(df, id_col, text_col)
    dealt = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("data"))
    return sorted((r.asDict() for r in dealt.mapInArrow(run, MANIFEST).collect()), key=lambda m: (m["part"], m["roll"]))


def read_records(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """Rows (READ) of every record: start counts the ids of all records before it, ids_crc32 is over uint32 ids."""
    names, rows, start = [f.split()[0] for f in READ.split(", ")], [], 0
    for m in manifest:
        rows.append((m["shard"], start))
        start += m["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = ShardReader(folder, shard)
                counts = reader.index[:, 1].astype(np.int64)
                starts = first + np.cumsum(counts) - counts
                found, at = [], 0
                for doc_id, ids in reader.read():
                    found.append((doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(found) == 20_000 or at + len(found) == len(reader):
                        cols = list(zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(starts[at : at + len(found)]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names)
                        at, found = at + len(found), []

    shards = spark.createDataFrame(rows, "shard string, first long").repartition(max(1, len(rows)))
    return shards.mapInArrow(run, READ)


def shuffled(folder: str, manifest: list[dict], seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """One epoch in an order drawn from the seed: shards in random order, each read at random through its index."""
    rng = np.random.default_rng(seed)
    for k in rng.permutation(len(manifest)):
        reader = ShardReader(folder, manifest[k]["shard"])
        yield from reader.read(rng.permutation(len(reader)))


def encode_to_records(df: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write df as records to folder (a new one in the shared folder by default), then read the files back (READ)."""
    spark = df.sparkSession
    folder = folder or new_path(spark, "records")
    return read_records(spark, folder, write_records(df, folder, tokenizer, end_id, id_col, text_col))
