"""Token ids as length-delimited binary records, with a separate offset index for reads in any order.

A shard's data file is a run of records: u64 length, u32 masked CRC-32 of those eight bytes, the payload, u32 masked
CRC-32 of the payload. A payload is i64 doc_id (the least value: null), u8 width, then the ids, each of that many bytes;
all numbers are little-endian. A checksum c is masked as rotate-right(c, 15) + 0xA282EAD8, so checksums of data that
hold checksums stay independent. The index file has for each record u64 offset and u64 ids before it in the shard.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Files, shared_dir, shipped, written
from .tokens import default_path, encoder

_HEAD, _INDEX, _NULL = struct.Struct("<QI"), struct.Struct("<QQ"), -(1 << 63)
_MANIFEST = "shard int, n_docs bigint, n_ids bigint, n_bytes bigint"
_RECORDS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(source, offset: int) -> bytes:
    """The payload of the record at ``offset`` of a seekable file; ValueError where a checksum does not fit."""
    source.seek(offset)
    head = source.read(_HEAD.size)
    length, check = _HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError(f"record at {offset}: bad length")
    payload = source.read(length)
    (check,) = struct.unpack("<I", source.read(4))
    if len(payload) != length or masked(payload) != check:
        raise ValueError(f"record at {offset}: bad payload")
    return payload


def _write(batches, root: str, path: str, end: int):
    import pyarrow as pa
    from pyspark import TaskContext

    shard, files, enc = TaskContext.get().partitionId(), Files(root), encoder(path)
    state = {"offset": 0, "total": 0, "docs": 0}
    index: list[bytes] = []
    tail = end.to_bytes(enc.width, "little")

    def records():
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, found in zip(ids, enc.ids(texts)):
                record = frame(struct.pack("<qB", _NULL if doc_id is None else doc_id, enc.width) + found + tail)
                index.append(_INDEX.pack(state["offset"], state["total"]))
                state["offset"] += len(record)
                state["total"] += len(found) // enc.width + 1
                state["docs"] += 1
                yield record

    files.write(f"shard-{shard:08d}.bin", records())
    files.write(f"shard-{shard:08d}.idx", index)
    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], "int32"), "n_docs": [state["docs"]], "n_ids": [state["total"]], "n_bytes": [state["offset"]]})


def read_shard(files: Files, shard: int, order=None):
    """Yields (doc_id, ids before it in the shard, little-endian u32 ids); ``order`` lists record numbers, default as written."""
    import numpy as np

    with files.open(f"shard-{shard:08d}.idx") as f:
        index = f.read()
    with files.open(f"shard-{shard:08d}.bin") as f:
        for k in range(len(index) // _INDEX.size) if order is None else order:
            offset, before = _INDEX.unpack_from(index, k * _INDEX.size)
            payload = unframe(f, offset)
            doc_id, width = struct.unpack_from("<qB", payload)
            yield None if doc_id == _NULL else doc_id, before, np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4")


def _read(batches, root: str):
    import pyarrow as pa

    files = Files(root)
    for batch in batches:
        for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows: list[tuple] = []
            for doc_id, before, ids in read_shard(files, shard):
                rows.append((doc_id, start + before, len(ids), zlib.crc32(ids.tobytes())))
                if len(rows) == 10_000:
                    yield _batch(pa, rows)
                    rows = []
            if rows:
                yield _batch(pa, rows)


def _batch(pa, rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(documents: DataFrame, root: str, path: str, end: int = 0) -> DataFrame:
    """Encodes every whole text (null: empty), appends ``end``, and writes shards below ``root`` in ascending doc_id order.

    Empty texts have the end id alone; very long ones are encoded piece by piece, and a record is held at a time. Returns the manifest (shard, n_docs, n_ids, n_bytes, start: ids of all shards before it). Null ids come first;
    rows of equal doc_id follow each other, by text hash. Nothing is written for an empty table. A task that runs again
    writes the same bytes to the same names.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))  # a repeated id spans shards
    manifest = written(shipped(docs).mapInArrow(lambda batches: _write(batches, root, path, end), _MANIFEST)).filter("n_docs > 0")
    return manifest.withColumn("start", F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["start"])


def read_tokens(manifest: DataFrame, root: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id) and ids_crc32, read from the files."""
    shards = manifest.select("shard", "start").repartition(max(1, min(manifest.count(), 20_000)))  # a number given is not coalesced
    return shipped(shards).mapInArrow(lambda batches: _read(batches, root), _RECORDS)


def _sequences(batches, root: str, seed: int):
    import numpy as np
    import pyarrow as pa

    files = Files(root)
    for batch in batches:
        for shard, n_docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            order = np.random.default_rng([seed, shard]).permutation(n_docs).tolist()
            for k, (doc_id, _, ids) in enumerate(read_shard(files, shard, order)):
                yield pa.RecordBatch.from_arrays([pa.array([shard], "int32"), pa.array([k], "int64"), pa.array([doc_id], "int64"), pa.array([ids.astype("i8")], pa.list_(pa.int64()))], ["shard", "place", "doc_id", "ids"])


def shuffled_tokens(manifest: DataFrame, root: str, seed: int) -> DataFrame:
    """shard, place, doc_id and ids of every record, each shard in an order drawn from the seed: the offset index finds records
    in any order, so a shard is neither sorted nor held. Shards come in an order drawn by hash; reruns agree."""
    shards = manifest.select("shard", "n_docs").repartition(max(1, min(manifest.count(), 20_000)), F.xxhash64("shard", F.lit(seed)))
    return shipped(shards).mapInArrow(lambda batches: _sequences(batches, root, seed), "shard int, place bigint, doc_id bigint, ids array<bigint>")


def token_files(documents: DataFrame, path: str | None = None, end: int = 0) -> DataFrame:
    """Writes the documents as token records to the shared folder and returns what the files hold, a row for each document."""
    root = shared_dir(documents.sparkSession)
    return read_tokens(write_tokens(documents, root, path or default_path(), end), root)
