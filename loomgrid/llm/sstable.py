"""Operator 2, token ids in sorted-string-table shards.

A shard is one file.  Documents stand in key order in blocks; inside a block a
key is stored as the length it shares with the key before it and the rest.  A
sparse index has the first key, place and size of every block, a Bloom filter
the keys, a fixed-size footer the places of both and the shard's totals:

    block ...  = zstd( (varint shared, varint rest, varint bytes, key rest, value)* ) + crc32
    index      = (varint key length, key, varint offset, varint size)*
    Bloom      = bits, probes of one xxh64 split in halves
    footer     = FOOTER

Key: doc_id as 8 big-endian bytes with the sign bit flipped, so that byte order
is number order; a null doc_id has the empty key and comes first.  Value: the
ids, 2 bytes each where all of a document's ids fit, else 4 (first byte: width).

Shards are ranges of doc_id, so shard after shard is in ascending order.  Each
task writes its file under a fresh name in the shared folder; the manifest, a
Parquet table with one row per committed file, says which names count, so
tasks that ran twice leave a file that nobody reads.  A null text is an empty
one (only the end id); repeated rows are kept, next to each other, in order of
their texts; an empty table gives no shards; extra columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from loomgrid.llm import tokens
from loomgrid.llm.shared import Workspace, partitions

BLOCK_BYTES = 64 * 1024
BLOOM_BITS = 10  # per key
BLOOM_PROBES = 7
MAGIC = 0x5353_5441_424C_4531
#: index offset, index size, Bloom offset, Bloom bytes, documents, ids, magic
FOOTER = struct.Struct("<QQQQQQQ")


class Shard(NamedTuple):
    shard: int
    path: str
    n_docs: int
    n_ids: int
    first_key: bytes
    last_key: bytes


MANIFEST = "shard int, path string, n_docs long, n_ids long, first_key binary, last_key binary"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def pack_ids(ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4")


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest(key)
    low, high = h & 0xFFFFFFFF, h >> 32 | 1
    return [(low + i * high) % bits for i in range(BLOOM_PROBES)]


class Writer:
    """Writes one shard from (doc_id, ids) in ascending key order."""

    def __init__(self, out):
        import zstandard

        self.out, self.at, self.zip = out, 0, zstandard.ZstdCompressor(level=1)
        self.block, self.first, self.last, self.index, self.keys = bytearray(), None, b"", [], []
        self.n_docs = self.n_ids = 0
        self.low = self.high = None

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.first is None:
            self.first, self.last = key, b""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        value = pack_ids(ids)
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.n_docs:
            self.low = key
        if self.high != key:
            self.keys.append(key)
        self.last = self.high = key
        self.n_docs += 1
        self.n_ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.first is not None:
            data = self.zip.compress(bytes(self.block))
            self.index.append((self.first, *self._put(data + struct.pack("<I", zlib.crc32(data)))))
            self.block, self.first = bytearray(), None

    def close(self) -> None:
        self._flush()
        index = self._put(b"".join(_varint(len(k)) + k + _varint(at) + _varint(size) for k, at, size in self.index))
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[_probes(key, bits)] = 1
        bloom_at = self._put(struct.pack("<Q", bits) + np.packbits(bloom).tobytes())
        self._put(FOOTER.pack(*index, *bloom_at, self.n_docs, self.n_ids, MAGIC))


class Reader:
    """Reads a shard: all documents in order, or those of one key by binary search."""

    def __init__(self, source):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size = source.size()
        at, n, bloom_at, bloom_n, self.n_docs, self.n_ids, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted-string-table shard")
        raw, self.index, k = source.read_at(n, at), [], 0
        while k < len(raw):
            length, k = _read_varint(raw, k)
            key, k = raw[k : k + length], k + length
            start, k = _read_varint(raw, k)
            length, k = _read_varint(raw, k)
            self.index.append((key, start, length))
        self.firsts = [x[0] for x in self.index]
        bloom = source.read_at(bloom_n, bloom_at)
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]

    def block(self, k: int):
        _, at, size = self.index[k]
        raw = self.source.read_at(size, at)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        data, at, key = self.unzip.decompress(raw[:-4]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + rest], at + rest
            yield key, unpack_ids(data[at : at + length])
            at += length

    def __iter__(self):
        for k in range(len(self.index)):
            yield from self.block(k)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every row of a document; the empty list if it isn't here."""
        key, found = key_of(doc_id), []
        if not self.may_have(key):
            return found
        k = max(0, bisect_right(self.firsts, key) - 1)
        while k and self.firsts[k] == key:  # rows of one key may begin in an earlier block
            k -= 1
        while k < len(self.index) and self.firsts[k] <= key:
            found += [ids for own, ids in self.block(k) if own == key]
            k += 1
        return found


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Encode and write ``docs`` below ``path``; the manifest as a DataFrame (not yet run)."""
    import pyarrow as pa

    count = shards or partitions(docs.sparkSession)
    sorted_docs = docs.select(key, text).repartitionByRange(count, key).sortWithinPartitions(key, text)

    def run(batches):
        from pyspark import TaskContext

        files, base = _open(path)
        number = TaskContext.get().partitionId()
        name = f"shard-{number:06d}-{uuid.uuid4().hex[:8]}.sst"
        encoder, end, writer = tokens.encoder(tokenizer), np.array([end_id], "<u4"), None
        for rows in tokens.slices(tokens.batch_rows(batches)):
            if writer is None:
                files.create_dir(base, recursive=True)
                out = files.open_output_stream(f"{base}/{name}")
                writer = Writer(out)
            for (doc_id, _), ids in zip(rows, encoder.encode([t for _, t in rows]), strict=True):
                writer.add(key_of(doc_id), np.concatenate([np.frombuffer(ids, "<u4"), end]))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist(
                [dict(shard=number, path=f"{path}/{name}", n_docs=writer.n_docs, n_ids=writer.n_ids, first_key=writer.low, last_key=writer.high)],
                pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())]),
            )

    return sorted_docs.mapInArrow(run, MANIFEST)


def listing(manifest: DataFrame) -> list[Shard]:
    """The shards in key order: one short row per file, as a file listing would be."""
    return sorted(Shard(*r) for r in manifest.select(*Shard._fields).collect())


def read_shards(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, one task per shard."""
    import pyarrow as pa

    starts = np.concatenate([[0], np.cumsum([s.n_ids for s in shards])]).tolist()
    paths = [s.path for s in shards]

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                files, path = _open(paths[k])
                at = starts[k]
                with files.open_input_file(path) as source:
                    for rows in tokens.take(Reader(source), 4096):
                        sizes = [len(ids) for _, ids in rows]
                        begins = at + np.concatenate([[0], np.cumsum(sizes)])
                        at = int(begins[-1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([id_of(key) for key, _ in rows], pa.int64()), pa.array(begins[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(ids.tobytes()) for _, ids in rows], pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, schema)


def lookup(shards: list[Shard], doc_id: int | None) -> list[np.ndarray]:
    """Ids of a document: the shards whose key range has it, Bloom filter, sparse index, block."""
    key, found = key_of(doc_id), []
    for s in shards:
        if s.first_key <= key <= s.last_key:
            files, path = _open(s.path)
            with files.open_input_file(path) as source:
                found += Reader(source).get(doc_id)
    return found


def write_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents and read the files back."""
    space = Workspace(spark, "sstable")
    manifest = space.table(write_shards(docs, tokenizer, f"{space.path}/shards", end_id), "manifest")
    return read_shards(spark, listing(manifest))
