"""Binary shards of token ids with a minimal perfect hash index from document keys to offsets.

A shard is one file, little-endian, without padding::

    8s  magic   "TIDSHRD1"
    u32 width   bytes of an id: 2 where the vocabulary fits, else 4
    u32 zero
    u64 n_docs, n_tokens, n_keys, n_buckets
    u64 offsets[n_docs + 1]   first id of each document, counted in ids
    i64 doc_ids[n_docs]       ascending
    u8  known[n_docs]         0 where the key is null
    u32 pilots[n_buckets]     of the hash index
    u32 slots[n_keys][2]      fingerprint of the key, row of its document
    ids[n_tokens]             raw payload

Index: a key's hash names its bucket, the bucket's pilot and the hash name the key's slot; every slot is
taken by exactly one key.  A pilot with its top bit set is the slot itself (buckets of one key).  The
fingerprint turns away foreign keys but for one in 2**32.  A lookup reads the header, one pilot, one slot,
two offsets and the ids, whatever the size of the shard.

Documents stand in ascending ``doc_id`` order over all shards, null ids first.  Rows that share a
``doc_id`` follow each other in the order of a hash of their texts, over several shards if there are many,
and a lookup finds the first of them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import U64, arrow_map, mix, shared_dir, shuffle_partitions, written
from .files import RangeFile, own_name, put
from .tokens import WordIds, loaded, most_id

MAGIC = b"TIDSHRD1"
HEADER = struct.Struct("<8sII4Q")
DIRECT = 1 << 31
MANIFEST = "path string, part int, number int, n_docs long, n_tokens long, first_id long, last_id long"


def _key_hashes(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(U64) ^ U64(0x5EED5EED5EED5EED))


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ U64(0xF1F1F1F1F1F1F1F1)) >> U64(32)).astype(np.uint32)


def _slots_of(hashes: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    spread = (mix(hashes ^ mix(pilots.astype(U64))) % U64(n)).astype(np.int64)
    return np.where(pilots & np.uint32(DIRECT), (pilots & np.uint32(DIRECT - 1)).astype(np.int64), spread)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots and the slot of each of the distinct ``keys``: hash and displace, largest buckets first."""
    n = len(keys)
    hashes = _key_hashes(keys)
    n_buckets = max(1, (n + 3) // 4)
    pilots, slots, free = np.zeros(n_buckets, np.uint32), np.zeros(n, np.int64), np.ones(n, bool)
    bucket = (hashes % U64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    ends = np.cumsum(sizes)
    for b in np.argsort(-sizes, kind="stable"):
        size = int(sizes[b])
        if size < 2:
            break
        members = order[ends[b] - size : ends[b]]
        start, width = 0, 64
        while True:
            tried = np.arange(start, start + width, dtype=np.uint32)
            at = (mix(hashes[members][None, :] ^ mix(tried.astype(U64))[:, None]) % U64(n)).astype(np.int64)
            good = free[at].all(axis=1)
            in_row = np.sort(at, axis=1)
            good &= (in_row[:, 1:] != in_row[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                pilots[b], slots[members] = tried[k], at[k]
                free[at[k]] = False
                break
            start, width = start + width, min(8192, 2 * width)
    spare = np.flatnonzero(free)
    single = np.flatnonzero(sizes == 1)
    pilots[single] = spare.astype(np.uint32) | np.uint32(DIRECT)
    slots[order[ends[single] - 1]] = spare
    return pilots, slots


def shard_bytes(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> list[bytes]:
    """A shard file of documents in ascending order of id."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.uint64)]).astype("<u8")
    new = known.astype(bool)
    new[1:] &= (numbers[1:] != numbers[:-1]) | (known[:-1] == 0)
    rows = np.flatnonzero(new)
    pilots, slots = build_index(numbers[rows])
    entries = np.zeros((len(rows), 2), "<u4")
    entries[slots, 0], entries[slots, 1] = _fingerprints(_key_hashes(numbers[rows])), rows
    head = HEADER.pack(MAGIC, width, 0, len(ids), int(offsets[-1]), len(rows), len(pilots))
    return [head, offsets.tobytes(), numbers.astype("<i8").tobytes(), known.tobytes(), pilots.astype("<u4").tobytes(), entries.tobytes(), *(x.tobytes() for x in ids)]


class Shard:
    """A shard read by ranges."""

    def __init__(self, uri: str):
        self.file = RangeFile(uri)
        magic, self.width, _, self.n_docs, self.n_tokens, self.n_keys, self.n_buckets = HEADER.unpack(self.file.read(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        sizes = [8 * (self.n_docs + 1), 8 * self.n_docs, self.n_docs, 4 * self.n_buckets, 8 * self.n_keys]
        self.at_offsets, self.at_ids, self.at_known, self.at_pilots, self.at_slots, self.at_payload = (HEADER.size + int(x) for x in np.cumsum([0, *sizes]))

    def part(self, at: int, kind: str, count: int) -> np.ndarray:
        return np.frombuffer(self.file.read(at, np.dtype(kind).itemsize * count), kind)

    def row(self, doc_id: int) -> int | None:
        """Row of a document by the index, in constant time; None if it isn't here."""
        if not self.n_keys:
            return None
        h = _key_hashes(np.array([doc_id]))
        pilot = self.part(self.at_pilots + 4 * int(h[0] % U64(self.n_buckets)), "<u4", 1)
        slot = int(_slots_of(h, pilot, self.n_keys)[0])
        found, row = self.part(self.at_slots + 8 * slot, "<u4", 2)
        return int(row) if found == _fingerprints(h)[0] else None

    def ids(self, row: int) -> np.ndarray:
        a, b = (int(x) for x in self.part(self.at_offsets + 8 * row, "<u8", 2))
        return self.part(self.at_payload + self.width * a, f"<u{self.width}", b - a).astype("<u4")

    def lookup(self, doc_id: int) -> np.ndarray | None:
        """Ids of a document by its key."""
        row = self.row(doc_id)
        return None if row is None else self.ids(row)

    def rows_by_index(self, keys: np.ndarray) -> np.ndarray:
        """Rows of many keys through the index; -1 for a key that isn't here."""
        if not self.n_keys:
            return np.full(len(keys), -1)
        h = _key_hashes(keys)
        pilots = self.part(self.at_pilots, "<u4", self.n_buckets)
        entries = self.part(self.at_slots, "<u4", 2 * self.n_keys).reshape(-1, 2)
        slot = _slots_of(h, pilots[(h % U64(self.n_buckets)).astype(np.int64)], self.n_keys)
        return np.where(entries[slot, 0] == _fingerprints(h), entries[slot, 1].astype(np.int64), -1)


def write_store(docs: DataFrame, vocabulary: str, end_id: int = 1, width: int | None = None, shard_limit: int = 32 << 20, uri: str | None = None) -> DataFrame:
    """Encode whole texts, append ``end_id``, write shards in ascending ``doc_id`` order; returns the manifest.

    Null and empty texts hold the end id alone.  A shard closes at ``shard_limit`` bytes; a longer
    document has one of its own.  ``width`` is 2 or 4 bytes an id, by default what the vocabulary needs; one
    that it doesn't fit is an error.  The manifest (one row per shard) is a written table.
    """
    spark = docs.sparkSession
    uri = uri or shared_dir(spark, "tokens")
    needed = 2 if max(most_id(vocabulary), end_id) < 1 << 16 else 4
    width = width or needed
    if width not in (2, 4) or width < needed:
        raise ValueError(f"ids of this vocabulary take {needed} bytes, not {width}")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # The hash deals rows that share an id over ranges too.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "text")
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loaded(vocabulary, lambda: WordIds(vocabulary))
        part, number, held = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            path = own_name(f"{uri}/shard-{part:06d}-{number:05d}", ".tid")
            put(path, shard_bytes(doc_ids, ids, width))
            known = [d for d in doc_ids if d is not None] or [None]
            row = [path, part, number, len(ids), sum(map(len, ids)), known[0], known[-1]]
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                for d, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    found = np.append(np.frombuffer(encode(text), "<u4"), end_id).astype(kind)
                    if ids and held + found.nbytes > shard_limit:
                        yield close()
                        number, held, doc_ids, ids = number + 1, 0, [], []
                    doc_ids.append(d), ids.append(found)
                    held += found.nbytes
        if ids:
            yield close()

    return written(ordered.mapInArrow(run, MANIFEST), "manifest")


def read_store(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of a store, read back through the index: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it over the whole store.  Raises if the index of a
    shard leads a document elsewhere.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))  # at most one row a shuffle partition
    parts = parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("above"))
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    shards = manifest.select("part", "path", before.alias("before")).join(F.broadcast(parts), "part")
    shards = shards.select("path", (F.col("above") + F.col("before")).alias("base")).repartition(shuffle_partitions(spark), "path")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = Shard(path)
            numbers, known = shard.part(shard.at_ids, "<i8", shard.n_docs), shard.part(shard.at_known, "u1", shard.n_docs).astype(bool)
            offsets = shard.part(shard.at_offsets, "<u8", shard.n_docs + 1).astype(np.int64)
            led = shard.rows_by_index(numbers[known])
            if (led < 0).any() or (numbers[led] != numbers[known]).any():
                raise ValueError(f"the index of {path} is broken")
            crcs = []
            for first in range(0, shard.n_docs, 256):
                last = min(first + 256, shard.n_docs)
                a = offsets[first]
                ids = shard.part(shard.at_payload + shard.width * int(a), f"<u{shard.width}", int(offsets[last] - a)).astype("<u4")
                crcs += [zlib.crc32(ids[offsets[k] - a : offsets[k + 1] - a].tobytes()) for k in range(first, last)]
            shard.file.close()
            yield {"doc_id": pa.array(numbers, pa.int64(), mask=~known), "start": pa.array(offsets[:-1] + base), "n_tokens": pa.array(np.diff(offsets)), "ids_crc32": pa.array(crcs, pa.int64())}

    return arrow_map(shards, "doc_id long, start long, n_tokens long, ids_crc32 long", run)


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Ids of the documents whose ``doc_id`` is among ``keys``: ``doc_id, ids`` (array of int).

    A key goes to the shards whose id range holds it and reads only its own ranges there; the first shard
    that has it counts.
    """
    ranges = manifest.where("first_id is not null").select("path", "part", "number", "first_id", "last_id")
    found = keys.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct().join(ranges, F.expr("doc_id between first_id and last_id"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        shards: dict[str, Shard] = {}
        rows = []
        for d, path, part, number in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if path not in shards:
                shards.clear()
                shards[path] = Shard(path)
            got = shards[path].lookup(d)
            if got is not None:
                rows.append((d, part, number, got.astype(np.int32)))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield {"doc_id": pa.array(columns[0], pa.int64()), "part": pa.array(columns[1], pa.int32()), "number": pa.array(columns[2], pa.int32()), "ids": pa.array(columns[3], pa.list_(pa.int32()))}

    read = arrow_map(found.select("doc_id", "path", "part", "number").sortWithinPartitions("path"), "doc_id long, part int, number int, ids array<int>", run)
    return read.groupBy("doc_id").agg(F.min_by("ids", F.struct("part", "number")).alias("ids"))
