"""Token ids as fixed-stride binary records in training order.

1. Each text is encoded and closed by an end id; its ids are stored, packed, with the number of sequences (of LENGTH
   ids) that came before it in its task. The tasks' totals, one number each, give every sequence a dense index.
2. A keyed Feistel permutation with cycle-walking maps an index below N to its slot below N: a bijection, computed
   for each sequence alone, without a sort and without a table.
3. Slots are dealt in ranges, one task for each: a shard of SHARD_RECORDS, or several beyond MOST_TASKS shards. A task
   writes its records by slot.

A record has a fixed stride: doc_id (8 bytes), sequence number, number of ids and whether there is a doc_id (4 each), and
LENGTH ids of 2 or 4 bytes, little-endian, padded with zeros. Slot s is in shard s // SHARD_RECORDS, there in block (s % SHARD_RECORDS) //
BLOCK_RECORDS, at stride * (s % BLOCK_RECORDS) of that block's payload; so reading is sequential and resumes at any
slot: the filter on first_slot is pushed down to row groups. Payloads are written by Spark's Parquet writer: its commit leaves no half-written shard when an executor is
lost, and it works in any store.

Defined results: null and empty texts have no sequence; a null doc_id comes back null; repeated
rows have a sequence each; an empty table gives no shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgewatch.llm.bpe import Encoder
from ridgewatch.llm.common import map_batches, scratch_dir

LENGTH, SHARD_RECORDS, BLOCK_RECORDS, ROUNDS = 512, 16_384, 256, 6
#: Partitions that the records are shuffled into at most: 100 TB make about 3 million shards. The output is the same.
MOST_TASKS = 100_000
HEADER = 20
#: Documents that a worker encodes before it yields them.
SLICE = 500


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(key)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of the numbers below size."""

    size: int
    key: int

    def _keys(self) -> list[int]:
        seeds = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return [int(k) for k in _mix(seeds, self.key % (1 << 64))]

    def _walk(self, numbers: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        half = np.uint64(max(1, (max(self.size - 1, 1).bit_length() + 1) // 2))
        low = (np.uint64(1) << half) - np.uint64(1)
        out = numbers.astype(np.uint64)
        walking = np.arange(len(out))
        while len(walking):  # the domain is less than four times size, so few steps leave it again
            left, right = out[walking] >> half, out[walking] & low
            for key in keys:
                if back:
                    left, right = right ^ _mix(left, key) & low, left
                else:
                    left, right = right, left ^ _mix(right, key) & low
            out[walking] = left << half | right
            walking = walking[out[walking] >= np.uint64(self.size)]
        return out.astype(np.int64)

    def forward(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self._keys(), back=False)

    def inverse(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self._keys()[::-1], back=True)


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file; the end id is the first one that's free."""
    return Encoder(path, pattern)


def id_width(path: str, pattern: str) -> int:
    return 2 if encoding(path, pattern).free < 1 << 16 else 4


def encoded(documents: DataFrame, path: str, pattern: str, width: int, length: int = LENGTH) -> DataFrame:
    """Per document with a text: doc_id, part (the task), before (sequences earlier in the task), count and ids."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path, pattern)
        part, total = TaskContext.get().partitionId(), 0
        closing = np.array([own.free], dtype=f"<u{width}").tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                piece, out = batch.slice(start, SLICE), []
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    if text:
                        ids = own.encode(text).astype(f"<u{width}").tobytes() + closing
                        count = -(-len(ids) // (width * length))
                        out.append((doc, part, total, count, ids))
                        total += count
                columns = list(zip(*out)) if out else [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "part", "before", "count", "ids"]
                )

    return rows.mapInArrow(run, "doc_id bigint, part int, before bigint, count int, ids binary")


def records(stored: DataFrame, offsets: dict[int, int], order: Permutation, width: int, length: int) -> DataFrame:
    """Every sequence of stored documents: slot and record. offsets: the first index of each task, one number a task."""
    shared = stored.sparkSession.sparkContext.broadcast(offsets)
    size = width * length

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, out = [], []
        for doc, part, before, count, ids in zip(*(c.to_pylist() for c in batch.columns)):
            first = shared.value[part] + before
            index.append(np.arange(first, first + count))
            for k in range(count):
                own = ids[k * size : (k + 1) * size]
                head = (doc or 0).to_bytes(8, "little", signed=True)
                numbers = np.array([k, len(own) // width, doc is not None], dtype="<u4").tobytes()
                out.append(head + numbers + own.ljust(size, b"\0"))
        slots = order.forward(np.concatenate(index)) if index else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(out, pa.binary())], ["slot", "record"])

    return map_batches(stored.select("doc_id", "part", "before", "count", "ids"), run, "slot bigint, record binary")


def write_shards(
    documents: DataFrame, path: str, pattern: str, key: int, folder: str | None = None, length: int = LENGTH,
    shard_records: int = SHARD_RECORDS, block_records: int = BLOCK_RECORDS,
) -> str:
    """Writes documents in the training order of key; returns the folder with ids, shards and a manifest."""
    spark = documents.sparkSession
    folder = folder or scratch_dir(spark, "token-output")
    width = id_width(path, pattern)
    encoded(documents, path, pattern, width, length).write.option("compression", "zstd").parquet(f"{folder}/ids")
    stored = spark.read.parquet(f"{folder}/ids")
    totals = stored.groupBy("part").agg(F.sum("count").alias("n")).orderBy("part").collect()  # one row a task
    offsets, total = {}, 0
    for row in totals:
        offsets[row["part"]] = total
        total += row["n"]
    order, shards = Permutation(total, key), max(1, -(-total // shard_records))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = None, []

        def block() -> pa.RecordBatch:
            arrays = [[first // shard_records], [first], [len(held)], [b"".join(held)]]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
            names = ["shard", "first_slot", "records", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], names)

        for batch in batches:
            for slot, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and slot % shard_records % block_records == 0:
                    yield block()
                    held = []
                first = first if held else slot
                if slot != first + len(held):
                    raise ValueError(f"slot {first + len(held)} is missing")
                held.append(record)
        if held:
            yield block()

    of_task = -(-shards // MOST_TASKS)
    task = F.floor(F.col("slot") / (shard_records * of_task)).cast("int")
    dealt = records(stored, offsets, order, width, length).repartitionById(-(-shards // of_task), task)
    ranged = dealt.sortWithinPartitions("slot")
    blocks = ranged.mapInArrow(pack, "shard int, first_slot bigint, records int, payload binary")
    blocks.write.option("compression", "zstd").parquet(f"{folder}/shards")
    spark.createDataFrame(
        [(total, length, width, HEADER + width * length, shard_records, block_records, key)],
        "sequences bigint, length int, width int, stride int, shard_records int, block_records int, key bigint",
    ).write.parquet(f"{folder}/manifest")
    return folder


def read_sequences(spark: SparkSession, folder: str, from_slot: int = 0) -> DataFrame:
    """The sequences from a slot on: slot, doc_id, seq_no, n_tokens and ids, read from the payloads."""
    manifest = spark.read.parquet(f"{folder}/manifest").first()
    stride, width = manifest["stride"], manifest["width"]
    blocks = spark.read.parquet(f"{folder}/shards").where(F.col("first_slot") > from_slot - manifest["block_records"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for first, count, payload in zip(*(c.to_pylist() for c in batch.columns)):
            for k in range(max(0, from_slot - first), count):
                record = payload[k * stride : (k + 1) * stride]
                doc = int.from_bytes(record[:8], "little", signed=True)
                number, size, known = np.frombuffer(record[8:HEADER], dtype="<u4").tolist()
                ids = record[HEADER : HEADER + width * size]
                out.append((first + k, doc if known else None, number, size, ids))
        columns = list(zip(*out)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["slot", "doc_id", "seq_no", "n_tokens", "ids"]
        )

    return map_batches(
        blocks.select("first_slot", "records", "payload"), run,
        "slot bigint, doc_id bigint, seq_no bigint, n_tokens bigint, ids binary",
    )


def materialised(documents: DataFrame, path: str, pattern: str, key: int) -> DataFrame:
    """Per sequence, read back from the shards: slot, doc_id, seq_no, n_tokens and the digest of its ids."""
    folder = write_shards(documents, path, pattern, key)
    return read_sequences(documents.sparkSession, folder).select(
        "slot", "doc_id", "seq_no", "n_tokens", F.sha2("ids", 256).alias("ids_sha256")
    )
