"""Token ids on disk: ids by frequency rank, byte-aligned variable-length numbers, control bytes apart.

Format. A table of blocks, each a row: ``shard`` and ``block`` (together the order of
the blocks), ``doc_ids`` and ``lengths`` of its documents, ``start`` (ids before it in
its shard), ``control`` and ``data``. An id is replaced by its rank in the corpus
(commonest first, ties by id), so common ids are small numbers. A number takes 1 to 4
bytes, little-endian, in ``data``; its length less one is two bits of ``control``, four
numbers a control byte, first number in the lowest bits. Lengths being apart from the
bytes, numpy decodes a whole block with table lookups and one gather. ``ranks`` beside
it lists the ids in rank order. Spark's writer commits both, so a lost executor leaves
no half-written file, on any store that Spark writes to.

Work. One pass encodes every text once and writes its raw ids (``folder/ids``). A second
counts them in that table (at most a row per id and task is shuffled). A third deals the
documents' ids, which are smaller than their texts, by ranges of ``doc_id``, ranks them
and writes the blocks. Where a document starts follows from the sums of its shard, which
are one row a shard.

Defined cases: a null or empty text is the end id alone. Rows are ordered by
``doc_id`` (null first); rows of one ``doc_id`` stay separate and are ordered by their
ids' bytes. An empty table
gives no rows. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.llm.byte_pieces import encoder, narrowest
from registrum.llm.common import only, slices, texts_of, written

#: Ids in a block, unless one document alone has more.
BLOCK = 1 << 18
#: Bytes of text that are encoded together: what a word's look-up costs besides its own falls with them.
SLICE = 1 << 23
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
BLOCK_SCHEMA = "shard int, block int, doc_ids array<long>, lengths array<long>, start long, n_tokens long, control binary, data binary"


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    v = np.ascontiguousarray(numbers, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    codes = codes.reshape(-1, 4)
    return (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of a block."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(size, dtype=np.int64) - size
    if n and starts[-1] + size[-1] != len(data):
        raise ValueError("control bytes and data do not fit together")
    at = np.ndarray(len(data) + 1, "<u4", data + bytes(4), strides=(1,))  # the four bytes from every position on
    return at[starts] & MASKS[size]


def coded(docs: DataFrame, tokenizer: str, end_id: int, dtype: str) -> DataFrame:
    """doc_id and ``ids`` (numbers of ``dtype``, the end id last) of every whole text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, dtype=dtype), np.array([end_id], dtype).tobytes()
        for batch in slices(rows, "text", SLICE, keep=True):
            ids = [x + end for x in encode.encode(texts_of(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def id_counts(ids: DataFrame, dtype: str) -> DataFrame:
    """(id, n) over all rows of ``ids``."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in rows:
            seen = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype), minlength=len(total))
            seen[: len(total)] += total
            total = seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> None:
    """Write ``folder/ids``, ``folder/ranks`` and ``folder/blocks``."""
    spark = docs.sparkSession
    dtype = narrowest(tokenizer, end_id)
    raw = written(coded(docs, tokenizer, end_id, dtype), f"{folder}/ids", compression="zstd")
    counts = id_counts(raw, dtype).orderBy(F.desc("n"), "id")
    ids = np.array([r["id"] for r in counts.collect()], np.int64)  # at most a row per id of the vocabulary
    written(spark.createDataFrame([(ids.tolist(),)], "ids array<long>").coalesce(1), f"{folder}/ranks")
    rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, shard = np.dtype(dtype).itemsize, TaskContext.get().partitionId()
        block = start = size = 0
        names: list[int | None] = []
        parts: list[bytes] = []

        def out() -> pa.RecordBatch:
            lengths = [len(p) // width for p in parts]
            control, data = pack(rank[np.frombuffer(b"".join(parts), dtype)])
            values = (shard, block, names, lengths, start, sum(lengths), control, data)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in rows:
            for name, part in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                n = len(part) // width
                if parts and size + n > BLOCK:
                    yield out()
                    block, start, size, names, parts = block + 1, start + size, 0, [], []
                names.append(name)
                parts.append(part)
                size += n
        if parts:
            yield out()

    order = raw.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    order.mapInArrow(run, BLOCK_SCHEMA).write.mode("errorifexists").option("compression", "zstd").parquet(f"{folder}/blocks")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ``ids`` (unsigned 32-bit little-endian bytes) of every document, from the files."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    (ranks,) = spark.read.schema("ids array<long>").parquet(f"{folder}/ranks").collect()
    id_of = np.array(ranks["ids"], "<u4")
    sums = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row per shard
    before, total = {}, 0
    for row in sums:
        before[row["shard"]], total = total, total + row["n"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                raw = id_of[unpack(row["control"], row["data"], row["n_tokens"])].tobytes()
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                texts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"] + before[row["shard"]]), pa.array(row["lengths"], pa.int64()), pa.array(texts, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
