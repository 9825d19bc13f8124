"""SimHash near duplicates with bit-sliced comparison.

Fingerprints. Words of the lower-cased text, shingles of three, XXH64 of each; a bit is
set if more than half of the shingles' hashes have it.

Candidates. Two fingerprints that differ in at most three bits agree in two of five
blocks of bits, whichever they are; each distinct fingerprint is dealt to the ten
buckets of its pairs of blocks. A bucket with more than ``GROUP`` rows is split: its
rows get one of several parts, and every two parts meet in one group, so no group is
larger than twice that and no pair is lost.

Comparison. A group's fingerprints are stored as 64 bit planes (bit *j* of all rows).
For a shift *d*, a plane combined with itself *d* rows later tells for 64 pairs a word
whether bit *j* differs, up to 64 shifts at a time; carry-save counters (ones, twos, overflow) add that up over the
planes, and a block of pairs is left as soon as all its counters passed three. Linked
rows are united within the task, which passes on at most one link per row.

Links are joined into components over all groups (``components``); a fingerprint stands
for all its documents by the smallest id, so exact copies cost nothing here.

Defined cases: a null text, or one without words, has fingerprint 0, linked like any
other. One or two words are one shingle. Rows with the same ``doc_id`` are one node;
rows with a null ``doc_id`` get their fingerprint, link nothing and have a null
component. An empty table gives no rows. Columns besides those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registrum.llm.common import only, shared_folder, slices, texts_of, written
from registrum.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Bits of the five blocks; any RADIUS differing bits leave two blocks alike.
BLOCKS = (13, 13, 13, 13, 12)
GROUP = 2048
#: Words of 64 rows whose pairs are counted and abandoned together.
STRIDE = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), fp as a signed 64-bit number."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows, "text"):
            fp = np.array([fingerprint(t) for t in texts_of(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def masks() -> list[int]:
    """For each pair of blocks, the bits in them, as signed numbers."""
    ends = np.cumsum(BLOCKS)
    block = [((1 << size) - 1) << int(end - size) for size, end in zip(BLOCKS, ends, strict=True)]
    both = [a | b for a, b in combinations(block, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in both]


class Sliced:
    """Bit planes of rows whose groups stand together, larger groups first. Fingerprints are one or more 64-bit words each."""

    def __init__(self, fp: np.ndarray, group: np.ndarray, radius: int = RADIUS):
        self.n, self.radius = len(fp), radius
        words = -(-self.n // 64) + STRIDE + 2
        self.group = np.full(words * 64 + 64, -1, np.int64)
        self.group[: self.n] = group
        bits = np.ascontiguousarray(fp).view(np.uint8).reshape(self.n, -1)
        rows = np.zeros((words * 64, bits.shape[1]), np.uint8)
        rows[: self.n] = bits
        planes = np.unpackbits(rows, axis=1, bitorder="little").T  # planes of one bit a row
        self.planes = np.ascontiguousarray(np.packbits(planes, axis=1, bitorder="little")).view("<u8")

    def close(self, d: int, count: int, active: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows i and j = i + d .. i + d + count - 1 of one group within the radius, i + d below ``active``.

        The shifts d .. d + count - 1 must not cross a multiple of 64.
        """
        skip, shift = divmod(d, 64)
        by = np.arange(shift, shift + count, dtype=np.uint64)[:, None]
        found = []
        for at in range(0, -(-(active - d) // 64), STRIDE):
            low, width = at * 64, STRIDE * 64
            width = min(width, -(-(active - d - low) // 64) * 64)
            n = width // 64
            later = np.lib.stride_tricks.sliding_window_view(self._groups(low + d, width + count - 1), width)
            own = self._groups(low, width)
            over = ~np.packbits(later == np.where(own < 0, -2, own), axis=1, bitorder="little").view("<u8")
            # Counters by bit planes, begun so that the radius is the last number before they run over.
            digits = self.radius.bit_length()
            spare = (1 << digits) - 1 - self.radius
            counters = [np.full((count, n), FULL if spare >> b & 1 else 0, np.uint64) for b in range(digits)]
            for j, plane in enumerate(self.planes):
                if at + skip + n + 1 > len(plane):
                    plane = np.append(plane, np.zeros(at + skip + n + 1 - len(plane), np.uint64))
                first, second = plane[at + skip : at + skip + n], plane[at + skip + 1 : at + skip + 1 + n]
                differ = (first >> by) | ((second << np.uint64(1)) << (np.uint64(63) - by))
                differ ^= plane[at : at + n]
                for counter in counters:
                    carry = counter & differ
                    counter ^= differ
                    differ = carry
                over |= differ
                if j % 8 == 7 and (over == FULL).all():
                    break
            else:
                k, i = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
                found.append((i + low, i + low + d + k))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])

    def _groups(self, low: int, width: int) -> np.ndarray:
        """Group numbers of so many rows; beyond the last row none that any row has."""
        part = self.group[low : low + width]
        return part if len(part) == width else np.append(part, np.full(width - len(part), -1))


def forest(fp: np.ndarray, node: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(node, smaller node) links that connect all rows within the radius in the same group. Rows of a group adjoin."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    order = np.argsort(-np.repeat(size, size), kind="stable")
    fp, node, group = fp[order], node[order], group[order]
    size = np.sort(size)[::-1]
    ends = np.cumsum(size)
    sliced = Sliced(fp, group, radius)
    names, row = np.unique(node, return_inverse=True)
    root = np.arange(len(names))
    d, count = 1, 1
    while len(size) and d < size[0]:
        active = int(ends[np.searchsorted(-size, -d, side="left") - 1])  # groups with more than d rows
        i, j = sliced.close(d, count, active)
        a, b = root[row[i]], root[row[j]]
        apart = a != b
        while apart.any():
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
            apart = a != b
        d += count
        count = min(d, 64)  # 1, 2-3, 4-7 .. 32-63, then 64 shifts at a time
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def links(reps: DataFrame, folder: str) -> DataFrame:
    """(a, b) links between the nodes of fingerprints (fp, node) within the radius."""
    dealt = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks())])).alias("x")
    rows = reps.select("fp", "node", dealt).select("fp", "node", "x.t", "x.key")
    crowded = written(rows.groupBy("t", "key").count().where(F.col("count") > GROUP), f"{folder}/crowded")
    rows = rows.join(crowded, ["t", "key"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("count") / GROUP), F.lit(1)).cast("int"))
    part = F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), part)))
    rows = rows.withColumn("part", part).withColumn("other", other)
    rows = rows.select("t", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "fp", "node")
    return linked(rows, ["t", "key", "low", "high"], ["fp"])


def linked(rows: DataFrame, group: list[str], words: list[str], radius: int = RADIUS) -> DataFrame:
    """(a, b) links that connect the nodes within the radius in the same group; ``words`` hold the fingerprints of ``node``."""
    rows = rows.select(*group, *words, "node").repartition(*group).sortWithinPartitions(*group)
    g = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            x = np.vstack(held)
            number = np.cumsum(np.concatenate([[0], (x[1:, :g] != x[:-1, :g]).any(1)]))
            a, b = forest(x[:, g:-1].copy().view(np.uint64), x[:, -1], number, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*group, *words, "node")])
            last = np.flatnonzero((x[:, :g] != x[-1, :g]).any(1))  # rows before the batch's last group
            cut = last[-1] + 1 if len(last) else 0
            if cut or held and (held[-1][-1, :g] != x[0, :g]).any():
                held.append(x[:cut])
                yield out()
                held = []
            held.append(x[cut:])
        if held:
            yield out()

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    prints = written(fingerprints(docs), f"{folder}/prints")
    reps = written(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), f"{folder}/reps")
    # One id with several texts ties their fingerprints together.
    own = prints.where("doc_id IS NOT NULL").join(reps, "fp").select("doc_id", "node")
    least = own.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most")
    same_id = own.join(least, "doc_id").select(F.col("node").alias("a"), "b")
    found = components(links(reps, folder).unionByName(same_id), f"{folder}/components")
    named = reps.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
