"""Near copies by SimHash over five-word shingles: bit-sliced distances propose, the whole sets decide.

Sets are those of ``circulant_minhash`` with ``SHINGLE`` words; texts with equal sets are one
node. A fingerprint has ``WIDTH`` bits, each set if more than half of the shingles' hashes
have it. Two sets of Jaccard similarity s have an angle with cosine 2 s / (1 + s) and differ in each
bit with the angle over pi: at 0.8 in 19 of 128 bits, give or take four. Radius three of
op4 would find almost none of these, and no radius can be served by blocks of bits that must
agree. So each fingerprint is dealt to several tables, each by its own choice of bits, so many
bits that groups hold about ``ROWS`` rows of unlike texts, and so many tables that a pair at 0.8 meets in none
with chance ``MISS``; both follow from the number of nodes, recall does not. Tables grow with
the number of nodes to the power of 0.24.

In each group, distances up to ``RADIUS`` are found by the bit-sliced comparison of ``simhash``
(carry-save counters over vertical bit planes, blocks of pairs left as soon as all have passed the radius); crowded groups are
split into parts of which every two meet. Texts of a component of such pairs come together once,
and are linked if the Jaccard similarity of their whole sets is 0.8 or more.

Defined cases: texts of one to four words are one shingle; null texts and texts without words
have the empty set, and are alike. Very long texts are sets like others; a row longer than a batch's slice is worked off alone.
Rows with the same ``doc_id`` are one node; rows with a null ``doc_id`` link nothing and have a null component.
Repeated rows and copies cost one node. An empty table gives no rows. Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registrum.llm import circulant_minhash as sets
from registrum.llm import simhash
from registrum.llm.common import only, shared_folder, slices, texts_of, written
from registrum.llm.components import components

SHINGLE, WIDTH, RADIUS = 5, 128, 34
#: Chance that a pair at the threshold meets in no table, and rows of unlike texts in a group.
MISS, ROWS = 0.001, 256
#: Rows of a part of a crowded group.
GROUP = 2048
DIFFER = math.acos(2 * sets.PERCENT / (100 + sets.PERCENT)) / math.pi
SECOND = np.uint64(0xD6E8FEB86659FD93)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """Two words of the fingerprint of a set."""
    counts = np.zeros(WIDTH, np.int64)
    for i in range(0, len(found), 1 << 13):
        h = found[i : i + (1 << 13)]
        more = (h ^ (h >> np.uint64(32))) * SECOND
        both = np.column_stack([h, more ^ (more >> np.uint64(29))])
        counts += np.unpackbits(both.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(found), bitorder="little").view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, p0, p1): size and digest of the set, and its fingerprint."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows, "text", 1 << 20):
            made = sets.sets_of(texts_of(batch.column("text")), SHINGLE)
            prints = np.array([fingerprint(s) for s in made], np.int64).reshape(-1, 2)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in made]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in made], pa.int64()), pa.array(keys, pa.binary()), pa.array(prints[:, 0]), pa.array(prints[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "key", "p0", "p1"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, p0 long, p1 long")


def tables(nodes: int) -> list[tuple[int, int]]:
    """For each table, the bits that must agree, as two signed words."""
    bits = min(max(4, math.ceil(math.log2(max(nodes, 1) / ROWS))), WIDTH // 2)
    many = math.ceil(math.log(MISS) / math.log(1 - (1 - DIFFER) ** bits))
    pick = np.random.default_rng(bits)
    out = []
    for _ in range(many):
        chosen = np.zeros(WIDTH, bool)
        chosen[pick.choice(WIDTH, bits, replace=False)] = True
        out.append(tuple(np.packbits(chosen, bitorder="little").view(np.int64).tolist()))
    return out


def candidates(nodes: DataFrame, folder: str) -> DataFrame:
    """(node, component) of the nodes (node, key, p0, p1) that others come near."""
    dealt = F.array(*[F.xxhash64(F.lit(t), F.col("p0").bitwiseAND(F.lit(a)), F.col("p1").bitwiseAND(F.lit(b))) for t, (a, b) in enumerate(tables(nodes.count()))])
    rows = nodes.select("node", "key", "p0", "p1", F.explode(dealt).alias("bucket"))
    crowded = written(rows.groupBy("bucket").count().where(F.col("count") > GROUP), f"{folder}/crowded")
    rows = rows.join(crowded, "bucket", "left").withColumn("parts", F.coalesce(F.ceil(F.col("count") / GROUP), F.lit(1)))
    return components(simhash.linked(sets.parted(rows, "parts"), ["bucket", "_low", "_high"], ["p0", "p1"], RADIUS), f"{folder}/candidates")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest doc_id that links reach) of every row."""
    folder = shared_folder(docs.sparkSession)
    made = written(sketches(docs), f"{folder}/sketches")
    named = made.where("doc_id IS NOT NULL")
    nodes = written(named.groupBy("key").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n", "p0", "p1")]), f"{folder}/nodes")
    full = nodes.where("n > 0")
    links = written(sets.confirmed(docs, full.select("node", "key", "n"), candidates(full, folder), folder, SHINGLE), f"{folder}/links")
    # Copies hang on their node; all texts of one id stand for it, so they tie what is alike to any of them.
    own = named.select("doc_id", "key").distinct().join(nodes.select("key", "node"), "key").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    joined = components(links.unionByName(own), f"{folder}/components")
    out = made.select("doc_id").join(joined, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
