"""Near duplicates by circulant MinHash, confirmed on whole sets.

Sets. Words of the lower-cased text, distinct shingles of ``SHINGLE`` words, each known by a
64-bit number made of its words' XXH64. A document is the set of its shingles; documents with
the same set (128-bit digest) are one node, named by the smallest ``doc_id``.

Signatures. Two permutations of the 64-bit numbers make all coordinates: the first scatters
the shingles once, the second is applied to the scattered numbers after a circular shift by
*k* (addition modulo 2 ** 64) and its smallest value is coordinate *k*. ``ROWS`` coordinates
each make a band; two sets of similarity s share none of the bands with chance
(1 - s ** ROWS) ** BANDS, 3 in 100 million at 0.8.

Candidates. In each bucket of a band (buckets with the same rows count once, crowded ones are
split into parts of which every two meet) rows are compared by one byte of every coordinate.
Pairs that agree in ``AGREE`` of them and whose sizes fit are candidates; of them a bucket
passes on a spanning forest only. At a similarity of 0.8 fewer agree once in 60 million pairs.
All links lie inside the components of these forests.

Confirmation. The whole sets of a component's rows come together once (components with more
than ``GROUP`` rows or ``GROUP_BYTES`` of sets in parts as above), and rows that nothing
unites yet are compared by their sets: linked if 100 times the intersection is at least
``PERCENT`` times the union. Links are joined into components.

Defined cases: fewer words than a shingle has are one shingle; a null text or one without
words has the empty set, which is linked with nothing. Very long texts are sets like any
other; a row longer than a batch's slice is worked off alone. Equal sets are one node, so
exact copies cost one row. Rows with the same ``doc_id`` are one node; rows with a null
``doc_id`` keep their size, link nothing and have a null component. An empty table gives no
rows. Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registrum.llm.common import only, shared_folder, slices, texts_of, written
from registrum.llm.components import components

SHINGLE, PERCENT, SEED = 4, 80, 42
BANDS, ROWS = 24, 3
AGREE = BANDS * ROWS // 2
#: Rows of one part of a bucket or component, and bytes of sets of one part of a component.
GROUP, GROUP_BYTES = 4096, 8 << 20
_odd = np.random.default_rng(SEED).integers(0, 1 << 64, 8, np.uint64) | np.uint64(1)
#: Multipliers of the two permutations, of a word's place in its shingle, and of a band's hash.
FIRST, SECOND, THIRD, PLACE, BAND = (int(x) for x in _odd[:5])
MASK = (1 << 64) - 1


def scattered(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
    return x ^ (x >> np.uint64(27))


def sets_of(texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted numbers of the distinct shingles of each text. Words are hashed once for all texts."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    known: dict[bytes, int] = {}
    for words in split:
        known.update(dict.fromkeys(words, 0))
    for word in known:
        known[word] = xxhash.xxh64_intdigest(word, SEED)
    out = []
    for words in split:
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            out.append(h)
            continue
        width = min(shingle, len(h))
        x = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            x = x * np.uint64(PLACE) + h[i : i + len(x)]
        out.append(np.unique(scattered(x)))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Coordinates (rows: sets, none of them empty; columns: shifts)."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    # The second permutation begins with a product, which takes the shift out of the loop over shingles.
    base = np.concatenate(sets) * np.uint64(SECOND)
    for k in range(BANDS * ROWS):
        y = base + np.uint64((k + 1) * SECOND & MASK)
        y ^= y >> np.uint64(32)
        y *= np.uint64(THIRD)
        out[:, k] = np.minimum.reduceat(y, starts)
    return out


def buckets(found: np.ndarray) -> np.ndarray:
    """One number for each band of each row, other for every band."""
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(found), BANDS)).copy()
    for i in range(ROWS):
        out = (out ^ found[:, i::ROWS]) * np.uint64(BAND)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, marks, buckets): size, digest of the set, a byte of each coordinate, a number for each band."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows, "text", 1 << 20):
            sets = sets_of(texts_of(batch.column("text")))
            full = [i for i, s in enumerate(sets) if len(s)]
            found = signatures([sets[i] for i in full]) if full else np.zeros((0, BANDS * ROWS), np.uint64)
            marks: list[bytes | None] = [None] * len(sets)
            made: list[np.ndarray | None] = [None] * len(sets)
            for i, mark, bucket in zip(full, (found >> np.uint64(40)).astype(np.uint8), buckets(found), strict=True):
                marks[i], made[i] = mark.tobytes(), bucket
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary()), pa.array(made, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "key", "marks", "buckets"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, marks binary, buckets array<long>")


def united(close: Callable[[int, np.ndarray], np.ndarray], size: np.ndarray) -> np.ndarray:
    """For rows in order of size, each row's first row that links reach; ``close(i, others)`` says which others are linked to i."""
    root = np.arange(len(size))
    for i in range(len(size) - 1):
        until = int(np.searchsorted(size, size[i] * 100 // PERCENT, side="right"))  # no larger set can reach it
        others = i + 1 + np.flatnonzero(root[i + 1 : until] != root[i])
        if not len(others):
            continue
        near = np.unique(root[others[close(i, others)]])
        near = near[near != root[i]]
        if len(near):
            least = min(root[i], near[0])
            root[np.isin(root, np.append(near, root[i]))] = least
    return root


def by_marks(marks: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    return lambda i, others: (marks[others] == marks[i]).sum(1, dtype=np.int32) >= AGREE


def by_sets(sets: list[np.ndarray], marks: np.ndarray | None = None) -> Callable[[int, np.ndarray], np.ndarray]:
    size = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    marked = np.zeros(len(codes), bool)
    maybe = by_marks(marks) if marks is not None else lambda i, others: np.ones(len(others), bool)

    def close(i: int, others: np.ndarray) -> np.ndarray:
        linked = maybe(i, others)
        own = codes[ends[i] - size[i] : ends[i]]
        marked[own] = True
        for at in np.flatnonzero(linked):
            j = others[at]
            both = int(marked[codes[ends[j] - size[j] : ends[j]]].sum())
            linked[at] = 100 * both >= PERCENT * (size[i] + size[j] - both)
        marked[own] = False
        return linked

    return close


def parted(rows: DataFrame, parts: str) -> DataFrame:
    """``rows`` with ``_low`` and ``_high``: those of groups with several ``parts`` stand in a group for each two of them."""
    part = F.pmod(F.xxhash64(F.lit(1), "node", "key"), F.col(parts)).cast("int")
    other = F.explode(F.when(F.col(parts) == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col(parts).cast("int") - 1), F.col("_part"))))
    dealt = rows.withColumn("_part", part).withColumn("_other", other)
    return dealt.withColumn("_low", F.least("_part", "_other")).withColumn("_high", F.greatest("_part", "_other"))


def in_groups(rows: DataFrame, parts: str, *group: str) -> DataFrame:
    """``parted`` rows, dealt by group."""
    return parted(rows, parts).repartition(*group, "_low", "_high").sortWithinPartitions(*group, "_low", "_high")


def forests(rows: DataFrame, bulk: str, *group: str) -> DataFrame:
    """(a, b) links that connect what is linked inside each group of ``in_groups``: by marks, and by whole sets if the rows have them."""
    keys = [*group, "_low", "_high"]
    given = [c for c in ("node", "n", "marks", "set") if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            held.sort(key=lambda r: (r[1], r[0]))
            node, size = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64)
            marks = np.frombuffer(b"".join(r[2] for r in held), np.uint8).reshape(len(held), -1) if "marks" in given else None
            root = united(by_sets([np.frombuffer(r[-1], np.uint64) for r in held], marks) if "set" in given else by_marks(marks), size)
            moved = np.flatnonzero(node != node[root])
            return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], ["a", "b"])

        for batch in slices(batches, bulk, 1 << 22):
            columns = [batch.column(c).to_pylist() for c in (*keys, *given)]
            for row in zip(*columns, strict=True):
                if list(row[: len(keys)]) != now:
                    if len(held) > 1:
                        yield out()
                    now, held = list(row[: len(keys)]), []
                held.append(row[len(keys) :])
        if len(held) > 1:
            yield out()

    return rows.select(*keys, *given).mapInArrow(run, "a long, b long")


def whole_sets(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``nodes`` (node, key, ...) with their sets, made again from the texts of their documents; one row a node and key."""
    others = [c for c in nodes.columns if c not in ("node", "key")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows, "text", 1 << 20):
            made = [s.tobytes() for s in sets_of(texts_of(batch.column("text")), shingle)]
            fits = [m if xxhash.xxh3_128_digest(m) == k else None for m, k in zip(made, batch.column("key").to_pylist(), strict=True)]  # one id may have several texts
            columns = {c: batch.column(c) for c in ("node", "key", *others)} | {"set": pa.array(fits, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    named = only(docs, "doc_id", "text").withColumnRenamed("doc_id", "node").join(nodes, "node")
    types = ", ".join(f"{c} {t}" for c, t in nodes.select("node", "key", *others).dtypes)
    return named.select("node", "key", *others, "text").mapInArrow(run, f"{types}, set binary").where("set IS NOT NULL").dropDuplicates(["node", "key"])


def candidates(nodes: DataFrame, folder: str) -> DataFrame:
    """(node, component) of the nodes (node, key, n, marks, buckets) that have candidates."""
    rows = nodes.select("node", "key", F.explode("buckets").alias("bucket"))
    mark = F.sum(F.xxhash64("node", "key").cast("decimal(38,0)")).alias("mark")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), mark, F.min("node").alias("least")).where("count > 1")
    # Buckets with the same rows are one.
    sizes = sizes.groupBy("count", "mark", "least").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("count") / GROUP).alias("parts"))
    chosen = rows.join(sizes, "bucket").groupBy("node", "key").agg(F.collect_list(F.struct("bucket", "parts")).alias("x"))
    members = written(nodes.select("node", "key", "n", "marks").join(chosen, ["node", "key"]), f"{folder}/members").select("node", "key", "n", "marks", F.inline("x"))
    found = forests(in_groups(members, "parts", "bucket"), "marks", "bucket")
    return components(found, f"{folder}/candidates")


def confirmed(docs: DataFrame, nodes: DataFrame, joined: DataFrame, folder: str, shingle: int = SHINGLE) -> DataFrame:
    """(a, b) links between nodes (node, key, n, if given marks) of the same candidate component (node, component), by their whole sets."""
    least = joined.groupBy("component").agg(F.min("component").alias("node")).select("node", "component")
    inside = nodes.select("node", "key", "n", *[c for c in nodes.columns if c == "marks"]).join(joined.unionByName(least), "node")
    sets = written(whole_sets(docs, inside, shingle), f"{folder}/sets")
    sizes = sets.groupBy("component").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("bytes"))
    sizes = sizes.where("count > 1").select("component", F.greatest(F.ceil(F.col("count") / GROUP), F.ceil(8 * F.col("bytes") / GROUP_BYTES)).alias("parts"))
    return forests(in_groups(sets.join(sizes, "component"), "parts", "component"), "set", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    folder = shared_folder(docs.sparkSession)
    made = written(sketches(docs), f"{folder}/sketches")
    named = made.where("doc_id IS NOT NULL AND key IS NOT NULL")
    nodes = written(named.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("marks").alias("marks"), F.first("buckets").alias("buckets")), f"{folder}/nodes")
    links = written(confirmed(docs, nodes, candidates(nodes, folder), folder), f"{folder}/links")
    # Copies hang on their node; so do all the texts of one id.
    own = named.select("doc_id", "key").distinct().join(nodes.select("key", "node"), "key").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    joined = components(links.unionByName(own), f"{folder}/components")
    out = made.select("doc_id", "n").join(joined, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
