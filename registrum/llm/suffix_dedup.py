"""Repeated byte strings across documents, by bucket refinement over suffixes.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document
with a smaller id. So suffixes need only be told apart by their first 50 bytes.

Buckets. Every position has the identifier of the 16-byte gram that starts there (a mix
of its two 8-byte halves). Identifiers of longer prefixes come from those of shorter
ones at later offsets, reused recursively: 16 + 16 at offset 16 give 32, and 32 with 32
at offset 18 give 50. Only a synchronised sample of suffixes is sorted: of each 50-byte
string, those of its 35 grams with the smallest identifier (*anchors*). Equal strings have
equal anchors at equal places, so nothing is missed, and about 1 position in 18 is moved.

Refinement 1. Suffixes at anchors are dealt by initial bucket (the anchor's gram) and
sorted within it by the identifier of their *unit*: all 50-byte strings that have this
anchor, which adjoin. Buckets of one document are finished. A unit also found in a smaller
document is finished: all its strings repeat. Refinement 2. Only where a bucket holds
several units of several documents, their single strings are sorted, by identifiers that
refinement 1 computed. What is left after that repeats nothing.

Work. Documents are packed into chunks, written once, bucketed by chunk without moving
text. A chunk sends each unit (each string) once, with the smallest of its own documents,
so a passage in a third of all documents is sent at most once a chunk, and gets back only
the identifiers that a smaller document holds elsewhere. Text never goes through a
shuffle; identifiers are packed by byte planes, which compress. Identifiers are 64-bit
hashes: the chance that any two of n different strings share one is n * n / 2**65.

Defined cases: a null text is empty; texts below 50 bytes, and texts of rows without an
id, lose nothing and take nothing from others. Rows with the same id don't take from each
other. An empty table gives no rows. What is kept of a text may cut characters, so it is
bytes. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.llm.common import only, shared_folder, texts_of

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1  # grams of a string
#: Bytes of a chunk (unless one document has more), and strings handled in one numpy step.
CHUNK, STEP = 1 << 21, 1 << 19
#: Bits of a bucket that are sent.
BUCKET_BITS = 40
#: Parts per shuffle partition, in which identifiers are dealt.
PARTS = 4
U = np.uint64


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (b ^ (b >> U(31))) * U(0xC2B2AE3D27D4EB4F)
    x += a * U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    x[x == 0] = 1  # 0 marks strings that are not valid
    return x


def scattered(bucket: np.ndarray) -> np.ndarray:
    """Buckets dealt evenly: they are minima, so small, until their bits are mixed.

    Of the mixed bits, which are as many as before and belong to one bucket, the low ones are
    left out. Two buckets that then look alike are sorted together: units are
    still told apart, at most more strings are compared.
    """
    x = (bucket ^ (bucket >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return (x ^ (x >> U(32))) & ~U((1 << 64 - BUCKET_BITS) - 1)


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``width`` adjoining values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[:-rest], x[rest:]) if rest else x


def units(raw: bytes, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the strings that start at 0 .. len(valid) - 1, where valid.

    Returns bucket, unit, first and last string of each anchor's unit, and the identifier of each string.
    """
    n = len(valid)
    grams = n + SPAN - 1
    padded = raw + bytes(GRAM)
    word = np.ascontiguousarray(np.ndarray((grams + 8,), "<u8", padded, strides=(1,)))
    gram = mix(word[:grams], word[8 : grams + 8])
    double = mix(gram[: n + 18], gram[GRAM : n + 18 + GRAM])
    string = mix(double[:n], double[18 : n + 18])
    edge = np.zeros(SPAN - 1, U)
    least = np.concatenate([edge, np.where(valid, sliding(gram, SPAN, np.minimum), U(0)), edge])
    at = np.flatnonzero((sliding(least, SPAN, np.maximum) == gram) & (gram > 0))
    bucket = gram[at]
    has = np.lib.stride_tricks.sliding_window_view(least, SPAN)[at] == bucket[:, None]  # strings that start up to SPAN - 1 before
    first, last = at - (SPAN - 1) + has.argmax(axis=1), at - has[:, ::-1].argmax(axis=1)
    shape = ((at - first) * 64 + (last - first)).astype(U)
    unit = mix(mix(string[first], string[last]), shape + U(1))
    return bucket, unit, first, last, string


class Chunk:
    """Documents one after the other in a run of bytes."""

    def __init__(self, docs: list[int], lengths: list[int], raw: bytes):
        self.docs, self.raw = np.array(docs, np.int64), raw
        self.ends = np.cumsum(np.array(lengths, np.int64))
        self.starts = self.ends - lengths

    def steps(self) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        """(offset, units) of every step; each string is in one step."""
        size = len(self.raw)
        valid = np.ones(size, bool)
        for start, end in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            valid[max(start, end - LENGTH + 1) : end] = False
        for at in range(0, size, STEP):
            ok = valid[at : at + STEP]
            if ok.any():
                part = self.raw[at : at + len(ok) + LENGTH]
                yield at, units(part + bytes(len(ok) + LENGTH - len(part)), ok)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Ids of the documents that hold these positions."""
        return self.docs[np.searchsorted(self.ends, at, side="right")]


def smallest(keys: list[np.ndarray], doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each distinct key (most significant first) with its smallest document."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    keys, doc = [k[order] for k in keys], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return [k[new] for k in keys], least_of(new, doc)


def least_of(new: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest document of each group; ``new`` marks where groups begin."""
    return np.minimum.reduceat(doc, np.flatnonzero(new)) if len(doc) else doc


def above_least(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which (key, doc) have the key with a smaller document too."""
    order = np.argsort(keys)
    k, d = keys[order], doc[order]
    out = np.zeros(len(k), bool)
    if len(k):
        new = np.append(True, k[1:] != k[:-1])
        out[order] = d > least_of(new, d)[np.cumsum(new) - 1]
    return out


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, by byte planes."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(blob, np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes]


def joined(blobs: list[bytes] | None) -> np.ndarray:
    return np.sort(np.concatenate([unpacked(b, 1)[0] for b in blobs])) if blobs else np.zeros(0, U)


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def chunks(docs: DataFrame, folder: str, chunk_bytes: int = CHUNK) -> str:
    """Write the documents as chunks; returns the name of the bucketed table."""
    spark = docs.sparkSession

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        parts: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            values = ([number], [ids], [[len(p) for p in parts]], [b"".join(parts)])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["chunk", "docs", "lengths", "raw"])

        types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        for batch in rows:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if ids and size + len(raw) > chunk_bytes:
                    yield out()
                    number, ids, parts, size = number + 1, [], [], 0
                ids.append(doc)
                parts.append(raw)
                size += len(raw)
        if ids:
            yield out()

    name = f"llm_chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = only(docs, "doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, "chunk long, docs array<long>, lengths array<long>, raw binary")
    rows.write.bucketBy(buckets, "chunk").option("compression", "zstd").option("path", f"{folder}/chunks").saveAsTable(name)
    return name


def dealt(rows: Iterator[pa.RecordBatch], parts: int, send) -> Iterator[pa.RecordBatch]:
    """(part, chunk, blob) of what ``send(chunk row)`` gives: columns sorted by the first, dealt by its high bits."""
    for batch in rows:
        for row in batch.to_pylist():
            columns = send(row)
            bounds = np.searchsorted((columns[0] >> U(40)) * U(parts) >> U(24), np.arange(parts + 1, dtype=U))
            used = [(p, packed(*[c[bounds[p] : bounds[p + 1]] for c in columns])) for p in range(parts) if bounds[p] < bounds[p + 1]]
            if used:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in used], pa.int32()), pa.array([row["chunk"]] * len(used), pa.int64()), pa.array([b for _, b in used], pa.binary())], ["part", "chunk", "blob"]
                )


def answered(sent: DataFrame, columns: int, answer) -> DataFrame:
    """(chunk, kind, blob): for every part, ``answer(columns)`` gives masks by kind; each chunk gets its identifiers back."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        part = None

        def out() -> Iterator[pa.RecordBatch]:
            each = [unpacked(blob, columns) for _, blob in held]
            names = np.array([c for c, _ in held])
            of = np.repeat(np.arange(len(held)), [len(x[0]) for x in each])
            found = []
            for kind, (mask, identifier) in enumerate(answer([np.concatenate(c) for c in zip(*each, strict=True)])):
                where, values = of[mask], identifier[mask]
                if not len(where):
                    continue
                order = np.lexsort([values, names[where]])
                where, values = names[where][order], values[order]
                cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
                for a, b in zip(cuts, [*cuts[1:], len(where)], strict=True):
                    found.append((int(where[a]), kind, packed(values[a:b])))
            if found:
                chunk, kind, blob = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["chunk", "kind", "blob"])

        for batch in rows:
            for p, c, b in zip(batch.column("part").to_pylist(), batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if p != part and held:
                    yield from out()
                    held = []
                part = p
                held.append((c, b))
        if held:
            yield from out()

    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(run, "chunk long, kind int, blob binary")


def refine_units(columns: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of (bucket, unit, doc): units that a smaller document of another chunk holds; units whose strings must be sorted.

    Where several chunks have the smallest document of a unit, each of them has strings to sort.
    """
    bucket, unit, doc = columns[0], columns[1], columns[2].view(np.int64)
    order = np.lexsort([unit, bucket])
    b, u, d = bucket[order], unit[order], doc[order]
    new_bucket = np.append(True, b[1:] != b[:-1])
    new_unit = new_bucket | np.append(True, u[1:] != u[:-1])
    of_unit = least_of(new_unit, d)
    least = of_unit[np.cumsum(new_unit) - 1]
    heads = np.flatnonzero(new_unit)
    of_bucket = np.cumsum(new_bucket[heads]) - 1
    starts = np.flatnonzero(new_bucket[heads])
    low, high = np.minimum.reduceat(of_unit, starts), np.maximum.reduceat(of_unit, starts)
    resolved, probe = np.zeros(len(d), bool), np.zeros(len(d), bool)
    resolved[order] = d > least
    probe[order] = (d == least) & (low < high)[of_bucket][np.cumsum(new_unit) - 1]
    return [(resolved, unit), (probe, unit)]


def refine_strings(columns: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of (string, doc): strings that a smaller document of another chunk holds."""
    string, doc = columns[0], columns[1].view(np.int64)
    return [(above_least(string, doc), string)]


def send_units(row: dict) -> list[np.ndarray]:
    chunk = Chunk(row["docs"], row["lengths"], row["raw"])
    found = [(b, u, chunk.owner(first + at)) for at, (b, u, first, _, _) in chunk.steps()]
    if not found:
        return [np.zeros(0, U)] * 3
    bucket, unit, doc = (np.concatenate(c) for c in zip(*found, strict=True))
    (bucket, unit), doc = smallest([scattered(bucket), unit], doc)
    return [bucket, unit, doc.view(U)]


def probed(at: int, found: tuple[np.ndarray, ...], probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, identifier) of every string of a step that is in the units to probe."""
    _, unit, first, last, string = found
    hit = among(unit, probe)
    where = spread(first[hit], last[hit])
    return at + where, string[where]


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All positions in the ranges, once each."""
    if not len(first):
        return np.zeros(0, np.int64)
    edge = np.zeros(int(last.max()) + 2, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    return np.flatnonzero(np.cumsum(edge) > 0)


def send_strings(row: dict) -> list[np.ndarray]:
    probe = joined(row["probe"])
    if not len(probe):
        return [np.zeros(0, U)] * 2
    chunk = Chunk(row["docs"], row["lengths"], row["raw"])
    at, string = (np.concatenate(c) for c in zip(*[probed(*step, probe) for step in chunk.steps()], strict=True))
    (string,), doc = smallest([string], chunk.owner(at))
    return [string, doc.view(U)]


def repeats(keys: np.ndarray, doc: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
    """Which (key, doc) have a smaller document: in another chunk, or in this one."""
    return above_least(keys, doc) | among(keys, elsewhere)


def removed(row: dict) -> tuple[Chunk, np.ndarray]:
    """Which bytes of the chunk go."""
    chunk = Chunk(row["docs"], row["lengths"], row["raw"])
    probe, resolved, strings = joined(row["probe"]), joined(row["resolved"]), joined(row["strings"])
    edge = np.zeros(len(chunk.raw) + 1, np.int32)
    ranges, strung = [], []
    for at, found in chunk.steps():  # once for both: identifiers are most of the work
        _, unit, first, last, _ = found
        ranges.append((unit, first + at, last + at))
        if len(probe):
            strung.append(probed(at, found, probe))
    if ranges:
        unit, first, last = (np.concatenate(c) for c in zip(*ranges, strict=True))
        hit = repeats(unit, chunk.owner(first), resolved)
        np.add.at(edge, first[hit], 1)
        np.add.at(edge, last[hit] + LENGTH, -1)
        if len(probe):
            at, string = (np.concatenate(c) for c in zip(*strung, strict=True))
            hit = repeats(string, chunk.owner(at), strings)
            np.add.at(edge, at[hit], 1)
            np.add.at(edge, at[hit] + LENGTH, -1)
    return chunk, np.cumsum(edge[:-1]) > 0


def apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for row in batch.to_pylist():
            chunk, gone = removed(row)
            raw = np.frombuffer(chunk.raw, np.uint8)
            out = []
            for doc, start, end in zip(row["docs"], chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
                own = gone[start:end]
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
                out.append((doc, end - start, int(own.sum()), spans, raw[start:end][~own].tobytes()))
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.binary()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def deduplicated(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of every row."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    table = chunks(docs, folder, chunk_bytes)
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = "part int, chunk long, blob binary"
    first = spark.table(table).mapInArrow(lambda rows: dealt(rows, parts, send_units), sent)
    answered(first, 3, refine_units).write.partitionBy("kind").parquet(f"{folder}/units")
    back = spark.read.schema("chunk long, blob binary, kind int").parquet(f"{folder}/units")
    probe = _by_chunk(spark, back.where("kind = 1"), "probe")
    second = spark.table(table).join(probe.hint("shuffle_hash"), "chunk").mapInArrow(lambda rows: dealt(rows, parts, send_strings), sent)
    answered(second, 2, refine_strings).drop("kind").write.parquet(f"{folder}/strings")
    strings = _by_chunk(spark, spark.read.schema("chunk long, blob binary").parquet(f"{folder}/strings"), "strings")
    whole = spark.table(table)
    for answers in (probe, _by_chunk(spark, back.where("kind = 0"), "resolved"), strings):
        whole = whole.join(answers.hint("shuffle_hash"), "chunk", "left")
    spark.sql(f"DROP TABLE {table}")  # its files stay, which the plan below reads
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    out = whole.mapInArrow(apply, schema)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    nameless = only(docs, "doc_id", "text").where("doc_id IS NULL").select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), raw.alias("kept"))
    return out.unionByName(nameless)


def _by_chunk(spark: SparkSession, answers: DataFrame, name: str) -> DataFrame:
    """A row per chunk: its answers from all parts, at most as many identifiers as the chunk has."""
    return answers.groupBy("chunk").agg(F.collect_list("blob").alias(name))
