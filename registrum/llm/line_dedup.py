"""Lines that many documents share, found with levelled sorted runs of line hashes.

A run is a table of line keys (128-bit hashes), bucketed and sorted by key, with the
number of documents that hold each key and, if the run's batch was the first to hold it,
the key's owner. A new batch is summed per key, merge-joined with the runs there are
(bucketed alike, so no run is shuffled or sorted again) to tell new keys from known
ones, and written as a run of level 0. When a level holds ``fanout`` runs they are
merged into one of the next level, so there are few runs and each key is rewritten once
a level. Batches come in descending ``doc_id``, which makes the owner the largest id.

Dropping. Keys of at least ``min_chars`` code points, held by at least ``min_docs``
documents, lose all their lines outside their owner. Which keys a document loses is
joined to it by ``doc_id``; a key that very many documents hold is an ordinary skewed
join, which adaptive execution splits.

Defined cases: a null or empty text is one empty line. Rows with the same ``doc_id``
count as one document and are each filtered. Rows with a null ``doc_id`` count for no
key and lose nothing. An empty table gives no rows. Other columns than those named are
carried along by ``kept`` and not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.llm.common import BLANKS, only, shared_folder, slices, texts_of, written

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 3


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Hash of the line's key, None if the key is too short."""
    key = line.strip(BLANKS).lower()  # bytes lower A to Z only
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, k): the distinct keys of every document."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows, "text"):
            ids, keys = [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                own = {line_key(x, min_chars) for x in text.encode("utf-8", "surrogatepass").split(b"\n")} - {None}
                ids += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "k"])

    return only(docs, "doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, k binary").dropDuplicates(["doc_id", "k"])


class LineRuns:
    """Levelled runs in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def add(self, batch: DataFrame) -> None:
        """Merge-join a batch (doc_id, k), distinct, with the runs and add it as a run."""
        sums = batch.groupBy("k").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("owner"))
        known = F.lit(False)
        for i, name in enumerate(x for level in self.levels for x in level):
            sums = sums.join(self.spark.table(name).select("k", F.lit(True).alias(f"_in{i}")), "k", "left")
            known = known | F.coalesce(f"_in{i}", F.lit(False))
        self._write(sums.select("k", "n_docs", F.when(~known, F.col("owner")).alias("owner")), 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._compact(level)

    def _compact(self, level: int) -> None:
        merged, self.levels[level] = self.levels[level], []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self._write(self._summed(merged), level + 1)
        for name in merged:
            self.spark.sql(f"DROP TABLE {name}")

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"llm_run_{uuid.uuid4().hex}"
        sorted_rows = rows.repartition(self.buckets, "k").sortWithinPartitions("k")
        sorted_rows.write.bucketBy(self.buckets, "k").sortBy("k").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.levels[level].append(name)

    def _summed(self, names: list[str]) -> DataFrame:
        # Read as plain files: a union of bucketed scans would claim a partitioning that it loses when buckets are not scanned as such.
        rows = self.spark.read.schema("k binary, n_docs long, owner long").parquet(*[f"{self.folder}/{name}" for name in names])
        return rows.groupBy("k").agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))

    def common(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(k, owner) of the keys that at least ``min_docs`` documents hold."""
        names = [x for level in self.levels for x in level]
        return self._summed(names).where(F.col("n_docs") >= min_docs).select("k", "owner")

    def close(self) -> None:
        for name in (x for level in self.levels for x in level):
            self.spark.sql(f"DROP TABLE {name}")


def kept(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with its text after dropping, and n_lines and n_dropped."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    keys = written(line_keys(docs, min_chars), f"{folder}/keys")
    runs = LineRuns(spark, folder)
    cuts = keys.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        part = keys if low is None else keys.where(F.col("doc_id") > low)
        runs.add(part if high is None else part.where(F.col("doc_id") <= high))
    common = written(runs.common(min_docs), f"{folder}/common")
    runs.close()
    lost = keys.join(common, "k").where("doc_id <> owner").groupBy("doc_id").agg(F.collect_set("k").alias("_lost"))
    frame = docs.join(lost.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    types = [(f.name, f.dataType.simpleString()) for f in docs.schema.fields]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows, "text"):
            texts, n_lines, n_dropped = [], [], []
            for text, lose in zip(texts_of(batch.column("text")), batch.column("_lost").to_pylist(), strict=True):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                gone = set(lose or ())
                stay = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                texts.append(b"\n".join(stay).decode("utf-8", "surrogatepass") if gone else text)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            out = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c, _ in types]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*[c for c, _ in types], "n_lines", "n_dropped"])

    return frame.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in types], "n_lines long, n_dropped long"]))
