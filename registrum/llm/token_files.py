"""Document lengths from flat token files without an index, by scanning for the end-of-document id.

Files. Ids as little-endian numbers of two or four bytes, every document followed by
the end id, nothing else. Spark's text writer makes them: a document's bytes are a
"line" and the end id's bytes are the line separator, so the commit protocol of Spark
covers them and any store will do.

Scan. A file is cut into blocks. Each block is searched with one vectorised comparison
and gives its number of ids and the positions of its end ids. A prefix scan then stitches
what crosses a border: over the blocks of a file, and over the files (a row each), it
carries how many ids came since the last end id, how many documents ended and where the
block starts. Documents may therefore cross blocks and files, and be longer than both.

Defined cases: an empty text is the end id alone, and so is a null one. Empty files give
nothing. Ids after the last end id are a last document with ``closed`` false. A file that
does not hold whole ids fails, as does one of two gigabytes. Repeated texts are separate documents. An empty table
gives no files and no rows. Columns besides ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from registrum.llm.byte_pieces import encoder
from registrum.llm.common import only, slices, texts_of

#: Bytes of a block, a multiple of every width, and documents of a file at most: files are read in parallel, and Spark refuses one of two gigabytes.
BLOCK, RECORDS = 1 << 21, 200_000


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2) -> None:
    """Flat files, one per ``RECORDS`` documents of a partition of ``docs``, in its order. Strings of special tokens in a text are ordinary text."""
    dtype = f"<u{width}"
    end = np.array([end_id], dtype).tobytes()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, True, dtype)
        for batch in slices(rows, "text", keep=True):
            yield pa.RecordBatch.from_arrays([pa.array(encode.encode(texts_of(batch.column("text"))), pa.binary())], ["ids"])

    ids = only(docs, "text").mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
    ids.write.option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).option("maxRecordsPerFile", RECORDS).text(folder)


def blocks(spark: SparkSession, folder: str, end_id: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """file, block, n_ids and ``ends`` (positions of the end ids in the block)."""
    files = spark.read.format("binaryFile").load(folder).where("length > 0")
    whole = F.when(F.col("length") % width == 0, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("not whole ids: "), "path")))
    parts = files.select("path", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((whole - 1) / block))).alias("block"))
    parts = parts.select(F.col("path").alias("file"), "block", F.substring("content", F.col("block") * block + 1, F.lit(block)).alias("data"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids = [np.frombuffer(x, f"<u{width}") for x in batch.column("data").to_pylist()]
            found = [np.flatnonzero(x == end_id) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array([len(x) for x in ids], pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                ["file", "block", "n_ids", "ends"],
            )

    return parts.mapInArrow(run, "file string, block long, n_ids long, ends array<long>")


def scanned(rows: DataFrame, over: Window, first: str) -> DataFrame:
    """The prefix scan of (n_ids, n_ends, rest): what lies before each row, in columns that begin with ``first``.

    ``rest`` is how many ids follow a row's last end id. Given are ids (``ids``), ended
    documents (``docs``) and the position after the last end id (``last``, null: none yet).
    """
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(f"{first}ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    rows = rows.withColumn(f"{first}docs", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    here = F.when(F.col("n_ends") > 0, F.col(f"{first}ids") + F.col("n_ids") - F.col("rest"))
    return rows.withColumn("_here", here).withColumn(f"{first}last", F.max("_here").over(before)).drop("_here")


def lengths(cut: DataFrame) -> DataFrame:
    """doc_no, start, n_tokens (the end id included) and closed, from ``blocks``."""
    n_ends = F.size("ends").cast("long")
    cut = cut.withColumn("n_ends", n_ends).withColumn("rest", F.when(n_ends > 0, F.col("n_ids") - 1 - F.element_at("ends", -1)).otherwise(F.col("n_ids")))
    cut = scanned(cut, Window.partitionBy("file").orderBy("block"), "b_")
    end = F.when(F.col("n_ends") > 0, F.col("b_ids") + F.col("n_ids") - F.col("rest"))
    files = cut.groupBy("file").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_ends").alias("n_ends"), F.max(end).alias("_end"))
    files = files.withColumn("rest", F.col("n_ids") - F.coalesce("_end", F.lit(0))).drop("_end")
    files = scanned(files, Window.orderBy("file"), "f_")  # a row per file
    where = files.select("file", "f_ids", "f_docs", "f_last")
    cut = cut.where("n_ends > 0").join(where, "file")
    at = cut.select(
        (F.col("f_docs") + F.col("b_docs")).alias("docs"),
        (F.col("f_ids") + F.col("b_ids")).alias("ids"),
        F.coalesce(F.col("f_ids") + F.col("b_last"), F.col("f_last"), F.lit(0)).alias("last"),
        "ends",
        F.posexplode("ends").alias("pos", "end"),
    )
    start = F.when(F.col("pos") == 0, F.col("last")).otherwise(F.col("ids") + F.get("ends", F.col("pos") - 1) + 1)
    ended = at.select((F.col("docs") + F.col("pos")).alias("doc_no"), start.alias("start"), (F.col("ids") + F.col("end") + 1 - start).alias("n_tokens"), F.lit(True).alias("closed"))
    totals = files.agg(F.sum("n_ids").alias("ids"), F.sum("n_ends").alias("docs"), F.max(F.when(F.col("n_ends") > 0, F.col("f_ids") + F.col("n_ids") - F.col("rest"))).alias("last"))
    last = F.coalesce("last", F.lit(0).cast("long"))
    open_end = totals.where(F.col("ids") > last).select(F.col("docs").alias("doc_no"), last.alias("start"), (F.col("ids") - last).alias("n_tokens"), F.lit(False).alias("closed"))
    return ended.unionByName(open_end)
