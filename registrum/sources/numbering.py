"""Numbers of documents over any set of files, and cuts by them.

A document's number is that of its line, plus the lines of all files before its own. The
lines of the files are counted, and summed up in two levels: inside ranges of files, and over
the ranges, of which there are as many as partitions. No task sees more than a range of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from registrum.session import materialise

NUMBER = "doc_no"
#: Numbers fall into so many steps at once when a cut is looked for; the driver sees a count of each.
STEP_BITS = 12


def prefix_sums(parts: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``parts`` with the sum of ``value`` over all rows before, by ``order`` (which names a row)."""
    placed = materialise(parts.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_range").agg(F.sum(value).alias("_sum"))
    # A row per partition of a shuffle, so one window and a broadcast are bounded.
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(before.orderBy("_range")), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(before.partitionBy("_range").orderBy(*order)), F.lit(0))
    return placed.withColumn("_inside", inside).join(F.broadcast(sums), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def numbered(docs: DataFrame, file: str = "path", line: str = "doc_idx", name: str = NUMBER) -> DataFrame:
    """``docs`` with their number over all files, in order of file name and line.

    Numbers run from 0 without gaps if each file's lines do. They are the same however the
    files are read; a file added before others moves the numbers of these.
    """
    files = docs.groupBy(file).agg((F.max(line) + 1).alias("_lines"))
    first = prefix_sums(files, [file], "_lines", "_first").select(file, "_first")
    return docs.join(first, file).withColumn(name, F.col("_first") + F.col(line)).drop("_first")


def end_of(docs: DataFrame, n: int, start: int = 0, number: str = NUMBER) -> int:
    """The number below which there are ``n`` documents from ``start`` on, or all there are.

    Looked for digit by digit: each pass counts documents per leading digits of their number
    within the last pass's digit, so nothing is sorted or collected but these counts.
    """
    keys = docs.select(F.col(number).cast("long").alias("k")).where(F.col("k") >= start)
    top = keys.agg(F.max("k")).first()[0]
    if top is None or n <= 0:
        return start
    shift = max(0, int(top).bit_length() - STEP_BITS)
    while True:
        seen = 0
        for row in keys.groupBy(F.shiftright("k", shift).alias("d")).count().orderBy("d").collect():
            if seen + row["count"] >= n:
                break
            seen += row["count"]
        else:
            return int(top) + 1  # fewer than asked for
        low, high = row["d"] << shift, (row["d"] + 1) << shift
        if shift == 0:
            return high
        keys, n, shift = keys.where((F.col("k") >= low) & (F.col("k") < high)), n - seen, max(0, shift - STEP_BITS)


def document_range(docs: DataFrame, start: int = 0, max_docs: int | None = None, number: str = NUMBER) -> DataFrame:
    """The first ``max_docs`` documents from number ``start`` on; numbers may have gaps, which are not counted."""
    kept = docs.where(F.col(number) >= start)
    return kept if max_docs is None else kept.where(F.col(number) < end_of(docs.select(number), max_docs, start, number))
