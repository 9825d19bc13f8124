"""Registers per line, segments of equal register, and register counts per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.functions import annotation as A
from registrum.functions.arrays import map_runs, total
from registrum.operators.lines import document_lines, section_lines
from registrum.schemas import SECTIONS, SEGMENT
from registrum.session import built_once

MAX_BIN = 6


def register_lines(lines: Column) -> Column:
    """Labelled lines to (label, text); a line without annotation cannot be rated."""
    return F.transform(
        lines,
        lambda l: F.struct(
            A.register_for_segments(
                l["ann"]["mode_medium"], l["ann"]["mode_turn"], l["ann"]["field_activity"]
            ).alias("label"),
            l["text"].alias("text"),
        ),
    ).cast(f"array<{SEGMENT}>")


@built_once
def section_registers(section: str) -> Column:
    """(label, text) of every line of one section."""
    return register_lines(section_lines(section))


def merge_runs(lines: Column) -> Column:
    """Neighbouring lines of one register become one segment, texts joined by a blank."""
    return map_runs(
        lines,
        lambda l: l["label"],
        lambda run: F.struct(
            F.get(run, F.lit(0))["label"].alias("label"),
            F.array_join(F.transform(run, lambda l: l["text"]), " ").alias("text"),
        ),
    ).cast(f"array<{SEGMENT}>")


@built_once
def document_segments(sections: list[str]) -> Column:
    return merge_runs(register_lines(document_lines(sections)))


def map_segments(docs: DataFrame, keys: list[str], sections: list[str] = SECTIONS) -> DataFrame:
    """Documents to arrays of segments; a run continues across the section boundary."""
    return docs.select(*keys, document_segments(sections).alias("segments"))


def explode_segments(mapped: DataFrame, keys: list[str]) -> DataFrame:
    fields = F.arrays_zip(F.col("segments.label"), F.col("segments.text"))
    return mapped.select(*keys, F.posexplode(fields).alias("segment_idx", "segment")).select(
        *keys, "segment_idx", "segment.label", "segment.text"
    )


def distinct_registers(labels: Column, cap: int | None = MAX_BIN) -> Column:
    """Distinct registers in a document, unrateable lines aside, capped at ``cap`` and more."""
    n = F.size(F.array_distinct(F.filter(labels, lambda x: x != A.CANNOT_RATE)))
    return n if cap is None else F.least(n, F.lit(cap))


def register_count_distribution(counts: DataFrame) -> DataFrame:
    """(lang, n_reg) per document to frequency and share within the language."""
    freq = counts.groupBy("lang", "n_reg").agg(F.count(F.lit(1)).alias("freq"))
    docs = F.sum("freq").over(Window.partitionBy("lang"))
    return freq.select("lang", "n_reg", "freq", (F.col("freq").cast("double") / docs).alias("share"))


def mean_share_by_count(distribution: DataFrame) -> DataFrame:
    """Mean and population deviation over languages of each count's share.

    A language without documents at some count has share 0 there. The zeros
    need no language x count grid: with L languages, sums over the present
    shares give both moments.
    """
    langs = distribution.agg(F.count_distinct("lang").alias("langs")).scalar()
    sums = distribution.groupBy("n_reg").agg(
        F.sum("share").alias("s1"),
        F.count(F.lit(1)).alias("present"),
        F.collect_list("share").alias("shares"),
    )
    mean = F.col("s1") / F.col("langs")
    squares = F.aggregate(
        F.transform("shares", lambda x: x - F.col("mean")), F.lit(0.0), lambda acc, d: acc + d * d
    ) + (F.col("langs") - F.col("present")) * F.col("mean") * F.col("mean")
    return (
        sums.withColumn("langs", langs)
        .withColumn("mean", mean)
        .select("n_reg", "mean", F.sqrt(squares / F.col("langs")).alias("std"))
    )


def length_and_registers(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """Characters and distinct labels (unrateable included) per document."""
    return mapped.select(
        *keys,
        total(F.transform("segments", lambda s: F.length(s["text"]))).alias("n_chars"),
        F.size(F.array_distinct(F.transform("segments", lambda s: s["label"]))).alias("n_labels"),
    )
