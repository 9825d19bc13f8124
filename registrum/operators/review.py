"""Looking through labelled documents: filtered lines, next match, random document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions import annotation as A
from registrum.operators.lines import explode_lines, section_lines
from registrum.schemas import SECTIONS


def review_lines(docs: DataFrame, keys: list[str], value: str | None = None,
                 sections: list[str] = SECTIONS) -> DataFrame:
    """Lines to review, with a one-line summary of their label."""
    lines = explode_lines(docs, keys, sections).where(A.is_reviewable(F.col("ann"), value))
    return lines.select(*keys, "section", "line_idx", "num", "text", A.describe(F.col("ann")).alias("summary"))


def has_match(section: str, value: str | None) -> Column:
    return F.exists(section_lines(section), lambda l: A.is_reviewable(l["ann"], value))


def next_match(docs: DataFrame, start: int, section: str = "main", value: str | None = None, forward: bool = True,
               order: str = "doc_id") -> DataFrame:
    """First document at or after ``start`` with a match, wrapping round; backwards likewise.

    Two aggregates over the matching positions, with no global ordering.
    """
    at = F.col(order)
    hits = docs.where(has_match(section, value)).select(order)
    if forward:
        found = F.coalesce(F.min(F.when(at >= start, at)), F.min(at))
    else:
        found = F.coalesce(F.max(F.when(at <= start, at)), F.max(at))
    return hits.agg(found.alias(order))


def random_document(docs: DataFrame, seed: int, order: str = "doc_id") -> DataFrame:
    """One document, drawn by seeded hash."""
    return docs.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(order).cast("string"))), order).limit(1)
