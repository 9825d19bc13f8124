"""Numbered lines of a document, their labels and their context.

Lines and annotations of a document stay arrays of its row. The join between
them, the context windows and the numbering are all row-local, so the only
growth is the final explode where a long table is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions import text as T
from registrum.functions.arrays import bind, lookup
from registrum.schemas import ANNOTATION, LINE, SECTIONS
from registrum.session import built_once

PAIR = "llm_register_annotation"
LABELLED_LINE = f"struct<section:string,line_idx:int,num:int,text:string,ann:{ANNOTATION}>"


def markdown_of(section: str) -> Column:
    return F.col(f"markdown_{section}")


def join_labels(lines: Column, annotations: Column, section: str) -> Column:
    """Lines with the label of the same line number, null when there is none."""
    labelled = lookup(
        lines,
        lambda l: l["num"],
        annotations,
        lambda a: a["line"],
        lambda l, a: F.struct(l["num"].alias("num"), l["text"].alias("text"), a.alias("ann")),
        ANNOTATION,
        LINE,
    )
    return F.transform(
        labelled,
        lambda x, i: F.struct(
            F.lit(section).alias("section"),
            i.alias("line_idx"),
            x["num"].alias("num"),
            x["text"].alias("text"),
            x["ann"].alias("ann"),
        ),
    ).cast(f"array<{LABELLED_LINE}>")


@built_once
def section_lines(section: str, pair: str = PAIR) -> Column:
    """Labelled lines of one section of an annotated document."""
    return join_labels(T.parse_numbered(markdown_of(section)), F.col(pair)[section], section)


@built_once
def document_lines(sections: list[str] = SECTIONS, pair: str = PAIR) -> Column:
    """Labelled lines of a document, main text before comments."""
    return F.concat(*[section_lines(s, pair) for s in sections])


def explode_lines(docs: DataFrame, keys: list[str], sections: list[str] = SECTIONS) -> DataFrame:
    """Long table of labelled lines: keys, section, line_idx, num, text, ann."""
    return docs.select(*keys, F.inline(document_lines(sections)))


@built_once
def numbered_lines(section: str) -> Column:
    """Numbered lines of one section without labels."""
    return F.transform(
        T.parse_numbered(markdown_of(section)),
        lambda l, i: F.struct(
            F.lit(section).alias("section"), i.alias("line_idx"), l["num"].alias("num"), l["text"].alias("text")
        ),
    )


def parse_lines(docs: DataFrame, keys: list[str], sections: list[str] = SECTIONS) -> DataFrame:
    """Long table of numbered lines without labels."""
    return docs.select(*keys, F.inline(F.concat(*[numbered_lines(s) for s in sections])))


def context_windows(lines: Column, size: int, limit: int | None, suffix: str = "…") -> Column:
    """Up to ``size`` lines before and after each line, by position in the section."""

    def shown(part: Column) -> Column:
        if limit is None:
            return F.transform(part, lambda l: F.struct(l["num"].alias("num"), l["text"].alias("text")))
        return F.transform(
            part, lambda l: F.struct(l["num"].alias("num"), T.truncate(l["text"], limit, suffix).alias("text"))
        )

    def windows(ls: Column) -> Column:
        return F.transform(
            ls,
            lambda l, i: F.struct(
                l.alias("line"),
                shown(F.slice(ls, F.greatest(i + 1 - size, F.lit(1)), F.least(i, F.lit(size)))).alias("before"),
                shown(F.slice(ls, i + 2, F.lit(size))).alias("after"),
            ),
        )

    return bind(lines, windows)


def _classifiable(line: Column) -> Column:
    return ~T.is_structural(line["text"]) & ~F.coalesce(line["ann"]["is_structural"], F.lit(False))


@built_once
def _section_candidates(section: str, size: int, limit: int, suffix: str) -> Column:
    windows = context_windows(section_lines(section), size, limit, suffix)
    return F.transform(
        F.filter(windows, lambda w: _classifiable(w["line"])),
        lambda w: F.struct(
            w["line"]["section"].alias("section"),
            w["line"]["line_idx"].alias("line_idx"),
            w["line"]["num"].alias("line_num"),
            T.truncate(w["line"]["text"], limit, suffix).alias("line_text"),
            w["before"].alias("context_before"),
            w["after"].alias("context_after"),
            w["line"]["ann"].alias("ann"),
        ),
    )


def candidates(docs: DataFrame, keys: list[str], sections: list[str] = SECTIONS, size: int = 5, limit: int = 500,
               suffix: str = "…") -> DataFrame:
    """Lines a person could label, with context and the present label.

    Structural lines go, whether recognised by prefix or flagged by the
    labelling stage; the context still shows them.
    """
    return docs.select(*keys, F.inline(F.concat(*[_section_candidates(s, size, limit, suffix) for s in sections])))


@built_once
def _slim_candidates(sections: list[str]) -> Column:
    return F.transform(
        F.filter(document_lines(sections), _classifiable),
        lambda l: F.struct(
            l["section"].alias("section"),
            l["line_idx"].alias("line_idx"),
            l["num"].alias("line_num"),
            l["ann"].alias("ann"),
        ),
    )


def candidate_keys(docs: DataFrame, keys: list[str], sections: list[str] = SECTIONS) -> DataFrame:
    """The same lines as :func:`candidates` without text or context, for counting and drawing."""
    return docs.select(*keys, F.inline(_slim_candidates(sections)))


def label_distribution(lines: DataFrame, key: Column) -> DataFrame:
    """Count and percentage per key, and a row with the total.

    The percentage needs the grand total, taken over the few grouped rows.
    """
    counts = lines.groupBy(key.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    shares = counts.select("label", "n", (F.lit(100.0) * F.col("n") / total.scalar()).alias("pct"))
    return shares.unionByName(
        total.select(F.lit("TOTAL").alias("label"), F.col("total").alias("n"), F.lit(100.0).alias("pct"))
    )
