"""Agreement between two annotators of the same documents.

Documents meet by address. Each side is reduced to its last document per
address before the join, so a hot address costs one row per map task. The line
comparison happens inside the joined row and leaves only counts to shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.functions import text as T
from registrum.functions.arrays import bind, last_per_key, lookup
from registrum.operators.lines import PAIR, markdown_of
from registrum.schemas import ANNOTATION, FACETS, LINE, SECTIONS
from registrum.session import built_once

COMPARISON = "struct<field:string,v1:string,v2:string>"


def latest_by_url(docs: DataFrame, order: str) -> DataFrame:
    """One document per address, the last in document order; empty addresses are dropped."""
    payload = [c for c in docs.columns if c != "u"]
    return (
        docs.where(F.col("u").isNotNull() & (F.col("u") != ""))
        .groupBy("u")
        .agg(F.max_by(F.struct(*payload), order).alias("doc"))
        .select("u", "doc.*")
    )


def match_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many addresses both sides have, and how many only one. One shuffle of bare addresses."""

    def side(docs: DataFrame, in_left: bool) -> DataFrame:
        return docs.where(F.col("u").isNotNull() & (F.col("u") != "")).select(
            "u", F.lit(in_left).alias("l"), F.lit(not in_left).alias("r")
        )

    flags = side(left, True).unionByName(side(right, False)).groupBy("u").agg(
        F.bool_or("l").alias("l"), F.bool_or("r").alias("r")
    )
    return flags.agg(
        F.count_if(F.col("l") & F.col("r")).alias("matched"),
        F.count_if(F.col("l") & ~F.col("r")).alias("only_first"),
        F.count_if(~F.col("l") & F.col("r")).alias("only_second"),
    )


def matched(left: DataFrame, right: DataFrame, order: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Documents both sides have: address, both annotations, failure flags.

    The first side's text comes along only ``with_text``: counting agreement
    does not need it, and it is most of a document.
    """
    texts = [f"markdown_{s}" for s in SECTIONS] if with_text else []

    def slim(docs: DataFrame, *extra: str) -> DataFrame:
        failed = F.coalesce(F.col("classification_failed"), F.lit(False))
        return docs.select("u", order, F.col(PAIR).alias("ann"), failed.alias("failed"), *extra)

    first = latest_by_url(slim(left, *texts), order)
    second = latest_by_url(slim(right), order)
    return first.select(
        "u",
        F.col("ann").alias("ann1"),
        F.col("failed").alias("failed1"),
        *texts,
    ).join(second.select("u", F.col("ann").alias("ann2"), F.col("failed").alias("failed2")), "u")


@built_once
def _common_lines(section: str) -> Column:
    """Lines both sides annotated; among repeated line numbers the last annotation counts."""
    empty = F.array().cast(f"array<{ANNOTATION}>")
    first = last_per_key(F.coalesce(F.col("ann1")[section], empty), lambda a: a["line"])
    pairs = lookup(
        first,
        lambda a: a["line"],
        F.col("ann2")[section],
        lambda a: a["line"],
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
        ANNOTATION,
        ANNOTATION,
    )
    return F.transform(
        F.filter(pairs, lambda p: p["b"].isNotNull()),
        lambda p: F.struct(
            F.lit(section).alias("section"),
            p["a"]["line"].alias("line"),
            F.array(
                *[
                    F.struct(F.lit(f).alias("field"), p["a"][f].alias("v1"), p["b"][f].alias("v2"))
                    for f in FACETS
                ]
            ).alias("facets"),
        ),
    )


def compared_lines(pairs: DataFrame) -> DataFrame:
    """Long table (u, section, line, facets) of documents neither side failed on."""
    usable = pairs.where(~F.col("failed1") & ~F.col("failed2"))
    return usable.select("u", F.inline(F.concat(*[_common_lines(s) for s in SECTIONS])))


def cells(lines: DataFrame) -> DataFrame:
    """Counts per (field, first value, second value): everything the report needs."""
    return (
        lines.select(F.inline("facets"))
        .groupBy("field", "v1", "v2")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def facet_agreement(counts: DataFrame) -> DataFrame:
    """Agreement per facet; two nulls agree."""
    same = F.col("v1").eqNullSafe(F.col("v2"))
    return counts.groupBy("field").agg(
        F.sum(F.when(same, F.col("n")).otherwise(0)).alias("agree"),
        F.sum(F.when(~same, F.col("n")).otherwise(0)).alias("disagree"),
        (
            F.lit(100.0) * F.sum(F.when(same, F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0))
        ).alias("pct"),
    )


def top_disagreements(counts: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent ordered disagreements per facet; ties by value."""
    order = Window.partitionBy("field").orderBy(
        F.col("n").desc(), F.col("v1").asc_nulls_first(), F.col("v2").asc_nulls_first()
    )
    return (
        counts.where(~F.col("v1").eqNullSafe(F.col("v2")))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def summary(pairs: DataFrame) -> DataFrame:
    """Matched documents, those one side or both failed on, and lines compared."""
    n_lines = sum(
        (F.size(_common_lines(s)) for s in SECTIONS[1:]), start=F.size(_common_lines(SECTIONS[0]))
    )
    both, either = F.col("failed1") & F.col("failed2"), F.col("failed1") | F.col("failed2")
    return pairs.agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(either & ~both).alias("one_failed"),
        F.count_if(both).alias("both_failed"),
        F.coalesce(F.sum(F.when(~either, n_lines)), F.lit(0)).cast("bigint").alias("lines"),
    )


@built_once
def _differing_lines(section: str, limit_chars: int) -> Column:
    """Common lines with a differing facet, with their text in the first document."""
    differing = F.filter(
        F.transform(
            _common_lines(section),
            lambda c: F.struct(
                c["line"].alias("line"),
                F.filter(c["facets"], lambda f: ~f["v1"].eqNullSafe(f["v2"])).alias("facets"),
            ),
        ),
        lambda c: F.size(c["facets"]) > 0,
    )
    return lookup(
        differing,
        lambda c: c["line"],
        T.parse_numbered(markdown_of(section)),
        lambda l: l["num"],
        lambda c, l: F.struct(
            F.lit(section).alias("section"),
            c["line"].alias("line"),
            T.truncate(F.coalesce(l["text"], F.lit("<text not found>")), limit_chars).alias("text"),
            c["facets"].alias("facets"),
        ),
        LINE,
        f"struct<line:int,facets:array<{COMPARISON}>>",
    )


def disagreement_lines(pairs: DataFrame, limit_chars: int = 500) -> DataFrame:
    """One row per line with a disagreement: its text and the differing facets. Needs pairs with text."""
    usable = pairs.where(~F.col("failed1") & ~F.col("failed2"))
    return usable.select("u", F.inline(F.concat(*[_differing_lines(s, limit_chars) for s in SECTIONS])))


def examples(lines: DataFrame, n: int = 20, seed: int | None = None) -> DataFrame:
    """First ``n`` disagreeing lines by address, section and line, or a seeded random draw."""
    place = F.concat_ws("|", "u", "section", F.col("line").cast("string"))
    if seed is None:
        rank = F.when(F.col("section") == "main", 0).otherwise(1)
        return lines.orderBy("u", rank, "line").limit(n)
    return lines.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), place)), place).limit(n)


def render_facets(facets: Column) -> Column:
    """Differing facets as text, ``null`` for a missing value."""
    return F.array_join(
        F.transform(
            facets,
            lambda f: F.concat(
                f["field"],
                F.lit(":"),
                F.coalesce(f["v1"], F.lit("null")),
                F.lit("/"),
                F.coalesce(f["v2"], F.lit("null")),
            ),
        ),
        ";",
    )


def session_agreement(tasks: DataFrame) -> DataFrame:
    """Agreement of one annotator with the prefilled labels: all four facets equal.

    Counts the tasks the annotator touched that carry a label and whose medium is set.
    """
    same = F.lit(True)
    for f in FACETS:
        same = same & F.col("human_labels")[f].eqNullSafe(F.col("llm_labels")[f])
    counted = F.col("touched") & F.col("llm_labels").isNotNull() & F.col("human_labels")["mode_medium"].isNotNull()
    return tasks.agg(
        F.count_if(counted & same).alias("ag"),
        F.count_if(counted & ~same).alias("dis"),
        F.count_if(counted).alias("tot"),
    )
