"""Scoring one annotator against another: accuracy, reports, confusion matrices.

The data is read once into counts per (lang, facet, truth, prediction). Every
metric is arithmetic over those few cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.functions import annotation as A
from registrum.functions.names import TASK_CAP, task_cap
from registrum.schemas import FACETS

REGISTER = "core_register"


def facet_pairs(human: Column, llm: Column) -> Column:
    """Array of (facet, truth, prediction) for one task: the four facets and the derived register."""

    def register(labels: Column) -> Column:
        return A.register_for_scoring(labels["mode_medium"], labels["mode_turn"], labels["field_activity"])

    rows = [F.struct(F.lit(f).alias("facet"), human[f].alias("truth"), llm[f].alias("pred")) for f in FACETS]
    rows.append(F.struct(F.lit(REGISTER).alias("facet"), register(human).alias("truth"), register(llm).alias("pred")))
    return F.array(*rows)


def first_tasks(tasks: DataFrame, lang: str, order: list[str], caps: Column | None = None, largest: int | None = None) -> DataFrame:
    """The first tasks of each language, up to its cap: ``caps``, by default those of the published evaluation.

    With ``largest``, the largest of all caps, a rank filter lets every map task drop all but its
    own first rows before the shuffle; the language's own cap follows.
    """
    if caps is None:
        caps, largest = task_cap(F.col(lang)), TASK_CAP
    ranked = tasks.withColumn("task_rank", F.row_number().over(Window.partitionBy(lang).orderBy(*order)))
    if largest is not None:
        ranked = ranked.where(F.col("task_rank") <= largest)
    return ranked.where(F.col("task_rank") <= caps).drop("task_rank")


def confusion_cells(tasks: DataFrame, lang: str = "lang", human: str = "human_labels",
                    llm: str = "llm_labels") -> DataFrame:
    """Counts per (lang, facet, truth, pred) over pairs where both sides have a value."""
    pairs = tasks.select(F.col(lang).alias("lang"), F.inline(facet_pairs(F.col(human), F.col(llm))))
    return (
        pairs.where(F.col("truth").isNotNull() & F.col("pred").isNotNull())
        .groupBy("lang", "facet", "truth", "pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def accuracy(cells: DataFrame, by: list[str]) -> DataFrame:
    hits = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    return cells.groupBy(*by).agg(
        F.sum("n").alias("n"), hits.alias("correct"), (hits.cast("double") / F.sum("n")).alias("accuracy")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def class_report(cells: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives 0."""
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    roles = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), hit.alias("h")),
        F.struct(
            F.col("pred").alias("label"),
            F.lit(0).cast("bigint").alias("t"),
            F.col("n").alias("p"),
            F.lit(0).cast("bigint").alias("h"),
        ),
    )
    counts = (
        cells.select(*by, F.inline(roles))
        .groupBy(*by, "label")
        .agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    )
    return counts.select(
        *by,
        "label",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )


def report_averages(report: DataFrame, by: list[str]) -> DataFrame:
    """Macro and support-weighted averages of a class report."""

    def weighted(name: str) -> Column:
        return F.sum(F.col(name) * F.col("support")) / F.sum("support")

    return report.groupBy(*by).agg(
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[weighted(m).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )


def confusion_matrix(cells: DataFrame, by: list[str]) -> DataFrame:
    """Zero-filled matrix in long form over the sorted union of both sides' labels.

    Cells of one group number at most labels squared, so they fold into one
    row, where the zeros are filled in.
    """
    folded = cells.groupBy(*by, "truth", "pred").agg(F.sum("n").alias("n")).groupBy(*by).agg(
        F.array_sort(F.array_union(F.collect_set("truth"), F.collect_set("pred"))).alias("labels"),
        F.map_from_entries(
            F.collect_list(F.struct(F.struct("truth", "pred").alias("key"), F.col("n").alias("value")))
        ).alias("cells"),
    )
    grid = F.flatten(
        F.transform(
            "labels",
            lambda t: F.transform("labels", lambda p: F.struct(t.alias("truth"), p.alias("pred"))),
        )
    )
    return folded.select(*by, F.explode(grid).alias("cell"), "cells").select(
        *by, "cell.truth", "cell.pred", F.coalesce(F.col("cells")[F.col("cell")], F.lit(0)).alias("n")
    )


def overall_accuracy(cells: DataFrame, truncate: bool = False) -> DataFrame:
    """Accuracy per language over the four facets together.

    ``truncate`` counts ``floor(accuracy * n)`` hits per facet, which can lose
    one to rounding; published figures were made that way.
    """
    facets = accuracy(cells.where(F.col("facet") != REGISTER), ["lang", "facet"])
    hits = F.floor(F.col("accuracy") * F.col("n")) if truncate else F.col("correct")
    return facets.groupBy("lang").agg(
        F.sum("n").alias("n"), (F.sum(hits).cast("double") / F.sum("n")).alias("accuracy")
    )


def pooled_accuracy(cells: DataFrame, truncate: bool = False) -> DataFrame:
    """Mean and population deviation over languages of the overall and the register accuracy."""
    overall = overall_accuracy(cells, truncate).select(F.lit("overall").alias("measure"), "accuracy")
    register = accuracy(cells.where(F.col("facet") == REGISTER), ["lang"]).select(
        F.lit(REGISTER).alias("measure"), "accuracy"
    )
    return overall.unionByName(register).groupBy("measure").agg(
        F.avg("accuracy").alias("mean"),
        F.stddev_pop("accuracy").alias("std"),
        F.count(F.lit(1)).alias("langs"),
    )


def matrix_text(matrix: DataFrame, by: list[str]) -> DataFrame:
    """Confusion matrix as right-aligned text, one row per group."""
    width = F.greatest(F.array_max(F.transform("labels", lambda l: F.length(l))) + 2, F.lit(8))

    def pad(value: Column) -> Column:
        return F.concat(F.repeat(F.lit(" "), F.greatest(F.col("width") - F.length(value), F.lit(0))), value)

    rows = matrix.groupBy(*by, "truth").agg(
        F.array_sort(F.collect_list(F.struct("pred", "n"))).alias("row")
    )
    folded = rows.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("truth", "row"))).alias("rows"),
        F.array_sort(F.collect_set("truth")).alias("labels"),
    )
    header = F.concat(
        F.repeat(F.lit(" "), F.col("width")),
        F.lit("  "),
        F.array_join(F.transform("labels", pad), "  "),
    )
    body = F.transform(
        "rows",
        lambda r: F.concat(
            pad(r["truth"]),
            F.lit("  "),
            F.array_join(F.transform(r["row"], lambda c: pad(c["n"].cast("string"))), "  "),
        ),
    )
    return folded.withColumn("width", width).select(
        *by, F.array_join(F.concat(F.array(header), body), "\n").alias("text")
    )
