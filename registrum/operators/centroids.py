"""Register means on factors: confidence intervals, bootstrap, comparison across languages.

One aggregation per language and register gives count, mean and spread. The
within-language normalisation, the cross-language ordering and the intervals
are arithmetic over that small table, so scores are read once.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.96
BOOTSTRAP = 2000
MASK = (1 << 32) - 1

# Point colours and markers, in order of use.
PALETTE = [
    "#e6194b",
    "#3cb44b",
    "#4363d8",
    "#f58231",
    "#911eb4",
    "#42d4f4",
    "#f032e6",
    "#9A6324",
    "#469990",
    "#800000",
    "#808000",
    "#000075",
    "#a9a9a9",
    "#000000",
    "#dcbeff",
]
MARKERS = ["o", "s", "^", "D", "v", "P", "X", "*", "h", "<", ">", "p"]


def factor_names(columns: list[str]) -> list[str]:
    """Factor columns in text order."""
    return sorted(c for c in columns if c.startswith("F"))


def parse_pairs(pairs: list[str], columns: list[str] = []) -> list[tuple[str, str]]:
    """``["1,2"]`` or ``["all"]`` to factor pairs; ``all`` combines the given columns."""
    if "all" in pairs:
        return list(combinations(factor_names(columns), 2))
    out = []
    for text in pairs:
        parts = text.split(",")
        if len(parts) != 2:
            raise ValueError(f"bad pair: {text!r}")
        out.append(tuple(p if p.startswith("F") else f"F{p}" for p in parts))
    return out


def shared_factors(column_lists: list[list[str]]) -> list[str]:
    """Factors every table has."""
    sets = [set(factor_names(c)) for c in column_lists]
    return sorted(set.intersection(*sets)) if sets else []


def centroids(scores: DataFrame, by: list[str], factors: list[str], min_n: int = 1) -> DataFrame:
    """Mean and normal 95% interval of each factor per group. A single row has no interval.

    Combined views across languages use ``min_n=2``.
    """
    aggregates = [F.count(F.lit(1)).alias("n")]
    for f in factors:
        aggregates += [F.avg(f).alias(f"_mean_{f}"), F.stddev_samp(f).alias(f"_sd_{f}")]
    grouped = scores.groupBy(*by).agg(*aggregates).where(F.col("n") >= min_n)
    columns = []
    for f in factors:
        half = Z95 * F.col(f"_sd_{f}") / F.sqrt("n")
        columns += [
            F.col(f"_mean_{f}").alias(f"mean_{f}"),
            (F.col(f"_mean_{f}") - half).alias(f"lo_{f}"),
            (F.col(f"_mean_{f}") + half).alias(f"hi_{f}"),
        ]
    return grouped.select(*by, "n", *columns)


def styled(points: DataFrame, label: str = "label", lang: str | None = None) -> DataFrame:
    """Colour per register in name order and, with several languages, a marker per language."""

    def pick(values: list[str], column: str) -> Column:
        rank = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(column)) - 1
        return F.array(*[F.lit(v) for v in values])[rank % len(values)]

    out = points.withColumn("colour", pick(PALETTE, label))
    return out.withColumn("marker", pick(MARKERS, lang) if lang else F.lit(MARKERS[0]))


def register_moments(scores: DataFrame, value: str, lang: str = "lang", label: str = "label") -> DataFrame:
    """Count, mean and sum of squared deviations per language and register."""
    return scores.groupBy(F.col(lang).alias("lang"), F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(F.lit(1))).alias("m2"),
    )


def register_means(moments: DataFrame, normalise: bool) -> DataFrame:
    """Mean and 95% interval per language and register, of raw or within-language z scores.

    z scoring is linear, so a register's z mean follows from its own moments
    and its language's, and those combine from the registers. A language
    without variance drops out. A single row has an interval of width zero.
    """
    table = moments
    if normalise:
        lang = Window.partitionBy("lang")
        total = F.sum("n").over(lang)
        centre = F.sum(F.col("n") * F.col("mean")).over(lang) / total
        table = table.withColumn("_total", total).withColumn("_centre", centre)
        spread = F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_centre"), 2)).over(lang)
        table = (
            table.withColumn("_sd", F.sqrt(spread / F.nullif(F.col("_total") - 1, F.lit(0))))
            .where(F.col("_sd") > 0)
            .withColumn("mean", (F.col("mean") - F.col("_centre")) / F.col("_sd"))
            .withColumn("m2", F.col("m2") / (F.col("_sd") * F.col("_sd")))
        )
    error = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / F.nullif(F.col("n") - 1, F.lit(0))) / F.sqrt("n")).otherwise(0.0)
    return table.withColumn("_se", error).select(
        "lang",
        "label",
        "n",
        "mean",
        (F.col("mean") - Z95 * F.col("_se")).alias("ci_lo"),
        (F.col("mean") + Z95 * F.col("_se")).alias("ci_hi"),
    )


def register_order(means: DataFrame, sort_by: str | None = None) -> DataFrame:
    """Position of each register: by one language's means, or by the mean over languages."""
    if sort_by is None:
        values = means.groupBy("label").agg(F.avg("mean").alias("key"))
    else:
        has = means.where(F.col("lang") == sort_by).limit(1).count() > 0
        if not has:
            return register_order(means)
        values = means.where(F.col("lang") == sort_by).select("label", F.col("mean").alias("key"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key", "label"))
    return values.select("label", (rank - 1).alias("position"))


def dimension(scores: DataFrame, factor: str, normalise: bool, sort_by: str | None = None) -> DataFrame:
    """Register means of every language in plotting order; registers outside the order drop out."""
    means = register_means(register_moments(scores, factor), normalise)
    return means.join(register_order(means, sort_by), "label")


def scattered(df: DataFrame, column: str) -> DataFrame:
    """A fixed one-to-one scattering of 32-bit numbers, in 64-bit arithmetic that cannot overflow.

    Step by step in columns of their own: each number is used twice, so one expression would double at every step.
    """
    at = F.col(column)
    for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
        df = df.withColumn(column, at.bitwiseXOR(F.shiftright(at, shift)))
        df = df.withColumn(column, (at * F.lit(factor).cast("long")).bitwiseAND(F.lit(MASK).cast("long")))
    return df.withColumn(column, at.bitwiseXOR(F.shiftright(at, 15)))


def with_key_words(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with two 32-bit numbers of their key, ``_first`` and ``_second``."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key]))
    return rows.withColumns({name: F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for name, at in (("_first", 1), ("_second", 9))})


def poisson_limits() -> list[int]:
    """Where each further count begins: the distribution function of the Poisson law of mean 1, times 2 ** 32."""
    out, term, total, k = [], math.exp(-1), 0.0, 0
    while (limit := int((total := total + term) * (MASK + 1))) <= MASK and k < 12:
        out.append(limit)
        k += 1
        term /= k
    return out


def resampled(rows: DataFrame, replicate: Column, weight: str, seed: int) -> DataFrame:
    """Rows with key words, and how often each is in a resample: a Poisson count of mean 1 that key and replicate alone determine."""
    counter = (replicate.cast("long") * 0x1F123BB5 + seed).bitwiseAND(F.lit(MASK).cast("long"))
    out = scattered(rows.withColumn(weight, counter), weight)
    out = scattered(out.withColumn(weight, F.col(weight).bitwiseXOR(F.col("_first"))), weight)
    out = scattered(out.withColumn(weight, F.col(weight).bitwiseXOR(F.col("_second"))), weight)
    limits = poisson_limits()
    count = F.when(F.col(weight) < limits[0], 0)
    for k, limit in enumerate(limits[1:], 1):
        count = count.when(F.col(weight) < limit, k)
    return out.withColumn(weight, count.otherwise(len(limits)))


def bootstrap(values: DataFrame, by: list[str], value: str, key: list[str], n_boot: int = BOOTSTRAP, ci: float = 95,
              seed: int = 0) -> DataFrame:
    """Percentile interval of the mean per group, over ``n_boot`` Poisson resamples.

    Each row is in a resample as often as a count of mean 1 says that its key and the
    resample's number determine, so the outcome is the same in any partitioning, and a resample is a
    sum that is aggregated where the rows are: only sums per group and
    resample are shuffled. Resamples without any row of a group have no mean there. Rows without a value are left out.
    """
    rows = values.where(F.col(value).isNotNull()).select(*by, *[c for c in key if c not in by], F.col(value).cast("double").alias("_value"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    drawn = with_key_words(rows, key).withColumn("_rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_boot - 1).cast("long"))))
    drawn = resampled(drawn, F.col("_rep"), "_weight", seed)
    sums = drawn.groupBy(*by, "_rep").agg(F.sum("_weight").alias("_n"), F.sum(F.col("_weight") * F.col("_value")).alias("_total"))
    mean, tail = F.when(F.col("_n") > 0, F.col("_total") / F.col("_n")), (100 - ci) / 200
    found = sums.groupBy(*by).agg(F.percentile(mean, F.lit(tail)).alias("lo"), F.percentile(mean, F.lit(1 - tail)).alias("hi"))
    return sizes.join(found, by).select(*by, "n", "lo", "hi")
