"""Random and stratified draws of lines for human labelling.

The draw is by a seeded hash of the line's key: the same on every run and every
partitioning. Drawing works on keys alone; text and context are fetched for the
drawn lines afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registrum.functions import annotation as A
from registrum.operators.lines import candidate_keys, candidates
from registrum.schemas import FACETS, LABELS, SECTIONS

KEY = ["section", "line_idx"]
# Leading hex digits of the draw order by which lines are counted before any is moved.
DIGITS = 4


def draw_order(seed: int, doc_key: str = "doc_id") -> Column:
    """Seeded hash that orders lines at random."""
    place = F.concat_ws("|", F.lit(str(seed)), F.col(doc_key).cast("string"), "section", F.col("line_idx").cast("string"))
    return F.md5(place)


def first_drawn(keyed: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Rows that can be among the first ``n`` of their group in draw order, at any ``n``.

    Rows are counted per group and leading digits of the hash (a partial aggregate), a
    running sum finds the digits at which ``n`` is reached, and rows beyond them stay where
    they are. So a group passes on ``n`` rows and at most one more slice of the hash.
    """
    slice_ = F.substring("draw", 1, DIGITS)
    counted = keyed.groupBy(*by, slice_.alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("_n").over(order.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    wanted = counted.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < n).select(*by, "_slice")
    return keyed.withColumn("_slice", slice_).join(wanted, [*by, "_slice"], "left_semi").drop("_slice")


def simple_sample(keys: DataFrame, n: int = 500, seed: int = 42, doc_key: str = "doc_id") -> DataFrame:
    """``n`` lines without replacement (all when fewer), numbered in draw order."""
    keyed = first_drawn(keys.withColumn("draw", draw_order(seed, doc_key)), n, [])
    drawn = keyed.orderBy("draw", doc_key, *KEY).limit(n)
    return _number(drawn, ["draw", doc_key, *KEY])


def _number(drawn: DataFrame, order: list[str]) -> DataFrame:
    """Task numbers from 0. The draw has at most ``n`` rows, so one window partition holds it."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return drawn.withColumn("task_id", (rank - 1).cast("bigint"))


def allocate(sizes: list[tuple[str, int]], n: int, floor: int, order: list[str]) -> dict[str, int]:
    """Sample size per stratum.

    Each stratum gets ``floor`` (or all it has). Floors beyond the budget are
    scaled down, at least one each. The rest of the budget goes out in
    proportion to what the strata have left, in up to three rounds; what
    rounding leaves over goes one each in the given random ``order``.
    """
    size = dict(sizes)
    share = {k: min(floor, m) for k, m in size.items()}
    budget = n - sum(share.values())
    if budget < 0:
        floors = sum(share.values())
        return {k: max(1, round(v * n / floors)) for k, v in share.items()}
    for _ in range(3):
        room = {k: size[k] - share[k] for k in size if size[k] > share[k]}
        available = sum(room.values())
        if budget <= 0 or available <= 0:
            break
        wanted = {k: budget * (r / available) for k, r in room.items()}
        given = {k: min(int(w), room[k]) for k, w in wanted.items()}
        for k, g in given.items():
            share[k] += g
        budget = round(sum(wanted[k] - given[k] for k in wanted))
    for k in order:
        if budget <= 0:
            break
        if size[k] > share[k]:
            share[k] += 1
            budget -= 1
    return share


def allocations(strata: DataFrame, n: int, floor: int, seed: int) -> DataFrame:
    """(stratum, size) to (stratum, size, alloc). There is one row per label pair, so one task plans it."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values("stratum")
        if len(rows):
            order = list(rows.sort_values(["draw", "stratum"])["stratum"])
            share = allocate(list(zip(rows["stratum"], rows["size"].astype(int))), n, floor, order)
            rows = rows.assign(alloc=[share[s] for s in rows["stratum"]])
            yield rows[["stratum", "size", "alloc"]]

    keyed = strata.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}|"), F.col("stratum"))))
    return keyed.coalesce(1).mapInPandas(plan, "stratum string, size bigint, alloc bigint")


def stratified_sample(keys: DataFrame, n: int = 500, floor: int = 5, seed: int = 42,
                      doc_key: str = "doc_id") -> DataFrame:
    """Draw with a guaranteed floor per stratum and proportional shares above it.

    No stratum can get more than ``n`` lines (or one, whichever is more), so only
    lines that can be among a stratum's first ``n`` are moved and ranked.
    """
    keyed = keys.withColumn("stratum", A.stratum_key(F.col("ann"))).withColumn("draw", draw_order(seed, doc_key))
    strata = keyed.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    plan = allocations(strata, n, floor, seed)
    order = ["draw", doc_key, *KEY]
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(*order))
    firsts = first_drawn(keyed, max(n, 1), ["stratum"]).withColumn("rank", rank).where(F.col("rank") <= max(n, 1))
    drawn = firsts.join(plan, "stratum").where(F.col("rank") <= F.col("alloc"))
    shuffled = drawn.withColumn("shuffle", F.md5(F.concat(F.lit("order|"), F.col("draw"))))
    return _number(shuffled.drop("size", "alloc", "rank"), ["shuffle", doc_key, *KEY]).drop("shuffle")


def sample_tasks(docs: DataFrame, drawn: DataFrame, n: int, doc_key: str = "doc_id", sections: list[str] = SECTIONS,
                 limit_chars: int = 500, context: int = 5) -> DataFrame:
    """Drawn keys to annotation tasks with text, context and labels.

    Only documents with a drawn line are expanded.
    """
    keys = drawn.select(doc_key, *KEY, "task_id")
    number = ["doc_idx"] if doc_key != "doc_idx" and "doc_idx" in docs.columns else []
    hit = docs.join(keys.select(doc_key).distinct(), doc_key, "left_semi")
    rows = candidates(hit, [doc_key, *number, "u"], sections, context, limit_chars)
    labels = F.when(F.col("ann").isNotNull(), F.struct(*[F.col("ann")[f].alias(f) for f in FACETS]).cast(LABELS))
    return rows.join(keys, [doc_key, *KEY]).select(
        "task_id",
        F.col(number[0] if number else doc_key).alias("doc_idx"),
        "section",
        F.coalesce("u", F.lit("")).alias("url"),
        "line_idx",
        "line_num",
        "line_text",
        "context_before",
        "context_after",
        labels.alias("llm"),
    )


def sample_documents(docs: DataFrame, n: int = 500, seed: int = 42, stratified: bool = False, floor: int = 5,
                     sections: list[str] = SECTIONS, doc_key: str = "doc_id") -> DataFrame:
    """Annotated documents to sampled annotation tasks."""
    keys = candidate_keys(docs, [doc_key], sections)
    drawn = (
        stratified_sample(keys, n, floor, seed, doc_key) if stratified else simple_sample(keys, n, seed, doc_key)
    )
    return sample_tasks(docs, drawn, n, doc_key, sections)
