"""Array algorithms inside one row.

A document, its lines, its annotations and its tokens arrive in one record, so
everything that relates them (line to label lookup, run merging, tag counting,
moving type-token ratios) is written over arrays of that record. Nothing is
exploded and nothing is shuffled. Each helper is linear or n log n in the
record's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Key = Callable[[Column], Column]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    Inside a lambda an outer expression would be evaluated again per element;
    a one-element array carries the computed value instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(array: Column) -> Column:
    """0-based positions of an array; empty for an empty or null array."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def _spans(array: Column, starts: Column, make: Callable[[Column], Column]) -> Column:
    def one(begin: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(array))
        return make(F.slice(array, begin + 1, end - begin))

    return F.transform(starts, one)


def map_runs(array: Column, key: Key, make: Callable[[Column], Column]) -> Column:
    """Cut ``array`` where ``key`` changes and map every run through ``make``."""

    def body(items: Column) -> Column:
        starts = F.filter(
            positions(items),
            lambda i: (i == 0) | ~key(F.get(items, i)).eqNullSafe(key(F.get(items, i - 1))),
        )
        return bind(starts, lambda s: _spans(items, s, make))

    return bind(array, body)


def last(array: Column) -> Column:
    """Last element, null when empty."""
    return F.get(array, F.size(array) - 1)


def last_per_key(entries: Column, key: Key) -> Column:
    """One entry per key, the one that came last, in key order. Null keys are dropped."""
    tagged = F.filter(
        F.transform(entries, lambda e, i: F.struct(key(e).alias("k"), i.alias("pos"), e.alias("entry"))),
        lambda t: t["k"].isNotNull(),
    )
    return map_runs(F.sort_array(tagged), lambda t: t["k"], lambda run: last(run)["entry"])


def lookup(
    items: Column,
    item_key: Key,
    entries: Column,
    entry_key: Key,
    combine: Callable[[Column, Column], Column],
    entry_type: str,
    item_type: str,
) -> Column:
    """Left outer join of two arrays of one row; among equal entry keys the last wins.

    ``combine(item, entry_or_null)`` builds the output, in item order. Entries
    that already line up one to one with the items (what the labelling stage
    writes) are zipped; anything else goes through a sort and a pass over the
    runs of equal keys.
    """

    def joined(its: Column, ents: Column) -> Column:
        item_keys = F.transform(its, item_key)
        aligned = (item_keys == F.transform(ents, entry_key)) & (
            F.size(F.array_distinct(item_keys)) == F.size(its)
        )
        left = F.transform(
            its,
            lambda x, i: F.struct(
                item_key(x).alias("k"),
                F.lit(1).alias("side"),
                i.alias("pos"),
                x.alias("item"),
                F.lit(None).cast(entry_type).alias("entry"),
            ),
        )
        right = F.transform(
            F.filter(ents, lambda e: entry_key(e).isNotNull()),
            lambda e, i: F.struct(
                entry_key(e).alias("k"),
                F.lit(0).alias("side"),
                i.alias("pos"),
                F.lit(None).cast(item_type).alias("item"),
                e.alias("entry"),
            ),
        )

        def pair(run: Column) -> Column:
            entry = last(F.filter(run, lambda r: r["side"] == 0))["entry"]
            return bind(
                F.struct(entry.alias("entry")),
                lambda e: F.transform(
                    F.filter(run, lambda r: r["side"] == 1),
                    lambda r: F.struct(r["pos"].alias("pos"), r["item"].alias("item"), e["entry"].alias("entry")),
                ),
            )

        merged = F.flatten(map_runs(F.sort_array(F.concat(right, left)), lambda r: r["k"], pair))
        slow = F.transform(F.sort_array(merged), lambda r: combine(r["item"], r["entry"]))
        return F.when(aligned, F.zip_with(its, ents, combine)).otherwise(slow)

    empty = F.array().cast(f"array<{entry_type}>")
    return bind(
        F.struct(items.alias("i"), F.coalesce(entries, empty).alias("e")),
        lambda p: joined(p["i"], p["e"]),
    )


def run_lengths(array: Column) -> Column:
    """Distinct values with their counts, in value order."""
    return map_runs(
        F.sort_array(array),
        lambda x: x,
        lambda run: F.struct(F.get(run, F.lit(0)).alias("value"), F.size(run).alias("n")),
    )


def sum_per_value(entries: Column) -> Column:
    """(value, n) entries with the counts of equal values added up, in value order."""
    return map_runs(
        F.sort_array(entries),
        lambda e: e["value"],
        lambda run: F.struct(
            F.get(run, F.lit(0))["value"].alias("value"), total(F.transform(run, lambda e: e["n"]), "int").alias("n")
        ),
    )


def align_counts(counts: Column, vocabulary: Column) -> Column:
    """Counts of each vocabulary entry, in the (sorted) vocabulary's order.

    ``counts`` holds (value, n) once per value. One sort of both together: an
    entry's run starts with its vocabulary marker, so values outside the
    vocabulary are runs without one.
    """
    marked = F.concat(
        F.transform(vocabulary, lambda v: F.struct(v.alias("v"), F.lit(0).alias("m"), F.lit(0).alias("n"))),
        F.transform(counts, lambda c: F.struct(c["value"].alias("v"), F.lit(1).alias("m"), c["n"].alias("n"))),
    )
    runs = map_runs(
        F.sort_array(marked),
        lambda t: t["v"],
        lambda run: F.when(F.get(run, F.lit(0))["m"] == 0, last(run)["n"]),
    )
    return F.filter(runs, lambda n: n.isNotNull())


def total(array: Column, type_name: str = "bigint") -> Column:
    """Sum of the elements, 0 when empty."""
    zero = F.lit(0).cast(type_name)
    return F.aggregate(array, zero, lambda acc, x: acc + x.cast(type_name))


def moving_ttr(tokens: Column, window: int) -> Column:
    """Moving-average type-token ratio.

    The number of types in a window is the number of tokens whose previous
    occurrence lies before the window's start. Summed over all windows, the
    token at position i counts once for every start in
    ``[max(previous + 1, i - window + 1, 0), min(i, n - window)]``, so one sort
    by (type, position) gives the exact total without visiting any window.
    Texts shorter than the window fall back to the plain ratio, empty ones to 0.
    """

    def covered(pos: Column, previous: Column, size: Column) -> Column:
        low = F.greatest(previous + 1, pos - (window - 1), F.lit(0))
        high = F.least(pos, size - window)
        return F.greatest(high - low + 1, F.lit(0))

    def body(toks: Column) -> Column:
        size = F.size(toks)
        order = F.sort_array(F.transform(toks, lambda t, i: F.struct(t.alias("t"), i.alias("pos"))))

        def sum_of_types(sorted_tokens: Column) -> Column:
            per_token = F.transform(
                sorted_tokens,
                lambda x, k: covered(
                    x["pos"],
                    F.when(
                        (k > 0) & (F.get(sorted_tokens, k - 1)["t"] == x["t"]),
                        F.get(sorted_tokens, k - 1)["pos"],
                    ).otherwise(F.lit(-1)),
                    size,
                ),
            )
            return total(per_token)

        windows = bind(order, sum_of_types).cast("double") / F.lit(float(window))
        return (
            F.when(size == 0, F.lit(0.0))
            .when(size < window, F.size(F.array_distinct(toks)).cast("double") / size)
            .otherwise(windows / (size - (window - 1)))
        )

    return bind(tokens, body)
