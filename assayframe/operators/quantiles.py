"""Exact medians per group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.operators.joins import checked_broadcast
from assayframe.sources.scratch import materialize

# Of a mergeable sketch: ranks are off by half a percent, rarely more.
SKETCH_SIZE = 800


def weighted_median(
    counts: DataFrame, keys: Sequence[str], value: str, weight: str, name: str = "median"
) -> DataFrame:
    """Median of ``value`` repeated ``weight`` times, middle values averaged.

    For few distinct values per group, such as missing counts.
    """
    tallies = counts.groupBy(*keys, value).agg(F.sum(weight).alias("_n"))
    return _middle(tallies, keys, value, name)


def exact_median(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str = "median",
    accuracy: int = 2_000,
    alongside: Mapping[str, Column] | None = None,
    margin: float | None = None,
) -> DataFrame:
    """Exact median of the non-null values of each group.

    The built-in exact aggregate holds every distinct value of a group in one
    buffer. Here a mergeable quantile sketch first brackets the middle; the second
    pass collapses everything below the bracket to one count, drops everything
    above, and orders only the bracket, ``2 * margin`` of the group. A group whose
    middle lies outside is taken up again with a wider one. Aggregates given
    ``alongside`` are computed in the first pass over the same rows.
    """
    observed = rows.filter(F.col(value).isNotNull())
    others = alongside or {}
    # The error bound of the sketch, four times.
    start = 4.0 / accuracy if margin is None else margin

    def edges(at: float) -> Column:
        return F.percentile_approx(value, [0.5 - at, 0.5 + at], accuracy)

    first_pass = checked_broadcast(
        observed.groupBy(*keys)
        .agg(
            edges(start).alias("_edges"),
            F.count(value).alias("_total"),
            *[column.alias(label) for label, column in others.items()],
        )
        .select(*keys, *_ends(), "_total", *others)
    )

    def tally(groups: DataFrame | None, at: float) -> DataFrame:
        own, brackets = observed, first_pass.select(*keys, "_lo", "_hi", "_total")
        if groups is not None:
            own = observed.join(checked_broadcast(groups), list(keys), "left_semi")
            wider = own.groupBy(*keys).agg(edges(at).alias("_edges"), F.count(value).alias("_total"))
            brackets = checked_broadcast(wider.select(*keys, *_ends(), "_total"))
        near = (
            own.select(*keys, F.col(value).alias("_v"))
            .join(brackets, list(keys))
            .filter(F.col("_v") <= F.col("_hi"))
        )
        inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")
        return near.groupBy(*keys, "_total", inside).agg(F.count(F.lit(1)).alias("_n"))

    middle = settled(tally, keys, name, start)
    return middle.join(first_pass.select(*keys, *others), list(keys)) if others else middle


def _ends() -> list[Column]:
    return [F.col("_edges")[0].alias("_lo"), F.col("_edges")[1].alias("_hi")]


def settled(
    tally: Callable[[DataFrame | None, float], DataFrame],
    keys: Sequence[str],
    name: str,
    margin: float,
) -> DataFrame:
    """Medians from brackets that are widened until they hold the middle.

    ``tally(groups, margin)`` returns the tallies ``(keys, _total, _v, _n)`` of some
    groups, or of all; a NULL value stands for all rows below the bracket. A bracket
    of half a group to either side is all of it, so that the rounds end.
    """
    groups, done = None, None
    while True:
        found = materialize(_middle(tally(groups, margin), keys, "_v", name, "_total"), "medians")
        inside = found.filter(F.col(name).isNotNull())
        done = inside if done is None else done.unionByName(inside)
        missed = found.filter(F.col(name).isNull()).select(*keys)
        if margin >= 0.5 or missed.isEmpty():
            return done
        groups, margin = missed, min(0.5, 8 * margin)


def merged_median(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    part: str,
    groups: Sequence[int],
    parts: DataFrame,
    name: str = "median",
    margin: float = 0.015,
) -> DataFrame:
    """Exact medians of all parts of ``keys`` but one, for each of ``groups``:
    ``(keys, fit, name)``, where ``fit`` is the part left out, or none of them.

    ``parts`` has the sketches of :func:`part_sketch` with ``_n`` values each:
    ``(keys, _parts: array<struct<part, n, sketch>>)``. Sketches of the parts that count
    are merged, the widest bracket of a key serves all its groups, and only what lies
    inside it is counted for each group.
    """
    fits = F.array(*[F.lit(g) for g in groups])
    by_fit = [*keys, "fit"]
    others = F.filter("_parts", lambda p: p["part"] != F.col("fit"))
    each = (
        parts.select(*keys, "_parts", F.explode(fits).alias("fit"))
        .withColumn("_others", others)
        .filter(F.size("_others") > 0)
        .select(
            *by_fit,
            F.aggregate("_others", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("_total"),
            F.aggregate(
                F.slice("_others", 2, len(groups)),
                F.col("_others")[0]["sketch"],
                lambda sketch, p: F.kll_sketch_merge_double(sketch, p["sketch"]),
            ).alias("_sketch"),
        )
    )
    totals = materialize(each, "sketches")

    def quantile(rank: float) -> Column:
        return F.kll_sketch_get_quantile_double("_sketch", F.lit(rank))

    def tally(missed: DataFrame | None, at: float) -> DataFrame:
        wanted = totals if missed is None else totals.join(missed, by_fit, "left_semi")
        # A key's fits are as many as it has parts.
        brackets = wanted.groupBy(*keys).agg(
            F.min(quantile(max(0.0, 0.5 - at))).alias("_lo"),
            F.max(quantile(min(1.0, 0.5 + at))).alias("_hi"),
            F.collect_list(F.struct("fit", "_total")).alias("_fits"),
        )
        near = (
            rows.filter(F.col(value).isNotNull())
            .select(*keys, F.col(part).alias("_part"), F.col(value).alias("_v"))
            .join(checked_broadcast(brackets), list(keys))
            .filter(F.col("_v") <= F.col("_hi"))
        )
        inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")
        counted = near.groupBy(*keys, "_part", inside).agg(
            F.count(F.lit(1)).alias("_n"), F.first("_fits").alias("_fits")
        )
        return (
            counted.select(*keys, "_part", "_v", "_n", F.inline("_fits"))
            .filter(F.col("fit") != F.col("_part"))
            .groupBy(*by_fit, "_total", "_v")
            .agg(F.sum("_n").alias("_n"))
        )

    return settled(tally, by_fit, name, margin)


def part_sketch(value: str) -> Column:
    """Mergeable sketch of the values of a part."""
    return F.kll_sketch_agg_double(value, F.lit(SKETCH_SIZE))


def _middle(
    tallies: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str,
    total: str | None = None,
) -> DataFrame:
    """Middle of ordered tallies ``(keys, value, _n)``. A NULL value stands for
    all rows below the listed ones."""
    per_group = Window.partitionBy(*keys)
    upto = per_group.orderBy(F.col(value).asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    size = F.col(total) if total else F.sum("_n").over(per_group)
    ranked = tallies.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_size", size)

    def at(position):
        hit = (F.col("_upto") >= position) & (F.col("_upto") - F.col("_n") < position)
        return F.max(F.when(hit, F.col(value)))

    lower = at(F.floor((F.col("_size") + 1) / 2))
    upper = at(F.floor(F.col("_size") / 2) + 1)
    found = ranked.groupBy(*keys).agg(lower.alias("_lower"), upper.alias("_upper"))
    # Without a middle where the bracket missed it.
    middle = (F.col("_lower") + F.col("_upper")) / 2
    return found.select(*keys, middle.alias(name))
