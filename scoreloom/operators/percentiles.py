"""Exact percentiles of groups of any size.

Spark's exact percentile keeps every distinct value of a group in one buffer,
which a group holding a third of a large table does not fit. Here a first scan
sketches each group on a fixed grid of fractions and brackets every wanted rank
between two grid values; a second counts what lies below each bracket and the copies
of every distinct value inside it. Where few values stand many times a bracket holds
many rows, but as one value each. Brackets with too many distinct values are
cut and narrowed again. Ranks are read off exact counts, so the sketch decides how
much work is left and never the answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.session import settle, small_side

ACCURACY = 10_000
# Fractions 0, 1/GRID, ... 1 that are sketched.
GRID = 1000
# In a group of up to this many values a step of the grid is a few ranks: all of it is kept.
WHOLE = 5_000
# Distinct values of a group and percentile that one task may put in order.
KEPT = 500_000


@dataclass(frozen=True)
class Percentile:
    """One wanted output: percentile p (0..1) of a numeric column."""

    name: str
    column: str
    p: float


def _grid(column: str, accuracy: int) -> str:
    fractions = ", ".join(f"{i / GRID}D" for i in range(GRID + 1))
    return f"CAST(percentile_approx({column}, array({fractions}), {accuracy}) AS array<double>)"


def _bracket(grid: str, n: str, first: str, last: str, accuracy: int) -> tuple[str, str]:
    """Grid values surely at or below the value of rank `first`, and at or above that of `last`."""
    margin = -(-GRID // accuracy) + 1
    low = f"CAST(floor({first} * {GRID}D / greatest({n}, 1)) AS INT) - {margin}"
    high = f"CAST(ceil(({last} + 1) * {GRID}D / greatest({n}, 1)) AS INT) + {margin}"
    whole = f"{n} <= {WHOLE}"
    return (
        f"IF({whole} OR {low} < 0, CAST('-Infinity' AS DOUBLE), get({grid}, {low}))",
        f"IF({whole} OR {high} > {GRID}, CAST('NaN' AS DOUBLE), get({grid}, {high}))",
    )


def _counted(df: DataFrame, group: Column, ends: DataFrame, wanted: Sequence[Percentile]) -> DataFrame:
    """(_gid, want, value, copies): distinct values inside each bracket, and under NULL how many lie below it.

    One pass: every task adds up its own rows first, so a value that stands many times, and all
    that lies below a bracket, leave the task as one row.
    """
    told = []
    for i, w in enumerate(wanted):
        value = f"CAST(`{w.column}` AS DOUBLE)"
        told.append(
            f"IF({value} <= `_high_{i}`, struct({i} AS want, IF({value} >= `_low_{i}`, {value}, NULL) AS value), NULL)"
        )
    columns = list(dict.fromkeys(w.column for w in wanted))
    rows = df.select(group, *columns).join(small_side(ends), "_group")
    return (
        rows.selectExpr("_gid", f"inline(array({', '.join(told)}))")
        .where("want IS NOT NULL")
        .groupBy("_gid", "want", "value")
        .agg(F.count("*").alias("copies"))
    )


def _largest(values: DataFrame, kept: int) -> int:
    """Distinct values of the largest target; where all targets together have no more than `kept`, their sum will do."""
    total = values.count()
    if total <= kept:
        return total
    return values.groupBy("_gid", "want").count().agg(F.max("count")).first()[0] or 0


def _narrowed(values: DataFrame, targets: DataFrame, accuracy: int) -> tuple[DataFrame, DataFrame]:
    """Only the values near the wanted ranks, and ranks that skip more.

    Distinct values are cut into GRID parts by a sketch; the rows in each part are added up, and of
    all parts those go on in which a wanted rank lies.
    """
    key = ["_gid", "want"]
    cuts = settle(values.groupBy(*key).agg(F.expr(f"{_grid('value', accuracy)} AS grid")))
    placed = values.join(cuts, key).selectExpr(*key, "value", "copies", "size(filter(grid, g -> g < value)) AS part")
    upto = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy(*key, "part").agg(F.sum("copies").alias("held")).withColumn("past", F.sum("held").over(upto))
    holds = F.struct("part", (F.col("past") - F.col("held")).alias("before"))
    ends = settle(
        parts.join(targets, key)
        .groupBy(*key, "first", "last", "skip")
        .agg(
            F.min(F.when(F.col("past") + F.col("skip") > F.col("first"), holds)).alias("from"),
            F.min(F.when(F.col("past") + F.col("skip") > F.col("last"), F.col("part"))).alias("to"),
        )
    )
    left = placed.join(ends, key).where("part BETWEEN from.part AND to").select(*key, "value", "copies")
    return settle(left), ends.selectExpr(*key, "first", "last", "skip + from.before AS skip")


def ranked_values(values: DataFrame, targets: DataFrame, accuracy: int = ACCURACY, kept: int = KEPT) -> DataFrame:
    """(_gid, want, low, high): the values at ranks `first` and `last` (from 0) of every target.

    values are (_gid, want, value, copies) with distinct values; targets are (_gid, want, first,
    last, skip), skip being how many rows lie below all the values given. Targets of more than `kept`
    distinct values are narrowed first, so none is put in order whole.
    """
    largest = _largest(values, kept)
    while largest > kept:
        values, targets = _narrowed(values, targets, accuracy)
        left = _largest(values, kept)
        if left >= largest:
            break
        largest = left
    upto = Window.partitionBy("_gid", "want").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        values.withColumn("past", F.sum("copies").over(upto))
        .join(targets, ["_gid", "want"])
        .groupBy("_gid", "want")
        .agg(
            F.min(F.when(F.col("past") + F.col("skip") > F.col("first"), F.col("value"))).alias("low"),
            F.min(F.when(F.col("past") + F.col("skip") > F.col("last"), F.col("value"))).alias("high"),
        )
    )


def _ranks(wanted: Sequence[Percentile]) -> str:
    """SQL array of every wanted percentile with its ranks, from `_n_<column>`."""
    ranks = []
    for i, w in enumerate(wanted):
        n = f"`_n_{w.column}`"
        position = f"({w.p}D * ({n} - 1))"
        ranks.append(
            f"struct({i} AS want, {n} AS n, CAST(floor{position} AS BIGINT) AS first, CAST(ceil{position} AS BIGINT) AS last)"
        )
    return f"array({', '.join(ranks)})"


def percentile_columns(stats: DataFrame, found: DataFrame, wanted: Sequence[Percentile], interpolate: bool = True) -> DataFrame:
    """stats (with _gid and `_n_<column>`) and a column for each percentile from :func:`ranked_values`."""
    by_want = found.groupBy("_gid").agg(
        *(
            F.max(F.when(F.col("want") == i, F.struct("low", "high"))).alias(f"_found_{i}")
            for i in range(len(wanted))
        )
    )
    outputs = []
    for i, w in enumerate(wanted):
        low, high, n = f"`_found_{i}`.low", f"`_found_{i}`.high", f"`_n_{w.column}`"
        position = f"({w.p}D * ({n} - 1))"
        value = f"{low} + ({high} - {low}) * ({position} - floor{position})" if interpolate else low
        # A rank outside its bracket would mean that the sketch broke its error bound.
        outputs.append(
            F.expr(
                f"CASE WHEN {n} > 0 AND ({value}) IS NULL "
                f"THEN raise_error('rank of {w.name} is outside its bracket') ELSE {value} END AS `{w.name}`"
            )
        )
    return stats.join(by_want, "_gid", "left").select(stats["*"], *outputs)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Sequence[Percentile],
    extra: Sequence[Column] = (),
    interpolate: bool = True,
    accuracy: int = ACCURACY,
    kept: int = KEPT,
) -> DataFrame:
    """One row per group: keys, the extra aggregates, and every wanted percentile.

    interpolate=True is the continuous percentile; False takes the value at rank
    floor(p * (n - 1)). NULLs are ignored; a group without values gets NULL.
    """
    keys = list(keys)
    columns = list(dict.fromkeys(w.column for w in wanted))
    group = (F.struct(*keys) if keys else F.lit(0)).alias("_group")
    sketches = [
        F.expr(e)
        for c in columns
        for e in (f"count(`{c}`) AS `_n_{c}`", f"{_grid(f'`{c}`', accuracy)} AS `_grid_{c}`")
    ]
    stats = settle(df.groupBy(group).agg(*extra, *sketches).withColumn("_gid", F.monotonically_increasing_id()))

    brackets = []
    for index, w in enumerate(wanted):
        n = f"`_n_{w.column}`"
        position = f"({w.p}D * ({n} - 1))"
        first, last = f"CAST(floor{position} AS BIGINT)", f"CAST(ceil{position} AS BIGINT)"
        low, high = _bracket(f"`_grid_{w.column}`", n, first, last, accuracy)
        brackets += [f"{low} AS `_low_{index}`", f"{high} AS `_high_{index}`"]
    counted = settle(_counted(df, group, stats.selectExpr("_group", "_gid", *brackets), wanted))
    targets = (
        stats.selectExpr("_gid", f"inline({_ranks(wanted)})")
        .where("n > 0")
        .join(counted.where("value IS NULL").select("_gid", "want", F.col("copies").alias("skip")), ["_gid", "want"], "left")
        .select("_gid", "want", "first", "last", F.coalesce("skip", F.lit(0)).alias("skip"))
    )
    found = ranked_values(counted.where("value IS NOT NULL"), targets, accuracy, kept)
    hidden = {"_group", "_gid", *(f"_n_{c}" for c in columns), *(f"_grid_{c}" for c in columns)}
    plain = stats.drop(*(f"_grid_{c}" for c in columns))
    names = [F.col("_group")[k].alias(k) for k in keys]
    extras = [c for c in stats.columns if c not in hidden]
    return percentile_columns(plain, found, wanted, interpolate).select(*names, *extras, *(w.name for w in wanted))


def approximate_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Sequence[Percentile],
    extra: Sequence[Column] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One scan, rank error at most 1/accuracy; for dashboards that may be off by that much."""
    sketched = [F.percentile_approx(w.column, w.p, accuracy).alias(w.name) for w in wanted]
    return df.groupBy(*keys).agg(*extra, *sketched)
