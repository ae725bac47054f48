"""Comparison of portfolio snapshots and filings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, stored

from ..functions.numbers import half_up
from ..functions.texts import issuer_key


def matched(before: DataFrame, after: DataFrame, group: list[str], strong: str, weak: str) -> DataFrame:
    """Pairs of rows of two snapshots, by a strong key where both have it, then by a weak one; unmatched rows of
    either side stay alone. Each row is in one pair. Columns of before get the suffix _from, of after _to.
    Keys are unique in a snapshot; group names the comparison."""
    a = before.select(*group, *(F.col(c).alias(f"{c}_from") for c in before.columns if c not in group), F.lit(True).alias("_a"))
    b = after.select(*group, *(F.col(c).alias(f"{c}_to") for c in after.columns if c not in group), F.lit(True).alias("_b"))
    ka, kb = (x.withColumn("_k", F.col(c)).filter("_k is not null") for x, c in ((a, f"{strong}_from"), (b, f"{strong}_to")))
    met = stored(kb.join(ka, [*group, "_k"], "full").drop("_k"))  # read three times: pairs, and what is left of either side
    left_b = met.filter("_a is null").select(*b.columns).unionByName(b.filter(F.col(f"{strong}_to").isNull()))
    left_a = met.filter("_b is null").select(*a.columns).unionByName(a.filter(F.col(f"{strong}_from").isNull()))
    rest = left_b.withColumn("_k", F.col(f"{weak}_to")).join(left_a.withColumn("_k", F.col(f"{weak}_from")), [*group, "_k"], "full")
    return met.filter("_a and _b").drop("_a", "_b").unionByName(rest.drop("_k", "_a", "_b"))


def changes(pairs: DataFrame, units_from: Column, units_to: Column) -> DataFrame:
    """Share changes of paired rows: moves under half a share, and moves in proportion to the fund's units, are none."""
    old, new = F.coalesce("shares_from", F.lit(0.0)), F.coalesce("shares_to", F.lit(0.0))
    delta = new - old
    flowed = F.col("shares_from").isNotNull() & F.col("shares_to").isNotNull() & F.coalesce((units_from > 0) & (units_to > 0) & (units_from != units_to), F.lit(False))
    expected = F.when(flowed, old * units_to / units_from)
    proportional = F.coalesce(F.abs(new - expected) <= F.greatest(F.lit(0.5), F.abs(delta) * 0.005), F.lit(False))
    price = F.coalesce(F.when(F.col("shares_to") != 0, F.col("mv_to") / F.col("shares_to")), F.when(F.col("shares_from") != 0, F.col("mv_from") / F.col("shares_from")), F.lit(0.0))
    kind = F.when(F.col("shares_from").isNull(), "NEW").when(F.col("shares_to").isNull(), "SOLD OUT").when(delta > 0, "INCREASE").otherwise("DECREASE")
    return pairs.withColumn("delta", delta).withColumn("expected", expected).withColumn("kind", kind).withColumn("value", F.abs(delta) * price).filter((F.abs(delta) >= 0.5) & ~proportional)


def small_13f(shares: Column, value: Column) -> Column:
    return (shares < 10_000) & (value < 200_000)


def filing_change(shares: Column, value: Column, shares_before: Column, value_before: Column) -> Column:
    """What a quarterly filing's row tells against the quarter before."""
    return (
        F.when(shares_before.isNull(), F.when((shares > 0) & small_13f(shares, value), "first reported").otherwise("new"))
        .when((shares == 0) | (shares.isNull() & (shares_before > 0)), "no longer reported")
        .when(shares > shares_before, "increase").when(shares < shares_before, "decrease").otherwise("unchanged")
    )


def quarter_on_quarter(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both quarters with their change; securities gone since are there with no shares."""
    old = previous.select(*keys, F.col("shares").alias("shares_before"), F.col("value").alias("value_before"))
    both = current.join(old, keys, "full")
    shares, value = F.coalesce("shares", F.lit(0.0)), F.coalesce("value", F.lit(0.0))
    return both.select(*keys, shares.alias("shares"), value.alias("value"), "shares_before", "value_before", filing_change(shares, value, F.col("shares_before"), F.col("value_before")).alias("change"))


def resolved(a: DataFrame, b: DataFrame, a_id: str, b_id: str, steps: list[tuple[str, Column, Column, bool]]) -> DataFrame:
    """Pairs of ids of two lists by a cascade of keys, each step over what the earlier ones left. Step: method's
    name, key of a, key of b, and whether the key must be unique on both sides (else the first by id is taken)."""
    out = []
    for method, key_a, key_b, unique in steps:
        ka, kb = (x.withColumn("_k", k).filter("_k is not null and _k != ''") for x, k in ((a, key_a), (b, key_b)))
        if unique:
            once = lambda x: x.withColumn("_n", F.count("*").over(Window.partitionBy("_k"))).filter("_n = 1").drop("_n")
            ka, kb = once(ka), once(kb)
        else:
            nth = lambda x, i: x.withColumn("_i", F.row_number().over(Window.partitionBy("_k").orderBy(i)))
            ka, kb = nth(ka, a_id), nth(kb, b_id)
        on = ["_k"] if unique else ["_k", "_i"]
        found = ka.select(*on, F.col(a_id).alias("a_id")).join(kb.select(*on, F.col(b_id).alias("b_id")), on).select("a_id", "b_id", F.lit(method).alias("method"))
        out.append(found)
        a = a.join(found, a[a_id] == F.col("a_id"), "left_anti")
        b = b.join(found, b[b_id] == F.col("b_id"), "left_anti")
    return reduce(DataFrame.unionByName, out)


def name_key(name: Column) -> Column:
    return issuer_key(name)


def implied_units(net_assets: Column, nav: Column) -> Column:
    """The number of units that a file's net assets and the rounded NAV imply; null unless it is whole within the rounding."""
    shown = half_up(nav, 2)
    quotient = net_assets / shown
    units = F.floor(quotient + 0.5)
    return F.when((units > 0) & (F.abs(quotient - units) <= F.greatest(0.01 / shown, F.lit(1e-6))), units)


def nav_proof(net_assets: Column, units: Column, nav: Column, nav_units: Column, gap_days: Column) -> Column:
    """Whether a holdings file's total proves its pricing date: exact, per-share, or null."""
    shown = half_up(nav, 2)
    near = (gap_days >= 0) & (gap_days <= 4)
    exact = (F.abs(net_assets - shown * units) <= F.greatest(F.lit(1.0), F.abs(net_assets) * 1e-5)) & (nav_units.isNull() | (F.abs(units - nav_units) < 0.5))
    return F.when(near & exact, "exact").when(near & (F.abs(net_assets / units - shown) <= 0.005), "per-share")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, as when later versions replace earlier ones."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def changed_only(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Observations that differ from the one before them."""
    w = Window.partitionBy(*keys).orderBy(order)
    now = F.struct(*columns)
    return df.withColumn("_b", F.lag(now).over(w)).filter(F.col("_b").isNull() | ~F.col("_b").eqNullSafe(now)).drop("_b")


def chains(links: DataFrame, start: str, end: str, value: str) -> DataFrame:
    """Maximal chains of rows in which one's end is the next one's start: first start, last end, length and the product of the values.

    Runs by doubling: in each round every row takes over what follows the row it leads to, so that n rows in a
    chain take log n rounds, until no row leads any further. Starts and ends are unique, and ends come after starts. Each round's rows are a checkpoint."""
    rows = cut(links.select(F.col(start).alias("s"), F.col(end).alias("e"), F.lit(1).cast("long").alias("n"), F.log(value).alias("v")))
    while True:
        nxt = rows.select(F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("n").alias("n2"), F.col("v").alias("v2"))
        further = rows.join(nxt, F.col("e") == F.col("s2"), "left").select("s", F.coalesce("e2", "e").alias("e"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), (F.col("v") + F.coalesce("v2", F.lit(0.0))).alias("v"), F.col("e2").isNotNull().alias("moved"))
        further = cut(further)
        rows = further.drop("moved")
        if further.filter("moved").isEmpty():
            break
    heads = rows.join(links.select(F.col(end).alias("s")), "s", "left_anti")
    return heads.select(F.col("s").alias("first"), F.col("e").alias("last"), F.col("n").alias("length"), F.exp("v").alias("product"))
