"""Rules with a state as compositions of transition maps.

What a bar does to a rule with k states is a map: for each state before the bar the state after it. Composing
maps is associative, so the maps of all prefixes of a series come from doubling: after the pass with step d each row holds the composition
of the 2d rows that end with it. All passes are windows over the same series in the same order, hence one shuffle and one sort, and no task
steps through a series in Python. A prefix's map answers for every initial state at once.

Maps of few states are bits of one long, which keeps their composition in compiled code; others are arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import series


def _bits(k: int) -> int:
    """Bits for a state, 0 if the maps of k states don't fit a long."""
    b = max(1, (k - 1).bit_length())
    return b if k * b <= 63 else 0


def _right(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n.cast("int"))


def transition(after: list[Column]) -> Column:
    """The map that leads from state s to after[s]."""
    b = _bits(len(after))
    if not b:
        return F.array(*(a.cast("int") for a in after))
    out = F.lit(0).cast("long")
    for s, a in enumerate(after):
        out = out.bitwiseOR(F.shiftleft(a.cast("long"), s * b))
    return out


def image(step: Column, state: Column | int, k: int) -> Column:
    """Where a map leads from a state."""
    state, b = (F.lit(state) if isinstance(state, int) else state), _bits(k)
    return _right(step, state * b).bitwiseAND((1 << b) - 1).cast("int") if b else F.get(step, state)


def composed(first: Column, then: Column, k: int) -> Column:
    """The map of `first` followed by `then`; a null map changes nothing."""
    both = transition([image(then, image(first, s, k), k) for s in range(k)]) if _bits(k) else F.transform(first, lambda s: F.get(then, s))
    return F.when(first.isNull(), then).when(then.isNull(), first).otherwise(both)


def scanned(df: DataFrame, keys: list[str], step: str, k: int, order: str = "date", longest: int | None = None) -> DataFrame:
    """df with the column `step` (a map of k states per row) turned into the map of all rows of the series up to and with this one.

    longest: rows of the longest series, if known; else it is counted, and the driver gets that one number.
    """
    if longest is None:
        longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    w, d = series(keys, order), 1
    while d < longest:
        df = df.withColumn("_back", F.lag(step, d).over(w)).withColumn(step, composed(F.col("_back"), F.col(step), k)).drop("_back")
        d *= 2
    return df


def states(df: DataFrame, keys: list[str], after: list[Column], initial: int, order: str = "date", longest: int | None = None) -> DataFrame:
    """df with `before` and `after`: the state in which each row finds the rule and leaves it, from `initial` on. after: for each state the one that a row leads it to."""
    k = len(after)
    done = scanned(df.withColumn("_step", transition(after)), keys, "_step", k, order, longest).withColumn("after", image(F.col("_step"), initial, k))
    return done.withColumn("before", F.coalesce(F.lag("after").over(series(keys, order)), F.lit(initial))).drop("_step")
