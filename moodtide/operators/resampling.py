"""Confidence of a bucket's mean against the mean of all rows, from blocks of consecutive rows drawn anew.

Draws come from one generator that runs on through all repetitions. Its state after k steps is an affine map of the seed, put together from the maps of the powers of two in k; so every
draw is a row that needs no other one, and a block's sums are differences of running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import over, series

#: Multiplier, increment and modulus of the generator, and the seed.
MULTIPLIER, INCREMENT, MODULUS, SEED = 1664525, 1013904223, 1 << 32, 20260827
BITS = 40


def jumps() -> list[tuple[int, int]]:
    """Multiplier and increment of 1, 2, 4, ... steps."""
    out = [(MULTIPLIER, INCREMENT)]
    for _ in range(BITS - 1):
        a, c = out[-1]
        out.append((a * a % MODULUS, (a * c + c) % MODULUS))
    return out


def state_after(k: Column, seed: int = SEED) -> Column:
    """The generator's state after k steps (k below 2**40)."""
    state = F.lit(seed).cast("long")
    steps = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(a >> 16).cast("long").alias("high"), F.lit(a & 0xFFFF).cast("long").alias("low"), F.lit(c).cast("long").alias("c")) for j, (a, c) in enumerate(jumps())])
    # by halves, since a product of two states doesn't fit a long
    moved = lambda s, x: ((x["high"] * s % 65536) * 65536 + x["low"] * s + x["c"]) % MODULUS
    wanted = F.filter(steps, lambda x: F.call_function("getbit", k, x["j"]) == 1)
    return F.aggregate(wanted, state, moved)


def blocks(sizes: DataFrame, reps: int, block: Column, seed: int = SEED) -> DataFrame:
    """sizes: keys and n. Adds rep, start and length of each block drawn: as many blocks as fill n rows, the last one cut."""
    rows = sizes.withColumn("block", F.least("n", block)).withColumn("__blocks", F.ceil(F.col("n") / F.col("block")))
    # a row a series becomes many, so repetitions are dealt out first, to a number of tasks that isn't cut down for their small size
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [c for c in sizes.columns if c != "n"]
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition(tasks, *keys, "rep").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    draw = state_after(F.col("rep") * F.col("__blocks") + F.col("b") + 1, seed) / F.lit(float(MODULUS))
    return rows.withColumn("start", F.floor(draw * (F.col("n") - F.col("block") + 1))).withColumn("length", F.least("block", F.col("n") - F.col("b") * F.col("block"))).drop("__blocks")


def bucket_confidence(rows: DataFrame, keys: list[str], order: str, value: str, inside: str, reps: int, horizon: int, extra: int = 0, seed: int = SEED) -> DataFrame:
    """keys, n, bucket (rows inside), difference of means, low, high (95 %), p (two-sided), valid: repetitions with at least five rows inside.

    Rows whose value is null or NaN are left out; `inside` null counts as outside. Low, high and p are null if less than half the repetitions are valid. A series without rows has no result."""
    w = series(keys, order)
    sound = rows.filter(F.col(value).isNotNull() & ~F.isnan(value))
    flagged = sound.select(*keys, (F.row_number().over(w)).cast("long").alias("__i"), F.col(value).cast("double").alias("__x"), F.coalesce(F.col(inside), F.lit(False)).alias("__in"))
    run = over(keys, order="__i")
    x_in = F.when(F.col("__in"), F.col("__x")).otherwise(0.0)
    # sums of the first i rows, from i = 0
    sums = flagged.select(*keys, F.col("__i").alias("at"), F.sum("__x").over(run).alias("all"), F.sum(x_in).over(run).alias("part"), F.sum(F.col("__in").cast("long")).over(run).alias("k"))
    sizes = flagged.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(F.col("__in"), 1)).alias("bucket"), (F.avg(F.when(F.col("__in"), F.col("__x"))) - F.avg("__x")).alias("difference"))
    sums = sums.unionByName(sizes.select(*keys, F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("all"), F.lit(0.0).alias("part"), F.lit(0).cast("long").alias("k")))
    drawn = blocks(sizes.select(*keys, "n"), reps, F.lit(max(horizon, 5) + extra).cast("long"), seed)
    ends = drawn.select(*keys, "n", "rep", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("start") + F.col("length")).alias("at"), F.lit(1).alias("sign")))).alias("e")).select(*keys, "n", "rep", "e.at", "e.sign")
    # draws that meet the same row are added up before the join
    met = ends.groupBy(*keys, "n", "rep", "at").agg(F.sum("sign").alias("sign")).filter("sign <> 0").join(sums, [*keys, "at"])
    by_rep = met.groupBy(*keys, "n", "rep").agg(*(F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("all", "part", "k")))
    diffs = by_rep.filter("k >= 5").withColumn("d", F.col("part") / F.col("k") - F.col("all") / F.col("n"))
    ranked = diffs.withColumn("r", F.row_number().over(series(keys, "d")) - 1).withColumn("m", F.count("*").over(Window.partitionBy(*keys)))  # a row per repetition
    at = lambda q: F.max(F.when(F.col("r") == F.floor(F.col("m") * q), F.col("d")))
    share = lambda c: F.count(F.when(c, 1)) / F.count("*")
    ci = ranked.groupBy(*keys).agg(F.count("*").alias("valid"), at(0.025).alias("low"), at(0.975).alias("high"), F.least(F.lit(1.0), 2 * F.least(share(F.col("d") <= 0), share(F.col("d") >= 0))).alias("p"))
    out = sizes.join(ci, keys, "left").withColumn("valid", F.coalesce("valid", F.lit(0).cast("long")))
    enough = F.col("valid") >= reps / 2
    return out.select(*keys, "n", "bucket", "difference", *(F.when(enough, F.col(c)).alias(c) for c in ("low", "high", "p")), "valid")
