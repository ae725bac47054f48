"""A grid of rules as a table.

A rule says when to be in the market and when to be out of it by predicates over a bar's features. Predicates are data: the place of a feature, a comparison, and the place of
another feature or a constant, with a second feature as a gate. One expression evaluates any of them, so that rules are rows that are joined with bars, and a new rule is
a new row. What a rule does on a bar is a transition map of the states out (0) and in (1), see scan.py; thus a rule may depend on its state.

A decision at a close is carried out at the next one. Costs multiply wealth at each trade. The last bar's decision is not carried out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import displayed
from . import scan
from .windows import full_mean, over, series

COMPONENTS = ("trend", "strength", "volatility", "safe", "credit", "breadth")
FEATURES = ("score", "shown", "votes", "above_125", "above_210", *(f"mean_{n}" for n in (21, 63, 126)), *(f"lag_{n}" for n in (5, 21, 63)), *COMPONENTS, *(f"{c}_mean" for c in COMPONENTS))
WARM_UP, DEVELOPMENT, LEAST_TRADES = 126, 0.6, 4
#: Share of wealth that a trade costs, by scenario.
COSTS = {"zero": 0.0, "base": 0.001, "stress": 0.0025}

_PREDICATE = "struct<feature: int, op: string, other: int, constant: double, gate: int, how: string>"
SCHEMA = f"rule string, family string, place int, enter {_PREDICATE}, leave {_PREDICATE}"


def predicate(feature: str, op: str, to: str | float, gate: str | None = None, how: str | None = None) -> tuple:
    """feature op (another feature or a constant), alone or joined by `how` (and, or) with a gate, a feature that is 0 or 1."""
    other = FEATURES.index(to) if isinstance(to, str) else None
    return (FEATURES.index(feature), op, other, None if isinstance(to, str) else float(to), FEATURES.index(gate) if gate else None, how)


def rule_list() -> list[tuple]:
    """(rule, family, enter, leave) in the order that settles ties; no leave: out whenever enter doesn't hold. The windows, levels and pairs are the grid's parameters."""
    found: list[tuple] = []
    both = ((">", "with"), ("<=", "against"))
    found += [(f"score_{word}_mean_{n}", "mean cross", predicate("score", op, f"mean_{n}"), None) for n in (21, 63, 126) for op, word in both]
    found += [(f"score_{word}_lag_{n}", "slope", predicate("score", op, f"lag_{n}"), None) for n in (5, 21, 63) for op, word in both]
    found += [(f"shown_{word}_{x}", "level", predicate("shown", op, x), None) for x in (35, 45, 50, 55, 65) for op, word in ((">=", "above"), ("<=", "below"))]
    found += [(f"shown_band_{hi}_{lo}", "hysteresis", predicate("shown", ">=", hi), predicate("shown", "<=", lo)) for hi, lo in ((55, 45), (60, 40), (65, 45), (70, 50))]
    for c in COMPONENTS:
        found += [(f"{c}_with_mean", "component cross", predicate(c, ">", f"{c}_mean"), None), (f"{c}_above_50", "component level", predicate(c, ">", 50), None)]
    found += [(f"votes_{n}", "vote", predicate("votes", ">=", n), None) for n in (3, 4, 5)]
    found += [("trend_and_no_fear", "gated", predicate("shown", ">=", 45, "above_125", "and"), None), ("trend_and_no_greed", "gated", predicate("shown", "<=", 74, "above_125", "and"), None)]
    found += [("trend_or_greed", "gated", predicate("shown", ">=", 65, "above_125", "or"), None), ("trend_and_rising", "gated", predicate("score", ">", "mean_21", "above_125", "and"), None)]
    found += [(f"price_{n}", "control", predicate(f"above_{n}", ">", 0), None) for n in (125, 210)]
    return found


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, f, i, enter, leave) for i, (r, f, enter, leave) in enumerate(rule_list())], SCHEMA)


def holds(p: Column, features: Column) -> Column:
    """Whether a predicate holds on a bar; null where a feature that it needs is."""
    x, y = F.get(features, p["feature"]), F.coalesce(F.get(features, p["other"]), p["constant"])
    compared = F.when(p["op"] == ">", x > y).when(p["op"] == ">=", x >= y).when(p["op"] == "<", x < y).when(p["op"] == "<=", x <= y)
    gate = F.get(features, p["gate"]) > 0
    return F.when(p["how"] == "and", compared & gate).when(p["how"] == "or", compared | gate).otherwise(compared)


def transition(features: Column) -> Column:
    """The map of a bar under a rule; nothing changes where a predicate is null."""
    enter = holds(F.col("enter"), features)
    leave = F.when(F.col("leave").isNull(), ~enter).otherwise(holds(F.col("leave"), features))
    return scan.transition([F.when(enter, 1).otherwise(0), F.when(leave, 0).otherwise(1)])


def context(scores: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """keys, date, close, i (from 0), n and `features` (doubles in the order of FEATURES) of the bars after the warm-up.

    scores: keys, date, score and the components; prices: keys, date, close. Means and lags count score rows, gates price rows; only dates with both remain.
    """
    gates = [F.when(F.col("close") > full_mean(F.col("close"), keys, n), 1.0).when(full_mean(F.col("close"), keys, n).isNotNull(), 0.0).alias(f"above_{n}") for n in (125, 210)]
    priced = prices.select(*keys, "date", "close", *gates)
    w = series(keys)
    made = scores.select(
        *keys, "date", "score", *COMPONENTS, displayed(F.col("score")).cast("double").alias("shown"), F.row_number().over(w).alias("_k"),
        *(full_mean(F.col("score"), keys, n).alias(f"mean_{n}") for n in (21, 63, 126)), *(F.lag("score", n).over(w).alias(f"lag_{n}") for n in (5, 21, 63)),
        *(full_mean(F.col(c), keys, 63).alias(f"{c}_mean") for c in COMPONENTS), sum(F.when(F.col(c) > 50, 1.0).otherwise(0.0) for c in COMPONENTS).alias("votes"),
    )
    bars = made.filter(F.col("_k") > WARM_UP).join(priced, [*keys, "date"]).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    return bars.select(*keys, "date", "close", "i", "n", F.array(*FEATURES).alias("features"))


def stages(bars: DataFrame) -> DataFrame:
    """bars with `stage`: development, the first 60 % of a series, and holdout, the others and the bar before them."""
    last = F.ceil(F.col("n") * DEVELOPMENT) - 1
    of = F.filter(F.array(F.when(F.col("i") <= last, F.lit("development")), F.when(F.col("i") >= last, F.lit("holdout"))), lambda s: s.isNotNull())
    return bars.withColumn("stage", F.explode(of))


def paths(rows: DataFrame, keys: list[str], longest: int | None = None) -> DataFrame:
    """rows: bars by stage and rule, with the rule's columns. One row per bar, stage and rule: `state` (the map from either start to the state after the bar), held (in over the interval that ends here, having
    begun in the market) and traded (a change was carried out here)."""
    path = [*keys, "stage", "rule"]
    done = scan.scanned(rows.withColumn("state", transition(F.col("features"))).drop("features", "enter", "leave"), path, "state", 2, longest=longest)
    w = series(path)
    after, before = scan.image(F.col("state"), 1, 2), F.lag("after").over(w)
    # what was decided a bar ago is carried out here; the interval up to here was held by what was decided before that
    decided = done.withColumn("after", after).withColumn("target", F.coalesce(before, F.lit(1))).withColumn("at", F.row_number().over(w))
    return decided.withColumn("held", F.coalesce(F.lag("target").over(w), F.lit(1))).withColumn("traded", (F.col("target") != F.col("held")).cast("int"))


def results(path_rows: DataFrame, keys: list[str], costs: dict[str, float]) -> DataFrame:
    """One row per stage, rule and cost: wealth and its ratio to holding, drawdown, trades, cycles (completed times in cash), exposure, pending (a decision of the last bar that wasn't carried out), in at the end."""
    path = [*keys, "stage", "rule"]
    upto = over(path)
    move = F.log(F.col("close") / F.lag("close").over(series(path)))
    rows = path_rows.withColumn("gross", F.sum(F.coalesce(F.when(F.col("held") == 1, move), F.lit(0.0))).over(upto)).withColumn("trades", F.sum("traded").over(upto))
    level = {s: F.exp(F.col("gross") + F.col("trades") * F.log(F.lit(1 - c))) for s, c in costs.items()}
    rows = rows.select("*", *(x.alias(f"w_{s}") for s, x in level.items()))
    rows = rows.select("*", *((F.col(f"w_{s}") / F.max(f"w_{s}").over(upto) - 1).alias(f"d_{s}") for s in costs))
    last = lambda c: F.max_by(c, "at")
    done = rows.groupBy(*path, "family", "place").agg(
        F.max_by("close", "at").alias("_b"), F.min_by("close", "at").alias("_a"), F.sum("traded").alias("trades"), F.sum(F.col("traded") * F.col("target")).alias("cycles"), F.count("*").alias("_n"),
        F.sum(F.when(F.col("at") > 1, F.col("held"))).alias("_in"), last((F.col("after") != F.col("target")).cast("int")).alias("pending"), last("target").alias("invested"),
        *(last(f"w_{s}").alias(f"w_{s}") for s in costs), *(F.min(f"d_{s}").alias(f"d_{s}") for s in costs),
    )
    scenario = F.explode(F.array(*(F.struct(F.lit(s).alias("scenario"), F.col(f"w_{s}").alias("wealth"), F.col(f"d_{s}").alias("drawdown")) for s in costs)))
    hold = F.col("_b") / F.col("_a")
    return done.withColumn("s", scenario).select(
        *path, "family", "place", "s.scenario", "s.wealth", (F.col("s.wealth") / hold).alias("ratio"), "s.drawdown", "trades", "cycles",
        (F.col("_in") / (F.col("_n") - 1)).alias("exposure"), "pending", "invested",
    )


def wide(done: DataFrame, keys: list[str]) -> DataFrame:
    """One row per stage and rule with base and stress ratios, from results."""
    of = lambda s: F.max(F.when(F.col("scenario") == s, F.col("ratio"))).alias(s)
    return done.groupBy(*keys, "stage", "rule", "family", "place", "trades", "exposure").agg(of("base"), of("stress"))


def selection(done: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """The best rules of each series in development: those with a ratio above 1 at base and stress costs and enough trades, by base ratio, then fewer trades, then name.
    Returns rank, eligible (how many there are), rule, base, stress, trades and exposure of the first `most`; series without any have one row of nulls with rank 0."""
    rules = wide(done.filter("stage = 'development' and family <> 'control'"), keys)
    good = rules.filter((F.col("base") > 1) & (F.col("stress") > 1) & (F.col("trades") >= LEAST_TRADES))
    ranked = good.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("base"), "trades", "rule"))).withColumn("eligible", F.count("*").over(Window.partitionBy(*keys)))
    every = rules.select(*keys).distinct()
    return every.join(ranked.filter(F.col("rank") <= most), keys, "left").select(*keys, F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("eligible", F.lit(0)).alias("eligible"), "rule", "base", "stress", "trades", "exposure")


def shared_selection(done: DataFrame, keys: list[str]) -> DataFrame:
    """The rule (one row, or none) whose least log ratio over all series at base costs is largest, above 0 everywhere and at stress costs too; ties by the grid's order."""
    rules = wide(done.filter("stage = 'development' and family <> 'control'"), keys).groupBy("rule", "place").agg(F.min("base").alias("worst"), F.min("stress").alias("worst_stress"))
    first = rules.filter("worst > 1 and worst_stress > 1").orderBy(F.desc("worst"), "place").limit(1)
    return first.select("rule", F.log("worst").alias("objective"))


def shifted(bars: DataFrame, keys: list[str], offsets: Column) -> DataFrame:
    """bars with each of `offsets` (an array by n) as a key `offset`, their sentiment features moved round by it among the rows of a series; gates stay on their dates.

    bars: keys, i and n within the series, features."""
    moved = bars.select(*keys, "n", "i", F.col("features").alias("_from"), F.explode(offsets).alias("offset"))
    moved = moved.select(*keys, "offset", F.pmod(F.col("i") + F.col("offset"), F.col("n")).alias("i"), "_from")
    gates = [i for i, f in enumerate(FEATURES) if f.startswith("above_")]
    both = F.array(*(F.get("features" if i in gates else "_from", F.lit(i)) for i in range(len(FEATURES))))
    return bars.join(moved, [*keys, "i"]).withColumn("features", both).drop("_from")
