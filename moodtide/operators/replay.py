"""Ledgers of daily decisions: whether each follows from the one before, what they earned under a cost, and whether reported
figures come out again. A ledger has the columns ordinal, index (the bar decided on), date, execution (the bar at which it is
carried out), target and filled (LONG or CASH), action (BUY or SELL), traded and digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import over, series

LONG, CASH = "LONG", "CASH"
#: Columns under a decision's digest, in the order of their names.
SIGNED = ("action", "date", "execution", "filled", "index", "ordinal", "target", "traded")


def signature() -> Column:
    return F.sha2(F.to_json(F.struct(*SIGNED)), 256)


def ledger(targets: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger of the targets of consecutive bars (keys, index, date, target); before the first one is LONG."""
    w = series(keys, "index")
    action = F.when(F.col("target") == LONG, "BUY").otherwise("SELL")
    rows = targets.select(*keys, "index", "date", "target", action.alias("action"), (F.col("index") + 1).alias("execution"), (F.row_number().over(w) - 1).alias("ordinal"), F.coalesce(F.lag("target").over(w), F.lit(LONG)).alias("filled"))
    return rows.withColumn("traded", F.col("target") != F.col("filled")).withColumn("digest", signature())


def timeline_problems(decisions: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place (of the decision in its series) and each way in which it departs from what the bars and the one before imply.

    Nulls differ from whatever is expected. An empty ledger has no problems."""
    w = series(keys, "index")
    known = bars.select(*keys, "index", F.col("date").alias("__date"))
    rows = decisions.join(known, [*keys, "index"], "left").withColumn("place", F.row_number().over(w) - 1).withColumn("__before", F.when(F.col("place") == 0, LONG).otherwise(F.lag("target").over(w)))
    differs = lambda a, b: ~F.col(a).eqNullSafe(b)
    checks = {
        "ordinal": differs("ordinal", F.col("place")),
        "gap": (F.col("place") > 0) & differs("index", F.lag("index").over(w) + 1),
        "date": F.col("__date").isNull() | differs("date", F.col("__date")),
        "execution": differs("execution", F.col("index") + 1),
        "target": ~F.coalesce(F.col("target").isin(LONG, CASH), F.lit(False)),
        "action": differs("action", F.when(F.col("target") == LONG, "BUY").otherwise("SELL")),
        "filled": differs("filled", F.col("__before")),
        "traded": differs("traded", ~F.col("target").eqNullSafe(F.col("__before"))),
        "digest": differs("digest", signature()),
    }
    found = F.array_compact(F.array(*[F.when(wrong, name) for name, wrong in checks.items()]))
    return rows.withColumn("__found", found).select(*keys, "place", F.explode("__found").alias("problem"))


def path(decisions: DataFrame, bars: DataFrame, keys: list[str], costs: list[float]) -> DataFrame:
    """Wealth from the first to the last bar decided on, for each cost of a change of position.

    The series starts LONG at wealth 1. A target is carried out at the close of its execution, after the bar's own move; of several
    at one bar the latest decision's holds. Decisions without an execution change nothing."""
    span = decisions.groupBy(*keys).agg(F.min("index").alias("__first"), F.max("index").alias("__last"))
    fills = decisions.filter("execution is not null").groupBy(*keys, F.col("execution").alias("index")).agg(F.max_by("target", F.struct("index", "ordinal")).alias("fill"))
    rows = bars.select(*keys, "index", "date", "close").join(span, keys).filter("index between __first and __last").join(fills, [*keys, "index"], "left")
    w = series(keys, "index")
    rows = rows.withColumn("fill", F.when(F.col("index") > F.col("__first"), F.col("fill")))
    rows = rows.withColumn("position", F.coalesce(F.last("fill", ignorenulls=True).over(over(keys, order="index")), F.lit(LONG)))
    rows = rows.withColumn("held", F.lag("position").over(w)).withColumn("move", F.when(F.col("held") == LONG, F.log(F.col("close") / F.lag("close").over(w))).otherwise(0.0))
    rows = rows.withColumn("changed", F.coalesce(F.col("position") != F.col("held"), F.lit(False)))
    rows = rows.withColumn("cost", F.explode(F.array(*map(F.lit, costs))))
    by_cost = over([*keys, "cost"], order="index")
    rows = rows.withColumn("charged", F.when(F.col("changed"), F.col("cost")).otherwise(0.0))
    rows = rows.withColumn("wealth", F.exp(F.sum(F.col("move") + F.log(1 - F.col("charged"))).over(by_cost)))
    rows = rows.withColumn("drawdown", 1 - F.col("wealth") / F.max("wealth").over(by_cost))
    return rows.select(*keys, "cost", "index", "date", "wealth", "position", "held", "fill", "changed", "charged", "drawdown")


def figures(replayed: DataFrame, decisions: DataFrame, keys: list[str], per_year: int = 252) -> DataFrame:
    """The figures of a path, and those of its decisions; `ledger` is the digest of their indices, executions, actions and targets, so it is the same under all costs."""
    by_cost = [*keys, "cost"]
    net = replayed.withColumn("net", F.col("wealth") / F.lag("wealth").over(series(by_cost, "index")) - 1)
    n, fills = F.col("intervals"), F.col("fills")
    sums = net.groupBy(*by_cost).agg(
        (F.count("*") - 1).alias("intervals"), F.max_by("wealth", "index").alias("wealth"), F.stddev_samp("net").alias("__sd"), F.max("drawdown").alias("drawdown"),
        F.count(F.when(F.col("held") == LONG, 1)).alias("__in"), F.count(F.when(F.col("changed"), 1)).alias("fills"),
    )
    done = sums.select(
        *by_cost, "intervals", "wealth", F.when(n > 0, F.log("wealth") * per_year / n).otherwise(0.0).alias("growth"), (F.coalesce("__sd", F.lit(0.0)) * per_year**0.5).alias("volatility"), "drawdown",
        F.when(n > 0, F.col("__in") / n).otherwise(1.0).alias("exposure"), "fills", (fills * F.col("cost")).alias("cost_sum"), F.pow(1 - F.col("cost"), fills).alias("cost_multiplier"),
    )
    w = series(keys, "index")
    text = F.concat_ws(":", "index", "execution", "action", "target")
    turned = decisions.withColumn("__back", (F.col("target") == LONG) & (F.lag("target").over(w) == CASH))
    states = turned.groupBy(*keys).agg(
        F.count(F.when(F.col("target") == LONG, 1)).alias("long"), F.count(F.when(F.col("target") == CASH, 1)).alias("cash"), F.count(F.when(F.col("__back"), 1)).alias("episodes"),
        # one row a day and series
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", text.alias("t")))), lambda x: x["t"]), "\n"), 256).alias("ledger"),
    )
    return done.join(states, keys)


def differences(reported: DataFrame, again: DataFrame, keys: list[str], fields: list[str], tolerance: float = 1e-9) -> DataFrame:
    """keys, field, reported, recomputed: the figures that differ by more than the tolerance, relative to the larger of both and 1, or that one side lacks.

    NaN equals nothing but NaN. Keys must not be null."""
    long = lambda df, name: df.select(*keys, *[F.col(f).cast("double") for f in fields]).unpivot(keys, fields, "field", name)
    both = long(reported, "reported").join(long(again, "recomputed"), [*keys, "field"], "full")
    a, b = F.col("reported"), F.col("recomputed")
    near = F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    same = a.eqNullSafe(b) | F.coalesce(near & ~F.isnan(a) & ~F.isnan(b), F.lit(False))
    return both.filter(~same)


def forecast_errors(decisions: DataFrame, bars: DataFrame, keys: list[str], least: int = 252) -> DataFrame:
    """Squared errors of the decisions' forecasts of the log return from the next close to the one after, where that is known.

    early: forecasts made with fewer than `least` rows known (`trained`), unsound: those that come with a reason for having none."""
    w = series(keys, "index")
    actual = bars.select(*keys, "index", F.log(F.lead("close", 2).over(w) / F.lead("close", 1).over(w)).alias("actual"))
    rows = decisions.filter(F.col("forecast").isNotNull() & ~F.isnan("forecast")).join(actual, [*keys, "index"], "left")
    e = F.pow(F.col("actual") - F.col("forecast"), 2)
    return rows.groupBy(*keys).agg(
        F.count("actual").alias("origins"), F.sum(e).alias("sse"), F.avg(e).alias("mse"),
        F.count(F.when(F.coalesce(F.col("trained") < least, F.lit(True)), 1)).alias("early"), F.count("reason").alias("unsound"),
    )


#: What keeps results from being scored, in the order of their names.
CASH_NOT_EXECUTABLE, CASH_NOT_TOTAL = "CASH_INSTRUMENT_NOT_EXECUTABLE", "CASH_INSTRUMENT_NOT_TOTAL_RETURN"
RISKY_NOT_EXECUTABLE, RISKY_NOT_TOTAL = "RISKY_INSTRUMENT_NOT_EXECUTABLE", "RISKY_INSTRUMENT_NOT_TOTAL_RETURN"
ATTESTATION = "risky struct<executable:boolean,returns:string,currency:string>, cash struct<executable:boolean,returns:string,currency:string>, same_benchmark boolean, cash_in_labels boolean, frozen boolean"


def scoreability(attestation: Column, limitations: Column) -> Column:
    """The sorted reasons for which results can't be scored, from an attestation (a struct as in ATTESTATION, or null) and a list of limitations."""
    given = attestation.isNotNull()
    missing = lambda c: given & ~F.coalesce(c, F.lit(False))
    part = lambda side, name: attestation[side][name]
    currency = F.nullif(part("risky", "currency"), F.lit(""))
    reasons = {
        "BENCHMARK_NOT_SAME_RISKY_INSTRUMENT": missing(attestation["same_benchmark"]),
        CASH_NOT_EXECUTABLE: missing(part("cash", "executable")),
        CASH_NOT_TOTAL: missing(part("cash", "returns") == "total_return"),
        "CASH_RETURN_NOT_INCLUDED_IN_LABELS_AND_LEDGERS": missing(attestation["cash_in_labels"]),
        "MISSING_SCOREABILITY_ATTESTATION": ~given,
        "RISKY_CASH_CURRENCY_MISMATCH": missing(currency == part("cash", "currency")),
        RISKY_NOT_EXECUTABLE: missing(part("risky", "executable")),
        RISKY_NOT_TOTAL: missing(part("risky", "returns") == "total_return"),
        "TARGET_IDENTITY_NOT_FROZEN": missing(attestation["frozen"]),
        "ZERO_RETURN_CASH_LEDGER": F.coalesce(F.exists(limitations, lambda x: x.rlike("(?i)cash return is fixed at zero")), F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(holds, name) for name, holds in reasons.items()]))
