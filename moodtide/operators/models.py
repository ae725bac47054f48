"""Forecasts fitted on the past only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the online learner: ridge penalty, rows needed before it decides, bound of standardised features.
RIDGE, LEAST_ROWS, Z_LIMIT = 1.0, 252, 5.0


def ridge_forecast(n: float, sx: np.ndarray, sxx: np.ndarray, sy: float, sxy: np.ndarray, x: np.ndarray, penalty: float = RIDGE, limit: float = Z_LIMIT) -> float:
    """The forecast at x of a ridge regression on standardised features, from sums over n rows."""
    mean, my = sx / n, sy / n
    cov = sxx / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    on = sd > 1e-14
    if not on.any():
        return my
    scale = np.outer(sd[on], sd[on])
    beta = np.linalg.solve(cov[np.ix_(on, on)] / scale + penalty * np.eye(on.sum()), (sxy / n - mean * my)[on] / sd[on])
    return float(my + beta @ np.clip((x - mean)[on] / sd[on], -limit, limit))


def prequential(rows: DataFrame, keys: list[str], features: list[str], label: str, cost: float, delay: int = 2, least: int = LEAST_ROWS) -> DataFrame:
    """Each row's forecast from the rows whose outcome was known by then (`delay` rows back), and the position decided by it.

    Rows without complete features decide for cash, rows with fewer than `least` known outcomes for long; else
    the position changes only if the forecast pays the cost of changing. Adds n_known, forecast, reason and target.
    The sums of each series are taken once and accumulated, so that a row costs one small system of equations."""
    hurdle = -np.log(1 - cost)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        x = pdf[features].to_numpy(float)
        y = pdf[label].to_numpy(float)
        whole = np.isfinite(x).all(axis=1)
        usable = whole & np.isfinite(y)
        z = np.where(usable[:, None], np.column_stack([np.ones(len(x)), x, np.where(np.isfinite(y), y, 0)]), 0)
        z = np.nan_to_num(z)
        sums = np.cumsum(z[:, :, None] * z[:, None, :], axis=0)
        forecast, known, reason, target = [], [], [], []
        position = "LONG"
        for t in range(len(x)):
            s = sums[t - delay] if t >= delay else np.zeros(sums.shape[1:])
            n = int(s[0, 0])
            f, why = None, None
            if not whole[t]:
                position, why = "CASH", "incomplete features"
            elif n < least:
                position, why = "LONG", "too few outcomes"
            else:
                f = ridge_forecast(n, s[0, 1:-1], s[1:-1, 1:-1], s[0, -1], s[1:-1, -1], x[t])
                if position == "CASH" and f > hurdle:
                    position = "LONG"
                elif position == "LONG" and f < -hurdle:
                    position = "CASH"
            forecast.append(f)
            known.append(n)
            reason.append(why)
            target.append(position)
        return pdf[[*keys, "date", label]].assign(n_known=known, forecast=pd.Series(forecast, dtype="float64"), reason=reason, target=target)

    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([*(fields[c] for c in (*keys, "date", label)), T.StructField("n_known", T.LongType()), T.StructField("forecast", T.DoubleType()), T.StructField("reason", T.StringType()), T.StructField("target", T.StringType())])
    out = rows.select(*keys, "date", *features, label).groupBy(*keys).applyInPandas(fold, schema)
    return out.withColumn("forecast", F.nanvl("forecast", F.lit(None).cast("double")))


def gram(rows: DataFrame, keys: list[str], features: list[str], label: str, weight: str | None = None) -> DataFrame:
    """(Weighted) sums and products of features and label by key: all that least squares needs, of a size that doesn't grow with the rows."""
    names = ["1", *features, label]
    col = lambda c: F.lit(1.0) if c == "1" else F.col(c)
    complete = rows.dropna(subset=[*features, label])
    w = F.col(weight) if weight else F.lit(1.0)
    return complete.groupBy(*keys).agg(*(F.sum(w * col(a) * col(b)).alias(f"{a}*{b}") for i, a in enumerate(names) for b in names[i:]))


def least_squares(rows: DataFrame, keys: list[str], features: list[str], label: str, penalty: float = 0.0, weight: str | None = None) -> DataFrame:
    """key, term, coefficient of ordinary (weighted, ridge) least squares by key."""
    names = ["1", *features, label]
    sums = gram(rows, keys, features, label, weight)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        m = np.array([[row[f"{names[min(i, j)]}*{names[max(i, j)]}"] for j in range(len(names))] for i in range(len(names))], float)
        beta = np.linalg.solve(m[:-1, :-1] + penalty * np.diag([0.0] + [1.0] * len(features)), m[:-1, -1])
        return pd.DataFrame({**{k: [row[k]] * len(beta) for k in keys}, "term": ["intercept", *features], "coefficient": beta})

    fields = {f.name: f for f in sums.schema.fields}
    schema = T.StructType([*(fields[k] for k in keys), T.StructField("term", T.StringType()), T.StructField("coefficient", T.DoubleType())])
    return sums.groupBy(*keys).applyInPandas(solve, schema)


def residual_pls(rows: DataFrame, keys: list[str], controls: list[str], components: list[str], label: str) -> DataFrame:
    """key, term, coefficient of a one-factor partial least squares on what controls leave of components and label.

    Components' residuals are standardised, weighed by their covariance with the label's residual, and make one
    score, on which that residual is regressed. All of it follows from one matrix of sums and products, so that
    the rows are read once; the coefficients are those of the raw terms."""
    features = [*controls, *components]
    names = ["1", *features, label]
    sums = gram(rows, keys, features, label)
    k = 1 + len(controls)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        m = np.array([[row[f"{names[min(i, j)]}*{names[max(i, j)]}"] for j in range(len(names))] for i in range(len(names))], float)
        on_controls = np.linalg.solve(m[:k, :k], m[:k, k:])
        left = m[k:, k:] - m[k:, :k] @ on_controls
        sd = np.sqrt(np.maximum(np.diag(left)[:-1] / m[0, 0], 1e-300))
        cov = left[:-1, -1] / sd
        w = cov / np.linalg.norm(cov)
        spread = (w / sd) @ left[:-1, :-1] @ (w / sd)
        per_component = (w @ cov) / spread * w / sd
        base = on_controls[:, -1] - on_controls[:, :-1] @ per_component
        beta = [*base, *per_component]
        return pd.DataFrame({**{c: [row[c]] * len(beta) for c in keys}, "term": ["intercept", *features], "coefficient": beta})

    fields = {f.name: f for f in sums.schema.fields}
    schema = T.StructType([*(fields[c] for c in keys), T.StructField("term", T.StringType()), T.StructField("coefficient", T.DoubleType())])
    return sums.groupBy(*keys).applyInPandas(solve, schema)


def lcg(seed: int, n: int) -> np.ndarray:
    """The first n values in [0, 1) of the linear congruential generator modulo 2^32, without a loop over them: its jumps double."""
    out = np.empty(n, np.uint64)
    if not n:
        return out.astype(float)
    mask = np.uint64(0xFFFFFFFF)
    a, c = np.uint64(1664525), np.uint64(1013904223)
    out[0] = (a * np.uint64(seed) + c) & mask
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = (a * out[:take] + c) & mask
        a, c = (a * a) & mask, (a * c + c) & mask
        have += take
    return out / 2.0**32


def block_bootstrap(rows: DataFrame, keys: list[str], value: str, block: int, draws: int, seed: int, factor: float = 1.0) -> DataFrame:
    """Quantiles of the mean of circular blocks drawn from each series in order of date: low (2.5 %), median, high and the share at or below zero."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("date")[value].dropna().to_numpy(float)
        n = len(v)
        per = -(-n // block)
        starts = (lcg(seed, per * draws) * n).astype(int).reshape(draws, per)
        cum = np.r_[0.0, np.cumsum(np.r_[v, v])]
        sizes = np.full(per, block)
        sizes[-1] = n - block * (per - 1)
        means = factor * (cum[starts + sizes] - cum[starts]).sum(axis=1) / n
        low, mid, high = np.quantile(means, [0.025, 0.5, 0.975])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [n], "low": [low], "median": [mid], "high": [high], "share_below": [float((means <= 0).mean())]})

    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([*(fields[k] for k in keys), T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("low", "median", "high", "share_below"))])
    return rows.groupBy(*keys).applyInPandas(run, schema)


def multi_rebalanced(wealth: float, risk: np.ndarray, weights: np.ndarray, cost: float, steps: int = 100) -> float:
    """Wealth after trading several assets to target weights of what is left after costs, by bisection."""
    low, high = 0.0, wealth
    for _ in range(steps):
        mid = (low + high) / 2
        if mid + cost * np.abs(weights * mid - risk).sum() > wealth:
            high = mid
        else:
            low = mid
    return (low + high) / 2


def rotation(rows: DataFrame, keys: list[str], assets: list[str], cost: float) -> DataFrame:
    """Wealth of a portfolio that is traded to the weights decided at the close before. rows: keys, date, the assets' closes, and a weight w_<asset> each, null where nothing is decided."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        price = pdf[assets].to_numpy(float)
        weight = pdf[[f"w_{a}" for a in assets]].to_numpy(float)
        wealth, risk, out = 1.0, np.zeros(len(assets)), []
        for t in range(len(pdf)):
            if t:
                grown = risk * price[t] / price[t - 1]
                wealth += grown.sum() - risk.sum()
                risk = grown
                if np.isfinite(weight[t - 1]).all():
                    wealth = multi_rebalanced(wealth, risk, weight[t - 1], cost)
                    risk = weight[t - 1] * wealth
            out.append(wealth)
        return pdf[[*keys, "date"]].assign(wealth=out)

    fields = {f.name: f for f in rows.schema.fields}
    return rows.groupBy(*keys).applyInPandas(fold, T.StructType([*(fields[c] for c in (*keys, "date")), T.StructField("wealth", T.DoubleType())]))


def identifiability(rows: DataFrame, keys: list[str], market: str, controls: list[str], regressor: str, markets: int, tolerance: float = 1e-12) -> DataFrame:
    """keys, rows, stage, residual_variance: whether the regressor has variation beyond the controls, before anything is fitted.

    Markets weigh the same, whatever their number of rows. Weighted sums of products are aggregated by market and then by keys; means, deviations and the residual variance, the Schur complement of the
    controls in the correlation matrix, come from them alone. Stages in order, the first that fails is named: weights (a market is missing), preprocessing (a
    feature doesn't vary), controls (they are collinear), residual variance (not above the tolerance); null if none fails. Rows with missing features are left out."""
    names = [*controls, regressor]
    whole = rows.dropna(subset=names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    per = whole.groupBy(*keys, market).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"m_{a}") for a in names), *(F.avg(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs))
    mean = [*(f"m_{a}" for a in names), *(f"p_{a}_{b}" for a, b in pairs)]
    sums = per.groupBy(*keys).agg(F.sum("n").alias("rows"), F.count("*").alias("markets"), *(F.avg(c).alias(c) for c in mean))

    def judge(batches):
        for pdf in batches:
            stages, left = [], []
            for r in pdf.to_dict("records"):
                m = np.array([r[f"m_{a}"] for a in names])
                s = np.zeros((len(names),) * 2)
                for a, b in pairs:
                    i, j = names.index(a), names.index(b)
                    s[i, j] = s[j, i] = r[f"p_{a}_{b}"] - m[i] * m[j]
                sd = np.sqrt(np.maximum(np.diag(s), 0))
                stage, v = None, None
                if r["markets"] != markets:
                    stage = "weights"
                elif (sd <= 1e-12 * np.maximum(1, np.abs(m))).any():
                    stage = "preprocessing"
                else:
                    c = s / np.outer(sd, sd)
                    if np.linalg.eigvalsh(c[:-1, :-1])[0] <= tolerance:
                        stage = "controls"
                    else:
                        v = float(max(0.0, c[-1, -1] - c[-1, :-1] @ np.linalg.solve(c[:-1, :-1], c[:-1, -1])))
                        stage = "residual variance" if v <= max(tolerance, 1e-10) else None
                stages.append(stage)
                left.append(v)
            yield pdf[[*keys, "rows"]].assign(stage=stages, residual_variance=left)

    fields = {f.name: f for f in sums.schema.fields}
    return sums.mapInPandas(judge, T.StructType([*(fields[k] for k in keys), T.StructField("rows", T.LongType()), T.StructField("stage", T.StringType()), T.StructField("residual_variance", T.DoubleType())]))
