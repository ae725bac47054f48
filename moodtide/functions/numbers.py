"""Column expressions on numbers: rounding, score bands, tests' tail probabilities, growth factors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bounds of the bands (on one-decimal scores, and on integers) and their labels.
BANDS = (0.0, 25.0, 45.0, 56.0, 75.0)
LABELS = ("Extreme Fear", "Fear", "Neutral", "Greed", "Extreme Greed")
DAYS_PER_YEAR = 365.2425


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def displayed(score: Column) -> Column:
    """The integer that is shown: rounded to one decimal, then to none."""
    return F.floor(half_up(score, 1) + 0.5).cast("int")


def band(rounded: Column) -> Column:
    """The index of the band of an already rounded score; null outside 0 to 100."""
    steps = F.lit(0)
    for bound in BANDS[1:]:
        steps = steps + F.when(rounded >= bound, 1).otherwise(0)
    return F.when((rounded >= 0) & (rounded <= 100), steps)


def label(score: Column) -> Column:
    return F.get(F.array(*map(F.lit, LABELS)), band(half_up(score, 1)))


def legacy_label(score: Column) -> Column:
    return F.get(F.array(*map(F.lit, LABELS)), band(displayed(score).cast("double")))


def decision(score: Column, buy_at_most: float, sell_at_least: float) -> Column:
    shown = displayed(score)
    return F.when(shown <= buy_at_most, "BUY").when(shown >= sell_at_least, "SELL").when(shown.isNotNull(), "HOLD")


def overlay_exposure(score: Column, fear: float = 24, greed: float = 75) -> Column:
    """1.5 in fear, 0.5 in greed, else 1.0, by the raw score."""
    return F.when(score <= fear, 1.5).when(score >= greed, 0.5).when(score.isNotNull(), 1.0)


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; error below 1.5e-7."""
    z = F.abs(x)
    t = 1 / (1 + 0.3275911 * z)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - poly * F.exp(-z * z))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / F.sqrt(F.lit(2.0))))


#: Coefficients of the rational functions for the error function (below 1), and for its complement times exp(x squared) from 1 to 8 and beyond, highest power first; denominators begin with 1.
ERF = ((9.60497373987051638749, 90.0260197203842689217, 2232.00534594684319226, 7003.32514112805075473, 55592.3013010394962768), (1.0, 33.5617141647503099647, 521.357949780152679795, 4594.32382970980127987, 22629.0000613890934246, 49267.3942608635921086))
ERFC_NEAR = (
    (2.46196981473530512524e-10, 0.564189564831068821977, 7.46321056442269912687, 48.6371970985681366614, 196.520832956077098242, 526.445194995477358631, 934.528527171957607540, 1027.55188689515710272, 557.535335369399327526),
    (1.0, 13.2281951154744992508, 86.7072140885989742329, 354.937778887819891062, 975.708501743205489753, 1823.90916687909736289, 2246.33760818710981792, 1656.66309194161350182, 557.535340817727675546),
)
ERFC_FAR = (
    (0.564189583547755073984, 1.27536670759978104416, 5.01905042251180477414, 6.16021097993053585195, 7.40974269950448939160, 2.97886665372100240670),
    (1.0, 2.26052863220117276590, 9.39603524938001434673, 12.0489539808096656605, 17.0814450747565897222, 9.60896809063285878198, 3.36907645100081516050),
)


def _ratio(x: Column, parts: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    def value(coefficients: tuple[float, ...]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    return value(parts[0]) / value(parts[1])


def erfc(x: Column) -> Column:
    """The complement of the error function with full relative accuracy as far as doubles reach (0 beyond 26.6). The square of x is split, so that
    its rounding doesn't show in the exponential."""
    a = F.abs(x)
    head = F.floor(a * 128 + 0.5) / 128
    rest = a - head
    falling = F.exp(-head * head) * F.exp(-(2 * head + rest) * rest)
    tail = falling * F.when(a < 8, _ratio(a, ERFC_NEAR)).otherwise(_ratio(a, ERFC_FAR))
    tail = F.when(a > 27, 0.0).otherwise(tail)
    return F.when(x.isNull() | F.isnan(x), x).when(a < 1, 1 - x * _ratio(x * x, ERF)).when(x < 0, 2 - tail).otherwise(tail)


def normal_survival(z: Column) -> Column:
    """The probability above z under the normal distribution, accurate in the tail."""
    return 0.5 * erfc(z / F.sqrt(F.lit(2.0)))


def discount_growth(percent: Column, days: Column) -> Column:
    """Growth over some days at a bill's bank-discount yield."""
    return F.pow(1 / (1 - percent / 100 * 91 / 360), days / 91)


def rebalanced_risk(wealth: Column, risk: Column, target: Column, cost: float) -> Column:
    """The risky amount after trading to a target share of the wealth that is left after the cost of trading."""
    buy = target * (wealth + cost * risk) / (1 + target * cost)
    sell = target * (wealth - cost * risk) / (1 - target * cost)
    return F.when(target * wealth > risk, buy).when(target * wealth < risk, sell).otherwise(risk)


def years_between(first: Column, last: Column) -> Column:
    return F.datediff(last, first) / DAYS_PER_YEAR
