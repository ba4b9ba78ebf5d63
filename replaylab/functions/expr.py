"""Pure ``Column`` functions: unit conversion, levels, labels and statistics.

Everything here is a JVM-side expression; nothing calls back into Python.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- durations

def _half_up_div(ms: ColumnOrName, unit_ms: int) -> Column:
    """``ms / unit_ms`` rounded half-up to 2 dp, in integer arithmetic.

    Rounding the double would make results depend on binary representation
    (0.015 -> 0.01 or 0.02 by engine); integer rounding is exact everywhere.
    """
    step = unit_ms // 100
    shifted = _c(ms).cast("bigint") + F.lit(step // 2)
    # Integer division (`div`): exact for every BIGINT, no double rounding.
    quotient = F.call_function("div", shifted, F.lit(step))
    return quotient / F.lit(100)


def minutes(ms: ColumnOrName) -> Column:
    """Milliseconds to minutes, 2 dp half-up."""
    return _half_up_div(ms, 60_000)


def hours(ms: ColumnOrName) -> Column:
    """Milliseconds to hours, 2 dp half-up."""
    return _half_up_div(ms, 3_600_000)


def days(ms: ColumnOrName) -> Column:
    """Milliseconds to days, 2 dp half-up."""
    return _half_up_div(ms, 86_400_000)


def raw_minutes(ms: ColumnOrName) -> Column:
    """Milliseconds to minutes, unrounded."""
    return _c(ms) / F.lit(60_000.0)


# ---------------------------------------------------------------- calendar

def activity_level(count: ColumnOrName) -> Column:
    """Heatmap intensity: 0 -> 0, <=8 -> 1, <=20 -> 2, <=40 -> 3, else 4."""
    c = _c(count)
    # Level thresholds of the activity calendar.
    return (
        F.when(c <= 0, 0).when(c <= 8, 1).when(c <= 20, 2).when(c <= 40, 3).otherwise(4)
    ).cast("int")


DAY_US = 86_400_000_000


def day(ts: ColumnOrName, tz: str | None = None) -> Column:
    """Calendar day of an instant in UTC, or in ``tz``; the session's time zone has no say."""
    t = _c(ts) if tz is None else F.from_utc_timestamp(_c(ts), tz)
    us = F.unix_micros(t)
    # Floor division (instants before 1970 too).
    whole = F.call_function("div", us - F.pmod(us, F.lit(DAY_US)), F.lit(DAY_US))
    return F.date_from_unix_date(whole.cast("int"))


def year(ts: ColumnOrName, tz: str | None = None) -> Column:
    """Calendar year of an instant in UTC, or in ``tz``."""
    return F.year(day(ts, tz))


def iso_text(ts: ColumnOrName) -> Column:
    """``2024-01-31T10:00:00.000000Z`` of an instant, whatever the session's time zone."""
    t = F.pmod(F.unix_micros(_c(ts)), F.lit(DAY_US))

    def part(unit_us: int, size: int) -> Column:
        return F.pmod(F.call_function("div", t, F.lit(unit_us)), F.lit(size))

    return F.when(_c(ts).isNotNull(), F.format_string(
        "%sT%02d:%02d:%02d.%06dZ", day(ts).cast("string"), part(3_600_000_000, 24), part(60_000_000, 60),
        part(1_000_000, 60), part(1, 1_000_000)))


def instant(text: str) -> Column:
    """An ISO date or date-time as a foldable timestamp literal; without an offset it is UTC."""
    t = dt.datetime.fromisoformat(text)
    t = t.replace(tzinfo=dt.UTC) if t.tzinfo is None else t
    return F.timestamp_micros(F.lit((t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)))


def months_before(ts: ColumnOrName, months: int) -> Column:
    """The instant ``months`` calendar months (UTC) earlier at the same time of day."""
    us = F.unix_micros(_c(ts))
    return F.timestamp_micros(F.unix_date(F.add_months(day(ts), -months)).cast("bigint") * F.lit(DAY_US) + F.pmod(us, F.lit(DAY_US)))


def days_before(ts: ColumnOrName, days_: int) -> Column:
    """The instant ``days_`` days of 24 hours earlier."""
    return F.timestamp_micros(F.unix_micros(_c(ts)) - F.lit(days_ * DAY_US))


def month_key(ts: ColumnOrName) -> Column:
    """``YYYY-MM`` of a date."""
    return F.date_format(_c(ts), "yyyy-MM")


def month_long_label(month_start: ColumnOrName) -> Column:
    """``January 2024``."""
    return F.date_format(_c(month_start), "MMMM yyyy")


def month_short_label(month_start: ColumnOrName) -> Column:
    """``JAN '24``."""
    return F.upper(F.date_format(_c(month_start), "MMM ''yy"))


def with_default(name: ColumnOrName, default: str) -> Column:
    """Null or empty label -> a fixed default label."""
    c = _c(name)
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


# ---------------------------------------------------------------- statistics

# Lanczos approximation, g = 7, nine coefficients.
_LANCZOS_G = 7.0
_LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)
_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)


def lgamma(x: ColumnOrName) -> Column:
    """log Gamma(x) for x >= 0.5 (all we need: x >= 1)."""
    z = _c(x).cast("double") - F.lit(1.0)
    series = F.lit(_LANCZOS[0])
    for i, coef in enumerate(_LANCZOS[1:], start=1):
        series = series + F.lit(coef) / (z + F.lit(float(i)))
    t = z + F.lit(_LANCZOS_G + 0.5)
    return F.lit(_HALF_LOG_2PI) + (z + F.lit(0.5)) * F.log(t) - t + F.log(series)


_TINY = 1e-300


def _stirling_rest(z: Column) -> Column:
    """log Gamma(z) less Stirling's (z - 1/2) log z - z + log(2 pi)/2; the series from z = 16, the difference below."""
    r = F.lit(1.0) / (z * z)
    series = (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * (F.lit(1 / 1260) - r * (F.lit(1 / 1680) - r * F.lit(1 / 1188))))) / z
    small = F.least(z, F.lit(16.0))
    return F.when(z >= F.lit(16.0), series).otherwise(
        lgamma(small) - (small - F.lit(0.5)) * F.log(small) + small - F.lit(_HALF_LOG_2PI))


def log_beta_front(a: Column, b: Column, x: Column) -> Column:
    """log of x^a (1 - x)^b / B(a, b) for 0 < x < 1, without the cancellation of three large log Gammas.

    With n = a + b and d = x n - a it is a log(1 + d/a) + b log(1 - d/b) + log(a b / (2 pi n)) / 2
    plus the Stirling rests: every large term is gone before the logarithms.
    """
    n = a + b
    d = x * n - a
    tiny = F.lit(-1.0 + 1e-16)
    return (a * F.log1p(F.greatest(d / a, tiny)) + b * F.log1p(F.greatest(-d / b, tiny))
            + F.lit(0.5) * F.log(a / n * b) - F.lit(_HALF_LOG_2PI)
            + _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b))



def _betacf(a: Column, b: Column, x: Column, iterations: Column) -> Column:
    """Continued fraction of the incomplete beta (modified Lentz), as a fold."""
    qab, qap, qam = a + b, a + F.lit(1.0), a - F.lit(1.0)

    def clamp(v: Column) -> Column:
        return F.when(F.abs(v) < F.lit(_TINY), F.lit(_TINY)).otherwise(v)

    d0 = F.lit(1.0) / clamp(F.lit(1.0) - qab * x / qap)
    init = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def step(acc: Column, m_int: Column) -> Column:
        m = m_int.cast("double")
        m2 = m * F.lit(2.0)
        # even step
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d1 = F.lit(1.0) / clamp(F.lit(1.0) + aa * acc["d"])
        c1 = clamp(F.lit(1.0) + aa / acc["c"])
        h1 = acc["h"] * d1 * c1
        # odd step
        aa2 = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d2 = F.lit(1.0) / clamp(F.lit(1.0) + aa2 * d1)
        c2 = clamp(F.lit(1.0) + aa2 / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (h1 * d2 * c2).alias("h"))

    folded = F.aggregate(F.sequence(F.lit(1), iterations), init, step)
    return folded["h"]


def betainc(a: ColumnOrName, b: ColumnOrName, x: ColumnOrName) -> Column:
    """Regularised incomplete beta ``I_x(a, b)`` for a, b >= 1, 0 <= x <= 1.

    The continued fraction converges fast for x < (a+1)/(a+b+2); otherwise
    the symmetry ``I_x(a,b) = 1 - I_{1-x}(b,a)`` is used.  The orientation
    is chosen per row first, so only ONE fold of O(sqrt(max(a, b))) steps runs.
    """
    a, b, x = _c(a).cast("double"), _c(b).cast("double"), _c(x).cast("double")
    direct = x < (a + F.lit(1.0)) / (a + b + F.lit(2.0))
    aa = F.when(direct, a).otherwise(b)
    bb = F.when(direct, b).otherwise(a)
    xx = F.when(direct, x).otherwise(F.lit(1.0) - x)
    iterations = (F.lit(60.0) + F.lit(6.0) * F.sqrt(F.greatest(a, b))).cast("int")
    log_front = log_beta_front(a, b, x)
    part = F.exp(log_front) * _betacf(aa, bb, xx, iterations) / aa
    value = F.when(direct, part).otherwise(F.lit(1.0) - part)
    return (
        F.when(x <= F.lit(0.0), F.lit(0.0))
        .when(x >= F.lit(1.0), F.lit(1.0))
        .otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
    )


def with_binom_sf(df: "DataFrame", k: str, n: str, p: str, out: str = "p_value") -> "DataFrame":
    """Add ``out = P(X >= k)``, ``X ~ Bin(n, p)``, computed in stages.

    Same result as :func:`binom_sf`, but the fold's inputs (orientation,
    iteration count, log prefactor) are first materialised as plain columns,
    so the lambda reads attributes instead of re-evaluating expressions on
    every step.  Cost per row: one fold of O(sqrt(n)) steps.
    """
    kk, nn, pp = F.col(k).cast("double"), F.col(n).cast("double"), F.col(p).cast("double")
    a, b, x = F.col("__a"), F.col("__b"), F.col("__x")
    # Clamp to the domain: rows outside it take an exact branch below, but
    # every staged column is still evaluated (ANSI division must not fail).
    s1 = df.withColumns({
        "__a": F.greatest(kk, F.lit(1.0)),
        "__b": F.greatest(nn - kk + F.lit(1.0), F.lit(1.0)),
        "__x": F.least(F.greatest(pp, F.lit(0.0)), F.lit(1.0)),
    })
    direct = x < (a + F.lit(1.0)) / (a + b + F.lit(2.0))
    s2 = s1.withColumns({
        "__dir": direct,
        "__aa": F.when(direct, a).otherwise(b),
        "__bb": F.when(direct, b).otherwise(a),
        "__xx": F.when(direct, x).otherwise(F.lit(1.0) - x),
        "__it": (F.lit(60.0) + F.lit(6.0) * F.sqrt(F.greatest(a, b))).cast("int"),
        "__lf": log_beta_front(a, b, x),
    })
    usable = (kk >= F.lit(1.0)) & (kk <= nn) & (pp > F.lit(0.0)) & (pp < F.lit(1.0))
    s3 = s2.withColumn(
        "__cf", F.when(usable, _betacf(F.col("__aa"), F.col("__bb"), F.col("__xx"), F.col("__it")))
    )
    part = F.exp(F.col("__lf")) * F.col("__cf") / F.col("__aa")
    value = F.when(F.col("__dir"), part).otherwise(F.lit(1.0) - part)
    tail = (
        F.when(kk <= F.lit(0.0), F.lit(1.0))
        .when(kk > nn, F.lit(0.0))
        .when(pp <= F.lit(0.0), F.lit(0.0))
        .when(pp >= F.lit(1.0), F.lit(1.0))
        .otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
    )
    return s3.withColumn(out, tail).drop("__a", "__b", "__x", "__dir", "__aa", "__bb", "__xx",
                                         "__it", "__lf", "__cf")


def binom_sf(k: ColumnOrName, n: ColumnOrName, p: ColumnOrName) -> Column:
    """One-sided binomial tail ``P(X >= k)``, ``X ~ Bin(n, p)``.

    ``P(X >= k) = I_p(k, n - k + 1)`` for ``1 <= k <= n``; ``k <= 0`` gives 1,
    ``k > n`` gives 0.  p in {0, 1} is handled exactly.
    """
    k, n, p = _c(k).cast("double"), _c(n).cast("double"), _c(p).cast("double")
    return (
        F.when(k <= F.lit(0.0), F.lit(1.0))
        .when(k > n, F.lit(0.0))
        .when(p <= F.lit(0.0), F.lit(0.0))
        .when(p >= F.lit(1.0), F.lit(1.0))
        .otherwise(betainc(F.greatest(k, F.lit(1.0)), F.greatest(n - k + F.lit(1.0), F.lit(1.0)), p))
    )


# Fixed value: two-sided 95 % normal quantile.
Z_95 = 1.959963984540054


def wilson_bounds(k: ColumnOrName, n: ColumnOrName, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score interval (low, high) for k successes out of n."""
    k, n = _c(k).cast("double"), _c(n).cast("double")
    z2 = F.lit(z * z)
    phat = k / n
    denom = F.lit(1.0) + z2 / n
    centre = (phat + z2 / (F.lit(2.0) * n)) / denom
    half = F.lit(z) * F.sqrt(phat * (F.lit(1.0) - phat) / n + z2 / (F.lit(4.0) * n * n)) / denom
    guard = n > F.lit(0.0)
    return (F.when(guard, centre - half), F.when(guard, centre + half))


def neg_log10_p(p: ColumnOrName) -> Column:
    """``-log10(max(p, 1e-300))`` (``0 - x`` so that p = 1 gives +0.0, not -0.0)."""
    return F.lit(0.0) - F.log10(F.greatest(_c(p), F.lit(1e-300)))
