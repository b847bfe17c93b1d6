"""Scalar rules on columns: keys, guarded division, saturation curves, bands, dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_MILES = 3959.0

# Market region of each state code.
REGION_STATES: dict[str, tuple[str, ...]] = {
    "Northeast": ("CT", "DC", "DE", "MA", "MD", "ME", "NH", "NJ", "NY", "PA", "RI", "VT"),
    "Southeast": ("AL", "AR", "FL", "GA", "KY", "LA", "MS", "NC", "SC", "TN", "VA", "WV"),
    "Midwest": ("IA", "IL", "IN", "KS", "MI", "MN", "MO", "ND", "NE", "OH", "SD", "WI"),
    "Southwest": ("OK", "TX"),
    "West": ("AK", "AZ", "CA", "CO", "HI", "ID", "MT", "NM", "NV", "OR", "UT", "WA", "WY"),
}


def channel_key(name: Column) -> Column:
    """Lower case; `` - ``, ``-`` and blanks become underscores, in that order."""
    out = F.lower(name)
    for token in (" - ", "-", " "):
        out = F.replace(out, F.lit(token), F.lit("_"))
    return out


def zip_prefix(zip_code: Column) -> Column:
    """First three characters, NULL when the code is shorter."""
    z = F.trim(zip_code)
    return F.when(F.length(z) >= 3, F.substring(z, 1, 3))


def zip5(zip_code: Column) -> Column:
    return F.substring(F.trim(F.coalesce(zip_code, F.lit(""))), 1, 5)


def first_segment(text: Column, sep: str = ",") -> Column:
    return F.trim(F.substring_index(text, sep, 1))


def last_segment(text: Column, sep: str = "/") -> Column:
    return F.substring_index(text, sep, -1)


def zero_if_undefined(num: Column, den: Column) -> Column:
    """num/den, or 0 where the denominator is not positive or missing."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def null_if_undefined(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def nan_if_undefined(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(float("nan")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def hill_revenue(spend: Column, r_max: Column, k: Column, alpha: Column) -> Column:
    """r·s^a/(k^a+s^a), spend and k floored at 1e-10."""
    s = F.pow(F.greatest(spend, F.lit(1e-10)), alpha)
    half = F.pow(F.greatest(k, F.lit(1e-10)), alpha)
    return r_max * s / (half + s)


def hill_slope(spend: Column, r_max: Column, k: Column, alpha: Column) -> Column:
    """Derivative of :func:`hill_revenue`; 0 where the denominator vanishes."""
    s = F.greatest(spend, F.lit(1e-10))
    half, power = F.pow(k, alpha), F.pow(s, alpha)
    den = (half + power) * (half + power)
    return F.when(den < 1e-20, F.lit(0.0)).otherwise(r_max * alpha * half * F.pow(s, alpha - 1.0) / den)


def hill_share(x: Column, alpha: Column, gamma: Column) -> Column:
    """Normalised saturation x^α/(x^α+γ^α) with x clipped at 0."""
    p = F.pow(F.greatest(x, F.lit(0.0)), alpha)
    return p / (p + F.pow(gamma, alpha))


def marginal_step(spend: Column) -> Column:
    """1 % of the spend or 100, whichever is larger."""
    return F.greatest(spend * 0.01, F.lit(100.0))


def central_marginal(revenue, spend: Column, step: Column) -> Column:
    """Slope of ``revenue(spend)`` over one step centred on ``spend``, the lower end clipped at 0."""
    low = F.greatest(spend - step / 2, F.lit(0.0))
    return (revenue(spend + step / 2) - revenue(low)) / step


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2.0 * EARTH_RADIUS_MILES * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def region_of_state(state: Column) -> Column:
    out = None
    for region, states in REGION_STATES.items():
        hit = state.isin(*states)
        out = F.when(hit, region) if out is None else out.when(hit, region)
    return out.otherwise("Other")


def banded(x: Column, cuts: list[tuple[float, str]], above: str) -> Column:
    """Label of the first cut that ``x`` lies strictly below."""
    out = F.when(x < cuts[0][0], cuts[0][1])
    for cut, label in cuts[1:]:
        out = out.when(x < cut, label)
    return out.otherwise(above)


def next_monday(day: Column) -> Column:
    """The Monday strictly after ``day`` (a Monday moves a full week)."""
    return F.next_day(day, "Mon")


def plus_weeks(day: Column, weeks: Column) -> Column:
    return F.date_add(day, (weeks * 7).cast("int"))


def local_day(stamp: Column) -> Column:
    """Calendar day written in an ISO string, whatever its offset."""
    return F.to_date(F.substring(stamp, 1, 10))


def inclusive_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def monday_week(day: Column) -> Column:
    """``%Y-%W``: weeks start on Monday and split at the new year."""
    week = F.floor((F.dayofyear(day) - 1 + 7 - F.weekday(day)) / 7)
    return F.concat(F.year(day).cast("string"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def monday_of(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def add_all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)
