"""Scores and distances as Column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fadeline.config import Decay, Mode, PairMode, Schedule, decay_rate


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision, terms added in order; null if the lengths differ."""
    a, b = _col(a), _col(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clamped_dot(a: Column | str, b: Column | str) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def negative_dot(a: Column | str, b: Column | str) -> Column:
    return -dot(a, b)


def squared_norm(v: Column | str) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def norm(v: Column | str) -> Column:
    return F.sqrt(squared_norm(v))


def angular_distance(q: Column | str, x: Column | str) -> Column:
    """-dot / |x|."""
    return -dot(q, x) / norm(x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(v: Column | str, strict: bool = False) -> Column:
    """The vector at length 1 in single precision. A (near) zero vector stays as it is, or raises if ``strict``."""
    v, n = _col(v), norm(v)
    scaled = F.transform(v, lambda x: (x * (1.0 / n).cast("float")).cast("float"))
    if strict:
        bad = F.isnull(n) | F.isnan(n) | (n <= 1e-12) | (n == float("inf"))
        return F.when(bad, F.raise_error(F.lit("a vector without a finite, positive length can't be normalised"))).otherwise(scaled)
    return F.when(n > 1e-12, scaled).otherwise(v)


def bounded_time(ts: Column | str, horizon: Column | float) -> Column:
    """Days before the horizon, as a number that isn't positive for past times."""
    return _col(ts).cast("double") - (F.lit(horizon) if isinstance(horizon, (int, float)) else horizon)


def freshness(ts: Column | str, tau: Column | float, half_life: float) -> Column:
    """exp(-rate * (tau - ts)); Catalyst folds the rate to a constant."""
    return F.exp(F.lit(decay_rate(half_life)) * bounded_time(ts, tau))


def guarded_freshness(ts: Column | str, tau: Column | str, c: Decay) -> Column:
    """Freshness that takes times up to the slack in the future for now and raises beyond."""
    age = _col(tau).cast("double") - _col(ts).cast("double")
    late = F.when(age < -c.future_slack, F.raise_error(F.lit("a row is newer than the query's time"))).otherwise(F.greatest(age, F.lit(0.0)))
    return F.exp(-F.lit(c.rate) * late)


def combine(semantic: Column, fresh: Column, mode: Mode, alpha: float = 1.0) -> Column:
    if mode is Mode.MULTIPLICATIVE:
        return semantic * fresh
    return alpha * semantic + (1.0 - alpha) * fresh if mode is Mode.ADDITIVE else semantic


def query_distance(q: Column | str, x: Column | str, ts: Column | str, tau: Column | str, c: Decay) -> Column:
    """1 - score; rounding noise just under zero counts as zero."""
    d = 1.0 - combine(clamped_dot(q, x), guarded_freshness(ts, tau, c), c.mode, c.alpha)
    return F.when((d < 0) & (d > -1e-7), F.lit(0.0)).otherwise(d)


def kappa(level: Column | str, c: Decay) -> Column:
    """The schedule as an expression over a level column."""
    level = _col(level)
    if c.schedule is Schedule.PER_LEVEL:
        return F.element_at(F.array(*map(F.lit, c.kappa_levels)), F.least(level + 1, F.lit(len(c.kappa_levels))).cast("int"))
    return F.when(level > 0, F.lit(c.kappa_nav)).otherwise(F.lit(c.kappa_base)) if c.schedule is Schedule.TWO_TIER else F.lit(c.kappa_base)


def pair_distance(a: Column | str, b: Column | str, ta: Column | str, tb: Column | str, level: Column | str | int, c: Decay) -> Column:
    """Distance of two stored rows, as edges of a graph at ``level`` see it. Symmetric, never negative."""
    away = 1.0 - clamped_dot(a, b)
    if c.pair_mode is PairMode.SEMANTIC:
        return away
    k = F.lit(c.kappa(level)) if isinstance(level, int) else kappa(level, c)
    x = F.lit(c.rate) * F.abs(_col(ta).cast("double") - _col(tb).cast("double"))
    fresh, faded = F.exp(-x), -F.expm1(-x)
    d = 2.0 * faded + 2.0 * (fresh + k) * away if c.mode is Mode.MULTIPLICATIVE else 2.0 * (c.alpha + k) * away + 2.0 * (1.0 - c.alpha) * faded
    return F.when((d < 0) & (d > -1e-8), F.lit(0.0)).otherwise(d)


def decay_basis(ts: Column | str, origin: float, c: Decay) -> Column:
    """exp(rate * (t - origin)): a stored column by which scores need no exponential per pair."""
    return F.exp(F.lit(c.rate) * (_col(ts).cast("double") - origin))


def fast_freshness(basis: Column | str, ts: Column | str, tau: Column | str, origin: float, c: Decay) -> Column:
    """exp(-rate * (tau - origin)) * basis, or the direct form where that would over- or underflow."""
    g = F.exp(-F.lit(c.rate) * (_col(tau).cast("double") - origin))
    p = g * _col(basis)
    fits = (g > 1e-300) & (g < 1e300) & (_col(basis) > 1e-300) & (_col(basis) < 1e300) & (p <= 1.0 + 32 * 2.220446049250313e-16)
    return F.when(fits, F.least(p, F.lit(1.0))).otherwise(F.exp(-F.lit(c.rate) * F.greatest(_col(tau).cast("double") - _col(ts).cast("double"), F.lit(0.0))))


def fast_pair_freshness(za: Column | str, zb: Column | str, ta: Column | str, tb: Column | str, c: Decay) -> Column:
    """The older basis over the newer; the direct form where equal bases hide different times."""
    za, zb, ta, tb = map(_col, (za, zb, ta, tb))
    direct = F.exp(-F.lit(c.rate) * F.abs(ta.cast("double") - tb.cast("double")))
    hidden = ((za == zb) & (ta != tb)) | (za <= 0) | (zb <= 0)
    return F.when(hidden, direct).otherwise(F.least(za, zb) / F.greatest(za, zb))
