"""Rewrites of time-decayed scores as plain inner products, in the single precision that stores have."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadeline.functions import score as S


def _f32(x: float | Column) -> Column:
    return (F.lit(x) if isinstance(x, (int, float)) else x).cast("float")


def multiplicative_base(vec: Column | str, ts: Column | str, horizon: float, half_life: float, normalize: bool = False) -> Column:
    """decay * x; with ``normalize`` decay * x / |x|, and zeros for a zero vector."""
    v = F.col(vec) if isinstance(vec, str) else vec
    decay = S.freshness(ts, horizon, half_life)
    if not normalize:
        return F.transform(v, lambda x: (_f32(decay) * x).cast("float"))
    n = S.norm(v)
    scale = F.when(n > 1e-12, decay / n).otherwise(F.lit(0.0))
    return F.transform(v, lambda x: (_f32(scale) * x).cast("float"))


def additive_base(vec: Column | str, ts: Column | str, horizon: float, half_life: float, alpha: float, normalize: bool = False) -> Column:
    """[sqrt(alpha) x, sqrt(1 - alpha) decay]."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.concat(_scaled(v, math.sqrt(alpha), normalize), F.array((_f32(math.sqrt(1 - alpha)) * _f32(S.freshness(ts, horizon, half_life))).cast("float")))


def additive_query(qvec: Column | str, alpha: float, normalize: bool = False) -> Column:
    """[sqrt(alpha) q, sqrt(1 - alpha)]."""
    v = F.col(qvec) if isinstance(qvec, str) else qvec
    return F.concat(_scaled(v, math.sqrt(alpha), normalize), F.array(_f32(math.sqrt(1 - alpha))))


def _scaled(v: Column, by: float, normalize: bool) -> Column:
    scale = _f32(by)
    if normalize:
        n = S.norm(v)
        scale = F.when(n > 1e-12, _f32(F.lit(by) / n)).otherwise(_f32(0.0))
    return F.transform(v, lambda x: (scale * x).cast("float"))


def alignment(expected: DataFrame, actual: DataFrame, absolute: float = 1e-7, relative: float = 1e-6) -> DataFrame:
    """One row: how far ``actual(id, vec)`` is from ``expected(id, vec)``, element by element.

    Columns: rows, elements, mismatches (beyond absolute + relative * |expected|), missing (ids on one
    side only, or lengths that differ), max_abs_error, max_rel_error, aligned.
    """
    both = expected.select("id", F.col("vec").alias("e")).join(actual.select("id", F.col("vec").alias("a")), "id", "full")
    whole = F.col("e").isNotNull() & F.col("a").isNotNull() & (F.size("e") == F.size("a"))
    pairs = F.when(whole, F.zip_with("e", "a", lambda e, a: F.struct(F.abs(e.cast("double") - a.cast("double")).alias("d"), F.abs(e.cast("double")).alias("m"))))
    per = both.select(whole.alias("whole"), pairs.alias("p")).select(
        "whole", F.coalesce(F.size("p"), F.lit(0)).alias("n"),
        F.size(F.filter("p", lambda x: x["d"] > absolute + relative * x["m"])).alias("bad"),
        F.array_max(F.transform("p", lambda x: x["d"])).alias("worst"),
        F.array_max(F.transform("p", lambda x: x["d"] / F.greatest(x["m"], F.lit(1e-12)))).alias("worst_rel"))
    out = per.agg(F.count("*").alias("rows"), F.sum(F.greatest("n", F.lit(0))).alias("elements"), F.sum(F.when(F.col("whole"), F.col("bad")).otherwise(0)).alias("mismatches"),
                  F.count_if(~F.col("whole")).alias("missing"), F.max("worst").alias("max_abs_error"), F.max("worst_rel").alias("max_rel_error"))
    return out.withColumn("aligned", (F.col("mismatches") == 0) & (F.col("missing") == 0))
