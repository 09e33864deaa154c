"""Deterministic samples: the same rows for the same seed, whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix(rows: DataFrame, n: int) -> DataFrame:
    """Rows with ids under ``n``; not ``limit``, which has no order."""
    return rows.filter(F.col("id") < n)


def reservoir(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows without replacement: those with the smallest seeded hashes of their id."""
    return rows.withColumn("__h", F.xxhash64(F.lit(seed), "id")).orderBy("__h", "id").limit(n).drop("__h")


def disjoint(rows: DataFrame, taken: DataFrame, n: int, seed: int = 43) -> DataFrame:
    """``n`` rows that aren't in ``taken(id)``; raises if fewer are left."""
    left = rows.join(taken.select("id"), "id", "left_anti")
    out = reservoir(left, n, seed)
    if (have := left.count()) < n:
        raise ValueError(f"{n} rows asked for, {have} left")
    return out


def gather(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows named by ``wanted(id[, pos])``, with their ``pos`` if it has one; order by it where order matters."""
    return wanted.join(rows, "id")


def split(rows: DataFrame, n_base: int, n_query: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Disjoint (base, queries) of a source, both as (id, vec, source_row) with new ids from 0."""
    from fadeline.operators.windows import global_rank

    base = reservoir(rows, n_base, seed)
    query = disjoint(rows, base, n_query, seed + 1)
    number = lambda d: global_rank(d, ["id"], "__new").select(F.col("__new").alias("id"), "vec", F.col("id").alias("source_row"))
    return number(base), number(query)


def uniform_times(rows: DataFrame, horizon: float = 365.0, seed: int = 42) -> DataFrame:
    """``rows`` with ``ts_days`` uniform in [0, horizon], a function of seed and id."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return rows.withColumn("ts_days", (u * horizon).cast("float"))


def clustered_times(rows: DataFrame, centres: DataFrame, horizon: float = 365.0, sigma: float | None = None, seed: int = 42) -> DataFrame:
    """``rows(id, cluster_id)`` with times normal around their cluster's ``centre``, truncated to [0, horizon].

    Of 32 hashed draws the first inside the range counts; the centre itself if none is.
    """
    sigma = horizon / 12 if sigma is None else sigma
    # centres: one row per cluster, a number that the caller chose; Spark decides how to join
    x = rows.join(centres, "cluster_id")
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    draws = [F.col("centre") + sigma * F.sqrt(-2 * F.log(u(2 * k))) * F.cos(2 * math.pi * u(2 * k + 1)) for k in range(32)]
    inside = F.coalesce(*(F.when(d.between(0.0, horizon), d) for d in draws), F.col("centre"))
    return x.withColumn("ts_days", inside.cast("float")).drop("centre")


def cluster_centres(spark, clusters: int, horizon: float = 365.0, seed: int = 42) -> DataFrame:
    """(cluster_id, centre) with centres uniform over the horizon."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), "id"), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return spark.range(clusters).select(F.col("id").cast("int").alias("cluster_id"), (u * horizon).alias("centre"))
