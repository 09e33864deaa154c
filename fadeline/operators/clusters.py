"""Spherical k-means, per-cluster statistics and summaries of times."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy().astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def seed_centroids(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ on unit vectors, with 1 - cosine as the distance; repeats of a point are never drawn twice while others are left."""
    rng = np.random.default_rng(seed)
    out = [sample[rng.integers(len(sample))]]
    gap = np.full(len(sample), np.inf)
    for _ in range(1, k):
        gap = np.minimum(gap, np.maximum(1.0 - sample @ out[-1], 0.0))
        total = gap.sum()
        out.append(sample[rng.choice(len(sample), p=gap / total) if total > 0 else rng.integers(len(sample))])
    return np.array(out)


def spherical_kmeans(rows: DataFrame, k: int, training: int = 256_000, rounds: int = 15, seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """(unit centroids, rows with ``cluster_id``) of ``rows(id, vec)``.

    Trains on at most ``training`` rows (smallest seeded hashes); each round sums per cluster on the
    executors and sends k sums to the driver. An empty cluster keeps its old centre. Zero vectors go to cluster 0's side
    of equal similarity. Every row is assigned, to the most similar centroid, the smaller number on ties.
    """
    n = rows.count()
    if not 2 <= k <= max(n, 2):
        raise ValueError("k must lie in 2..rows")
    h = F.xxhash64(F.lit(seed), "id")
    train = rows.select("id", F.col("vec").cast("array<float>").alias("vec"), h.alias("h"))
    if n > training:
        train = train.orderBy("h", "id").limit(training)
    train = train.persist()
    first = train.orderBy("h", "id").limit(min(n, max(8 * k, 4096))).select("vec").toArrow()["vec"].combine_chunks()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    centres = seed_centroids(unit(_matrix(first)), k, seed)
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(centres)

        def sums(batches, sent=sent):
            total = np.zeros_like(sent.value)
            for b in batches:
                x = unit(_matrix(b["vec"]))
                if len(x):
                    np.add.at(total, (x @ sent.value.T).argmax(1), x)
            hit = np.flatnonzero(np.abs(total).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(list(total[hit]), pa.list_(pa.float64()))], names=["c", "s"])

        got = train.select("vec").mapInArrow(sums, "c int, s array<double>").select("c", F.posexplode("s").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v")).toPandas()
        new = centres.copy()
        if len(got):
            total = np.zeros_like(centres)
            total[got["c"], got["i"]] = got["v"]
            length = np.linalg.norm(total, axis=1)
            new[length > 1e-12] = total[length > 1e-12] / length[length > 1e-12, None]
        moved = np.abs(new - centres).max()
        centres = new
        if moved < 1e-9:
            break
    train.unpersist()
    return centres, assign(rows, centres)


def assign(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with the number of the most similar centroid as ``cluster_id``."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*rows.drop("cluster_id").schema.fields, T.StructField("cluster_id", T.IntegerType())])

    def nearest(batches):
        for b in batches:
            x = _matrix(b["vec"])
            best = (x @ sent.value.T).argmax(1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.int32())], names=[*b.schema.names, "cluster_id"])

    return rows.drop("cluster_id").mapInArrow(nearest, schema)


def time_summary(rows: DataFrame, horizon: float = 365.0, ts: str = "ts_days", levels: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """One row: rows, min, max, mean, population deviation, interpolated percentiles, times exactly at the bounds."""
    t = F.col(ts).cast("double")
    return rows.agg(F.count("*").alias("rows"), F.min(t).alias("min_ts"), F.max(t).alias("max_ts"), F.avg(t).alias("mean_ts"), F.stddev_pop(t).alias("std_ts"),
                    *(F.percentile(t, p).alias(f"p{round(100 * p):02d}") for p in levels), F.count_if((t == 0) | (t == horizon)).alias("at_bounds"))


def cluster_times(rows: DataFrame, ts: str = "ts_days", cluster: str = "cluster_id") -> DataFrame:
    """(cluster, size, mean, std) of every cluster that has rows."""
    t = F.col(ts).cast("double")
    return rows.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("size"), F.avg(t).alias("mean_ts"), F.stddev_pop(t).alias("std_ts"))


def cluster_time_summary(rows: DataFrame, ts: str = "ts_days", cluster: str = "cluster_id") -> DataFrame:
    """One row: clusters, smallest, upper median and largest size, mean of the clusters' deviations."""
    per = cluster_times(rows, ts, cluster)
    sizes = per.agg(F.count("*").alias("clusters"), F.min("size").alias("min_size"), F.sort_array(F.collect_list("size")).alias("s"), F.max("size").alias("max_size"), F.avg("std_ts").alias("mean_std"))
    return sizes.select("clusters", "min_size", F.element_at("s", (F.floor(F.col("clusters") / 2) + 1).cast("int")).alias("median_size"), "max_size", "mean_std")


def centroid(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """(dim, mean) of all vectors: one row per dimension."""
    return rows.select(F.posexplode(vec).alias("dim", "v")).groupBy("dim").agg(F.avg(F.col("v").cast("double")).alias("mean")).withColumn("dim", F.col("dim").cast("bigint"))
