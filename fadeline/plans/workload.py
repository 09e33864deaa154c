"""Workload preparation end to end: subset, times, ground truth, transforms, verification.

Each step reads and writes tables (Parquet under one folder) and leaves a JSON manifest beside them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadeline.config import Mode, file_tag
from fadeline.functions import score as S
from fadeline.operators import audit, clusters, exact, sampling, transforms
from fadeline.sources.binary import write_manifest

HORIZON, CLUSTERS, TRAINING, ROUNDS, SEED = 365.0, 256, 256_000, 15, 42


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def prepare_subset(source: DataFrame, out: str, n_base: int, n_query: int, seed: int = SEED, control_k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Disjoint base and queries of ``source(id, vec)``, at length 1, audited, with their source rows.

    Rows that aren't finite or are zero raise, as does any query that is also a base row. With
    ``control_k`` the exact results without freshness are written too.
    """
    spark = source.sparkSession
    base, query = sampling.split(source, n_base, n_query, seed)
    for rows in (base, query):
        audit.require_vectors(rows)
    base = _write(base.withColumn("vec", S.unit("vec", strict=True)), f"{out}/base")
    query = _write(query.withColumn("vec", S.unit("vec", strict=True)), f"{out}/query")
    asked = query.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    for rows in (base, query):
        audit.require_vectors(rows, unit=True)
    shared = audit.overlap(asked, base).first()["overlapping_queries"]
    if shared:
        raise ValueError(f"{shared} queries are base rows")
    report = audit.vector_audit(base).join(audit.duplicate_rows(base))
    write_manifest(spark, f"{out}/subset.json", "subset", report, seed=seed, queries=n_query)
    if control_k:
        _write(exact.top_k(base.withColumn("ts_days", F.lit(0.0)), asked, control_k, mode=Mode.SEMANTIC, tau=0.0), f"{out}/control")
    return base, query


def time_metadata(base: DataFrame, out: str, clustered: bool = True, horizon: float = HORIZON, n_clusters: int | None = None, sigma: float | None = None, seed: int = SEED) -> DataFrame:
    """``base`` with ``ts_days``: uniform, or normal around a time drawn for each vector's cluster."""
    spark = base.sparkSession
    audit.require_vectors(base, unit=True)
    n = base.count()
    if not clustered:
        rows = _write(sampling.uniform_times(base, horizon, seed), f"{out}/timed")
        write_manifest(spark, f"{out}/times.json", "times", clusters.time_summary(rows, horizon), distribution="uniform", horizon=horizon, seed=seed)
        return rows
    k = n_clusters or min(n, CLUSTERS)
    _, assigned = clusters.spherical_kmeans(base, k, min(n, TRAINING), ROUNDS, seed)
    rows = _write(sampling.clustered_times(assigned, sampling.cluster_centres(spark, k, horizon, seed), horizon, sigma, seed), f"{out}/timed")
    report = clusters.time_summary(rows, horizon).join(clusters.cluster_time_summary(rows))
    write_manifest(spark, f"{out}/times.json", "times", report, distribution="clustered", horizon=horizon, seed=seed)
    return rows


def ground_truth(base: DataFrame, queries: DataFrame, out: str, k: int, half_lives: Sequence[float] = (30.0, 90.0, 180.0), mode: Mode = Mode.MULTIPLICATIVE, alpha: float = 1.0, horizon: float = HORIZON, cosine: bool = False) -> DataFrame:
    """Exact results for every half-life, partitioned by it; ``k`` over the number of rows raises."""
    audit.require_times(base, horizon)
    n = base.count()
    if k > n:
        raise ValueError(f"{k} results asked for, {n} rows")
    found = exact.top_k(base, queries, k, half_lives, mode, alpha, horizon, cosine=cosine)
    found.write.mode("overwrite").partitionBy("half_life").parquet(f"{out}/truth")
    rows = base.sparkSession.read.parquet(f"{out}/truth")
    report = audit.ground_truth_structure(rows.filter(F.col("half_life") == half_lives[0]), base)
    write_manifest(base.sparkSession, f"{out}/truth.json", "truth", report, k=k, mode=mode.value, alpha=alpha, half_lives=[file_tag(h) for h in half_lives])
    return rows


def export_transforms(base: DataFrame, queries: DataFrame, out: str, half_life: float, mode: Mode, alpha: float = 1.0, horizon: float = HORIZON) -> tuple[DataFrame, DataFrame]:
    """Base and queries whose plain inner product is the score."""
    audit.require_times(base, horizon)
    if mode is Mode.MULTIPLICATIVE:
        b, q = base.withColumn("vec", transforms.multiplicative_base("vec", "ts_days", horizon, half_life)), queries
    elif mode is Mode.ADDITIVE:
        b, q = base.withColumn("vec", transforms.additive_base("vec", "ts_days", horizon, half_life, alpha)), queries.withColumn("qvec", transforms.additive_query("qvec", alpha))
    else:
        raise ValueError("the semantic score needs no transform")
    tag = f"{mode.value}_{file_tag(half_life)}_{file_tag(alpha)}"
    b, q = _write(b.select("id", "vec"), f"{out}/{tag}/base"), _write(q.select("qid", "qvec"), f"{out}/{tag}/query")
    write_manifest(base.sparkSession, f"{out}/{tag}/transform.json", "transform", audit.vector_audit(b), mode=mode.value, half_life=half_life, alpha=alpha)
    return b, q


def verify(spark: SparkSession, base: DataFrame, query: DataFrame, truth: DataFrame, moved: DataFrame, source: DataFrame, half_life: float, horizon: float = HORIZON) -> dict:
    """One report over a prepared workload; ``passed`` says whether all of it holds.

    ``moved`` is the exported multiplicative base. Structure doesn't prove ranking: ``exact`` does that.
    """
    expected = base.select("id", transforms.multiplicative_base("vec", "ts_days", horizon, half_life).alias("vec"))
    vectors, times = audit.vector_audit(base).first(), audit.time_audit(base, horizon).first()
    aligned, split = transforms.alignment(expected, moved).first(), audit.split_report(base.select("id", "source_row"), query.select("id", "source_row"), 1 << 62).first()
    normal = source.withColumn("vec", S.unit("vec"))
    mapped = audit.source_map_check(base.select("id", "vec"), base.select("id", "source_row"), normal).first()
    structure = audit.ground_truth_structure(truth, base).first()
    passed = (not vectors["nonfinite"] and not vectors["nonunit"] and not times["out_of_range"] and aligned["aligned"] and split["disjoint"]
              and not mapped["mismatches"] and not mapped["unmapped"] and not structure["invalid_ids"] and not structure["queries_with_duplicates"])
    return {"vectors": vectors.asDict(), "times": times.asDict(), "transform": aligned.asDict(), "split": split.asDict(), "source": mapped.asDict(), "truth": structure.asDict(), "passed": bool(passed)}
