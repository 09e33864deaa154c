import numpy as np
import pytest
from pyspark.sql import functions as F

from fadeline.config import Decay, Mode, Schedule
from fadeline.functions import score as S
from fadeline.operators import exact
from fadeline.plans import workload


def source(spark, n=120, dim=6):
    x = np.random.default_rng(4).normal(size=(n, dim)).astype(np.float32)
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<float>")


def test_workload_end_to_end(spark, tmp_path):
    out = str(tmp_path)
    rows = source(spark)
    base, query = workload.prepare_subset(rows, out, 80, 10, control_k=3)
    assert (base.count(), query.count(), spark.read.parquet(f"{out}/control").count()) == (80, 10, 30)
    timed = workload.time_metadata(base, out, n_clusters=4)
    assert timed.count() == 80 and timed.filter("ts_days < 0 OR ts_days > 365").count() == 0
    asked = query.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    truth = workload.ground_truth(timed, asked, out, 5, (30.0, 90.0))
    assert truth.count() == 100
    moved, q = workload.export_transforms(timed, asked, out, 30.0, Mode.MULTIPLICATIVE)
    got = exact.top_k(moved.withColumn("ts_days", F.lit(0.0)), q, 5, mode=Mode.SEMANTIC)
    assert got.select("qid", "rank", "id").exceptAll(truth.filter("half_life = 30.0").select("qid", "rank", "id")).count() == 0
    report = workload.verify(spark, timed, query, truth.filter("half_life = 30.0"), moved, rows, 30.0)
    assert report["passed"], report
    broken = moved.withColumn("vec", F.when(F.col("id") == 3, F.transform("vec", lambda v: (v + 0.01).cast("float"))).otherwise(F.col("vec")))
    assert not workload.verify(spark, timed, query, truth.filter("half_life = 30.0"), broken, rows, 30.0)["passed"]
    with pytest.raises(ValueError):
        workload.ground_truth(timed, asked, out, 81)
    with pytest.raises(ValueError):
        workload.export_transforms(timed, asked, out, 30.0, Mode.SEMANTIC)


def test_uniform_times_and_zero_rows(spark, tmp_path):
    base, _ = workload.prepare_subset(source(spark), str(tmp_path), 50, 5)
    assert workload.time_metadata(base, str(tmp_path), clustered=False).select("ts_days").distinct().count() > 40
    zero = source(spark).withColumn("vec", F.when(F.col("id") % 2 == 0, F.array(*[F.lit(0.0).cast("float")] * 6)).otherwise(F.col("vec")))
    with pytest.raises(ValueError):
        workload.prepare_subset(zero, str(tmp_path), 60, 5)


def test_stiffness_never_changes_a_query(spark):
    rows = source(spark, 40).withColumn("vec", S.unit("vec")).withColumn("ts_days", F.col("id").cast("double"))
    q = rows.limit(1).select(F.col("vec").alias("q"), F.lit(50.0).alias("tau"))
    pairs = rows.join(q)
    a, b = Decay(6, 30.0), Decay(6, 30.0, kappa_base=0.1, kappa_nav=0.9, schedule=Schedule.TWO_TIER)
    d = pairs.select(S.query_distance("q", "vec", "ts_days", "tau", a).alias("x"), S.query_distance("q", "vec", "ts_days", "tau", b).alias("y"))
    assert d.filter("x <> y").count() == 0
