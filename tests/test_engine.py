import math
import struct

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fadeline.config import Decay, Mode, PairMode, Schedule, decay_rate, file_tag, kappa_for_spread
from fadeline.functions import score as S
from fadeline.operators import audit, clusters, evaluate, exact, graph, sampling, transforms, windows
from fadeline.sources import binary
from fadeline.streaming import incremental

BASE = "id bigint, vec array<float>, ts_days double"


def vectors(n, dim, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def table(spark, x, ts=None, first=0):
    ts = np.linspace(0, 300, len(x)) if ts is None else ts
    return spark.createDataFrame([(first + i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, ts, strict=True))], BASE)


def ask(spark, x, tau=365.0):
    return spark.createDataFrame([(i, [float(v) for v in r], tau) for i, r in enumerate(x)], "qid bigint, qvec array<float>, tau double")


# ---- configuration


@pytest.mark.parametrize("bad", [
    {"dim": 0}, {"half_life": 0.0}, {"half_life": math.inf}, {"rate": 0.5}, {"alpha": 0.5}, {"alpha": 1.5, "mode": Mode.ADDITIVE},
    {"kappa_base": 0.2, "kappa_nav": 0.1}, {"kappa_nav": 0.5}, {"schedule": Schedule.PER_LEVEL}, {"kappa_levels": (0.1,)},
    {"schedule": Schedule.PER_LEVEL, "kappa_base": 0.1, "kappa_nav": 0.3, "kappa_levels": (0.1, 0.5, 0.3)}, {"future_slack": -1.0},
])
def test_invalid_configurations(bad):
    with pytest.raises(ValueError):
        Decay(**{"dim": 4, "half_life": 30.0} | bad)


def test_kappa_and_tags():
    c = Decay(4, 30.0, schedule=Schedule.PER_LEVEL, kappa_base=0.1, kappa_nav=0.4, kappa_levels=(0.1, 0.2, 0.4))
    assert [c.kappa(i) for i in (0, 1, 2, 9)] == [0.1, 0.2, 0.4, 0.4]
    assert Decay(4, 30.0, schedule=Schedule.TWO_TIER, kappa_base=0.1, kappa_nav=0.4).kappa(3) == 0.4
    assert kappa_for_spread(2) == 1 / 3 and file_tag(0.7) == "0p7" and file_tag(90.0) == "90"
    with pytest.raises(ValueError):
        c.kappa(-1)


# ---- exact search


def brute(base, ts, q, k, half_life, mode=Mode.MULTIPLICATIVE, alpha=1.0, tau=365.0):
    dot = q.astype(float) @ base.astype(float).T
    fresh = np.exp(-decay_rate(half_life) * (tau - ts))[None, :]
    s = dot * fresh if mode is Mode.MULTIPLICATIVE else alpha * dot + (1 - alpha) * fresh if mode is Mode.ADDITIVE else dot
    return [[int(i) for i in np.lexsort((np.arange(len(base)), -row))[:k]] for row in s]


def ranked(found):
    out = {}
    for r in found.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.id)
    return [out[q] for q in sorted(out)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 40), st.integers(1, 6), st.integers(1, 12), st.sampled_from([Mode.MULTIPLICATIVE, Mode.ADDITIVE, Mode.SEMANTIC]), st.integers(0, 1000))
def test_top_k_equals_brute_force(spark, n, nq, k, mode, seed):
    x, q = vectors(n, 5, seed), vectors(nq, 5, seed + 1)
    ts = np.random.default_rng(seed).uniform(0, 365, n)
    alpha = 0.6 if mode is Mode.ADDITIVE else 1.0
    assert ranked(exact.top_k(table(spark, x, ts), ask(spark, q), k, (45.0,), mode, alpha)) == brute(x, ts, q, k, 45.0, mode, alpha)


def test_ties_negative_products_and_bounds(spark):
    x = np.array([[1, 0], [1, 0], [-1, 0], [-1, 0]], np.float32)
    b = table(spark, x, np.array([100.0, 100.0, 50.0, 300.0]))
    q = ask(spark, np.array([[1, 0]], np.float32))
    # equal rows: the smaller id first; negative products: the older row ranks higher
    assert ranked(exact.top_k(b, q, 10)) == [[0, 1, 2, 3]]
    assert ranked(exact.top_k(b, q, 10, mode=Mode.ADDITIVE, alpha=0.0)) == [[3, 0, 1, 2]]
    assert ranked(exact.top_k(b, q, 2, keep=F.col("id") > 1)) == [[2, 3]]
    with pytest.raises(ValueError):
        exact.top_k(b, q, 0)
    assert exact.top_k(b.limit(0), q, 3).count() == 0
    assert exact.top_k(b, q.limit(0), 3).count() == 0


def test_query_blocks_give_the_same(spark, monkeypatch):
    x, q = vectors(60, 8), vectors(30, 8, 1)
    whole = ranked(exact.top_k(table(spark, x), ask(spark, q), 5))
    monkeypatch.setattr(exact, "BLOCK", 8 * 8 * 7)
    assert ranked(exact.top_k(table(spark, x), ask(spark, q), 5)) == whole


def test_transforms_keep_the_ranking(spark):
    x, q, ts = vectors(80, 6, 3), vectors(5, 6, 4), np.random.default_rng(5).uniform(0, 365, 80)
    b, a = table(spark, x, ts), ask(spark, q)
    flat = b.withColumn("vec", transforms.multiplicative_base("vec", "ts_days", 365.0, 30.0))
    assert ranked(exact.top_k(flat, a, 8, mode=Mode.SEMANTIC)) == ranked(exact.top_k(b, a, 8, (30.0,)))
    lift = b.withColumn("vec", transforms.additive_base("vec", "ts_days", 365.0, 30.0, 0.7))
    up = a.withColumn("qvec", transforms.additive_query("qvec", 0.7))
    assert ranked(exact.top_k(lift, up, 8, mode=Mode.SEMANTIC)) == ranked(exact.top_k(b, a, 8, (30.0,), Mode.ADDITIVE, 0.7))
    zero = spark.createDataFrame([(0, [0.0, 0.0], 1.0)], BASE)
    assert zero.select(transforms.multiplicative_base("vec", "ts_days", 1.0, 30.0, True).alias("v")).first().v == [0.0, 0.0]


def test_pair_distance_properties(spark):
    x = vectors(30, 4, 7)
    b = table(spark, x)
    pairs = b.alias("a").join(b.select(F.col("id").alias("j"), F.col("vec").alias("w"), F.col("ts_days").alias("u")))
    for mode, alpha in ((Mode.MULTIPLICATIVE, 1.0), (Mode.ADDITIVE, 0.7)):
        c = Decay(4, 60.0, mode, alpha, kappa_base=0.1, kappa_nav=0.1)
        r = pairs.select(S.pair_distance("vec", "w", "ts_days", "u", 0, c).alias("d"), S.pair_distance("w", "vec", "u", "ts_days", 0, c).alias("e"), (F.col("id") == F.col("j")).alias("same"))
        assert r.filter("d < 0 OR abs(d - e) > 1e-12 OR (same AND d > 1e-6)").count() == 0
    y = x.astype(float)
    want = graph.pair_distances(y, np.linspace(0, 300, 30), y, np.linspace(0, 300, 30), 0, c)
    got = np.zeros((30, 30))
    for r in pairs.select("id", "j", S.pair_distance("vec", "w", "ts_days", "u", 0, c).alias("d")).collect():
        got[r.id, r.j] = r.d
    assert np.allclose(got, want, atol=1e-6)


def test_future_rows(spark):
    c = Decay(2, 30.0)
    near = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], 10.0 + 5e-10, 10.0)], "q array<float>, v array<float>, ts double, tau double")
    assert near.select(S.query_distance("q", "v", "ts", "tau", c).alias("d")).first().d == 0.0
    far = near.withColumn("ts", F.lit(10.001))
    with pytest.raises(Exception, match="newer"):
        far.select(S.query_distance("q", "v", "ts", "tau", c)).collect()
    with pytest.raises(ValueError):
        audit.require_past(table(spark, vectors(2, 2), np.array([1.0, 9.0])), ask(spark, vectors(1, 2), 5.0))


# ---- audits, windows, samples


def test_audits_and_guards(spark):
    b = spark.createDataFrame([(0, [1.0, 0.0], 1.0), (1, [0.0, 0.0], 1.0), (2, [float("nan"), 0.0], 1.0), (3, [2.0, 0.0], 400.0)], BASE)
    r = audit.vector_audit(b).first()
    assert (r.rows, r.nonfinite, r.zero, r.nonunit) == (4, 1, 1, 2)
    with pytest.raises(ValueError):
        audit.require_vectors(b)
    with pytest.raises(ValueError):
        audit.require_times(b, 365.0)
    assert audit.duplicate_rows(b.unionByName(b)).first().duplicate_rows == 4
    assert b.filter("id = 1").select(S.unit("vec").alias("u")).first().u == [0.0, 0.0]
    with pytest.raises(Exception, match="normalised"):
        b.select(S.unit("vec", strict=True)).collect()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 60), min_size=0, max_size=40), st.integers(1, 6))
def test_global_ranks_and_runs(spark, values, parts):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id bigint, ts_days double")
    got = {r.id: r.pos for r in windows.global_rank(rows, ["ts_days", "id"], partitions=parts).collect()}
    assert got == {i: p for p, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    got = sorted(tuple(r) for r in windows.contiguous_runs(spark.createDataFrame([(v,) for v in values], "id bigint"), 8).collect())
    want, s = [], sorted(set(values))
    for v in s:
        if want and want[-1][1] == v - 1:
            want[-1][1] = v
        else:
            want.append([v, v])
    assert got == [(a, b, b - a + 1) for a, b in want]
    dec = {r.id: r.decile for r in windows.deciles(rows).collect()}
    n = len(values)
    assert dec == {i: min(9, 10 * p // n) for p, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}


def test_checkpoint_sizes():
    assert windows.checkpoint_sizes(200) == (100, 10, 10)
    for n, a, b in ((201, 50, 5), (200, 50, 7), (200, 0, 5), (200, 100, 5)):
        with pytest.raises(ValueError):
            windows.checkpoint_sizes(n, a, b)


def test_samples_are_exact_and_stable(spark):
    rows = table(spark, vectors(50, 3))
    a = sorted(r.id for r in sampling.reservoir(rows, 20).collect())
    assert len(a) == 20 and a == sorted(r.id for r in sampling.reservoir(rows.repartition(5), 20).collect())
    b, q = sampling.split(rows, 30, 20)
    assert {r.source_row for r in b.collect()}.isdisjoint(r.source_row for r in q.collect())
    with pytest.raises(ValueError):
        sampling.disjoint(rows, sampling.reservoir(rows, 40), 11)
    t = [r.ts_days for r in sampling.uniform_times(rows.drop("ts_days")).collect()]
    assert min(t) >= 0 and max(t) <= 365
    c = rows.drop("ts_days").withColumn("cluster_id", (F.col("id") % 3).cast("int"))
    t = sampling.clustered_times(c, sampling.cluster_centres(spark, 3)).collect()
    assert len(t) == 50 and all(0 <= r.ts_days <= 365 for r in t)


def test_kmeans_keeps_every_row_and_finds_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([np.eye(4)[i] + rng.normal(0, 0.02, (25, 4)) for i in range(4)])
    _, rows = clusters.spherical_kmeans(table(spark, x).select("id", "vec"), 4)
    got = {r.id: r.cluster_id for r in rows.collect()}
    assert len(got) == 100 and all(len({got[25 * i + j] for j in range(25)}) == 1 for i in range(4)) and len(set(got.values())) == 4
    with pytest.raises(ValueError):
        clusters.spherical_kmeans(table(spark, x).select("id", "vec"), 1)


def test_gini_and_recall(spark):
    v = [0, 0, 1, 3, 6, 6]
    n, s = len(v), sum(v)
    want = sum((2 * i - n - 1) * x for i, x in enumerate(sorted(v), 1)) / (n * s)
    got = evaluate.gini(spark.createDataFrame([(x,) for x in v], "indegree bigint")).first()
    assert got.n == n and abs(got.gini - want) < 1e-12
    truth = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 1, 7), (1, 2, 8)], "qid bigint, rank bigint, id bigint")
    found = spark.createDataFrame([(0, 1, 6), (0, 2, 9)], "qid bigint, rank bigint, id bigint")
    assert [r.recall for r in evaluate.recall(found, truth, [1, 2]).collect()] == [0.0, 0.25]


# ---- incremental


@pytest.mark.parametrize("mode,alpha", [(Mode.MULTIPLICATIVE, 1.0), (Mode.ADDITIVE, 0.7)])
def test_replay_equals_batch(spark, mode, alpha):
    x, q = vectors(100, 4, 9), vectors(3, 4, 10)
    ts = np.random.default_rng(11).uniform(0, 365, 100)
    order = np.lexsort((np.arange(100), ts))
    for c, kept in incremental.replay(table(spark, x, ts), ask(spark, q), 5, 50, 25, 60.0, mode, alpha):
        seen = np.sort(order[: 50 + 25 * c])
        want = brute(x[seen], ts[seen], q, 5, 60.0, mode, alpha)
        assert ranked(kept) == [[int(seen[i]) for i in w] for w in want]


def test_stream_equals_batch(spark, tmp_path):
    x, q = vectors(90, 4, 12), vectors(3, 4, 13)
    b = table(spark, x)
    for i in range(3):
        b.filter(f"id % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(BASE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    incremental.stream_top_k(stream, ask(spark, q), 7, f"{tmp_path}/state").awaitTermination()
    assert ranked(incremental.latest(spark, f"{tmp_path}/state")) == ranked(exact.top_k(b, ask(spark, q), 7))


def test_stream_newest_time_never_falls(spark, tmp_path):
    for i, times in enumerate(([5.0, 9.0], [1.0], [])):
        spark.createDataFrame([(t,) for t in times], "ts_days double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema("ts_days double").parquet(f"{tmp_path}/in/*")
        incremental.stream_newest_time(stream, f"{tmp_path}/state").awaitTermination()
        assert incremental.latest(spark, f"{tmp_path}/state").first().newest == 9.0


# ---- graphs


@pytest.mark.parametrize("method", graph.METHODS)
@pytest.mark.parametrize("mode,alpha", [(Mode.MULTIPLICATIVE, 1.0), (Mode.ADDITIVE, 0.7)])
def test_graphs_reach_recall(spark, method, mode, alpha):
    x, q = vectors(400, 8, 20), vectors(10, 8, 21)
    c = Decay(8, 90.0, mode, alpha, kappa_base=1 / 63, kappa_nav=1 / 15, schedule=Schedule.TWO_TIER)
    b, a = table(spark, x), ask(spark, q)
    index = graph.GraphIndex.build(b, graph.Plan(c, method, m=12, breadth=48, neighbours=40), shards=2)
    assert evaluate.recall(index.search(a, 10, 80), exact.top_k(b, a, 10, (90.0,), mode, alpha), [10]).first().recall >= 0.9


def test_graph_updates_and_storage(spark, tmp_path):
    x, q = vectors(200, 6, 22), vectors(5, 6, 23)
    b, a = table(spark, x), ask(spark, q)
    plan = graph.Plan(Decay(6, 90.0), m=8, breadth=40)
    index = graph.GraphIndex.build(b.filter("id < 150"), plan, shards=2).insert(b.filter("id >= 150")).delete(b.filter("id % 5 = 0"))
    got = index.search(a, 5, 60)
    assert got.filter("id % 5 = 0").count() == 0
    assert evaluate.recall(got, exact.top_k(b.filter("id % 5 <> 0"), a, 5), [5]).first().recall >= 0.9
    assert index.search(a, 5, 60, keep=F.col("id") < 50).filter("id >= 50").count() == 0
    index.save(f"{tmp_path}/index")
    again = graph.GraphIndex.load(spark, f"{tmp_path}/index")
    assert again.plan == plan and ranked(again.search(a, 5, 60)) == ranked(got)
    with pytest.raises(ValueError):
        index.insert(b.filter("id = 3"))
    with pytest.raises(ValueError):
        index.search(a, 50, 10)
    with pytest.raises(ValueError):
        graph.GraphIndex.build(b.unionByName(b), plan)


def test_two_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "src bigint, dst bigint")
    got = {r.node: r.component for r in graph.reachable_components(e).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30}


# ---- files


def test_binary_round_trips(spark, tmp_path):
    x = vectors(37, 5, 30)
    b = table(spark, x).withColumn("ts_days", F.col("ts_days").cast("float"))
    binary.write_raw(b.repartition(4), f"{tmp_path}/raw")
    file = binary.flat_file(f"{tmp_path}/raw")
    assert np.array_equal(np.fromfile(file, "<f4").reshape(-1, 5), x)
    got = {r.id: r.vec for r in binary.read_raw(spark, file, 5).collect()}
    assert all(np.array_equal(np.float32(got[i]), x[i]) for i in range(37)) and binary.count_vectors(spark, file, "raw", 5) == 37
    with pytest.raises(ValueError):
        binary.read_raw(spark, file, 4 * 7)
    assert binary.count_vectors(spark, file, "raw", 28) == 0
    binary.write_times(b, f"{tmp_path}/ts")
    assert [r.ts_days for r in binary.read_scalars(spark, binary.flat_file(f"{tmp_path}/ts"), rows=37).orderBy("id").collect()] == [r.ts_days for r in b.orderBy("id").collect()]
    (tmp_path / "f.fvecs").write_bytes(b"".join(struct.pack("<i", 5) + r.tobytes() for r in x))
    (tmp_path / "f.fbin").write_bytes(struct.pack("<II", 37, 5) + x.tobytes())
    for df in (binary.read_fvecs(spark, f"{tmp_path}/f.fvecs", 5), binary.read_fbin(spark, f"{tmp_path}/f.fbin", 5)):
        assert {r.id: r.vec for r in df.collect()} == got
    gt = spark.createDataFrame([(q, r + 1, 10 * q + r) for q in range(3) for r in range(4)], "qid bigint, rank bigint, id bigint")
    binary.write_ground_truth(gt, f"{tmp_path}/gt")
    flat = binary.flat_file(f"{tmp_path}/gt")
    assert sorted(map(tuple, binary.read_ground_truth(spark, flat, 4, base_rows=100).collect())) == sorted(map(tuple, gt.collect()))
    with pytest.raises(Exception, match="outside"):
        binary.read_ground_truth(spark, flat, 4, base_rows=5).collect()
    edges = exact.knn_graph(b, 3)
    binary.write_knng(edges, f"{tmp_path}/knng")
    assert sorted(map(tuple, binary.read_knng(spark, binary.flat_file(f"{tmp_path}/knng"), 3).collect())) == sorted((r.src, r.rank, r.dst) for r in edges.collect())
    (tmp_path / "ids.txt").write_text("5\n3\n9\n")
    assert [tuple(r) for r in binary.read_id_lines(spark, f"{tmp_path}/ids.txt").orderBy("pos").collect()] == [(0, 5), (1, 3), (2, 9)]


def test_manifests_and_key_values(spark, tmp_path):
    binary.write_manifest(spark, f"{tmp_path}/m", "times", spark.range(5).agg(F.count("*").alias("rows")), seed=42)
    assert binary.read_manifest(spark, f"{tmp_path}/m", "times")["rows"] == 5
    with pytest.raises(ValueError):
        binary.read_manifest(spark, f"{tmp_path}/m", "graph")
    assert binary.parse_key_values("a=1\n# no\nb = 2=3\n") == {"a": "1", "b ": " 2=3"}
    with pytest.raises(ValueError):
        binary.parse_key_values("a=1\na=2")


def test_pair_mode_semantic(spark):
    c = Decay(2, 30.0, pair_mode=PairMode.SEMANTIC)
    r = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<float>, b array<float>").select(S.pair_distance("a", "b", F.lit(0.0), F.lit(9.0), 0, c).alias("d")).first()
    assert r.d == 1.0
