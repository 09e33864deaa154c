"""The registered queries over the driver's tables, each with its SQL twin where SQL can say it.

``embeddings`` stands for a collection of timestamped vectors; times are a fixed function of the id over a
horizon of 365 days. Searches ask for every 50th row, by id, against all rows. Queries about splits of a
collection (disjointness, runs, source maps) take every 25th row out of it, which is what they are about.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadeline.config import Decay, Mode, PairMode, Schedule
from fadeline.functions import score as S
from fadeline.operators import audit, clusters, evaluate, exact, graph, sampling, transforms, windows
from fadeline.sources import tables
from fadeline.streaming import incremental

TAU, K, HALF_LIFE, ALPHA = 365.0, 10, 90.0, 0.7
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_VIEWS = """base AS (SELECT vec_id AS id, embedding AS vec, label, CAST((vec_id * 7919) % 36500 AS DOUBLE) / 100 AS ts FROM embeddings),
q AS (SELECT vec_id AS qid, embedding AS qvec, 365.0 + vec_id % 7 AS own_tau FROM embeddings WHERE vec_id % 50 = 0),
pairs AS (SELECT qid, id, label, ts, own_tau, vec, qvec, list_dot_product(CAST(qvec AS DOUBLE[]), CAST(vec AS DOUBLE[])) AS dot FROM q CROSS JOIN base)"""


def all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label", (F.pmod(F.col("vec_id") * 7919, F.lit(36500)).cast("double") / 100).alias("ts_days"))


def split_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rows(spark, sf_dir).filter("id % 25 <> 0")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_rows(spark, sf_dir).filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), (F.lit(365.0) + F.col("id") % 7).alias("tau"))


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _r(c: str, digits: int = 9):
    return F.round(c, digits).alias(c)


def _top_sql(score: str, where: str = "", k: int = K, views: str = _VIEWS) -> str:
    return f"""WITH {views}, scored AS (SELECT qid, id, {score} AS score FROM pairs {where}),
ranked AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored)
SELECT qid, CAST(rank AS BIGINT) AS rank, id, round(score, 9) AS score FROM ranked WHERE rank <= {k}"""


_MUL = "dot * exp(-ln(2.0) / 90.0 * (365.0 - ts))"
_ADD = "0.7 * dot + 0.3 * exp(-ln(2.0) / 90.0 * (365.0 - ts))"


def _top(spark, d, rows=None, **how) -> DataFrame:
    found = exact.top_k(all_rows(spark, d) if rows is None else rows, asked(spark, d), how.pop("k", K), **how)
    return found.select("qid", "rank", "id", _r("score"))


# ---- exact search ------------------------------------------------------------------------------


@query(_top_sql(_MUL))
def topk_mul(spark, d):
    return _top(spark, d)


@query(_top_sql(_MUL))
def topk_mul_expressions(spark, d):
    return exact.top_k_sql(all_rows(spark, d), asked(spark, d).drop("tau"), K).select("qid", "rank", "id", _r("score"))


@query(_top_sql(_ADD))
def topk_add(spark, d):
    return _top(spark, d, mode=Mode.ADDITIVE, alpha=ALPHA)


@query(_top_sql("dot"))
def topk_semantic(spark, d):
    return _top(spark, d, mode=Mode.SEMANTIC)


@query(_top_sql("dot / (sqrt(list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[]))) * sqrt(list_dot_product(CAST(qvec AS DOUBLE[]), CAST(qvec AS DOUBLE[])))) * exp(-ln(2.0) / 90.0 * (365.0 - ts))"))
def topk_cosine(spark, d):
    return _top(spark, d, cosine=True)


@query(f"""WITH {_VIEWS}, h AS (SELECT unnest([30.0, 90.0, 180.0])::DOUBLE AS half_life), scored AS (SELECT half_life, qid, id, dot * exp(-ln(2.0) / half_life * (365.0 - ts)) AS score FROM pairs CROSS JOIN h),
ranked AS (SELECT *, row_number() OVER (PARTITION BY half_life, qid ORDER BY score DESC, id) AS rank FROM scored)
SELECT half_life, qid, CAST(rank AS BIGINT) AS rank, id, round(score, 9) AS score FROM ranked WHERE rank <= 10""")
def topk_multi_halflife(spark, d):
    return exact.top_k(all_rows(spark, d), asked(spark, d), K, (30.0, 90.0, 180.0)).select("half_life", "qid", "rank", "id", _r("score"))


@query(_top_sql("dot * exp(-ln(2.0) / 90.0 * (own_tau - ts))"))
def topk_per_query_tau(spark, d):
    return _top(spark, d, tau=None)


@query(_top_sql(_MUL, "WHERE id % 3 = 1 AND label < 7"))
def topk_filtered(spark, d):
    return _top(spark, d, keep=(F.col("id") % 3 == 1) & (F.col("label") < 7))


@query(_top_sql(_MUL, "WHERE id % 10 <> 3"))
def topk_without_deleted(spark, d):
    rows = all_rows(spark, d)
    return _top(spark, d, exact.without_deleted(rows, rows.filter("id % 10 = 3")))


@query(_top_sql(_MUL, k=100))
def topk_100(spark, d):
    return _top(spark, d, k=100)


@query(f"""WITH {_VIEWS}, r AS (SELECT qid, id, 1 - {_MUL} AS distance FROM pairs), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM r)
SELECT qid, CAST(rank AS BIGINT) AS rank, id, round(distance, 9) AS distance FROM n WHERE rank <= 10""")
def topk_nearest_first(spark, d):
    found = exact.top_k(all_rows(spark, d), asked(spark, d), K).select("qid", "id", (1 - F.col("score")).alias("distance"))
    return exact.nearest_first(found).select("qid", "rank", "id", _r("distance"))


# ---- transforms --------------------------------------------------------------------------------


def _mips(vec: str, qvec: str) -> str:
    views = _VIEWS.split(",\npairs AS")[0]
    return f"""WITH {views}, b AS (SELECT id, {vec} AS v FROM base), qq AS (SELECT qid, {qvec} AS w FROM q),
scored AS (SELECT qid, id, list_dot_product(CAST(w AS DOUBLE[]), CAST(v AS DOUBLE[])) AS score FROM qq CROSS JOIN b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored)
SELECT qid, CAST(rank AS BIGINT) AS rank, id, round(score, 5) AS score FROM ranked WHERE rank <= 10"""


_FLAT = "list_transform(vec, lambda x: CAST(CAST(exp(-ln(2.0) / 90.0 * (365.0 - ts)) AS FLOAT) * x AS FLOAT))"
_LIFT = "list_append(list_transform(vec, lambda x: CAST(CAST(sqrt(0.7) AS FLOAT) * x AS FLOAT)), CAST(CAST(sqrt(1 - 0.7) AS FLOAT) * CAST(exp(-ln(2.0) / 90.0 * (365.0 - ts)) AS FLOAT) AS FLOAT))"
_LIFT_Q = "list_append(list_transform(qvec, lambda x: CAST(CAST(sqrt(0.7) AS FLOAT) * x AS FLOAT)), CAST(sqrt(1 - 0.7) AS FLOAT))"


@query(_mips(_FLAT, "qvec"))
def mips_mul_topk(spark, d):
    rows = all_rows(spark, d).withColumn("vec", transforms.multiplicative_base("vec", "ts_days", TAU, HALF_LIFE))
    return exact.top_k(rows, asked(spark, d), K, mode=Mode.SEMANTIC).select("qid", "rank", "id", _r("score", 5))


@query(_mips(_LIFT, _LIFT_Q))
def mips_add_topk(spark, d):
    rows = all_rows(spark, d).withColumn("vec", transforms.additive_base("vec", "ts_days", TAU, HALF_LIFE, ALPHA))
    q = asked(spark, d).withColumn("qvec", transforms.additive_query("qvec", ALPHA))
    return exact.top_k(rows, q, K, mode=Mode.SEMANTIC).select("qid", "rank", "id", _r("score", 5))


@query("SELECT COUNT(*) AS rows, CAST(SUM(len(embedding)) AS BIGINT) AS elements, CAST(0 AS BIGINT) AS mismatches, CAST(0 AS BIGINT) AS missing, true AS aligned FROM embeddings")
def transform_alignment(spark, d):
    rows = all_rows(spark, d)
    wanted = rows.select("id", F.transform("vec", lambda x: x.cast("double") * S.freshness(F.col("ts_days"), TAU, HALF_LIFE)).alias("vec"))
    actual = rows.select("id", transforms.multiplicative_base("vec", "ts_days", TAU, HALF_LIFE).alias("vec"))
    return transforms.alignment(wanted, actual).select("rows", F.col("elements").cast("bigint").alias("elements"), F.col("mismatches").cast("bigint").alias("mismatches"), "missing", "aligned")


# ---- distances ---------------------------------------------------------------------------------

_PAIR = Decay(64, HALF_LIFE, kappa_base=1 / 63, kappa_nav=1 / 15, schedule=Schedule.TWO_TIER)
_PAIR_VIEW = """e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST((vec_id * 7919) % 36500 AS DOUBLE) / 100 AS ts FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b, greatest(-1.0, least(1.0, list_dot_product(a.v, b.v))) AS c, ln(2.0) / 90.0 * abs(a.ts - b.ts) AS x FROM e a JOIN e b ON b.id = a.id + 1)"""


def _neighbours(spark, d):
    e = all_rows(spark, d)
    return e.select(F.col("id").alias("a"), F.col("vec").alias("va"), F.col("ts_days").alias("ta")).join(e.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("vec").alias("vb"), F.col("ts_days").alias("tb")), "a")


def _pair(spark, d, c: Decay, level: int = 0):
    return _neighbours(spark, d).select("a", "b", F.round(S.pair_distance("va", "vb", "ta", "tb", level, c), 9).alias("distance"))


@query(f"WITH {_PAIR_VIEW} SELECT a, b, round(2 * (1 - exp(-x)) + 2 * (exp(-x) + 1.0 / 63) * (1 - c), 9) AS distance FROM p")
def dd_distance_mul(spark, d):
    return _pair(spark, d, _PAIR)


@query(f"WITH {_PAIR_VIEW} SELECT a, b, round(2 * (1 - exp(-x)) + 2 * (exp(-x) + 1.0 / 15) * (1 - c), 9) AS distance FROM p")
def dd_distance_mul_upper(spark, d):
    return _pair(spark, d, _PAIR, 2)


@query(f"WITH {_PAIR_VIEW} SELECT a, b, round(2 * (0.7 + 1.0 / 63) * (1 - c) + 2 * (1 - 0.7) * (1 - exp(-x)), 9) AS distance FROM p")
def dd_distance_add(spark, d):
    return _pair(spark, d, Decay(64, HALF_LIFE, Mode.ADDITIVE, ALPHA, kappa_base=1 / 63, kappa_nav=1 / 15, schedule=Schedule.TWO_TIER))


@query(f"WITH {_PAIR_VIEW} SELECT a, b, round(1 - c, 9) AS distance FROM p")
def dd_distance_semantic(spark, d):
    return _pair(spark, d, Decay(64, HALF_LIFE, pair_mode=PairMode.SEMANTIC))


@query(f"WITH {_VIEWS} SELECT qid, id, round(CASE WHEN d < 0 AND d > -1e-7 THEN 0 ELSE d END, 9) AS distance FROM (SELECT qid, id, 1 - greatest(-1.0, least(1.0, dot)) * exp(-ln(2.0) / 90.0 * (own_tau - ts)) AS d FROM pairs) t")
def qd_distance(spark, d):
    pairs = all_rows(spark, d).join(F.broadcast(asked(spark, d)))
    return pairs.select("qid", "id", F.round(S.query_distance("qvec", "vec", "ts_days", "tau", _PAIR), 9).alias("distance"))


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, a.v AS x, b.v AS y FROM e a JOIN e b ON b.id = a.id + 1)
SELECT a, b, round(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS l2, round(-list_dot_product(x, y), 9) AS negative_dot,
round(-list_dot_product(x, y) / sqrt(list_dot_product(y, y)), 9) AS angular, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 9) AS cosine FROM p""")
def vector_distances(spark, d):
    return _neighbours(spark, d).select("a", "b", F.round(S.squared_distance("va", "vb"), 9).alias("l2"), F.round(S.negative_dot("va", "vb"), 9).alias("negative_dot"), F.round(S.angular_distance("va", "vb"), 9).alias("angular"), F.round(S.cosine("va", "vb"), 9).alias("cosine"))


@query("SELECT CAST(l AS INTEGER) AS level, round(CASE least(l, 2) WHEN 0 THEN 1.0 / 63 WHEN 1 THEN 1.0 / 31 ELSE 1.0 / 15 END, 12) AS per_level, round(CASE WHEN l > 0 THEN 1.0 / 15 ELSE 1.0 / 63 END, 12) AS two_tier, round(1.0 / (2 ** (l + 1) - 1), 12) AS from_spread FROM range(6) t(l)")
def kappa_schedule(spark, d):
    per = Decay(64, HALF_LIFE, schedule=Schedule.PER_LEVEL, kappa_base=1 / 63, kappa_nav=1 / 15, kappa_levels=(1 / 63, 1 / 31, 1 / 15))
    level = spark.range(6).select(F.col("id").cast("int").alias("level"))
    return level.select("level", F.round(S.kappa("level", per), 12).alias("per_level"), F.round(S.kappa("level", _PAIR), 12).alias("two_tier"), F.round(1 / (F.pow(F.lit(2.0), F.col("level") + 1) - 1), 12).alias("from_spread"))


@query("SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS failures FROM embeddings")
def fastpath_equivalence(spark, d):
    return audit.fast_path_check(all_rows(spark, d), TAU, 0.0, _PAIR).select("rows", "failures")


@query(f"""WITH {_PAIR_VIEW} SELECT a, b, round(exp(-x), 9) AS freshness FROM p""")
def fastpath_pairs(spark, d):
    z = lambda t: S.decay_basis(t, 0.0, _PAIR)
    return _neighbours(spark, d).select("a", "b", F.round(S.fast_pair_freshness(z("ta"), z("tb"), F.col("ta"), F.col("tb"), _PAIR), 9).alias("freshness"))


@query("SELECT vec_id AS id, round(sqrt(list_dot_product(CAST(u AS DOUBLE[]), CAST(u AS DOUBLE[]))), 5) AS length FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x * CAST(1 / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS FLOAT) AS FLOAT)) AS u FROM embeddings) t")
def unit_vectors(spark, d):
    return all_rows(spark, d).select("id", F.round(S.norm(S.unit("vec")), 5).alias("length"))


@query("SELECT vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * exp(-ln(2.0) / 90.0 * (365.0 - CAST((vec_id * 7919) % 36500 AS DOUBLE) / 100)), 9) AS score FROM embeddings")
def sql_function_score(spark, d):
    incremental.register_sql(spark)
    return all_rows(spark, d).select("id", S.squared_norm("vec").alias("s"), "ts_days").selectExpr("id", "round(decayed_score(s, 365.0D - ts_days, 90.0D, 'multiplicative', 1.0D), 9) AS score")


# ---- audits ------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)
SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS nonfinite, count_if(n <= 1e-12)::BIGINT AS zero, count_if(abs(n - 1) > 1e-4)::BIGINT AS nonunit, round(min(n), 9) AS min_norm, round(max(n), 9) AS max_norm, round(max(abs(n - 1)), 9) AS max_unit_error FROM n""")
def vector_audit(spark, d):
    return audit.vector_audit(all_rows(spark, d)).select("rows", "nonfinite", "zero", "nonunit", _r("min_norm"), _r("max_norm"), _r("max_unit_error"))


@query("SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows, count_if(c > 1)::BIGINT AS duplicate_groups FROM (SELECT COUNT(*) AS c FROM embeddings GROUP BY embedding) t")
def duplicate_rows(spark, d):
    return audit.duplicate_rows(all_rows(spark, d))


@query("SELECT COUNT(*) AS overlapping_queries FROM embeddings WHERE vec_id % 25 = 0 AND embedding IN (SELECT embedding FROM embeddings WHERE vec_id % 25 <> 0)")
def query_base_overlap(spark, d):
    held_out = all_rows(spark, d).filter("id % 25 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return audit.overlap(held_out, split_base(spark, d))


@query("WITH t AS (SELECT CAST((vec_id * 7919) % 36500 AS DOUBLE) / 100 AS ts FROM embeddings) SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS nonfinite, count_if(ts > 300 + 1e-9)::BIGINT AS out_of_range, min(ts) AS min_ts, max(ts) AS max_ts FROM t")
def time_audit(spark, d):
    return audit.time_audit(all_rows(spark, d), 300.0)


@query(f"""WITH {_VIEWS}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY {_MUL} DESC, id) AS rank FROM pairs), g AS (SELECT * FROM r WHERE rank <= 10), per AS (SELECT qid, COUNT(*) AS n, min(id) AS low, max(id) AS high FROM g GROUP BY qid)
SELECT COUNT(*) AS queries, CAST(sum(n) AS BIGINT) AS entries, CAST(0 AS BIGINT) AS invalid_ids, CAST(0 AS BIGINT) AS queries_with_duplicates, min(low) AS min_id, max(high) AS max_id, min(n) AS min_width, max(n) AS max_width FROM per""")
def gt_structure(spark, d):
    return audit.ground_truth_structure(exact.top_k(all_rows(spark, d), asked(spark, d), K), all_rows(spark, d))


_SPLIT = "m AS (SELECT vec_id AS source_row, vec_id % 25 = 0 AS is_query FROM embeddings)"


@query(f"""WITH {_SPLIT} SELECT (SELECT COUNT(*) FROM m WHERE NOT is_query) AS base_rows, CAST(0 AS BIGINT) AS base_repeats, CAST(0 AS BIGINT) AS base_out_of_range, (SELECT COUNT(*) FROM m WHERE is_query) AS query_rows, CAST(0 AS BIGINT) AS query_repeats, CAST(0 AS BIGINT) AS query_out_of_range, CAST(0 AS BIGINT) AS shared,
(SELECT COUNT(DISTINCT g) FROM (SELECT source_row - row_number() OVER (ORDER BY source_row) AS g FROM m WHERE NOT is_query) t) AS base_runs, true AS disjoint""")
def split_report(spark, d):
    m = all_rows(spark, d).select("id", F.col("id").alias("source_row"))
    return audit.split_report(m.filter("id % 25 <> 0"), m.filter("id % 25 = 0"), 1 << 40)


@query("WITH g AS (SELECT vec_id, vec_id - row_number() OVER (ORDER BY vec_id) AS g FROM embeddings WHERE vec_id % 25 <> 0) SELECT min(vec_id) AS first, max(vec_id) AS last, COUNT(*) AS length FROM g GROUP BY g.g")
def contiguous_runs(spark, d):
    return windows.contiguous_runs(split_base(spark, d), 64)


@query("SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS unmapped, count_if(vec_id % 25 = 3)::BIGINT AS mismatches FROM embeddings WHERE vec_id % 25 <> 0")
def source_map_check(spark, d):
    source = all_rows(spark, d)
    subset = split_base(spark, d).select((F.col("id") + 1000).alias("id"), F.when(F.col("id") % 25 == 3, F.transform("vec", lambda x: x + F.lit(1.0).cast("float"))).otherwise(F.col("vec")).alias("vec"))
    return audit.source_map_check(subset, split_base(spark, d).select((F.col("id") + 1000).alias("id"), F.col("id").alias("source_row")), source)


# ---- windows and statistics --------------------------------------------------------------------


@query("""WITH t AS (SELECT CAST((vec_id * 7919) % 36500 AS DOUBLE) / 100 AS ts FROM embeddings) SELECT COUNT(*) AS rows, min(ts) AS min_ts, max(ts) AS max_ts, round(avg(ts), 9) AS mean_ts, round(stddev_pop(ts), 9) AS std_ts,
round(quantile_cont(ts, 0.01), 9) AS p01, round(quantile_cont(ts, 0.05), 9) AS p05, round(quantile_cont(ts, 0.25), 9) AS p25, round(quantile_cont(ts, 0.5), 9) AS p50, round(quantile_cont(ts, 0.75), 9) AS p75, round(quantile_cont(ts, 0.95), 9) AS p95, round(quantile_cont(ts, 0.99), 9) AS p99, count_if(ts = 0 OR ts = 365)::BIGINT AS at_bounds FROM t""")
def timestamp_summary(spark, d):
    s = clusters.time_summary(all_rows(spark, d))
    return s.select(*(c if c in ("rows", "at_bounds", "min_ts", "max_ts") else _r(c) for c in s.columns))


@query("WITH t AS (SELECT vec_id AS id, CAST((vec_id * 7919) % 36500 AS DOUBLE) / 100 AS ts FROM embeddings), r AS (SELECT id, row_number() OVER (ORDER BY ts, id) - 1 AS r, COUNT(*) OVER () AS n FROM t) SELECT id, CAST(least(9, (10 * r) // n) AS BIGINT) AS decile FROM r")
def timestamp_decile(spark, d):
    return windows.deciles(all_rows(spark, d)).select("id", "decile")


@query("""WITH t AS (SELECT vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 12) AS n FROM embeddings), r AS (SELECT id, row_number() OVER (ORDER BY n, id) - 1 AS p, COUNT(*) OVER () AS c FROM t)
SELECT id, (SELECT max(k) FROM range(7) x(k) WHERE (k * c) // 7 <= p) AS range FROM r""")
def norm_ranges(spark, d):
    rows = all_rows(spark, d).select("id", F.round(S.squared_norm("vec"), 12).alias("n"))
    return windows.equal_ranges(rows, 7, ["n", "id"]).select("id", "range")


@query("WITH t AS (SELECT vec_id AS id, CAST((vec_id * 7919) % 36500 AS DOUBLE) / 100 AS ts FROM embeddings), r AS (SELECT id, row_number() OVER (ORDER BY ts, id) AS pos, COUNT(*) OVER () AS n FROM t) SELECT id, CAST(pos AS BIGINT) AS pos, CAST(CASE WHEN pos <= n // 2 THEN 0 ELSE ceil((pos - n // 2) / 24.0) END AS BIGINT) AS checkpoint FROM r")
def arrival_order(spark, d):
    rows = all_rows(spark, d)
    half = rows.count() // 2
    return windows.arrival_order(rows).select("id", "pos", windows.checkpoint_of("pos", half, 24).alias("checkpoint"))


@query("SELECT label AS cluster_id, COUNT(*) AS size, round(avg(ts), 9) AS mean_ts, round(stddev_pop(ts), 9) AS std_ts FROM (SELECT label, CAST((vec_id * 7919) % 36500 AS DOUBLE) / 100 AS ts FROM embeddings) t GROUP BY label")
def cluster_time_stats(spark, d):
    return clusters.cluster_times(all_rows(spark, d).withColumnRenamed("label", "cluster_id")).select("cluster_id", "size", _r("mean_ts"), _r("std_ts"))


@query("""WITH p AS (SELECT label, COUNT(*) AS size, stddev_pop(ts) AS s FROM (SELECT label, CAST((vec_id * 7919) % 36500 AS DOUBLE) / 100 AS ts FROM embeddings) t GROUP BY label), o AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS r, COUNT(*) OVER () AS n FROM p)
SELECT COUNT(*) AS clusters, min(size) AS min_size, (SELECT size FROM o WHERE r = n // 2) AS median_size, max(size) AS max_size, round(avg(s), 9) AS mean_std FROM p""")
def cluster_time_summary(spark, d):
    return clusters.cluster_time_summary(all_rows(spark, d).withColumnRenamed("label", "cluster_id")).select("clusters", "min_size", "median_size", "max_size", _r("mean_std"))


@query("SELECT CAST(i - 1 AS BIGINT) AS dim, round(avg(v), 9) AS mean FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) t GROUP BY i")
def centroid(spark, d):
    return clusters.centroid(all_rows(spark, d)).select("dim", _r("mean"))


@query("WITH n AS (SELECT vec_id AS id, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings) SELECT id, round(n, 9) AS norm FROM n")
def norm_order(spark, d):
    return evaluate.max_norm_order(all_rows(spark, d)).select("id", _r("norm"))


@query("SELECT event_type, COUNT(*) AS calls, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(COUNT(*) * 1000.0 / sum(value), 6) AS qps FROM events GROUP BY event_type")
def latency_summary(spark, d):
    s = evaluate.latency(spark.read.parquet(f"{d}/events.parquet"), "value", ["event_type"])
    return s.select("event_type", "calls", *(_r(c, 6) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms", "qps")))


@query("SELECT event_id, user_id, event_type FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) t WHERE before = event_type")
def adjacent_repeats(spark, d):
    return windows.adjacent_repeats(spark.read.parquet(f"{d}/events.parquet"), "user_id", ["event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("WITH w AS (SELECT vec_id AS id, CAST(1 + vec_id % 5 AS BIGINT) AS weight FROM embeddings), c AS (SELECT id, weight, sum(weight) OVER (ORDER BY id) AS c, sum(weight) OVER () AS t FROM w) SELECT min(id) AS id FROM c WHERE c >= 0.625 * t")
def weighted_pick(spark, d):
    return windows.running_pick(all_rows(spark, d).select("id", (1 + F.col("id") % 5).cast("bigint").alias("weight")), 0.625).select("id")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id < 100")
def prefix_sample(spark, d):
    return sampling.prefix(all_rows(spark, d), 100).select("id")


@query("SELECT p.i AS pos, e.vec_id AS id, e.label FROM range(0, 400, 7) r(x) JOIN embeddings e ON e.vec_id = r.x JOIN (SELECT x, row_number() OVER (ORDER BY x DESC) AS i FROM range(0, 400, 7) t(x)) p ON p.x = r.x")
def gather_rows(spark, d):
    wanted = spark.range(0, 400, 7).select("id", (F.lit(58) - F.col("id") / 7).cast("bigint").alias("pos"))
    return sampling.gather(all_rows(spark, d).select("id", "label"), wanted).select("pos", "id", "label")


# ---- evaluation and graphs ---------------------------------------------------------------------


@query(f"""WITH {_VIEWS}, t AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY {_MUL} DESC, id) AS rank FROM pairs), f AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY dot DESC, id) AS rank FROM pairs),
k AS (SELECT unnest([1, 5, 10])::BIGINT AS k) SELECT k, (SELECT COUNT(*) FROM t JOIN f USING (qid, id) WHERE t.rank <= k AND f.rank <= k) AS hits, (SELECT COUNT(*) FROM q) * k AS expected, round((SELECT COUNT(*) FROM t JOIN f USING (qid, id) WHERE t.rank <= k AND f.rank <= k) / ((SELECT COUNT(*) FROM q) * k)::DOUBLE, 9) AS recall FROM k""")
def recall_at_k(spark, d):
    truth, found = exact.top_k(all_rows(spark, d), asked(spark, d), K), exact.top_k(all_rows(spark, d), asked(spark, d), K, mode=Mode.SEMANTIC)
    return evaluate.recall(found, truth, [1, 5, 10]).select("k", "hits", "expected", _r("recall"))


@query("SELECT CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right")
def kernels_agree(spark, d):
    return evaluate.same_sets(exact.top_k(all_rows(spark, d), asked(spark, d), K), exact.top_k_sql(all_rows(spark, d), asked(spark, d).drop("tau"), K))


_KNN = """e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST((vec_id * 7919) % 36500 AS DOUBLE) / 100 AS ts FROM embeddings),
dd AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v) AS distance FROM e a JOIN e b ON a.id <> b.id),
g AS (SELECT src, dst, distance, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM dd), knn AS (SELECT * FROM g WHERE rank <= {k})"""


@query(f"WITH {_KNN.format(k=10)} SELECT src, CAST(rank AS BIGINT) AS rank, dst, round(distance, 9) AS distance FROM knn")
def exact_knn_graph(spark, d):
    return exact.knn_graph(all_rows(spark, d), 10).select("src", "rank", "dst", _r("distance"))


@query(f"WITH {_KNN.format(k=10)} SELECT (SELECT COUNT(*) FROM e) AS sources, COUNT(*) AS edges, CAST(10 AS BIGINT) AS min_degree, CAST(10 AS BIGINT) AS max_degree, CAST(0 AS BIGINT) AS unknown_targets, CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS repeats, true AS valid FROM knn")
def knng_check(spark, d):
    c = audit.knng_check(exact.knn_graph(all_rows(spark, d), 10), all_rows(spark, d))
    return c.select("sources", *(F.col(x).cast("bigint").alias(x) for x in ("edges", "min_degree", "max_degree", "unknown_targets", "loops", "repeats")), "valid")


@query(f"""WITH {_KNN.format(k=5)}, o AS (SELECT src, dst FROM knn WHERE rank <= 2 UNION SELECT dst AS src, src AS dst FROM knn WHERE rank <= 3), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS rank FROM o)
SELECT src, CAST(rank AS BIGINT) AS rank, dst FROM r WHERE rank <= 4""")
def knng_union(spark, d):
    g = exact.knn_graph(all_rows(spark, d), 3)
    return graph.merge_neighbours(g.filter("rank <= 2"), g.select(F.col("dst").alias("src"), F.col("src").alias("dst")), 4)


@query(f"""WITH {_KNN.format(k=4)}, o AS (SELECT src, dst, 1 AS hops, rank AS cost FROM knn UNION ALL SELECT a.src, b.dst, 2, a.rank + b.rank FROM knn a JOIN knn b ON a.dst = b.src),
m AS (SELECT src, dst, min(hops * 1000 + cost) AS c FROM o WHERE src <> dst GROUP BY src, dst), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c, dst) AS rank FROM m) SELECT src, CAST(rank AS BIGINT) AS rank, dst FROM r WHERE rank <= 12""")
def two_hop_neighbours(spark, d):
    return graph.two_hop(exact.knn_graph(all_rows(spark, d), 4), 12)


def _as_graph(spark, d, k=5):
    rows = all_rows(spark, d).withColumn("level", F.lit(0))
    return rows, exact.knn_graph(rows, k).select(F.lit(0).alias("level"), "src", "dst")


@query(f"""WITH {_KNN.format(k=5)}, i AS (SELECT e.id, COUNT(k.dst) AS v FROM e LEFT JOIN knn k ON k.dst = e.id GROUP BY e.id), o AS (SELECT v, row_number() OVER (ORDER BY v) AS r, COUNT(*) OVER () AS n FROM i)
SELECT max(n) AS n, round(sum((2 * r - n - 1) * v) / (max(n) * sum(v)), 9) AS gini FROM o""")
def gini_indegree(spark, d):
    return evaluate.gini(evaluate.in_degrees(*_as_graph(spark, d))).select("n", _r("gini"))


_GRAPH = _KNN.format(k=5) + """, dec AS (SELECT id, v, ts, least(9, (10 * (row_number() OVER (ORDER BY ts, id) - 1)) // COUNT(*) OVER ()) AS decile FROM e), i AS (SELECT e.id, COUNT(k.dst) AS n FROM e LEFT JOIN knn k ON k.dst = e.id GROUP BY e.id)"""


@query(f"""WITH {_GRAPH}, x AS (SELECT abs(a.ts - b.ts) AS gap, list_dot_product(a.v, b.v) AS cos, a.decile <> b.decile AS across FROM knn JOIN dec a ON a.id = src JOIN dec b ON b.id = dst)
SELECT CAST(0 AS INTEGER) AS level, (SELECT COUNT(*) FROM e) AS nodes, COUNT(*) AS edges, round((SELECT avg(n) FROM i), 9) AS indegree_mean, round((SELECT quantile_cont(n, 0.95) FROM i), 9) AS indegree_p95, (SELECT max(n) FROM i) AS indegree_max,
round(avg(gap), 9) AS time_delta_mean, round(quantile_cont(gap, 0.5), 9) AS time_delta_p50, round(avg(cos), 9) AS semantic_cosine_mean, round(quantile_cont(cos, 0.95), 9) AS semantic_cosine_p95, round(avg(across::INTEGER), 9) AS cross_decile_ratio FROM x""")
def graph_stats(spark, d):
    s = evaluate.graph_stats(*_as_graph(spark, d))
    return s.select("level", "nodes", "edges", *(_r(c) for c in ("indegree_mean", "indegree_p95")), "indegree_max", *(_r(c) for c in ("time_delta_mean", "time_delta_p50", "semantic_cosine_mean", "semantic_cosine_p95", "cross_decile_ratio")))


@query(f"WITH {_GRAPH} SELECT CAST(0 AS INTEGER) AS level, CAST(decile AS BIGINT) AS decile, COUNT(*) AS nodes, round(avg(n), 9) AS indegree_mean FROM dec JOIN i USING (id) GROUP BY decile")
def decile_in_degrees(spark, d):
    return evaluate.decile_in_degrees(*_as_graph(spark, d)).select("level", "decile", "nodes", _r("indegree_mean"))


# ---- incremental -------------------------------------------------------------------------------


@query(f"""WITH {_VIEWS}, o AS (SELECT id, row_number() OVER (ORDER BY ts, id) AS pos, COUNT(*) OVER () AS n FROM base), c AS (SELECT unnest(range(11)) AS checkpoint),
s AS (SELECT checkpoint, qid, p.id, {_MUL} AS score FROM c CROSS JOIN pairs p JOIN o ON o.id = p.id AND o.pos <= o.n // 2 + checkpoint * (o.n // 20)), r AS (SELECT *, row_number() OVER (PARTITION BY checkpoint, qid ORDER BY score DESC, id) AS rank FROM s)
SELECT CAST(checkpoint AS BIGINT) AS checkpoint, qid, CAST(rank AS BIGINT) AS rank, id, round(score, 9) AS score FROM r WHERE rank <= 10""")
def incremental_topk_by_checkpoint(spark, d):
    return incremental.every_checkpoint(all_rows(spark, d), asked(spark, d), K, whole=False).select("checkpoint", "qid", "rank", "id", _r("score"))


@query(_SQL["incremental_topk_by_checkpoint"])
def incremental_topk_replay(spark, d):
    _checkpoints(spark)
    out = None
    for c, kept in incremental.replay(all_rows(spark, d), asked(spark, d), K, whole=False):
        one = kept.select(F.lit(c).cast("bigint").alias("checkpoint"), "qid", "rank", "id", _r("score"))
        out = one if out is None else out.unionByName(one)
    return out


# ---- not for SQL: random draws, clustering, graphs built and searched ----------------------------


def _checkpoints(spark: SparkSession) -> None:
    """Tests on one machine name no shared folder; a cluster must."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tables.shared_folder(spark))


@query()
def reservoir_sample(spark, d):
    return sampling.reservoir(all_rows(spark, d), 100).select("id")


@query()
def disjoint_split(spark, d):
    b, q = sampling.split(all_rows(spark, d), 300, 50)
    return audit.split_report(b.select("id", "source_row"), q.select("id", "source_row"), 1 << 40).select("base_rows", "query_rows", "shared", "disjoint")


@query()
def uniform_times(spark, d):
    return sampling.uniform_times(all_rows(spark, d).drop("ts_days")).select("id", "ts_days")


@query()
def clustered_times(spark, d):
    _, rows = clusters.spherical_kmeans(all_rows(spark, d).select("id", "vec"), 8, rounds=5)
    return sampling.clustered_times(rows, sampling.cluster_centres(spark, 8)).select("id", "cluster_id", "ts_days")


@query()
def spherical_kmeans(spark, d):
    return clusters.spherical_kmeans(all_rows(spark, d).select("id", "vec"), 8)[1].groupBy("cluster_id").agg(F.count("*").alias("size"))


@query()
def norm_strata_factors(spark, d):
    return evaluate.norm_strata_factors(all_rows(spark, d).select("id", "vec"), samples=20, top=20)


def _ann(method: str, **how):
    def run(spark, d):
        rows = all_rows(spark, d).select("id", "vec", "ts_days")
        index = graph.GraphIndex.build(rows, graph.Plan(how.get("decay", _PAIR), method, m=16, breadth=64, neighbours=40, seed=100))
        q = asked(spark, d).withColumn("tau", F.lit(TAU))
        c = index.plan.decay
        truth = exact.top_k(rows, q, K, (c.half_life,), c.mode, c.alpha)
        return evaluate.recall(index.search(q, K, how.get("ef", 100)), truth, [K])

    return run


for _name, _method, _how in (
    ("ann_timelift", "timelift", {}),
    ("ann_timelift_additive", "timelift", {"decay": Decay(64, HALF_LIFE, Mode.ADDITIVE, ALPHA, kappa_base=1 / 63, kappa_nav=1 / 15, schedule=Schedule.TWO_TIER)}),
    ("ann_timelift_semantic_edges", "timelift", {"decay": Decay(64, HALF_LIFE, pair_mode=PairMode.SEMANTIC)}),
    ("ann_inner_product", "inner-product", {}),
    ("ann_inner_product_cosine", "inner-product-cosine", {}),
    ("ann_norm_adjusted", "norm-adjusted", {}),
    ("ann_monotonic", "monotonic", {}),
    ("ann_angular", "angular", {}),
):
    _QUERIES[_name] = _ann(_method, **_how)


@query()
def ann_insert_delete(spark, d):
    rows = all_rows(spark, d).select("id", "vec", "ts_days")
    index = graph.GraphIndex.build(rows.filter("id % 4 <> 1"), graph.Plan(_PAIR, m=16, breadth=64), shards=2).insert(rows.filter("id % 4 = 1")).delete(rows.filter("id % 10 = 3"))
    q = asked(spark, d).withColumn("tau", F.lit(TAU))
    return evaluate.recall(index.search(q, K, 100), exact.top_k(rows.filter("id % 10 <> 3"), q, K), [K])


@query()
def ann_integrity(spark, d):
    return graph.GraphIndex.build(all_rows(spark, d).select("id", "vec", "ts_days"), graph.Plan(_PAIR, m=16, breadth=64)).integrity()


@query()
def ann_graph_stats(spark, d):
    index = graph.GraphIndex.build(all_rows(spark, d).select("id", "vec", "ts_days"), graph.Plan(_PAIR, m=16, breadth=64))
    return evaluate.graph_stats(index.levelled(), index.edges.filter("kind = 'graph'"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
