"""Checks of vectors, times, splits and result tables: reports as DataFrames, and guards that raise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadeline.functions import score as S
from fadeline.operators.windows import contiguous_runs


def vector_audit(rows: DataFrame, tolerance: float = 1e-4, vec: str = "vec") -> DataFrame:
    """One row: rows, nonfinite, zero, nonunit, min_norm, max_norm, max_unit_error.

    Rows with a non-finite component are counted and otherwise left out. One aggregation, partial on each task.
    """
    n = S.norm(vec)
    bad = F.exists(F.col(vec), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    x = rows.select(bad.alias("bad"), F.when(~bad, n).alias("n"))
    off = F.abs(F.col("n") - 1.0)
    return x.agg(F.count("*").alias("rows"), F.count_if("bad").alias("nonfinite"), F.count_if(F.col("n") <= 1e-12).alias("zero"), F.count_if(off > tolerance).alias("nonunit"),
                 F.min("n").alias("min_norm"), F.max("n").alias("max_norm"), F.max(off).alias("max_unit_error"))


def require_vectors(rows: DataFrame, unit: bool = False, tolerance: float = 1e-4, vec: str = "vec") -> None:
    r = vector_audit(rows, tolerance, vec).first()
    if r["nonfinite"] or r["zero"] or (unit and r["nonunit"]):
        raise ValueError(f"{r['nonfinite']} rows aren't finite, {r['zero']} are zero, {r['nonunit']} aren't of length 1")


def duplicate_rows(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: how many rows repeat an earlier one bit by bit (rows beyond the first of each group)."""
    return rows.groupBy(vec).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"), F.count_if(F.col("count") > 1).alias("duplicate_groups"))


def overlap(queries: DataFrame, base: DataFrame) -> DataFrame:
    """One row: queries whose vector is also a base row."""
    return queries.join(base.select(F.col("vec").alias("qvec")).distinct(), "qvec", "left_semi").agg(F.count("*").alias("overlapping_queries"))


def time_audit(rows: DataFrame, horizon: float, ts: str = "ts_days", slack: float = 1e-9) -> DataFrame:
    """One row: rows, nonfinite, out_of_range, min_ts, max_ts."""
    t = F.col(ts).cast("double")
    fine = t.isNotNull() & ~F.isnan(t) & (F.abs(t) != float("inf"))
    return rows.agg(F.count("*").alias("rows"), F.count_if(~fine).alias("nonfinite"), F.count_if(fine & ((t < -slack) | (t > horizon + slack))).alias("out_of_range"),
                    F.min(F.when(fine, t)).alias("min_ts"), F.max(F.when(fine, t)).alias("max_ts"))


def require_times(rows: DataFrame, horizon: float, ts: str = "ts_days") -> None:
    r = time_audit(rows, horizon, ts).first()
    if r["nonfinite"] or r["out_of_range"]:
        raise ValueError(f"{r['nonfinite']} times aren't finite, {r['out_of_range']} lie outside 0..{horizon}")


def require_past(rows: DataFrame, queries: DataFrame, slack: float = 1e-9) -> None:
    """No query may be older than the newest row. Nothing is filtered for visibility."""
    newest, earliest = rows.agg(F.max(F.col("ts_days").cast("double"))).first()[0], queries.agg(F.min(F.col("tau").cast("double"))).first()[0]
    if newest is not None and earliest is not None and earliest < newest - slack:
        raise ValueError(f"a query at {earliest} would see rows as new as {newest}")


def ground_truth_structure(gt: DataFrame, base: DataFrame) -> DataFrame:
    """One row: queries, entries, invalid_ids (not in the base), queries_with_duplicates, min_id, max_id, min_width, max_width."""
    known = gt.join(base.select("id", F.lit(True).alias("known")), "id", "left")
    per = known.groupBy("qid").agg(F.count("*").alias("n"), F.countDistinct("id").alias("kinds"), F.count_if(F.col("known").isNull()).alias("bad"), F.min("id").alias("low"), F.max("id").alias("high"))
    return per.agg(F.count("*").alias("queries"), F.sum("n").alias("entries"), F.sum("bad").alias("invalid_ids"), F.count_if(F.col("n") > F.col("kinds")).alias("queries_with_duplicates"),
                   F.min("low").alias("min_id"), F.max("high").alias("max_id"), F.min("n").alias("min_width"), F.max("n").alias("max_width"))


def require_results(found: DataFrame, base: DataFrame) -> None:
    r = ground_truth_structure(found, base).first()
    if r["invalid_ids"] or r["queries_with_duplicates"]:
        raise ValueError(f"{r['invalid_ids']} ids are unknown, {r['queries_with_duplicates']} queries repeat ids")


def split_report(base_map: DataFrame, query_map: DataFrame, source_rows: int, same_source: bool = True) -> DataFrame:
    """One row on two maps (id, source_row): sizes, repeats, rows out of range, shared source rows, runs of the base."""
    side = lambda m, p: m.agg(F.count("*").alias(f"{p}_rows"), (F.count("*") - F.countDistinct("source_row")).alias(f"{p}_repeats"), F.count_if((F.col("source_row") < 0) | (F.col("source_row") >= source_rows)).alias(f"{p}_out_of_range"))
    shared = base_map.select("source_row").intersect(query_map.select("source_row")).agg(F.count("*").alias("shared"))
    runs = contiguous_runs(base_map.select(F.col("source_row").alias("id"))).agg(F.count("*").alias("base_runs"))
    out = side(base_map, "base").join(side(query_map, "query")).join(shared).join(runs)  # one row each
    clean = (F.col("base_repeats") + F.col("query_repeats") + F.col("base_out_of_range") + F.col("query_out_of_range") == 0) & ((F.col("shared") == 0) | F.lit(not same_source))
    return out.withColumn("disjoint", clean)


def source_map_check(subset: DataFrame, id_map: DataFrame, source: DataFrame) -> DataFrame:
    """One row: of ``subset(id, vec)``, how many rows differ from the ``source(id, vec)`` row that the map names."""
    s = source.select(F.col("id").alias("source_row"), F.col("vec").alias("original"))
    x = subset.join(id_map, "id", "left").join(s, "source_row", "left")
    return x.agg(F.count("*").alias("rows"), F.count_if(F.col("source_row").isNull()).alias("unmapped"), F.count_if(~F.col("vec").eqNullSafe(F.col("original"))).alias("mismatches"))


def knng_check(edges: DataFrame, rows: DataFrame, allow_self: bool = False) -> DataFrame:
    """One row on a graph (src, rank, dst): sources, edges, least and greatest degree, unknown targets, loops, repeats."""
    known = edges.join(rows.select(F.col("id").alias("dst"), F.lit(True).alias("known")), "dst", "left")
    per = known.groupBy("src").agg(F.count("*").alias("degree"), F.countDistinct("dst").alias("kinds"), F.count_if(F.col("known").isNull()).alias("bad"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    out = per.agg(F.count("*").alias("sources"), F.sum("degree").alias("edges"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.sum("bad").alias("unknown_targets"), F.sum("loops").alias("loops"), F.sum(F.col("degree") - F.col("kinds")).alias("repeats"))
    fine = (F.col("min_degree") == F.col("max_degree")) & (F.col("unknown_targets") == 0) & (F.col("repeats") == 0)
    return out.withColumn("valid", fine if allow_self else fine & (F.col("loops") == 0))


def fast_path_check(rows: DataFrame, tau: float, origin: float, config) -> DataFrame:
    """One row: the stored-basis freshness against the exponential: rows, max_error, failures beyond 2e-6 (absolute and relative)."""
    z = rows.withColumn("z", S.decay_basis("ts_days", origin, config)).withColumn("tau", F.lit(float(tau)))
    fast, direct = S.fast_freshness("z", "ts_days", "tau", origin, config), S.guarded_freshness("ts_days", "tau", config)
    x = z.select(F.abs(fast - direct).alias("d"), direct.alias("v"))
    return x.agg(F.count("*").alias("rows"), F.max("d").alias("max_error"), F.count_if(F.col("d") > 2e-6 + 2e-6 * F.col("v")).alias("failures"))
