"""Quality of results and graphs: recall, latency summaries, degrees, Gini, levels and deciles."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fadeline.functions import score as S
from fadeline.operators.windows import deciles, global_rank


def recall(found: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(k, hits, expected, recall): of each query's first k true ids, the share among its first k results.

    ``found`` and ``truth`` are (qid, rank, id). A query without results counts with no hits; an id found twice counts once.
    """
    got = found.filter(F.col("rank") <= max(ks)).groupBy("qid", "id").agg(F.min("rank").alias("got"))
    # one join for all k: a true id is a hit from the k on at which both sides have it
    met = truth.select("qid", "id", F.col("rank").alias("want")).join(got, ["qid", "id"], "left").withColumn("from", F.when(F.col("got").isNotNull(), F.greatest("want", "got")))
    sums = met.agg(F.countDistinct("qid").alias("n"), *(F.count_if(F.col("from") <= k).alias(f"hits_{k}") for k in ks))
    each = F.explode(F.array(*(F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"hits_{k}").alias("hits"), (F.col("n") * k).alias("expected")) for k in ks)))
    return sums.select(each.alias("x")).select("x.*", (F.col("x.hits") / F.greatest("x.expected", F.lit(1))).alias("recall"))


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: (qid, id) pairs on either side only; (0, 0) means the same sets, in whatever order."""
    x, y = a.select("qid", "id"), b.select("qid", "id")
    return x.exceptAll(y).agg(F.count("*").alias("only_left")).join(y.exceptAll(x).agg(F.count("*").alias("only_right")))


def latency(samples: DataFrame, ms: str = "ms", by: Sequence[str] = ()) -> DataFrame:
    """Per group: calls, mean, interpolated p50 / p95 / p99 and calls per second of serial latencies."""
    c = F.col(ms).cast("double")
    return samples.groupBy(*by).agg(F.count("*").alias("calls"), F.avg(c).alias("mean_ms"), *(F.percentile(c, p).alias(f"p{round(p * 100)}_ms") for p in (0.5, 0.95, 0.99)), (F.count("*") * 1000.0 / F.sum(c)).alias("qps"))


def in_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, id, indegree) of every node on its levels; nodes(id, level, ...) reach down to level 0."""
    at = nodes.select("id", F.explode(F.sequence(F.lit(0), F.col("level").cast("int"))).alias("level"))
    into = edges.groupBy("level", F.col("dst").alias("id")).agg(F.count("*").alias("indegree"))
    return at.join(into, ["level", "id"], "left").fillna(0, ["indegree"])


def gini(values: DataFrame, value: str = "indegree", by: str | None = None) -> DataFrame:
    """Gini coefficient sum((2 i - n - 1) v_i) / (n * sum v) per group; 0 where all is zero.

    Equal values share their ranks' sum, so the values are counted first and only distinct ones are ordered.
    """
    key = [by] if by else []
    counts = values.groupBy(*key, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    # ranks before + 1 .. before + c add up to c * before + c (c + 1) / 2
    ranked = ranked.withColumn("ranks", F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2)
    g = ranked.groupBy(*key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("v")).alias("s"), F.sum(F.col("v") * F.col("ranks")).alias("r"))
    return g.select(*key, "n", F.when(F.col("s") > 0, (2 * F.col("r") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s"))).otherwise(0.0).alias("gini"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per level: nodes, edges, out-degree, in-degree distribution, time gaps, cosines, edges across time deciles.

    ``nodes(id, level, vec, ts_days)``, ``edges(level, src, dst)``.
    """
    d = deciles(nodes).select("id", "vec", F.col("ts_days").cast("double").alias("ts"), "decile")
    end = lambda p: d.select(F.col("id").alias(p), F.col("vec").alias(f"{p}_vec"), F.col("ts").alias(f"{p}_ts"), F.col("decile").alias(f"{p}_decile"))
    e = edges.join(end("src"), "src").join(end("dst"), "dst").select("level", F.abs(F.col("src_ts") - F.col("dst_ts")).alias("gap"), S.dot("src_vec", "dst_vec").alias("cos"), (F.col("src_decile") != F.col("dst_decile")).alias("across"))
    p = lambda c, x, name: F.percentile(c, x).alias(name)
    per_edge = e.groupBy("level").agg(F.count("*").alias("edges"), F.avg("gap").alias("time_delta_mean"), p("gap", 0.5, "time_delta_p50"), p("gap", 0.95, "time_delta_p95"), p("gap", 0.99, "time_delta_p99"),
                                      F.avg("cos").alias("semantic_cosine_mean"), p("cos", 0.5, "semantic_cosine_p50"), p("cos", 0.95, "semantic_cosine_p95"), F.avg(F.col("across").cast("double")).alias("cross_decile_ratio"))
    into = in_degrees(nodes, edges)
    per_node = into.groupBy("level").agg(F.count("*").alias("nodes"), F.avg("indegree").alias("indegree_mean"), p("indegree", 0.5, "indegree_p50"), p("indegree", 0.95, "indegree_p95"), p("indegree", 0.99, "indegree_p99"), F.max("indegree").alias("indegree_max"))
    g = gini(into, "indegree", "level").select("level", F.col("gini").alias("indegree_gini"))
    out = per_node.join(g, "level").join(per_edge, "level", "left").fillna(0, ["edges"])
    return out.withColumn("avg_outdegree", F.col("edges") / F.col("nodes"))


def decile_in_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, decile, nodes, indegree_mean)."""
    into = in_degrees(nodes, edges).join(deciles(nodes).select("id", "decile"), "id")
    return into.groupBy("level", "decile").agg(F.count("*").alias("nodes"), F.avg("indegree").alias("indegree_mean"))


def norm_strata_factors(rows: DataFrame, ranges: int = 5, samples: int = 100, top: int = 100, seed: int = 42) -> DataFrame:
    """(range, sources, min_norm, max_norm, factor): per equal-count norm range, the average product among the best
    candidates of sampled rows over their average product with the sample itself.

    The candidates of a sample are its ``top`` rows by inner product (itself left out), found in blocks like any query.
    """
    from fadeline.config import Mode
    from fadeline.operators.exact import top_k
    from fadeline.operators.windows import equal_ranges

    n = rows.withColumn("norm", S.norm("vec"))
    ranged = equal_ranges(n, ranges, ["norm", "id"], "range").persist()
    w = Window.partitionBy("range").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    picked = ranged.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= samples).select("range", F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    best = top_k(rows.withColumn("ts_days", F.lit(0.0)), picked, top + 1, mode=Mode.SEMANTIC).filter("qid <> id")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).filter(F.col("rank") <= top)
    with_vec = best.join(rows.select("id", "vec"), "id").select("qid", "id", "score", "vec")
    # sum over ordered pairs i != j of x_i . x_j is |sum x|^2 - sum |x|^2: no pairs are made
    sums = with_vec.select("qid", F.posexplode("vec").alias("d", "v")).groupBy("qid", "d").agg(F.sum(F.col("v").cast("double")).alias("s"), F.sum(F.col("v").cast("double") ** 2).alias("q"))
    pair = sums.groupBy("qid").agg((F.sum(F.col("s") ** 2) - F.sum("q")).alias("pairs"))
    per = with_vec.groupBy("qid").agg(F.count("*").alias("m"), F.sum("score").alias("source")).join(pair, "qid").join(picked.select("qid", "range"), "qid")
    f = per.groupBy("range").agg(F.count("*").alias("sources"), F.sum("source").alias("a"), F.sum("m").alias("na"), F.sum("pairs").alias("b"), F.sum(F.col("m") * (F.col("m") - 1)).alias("nb"))
    bounds = ranged.groupBy("range").agg(F.min("norm").alias("min_norm"), F.max("norm").alias("max_norm"))
    return f.join(bounds, "range").select("range", "sources", "min_norm", "max_norm", ((F.col("b") / F.col("nb")) / (F.col("a") / F.col("na"))).alias("factor"))


def max_norm_order(rows: DataFrame) -> DataFrame:
    """(rank, id, norm): ids by falling norm, then id; places from 1."""
    n = rows.select("id", S.norm("vec").alias("norm"))
    return global_rank(n.withColumn("__neg", -F.col("norm")), ["__neg", "id"], "rank").select((F.col("rank") + 1).alias("rank"), "id", "norm")


def sweep(search: Callable[[int], DataFrame], truth: DataFrame, efs: Sequence[int], k: int, repeats: int = 3) -> list[dict]:
    """Recall and seconds of ``search(ef)`` for every breadth, each repeated; breadths under k raise.

    Each result is written out in full before its recall is taken, so that recall isn't timed.
    """
    if any(ef < k for ef in efs):
        raise ValueError("a breadth under k can't fill a result")
    out = []
    for ef in efs:
        for i in range(repeats):
            began = time.perf_counter()
            found = search(ef).persist()
            n = found.count()
            seconds = time.perf_counter() - began
            r = recall(found, truth, [k]).first()
            out.append({"ef": ef, "repeat": i, "k": k, "rows": n, "seconds": seconds, "recall": r["recall"]})
            found.unpersist()
    return out
