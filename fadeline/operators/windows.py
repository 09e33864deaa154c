"""Ranks, equal-count ranges, arrival order and runs.

Global orders are made without a single-task window: rows are range-partitioned, and each partition's
rows are numbered from the sum of the sizes of those before it (one small row per partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(rows: DataFrame, order: list[str], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """``rows`` with their 0-based place in the order ``order`` over the whole table.

    The order should be total (end with an id). The driver sees one count per partition.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id())
    # the bounds of the ranges, by which every row finds its partition again, in any later evaluation
    sizes = cuts.groupBy("__p").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("low")).orderBy("low").collect()
    if not sizes:
        return rows.withColumn(name, F.lit(0).cast("bigint"))
    starts, total = [], 0
    for r in sizes:
        starts.append((r["low"], total))
        total += r["n"]
    bounds = rows.sparkSession.createDataFrame([(i, r["low"], s) for i, (r, (_, s)) in enumerate(zip(sizes, starts, strict=True))], "__k int, low " + cuts.select(F.struct(*order).alias("low")).schema["low"].dataType.simpleString() + ", start bigint")
    table = bounds.agg(F.array_sort(F.collect_list(F.struct("low", "start"))).alias("__bounds"))
    out = rows.join(F.broadcast(table))  # one row: as many bounds as partitions
    at = F.size(F.filter("__bounds", lambda b: b["low"] <= F.struct(*order)))
    out = out.withColumn("__k", at).withColumn("__start", F.element_at("__bounds", F.greatest(at, F.lit(1)))["start"])
    place = F.row_number().over(Window.partitionBy("__k").orderBy(*order))
    return out.withColumn(name, F.col("__start") + place - 1).drop("__bounds", "__k", "__start")


def equal_ranges(rows: DataFrame, parts: int, order: list[str], name: str = "range") -> DataFrame:
    """``parts`` ranges [r * n / parts, (r + 1) * n / parts) of the order. Not ``ntile``: that deals the rest out otherwise."""
    n = rows.count()
    pos = global_rank(rows, order, "__pos")
    # the range of place p is the largest r with floor(r * n / parts) <= p
    r = F.floor(((F.col("__pos") + 1) * parts - 1) / F.lit(max(n, 1)))
    return pos.withColumn(name, F.least(F.lit(parts - 1), r).cast("bigint")).drop("__pos")


def deciles(rows: DataFrame, order: list[str] | None = None, name: str = "decile") -> DataFrame:
    """min(9, floor(10 * place / n)) by (ts, id)."""
    n = max(1, rows.count())
    pos = global_rank(rows, order or ["ts_days", "id"], "__pos")
    return pos.withColumn(name, F.least(F.lit(9), F.floor(F.col("__pos") * 10 / n)).cast("bigint")).drop("__pos")


def arrival_order(rows: DataFrame, name: str = "pos") -> DataFrame:
    """Place in the stable order by time, then id, from 1."""
    return global_rank(rows, ["ts_days", "id"], name).withColumn(name, F.col(name) + 1)


def checkpoint_of(pos: Column | str, initial: int, batch: int) -> Column:
    """0 for the first ``initial`` arrivals, then 1, 2, ... for batches of ``batch``; null after them where batches are empty."""
    p = F.col(pos) if isinstance(pos, str) else pos
    later = F.ceil((p - initial) / F.lit(batch)) if batch else F.lit(None)
    return F.when(p <= initial, F.lit(0)).otherwise(later).cast("bigint")


def checkpoint_sizes(n: int, initial_percent: int = 50, batch_percent: int = 5, whole: bool = True) -> tuple[int, int, int]:
    """(initial rows, rows of a batch, batches); percentages that don't give whole rows raise, unless not ``whole``: then sizes are rounded down."""
    if not (0 < initial_percent < 100 and 0 < batch_percent < 100) or (100 - initial_percent) % batch_percent:
        raise ValueError("the batches must be equal and end at 100 %")
    if whole and (n * initial_percent % 100 or n * batch_percent % 100):
        raise ValueError("the percentages must give whole numbers of rows")
    return n * initial_percent // 100, n * batch_percent // 100, (100 - initial_percent) // batch_percent


def contiguous_runs(ids: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(first, last, length) of the runs of consecutive ids.

    Islands are found within blocks of the id range, then those that meet at a block's edge are joined
    up; only a run's parts, one per block, pass through the second window.
    """
    d = ids.select(F.col("id").cast("bigint").alias("id")).filter("id IS NOT NULL").distinct().withColumn("b", F.floor(F.col("id") / block))
    island = F.col("id") - F.row_number().over(Window.partitionBy("b").orderBy("id"))
    parts = d.withColumn("g", island).groupBy("b", "g").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    edge = lambda c, at: F.pmod(F.col(c), F.lit(block)) == at
    inner = parts.filter(~edge("first", 0) & ~edge("last", block - 1)).select("first", "last")
    rim = parts.filter(edge("first", 0) | edge("last", block - 1))
    w = Window.orderBy("first")  # two rows a block at most
    joined = rim.withColumn("new", F.coalesce(F.lag("last").over(w) + 1 != F.col("first"), F.lit(True)).cast("int")).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("k").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last")
    return inner.unionByName(joined).withColumn("length", F.col("last") - F.col("first") + 1)


def adjacent_repeats(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value equals that of the row before them in their key's order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.filter(F.col(value).isNotNull()).withColumn("__before", F.lag(value).over(w)).filter(F.col("__before") == F.col(value)).drop("__before")


def running_pick(weights: DataFrame, u: float) -> DataFrame:
    """The row (id, weight) at which the running sum, by id, first reaches ``u`` of the total: one weighted pick.

    Blocks of rows are summed first; only the block that holds the pick is scanned row by row.
    """
    blocks = weights.withColumn("b", F.floor(F.col("id") / 65536)).groupBy("b").agg(F.sum("weight").alias("s")).orderBy("b")
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    total = weights.agg(F.sum("weight")).first()[0] or 0.0
    hit = blocks.withColumn("c", F.sum("s").over(w)).filter(F.col("c") >= u * total).orderBy("b").first()
    if hit is None:
        return weights.limit(0)
    inside = weights.filter(F.floor(F.col("id") / 65536) == hit["b"]).withColumn("c", F.sum("weight").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)))
    return inside.filter(F.col("c") + F.lit(hit["c"] - hit["s"]) >= u * total).orderBy("id").limit(1).drop("c")
