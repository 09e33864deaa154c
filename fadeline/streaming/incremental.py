"""Top-k that is kept up as rows arrive: batch replay by checkpoints, and Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadeline.config import Mode
from fadeline.operators.evaluate import recall
from fadeline.operators.exact import rank, top_k
from fadeline.operators.windows import arrival_order, checkpoint_of, checkpoint_sizes


def merge_top_k(old: DataFrame | None, new: DataFrame, k: int) -> DataFrame:
    """The k best of what was kept and what is new: (qid, rank, id, score)."""
    both = new.select("qid", "id", "score")
    if old is not None:
        both = old.select("qid", "id", "score").unionByName(both)
    return rank(both, k).select("qid", "rank", "id", "score")


def rescale(kept: DataFrame, half_life: float, days: float) -> DataFrame:
    """Multiplicative scores as they stand ``days`` later: all shrink alike, so ranks stay."""
    from fadeline.config import decay_rate

    return kept.withColumn("score", F.col("score") * F.exp(F.lit(-decay_rate(half_life) * days)))


def _sizes(base: DataFrame, k: int, initial_percent: int, batch_percent: int, whole: bool) -> tuple[int, int, int]:
    initial, batch, batches = checkpoint_sizes(base.count(), initial_percent, batch_percent, whole)
    if whole and initial < k:
        raise ValueError("the initial rows can't fill a result")
    return initial, batch, batches


def replay(base: DataFrame, queries: DataFrame, k: int, initial_percent: int = 50, batch_percent: int = 5, half_life: float = 90.0, mode: Mode = Mode.MULTIPLICATIVE, alpha: float = 1.0, tau: float = 365.0, whole: bool = True) -> Iterator[tuple[int, DataFrame]]:
    """(checkpoint, exact top-k so far): only each checkpoint's new rows are scored, the rest is kept.

    Rows arrive by (time, id). Percentages that don't give whole batches raise, as does an initial set under k.
    Not ``whole``: sizes are rounded down, so the few rows after the last batch don't arrive, and a result may have under k rows.
    """
    initial, batch, batches = _sizes(base, k, initial_percent, batch_percent, whole)
    placed = arrival_order(base).withColumn("checkpoint", checkpoint_of("pos", initial, batch)).persist()
    kept = None
    for c in range(batches + 1):
        new = top_k(placed.filter(F.col("checkpoint") == c), queries, k, (half_life,), mode, alpha, tau)
        kept = merge_top_k(kept, new, k).checkpoint()
        yield c, kept
    placed.unpersist()


def every_checkpoint(base: DataFrame, queries: DataFrame, k: int, initial_percent: int = 50, batch_percent: int = 5, half_life: float = 90.0, mode: Mode = Mode.MULTIPLICATIVE, alpha: float = 1.0, tau: float = 365.0, whole: bool = True) -> DataFrame:
    """(checkpoint, qid, rank, id, score) of all checkpoints from one pass over the rows.

    Each batch's own k best are found once; a checkpoint's result is the k best among those of the
    batches up to it. The same rows as ``replay`` gives one after the other; ``whole`` is as there.
    """
    initial, batch, batches = _sizes(base, k, initial_percent, batch_percent, whole)
    placed = arrival_order(base).withColumn("batch", checkpoint_of("pos", initial, batch)).filter(F.col("batch") <= batches)
    own = top_k(placed, queries, k, (half_life,), mode, alpha, tau, group="batch")
    later = own.withColumn("checkpoint", F.explode(F.sequence(F.col("batch"), F.lit(batches).cast("bigint"))))
    return rank(later, k, ("checkpoint", "qid")).select("checkpoint", "qid", "rank", "id", "score")


def replay_with_index(index_insert: Callable[[int, DataFrame], Callable[[int], DataFrame]], base: DataFrame, queries: DataFrame, k: int, efs: Sequence[int], stop_recall: float | None = None, least_efs: int = 1, **how) -> list[dict]:
    """Recall by checkpoint and breadth. ``index_insert(checkpoint, rows)`` takes the new rows in and gives a search.

    Breadths rise; from ``least_efs`` of them on, a checkpoint ends at the first that reaches ``stop_recall``.
    """
    out = []
    n = base.count()
    initial, batch, _ = checkpoint_sizes(n, how.get("initial_percent", 50), how.get("batch_percent", 5), how.get("whole", True))
    placed = arrival_order(base).withColumn("checkpoint", checkpoint_of("pos", initial, batch))
    for c, truth in replay(base, queries, k, **how):
        search = index_insert(c, placed.filter(F.col("checkpoint") == c).drop("pos", "checkpoint"))
        for i, ef in enumerate(sorted(efs)):
            r = recall(search(ef), truth, [k]).first()
            out.append({"checkpoint": c, "ef": ef, "recall": r["recall"]})
            if stop_recall is not None and i + 1 >= least_efs and r["recall"] >= stop_recall:
                break
    return out


def stream_top_k(arrivals: DataFrame, queries: DataFrame, k: int, state: str, half_life: float = 90.0, mode: Mode = Mode.MULTIPLICATIVE, alpha: float = 1.0, tau: float = 365.0):
    """A started query that keeps the exact top-k of a stream (id, vec, ts_days) in ``state``/batch=N.

    Each micro-batch scores its own rows and merges them with the state of the batch before, which is
    found by number: a batch that is run again after a failure overwrites its own state only, so the
    result is exactly-once. Late rows count like others; there is no watermark to drop them by.
    ``tau`` is fixed; rows newer than it raise no error here.
    """
    spark = queries.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        new = top_k(batch, queries, k, (half_life,), mode, alpha, tau)
        old = spark.read.parquet(f"{state}/batch={number - 1}") if number else None
        merge_top_k(old, new, k).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return arrivals.writeStream.foreachBatch(take).option("checkpointLocation", f"{state}/_checkpoint").trigger(availableNow=True).start()


def latest(spark: SparkSession, state: str) -> DataFrame:
    """The newest state that ``stream_top_k`` has written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(state)
    names = [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    newest = max(int(n.split("=")[1]) for n in names if n.startswith("batch="))
    return spark.read.parquet(f"{state}/batch={newest}")


def stream_newest_time(arrivals: DataFrame, state: str):
    """A started query that keeps the newest time that a stream has had so far in ``state``.

    Each micro-batch merges its own newest time with that of the batch before, which is found by number, as in ``stream_top_k``.
    """
    spark = arrivals.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        new = batch.select("ts_days")
        if number:
            new = new.unionByName(spark.read.parquet(f"{state}/batch={number - 1}").withColumnRenamed("newest", "ts_days"))
        new.agg(F.max("ts_days").alias("newest")).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return arrivals.writeStream.foreachBatch(take).option("checkpointLocation", f"{state}/_checkpoint").trigger(availableNow=True).start()


def register_sql(spark: SparkSession) -> None:
    """SQL functions ``decayed_score(dot, age_days, half_life, mode, alpha)`` and ``file_tag(x)``; the score is SQL text, not Python."""
    from fadeline.config import file_tag

    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION decayed_score(d DOUBLE, age DOUBLE, half_life DOUBLE, mode STRING, alpha DOUBLE) RETURNS DOUBLE
        RETURN CASE mode WHEN 'multiplicative' THEN d * exp(-ln(2.0D) / half_life * age) WHEN 'additive' THEN alpha * d + (1 - alpha) * exp(-ln(2.0D) / half_life * age) ELSE d END""")
    spark.udf.register("file_tag", lambda x: None if x is None else file_tag(x), "string")


def describe(rows: list[dict]) -> str:
    return "\n".join(json.dumps(r, sort_keys=True) for r in rows)
