"""Exact top-k of timestamped vectors under a score that mixes similarity and freshness.

Queries meet all rows in blocks of bounded size: a block of query vectors goes to the executors, each
task keeps its k best per query, and only those are shuffled. The plan reads the base once per block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fadeline.config import Mode, decay_rate
from fadeline.functions import score as S

#: Bytes of query vectors in a block; a block is what is broadcast.
BLOCK = 32 << 20


def rank(scored: DataFrame, k: int, keys: Sequence[str] = ("qid",), by: str = "score", id_: str = "id") -> DataFrame:
    """The ``k`` best rows of every key, numbered from 1: higher scores first, then smaller ids.

    Spark limits each task to k rows per key before the shuffle (WindowGroupLimit).
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(by), id_)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def top_k_sql(base: DataFrame, queries: DataFrame, k: int, half_life: float = 90.0, mode: Mode = Mode.MULTIPLICATIVE, alpha: float = 1.0, tau: float | None = 365.0, keep: Column | None = None) -> DataFrame:
    """The readable form, expressions only, for query sets of a checked size: (qid, rank, id, score)."""
    n, width = queries.agg(F.count("*"), F.max(F.size("qvec"))).first()
    if n * (width or 0) * 4 > BLOCK:
        raise ValueError("too many queries for the expression form; use top_k")
    at = F.lit(tau) if tau is not None else F.col("tau")
    rows = base if keep is None else base.filter(keep)
    pairs = rows.join(F.broadcast(queries))  # its size was checked above
    semantic = S.dot("qvec", "vec")
    fresh = S.freshness("ts_days", at, half_life)
    return rank(pairs.select("qid", "id", S.combine(semantic, fresh, mode, alpha).alias("score")), k).select("qid", "rank", "id", "score")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k best columns of every row; ties by id."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k, None]
        row, col = np.nonzero(scores >= least)
    else:
        row, col = (x.ravel() for x in np.indices(scores.shape))
    value = scores[row, col]
    got = ids[row, col] if ids.ndim == 2 else ids[col]
    order = np.lexsort((got, -value, row))
    row, got, value = row[order], got[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = (place < k) & (value > -np.inf)
    return row[keep], got[keep], value[keep]


def top_k(base: DataFrame, queries: DataFrame, k: int, half_lives: Sequence[float] = (90.0,), mode: Mode = Mode.MULTIPLICATIVE, alpha: float = 1.0, tau: float | None = 365.0, keep: Column | None = None, cosine: bool = False, group: str | None = None) -> DataFrame:
    """(half_life, qid, rank, id, score) of ``base(id, vec, ts_days)`` for ``queries(qid, qvec[, tau])``.

    Rows that ``keep`` rules out (by id, by a deleted flag, ...) are filtered before scoring, which Spark pushes
    into the scan. ``cosine`` scales both sides to length 1 first (zero vectors score 0). More than N is
    never asked of N rows: a query gets min(k, N). With ``group``, an integer column of few values, the
    k best of each of its values are found in the same pass, and it comes first in the result. Null vectors are no candidates. A query newer than a
    row scores it by its age; whether rows may be newer is for ``audit.require_past`` to check first.
    """
    if k < 1:
        raise ValueError("k must be positive")
    modes = [(h, decay_rate(h)) for h in half_lives]
    part = F.lit(0) if group is None else F.col(group)
    rows = (base if keep is None else base.filter(keep)).select("id", F.col("vec").cast("array<float>").alias("vec"), F.col("ts_days").cast("double").alias("ts"), part.cast("bigint").alias("part")).filter("vec IS NOT NULL AND id IS NOT NULL AND part IS NOT NULL")
    asked = queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("qvec").cast("array<float>").alias("qvec"), (F.lit(float(tau)) if tau is not None else F.col("tau").cast("double")).alias("tau"))
    n, width = asked.agg(F.count("*"), F.max(F.size("qvec"))).first()
    blocks = max(1, -(-n * (width or 1) * 8 // BLOCK))
    out = None
    for i in range(blocks):
        block = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)).orderBy("qid").toArrow()
        found = _block(rows, block, k, modes, mode, alpha, cosine)
        out = found if out is None else out.unionByName(found)
    return out.drop("part") if group is None else out.withColumnRenamed("part", group)


def _block(rows: DataFrame, part: pa.Table, k: int, modes: list[tuple[float, float]], mode: Mode, alpha: float, cosine: bool) -> DataFrame:
    qids, tau = part["qid"].to_numpy(), part["tau"].to_numpy()
    q = part["qvec"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(qids), -1) if len(qids) else np.zeros((0, 1))
    if cosine:
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    sent = rows.sparkSession.sparkContext.broadcast((qids, tau, q))

    def search(batches):
        qids, tau, q = sent.value
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        # scores of a tile, not of a batch, are held at once: 32 MB of each kind
        tiles = (b.slice(at, step) for step in [max(1, (4 << 20) // max(1, len(qids)))] for b in batches for at in range(0, len(b), step))
        for whole in tiles:
            if not len(qids):
                continue
            parts = whole["part"].to_numpy()
            for g in np.unique(parts).tolist():
                b = whole if (parts == g).all() else whole.filter(pa.array(parts == g))
                x = b["vec"].flatten().to_numpy().astype(np.float64).reshape(len(b), -1)
                if cosine:
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                ids, ts = b["id"].to_numpy(), b["ts"].to_numpy()
                semantic = q @ x.T
                for m, (_, rate) in enumerate(modes):
                    if mode is Mode.SEMANTIC:
                        s = semantic
                    else:
                        fresh = np.exp(-rate * (tau[:, None] - ts[None, :]))
                        s = semantic * fresh if mode is Mode.MULTIPLICATIVE else alpha * semantic + (1 - alpha) * fresh
                    old_s, old_i = best.get((g, m)) or (np.full((len(qids), k), -np.inf), np.zeros((len(qids), k), np.int64))
                    row, got, value = _best(np.hstack([old_s, s]), np.hstack([old_i, np.broadcast_to(ids, s.shape)]), k)
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    new_s, new_i = np.full_like(old_s, -np.inf), np.zeros_like(old_i)
                    new_s[row, place], new_i[row, place] = value, got
                    best[g, m] = new_s, new_i
        for (g, m), (s, i) in best.items():
            row, col = np.nonzero(s > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), g)), pa.array(np.full(len(row), modes[m][0], float)), pa.array(qids[row]), pa.array(i[row, col]), pa.array(s[row, col])], names=["part", "half_life", "qid", "id", "score"])

    found = rows.select("id", "vec", "ts", "part").mapInArrow(search, "part bigint, half_life double, qid bigint, id bigint, score double")
    return rank(found, k, ("part", "half_life", "qid")).select("part", "half_life", "qid", "rank", "id", "score")


def nearest_first(found: DataFrame, by: str = "distance") -> DataFrame:
    """Results with the closest first, numbered from 1 within each query."""
    w = Window.partitionBy("qid").orderBy(by, "id")
    return found.withColumn("rank", F.row_number().over(w).cast("bigint"))


def without_deleted(base: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows whose id isn't in ``deleted(id)``."""
    return base.join(deleted.select("id"), "id", "left_anti")


def knn_graph(rows: DataFrame, k: int) -> DataFrame:
    """Exact (src, rank, dst, distance) of each row's ``k`` nearest others by squared Euclidean distance.

    Query blocks of bounded size meet all rows, like ``top_k``; rows never pair up in a shuffle. Equal
    distances go by id, and a row is never its own neighbour.
    """
    slim = rows.select("id", F.col("vec").cast("array<float>").alias("vec"))
    n, width = slim.agg(F.count("*"), F.max(F.size("vec"))).first()
    blocks = max(1, -(-n * (width or 1) * 8 // BLOCK))
    out = None
    for i in range(blocks):
        part = (slim if blocks == 1 else slim.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)).orderBy("id").toArrow()
        qids = part["id"].to_numpy()
        q = part["vec"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(qids), -1)
        sent = rows.sparkSession.sparkContext.broadcast((qids, q))

        def search(batches, sent=sent):
            qids, q = sent.value
            norms = (q * q).sum(1)
            for b in batches:
                if not len(b):
                    continue
                x, ids = b["vec"].flatten().to_numpy().astype(np.float64).reshape(len(b), -1), b["id"].to_numpy()
                for at in range(0, len(qids), 1024):
                    cut = slice(at, at + 1024)
                    near = -(norms[cut, None] + (x * x).sum(1)[None, :] - 2 * q[cut] @ x.T)
                    near[qids[cut, None] == ids[None, :]] = -np.inf
                    row, got, _ = _best(near, ids, k + 4)  # a few more: these products round differently
                    place = np.searchsorted(ids, got, sorter=(o := np.argsort(ids)))
                    exact = ((q[cut][row] - x[o[place]]) ** 2).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[cut][row]), pa.array(got), pa.array(exact)], names=["src", "dst", "distance"])

        w = Window.partitionBy("src").orderBy("distance", "dst")
        found = slim.mapInArrow(search, "src bigint, dst bigint, distance double").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        found = found.select("src", F.col("rank").cast("bigint").alias("rank"), "dst", "distance")
        out = found if out is None else out.unionByName(found)
    return out
