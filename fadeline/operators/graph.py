"""Approximate search over proximity graphs, kept as node and edge tables in bounded shards.

Rows are dealt to shards by a hash of their id. Each shard's graph is built by one task and searched by
one task; a query meets every shard and the shards' results are merged. So neither building nor
searching holds more than one shard in a task, however large the index, and a lost executor costs its
shards only. Builders differ in the distance they use and in the rule by which a candidate neighbour is
rejected; all share the kernels below.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadeline.config import Decay, Mode, PairMode
from fadeline.operators.exact import rank
from fadeline.sources import tables

#: Rows in a shard, on average.
SHARD = 8192
METHODS = ("timelift", "inner-product", "inner-product-cosine", "norm-adjusted", "monotonic", "angular")


@dataclass(frozen=True)
class Plan:
    """How a graph is built. ``method`` is one of METHODS; ``decay`` scores queries in all of them."""

    decay: Decay
    method: str = "timelift"
    m: int = 16
    breadth: int = 100
    seed: int = 100
    ranges: int = 5
    angle: float = 60.0
    extra: int = 5
    neighbours: int = 60
    max_expansions: int | None = None
    factors: tuple[float, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        if self.m < 2:
            raise ValueError("m must be at least 2")
        object.__setattr__(self, "breadth", max(self.breadth, self.m))


# ---- kernels -----------------------------------------------------------------------------------


def pair_distances(x: np.ndarray, tx: np.ndarray, y: np.ndarray, ty: np.ndarray, level: int, c: Decay) -> np.ndarray:
    """Distances between stored rows, as edges at ``level`` see them."""
    away = 1.0 - np.clip(x @ y.T, -1.0, 1.0)
    if c.pair_mode is PairMode.SEMANTIC:
        return away
    e = c.rate * np.abs(tx[:, None] - ty[None, :])
    fresh, faded, k = np.exp(-e), -np.expm1(-e), c.kappa(level)
    d = 2 * faded + 2 * (fresh + k) * away if c.mode is Mode.MULTIPLICATIVE else 2 * (c.alpha + k) * away + 2 * (1 - c.alpha) * faded
    return np.maximum(d, 0.0)


def scores(q: np.ndarray, tau: float, x: np.ndarray, ts: np.ndarray, c: Decay) -> np.ndarray:
    """Scores of one query against rows; times within the slack of the future count as now."""
    semantic = np.clip(x @ q, -1.0, 1.0)
    if c.mode is Mode.SEMANTIC:
        return semantic
    fresh = np.exp(-c.rate * np.maximum(tau - ts, 0.0))
    return semantic * fresh if c.mode is Mode.MULTIPLICATIVE else c.alpha * semantic + (1 - c.alpha) * fresh


def diverse(near: np.ndarray, between: np.ndarray, cap: int, rejects: Callable[[np.ndarray, float], np.ndarray] | None = None, fill: bool = False) -> list[int]:
    """Positions of at most ``cap`` candidates, nearest first, each kept unless one already kept rules it out.

    ``near[i]`` is a candidate's distance to the source, ``between[i, j]`` that of two candidates. By default a kept
    candidate closer to the new one than the source is rules it out. Up to ``cap`` candidates all stay with ``fill``.
    """
    order = np.argsort(near, kind="stable")
    if fill and len(order) < cap:
        return order.tolist()
    kept: list[int] = []
    for i in order:
        if len(kept) >= cap:
            break
        b = between[i, kept]
        if not (rejects(b, i) if rejects else b < near[i]).any():
            kept.append(int(i))
    return kept


def beam(starts: Sequence[int], width: int, value: Callable[[np.ndarray], np.ndarray], links: Callable[[int], np.ndarray], n: int, most: int | None = None) -> list[tuple[float, int]]:
    """Best-first search: the ``width`` best (value, node) found, best first. Ends when the best open node is worse than the worst kept."""
    seen = np.zeros(n, bool)
    starts = np.unique(np.asarray(starts, np.int64))
    seen[starts] = True
    first = value(starts)
    open_ = [(-v, i) for v, i in zip(first.tolist(), starts.tolist(), strict=True)]
    kept = [(v, -i) for v, i in zip(first.tolist(), starts.tolist(), strict=True)]
    heapq.heapify(open_), heapq.heapify(kept)
    while len(kept) > width:
        heapq.heappop(kept)
    steps = 0
    while open_:
        v, i = heapq.heappop(open_)
        if len(kept) >= width and -v < kept[0][0] or most is not None and steps >= most:
            break
        steps += 1
        new = links(i)
        new = new[~seen[new]]
        if not len(new):
            continue
        seen[new] = True
        for w, j in zip(value(new).tolist(), new.tolist(), strict=True):
            if len(kept) < width or w > kept[0][0]:
                heapq.heappush(open_, (-w, j))
                heapq.heappush(kept, (w, -j))
                if len(kept) > width:
                    heapq.heappop(kept)
    return sorted(((v, -i) for v, i in kept), key=lambda x: (-x[0], x[1]))


def levels_of(ids: np.ndarray, m: int, seed: int) -> np.ndarray:
    """floor(-ln(U) / ln(m)) with U a hash of seed and id: a row's level never depends on the order of insertion."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    u = ((z >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
    return np.minimum(np.floor(-np.log(u) / math.log(m)), 16).astype(np.int32)


def _nearest(d: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(d))
    at = np.argpartition(d, k - 1)[:k]
    return at[np.argsort(d[at], kind="stable")]


def _connect(members: np.ndarray, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], breadth: int, m: int, cap: int, rejects=None) -> dict[int, list[int]]:
    """Out-links by candidates and rejection, reverse links, and rejection again where a node has more than ``cap``."""
    out: dict[int, list[int]] = {}
    for at in range(0, len(members), 512):
        part = members[at : at + 512]
        d = distance(part, members)
        d[np.arange(len(part)), np.arange(at, at + len(part))] = np.inf
        for r, i in enumerate(part.tolist()):
            c = _nearest(d[r], min(breadth, len(members) - 1))
            if len(c):
                c_ids = members[c]
                out[i] = [int(c_ids[k]) for k in diverse(d[r][c], distance(c_ids, c_ids), m, rejects and rejects(i, c_ids), fill=True)]
            else:
                out[i] = []
    back: dict[int, list[int]] = {i: [] for i in out}
    for i, js in out.items():
        for j in js:
            back[j].append(i)
    for i in out:
        both = list(dict.fromkeys(out[i] + back[i]))
        if len(both) > cap:
            c = np.array(both)
            near = distance(np.array([i]), c)[0]
            both = [int(c[k]) for k in diverse(near, distance(c, c), cap, rejects and rejects(i, c))]
        out[i] = both
    return out


def build_shard(ids: np.ndarray, x: np.ndarray, ts: np.ndarray, p: Plan) -> list[tuple[str, int, int, int, int]]:
    """Edges (kind, level, src, rank, dst) of one shard; ids are the rows' own."""
    n, edges = len(ids), []

    def emit(kind: str, level: int, links: dict[int, list[int]]) -> None:
        edges.extend((kind, level, int(ids[i]), r, int(ids[j])) for i, js in links.items() for r, j in enumerate(js))

    everyone = np.arange(n)
    if p.method == "timelift":
        level = levels_of(ids, p.m, p.seed)
        for at in range(int(level.max(initial=0)) + 1):
            members = np.flatnonzero(level >= at)
            emit("graph", at, _connect(members, lambda a, b, at=at: pair_distances(x[a], ts[a], x[b], ts[b], at, p.decay), p.breadth, p.m, p.m if at else 2 * p.m))
        return edges
    y = mips_rows(x, ts, float(ts.max(initial=0.0)), p.decay)
    norms = np.maximum(np.linalg.norm(y, axis=1), 1e-12)
    product = lambda a, b: -(y[a] @ y[b].T)
    cosine = lambda a, b: 1.0 - (y[a] / norms[a, None]) @ (y[b] / norms[b, None]).T
    euclid = lambda a, b: np.maximum((y[a] ** 2).sum(1)[:, None] + (y[b] ** 2).sum(1)[None, :] - 2 * y[a] @ y[b].T, 0)
    if p.method in ("inner-product", "norm-adjusted"):
        rejects = None
        if p.method == "norm-adjusted":
            order = np.lexsort((ids, norms))
            stratum = np.empty(n, np.int64)
            stratum[order] = np.minimum(p.ranges - 1, ((np.arange(n) + 1) * p.ranges - 1) // max(n, 1))
            factor = p.factors or _factors(y, stratum, p)
            # a candidate goes if its product with a kept one exceeds the adjusted product with the source
            rejects = lambda i, c: (lambda b, k: -b > factor[stratum[i]] * float(y[i] @ y[c[k]]))
        level = levels_of(ids, p.m, p.seed)
        for at in range(int(level.max(initial=0)) + 1):
            emit("graph", at, _connect(np.flatnonzero(level >= at), product, p.breadth, p.m, p.m if at else 2 * p.m, rejects))
    elif p.method == "inner-product-cosine":
        emit("cosine", 0, _connect(everyone, cosine, p.breadth, min(p.m, 10), 2 * min(p.m, 10)))
        # products choose candidates, cosines reject
        links = {}
        for at in range(0, n, 512):
            d = product(everyone[at : at + 512], everyone)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            for r in range(len(d)):
                c = _nearest(d[r], min(p.breadth, n - 1)) if n > 1 else np.zeros(0, np.int64)
                near = cosine(np.array([at + r]), c)[0] if len(c) else np.zeros(0)
                links[at + r] = [int(c[k]) for k in diverse(near, cosine(c, c), 2 * p.m)] if len(c) else []
        emit("graph", 0, links)
    else:
        links, best = {}, {}
        for at in range(0, n, 512):
            part = everyone[at : at + 512]
            d, s = euclid(part, everyone), -product(part, everyone)
            own = s[np.arange(len(part)), part].copy()
            for z, v in ((d, np.inf), (s, -np.inf)):
                z[np.arange(len(part)), part] = v
            for r, i in enumerate(part.tolist()):
                c = _nearest(d[r], min(p.neighbours, n - 1)) if n > 1 else np.zeros(0, np.int64)
                if not len(c):
                    links[i] = best[i] = []
                    continue
                if p.method == "angular":
                    turn = (y[c] - y[i]) / np.maximum(np.linalg.norm(y[c] - y[i], axis=1, keepdims=True), 1e-12)
                    edge = math.cos(math.radians(p.angle))
                    links[i] = [int(c[k]) for k in diverse(d[r][c], -(turn @ turn.T), p.m, lambda b, k, edge=edge: -b > edge)]
                    best[i] = [int(j) for j in _nearest(-s[r], min(p.extra, n - 1))]
                else:
                    links[i] = [int(c[k]) for k in diverse(d[r][c], euclid(c, c), p.m)]
                    # inner-product edges lead to rows that beat this one by its own measure
                    best[i] = [int(j) for j in _nearest(-s[r], min(20, n - 1)) if s[r][j] > own[r]]
        back: dict[int, list[int]] = {i: [] for i in links}
        for i, js in links.items():
            for j in js:
                back[j].append(i)
        for i in links:
            both = np.array(list(dict.fromkeys(links[i] + back[i])), np.int64)
            if len(both) > p.m:
                both = both[diverse(euclid(np.array([i]), both)[0], euclid(both, both), p.m, fill=True)]
            links[i] = list(dict.fromkeys([*both.tolist(), *best[i]]))[: 2 * p.m]
        emit("graph", 0, links)
    return edges


def _factors(y: np.ndarray, stratum: np.ndarray, p: Plan, samples: int = 100, top: int = 100) -> tuple[float, ...]:
    """Per norm range: average product among a sample's best candidates over their average product with it."""
    rng, out = np.random.default_rng(p.seed), []
    for r in range(p.ranges):
        own = np.flatnonzero(stratum == r)
        a = b = na = nb = 0.0
        for i in rng.permutation(own)[:samples]:
            s = y @ y[i]
            s[i] = -np.inf
            c = _nearest(-s, min(top, len(y) - 1))
            total = y[c].sum(0)
            a, na, b, nb = a + s[c].sum(), na + len(c), b + total @ total - (y[c] ** 2).sum(), nb + len(c) * (len(c) - 1)
        f = (b / nb) / (a / na) if na and nb and abs(a) > 1e-12 else 1.0
        out.append(f if math.isfinite(f) and f > 0 else 1.0)
    return tuple(out)


def mips_rows(x: np.ndarray, ts: np.ndarray, horizon: float, c: Decay) -> np.ndarray:
    """Rows whose plain product with ``mips_query`` is the score."""
    decay = np.exp(-c.rate * (horizon - ts))
    if c.mode is Mode.SEMANTIC:
        return x
    return x * decay[:, None] if c.mode is Mode.MULTIPLICATIVE else np.hstack([math.sqrt(c.alpha) * x, math.sqrt(1 - c.alpha) * decay[:, None]])


def search_shard(ids: np.ndarray, x: np.ndarray, ts: np.ndarray, edges: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], queries, p: Plan, k: int, ef: int, ok: np.ndarray | None) -> list[tuple[int, int, float]]:
    """(qid, id, score) of the k best that the graph leads to. Rows that aren't ``ok`` are passed through but not returned."""
    n, out = len(ids), []
    adjacency = {}
    place = {int(i): r for r, i in enumerate(ids)}
    for key, (src, dst) in edges.items():
        lists: dict[int, list[int]] = {}
        for a, b in zip(src.tolist(), dst.tolist(), strict=True):
            if a in place and b in place:
                lists.setdefault(place[a], []).append(place[b])
        adjacency[key] = {a: np.array(b, np.int64) for a, b in lists.items()}
    none = np.zeros(0, np.int64)
    norms = np.maximum(np.linalg.norm(x, axis=1), 1e-12)
    top = max((level for kind, level in edges if kind == "graph"), default=0)
    high = np.flatnonzero(levels_of(ids, p.m, p.seed) >= top) if top else np.arange(n)
    for qid, q, tau in queries:
        value = lambda at, q=q, tau=tau: scores(q, tau, x[at], ts[at], p.decay)
        hop = lambda kind, level: (lambda i: adjacency.get((kind, level), {}).get(i, none))
        width = max(ef, k)
        if p.method in ("timelift", "inner-product", "norm-adjusted"):
            start = [int(high[0])] if len(high) else [0]
            for level in range(top, 0, -1):
                start = [beam(start, 1, value, hop("graph", level), n)[0][1]]
        elif p.method == "inner-product-cosine":
            like = lambda at, q=q: (x[at] @ q) / norms[at]
            start = [i for _, i in beam([0], 1, like, hop("cosine", 0), n)]
            start += [int(j) for i in start for j in hop("cosine", 0)(i)]
        elif p.method == "monotonic":
            near = lambda at, q=q: -((x[at] - q) ** 2).sum(1)
            start = [i for _, i in beam([int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))], 5, near, hop("graph", 0), n)]
        else:
            start = np.random.default_rng(p.seed).integers(0, n, min(n, width)).tolist()
        found = beam(start, width, value, hop("graph", 0), n, p.max_expansions)
        found = [(v, i) for v, i in found if ok is None or ok[i]]
        found.sort(key=lambda r: (-r[0], int(ids[r[1]])))
        out += [(qid, int(ids[i]), v) for v, i in found[:k]]
    return out


# ---- tables ------------------------------------------------------------------------------------


class GraphIndex:
    """``nodes(shard, id, vec, ts_days, deleted)`` and ``edges(shard, kind, level, src, rank, dst)`` with their plan."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, plan: Plan, shards: int):
        self.nodes, self.edges, self.plan, self.shards = nodes, edges, plan, shards

    @classmethod
    def build(cls, rows: DataFrame, plan: Plan, shards: int | None = None) -> GraphIndex:
        """Index of ``rows(id, vec, ts_days)``. Ids must not repeat (that raises)."""
        n = rows.count()
        if rows.select("id").distinct().count() != n:
            raise ValueError("ids repeat")
        shards = shards or max(1, -(-n // SHARD))
        nodes = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "vec", F.col("ts_days").cast("double").alias("ts_days"), F.lit(False).alias("deleted"))
        return cls(nodes, tables.written(_edges(nodes, plan)), plan, shards)  # built once, however many searches follow

    def search(self, queries: DataFrame, k: int, ef: int = 100, keep: Column | None = None) -> DataFrame:
        """(qid, rank, id, score) for ``queries(qid, qvec, tau)``: every shard is searched, the best k of all are kept.

        Deleted rows, and those that ``keep`` rules out, are walked through but not returned. Query sets are
        sent whole and must fit (32 MB of vectors); larger ones raise and go in parts.
        """
        if ef < k:
            raise ValueError("a breadth under k can't fill a result")
        asked = queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("qvec").cast("array<double>").alias("qvec"), F.col("tau").cast("double").alias("tau"))
        n, width = asked.agg(F.count("*"), F.max(F.size("qvec"))).first()
        if n * (width or 0) * 8 > 32 << 20:
            raise ValueError("too many queries at once")
        sent = self.nodes.sparkSession.sparkContext.broadcast([(r.qid, np.array(r.qvec), r.tau) for r in asked.orderBy("qid").collect()])
        plan = self.plan
        ok = ~F.col("deleted") if keep is None else ~F.col("deleted") & F.coalesce(keep, F.lit(False))
        nodes = self.nodes.withColumn("ok", ok).select("shard", "id", F.col("vec").cast("array<double>").alias("vec"), "ts_days", "ok")
        edges = self.edges.select(F.col("shard").alias("shard"), F.col("kind").alias("kind"), F.col("level").alias("level"), F.col("src").alias("src"), F.col("rank").alias("rank"), F.col("dst").alias("dst"))

        def run(left, right):
            if not left.num_rows:
                return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            left = left.sort_by("id").combine_chunks()
            right = right.sort_by([("src", "ascending"), ("rank", "ascending")])
            ids, ts = left["id"].to_numpy(), left["ts_days"].to_numpy()
            x = left["vec"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            kind, level = np.array(right["kind"].to_pylist(), dtype=object), right["level"].to_numpy()
            src, dst = right["src"].to_numpy(), right["dst"].to_numpy()
            groups = {(a, int(b)): (src[at], dst[at]) for a in set(kind.tolist()) for b in np.unique(level) if (at := (kind == a) & (level == b)).any()}
            found = search_shard(ids, x, ts, groups, sent.value, plan, k, ef, left["ok"].to_numpy(zero_copy_only=False))
            q, i, s = zip(*found, strict=True) if found else ((), (), ())
            return pa.table({"qid": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

        found = nodes.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(run, "qid bigint, id bigint, score double")
        return rank(found, k).select("qid", "rank", "id", "score")

    def insert(self, rows: DataFrame) -> GraphIndex:
        """The index with more rows; ids it holds already raise. Only the shards that get rows are built anew."""
        if rows.join(self.nodes.select("id"), "id", "left_semi").limit(1).count():
            raise ValueError("an id is in the index already")
        new = rows.select(F.pmod(F.xxhash64("id"), F.lit(self.shards)).cast("int").alias("shard"), "id", "vec", F.col("ts_days").cast("double").alias("ts_days"), F.lit(False).alias("deleted"))
        touched = new.select("shard").distinct()
        nodes = self.nodes.unionByName(new)
        edges = self.edges.join(touched, "shard", "left_anti").unionByName(_edges(nodes.join(touched, "shard", "left_semi"), self.plan))
        return GraphIndex(nodes, tables.written(edges), self.plan, self.shards)

    def delete(self, ids: DataFrame, deleted: bool = True) -> GraphIndex:
        """The index with ``ids(id)`` marked deleted (or not): they stay in the graph and are never returned."""
        mark = ids.select("id", F.lit(True).alias("__hit")).distinct()
        nodes = self.nodes.join(mark, "id", "left").withColumn("deleted", F.when(F.col("__hit"), F.lit(deleted)).otherwise(F.col("deleted"))).drop("__hit")
        return GraphIndex(nodes.select(*self.nodes.columns), self.edges, self.plan, self.shards)

    def point(self, id_: int) -> DataFrame:
        return self.nodes.filter(F.col("id") == id_).select("id", "vec", "ts_days", "deleted")

    def levelled(self) -> DataFrame:
        """``nodes(id, level, vec, ts_days)``: a row's level is the highest at which it has an out-edge."""
        top = self.edges.filter("kind = 'graph'").groupBy(F.col("src").alias("id")).agg(F.max("level").alias("level"))
        return self.nodes.join(top, "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"), "vec", "ts_days")

    def integrity(self) -> DataFrame:
        """One row: edges, dangling ends, loops, repeated edges, nodes over their degree."""
        known = self.nodes.select("shard", F.col("id").alias("dst"), F.lit(True).alias("known"))
        per = self.edges.join(known, ["shard", "dst"], "left").groupBy("kind", "level", "src").agg(
            F.count("*").alias("degree"), F.countDistinct("dst").alias("kinds"), F.count_if(F.col("known").isNull()).alias("dangling"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))
        return per.agg(F.sum("degree").alias("edges"), F.sum("dangling").alias("dangling"), F.sum("loops").alias("loops"), F.sum(F.col("degree") - F.col("kinds")).alias("repeats"), F.count_if(F.col("degree") > 2 * self.plan.m).alias("over_degree"))

    def save(self, path: str) -> None:
        import dataclasses
        import json

        self.nodes.write.partitionBy("shard").parquet(f"{path}/nodes")
        self.edges.write.partitionBy("shard").parquet(f"{path}/edges")
        plain = json.dumps(dataclasses.asdict(self.plan) | {"shards": self.shards}, default=lambda v: v.value)
        self.nodes.sparkSession.createDataFrame([(plain,)], "value string").coalesce(1).write.text(f"{path}/plan")

    @classmethod
    def load(cls, spark, path: str) -> GraphIndex:
        """The index as saved; an invalid plan raises."""
        import json

        from fadeline.config import Schedule

        d = json.loads(spark.read.text(f"{path}/plan").first()[0])
        shards, c = d.pop("shards"), d.pop("decay")
        decay = Decay(**c | {"mode": Mode(c["mode"]), "pair_mode": PairMode(c["pair_mode"]), "schedule": Schedule(c["schedule"]), "kappa_levels": tuple(c["kappa_levels"])})
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), Plan(decay=decay, **d | {"factors": tuple(d["factors"])}), shards)


def _edges(nodes: DataFrame, plan: Plan) -> DataFrame:
    def run(key, table):
        table = table.sort_by("id").combine_chunks()
        ids, ts = table["id"].to_numpy(), table["ts_days"].to_numpy()
        x = table["vec"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        kind, level, src, place, dst = zip(*build_shard(ids, x, ts, plan), strict=True) if len(ids) > 1 else ((),) * 5
        return pa.table({"shard": pa.array([key[0].as_py()] * len(src), pa.int32()), "kind": pa.array(kind, pa.string()), "level": pa.array(level, pa.int32()), "src": pa.array(src, pa.int64()), "rank": pa.array(place, pa.int32()), "dst": pa.array(dst, pa.int64())})

    rows = nodes.select("shard", "id", F.col("vec").cast("array<double>").alias("vec"), "ts_days")
    return rows.groupBy("shard").applyInArrow(run, "shard int, kind string, level int, src bigint, rank int, dst bigint")


def two_hop(edges: DataFrame, cap: int) -> DataFrame:
    """(src, dst) over one or two edges, loops left out, at most ``cap`` for a source: by hops, then ranks, then id."""
    from pyspark.sql import Window

    one = edges.select("src", "dst", F.lit(1).alias("hops"), F.col("rank").cast("bigint").alias("cost"))
    two = one.join(one.select(F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("cost").alias("more")), "dst").select("src", F.col("far").alias("dst"), F.lit(2).alias("hops"), (F.col("cost") + F.col("more")).alias("cost"))
    best = one.unionByName(two).filter("src <> dst").groupBy("src", "dst").agg(F.min(F.struct("hops", "cost")).alias("c"))
    w = Window.partitionBy("src").orderBy("c", "dst")
    return best.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= cap).select("src", "rank", "dst")


def merge_neighbours(a: DataFrame, b: DataFrame, cap: int) -> DataFrame:
    """Union of two edge lists (src, dst) without repeats, at most ``cap`` for a source, smallest ids first."""
    from pyspark.sql import Window

    both = a.select("src", "dst").unionByName(b.select("src", "dst")).distinct()
    w = Window.partitionBy("src").orderBy("dst")
    return both.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= cap).select("src", "rank", "dst")


def reachable_components(edges: DataFrame) -> DataFrame:
    """(node, component): label propagation to the smallest id over edges taken both ways."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    label = both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        near = both.join(label.select(F.col("node").alias("dst"), F.col("component").alias("theirs")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("theirs").alias("theirs"))
        new = label.join(near, "node").select("node", F.least("component", "theirs").alias("component"), (F.col("theirs") < F.col("component")).alias("moved"))
        # a jump to the component's own label shortens long chains
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = new.join(jump, "component").select("node", F.col("up").alias("component"), "moved").checkpoint()
        if not new.filter("moved").limit(1).count():
            return new.select("node", "component")
        label = new.select("node", "component")
