"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are turned into the principal axes of the whole collection, so that the leading dimensions
carry most of every product. Vectors of a label are ordered by their leading dimensions and cut into tiles,
each one packed row with a box around its leading dimensions. Tiles whose boxes are too far apart for any pair to
reach the threshold never meet; no vector is sent for them. Others are compared pair by pair: products
are accumulated over the leading dimensions first, and what the rest can add is bounded by the norms of
the suffixes. A pair whose cosine can no longer reach the threshold is dropped; the survivors are
decided by the plain cosine of the stored vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadeline.llm._common import discard, gathered, settle
from fadeline.llm.components import components

#: Vectors in a tile, at most; a task compares two tiles. Tiles of a label that one tile is held against in one task.
TILE, MEET = 1024, 256
#: Leading dimensions whose bits order the vectors, and those that a tile's box bounds.
_ORDER, _BOX = 4, 8
#: What rounding in single steps can amount to; pairs within it of the threshold stay for the exact decision.
_SLACK = 1e-9


def principal_axes(vectors: DataFrame, vector: str) -> dict[int, np.ndarray]:
    """For each dimension of vectors that occurs, the axes (columns) by falling variance.

    Sums of products over all vectors, scaled to length 1: d * d numbers for each task and
    dimension reach the shuffle, d * d the driver, whatever the number of vectors.
    """

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, x in _by_dimension(b[0]):
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d * d, pa.int32()), pa.array(range(d * d), pa.int32()), pa.array(m.ravel())], names=["d", "k", "v"])

    rows = vectors.select(vector).mapInArrow(moments, "d int, k int, v double").groupBy("d", "k").agg(F.sum("v").alias("v")).toPandas()
    axes = {}
    for d, part in rows.groupby("d"):
        m = np.zeros(d * d)
        m[part["k"]] = part["v"]
        axes[int(d)] = np.ascontiguousarray(np.linalg.eigh(m.reshape(d, d))[1][:, ::-1])
    return axes


def _by_dimension(lists: pa.Array):
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes == sizes[0]).all():
        yield int(sizes[0]), lists.flatten().to_numpy().astype(np.float64).reshape(len(lists), sizes[0])
        return
    for d in np.unique(sizes):
        part = lists.filter(pa.array(sizes == d))
        yield int(d), part.flatten().to_numpy().astype(np.float64).reshape(len(part), d)


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, axes: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of rows of ``x`` and ``y`` whose cosine reaches the threshold (``same``: i < j only)."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    u, v = (x / nx[:, None]) @ axes, (y / ny[:, None]) @ axes
    d = u.shape[1]
    steps = [s for s in (d // 8, d // 4, d // 2) if s] + [d]
    rest = lambda z: np.sqrt(np.maximum(np.cumsum((z * z)[:, ::-1], axis=1)[:, ::-1], 0))
    ru, rv = (np.pad(rest(z), ((0, 0), (0, 1))) for z in (u, v))
    total = u[:, : steps[0]] @ v[:, : steps[0]].T
    alive = total + ru[:, steps[0], None] * rv[None, :, steps[0]] >= threshold - _SLACK
    if same:
        alive &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
    i, j = np.nonzero(alive)
    total = total[i, j]
    for a, b in zip(steps, steps[1:], strict=False):
        for at in range(0, len(i), 1 << 18):  # in blocks, so that memory doesn't follow the number of pairs
            cut = slice(at, at + (1 << 18))
            total[cut] += np.einsum("ij,ij->i", u[i[cut], a:b], v[j[cut], a:b])
        ok = total + ru[i, b] * rv[j, b] >= threshold - _SLACK
        i, j, total = i[ok], j[ok], total[ok]
    exact = np.empty(len(i))
    for at in range(0, len(i), 1 << 18):
        cut = slice(at, at + (1 << 18))
        exact[cut] = np.einsum("ij,ij->i", x[i[cut]], y[j[cut]]) / (nx[i[cut]] * ny[j[cut]])
    ok = exact >= threshold
    return i[ok], j[ok]


def _unpack(packed: bytes, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, copies, vectors in double precision) of a packed tile."""
    wide, n = packed[0] == 1, int.from_bytes(packed[1:9], "little")
    ids, copies = (np.frombuffer(packed, np.int64, n, 9 + 8 * n * k) for k in (0, 1))
    return ids, copies, np.frombuffer(packed, np.float64 if wide else np.float32, n * d, 9 + 16 * n).astype(np.float64).reshape(n, d)


def _tiles(node: DataFrame, axes) -> DataFrame:
    """(label, d, tile, low, high, packed): tiles of at most ``TILE`` vectors of a label, and the boxes around their leading dimensions.

    Vectors are ordered by the interleaved bits of their first ``_ORDER`` principal coordinates, so that a tile's box is
    small. Values that are single-precision numbers are packed as such; both forms hold them exactly.
    """
    from pyspark import TaskContext
    from pyspark.sql import types as T

    kind = node.schema["label"].dataType

    def place(batches):
        for b in batches:
            z = np.zeros(len(b), np.int64)
            lists = b["v"]
            sizes = np.diff(lists.offsets.to_numpy())
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = lists.filter(pa.array(sizes == d)).flatten().to_numpy().reshape(len(at), d)
                u = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes.value[int(d)][:, :_ORDER]
                cell = np.clip(((u + 1) * 2048).astype(np.int64), 0, 4095)
                code = np.zeros(len(at), np.int64)
                for bit in range(11, -1, -1):
                    for k in range(cell.shape[1]):
                        code = code << 1 | cell[:, k] >> bit & 1
                z[at] = code
            yield pa.RecordBatch.from_arrays([b["label"], pa.array(sizes, pa.int32()), pa.array(z), b["node"], b["copies"], lists], names=["label", "d", "z", "node", "copies", "v"])

    def tile(batches):
        number, key, held = TaskContext.get().partitionId() << 33, None, []

        def cut(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal number
            d = rows["d"][0].as_py()
            x = rows["v"].flatten().to_numpy().reshape(len(rows), d)
            u = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes.value[d][:, :_BOX]
            small = x.astype(np.float32)
            wide = not (small == x).all()
            packed = bytes([wide]) + len(rows).to_bytes(8, "little") + rows["node"].to_numpy().tobytes() + rows["copies"].to_numpy().tobytes() + (x if wide else small).tobytes()
            number += 1
            return pa.RecordBatch.from_arrays([rows["label"][:1], rows["d"][:1], pa.array([number - 1]), pa.array([u.min(0).tolist()]), pa.array([u.max(0).tolist()]), pa.array([packed], pa.binary())], names=["label", "d", "tile", "low", "high", "packed"])

        def full():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            return cut(whole)

        for b in batches:
            of = list(zip(b["label"].to_pylist(), b["d"].to_pylist(), strict=True))
            at = 0
            while at < len(of):
                if key != of[at] and held:
                    yield full()
                key, room = of[at], TILE - sum(map(len, held))
                to = at
                while to < len(of) and to - at < room and of[to] == key:
                    to += 1
                held.append(b.slice(at, to - at))
                at = to
                if sum(map(len, held)) == TILE:
                    yield full()
        if held:
            yield full()

    fields = lambda *rest: T.StructType([T.StructField("label", kind), *T.StructType.fromDDL(", ".join(rest)).fields])
    placed = node.select("label", "node", "copies", "v").mapInArrow(place, fields("d int", "z bigint", "node bigint", "copies bigint", "v array<double>"))
    n = int(node.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = settle(placed).repartitionByRange(n, "label", "d", "z", "node").sortWithinPartitions("label", "d", "z", "node")
    return ordered.mapInArrow(tile, fields("d int", "tile bigint", "low array<double>", "high array<double>", "packed binary"))


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows link when their labels are equal and not null and their cosine reaches the threshold.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do
    vectors of different lengths. Equal vectors collapse first and count by number, so large groups
    of copies cost one comparison. ``component_id``: smallest id reachable, the row's own included.
    Repeated ids stay rows of their own; a row with a null id and no link keeps a null component.
    """
    rows = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    v = F.col("v")
    sound = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull())
    good = rows.filter("ok")
    node = settle(good.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    axes = node.sparkSession.sparkContext.broadcast(principal_axes(node, "v"))
    tiles = settle(_tiles(node, axes))
    # boxes of unit vectors: a cosine of at least c means a distance of at most sqrt(2 - 2 c), in any dimensions
    box = tiles.select("label", "d", "tile", "low", "high")
    number = box.groupBy("label", "d").agg(F.ceil(F.count("*") / MEET).cast("int").alias("parts"))
    left = box.join(number, ["label", "d"]).withColumn("part", F.pmod(F.xxhash64("tile"), F.col("parts")).cast("int"))
    right = box.join(number, ["label", "d"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("label", "d", "part", F.col("tile").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    gap = F.zip_with(F.zip_with("low", "high2", lambda x, y: x - y), F.zip_with("low2", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    meets = left.join(right, ["label", "d", "part"]).filter("tile <= other").filter(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x * x) <= 2 - 2 * threshold + _SLACK).select("label", "d", F.col("tile").alias("i"), F.col("other").alias("j"))
    meets = settle(meets)
    one = lambda side: meets.join(tiles.select("label", "d", F.col("tile").alias(side), "packed"), ["label", "d", side]).select("label", "d", "i", "j", F.lit(side).alias("side"), "packed")
    seats = one("i").unionByName(one("j").filter("i <> j"))

    def compare(key, table):
        d, i, j = (key[k].as_py() for k in (1, 2, 3))
        sides = [_unpack(table["packed"][k].as_py(), d) for k in np.argsort(table["side"].to_pylist())]
        (ids_i, copies_i, x), (ids_j, copies_j, y) = sides[0], sides[-1]
        a, b = tile_links(x, y, threshold, axes.value[d], i == j)
        ids, copies = (ids_i, copies_i) if i == j else (np.r_[ids_i, ids_j], np.r_[copies_i, copies_j])
        b = b if i == j else b + len(ids_i)
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        root = np.arange(len(ids))
        while len(a):  # smallest position of each connected group within the pair of tiles
            before = root.copy()
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
            root = root[root]
            if (root == before).all():
                break
        has = np.flatnonzero(links)
        return pa.table({"node": pa.array(ids[has]), "links": pa.array(links[has].astype(np.int64)), "root": pa.array(ids[root[has]])})

    found = settle(seats.groupBy("label", "d", "i", "j").applyInArrow(compare, "node bigint, links bigint, root bigint"))
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = settle(node.join(links, "node", "left").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    least = named.groupBy("comp").agg(F.min("least").alias("component"))
    least = settle(least)
    named = settle(named.join(least, "comp").select("label", "v", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = good.join(named, ["label", "v"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    out = out.unionByName(rows.filter("NOT ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    discard(found, tiles, meets, least, node)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
