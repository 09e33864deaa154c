"""Exact n-gram Jaccard join with a token-group matrix.

Documents become sets of word shingles. Similar documents are partitioned into groups, each group's
token union bounds how much of a query document any member can hold, and only groups that the bound
lets through are opened and compared member by member. All results are exact up to 64-bit hashes.

1. ``token_order``: a fixed-size counting sketch over all documents ranks frequent shingles last.
2. ``document_sets``: every document's set by name and size, a parity bitmap of 2 to 4 bits a token, and its
   prefix: the rarest tokens, one of which any partner must share. Copies collapse by name before any join.
   ``_buckets`` brings equal prefix tokens together in packed columns; tokens of one set alone end there.
3. Groups: in every bucket of a prefix token each document meets one centre; documents near the same
   centre form a group, cut into parts of about ``GROUP`` members. Each part is compared with itself and
   the next one, which connects nearly all of a dense group at a cost linear in its size.
4. The matrix: bucket by bucket, (token, part) against the documents not yet connected with what the
   part holds. A document meets a part once; its tokens in the part's union bound what any member can
   share with it, and the part is opened only if that is enough.

Nothing is dropped or capped: hot tokens only change the order, never the candidates' completeness.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fadeline.llm._common import delete, discard, forget, free_name, gathered, pack_columns, row_key, settle, sieve, trim, unpack_columns, without
from fadeline.llm.components import components
from fadeline.llm.shingles import mix, shingle_hashes, text_slices

#: The sketch: 2**22 cells, of which the fullest, ORDER_CELLS at most, are sent to executors (about 1 MB), whatever the input.
CELL_BITS, CELL_LEAST, ORDER_CELLS = 22, 16, 1 << 17
#: Prefix tokens in a bucket of the exchange, on average; tokens of cells of level SPREAD and up are dealt over several.
BUCKET, SPREAD = 1 << 17, 20
#: Largest number of members in a part of a group, and of queries held against it in one task.
GROUP, QUERIES = 128, 256
#: Documents near no centre that make a group all the same, when so many have met the same one.
LOOSE = 32


def least_shared(n: int, num: int, den: int) -> int:
    """Tokens that a set of ``n`` must share with any partner: ceil(n * num / den)."""
    return -(-n * num // den)


def _sets(batch: pa.RecordBatch, text: str, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for at, data, cuts in text_slices(batch[text]):
        hashes, first, n = shingle_hashes(data, cuts, k)
        for i in range(len(first)):
            yield at + i, np.unique(hashes[first[i] : first[i] + n[i]])


def _node(u: np.ndarray) -> int:
    """The name of a set: equal sets, equal names."""
    u = u.view(np.uint64)
    return int(mix(mix(u + np.uint64(len(u))).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def token_order(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """A level from 0 to 63 for each cell of the sketch; a higher level means more frequent.

    A task tells the cells that stand out of its own mean, and a cell's level is what it holds beyond the mean of all.
    """

    def count(batches):
        forget()
        total, waiting, n_waiting = np.zeros(1 << CELL_BITS, np.int32), [], 0
        for b in batches:
            for _, data, cuts in text_slices(b[0]):
                hashes, first, n = shingle_hashes(data, cuts, k)
                keep = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(keep, first, 1)
                np.add.at(keep, first + n, -1)
                waiting.append((hashes[np.cumsum(keep)[:-1] > 0] >> np.uint64(64 - CELL_BITS)).astype(np.int32))
                n_waiting += len(waiting[-1])
                if n_waiting > 1 << 20:
                    total += np.bincount(np.concatenate(waiting), minlength=len(total)).astype(np.int32)
                    waiting, n_waiting = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=len(total)).astype(np.int32)
        mean = total.mean()
        cells = np.flatnonzero(total >= max(3, mean + 3 * mean**0.5))
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells] - int(mean), pa.int64())], names=["cell", "n"])

    cells = settle(docs.select(F.col(text).alias("t")).mapInArrow(count, "cell int, n bigint")
                   .groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") >= CELL_LEAST).withColumn("level", F.floor(F.log2("n"))))
    # the highest levels, as many as the driver has room for
    lowest, room = 64, ORDER_CELLS
    for r in cells.groupBy("level").count().orderBy(F.desc("level")).collect():
        if (room := room - r["count"]) < 0:
            break
        lowest = r["level"]
    rows = cells.filter(F.col("level") >= lowest).select("cell", "level").toPandas()
    delete(cells)
    level = np.zeros(1 << CELL_BITS, np.uint8)
    level[rows["cell"].to_numpy(np.int64)] = rows["level"].to_numpy(np.int64) if len(rows) else 0
    return level


def document_sets(docs: DataFrame, doc_id: str, text: str, k: int, num: int, den: int, level, row: str | None = None) -> DataFrame:
    """(doc_id, n, name, node, parity, prefix[, row]) of every document, with the bigint column ``row`` as it is.

    ``name`` is the set's, null for one without tokens; ``node`` numbers the rows. ``level`` is the broadcast order of tokens.
    """
    through = [row] if row else []

    def sets(batches):
        forget()
        rank, at = level.value, TaskContext.get().partitionId() << 33
        for b in batches:
            size, name, parity, prefix = [], [], [], []
            for _, u in _sets(b, "t", k):
                n = len(u)
                size.append(n)
                if not n:
                    name.append(None), parity.append(None), prefix.append(None)
                    continue
                name.append(_node(u))
                width = max(64, 1 << (2 * n - 1).bit_length())
                bits = np.bincount((u & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                parity.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
                order = np.argsort(rank[u >> np.uint64(64 - CELL_BITS)], kind="stable")
                # 48 bits are enough to meet by: a chance meeting costs a comparison, never a result
                prefix.append((u[order[: n - least_shared(n, num, den) + 1]] >> np.uint64(16)).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b[0], pa.array(size, pa.int64()), pa.array(name, pa.int64()), pa.array(range(at, at + len(size)), pa.int64()), pa.array(parity, longs), pa.array(prefix, longs), *b.columns[2:]],
                                             names=["doc_id", "n", "name", "node", "parity", "prefix", *through])
            at += len(size)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"), *through).mapInArrow(
        sets, "doc_id bigint, n bigint, name bigint, node bigint, parity array<bigint>, prefix array<bigint>" + "".join(f", `{c}` bigint" for c in through))


def _buckets(sets: DataFrame, level, total: int, ratio: float) -> DataFrame:
    """(token, node, n, room, centre, centre_order, centre_n, centre_room) for prefix tokens that more than one of ``sets(node, n, prefix)`` holds.

    ``total``: about the number of prefix tokens. They travel as packed columns, a few bytes a token, to buckets of
    about ``BUCKET``; those of very frequent cells go by their set's number as well, so that no token fills
    a task (they keep rows that may be alone). A bucket's centre of a token is one set for all others of its size to
    meet (up to a factor of ``ratio``, as sets that link have), the first in an order that is the same for all
    tokens (``centre_order``), so that alike sets meet the same centres.
    A first shared token at positions (i, j) leaves at most min(n_a - i, n_b - j) shared tokens: ``room``.
    """
    buckets = max(1, -(-total // BUCKET))
    spread = lambda token, rank: rank[token >> (48 - CELL_BITS)]

    def pack(batches):
        rank = level.value
        for b in gathered(batches):
            lists = b["prefix"]
            size = np.diff(lists.offsets.to_numpy())
            token, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
            node, n = b["node"].to_numpy()[owner], b["n"].to_numpy()[owner]
            pos = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            salt = node & ((1 << np.maximum(spread(token, rank).astype(np.int64) - SPREAD + 1, 0)) - 1)
            bucket = (mix((token ^ (salt << 48)).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((token, bucket))
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
            columns = [x[order] for x in (token, node, n, pos)]
            ends = np.r_[cuts[1:], len(order)] if len(order) else []
            blobs = [pack_columns([x[at:to] for x in columns]) for at, to in zip(cuts if len(order) else [], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts] if len(order) else [], pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "packed"])

    def meet(table: pa.Table) -> pa.Table:
        rank, parts = level.value, [unpack_columns(z, 4) for z in table["packed"].to_pylist()]
        token, node, n, pos = (np.concatenate([p[i] for p in parts]) for i in range(4))
        turn = (mix(node.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
        kind = np.floor(np.log(n) / np.log(max(ratio, 1.0001)))
        order = np.lexsort((turn, kind, token))
        token, node, turn, n, room, kind = token[order], node[order], turn[order], n[order], (n - pos)[order], kind[order]
        new = np.r_[True, token[1:] != token[:-1]]
        head = new | np.r_[True, kind[1:] != kind[:-1]]
        first = np.flatnonzero(head)[np.cumsum(head) - 1]  # the centre is the set with the smallest hash
        shared = ~new | np.r_[~new[1:], False] | (spread(token, rank) >= SPREAD)
        at = first[shared]
        return pa.table({"token": token[shared], "node": node[shared], "n": n[shared], "room": room[shared], "centre": node[at], "centre_order": turn[at], "centre_n": n[at], "centre_room": room[at]})

    shape = "token bigint, node bigint, n bigint, room bigint, centre bigint, centre_order bigint, centre_n bigint, centre_room bigint"
    return sets.select("node", "n", "prefix").mapInArrow(pack, "bucket bigint, packed binary").groupBy("bucket").applyInArrow(meet, shape)


def _apart(a: str, b: str):
    """Bits in which two parity bitmaps differ: never more than the sets' symmetric difference has tokens."""
    width = F.least(F.size(f"parity_{a}"), F.size(f"parity_{b}"))
    # a bitmap of twice the width folds onto the other; sizes that can link are never further apart
    fold = lambda c: F.when(F.size(c) > width, F.zip_with(F.slice(c, F.lit(1), width), F.slice(c, width + 1, width), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))
    return F.aggregate(F.zip_with(fold(f"parity_{a}"), fold(f"parity_{b}"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _close(a: str, b: str, num: int, den: int):
    """What sizes and parity bitmaps allow a pair: never rejects one that links."""
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    most = na + nb - 2 * F.ceil((na + nb) * num / F.lit(float(num + den)) - 1e-9)
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (_apart(a, b) <= most)


def _within_two(a: str, b: str, num: int, den: int):
    """What allows ``a`` to link with something that links with ``b``: differences add up at most.

    A bitmap of more than twice the other's width would need folding twice; such pairs pass unseen.
    """
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    between = F.least(na, nb) * (den / num)
    most = (na + 2 * between + nb) * ((den - num) / (den + num)) + 1e-6
    wide = F.greatest(F.size(f"parity_{a}"), F.size(f"parity_{b}")) > 2 * F.least(F.size(f"parity_{a}"), F.size(f"parity_{b}"))
    return wide | (_apart(a, b) <= most)


def _open_groups(docs: DataFrame, doc_id: str, text: str, k: int, node: DataFrame, meets: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Links of queries ``meets(a, seed, part)`` with members of groups' parts ``members(node, seed, part)``.

    One key holds one part's members (about ``GROUP``) and one slice of its queries. The part's token
    union bounds the overlap with every member; a query opens the part only beyond it. Of the links
    found, those that connect are returned: (a, b), at most one for each document in a key. Texts,
    which compress better than hashes, go to where they are compared and become sets there.
    """
    many = meets.groupBy("seed", "part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("slices"))
    queries = (meets.join(many, ["seed", "part"]).select(F.col("a").alias("node"), "seed", "part", F.pmod(F.xxhash64("a"), F.col("slices")).cast("int").alias("slice"), F.lit(False).alias("held")))
    held = (members.join(many, ["seed", "part"]).select("node", "seed", "part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("held")))
    seats = settle(queries.unionByName(held).join(node.select("node", "name", "doc_id"), "node"))
    bins = max(1, seats.count() // 256)
    seats = seats.withColumn("bin", F.pmod(F.xxhash64("seed", "part", "slice"), F.lit(bins)).cast("int"))

    def compare(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, int]]:
        ids = right["node"].to_numpy()
        own = [v.values.to_numpy() for v in right["set"]]
        size = np.array([len(v) for v in own])
        union, index = np.unique(np.concatenate(own), return_inverse=True)
        owner = np.repeat(np.arange(len(own)), size)
        order = np.argsort(index, kind="stable")
        postings, cut = owner[order], np.r_[0, np.cumsum(np.bincount(index, minlength=len(union)))]
        root = {}

        def top(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for a, v in zip(left["node"].to_pylist(), left["set"], strict=True):
            q = v.values.to_numpy()
            at = np.searchsorted(union, q)
            at[at == len(union)] = 0
            at = at[union[at] == q]
            if len(at) < least_shared(len(q), num, den):
                continue  # the bound: no member can hold enough of the query
            shared = np.bincount(np.concatenate([postings[cut[i] : cut[i + 1]] for i in at]), minlength=len(own)) if len(own) > 1 else np.array([len(at)])
            for b in ids[den * shared >= num * (len(q) + size - shared)].tolist():
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
        for x in list(root):
            if top(x) != x:
                yield x, root[x]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        unpack = zstandard.ZstdDecompressor().decompress
        texts = pa.array([unpack(z) for z in table["t"].to_pylist()], pa.large_binary())
        sets = [u.view(np.int64) for _, u in _sets(pa.RecordBatch.from_arrays([texts], names=["t"]), "t", k)]
        right = [_node(u) == n for u, n in zip(sets, table["name"].to_pylist(), strict=True)]  # another document may share an id
        table = table.drop_columns(["t", "name"]).append_column("set", pa.array(sets, pa.list_(pa.int64()))).filter(pa.array(right, pa.bool_()))
        table = table.sort_by([("seed", "ascending"), ("part", "ascending"), ("slice", "ascending"), ("held", "ascending")]).combine_chunks()
        keys = [table[c].to_numpy() for c in ("seed", "part", "slice")]
        new = np.flatnonzero(np.r_[True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])]) if len(table) else []
        links = []
        for at, to in zip(new, np.r_[new[1:], len(table)] if len(table) else [], strict=True):
            own = table["held"].slice(at, to - at).to_numpy()
            if 0 < own.sum() < len(own):
                split = at + len(own) - int(own.sum())
                links += compare(table.slice(at, split - at), table.slice(split, to - split))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    found = _texts_of(docs, doc_id, text, seats)
    seated = seats.join(found, seats["doc_id"].eqNullSafe(found["d"])).select("bin", "seed", "part", "slice", "held", "node", "name", "t")
    links = settle(seated.groupBy("bin").applyInArrow(run, "a bigint, b bigint").distinct())
    discard(seats)
    return links


def jaccard_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 8, den: int = 10, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(documents, links)``: documents (doc_id, n, node[, row]) and links (a, b) between distinct sets.

    Two sets link when ``den * |A & B| >= num * |A | B|``. The links are complete in this sense: two
    different sets that link are connected by them, directly or over others that link. Copies of a
    set share a node. A document without words (or with null text) has n = 0 and a null node.
    """
    level = docs.sparkSession.sparkContext.broadcast(token_order(docs, text, k))
    node = settle(document_sets(docs, doc_id, text, k, num, den, level, row))
    through = [row] if row else []
    # a set goes by the number of one of its rows; copies of it go no further than this
    first = settle(node.filter("name IS NOT NULL").groupBy("name").agg(F.min("node").alias("first")))
    rows = settle(node.select("doc_id", "n", "name", F.col("node").alias("own"), *through).join(first, "name", "left"))
    copies = rows.filter("own <> first").select("own")
    rows = rows.select("doc_id", "n", F.col("first").alias("node"), *through)
    once = without(node.filter("name IS NOT NULL").select("node", "n", "prefix"), "node", copies)
    total = node.select(F.sum(F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1)).first()[0] or 0
    bucket = settle(_buckets(once, level, int(total), den / num))
    discard(first)
    slim = node.select("node", "n", "parity")
    side = lambda c: slim.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}"))
    near = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").filter(_close("a", "b", num, den)).select("a", "b")
    # shared tokens needed: den * s >= num * (x + y - s)
    fits = lambda x, y, x_room, y_room: (F.least(x_room, y_room) * (num + den) >= (F.col(x) + F.col(y)) * num)
    open_ = lambda x, y: (F.col(x) * den >= F.col(y) * num) & (F.col(y) * den >= F.col(x) * num)

    # groups: documents that look near the same centre; a document near none is a group by itself
    flat = bucket.filter("node <> centre").filter(open_("n", "centre_n") & fits("n", "centre_n", F.col("room"), F.col("centre_room")))
    met = flat.select(F.col("node").alias("a"), F.col("centre").alias("b"), F.col("centre_order").alias("h")).distinct().join(side("a"), "a").join(side("b"), "b").filter(_within_two("a", "b", num, den)).select("a", "b", "h")
    tight = settle(met.groupBy(F.col("a").alias("node")).agg(F.min(F.struct("h", "b"))["b"].alias("seed")))
    # where the centre that many meet is far from all of them, they still share its tokens with one another
    stray = settle(bucket.filter("node <> centre").filter(open_("n", "centre_n")).select("node", "centre", "centre_order").join(tight.select("node"), "node", "left_anti").groupBy("node").agg(F.min(F.struct("centre_order", "centre"))["centre"].alias("seed")))
    loose = stray.join(stray.groupBy("seed").agg(F.count("*").alias("held")).filter(F.col("held") >= LOOSE).select("seed"), "seed", "left_semi").select("node", "seed")
    seed = settle(tight.unionByName(loose))
    # a centre without a centre of its own is a member of its group
    own = seed.select(F.col("seed").alias("node")).distinct().join(seed.select("node"), "node", "left_anti").select("node", F.col("node").alias("seed"))
    members = seed.unionByName(own)
    parts = members.groupBy("seed").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"), F.count("*").alias("held")).filter("held > 1").drop("held")
    members = settle(members.join(parts, "seed").select("node", "seed", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")))
    # each part against itself and the next: nearly all of a dense group is connected by that
    turn = F.explode(F.expr("CASE WHEN parts > 1 THEN array(part, (part + 1) % parts) ELSE array(part) END"))
    links = _open_groups(docs, doc_id, text, k, node, members.select(F.col("node").alias("a"), "seed", turn.alias("part")), members.select("node", "seed", "part"), num, den)

    # the matrix: documents against the parts near them that hold anything not yet connected with them
    comp = components(links)
    comp = comp.join(comp.groupBy("comp").agg(F.count("*").alias("size")), "comp")
    info = settle(members.join(comp, "node", "full").select("node", F.coalesce("seed", "node").alias("seed"), F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("comp", "node").alias("comp"), F.coalesce("size", F.lit(1)).alias("size")))
    alone, some = sieve(bucket.select("node", "n", "room", "token"), "node", info.select("node"))  # most rows are of documents without a group or link
    w = Window.partitionBy("token")
    named = (some.join(info, "node", "left")
             .select("token", "node", "n", "room", F.coalesce("comp", "node").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("seed", "node").alias("seed"), F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("parts", F.lit(0)).alias("parts"))
             .unionByName(alone.select("token", "node", "n", "room", F.col("node").alias("comp"), F.lit(1).cast("bigint").alias("size"), F.col("node").alias("seed"), F.lit(0).alias("part"), F.lit(0).cast(info.schema["parts"].dataType).alias("parts")))
             .withColumn("mixed", F.max("comp").over(w) != F.min("comp").over(w)).filter("mixed").drop("mixed"))
    named = settle(named).repartition("token")  # both sides of the matrix are made from this one exchange
    column = named.groupBy("token", "seed", "part", "parts", "comp", "size").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("room").alias("group_room"))
    column = column.select("token", F.col("seed").alias("group"), F.col("part").alias("group_part"), F.col("parts").alias("group_parts"), F.col("comp").alias("group_comp"), F.col("size").alias("group_size"), "low", "high", "group_room")
    # only members of a group have been compared; a document without one may be the centre of another's (parts = 0 tells it apart)
    done = "seed = group AND parts > 0 AND group_parts > 0 AND (part = group_part OR group_part = (part + 1) % parts OR part = (group_part + 1) % parts)"
    meets = settle(named.join(column, "token").filter("struct(size, comp) < struct(group_size, group_comp)").filter(f"NOT ({done})")
                   .filter((F.col("n") * den >= F.col("low") * num) & (F.col("high") * den >= F.col("n") * num))
                   .filter(fits("n", "low", F.col("room"), F.col("group_room")))
                   .select(F.col("node").alias("a"), F.col("group").alias("seed"), F.col("group_part").alias("part"), F.col("group_parts") == 0).toDF("a", "seed", "part", "alone").distinct())
    single = settle(near(meets.filter("alone").select("a", F.col("seed").alias("b"))).select("a", F.col("b").alias("seed"), F.lit(0).alias("part")))
    meets2 = settle(meets.filter("NOT alone").select("a", "seed", "part").unionByName(single))
    alone = single.select(F.col("seed").alias("node"), "seed", "part").distinct()
    more = _open_groups(docs, doc_id, text, k, node, meets2, settle(info.join(meets2.select("seed", "part").distinct(), ["seed", "part"], "left_semi").select("node", "seed", "part").unionByName(alone).distinct()), num, den)
    discard(node, bucket, tight, stray, seed, members, info, named, meets, meets2, single)  # links and rows are tables of their own
    return rows, links.unionByName(more)


def _texts_of(docs: DataFrame, doc_id: str, text: str, seats: DataFrame) -> DataFrame:
    """(d, t): ids and compressed texts of documents, of which those in ``seats(doc_id)`` are sure to be among them.

    A bitmap of 2**22 bits over the wanted ids (half a MB, whatever the input) goes to the executors and
    rules out most others before anything is shuffled; the join with the seats settles the rest.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 22))
    cells = (seats.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("cell"))
             .agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 31 AS INT)))").alias("bits")).toPandas())
    words = np.zeros(1 << 17, np.int64)
    words[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64) if len(cells) else 0
    maybe = docs.sparkSession.sparkContext.broadcast(words)

    def wanted(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            at = b["bit"].to_numpy()
            b = b.filter(pa.array((maybe.value[at >> 5] >> (at & 31)) & 1 == 1))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["d"], pa.array([pack((t.as_py() or "").encode()) for t in b["t"]], pa.binary())], names=["d", "t"])
        trim()

    return (docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t")).select(F.col("doc_id").alias("d"), "t", bit.alias("bit"))
            .mapInArrow(wanted, "d bigint, t binary"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    ``component_id`` is the smallest id reachable by links, the row's own included. A row without
    words keeps its own id. Rows with a null id are rows like others, but a null is never a
    component's id unless all ids of the component are null. Repeated ids stay repeated rows.
    """
    rows, links = jaccard_links(docs, doc_id, text, k, num, den)
    joined = rows.join(components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    joined = settle(joined)
    # written, so that a large component's rows can be dealt over several tasks
    least = settle(joined.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least")))
    return joined.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest id.

    All columns stay. Documents without words, and those with a null id, all stay. Of rows that
    repeat an id and a text, one stays. Rows are told apart by id and text: where several texts of a group
    have its smallest id, that with the smallest hash stays, and a text of another group isn't touched by it.
    """
    row = free_name(docs, "__row")
    named = docs.withColumn(row, F.when(F.col(doc_id).isNotNull(), row_key(doc_id, text)))
    rows, links = jaccard_links(named, doc_id, text, k, num, den, row)
    rows = settle(rows.filter("doc_id IS NOT NULL").join(components(links), "node", "left").select("doc_id", F.coalesce("comp", "node").alias("comp"), row)
                  .groupBy("doc_id", "comp", row).agg(F.count("*").alias("rows")))
    first = rows.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct("doc_id", row))[row].alias("first"))
    kept = without(named, row, rows.join(first, "comp").filter(F.col(row) != F.col("first")).select(row))
    repeated = rows.filter("rows > 1").select(row)
    if repeated.limit(1).count():
        again = kept.join(repeated.withColumnRenamed(row, "__again"), F.col(row) == F.col("__again"), "left_semi")
        kept = without(kept, row, repeated).unionByName(again.dropDuplicates([row]))
    return kept.select(*docs.columns)
