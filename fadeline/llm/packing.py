"""Best-fit packing of token pieces with a grouping genetic algorithm on islands.

A chromosome is a list of whole bins. Crossover injects a parent's well-filled bins into another
solution, deletes the bins that hold a piece twice, and best-fits the displaced pieces. Pieces are dealt
into shards of bounded size by row number; each shard is searched by several islands, every island a task's row of
its own with its own population. Between epochs, which are written to the shared folder, islands pass their elite
to the next one in a ring. What lies in bins that aren't well filled moves on to fewer, fresh shards, round by round,
while a tenth of it finds a place for good. So no task sees more than about ``SHARD`` pieces, whatever the input.
"""

from __future__ import annotations

import itertools
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadeline.llm._common import KEPT, delete, free_name, gathered, settle, trim

#: Pieces in a shard, on average; a bin that is fuller than WELL is final.
SHARD, WELL = 16_384, 0.998
#: Islands of a shard, solutions on an island, and generations in each of the epochs between which elites migrate.
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 2, 3, 8, 3

#: Texts of these alone are cut here: Latin letters, signs and punctuation that every engine classes, lowers and normalizes alike.
#: Others, and those that hold special tokens, are left to the library.
_PLAIN, _SPECIAL = r"^[\x09-\x0D\x20-\x7E\xA1-\x{12F}\x{131}-\x{24F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20AC}]*$", r"<\|(?:startoftext|endoftext)\|>"
#: Fixed by the vocabulary: the pattern of its pieces.
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The letter that byte-level vocabularies write for each byte; the space stays what parts the pieces.
_BARE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _BARE) if b != 0x20}


def _gather(values: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, their number for each of ``at``) of lists that lie one after the other in ``values``, taken in the order ``at``."""
    first, n = (np.cumsum(length) - length)[at], length[at]
    ends = np.cumsum(n)
    return values[np.repeat(first - (ends - n), n) + np.arange(n.sum())], n


class Tokens:
    """Ids of texts, by words that are cut once; the tokenizers library makes each piece's ids.

    Sound for vocabularies that drop white space, lower-case, and close each piece with a token of its
    own kind (``</w>``): no token spans two pieces. Texts of which engines could class, lower or normalize a
    character otherwise than the library does are left to it as they are.
    """

    def __init__(self, path: str, cached: int = 400_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the same merges over pieces that are cut, in lower case and written as bytes' letters already
        self._merges = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        self._last = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self._last[[i for s, i in spec["model"]["vocab"].items() if s.endswith("</w>")]] = True
        self._cached = cached
        #: Known pieces and their ids: one after the other, piece i has ``_length[i]``.
        self._known, self._ids, self._length = pa.array([""]), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _library(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each piece) of pieces, many in one text; where that doesn't come apart as expected, one by one."""
        ids, length = [], []
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000].to_pylist()
            text = " ".join(part)
            text = text if text.isascii() else text.encode().decode("latin-1").translate(_LETTERS)
            got = np.array(self._merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self._last[np.minimum(got, len(self._last) - 1)]) + 1
            if len(ends) == len(part) and (not len(got) or ends[-1] == len(got)):
                ids.append(got)
                length.append(np.diff(ends, prepend=0))
            else:
                each = self._library(part)
                ids += each
                length.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate(ids), np.concatenate(length)

    def _resolve(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each word) of distinct lower-cased words.

        Pieces that were met before are known; where they are too many, those of the words at hand stay.
        """
        cut = pc.ascii_rtrim_whitespace(pc.replace_substring_regex(words, _PIECE, r"\0 "))
        lists = pc.ascii_split_whitespace(cut)
        coded = lists.flatten().dictionary_encode()
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=self._known), -1).to_numpy().astype(np.int64)
        if len(new := np.flatnonzero(at < 0)):
            at[new] = np.arange(len(self._known), len(self._known) + len(new))
            fresh = coded.dictionary.take(pa.array(new))
            ids, length = self._learn(fresh)
            self._known = pa.concat_arrays([self._known, fresh])
            self._ids, self._length = np.r_[self._ids, ids], np.r_[self._length, length]
        ids, length = _gather(self._ids, self._length, at[coded.indices.to_numpy()])
        number = np.diff(np.r_[0, np.cumsum(length)][lists.offsets.to_numpy() - lists.offsets[0].as_py()])
        if len(self._known) > self._cached:
            stay = np.unique(np.r_[0, at])
            self._known = self._known.take(pa.array(stay))
            self._ids, self._length = _gather(self._ids, self._length, stay)
        return ids, number

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids as unsigned 32-bit integers; a null text has none.

        Arrow cuts the words of all texts at once and tells the distinct ones; only those are looked up.
        """
        texts = texts.cast(pa.string())
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        plain = pc.and_(pc.match_substring_regex(texts, _PLAIN), pc.invert(pc.match_substring_regex(texts, _SPECIAL)))
        simple = np.flatnonzero(pc.fill_null(plain, False).to_numpy(zero_copy_only=False)).tolist()
        at = np.flatnonzero(pc.fill_null(pc.invert(plain), False).to_numpy(zero_copy_only=False)).tolist()
        for i, ids in zip(at, self._library([texts[i].as_py() for i in at]), strict=True):
            out[i] = ids
        if simple:
            lists = pc.ascii_split_whitespace(pc.utf8_lower(texts.take(pa.array(simple))))
            coded = lists.flatten().dictionary_encode()
            flat, length = _gather(*self._resolve(coded.dictionary), coded.indices.to_numpy())
            cuts = np.r_[0, np.cumsum(length)][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            for k, i in enumerate(simple):
                out[i] = flat[cuts[k] : cuts[k + 1]]
        return out


_LOADED: dict[str, Tokens] = {}
KEPT.append(_LOADED)


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then ``end_id``.

    Only documents longer than ``capacity`` are cut, into pieces of ``capacity`` ids and a rest.
    Null and empty texts give one piece that holds the end id alone. Repeated ids repeat pieces.
    """

    def run(batches):
        if path not in _LOADED:
            _LOADED[path] = Tokens(path)
        tokens = _LOADED[path]
        trim()
        for b in gathered(batches, 4 << 20):
            rows: list[tuple] = []
            for d, ids in zip(b[0].to_pylist(), tokens.ids(b[1]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity].tobytes()
                    rows.append((d, k, at, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            out = [pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(out if with_ids else out[:5], names=names if with_ids else names[:5])
            del rows, cols, out
            trim()

    shape = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(F.col(doc_id).cast("bigint"), text).mapInArrow(run, shape)


def filling(bins: list[list[int]], lengths: np.ndarray) -> np.ndarray:
    """How much each bin holds."""
    if not bins:
        return np.zeros(0, np.int64)
    size = np.fromiter(map(len, bins), np.int64, len(bins))
    flat = np.fromiter(itertools.chain.from_iterable(bins), np.int64, int(size.sum()))
    return np.add.reduceat(lengths[flat], np.cumsum(size) - size)


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """``bins`` and the pieces of ``order`` in turn, each put where the least room is left over.

    A bit set of the rooms that occur finds the best fit in one step.
    """
    bins = bins if bins is not None else []
    at: dict[int, list[int]] = {}
    rooms = 0
    for k, room in enumerate((capacity - filling(bins, lengths)).tolist()):
        if room:
            at.setdefault(room, []).append(k)
            rooms |= 1 << room
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if fit := rooms >> n:
            room = n + (fit & -fit).bit_length() - 1
            k = at[room].pop()
            if not at[room]:
                rooms &= ~(1 << room)
            bins[k].append(i)
        else:
            k, room = len(bins), capacity
            bins.append([i])
        if left := room - n:
            at.setdefault(left, []).append(k)
            rooms |= 1 << left
    return bins


def _fitness(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> float:
    """Fewer bins first; among equals, the more uneven filling, which leaves more to work with."""
    fill = filling(bins, lengths) / capacity
    return float((fill**2).mean()) - len(bins)


def _cross(a: list[list[int]], b: list[list[int]], lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """``b``'s well-filled bins in ``a``: half of those that are full, of the others the fuller ones rather."""
    fill = filling(b, lengths) / capacity
    chosen = [b[i] for i in np.flatnonzero(rng.random(len(b)) < np.where(fill >= WELL, 0.7, 0.5 * (fill >= np.quantile(fill, 0.25))))]
    injected = np.zeros(len(lengths), np.int64)
    injected[list(itertools.chain.from_iterable(chosen))] = 1
    twice = filling(a, injected)  # a bin that holds what the injected ones hold goes
    clean = [list(x) for x, n in zip(a, twice, strict=True) if not n]
    displaced = np.array([i for x, n in zip(a, twice, strict=True) if n for i in x], np.int64)
    displaced = displaced[injected[displaced] == 0]
    return best_fit(lengths, displaced[np.argsort(-lengths[displaced], kind="stable")], capacity, clean + [list(x) for x in chosen])


def settlers(lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> list[list[list[int]]]:
    """An island's first population: best fits of the pieces in random orders."""
    return [best_fit(lengths, rng.permutation(len(lengths)), capacity) for _ in range(POPULATION)]


def evolve(island: list[list[list[int]]], lengths: np.ndarray, capacity: int, rng: np.random.Generator, generations: int = GENERATIONS) -> list[list[list[int]]]:
    """The island's population, best first, after some generations; it stops where no packing can have fewer bins."""
    least = -(-int(lengths.sum()) // capacity)
    rated = lambda x: (_fitness(x, lengths, capacity), x)
    best = lambda xs: sorted(xs, key=lambda x: x[0], reverse=True)[:POPULATION]
    alive = best(map(rated, island))
    for _ in range(generations):
        if len(alive[0][1]) == least or len(lengths) < 3:
            break
        i, j = rng.permutation(len(alive))[:2]
        alive = best([*alive, rated(_cross(alive[i][1], alive[j][1], lengths, capacity, rng))])
    return [x for _, x in alive]


def _coded(bins: list[list[int]], n: int) -> bytes:
    """A solution as each piece's bin, four bytes a piece, compressed."""
    bin_of = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        bin_of[b] = k
    return zlib.compress(bin_of.tobytes(), 1)


def _bins(coded: bytes) -> list[list[int]]:
    bin_of = np.frombuffer(zlib.decompress(coded), "<i4")
    order = np.argsort(bin_of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(bin_of[order])) + 1)]


def _search(rest: DataFrame, shards: int, level: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """(shards, their best solutions) of ``rest(k, length)`` dealt into ``shards``; one row a shard."""

    def gather(key, table):
        order = np.lexsort((table["k"].to_numpy(), table["length"].to_numpy()))
        k, n = (table[c].to_numpy()[order] for c in ("k", "length"))
        return pa.table({"shard": [key[0].as_py()], "k": [k.astype("<i8").tobytes()], "lengths": [n.astype("<i4").tobytes()], "least": [-(-int(n.sum()) // capacity)]})

    dealt = rest.select("k", "length", F.pmod(F.xxhash64("k", F.lit(level)), F.lit(shards)).alias("shard"))
    groups = settle(dealt.groupBy("shard").applyInArrow(gather, "shard bigint, k binary, lengths binary, least bigint"))
    shape = "shard bigint, island int, least bigint, bins bigint, solutions array<binary>"

    def epoch(number: int):
        def run(batches):
            for b in batches:
                out = []
                for shard, island, least, lengths, solutions in zip(*(b[c].to_pylist() for c in ("shard", "island", "least", "lengths", "solutions")), strict=True):
                    lengths = np.frombuffer(lengths, "<i4").astype(np.int64)
                    rng = np.random.default_rng([level, number, shard, island])
                    population = [_bins(x) for x in solutions] if solutions else settlers(lengths, capacity, rng)
                    best = evolve(population, lengths, capacity, rng)
                    out.append((shard, island, least, len(best[0]), [_coded(x, len(lengths)) for x in best]))
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["shard", "island", "least", "bins", "solutions"])

        return run

    lengths = groups.select("shard", "lengths")
    tasks = lambda rows: rows.repartition(max(1, min(shards * ISLANDS, 4096)), "shard", "island")
    first = groups.select("shard", "least", "lengths", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(None).cast("array<binary>").alias("solutions"))
    state = settle(tasks(first).mapInArrow(epoch(0), shape))
    for number in range(1, EPOCHS):
        open_ = state.groupBy("shard").agg(F.min("bins").alias("bins"), F.min("least").alias("least")).filter("bins > least").select("shard")
        if open_.limit(1).count() == 0:
            break
        elite = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("solutions", 1, 1).alias("guest"))
        met = state.join(elite, ["shard", "island"]).join(lengths, "shard").withColumn("solutions", F.concat("guest", "solutions")).drop("guest")
        before, state = state, settle(tasks(met).mapInArrow(epoch(number), shape))
        delete(before)
    best = settle(state.groupBy("shard").agg(F.min(F.struct("bins", "island", F.col("solutions")[0].alias("solution"))).alias("best")).select("shard", "best.solution"))
    delete(state)
    return groups, best


def pack(rows: DataFrame, capacity: int = 4096, shard: int = SHARD) -> DataFrame:
    """``rows`` (with ``doc_id``, ``piece`` and ``length``) plus ``sequence_id`` and ``offset``.

    Every row is packed, repeated ones and those with null ids too: rows go by a number of their own. Lengths must lie
    in 1..capacity (others, and null, raise). Offsets run gapless from 0 in each sequence. An empty input gives an
    empty result; other columns pass, but for those with the new names, which are replaced.

    Searching again stops where less than a tenth of the pieces found a well-filled bin: these rows' last shards
    keep the bins they have, each shard at most what its own best solution needs.
    """
    k = free_name(rows, "__k")
    rows = settle(rows.drop("sequence_id", "offset").withColumn(k, F.monotonically_increasing_id()))
    bad = rows.filter(F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity))
    if bad.limit(1).count():
        raise ValueError(f"a piece's length is outside 1..{capacity}")
    placed = []

    def show(last: bool, level: int):
        def run(batches):
            for b in batches:
                for no, ks, lengths, solution in zip(*(b[c].to_pylist() for c in ("shard", "k", "lengths", "solution")), strict=True):
                    ks, n = np.frombuffer(ks, "<i8"), np.frombuffer(lengths, "<i4").astype(np.int64)
                    bin_of, offset, final = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), bool)
                    for i, x in enumerate(_bins(solution)):
                        bin_of[x] = (level << 56) | (no << 24) | i
                        ends = np.cumsum(n[x])
                        offset[x] = ends - n[x]
                        final[x] = last or ends[-1] >= WELL * capacity
                    yield pa.RecordBatch.from_arrays([pa.array(ks), pa.array(n), pa.array(bin_of), pa.array(offset), pa.array(final)], names=["k", "length", "sequence_id", "offset", "final"])

        return run

    full = rows.filter(F.col("length") == capacity)
    done = [full.withColumn("sequence_id", (F.lit(1 << 62) + F.col(k)).cast("bigint")).withColumn("offset", F.lit(0).cast("bigint"))]
    rest = rows.filter(F.col("length") != capacity).select(F.col(k).alias("k"), F.col("length").cast("bigint").alias("length"))
    left, level = rest.count(), 0
    while left:
        shards = -(-left // shard)
        groups, best = _search(rest, shards, level, capacity)
        got = settle(groups.join(best, "shard").mapInArrow(show(shards == 1, level), "k bigint, length bigint, sequence_id bigint, offset bigint, final boolean"))
        delete(groups, best)
        before, left, level = left, got.filter("NOT final").count(), level + 1
        enough = 10 * left > 9 * before
        placed.append(got if enough else got.filter("final"))
        if enough:
            break
        rest = got.filter("NOT final").select("k", "length")
    if placed:
        spots = placed[0]
        for x in placed[1:]:
            spots = spots.unionByName(x)
        done.append(rows.join(spots.select(F.col("k").alias(k), "sequence_id", "offset"), k))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop(k)
