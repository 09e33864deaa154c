"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

The merge list fixes how far right a merge can depend on the text (``lookahead``). The transducer
keeps, for every byte of a sliding buffer, the last token of the tokenisation that ends there. Tokens
that lie further back than the lookahead are stable and leave. Memory is the buffer, however long the text.
"""

from __future__ import annotations

import codecs
import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadeline.llm._common import KEPT, gathered

#: Fixed by the format: how byte-level vocabularies spell bytes as printable characters.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_OF = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: Fixed by the format: the pattern that cuts text before the merges.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ODD_SPACE = regex.compile(r" (?=\s)|\s\Z")
#: Pieces that can go on without end, but white space, whose last character depends on what follows.
_RUNS = [regex.compile(r" ?\p{L}+"), regex.compile(r" ?\p{N}+"), regex.compile(r" ?[^\s\p{L}\p{N}]+")]
_OPEN = 4096
#: A piece can go on from one chunk to the next; what follows within so many characters settles it.
_SETTLED = 4


class Bpe:
    """A vocabulary with its merge list: ``encode``, ``encode_stream`` and ``decode_stream``."""

    def __init__(self, path: str, cached: int = 400_000, cached_chunks: int = 1_200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_bytes = lambda s: bytes(BYTE_OF[c] for c in s)
        self.ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(merges)}
        self.bytes = {i: s for s, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self._ends = {s[i:]: False for s in self.ids for i in range(len(s))} | dict.fromkeys(self.ids, True)  # whether an ending of a token is one
        self.lookahead = self._lookahead()
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._cached, self._cached_chunks, self._pieces, self._chunks, self._follows, self._made = cached, cached_chunks, {}, {}, {}, {}
        self._table: tuple | None = None

    def _lookahead(self) -> int:
        """Bytes from a merge's start that can matter for it.

        A merge of (x, y) waits for what a stronger merge (u, v) may take from y's end, u being one
        of y's right-hand parts; that merge in turn waits for its own right. Ranks fall along such a
        chain, so one sweep in rank order gives the longest.
        """
        right: dict[bytes, bytes] = {}
        beyond: dict[bytes, int] = {}
        most = 1
        for (x, y), _ in sorted(self.rank.items(), key=lambda m: m[1]):
            wait, part = 0, y
            while part is not None:
                wait, part = max(wait, beyond.get(part, 0)), right.get(part)
            right.setdefault(x + y, y)
            beyond[x] = max(beyond.get(x, 0), len(y) + wait)
            most = max(most, len(x) + len(y) + wait)
        return most

    def made(self, token: bytes) -> tuple[int, bytes, bytes] | None:
        """(rank, left, right) of the last merge that makes ``token`` of its bytes; rank -1 for a byte, None if they don't end up as one."""
        if token not in self._made:
            parts, how = [token[i : i + 1] for i in range(len(token))], (-1, b"", b"")
            while len(parts) > 1:
                r, i = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
                if r == 1 << 60:
                    how = None
                    break
                how = (r, parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._made[token] = how
        return self._made[token]

    def follows(self, a: bytes | None, b: bytes) -> bool:
        """Whether token ``b`` can stand right after ``a`` (None: at the start): no merge ever reaches across.

        Back in time, the part that was made last comes apart; two parts that touch would have merged if their
        rank comes before the merges that used them up. Of equal ranks the left one goes first.
        """
        if (ok := self._follows.get((a, b))) is None:
            if len(self._follows) > self._cached:
                self._follows.clear()
            ok = (right := self.made(b)) is not None
            if ok and a is not None:
                left, x, y, x_used, y_used = self.made(a), a, b, 1 << 60, 1 << 60
                while True:
                    r = self.rank.get((x, y), 1 << 60)
                    if r < x_used and r <= y_used and r < 1 << 60:
                        ok = False
                        break
                    if left[0] > right[0]:
                        x_used, x = left[0], left[2]
                        left = self.made(x)
                    elif right[0] >= 0:
                        y_used, y = right[0], right[1]
                        right = self.made(y)
                    else:
                        break
            self._follows[a, b] = ok
        return ok

    def tokens(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """The ids of one piece that arrives in chunks.

        A token is stable once ``lookahead`` bytes from its start on have been seen. Tokens leave when they are
        stable for all ends where a later token could still begin, that is for the last ``longest`` bytes, so the
        buffer never holds more than ``longest`` + ``lookahead`` bytes and one chunk.
        """
        hold = self.longest + self.lookahead
        data, first = b"", None  # not yet emitted bytes, and the token before them
        last: list[bytes] = []  # last[i]: the token that ends at i + 1
        for chunk in chunks:
            data += chunk
            self._advance(data, first, last)
            if len(data) > hold:
                end = len(data)
                while end > len(data) - hold:
                    end -= len(last[end - 1])
                if end > 0:
                    yield from self._back(last, end)
                    first = last[end - 1]
                    data, last = data[end:], last[end:]
        yield from self._back(last, len(data))

    def _advance(self, data: bytes, first: bytes | None, last: list[bytes]) -> None:
        """Carry ``last`` on to the end of ``data``: of the tokens that end at a byte, one may follow what is before it."""
        ends, get = self._ends, self._follows.get
        for end in range(len(last) + 1, len(data) + 1):
            found = []
            for start in range(end - 1, -1, -1):
                t = data[start:end]
                if (whole := ends.get(t)) is None:
                    break
                if whole:
                    found.append(t)
            for t in reversed(found):
                start = end - len(t)
                key = (last[start - 1] if start else first), t
                if (ok := get(key)) is None:
                    ok = self.follows(*key)
                if ok:
                    last.append(t)
                    break
            else:
                raise ValueError(f"the vocabulary has no token for the byte {data[end - 1]}")

    def _back(self, last: list[bytes], end: int) -> list[int]:
        out = []
        while end:
            out.append(self.ids[last[end - 1]])
            end -= len(last[end - 1])
        return out[::-1]

    def _piece(self, piece: str) -> tuple[int, ...]:
        if (got := self._pieces.get(piece)) is None:
            if len(self._pieces) > self._cached:
                self._pieces.clear()
            raw, step = piece.encode(), 1024
            if len(raw) <= step:
                self._advance(raw, None, last := [])
                got = tuple(self._back(last, len(raw)))
            else:
                got = tuple(self.tokens(raw[i : i + step] for i in range(0, len(raw), step)))
            if len(raw) <= 64:
                self._pieces[piece] = got
        return got

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        if len(self._chunks) > self._cached_chunks:
            self._chunks.clear()
        got = tuple(i for p in PIECES.findall(chunk) for i in self._piece(p))
        if len(chunk) <= 64:
            self._chunks[chunk] = got
        return got

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text. A lone space before a visible character always starts a piece,
        so texts are cut there and each cut-out stretch is looked up or transduced."""
        out: list[int] = []
        at = 0
        for m in [*self._special.finditer(text), None] if self._special else [None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                if _ODD_SPACE.search(part):
                    for p in PIECES.findall(part):
                        out += self._pieces.get(p) or self._piece(p)
                else:
                    head, *rest = part.split(" ")
                    known = self._chunks
                    if head:
                        out += self._chunk(head)
                    for w in rest:
                        w = " " + w
                        out += known.get(w) or self._chunk(w)
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """The ids of all texts as one Arrow array; nulls have none.

        Arrow cuts plain texts at single spaces and tells the distinct stretches; each of those is
        looked up or transduced once, and the ids are put together by position. Texts with other
        spacing or special strings are encoded one by one.
        """
        values = texts.to_pylist()
        plain = [i for i, t in enumerate(values) if t and not _ODD_SPACE.search(t) and not (self._special and self._special.search(t))]
        parts: list[np.ndarray] = [np.zeros(0, np.int32)] * len(values)
        rest = set(range(len(values))).difference(plain)
        for i in rest:
            if values[i]:
                parts[i] = np.array(self.encode(values[i]), np.int32)
        if plain:
            lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
            starts = lists.offsets.to_numpy()
            coded = lists.flatten().dictionary_encode()
            known, chunk = self._chunks, self._chunk
            ids = [known.get(w) or chunk(w) for w in map(" ".__add__, coded.dictionary.to_pylist())]
            word = coded.indices.to_numpy().astype(np.int64)
            first = starts[:-1] - starts[0]
            heads = lists.flatten().take(pa.array(first)).to_pylist()
            word[first] = len(ids) + np.arange(len(heads))  # a text's first stretch has no space before it
            ids += [self._chunk(h) if h else () for h in heads]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(size.sum()))
            begin = np.cumsum(size) - size
            n = size[word]
            ends = np.r_[0, np.cumsum(n)]
            got = flat[np.repeat(begin[word] - ends[:-1], n) + np.arange(ends[-1])]
            cuts = ends[starts - starts[0]]
            if not rest:
                return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(got))
            for k, i in enumerate(plain):
                parts[i] = got[cuts[k] : cuts[k + 1]]
        offsets = np.cumsum([0, *map(len, parts)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """Each list's text, by the same automaton as ``decode_stream``; bytes are gathered for all tokens at once."""
        if self._table is None:
            most = max(self.bytes) + 1
            raw = [self.bytes.get(i, b"") for i in range(most)]
            size = np.fromiter(map(len, raw), np.int64, most)
            self._table = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size
        blob, begin, size = self._table
        out, step = [], 1 << 20
        for one in lists:
            ids, state, text = one.values.to_numpy() if one.is_valid else (), codecs.getincrementaldecoder("utf-8")("replace"), []
            for at in range(0, len(ids), step):
                part = ids[at : at + step]
                n = size[part]
                ends = np.cumsum(n)
                text.append(state.decode(blob[np.repeat(begin[part] - ends + n, n) + np.arange(ends[-1])].tobytes()))
            out.append("".join([*text, state.decode(b"", True)]))
        return pa.array(out, pa.string())

    def encode_stream(self, chunks: Iterable[str]) -> Iterator[int]:
        """The ids of a text that arrives in chunks. What is held back is one open piece's and one
        special string's worth of characters; a piece beyond that is fed to the transducer as it comes."""
        starts = {s[:i] for s in self.special for i in range(1, len(s))}
        source, held, last = iter(chunks), "", False
        ready: list[str] = []  # cut pieces, but for the open one

        def begun(text: str) -> int:
            """Characters at the end that may be the start of a special string."""
            return next((len(text) - i for i in range(max(0, len(text) - 64), len(text)) if text[i:] in starts), 0)

        def more() -> bool:
            """Take in another chunk and cut what is settled; the rest stays in ``held``."""
            nonlocal held, last
            if last:
                return False
            try:
                held += next(source)
            except StopIteration:
                last = True
            while self._special and (m := self._special.search(held)):
                ready.extend(PIECES.findall(held[: m.start()]))
                ready.append(m[0])
                held = held[m.end() :]
            tail = 0 if last else begun(held)
            at = 0
            for m in PIECES.finditer(held, 0, len(held) - tail):
                if not last and m.end() > len(held) - tail - _SETTLED:
                    break
                ready.append(m[0])
                at = m.end()
            held = held[at:]
            return True

        def run(kind: regex.Pattern) -> Iterator[bytes]:
            """The open piece, as long as it goes on; it leaves what comes after it in ``held``."""
            nonlocal held, last
            while True:
                m = self._special.search(held) if self._special else None
                limit = m.start() if m else len(held) - (0 if last else begun(held))
                end = min(r.end() if (r := kind.match(held)) else 0, limit)
                if m or last or end < limit:
                    yield held[:end].encode()
                    held = held[end:]
                    return
                cut = max(0, end - _SETTLED)
                yield held[:cut].encode()
                held = held[cut:]
                try:
                    held += next(source)
                except StopIteration:
                    last = True

        while more():
            for p in ready:
                if p in self.special:
                    yield self.special[p]
                else:
                    yield from self._piece(p)
            ready.clear()
            if len(held) > _OPEN and not last:
                kind = next((k for k in _RUNS if k.match(held) and k.match(held).end() == len(held)), None)
                if kind is not None:
                    yield from self.tokens(run(kind))
        yield from self.encode(held)  # what a run left behind at the very end

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes certain: a UTF-8 automaton that holds at most three bytes. Bytes that
        can't be UTF-8 become U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        of = self.bytes
        block: list[bytes] = []
        for i in ids:
            block.append(of[i])
            if len(block) == 65536:
                yield state.decode(b"".join(block))
                block.clear()
        yield state.decode(b"".join(block), True)


_LOADED: dict[str, Bpe] = {}
KEPT.append(_LOADED)


def loaded(path: str) -> Bpe:
    """One instance for each worker process, so that its caches serve all batches."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the column ``ids`` (array<int>), and ``decoded`` (the ids decoded again) if named.

    A null text counts as empty: no ids, and an empty decoded text. Other columns stay as they are; a column that
    already has one of the new names is replaced.
    """
    from pyspark.sql import types as T

    new = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    keep = [f for f in docs.schema.fields if f.name.lower() not in {n.name.lower() for n in new}]
    names = [f.name for f in keep]

    def run(batches):
        bpe = loaded(path)
        for whole in gathered(batches):
            at, size = 0, max(1, min(len(whole), int(len(whole) * (16 << 20) / max(1, whole.nbytes))))
            while at < len(whole):
                b = whole.slice(at, size)
                at += size
                got = bpe.encode_all(b[-1])
                cols = [*(b[i] for i in range(len(names))), got]
                if decoded:
                    cols.append(bpe.decode_all(got))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *(n.name for n in new)])

    return docs.select(*names, F.col(text).alias("\x00text")).mapInArrow(run, T.StructType(keep + new))


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with ``text`` decoded from ``ids``; null ids give an empty text."""
    from pyspark.sql import types as T

    keep = [f for f in rows.schema.fields if f.name.lower() != text.lower()]
    names = [f.name for f in keep]

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            out = bpe.decode_all(b[-1])
            yield pa.RecordBatch.from_arrays([*(b[i] for i in range(len(names))), out], names=[*names, text])

    return rows.select(*names, F.col(ids).alias("\x00ids")).mapInArrow(run, T.StructType([*keep, T.StructField(text, T.StringType())]))
