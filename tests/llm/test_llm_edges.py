"""Lengths, ties, clashing names and repeated rows; brute force for alignment, URL models, tiles and the transducer."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from fadeline.llm import bpe, chat_format, embedding_dedup, html_extract, url_filter  # noqa: E402
from fadeline.llm._common import pack_columns, unpack_columns  # noqa: E402


def test_chat_roles_and_texts_of_any_length(spark):
    rows = [(1, 0, "r" * 1200, "hello"), (1, 1, "a:" * 3000 + "\\", "x: y\\" * 4000), (1, 1, "a:" * 3000 + "\\", "x: y\\" * 4000), (2, 0, "\\\\:", ": "), (None, 0, "user", "a"), (None, None, "user", "b")]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("tree", F.lit(3)).withColumn("node", F.lit("n")))
    got = {r.conv_id: [tuple(x) for x in r.t] for r in out.select("conv_id", chat_format.parse(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [r[2:] for r in rows[:3]], 2: [rows[3][2:]], None: [("user", "b"), ("user", "a")]}


def test_url_rules_of_one_length_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "http://x.ab/cd/", 5, "old"), (1, "http://x.ab/cd/", 5, "old"), (2, None, 6, "old")], "page_id bigint, url string, __r int, verdict string")
    for rules in ([("ab/cd/", "allow"), ("ab/cd/", "block")], [("ab/cd/", "block"), ("ab/cd/", "allow")]):
        got = url_filter.judge(rows, rules).collect()
        assert Counter((r.page_id, r["__r"], r.rule) for r in got) == {(1, 5, "ab/cd/"): 2, (2, 6, None): 1}
        assert {r.verdict for r in got if r.page_id == 1} == {rules[0][1]}
    with pytest.raises(ValueError):
        url_filter.judge(rows.withColumnRenamed("url", "host"), [], url="host")


def test_url_model_by_brute_force():
    rng = random.Random(4)
    urls, order = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))) for _ in range(60)], 3
    counts = defaultdict(Counter)
    for u in urls:
        s = "\x02" * order + u + "\x03"
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[s[i - k : i]][s[i]] += 1

    def p(context, c):
        lower = p(context[1:], c) if context else 1 / 65536
        seen = counts.get(context)
        return (seen[c] + len(seen) * lower) / (sum(seen.values()) + len(seen)) if seen else lower

    model = url_filter.CharModel(urls, order)
    for u in [*urls, "", "zzz", "ab" * 400]:
        s = "\x02" * order + u + "\x03"
        want = sum(math.log2(p(s[i - order : i], s[i])) for i in range(order, len(s))) / (len(s) - order)
        assert abs(model.score(u) - want) < 1e-9


@pytest.mark.parametrize("cells", [1 << 22, 20])
def test_alignment_by_brute_force(monkeypatch, cells):
    monkeypatch.setattr(html_extract, "_CELLS", cells)
    rng = random.Random(cells)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(25))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        kept = [x for x, k in zip(a, html_extract.shared_lines(a, b), strict=True) if k]
        rest = iter(b)
        assert len(kept) == best[-1][-1] and all(x in rest for x in kept)


def test_transducer_holds_no_more_than_its_lookahead():
    path = public_tokenizers.path("byte_bpe_50k.json")
    b, want, rng = bpe.loaded(path), Tokenizer.from_file(path), random.Random(5)
    for letters in ("a", "ab", "eatonshrl", "éà日本", "=-"):
        t = "".join(rng.choice(letters) for _ in range(6000))
        ids = want.encode(t, add_special_tokens=False).ids
        raw, taken, emitted = t.encode(), 0, 0

        def chunks(raw=raw):
            nonlocal taken
            for i in range(0, len(raw), 100):
                taken = i + 100
                yield raw[i : i + 100]

        got = []
        for i in b.tokens(chunks()):
            assert taken >= len(raw) or taken - emitted <= 2 * b.longest + b.lookahead + 200
            got.append(i)
            emitted += len(b.bytes[i])
        assert got == ids == b.encode(t)


def test_small_tiles_find_what_large_ones_find(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 6))[rng.integers(0, 40, 260)] + rng.normal(0, 0.12, (260, 6))
    rows = [(i, [float(v) for v in r], "ab"[i % 2]) for i, r in enumerate(x)] + [(7, [float(v) for v in x[7]], "b")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string").withColumn("node", F.lit(1)).withColumn("tile", F.lit(2))
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    monkeypatch.setattr(embedding_dedup, "MEET", 2)
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(table).collect())
    y = np.array([r[1] for r in rows])
    c = (y @ y.T) / np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(y, axis=1))
    names = np.array([r[2] for r in rows])
    link = (c >= 0.93) & (names[:, None] == names[None, :])
    np.fill_diagonal(link, False)
    comp, ids = np.array([r[0] for r in rows]), np.array([r[0] for r in rows])
    while (new := np.minimum(comp, np.where(link, comp[None, :], 1 << 60).min(1))).tolist() != comp.tolist():
        comp = new
    assert got == sorted((int(i), int(n), int(k), bool(i == k)) for i, n, k in zip(ids, link.sum(1), comp, strict=True))


def test_packed_columns():
    a = [np.array([1, 5, 5, 1 << 47]), np.array([3, -1, 0, 1 << 60]), np.zeros(4, np.int64)]
    assert [x.tolist() for x in unpack_columns(pack_columns(a), 3)] == [x.tolist() for x in a]
