"""Small exact checks of the training-data operators: brute force, round trips, and awkward inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zlib

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from fadeline.llm import bpe, chat_format, components, embedding_dedup, html_extract, jaccard_join, license_scan, packing, quality_classifier, quality_rules, url_filter  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
AWKWARD = [None, "", " \n\t ", "one", "one two three", "Ünïcode ẞ İstanbul ΑΣ", "x" * 5000, "a b c d e " * 3000, "tab\tand\nlines\n\nlines", "<|endoftext|> ### </turn> \\"]


def docs(spark, texts, extra=""):
    rows = [(i, t, ["en", "fr", None, "xx"][i % 4], f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(texts, k, num, den):
    sets = [shingles(t, k) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    having = defaultdict(list)
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in having[x])
        for j, n in both.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
        for x in s:
            having[x].append(i)
    return [(i, len(s), top(i)) for i, s in enumerate(sets)]


def near_copies(rng, n):
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t).upper() if rng.random() < 0.3 else " ".join(t))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("k,num,den,seed", [(4, 85, 100, 1), (5, 8, 10, 2), (2, 1, 2, 3)])
def test_jaccard_components(spark, k, num, den, seed):
    texts = near_copies(random.Random(seed), 40) + AWKWARD
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs(spark, texts), k=k, num=num, den=den).collect())
    assert got == brute_components(texts, k, num, den)


def test_jaccard_dense_groups_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 8)
    monkeypatch.setattr(jaccard_join, "QUERIES", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(60)] = f"v{rng.randrange(1000)}"
        texts.append(" ".join(t))
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs(spark, texts), k=4, num=85, den=100).collect())
    assert got == brute_components(texts, 4, 85, 100)


def test_jaccard_groups_of_far_centres(spark, monkeypatch):
    """Mixtures of like size share many tokens with a dense group and link with none of it, but may be its centres."""
    monkeypatch.setattr(jaccard_join, "LOOSE", 2)
    monkeypatch.setattr(jaccard_join, "GROUP", 8)
    rng, texts = random.Random(13), []
    base = [f"w{i}" for i in range(60)]
    for i in range(90):
        t = list(base)
        if i % 3 == 0:
            at = rng.randrange(30)
            t[at : at + 25] = [f"m{i}x{j}" for j in range(25)]
        else:
            t[rng.randrange(60)] = f"v{rng.randrange(1000)}"
        texts.append(" ".join(t))
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs(spark, texts), k=4, num=85, den=100).collect())
    assert got == brute_components(texts, 4, 85, 100)


def test_jaccard_chains_of_revisions(spark):
    rng, texts = random.Random(11), []
    for c in range(60):
        t = [f"c{c}w{i}" for i in range(rng.randint(40, 90))]
        for _ in range(rng.randint(4, 16)):
            texts.append(" ".join(t))
            for _ in range(rng.randint(1, 2)):
                t[rng.randrange(len(t))] = f"c{c}v{rng.randrange(10**6)}"
    rng.shuffle(texts)
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs(spark, texts), k=4, num=85, den=100).collect())
    assert got == brute_components(texts, 4, 85, 100)


def test_jaccard_empty_repeats_and_nulls(spark):
    empty = docs(spark, ["x"]).limit(0)
    assert jaccard_join.jaccard_components(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f", 9), (1, "a b c d e f", 9), (None, "a b c d e f", 9), (None, None, 1), (2, "q r s t u v", 0)], "doc_id bigint, text string, node int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(rows).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (2, 2, 2)], key=str)
    kept = sorted(((r.doc_id, r.node) for r in jaccard_join.keep_one(rows).collect()), key=str)
    assert kept == sorted([(1, 9), (2, 0), (None, 9), (None, 1)], key=str)


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (5, 5), (7, 8)], "a bigint, b bigint")
    got = {r.node: r.comp for r in components.components(e).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200}
    assert components.components(e.limit(0)).count() == 0


def test_bpe_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path)
    rng = random.Random(7)
    texts = AWKWARD + ["".join(rng.choice("abcdethé日 \n\t.'s!?#12") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    rows = bpe.encode(docs(spark, texts).withColumnRenamed("source", "ids"), path, decoded="decoded").orderBy("doc_id").collect()
    again = {r.doc_id: r.back for r in bpe.decode(bpe.encode(docs(spark, texts), path).select("doc_id", "ids"), path, text="back").collect()}
    for r, t in zip(rows, texts, strict=True):
        ids = want.encode(t or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == want.decode(ids, skip_special_tokens=False) == again[r.doc_id]
    b = bpe.loaded(path)
    for t in (t for t in texts if t):
        ids = want.encode(t, add_special_tokens=False).ids
        assert list(b.encode_stream(t[i : i + 5] for i in range(0, len(t), 5))) == ids
    assert bpe.encode(docs(spark, ["x"]).limit(0), path).count() == 0
    assert 0 < b.lookahead < 4096


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(8)
    texts = AWKWARD + [" ".join(rng.choice(["the", "Cat's", "naïve", "1234", "&&", "of"]) for _ in range(rng.randint(1, 400))) for _ in range(120)]
    rows = packing.pack(packing.pieces(docs(spark, texts), path, with_ids=True), shard=40).collect()
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    total = defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.start == 4096 * r.piece and r.ids == part and r.ids_crc32 == zlib.crc32(part)
        total[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids))
    for parts in total.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(map(len, ids)) // 4096)
    assert len(total) <= 1.1 * least + 4
    assert packing.pack(packing.pieces(docs(spark, ["x"]).limit(0), path)).count() == 0


def evolved(lengths, islands=packing.ISLANDS, epochs=packing.EPOCHS):
    """The islands of one shard in one process, with migration, as the tasks do it."""
    rngs = [np.random.default_rng(i) for i in range(islands)]
    state = [packing.evolve(packing.settlers(lengths, 4096, r), lengths, 4096, r) for r in rngs]
    for _ in range(1, epochs):
        state = [packing.evolve([state[i - 1][0], *state[i]], lengths, 4096, rngs[i]) for i in range(islands)]
    return min((x[0] for x in state), key=len)


def test_packing_search_betters_its_start():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 4096, 800), rng.integers(1, 3000, 800), rng.integers(1000, 2500, 800)):
        start = min(len(packing.best_fit(lengths, rng.permutation(800), 4096)) for _ in range(9))
        best = evolved(lengths)
        assert len(best) < start and sorted(i for b in best for i in b) == list(range(800))
        assert all(lengths[b].sum() <= 4096 for b in best)
        decreasing = len(packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), 4096))
        assert len(best) <= 1.01 * decreasing + 1
        assert [sorted(x) for x in packing._bins(packing._coded(best, 800))] == [sorted(x) for x in best]


def test_packing_repeats_nulls_and_clashes(spark):
    rows = [(None, 0, 3000, 7)] * 9 + [(5, 0, 1000, 7)] * 9 + [(5, 1, 4096, 7)] * 2 + [(6, None, 96, 7)] * 9
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint, __k int"), shard=8).collect()
    assert Counter((r.doc_id, r.piece, r.length, r["__k"]) for r in got) == Counter(rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all([o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 4096 for x in bins.values())
    for bad in (0, 4097, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, 0, bad)], "doc_id bigint, piece int, length bigint"))


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def test_url_rules(spark):
    cases = {
        "http://A.Example.COM/en/1?x#y": ("a.example.com", "/en/1", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://m.www.example.com/en/2": ("m.www.example.com", "/en/2", "www.example.com/en/", "allow"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.com": ("x.com", "", None, None), "http://x.net/es/a": ("x.net", "/es/a", "net/es/", "block"), "http://x.net/es": ("x.net", "/es", None, None), "nothing": ("", "", None, None), None: ("", "", None, None),
        "http://x.com?u=http://y.net/es/": ("x.com", "", None, None), "": ("", "", None, None),
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string")
    for r in url_filter.judge(rows, RULES).collect():
        host, path, rule, verdict = cases[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.judge(rows.limit(0), RULES).count() == 0


def test_packing_ids_are_the_librarys():
    import pyarrow as pa

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    library, tokens = Tokenizer.from_file(path), packing.Tokens(path, cached=500)
    some = "ab's'reé ß\xad\u0130\u0391\u03a3\u03c2\u4e2d\u3042\u00b2\u00bd\u0301 \t\n\x0b\x1c\x85\xa0\u200b\u2019\u2026#$'\"0\ufb01\u01c5\U0001f44d\x00\x7f\u023a\u1e9e"
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x300), rng.randrange(0x20, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(1000)]
    texts += [r[0] for r in public_texts()] + AWKWARD + ["it's<|endoftext|>IT'S", "x <|STARTOFTEXT|>"]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        want = [e.ids for e in library.encode_batch_fast([x or "" for x in part], add_special_tokens=False)]
        assert [x.tolist() for x in tokens.ids(pa.array(part, pa.string()))] == want


def public_texts():
    import pyarrow.parquet as pq

    return [(x,) for x in pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()]


def test_url_models_tell_apart():
    good, bad = [f"http://a.org/news/{i}" for i in range(200)], [f"http://b.biz/casino-win-{i}" for i in range(200)]
    g, b = url_filter.CharModel(good[:150]), url_filter.CharModel(bad[:150])
    assert sum(b.score(u) > g.score(u) for u in bad[150:]) == 50 and sum(b.score(u) < g.score(u) for u in good[150:]) == 50


def test_chat_format(spark):
    hard = ["\\### Assistant: </turn> ok", "", None, "a\\", "</turn>\n### User: x", "<<//turn>", "#" * 9, "\\\\<\\/"]
    rows, want = [], {}
    for c in range(4):
        for t in range(len(hard)):
            rows.append((c, t * 2, ["user", "assistant", "sys:tem", None][(t + c) % 4], hard[(t + c) % len(hard)]))
        want[c] = [(r or "", x or "") for _, _, r, x in rows[-len(hard) :]]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5))
    from pyspark.sql import functions as F

    for r in out.select("conv_id", chat_format.parse(F.col("formatted")).alias("t"), chat_format.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        assert [tuple(x) for x in r.t] == want[r.conv_id]
        assert r.loss == "".join(x for role, x in want[r.conv_id] if role == "assistant")
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_best_paths(spark):
    m = [("t", 1, None, 1.0), ("t", 2, 1, 0.0), ("t", 3, 1, 1.0), ("t", 4, 3, 1.0), ("t", 5, 3, 0.5), ("u", 1, 9, 0.0), ("v", 1, 2, 0.0), ("v", 2, 1, 0.0), ("t", 4, 3, 1.0)]
    rows = spark.createDataFrame(m, "tree string, node bigint, parent bigint, score double")
    got = sorted((r.tree, r.branch, r.depth, r.node) for r in chat_format.best_paths(rows, 2).collect())
    assert got == [("t", 1, 1, 1), ("t", 1, 2, 3), ("t", 1, 3, 4), ("t", 2, 1, 1), ("t", 2, 2, 3), ("t", 2, 3, 5), ("u", 1, 1, 1)]


def test_html(spark):
    pages = [
        (1, "http://h/a/1", "<nav>Menu</nav><article><h1>T&amp;T</h1><p>One <b>t</b>wo<br>three</p><div class=comments><p>no</p></div></article><footer>f</footer>"),
        (2, "http://h/a/2", "<div>Shared line</div><p>Only here</p><div>Foot</div>"), (3, "http://h/a/3", "<div>Shared line</div><p>Something else</p><div>Foot</div>"),
        (4, None, None), (5, "http://h/x", ""), (6, "http://h/y", "<article>a<script>var t='</p>'</script><style>p{}</style> &lt;b&gt; <p>un<b>closed"), (6, "http://h/y", "<article>a<script>x</script>"),
    ]
    got = sorted((r.page_id, r.text) for r in html_extract.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect())
    assert got == [(1, "T&T One two three"), (2, "Only here"), (3, "Something else"), (4, ""), (5, ""), (6, "a"), (6, "a <b> unclosed")]
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert html_extract.shared_lines([1, 2, 3, 4], [9, 2, 4, 3]).sum() == 2


def test_html_copies_keep_their_articles(spark, monkeypatch):
    page = lambda *article: "".join(f"<div>{x}</div>" for x in ("Home", "News", *article, "Foot"))
    long = [f"A sentence of a long article, number {i}, with words of its own." for i in range(8)]
    pages, want = [], []

    def add(url, html, text):
        pages.append((len(pages), url, html))
        want.append(text)

    for i in range(30):
        add(f"http://h/a/{i:03}", page(f"Only on page {i}"), f"Only on page {i}")
    for i in range(3):
        add("http://h/b/1", page(*long), " ".join(long))
        add(f"http://h/b/2{i}", page(*long[:-1], f"revised {i}"), " ".join([*long[:-1], f"revised {i}"]))
    for i in range(40):
        add(None, page("same") if i % 2 else page(*long), "same" if i % 2 else " ".join(long))
    add("http://alone/1", page(*long), " ".join(["Home", "News", *long, "Foot"]))
    add("http://alone/1", page(*long), " ".join(["Home", "News", *long, "Foot"]))
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    for part in (1024, 16):
        monkeypatch.setattr(html_extract, "PART", part)
        got = {r.page_id: r.text for r in html_extract.extract(rows).collect()}
        assert got == dict(enumerate(want)), part


def test_html_marked_pages_are_aligned_too(spark):
    page = lambda *body: f"<nav>Menu</nav><article>{''.join(f'<p>{x}</p>' for x in body)}</article><footer>Foot</footer>"
    pages = [(1, "http://h/1", page("one", "its own words")), (2, "http://h/2", page("two, quite another", "a passage", "and more of it")), (3, "http://h/3", page("three of them", "a passage", "with its own end")),
             (4, "http://h/4", "<div>Menu</div><p>no mark at all</p><div>Foot</div>"), (5, "http://lone/1", page("alone"))]
    got = {r.page_id: (r.text, r.n_lines, r.n_shared, r.by_neighbours) for r in html_extract.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {1: ("one its own words", 4, 2, True), 2: ("two, quite another a passage and more of it", 5, 3, False), 3: ("three of them a passage with its own end", 5, 3, False), 4: ("no mark at all", 3, 2, True), 5: ("alone", 3, 0, False)}


def test_html_marks_are_whole_names():
    kept = ['<h2 id="related-work">', '<section id="social-history">', '<section id="search-algorithms">', '<p class="notice-period">', '<h3 id="comments-on-method">', '<p id="notice">', '<div class="print-ad-history">', '<div data-id="search">', "<math>", "<object>"]
    for tag in kept:
        assert html_extract.blocks(f"<article><p>a</p>{tag}text</article>")[-1] == (1, "text"), tag
    gone = ['<div class="ad">', '<div class="box site-header">', '<div id="cookie-consent">', '<div class="ad_slot_2">', '<div role="search">', "<ul class=social-share-bar>", "<p class=notice>", '<section class="comments">']
    for tag in gone:
        assert html_extract.blocks(f"<article><p>a</p>{tag}text</article>")[-1] == (2, "text"), tag
    assert html_extract.blocks("<p>E = <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math></p>") == [(0, "E = mc2")]


def test_quality_counts(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + AWKWARD + ["a b c d e f g h i a b c d e f g h i", "x\nx\n\n \nx"]
    for r in quality_rules.judge(docs(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        seen, cover = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                cover.update(range(i, i + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert base == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.judge(docs(spark, ["x"]).limit(0)).count() == 0


def labelled(spark, verdicts):
    return verdicts.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()


def test_quality_rules_keep_clean_documents(spark):
    got = labelled(spark, quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    clean = [r for r in got if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert sum(not r.kept for r in got if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in got)


def test_quality_classifier(spark):
    got = labelled(spark, quality_classifier.classify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    assert sum(r.kept for r in got if r.quality == 1) >= 0.99 * sum(r.quality for r in got)
    assert sum(not r.kept for r in got if r.quality == 0) >= 0.95 * sum(r.quality == 0 for r in got)
    odd = quality_classifier.classify(docs(spark, AWKWARD)).orderBy("doc_id").collect()
    assert len(odd) == len(AWKWARD) and not any(r.kept for r in odd[:3])
    assert quality_classifier.classify(docs(spark, ["x"]).limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 16))
    x = np.vstack([x, x[:60] + rng.normal(0, 0.05, (60, 16)), x[:30], 2 * x[:10]]).astype(np.float32)
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16]
    rows += [(1000 + i, v, 0) for i, v in enumerate(bad)] + [(2000, rows[0][1], None), (2001, rows[0][1][:8], 0)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    y = x.astype(float)
    c = (y @ y.T) / np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(y, axis=1))
    link = (c >= 0.93) & ((np.arange(len(x)) % 2)[:, None] == (np.arange(len(x)) % 2)[None, :])
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], 1 << 60).min(1))
        if (new == comp).all():
            break
        comp = new
    assert link.sum() > 50
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), comp[i], comp[i] == i)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in got if i >= 1000)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_licenses(spark):
    files = [
        ("a", "p/LICENSE", "MIT License\n\nReleased under the MIT License."), ("b", "p/src/x.c", "int main() { return 0; }"), ("c", "p/src/y.c", "// Licensed under the Apache License, Version 2.0.\n" + "int f(int a) { return a; } " * 9), ("d", "q/z.c", "nothing"),
        ("e", "p/src/deep/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("f", "p/src/deep/er/w.c", None), ("g", None, "Licensed under CC BY-NC 4.0."), ("h", None, None), ("i", "p/src/v2.c", "Version 2.0. of the public work"),
    ]
    got = {r.key: (r.license, r.inherited_from) for r in license_scan.scan(spark.createDataFrame(files, "key string, path string, text string"), "key", "path", "text").collect()}
    assert got == {"a": ("MIT", None), "b": ("MIT", "p"), "c": ("Apache-2.0", None), "d": (None, None), "e": ("GPL-3.0", None), "f": ("GPL-3.0", "p/src/deep"), "g": ("CC-BY-NC-4.0", None), "h": (None, None), "i": ("MIT", "p")}
    assert license_scan.scan(spark.createDataFrame([], "key string, path string, text string"), "key", "path", "text").count() == 0


def test_licenses_of_real_notices(spark):
    notices = [
        ("MIT", "This project is licensed under the MIT License - see the LICENSE.md file for details"), ("MIT", "// SPDX-License-Identifier: MIT"), ("MIT", "The MIT License (MIT)"), (None, "MIT!!"), ("GPL-3.0", "# SPDX-License-Identifier: GPL-3.0-or-later"), ("Apache-2.0", "/* SPDX-License-Identifier: Apache-2.0 */"),
        ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'),
        *((f"{short}-3.0", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.") for short, name in (("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero "))),
        ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."), (None, "Mit der Lizenz hat das nichts zu tun"), (None, "the project is published by a foundation"),
    ]
    texts = [x for _, x in notices] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(90).collect()]
    rows = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "key bigint, path string, text string")
    got = {r.key: r.license for r in license_scan.scan(rows, "key", "path", "text").collect()}
    assert [got[i] for i in range(len(notices))] == [name for name, _ in notices]


def test_licenses_of_repeated_rows(spark):
    long = "Licensed under the Apache License, Version 2.0.\n" + "int f(int a) { return a; } " * 9
    files = [("a", "p/x.c", long)] * 20 + [("b", "p/y.c", "nothing"), ("c", "p/z.c", "nothing")]
    got = {(r.key, r.license, r.n_segments) for r in license_scan.scan(spark.createDataFrame(files, "key string, path string, text string"), "key", "path", "text").collect()}
    assert got == {("a", "Apache-2.0", 1), ("b", None, 0), ("c", None, 0)}


def test_pipeline(spark):
    import corpus_pipeline
    from fadeline.llm.quality_classifier import classify
    from fadeline.llm.quality_rules import judge

    raw = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in classify(raw).filter("kept").collect()}
    left = raw.filter(raw.doc_id.isin(list(good)))
    left = left.filter(left.doc_id.isin([r.doc_id for r in judge(left).filter("kept").collect()])).orderBy("doc_id").collect()
    comp = brute_components([r.text for r in left], 5, 8, 10)
    want = {left[i].doc_id for i, n, c in comp if c == i or not n}
    got = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 4 <= len(corpus_pipeline.STAGES) <= 5
    empty = raw.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_judges_row_by_row(spark):
    import corpus_pipeline

    raw = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.rules(spark, corpus_pipeline.classify(spark, raw, SF), SF).orderBy("doc_id").limit(3).collect()
    plain = [r.asDict() for r in good]
    bad = plain[0] | {"text": "x # | # x"}
    odd = spark.createDataFrame([plain[0], bad, plain[1] | {"doc_id": None}, bad | {"doc_id": None}], raw.schema)
    rest = raw.filter(~raw.doc_id.isin([r.doc_id for r in good]))
    for stage in (corpus_pipeline.classify, corpus_pipeline.rules):
        got = {(r.doc_id, r.text) for r in stage(spark, rest.unionByName(odd), SF).collect()}
        assert (good[0].doc_id, good[0].text) in got and (None, good[1].text) in got
        assert (good[0].doc_id, bad["text"]) not in got and (None, bad["text"]) not in got


def test_executors_give_their_heaps_back(spark):
    import gc

    from fadeline.llm._common import shrink_heaps

    blocks = [spark.sparkContext._gateway.new_array(spark._jvm.byte, 100 << 20) for _ in range(12)]
    assert len(blocks) == 12 and (grown := spark._jvm.java.lang.Runtime.getRuntime().totalMemory()) >= 1200 << 20
    del blocks
    gc.collect()
    shrink_heaps(spark)
    assert spark._jvm.java.lang.Runtime.getRuntime().totalMemory() < grown - (600 << 20)


def test_each_stage_begins_with_what_earlier_ones_left_given_back(spark, monkeypatch):
    import corpus_pipeline

    begun, size = [], "spark.sql.parquet.columnarReaderBatchSize"
    monkeypatch.setattr(corpus_pipeline, "shrink_heaps", begun.append)
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        spark.conf.unset(size)
        stage(spark, empty, SF)
        assert begun == [spark] * (k + 1) and spark.conf.get(size) == "512"


def test_keep_one_tells_rows_by_id_and_text(spark):
    a, b, near = "a b c d e f g h i j k l m n o p", "q r s t u v w x y z", "a b c d e f g h i j k l m n o z"
    rows = [(1, a), (1, b), (1, a), (2, near), (2, "other words than those above here"), (3, a), (4, b), (None, a), (5, ""), (5, " "), (5, "")]
    got = sorted(jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), k=2).collect(), key=str)
    want = [(1, a), (1, b), (2, "other words than those above here"), (None, a), (5, ""), (5, " ")]
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted((tuple(r) for r in want), key=lambda r: next(str(x) for x in got if tuple(x) == r))]


def test_digest_columns(spark):
    from fadeline.llm import queries

    row = queries.op2_bpe_roundtrip(spark, SF).orderBy("doc_id").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").filter(f"doc_id = {row.doc_id}").first().text
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert set(queries.queries()) == {f"op{i}_{n}" for i, n in ((1, "ngram_jaccard_join"), (2, "bpe_roundtrip"), (3, "best_fit_packing"), (4, "url_filter"), (5, "chat_format"), (6, "html_extraction"), (7, "quality_rules"), (8, "embedding_dedup"), (9, "license_scan"), (10, "quality_classifier"))} | {"pipeline"}
