"""Main text of HTML pages: blocks of text, minus what neighbouring pages share, minus marked furniture.

Pages of a host are ordered by URL path and paired with their nearest neighbours in that order that
aren't copies or near copies of them. The lines of a pair are aligned by longest common subsequence and the shared ones outside the article are deleted:
menus, notices and footers repeat from page to page, articles don't. A page of which nothing would be left keeps
its plain lines. Lines of an element that says
what it is (``<nav>``, ``class="ad"``, ...) go in any case, and if the page has an ``<article>`` or
``<main>`` only its lines stay. Lines inside it are never deleted for being shared: passages may
rightly repeat across articles.
"""

from __future__ import annotations

import bisect
import html as _html
import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadeline.llm.url_filter import host_path

#: Fixed values of HTML: elements without an end tag, elements whose content isn't text, and inline elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg select button".split())
_INLINE = frozenset("a abbr acronym annotation b bdi bdo big cite code data del dfn em font i ins kbd label mark math menclose mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover object q rp rt ruby s samp semantics small span strike strong sub sup time tt u var wbr".split())
#: Elements, and whole classes, ids and roles, that mark what isn't article text.
_FURNITURE = frozenset("nav header footer aside form dialog menu head".split())
_MARKS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies consent complementary disqus footer header menu modal nav navbar navigation newsletter notice notices popup promo promoted related search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
#: Words that such a name may be made up with ("site-header", "ad_slot_2", "cookie-consent"); any other word makes it a name of its own.
_PARTS = _MARKS | frozenset("area bar block bottom box btn button buttons container content global group inner item items left link links list main mobile outer overlay page panel posts primary right row secondary section site slot sticky sub top unit widgets wrap wrapper".split())
#: Elements whose ids are made from what they say: headings and paragraphs anywhere, sections within an article.
_NAMED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+|[^\W\d_a-z]+")
_END_RAW = {t: re.compile(rf"</{t}[\s/>]|\Z", re.I) for t in _RAW}


#: Whole pages and articles, whose classes tell of their layout; only reader comments count among those of an article.
_WHOLE = {"html": frozenset(), "body": frozenset(), "main": frozenset(), "article": frozenset(["comment", "comments"])}


def _marked(name: str, attrs: str, within: bool) -> bool:
    """Whether a whole class, id or role of the element is a mark, or made up of marks and ``_PARTS`` alone.

    ``within``: inside an article, where the id of a section tells its heading.
    """
    marks, parts = _WHOLE.get(name, _MARKS), _PARTS if name not in _WHOLE else _WHOLE[name]
    for m in _ATTR.finditer(attrs):
        if m[1].lower() == "id" and (name in _NAMED or name == "section" and within):
            continue
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            words = _WORD.findall(token)
            if any(w in marks for w in words) and all(w in parts for w in words):
                return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks in order; kind 0: plain, 1: in an article, 2: furniture.

    Character references are decoded, white space becomes one space, and the ends are trimmed.
    Comments, scripts and the like hold no text. Broken markup is read as far as it goes: an end tag closes the
    nearest element of its name and everything opened since; one without a start is skipped.
    """
    out: list[tuple[int, str]] = []
    text: list[str] = []
    open_: list[tuple[str, int]] = []  # element, kind inside it
    kind, at = 0, 0

    def flush() -> None:
        if text:
            if line := " ".join(_html.unescape("".join(text)).split()):
                out.append((kind, line))
            text.clear()

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if any(e == name for e, _ in open_):
                if name not in _INLINE:
                    flush()
                while True:
                    gone, _ = open_.pop()
                    if gone not in _INLINE:
                        flush()
                    kind = open_[-1][1] if open_ else 0
                    if gone == name:
                        break
            continue
        if name in _RAW:
            at = _END_RAW[name].search(page, at).start()
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            continue
        if name not in _INLINE:
            flush()
        if name in _VOID:
            continue
        while open_ and name not in _INLINE and (open_[-1][0] == "p" or open_[-1][0] in _INLINE and any(e == "p" for e, _ in open_) and name == "p" or open_[-1][0] == name == "li"):
            gone, _ = open_.pop()  # a block ends an open paragraph
        kind = open_[-1][1] if open_ else 0
        if kind != 2:
            if name in _FURNITURE or _marked(name, m[3] or "", kind == 1):
                kind = 2
            elif name in ("article", "main"):
                kind = 1
        open_.append((name, kind))
    flush()
    return out


#: Cells of an alignment table that is held as a whole (16 MB); larger ones are halved.
_CELLS = 1 << 22


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The longest common subsequence's length of ``x`` and every beginning of ``y``; one row of the usual table at a time."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0)))
    return row


def _align(x: np.ndarray, y: np.ndarray, keep: np.ndarray) -> None:
    """Mark in ``keep`` which of ``x`` are in a longest common subsequence, in memory that grows with len(x) + len(y)."""
    same = 0  # equal ends are in it
    while same < min(len(x), len(y)) and x[same] == y[same]:
        same += 1
    keep[:same] = True
    x, y, keep = x[same:], y[same:], keep[same:]
    same = 0
    while same < min(len(x), len(y)) and x[len(x) - 1 - same] == y[len(y) - 1 - same]:
        same += 1
    if same:
        keep[-same:] = True
        x, y, keep = x[:-same], y[:-same], keep[:-same]
    if not len(x) or not len(y):
        return
    if len(x) == 1:
        keep[0] = bool((y == x[0]).any())
        return
    if (len(x) + 1) * (len(y) + 1) > _CELLS:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        _align(x[:half], y[:cut], keep[:half])
        _align(x[half:], y[cut:], keep[half:])
        return
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x)):  # a running maximum over diagonal steps
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], np.where(y == x[i], table[i, :-1] + 1, 0)))
    i, j = len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            keep[i - 1] = True
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1


def shared_lines(a: list[int], b: list[int]) -> np.ndarray:
    """Which of ``a`` are in a longest common subsequence of ``a`` and ``b``."""
    keep = np.zeros(len(a), bool)
    both = set(a) & set(b)
    at = np.array([i for i, x in enumerate(a) if x in both], np.int64)
    if len(at):
        found = np.zeros(len(at), bool)
        _align(np.array([a[i] for i in at]), np.array([x for x in b if x in both]), found)
        keep[at[found]] = True
    return keep


#: Pages in a part of the order, and the most parts there are; a part is the least that one task takes.
PART, PARTS = 1024, 4096


#: Share of two pages' characters in lines that both have from which they are near copies of each other.
NEAR = 0.8


def near_copies(a: Counter[str], b: Counter[str]) -> bool:
    """Whether two pages' lines are the same for the most part, in whatever order."""
    size = lambda x: sum(len(t) * n for t, n in x.items())
    return 2 * size(a & b) >= NEAR * (size(a) + size(b))


def decide(lines: list[tuple[int, str]], others: list[list[tuple[int, str]]]) -> tuple[str, int, int, bool]:
    """(text, number of lines, number of those that the ``others`` share, whether what they don't share is the text).

    Articles' lines are aligned with articles' lines, the rest with the rest. Where the markup names an article, it
    brings back what is shared inside and takes out what isn't outside; a page of which nothing would be left keeps its plain lines.
    """
    gone = np.zeros(len(lines), bool)
    for inside in (True, False):
        at = [i for i, (k, _) in enumerate(lines) if (k == 1) is inside]
        own = [hash(lines[i][1]) for i in at]
        for other in others:
            gone[at] |= shared_lines(own, [hash(t) for k, t in other if (k == 1) is inside])
    new = [x for x, g in zip(lines, gone, strict=True) if not g]
    kept = [t for k, t in lines if k == 1] or [t for k, t in new if k == 0] or [t for k, t in lines if k == 0]
    text = " ".join(kept)
    return text, len(lines), int(gone.sum()), text == " ".join(t for _, t in new)


def others_before(run: list, alike) -> list:
    """For each content of ``run``, the last one before it that isn't ``alike``, or None. Repeated contents are looked at once."""
    out, recent = [], {}
    for c in run:
        out.append(next((x for x in reversed(recent) if x != c and not alike(c, x)), None))
        recent.pop(c, None)
        recent[c] = True
    return out


def _bounds(pages: DataFrame, host, path, page_id: str) -> list[tuple]:
    """(before, cut, after): cuts of the order by (host, path, id) into parts of about PART pages, and how far the pages
    reach that the part on the other side sees: from the keys with the smallest hashes, at most 16 for a part, so that
    they depend on the pages alone. ``before`` and ``after`` are pages' keys next to the cut in the sample."""
    keys = pages.select(host.alias("host"), path.alias("path"), F.coalesce(F.col(page_id).cast("bigint"), F.lit(-1)).alias("id"))
    n = keys.count()
    parts = min(PARTS, -(-n // PART))
    if parts < 2:
        return []
    sample = sorted(tuple(r)[1:] for r in keys.select(F.xxhash64("host", "path", "id").alias("h"), "*").orderBy("h", "host", "path", "id").limit(16 * parts).collect())
    sample, cuts = sorted(set(sample)), sorted({sample[i * len(sample) // parts] for i in range(1, parts)})
    at = [(bisect.bisect_left(sample, c), c) for c in cuts if c > sample[0]]
    return [(sample[i - 1], c, sample[min(i + 1, len(sample) - 1)]) for i, c in at]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_lines, n_shared, by_neighbours) of every row; text is empty where nothing is left, and for null html.

    ``n_shared`` of its ``n_lines`` lines are shared with its neighbours; ``by_neighbours``: the others are the text, so that
    the markup changes nothing.

    The order by (host, path, id) is cut into parts, so that no host's pages meet in one task; a part also sees about a
    sixteenth of the parts before and after it. A page is compared with the nearest page before and after it on its host
    that is no copy or near copy of it. Where all that its part sees are, it keeps its plain lines.
    All pages are aligned, whatever their markup says.
    Repeated rows and null urls (host and path empty) are rows like others.
    """
    host, path = host_path(F.col(url))
    bounds = pages.sparkSession.sparkContext.broadcast(_bounds(pages, host, path, page_id))
    shape = "page_id bigint, url string, host string, path string, part int, guest boolean, packed binary"

    def cut(batches):
        pack, at = zstandard.ZstdCompressor(level=3), bounds.value
        cuts = [c for _, c, _ in at]
        for b in batches:
            row, part, guest = [], [], []
            for i, (p, h, w) in enumerate(zip(*(b[c].to_pylist() for c in (0, 2, 3)), strict=True)):
                key = (h, w, -1 if p is None else p)
                own = bisect.bisect_right(cuts, key)
                seen = [own, *([own + 1] if own < len(at) and key >= at[own][0] else []), *([own - 1] if own and key <= at[own - 1][2] else [])]
                row += [i] * len(seen)
                part += seen
                guest += [x != own for x in seen]
            packed = pa.array([pack.compress(json.dumps(blocks(x.as_py() or ""), ensure_ascii=False).encode()) for x in b[4]], pa.binary())
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(row) for c in b.columns[:4]), pa.array(part, pa.int32()), pa.array(guest, pa.bool_()), packed.take(row)], names=["page_id", "url", "host", "path", "part", "guest", "packed"])

    def difference(batches):
        unpack = zstandard.ZstdDecompressor()

        def emit(run):
            """Texts of a host's pages in a part, in order; a content (packed lines) is read once however often it occurs."""
            lines = {z: [tuple(x) for x in json.loads(unpack.decompress(z))] for z in {r[4] for r in run}}
            texts = {z: Counter(t for k, t in x if k != 2) for z, x in lines.items()}
            known, left = {}, {}

            def alike(a, b):
                if (a, b) not in known:
                    known[a, b] = known[b, a] = near_copies(texts[a], texts[b])
                return known[a, b]

            order = [r[4] for r in run]
            both = zip(others_before(order, alike), reversed(others_before(order[::-1], alike)), strict=True)
            for (p, u, _, guest, z), near in zip(run, both, strict=True):
                if not guest:
                    if (z, near) not in left:
                        left[z, near] = decide(lines[z], [lines[x] for x in near if x is not None])
                    yield p, u, *left[z, near]

        def runs():
            run, at = [], None
            for b in batches:
                for p, u, h, _, part, guest, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if run and (part, h) != at:
                        yield run
                        run = []
                    at = part, h
                    run.append((p, u, h, guest, z))
            if run:
                yield run

        done, size = [], 0
        for run in runs():
            for page in emit(run):
                done.append(page)
                size += len(page[2])
                if size > 4 << 20:
                    yield _batch(done)
                    done, size = [], 0
        if done:
            yield _batch(done)

    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"), F.col(html).alias("html")).mapInArrow(cut, shape)
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = rows.repartition(n, "part").sortWithinPartitions("part", "host", "path", "page_id")
    return near.mapInArrow(difference, "page_id bigint, url string, text string, n_lines bigint, n_shared bigint, by_neighbours boolean")


def _batch(done: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "text", "n_lines", "n_shared", "by_neighbours"]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
