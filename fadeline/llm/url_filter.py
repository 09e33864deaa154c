"""URL filter: host and path rules first, then a ratio of two character language models.

Each model is an interpolated (Witten-Bell) variable-order Markov model over characters: orders 0 to
``order``, each context's distribution backing off to the next shorter one. One model learns URLs that
rules accept, the other those that rules reject. A URL that no rule settles is blocked when its
length-normalised log-likelihood under the rejected model exceeds that under the accepted model by
more than a threshold calibrated on URLs left out of the training.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fadeline.llm._common import free_name

_A_TO_Z, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    ok = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(ok, F.translate(host, _A_TO_Z, _LOWER)).otherwise(""), F.when(ok, path).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null.

    A rule is host + path as one string (``net/es/``): it fits its host and all subdomains, when the
    path starts with the rule's. Of equally long rules that fit, the first in ``rules`` wins.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(reversed(rules), key=lambda r: len(r[0])):  # the last one that fits is the outermost condition
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class CharModel:
    """Counts of characters after contexts of 0..order characters, with Witten-Bell interpolation."""

    def __init__(self, urls: Sequence[str], order: int = 4):
        self.order = order
        self.counts: dict[str, dict[str, int]] = {}
        for u in urls:
            s = "\x02" * order + u + "\x03"
            for i in range(order, len(s)):
                for k in range(order + 1):
                    c = self.counts.setdefault(s[i - k : i], {})
                    c[s[i]] = c.get(s[i], 0) + 1
        self.totals = {c: (sum(d.values()), len(d)) for c, d in self.counts.items()}
        self._memo: dict[str, float] = {}

    def log_p(self, gram: str) -> float:
        """log2 of the probability of the last character after the others."""
        if (got := self._memo.get(gram)) is None:
            p = 1.0 / 65536
            for k in range(len(gram)):
                ctx = gram[len(gram) - 1 - k : -1]
                if ctx not in self.totals:
                    break
                total, kinds = self.totals[ctx]
                p = (self.counts[ctx].get(gram[-1], 0) + kinds * p) / (total + kinds)
            if len(self._memo) > 500_000:
                self._memo.clear()
            got = self._memo[gram] = math.log2(p)
        return got

    def score(self, url: str) -> float:
        """Mean log2 probability of a character, the end mark included."""
        s, n = "\x02" * self.order + url + "\x03", self.order
        return sum(self.log_p(s[i - n : i + 1]) for i in range(n, len(s))) / (len(s) - n)


def fit(labelled: DataFrame, sample: int = 10_000, order: int = 4, holdout: int = 5, longest: int = 2_000) -> tuple[CharModel, CharModel, float]:
    """(accepted model, rejected model, threshold) from ``labelled(url, verdict)``.

    Learns from at most ``sample`` different URLs of each verdict, those with the smallest hashes among the ones of
    at most ``longest`` characters: a bounded sample (of 40 MB at most), documented as such. Every ``holdout``-th of them is left out and calibrates the
    threshold: the difference that errs least on both sides alike. Without URLs of either
    verdict the models stay empty and nothing is blocked.
    """
    ready = labelled.filter(F.length("url") <= longest).select("url", "verdict", F.xxhash64("url").alias("h"))
    number = {r["verdict"]: r["n"] for r in ready.groupBy("verdict").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    kept = {}
    for verdict in ("allow", "block"):
        # hashes under which about twice the sample lies, so that few rows are shuffled or sent to the driver
        share = min(1.0, 2 * sample / max(1, number.get(verdict, 0)))
        low = ready.filter(F.col("verdict") == verdict).filter(F.col("h") <= min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64))))
        kept[verdict] = [r.url for r in low.distinct().orderBy("h", "url").limit(sample).collect()]
    train = {v: [u for i, u in enumerate(us) if i % holdout or len(us) < 2 * holdout] for v, us in kept.items()}
    held = {v: us[::holdout] for v, us in kept.items()}
    good, bad = CharModel(train["allow"], order), CharModel(train["block"], order)
    if not kept["allow"] or not kept["block"]:
        return good, bad, math.inf
    marks = sorted([(bad.score(u) - good.score(u), v == "block") for v, us in held.items() for u in us])
    n_block, n_allow = len(held["block"]), len(held["allow"])
    # walk the threshold up: blocked URLs fall below it one by one, allowed ones get free
    missed, wrong, best = 0, n_allow, (n_allow / n_allow, marks[0][0] - 1e-9)
    for i, (x, is_block) in enumerate(marks):
        missed, wrong = missed + is_block, wrong - (not is_block)
        nxt = marks[i + 1][0] if i + 1 < len(marks) else x + 1e-9
        best = min(best, (missed / n_block + wrong / n_allow, (x + nxt) / 2))
    return good, bad, max(best[1], 0.0)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", **how) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block), for every row.

    The rule decides where one fits, else the models. Null URLs and those without ``://`` have empty
    host and path; they fit no rule, and the models judge them as they stand (null: as empty).
    Repeated rows get the same verdict and stay rows of their own; an empty table gives an empty one. Columns named
    host, path, rule or verdict are replaced, unless one of them holds the URLs: that raises.
    """
    h, p = host_path(F.col(url))
    if url in ("host", "path", "rule", "verdict"):
        raise ValueError(f"the URLs' column can't be named {url}")
    base = pages.drop("host", "path", "rule", "verdict")
    r = free_name(base, "__r")
    ruled = base.withColumn("host", h).withColumn("path", p).withColumn(r, rule_for(F.col("host"), F.col("path"), rules))
    good, bad, threshold = fit(ruled.filter(F.col(r).isNotNull()).select(F.col(url).alias("url"), F.col(f"{r}.verdict").alias("verdict")), **how)
    model = pages.sparkSession.sparkContext.broadcast((good, bad, threshold))
    out = T.StructType([*ruled.drop(r).schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches):
        good, bad, threshold = model.value
        for b in batches:
            urls, verdicts = b[url].to_pylist(), b["verdict"].to_pylist()
            got = [v or ("block" if bad.score(u or "") - good.score(u or "") > threshold else "allow") for u, v in zip(urls, verdicts, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.string())], names=out.names)

    return ruled.select("*", F.col(f"{r}.rule").alias("rule"), F.col(f"{r}.verdict").alias("verdict")).drop(r).mapInArrow(run, out)
