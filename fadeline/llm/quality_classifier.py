"""Quality classifier from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Labellers vote good, bad or nothing on every document. Their accuracies, and each voting pattern's
probability of being good, are estimated together, from how often they agree: no labels are used.
The posteriors of a bounded sample of documents train a logistic scorer over hashed features, which then
scores every document, those on which all labellers abstain included.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadeline.llm._common import discard, forget, settle, trim
from fadeline.llm.shingles import text_slices, word_hashes

#: Documents that train the scorer, at most: those with the smallest hashes of id and text.
SAMPLE = 8_000
#: Features: byte pairs, and bands of the labellers' measurements.
_PAIRS, _BANDS = 1 << 16, 16
#: Documents under this score are rejected; shorter ones than LEAST_WORDS are kept unless clearly bad.
REJECT, LEAST_WORDS = 0.5, 20

_IS = {k: np.zeros(256, np.int64) for k in ("space", "upper", "lower", "symbol", "mark", "digit")}
for _name, _chars in (("space", b" \t\n\x0b\f\r"), ("upper", bytes(range(65, 91))), ("lower", bytes(range(97, 123))), ("symbol", b"#*$%&|<>{}[]\\^~_=+@"), ("mark", b"!?"), ("digit", bytes(range(48, 58)))):
    _IS[_name][list(_chars)] = 1

MEASURES = ("symbols", "capitals", "marks", "repeats", "stutter", "variety", "digits")


def measures(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(measurements, number of words) of texts laid end to end: one row per text, columns as MEASURES."""
    sums = {k: np.diff(np.r_[0, np.cumsum(v[data])][cuts]).astype(float) for k, v in _IS.items()}
    words, first = word_hashes(data, cuts)
    n = np.diff(first)
    visible = np.maximum(np.diff(cuts) - sums["space"], 1)
    letters = np.maximum(sums["upper"] + sums["lower"], 1)
    # a word's earlier occurrence in the same text
    owner = np.repeat(np.arange(len(n)), n)
    key = words ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(words), bool)
    fresh[order[1:]] = key[order[1:]] != key[order[:-1]]
    kinds = np.bincount(owner[fresh], minlength=len(n))
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    stutter = np.bincount(owner[same], minlength=len(n))
    # pairs of words that have occurred before, as a share of all pairs
    pair = np.zeros(len(words), np.uint64)
    pair[1:] = words[1:] * np.uint64(3) + words[:-1]
    pkey = pair ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    porder = np.argsort(pkey, kind="stable")
    again = np.zeros(len(words), bool)
    again[porder[1:]] = pkey[porder[1:]] == pkey[porder[:-1]]
    repeats = np.bincount(owner[again], minlength=len(n))
    of = np.maximum(n, 1)
    return np.column_stack([sums["symbol"] / visible, sums["upper"] / letters, sums["mark"] / visible, repeats / of, stutter / of, kinds / of, sums["digit"] / visible]), n


#: The labellers: each turns measurements and word counts into 1 (good), -1 (bad) or 0 (no opinion). Those for
#: a kind of bad text have no opinion on other texts.
LABELLERS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "symbols": lambda m, n: -((m[:, 0] > 0.06) & (n >= 8)).astype(int),
    "capitals": lambda m, n: -((m[:, 1] > 0.35) & (n >= 8)).astype(int),
    "marks": lambda m, n: -((m[:, 2] > 0.05) & (n >= 8)).astype(int),
    "stutter": lambda m, n: -((m[:, 4] > 0.25) & (n >= 10)).astype(int),
    "monotony": lambda m, n: -((m[:, 5] < 0.15) & (n >= 50) & (n < 2000)).astype(int),
    "plain": lambda m, n: ((m[:, 0] < 0.03) & (m[:, 1] < 0.25) & (m[:, 2] < 0.03) & ((m[:, 4] < 0.1) | (n < 20))).astype(int),
    "variety": lambda m, n: ((m[:, 5] > 0.4) & (n >= 20)).astype(int),
}


def expectation_maximisation(votes: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, P(vote | class), prior) of patterns of votes with their counts.

    Labellers are taken as independent given the class; each has its own chances of voting bad, nothing
    and good for either class (the result's axes: class good and bad, labeller, vote). A bad vote starts
    a pattern as bad: that decides which class is the good one.
    """
    is_vote = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    post = np.where((votes == -1).any(1), 0.1, np.where((votes == 1).any(1), 0.9, 0.5))
    chance, prior = np.full((2, votes.shape[1], 3), 1 / 3), 0.8
    for _ in range(rounds):
        for c, of in enumerate((post, 1 - post)):
            got = np.einsum("p,plv->lv", weight * of, is_vote) + 0.5
            chance[c] = got / got.sum(1, keepdims=True)
        prior = float(((weight * post).sum() + 4) / (weight.sum() + 5))
        good, bad = (np.einsum("plv,lv->p", is_vote, np.log(x)) for x in chance)
        new = 1 / (1 + np.exp(np.clip(bad + np.log1p(-prior) - good - np.log(prior), -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, chance, prior


def features(data: np.ndarray, cuts: np.ndarray, m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indexes, values) of each text: byte pairs by their share's square root, bands by one; length 1."""
    out = []
    pairs = data[:-1].astype(np.int64) * 256 + data[1:] if len(data) else np.zeros(0, np.int64)
    bands = np.minimum((np.sqrt(np.clip(m, 0, 1)) * _BANDS).astype(np.int64), _BANDS - 1) + _PAIRS + np.arange(m.shape[1]) * _BANDS
    for d in range(len(cuts) - 1):
        kinds, count = np.unique(pairs[cuts[d] : max(cuts[d], cuts[d + 1] - 1)], return_counts=True)
        value = np.r_[np.sqrt(count / max(1, count.sum())), np.full(m.shape[1], 0.35)]
        out.append((np.r_[kinds, bands[d]], value))
    return out


def train(index: np.ndarray, value: np.ndarray, owner: np.ndarray, target: np.ndarray, epochs: int = 60, rate: float = 4.0, decay: float = 1e-5) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer, by full gradients with momentum on soft targets.

    ``index``, ``value`` and ``owner`` hold all documents' features end to end; ``owner`` numbers the document.
    """
    n, size = len(target), _PAIRS + len(MEASURES) * _BANDS + 1
    w, step = np.zeros(size), np.zeros(size)
    if not n:
        return w
    balance = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum()))
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[index] * value, n) + w[-1], -30, 30)))
        error = (p - target) * balance
        grad = np.bincount(index, error[owner] * value, size)
        grad[-1] = error.sum()
        step = 0.9 * step - rate * (grad + decay * w)
        w += step
    return w


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, row: str | None = None) -> DataFrame:
    """(doc_id, n_words, posterior, score, kept[, row]) of every row; ``row`` names a bigint column that goes through.

    ``posterior`` is the weak labels' probability of good, ``score`` the scorer's. A document is
    kept if its score reaches ``REJECT``, or if the scorer and the labellers don't agree that it is bad. Null
    and empty texts have no words: score 0, rejected. Repeated rows are judged alike. The counts
    of voting patterns cover all documents; the driver gets at most 3 ** labellers of them.
    """
    labellers = list(LABELLERS.values())

    def vote(batches):
        forget()
        for b in batches:
            pattern, n_words, h = [], [], []
            for _, data, cuts in text_slices(b[1]):
                m, n = measures(data, cuts)
                votes = np.column_stack([f(m, n) for f in labellers]) + 1
                pattern.append(np.where(n > 0, votes @ 3 ** np.arange(len(labellers)), -1))
                n_words.append(n)
            yield pa.RecordBatch.from_arrays([b[0], pa.array(np.concatenate(pattern) if pattern else [], pa.int32()), b[2]], names=["doc_id", "pattern", "h"])

    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"), F.xxhash64(doc_id, text).alias("h"))
    voted = settle(base.mapInArrow(vote, "doc_id bigint, pattern int, h bigint"))
    table = voted.filter("pattern >= 0").groupBy("pattern").count().orderBy("pattern").toPandas()
    votes = (table["pattern"].to_numpy(np.int64)[:, None] // 3 ** np.arange(len(labellers)) % 3) - 1
    post, _, _ = expectation_maximisation(votes, table["count"].to_numpy(float))
    posterior = np.zeros(3 ** len(labellers))
    posterior[table["pattern"].to_numpy(np.int64)] = post

    # the sample: all below the hash that leaves about ``sample`` of them
    n = int(table["count"].sum())
    below = min((1 << 63) - 1, -(1 << 63) + int(sample / max(1, n) * (1 << 64)))
    chosen = base.filter((F.col("h") <= below) & F.col("t").isNotNull()).select("h", "t")

    def describe(batches):
        for b in batches:
            index, value, target = [], [], []
            for _, data, cuts in text_slices(b[1]):
                m, n_words = measures(data, cuts)
                at = np.column_stack([f(m, n_words) for f in labellers]) + 1
                for (i, v), p, k in zip(features(data, cuts, m), posterior[at @ 3 ** np.arange(len(labellers))], n_words, strict=True):
                    index.append(i.astype(np.int32) if k else i[:0].astype(np.int32)), value.append(v.astype(np.float32) if k else v[:0].astype(np.float32)), target.append(p)
            yield pa.RecordBatch.from_arrays([b[0], pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())), pa.array(target, pa.float64())], names=["h", "i", "v", "p"])

    got = chosen.mapInArrow(describe, "h bigint, i array<int>, v array<float>, p double").orderBy("h").limit(sample).toArrow()
    lists = got["i"].combine_chunks()
    owner = np.repeat(np.arange(len(got), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    weights = train(lists.flatten().to_numpy(), got["v"].combine_chunks().flatten().to_numpy(), owner, got["p"].to_numpy())
    del got, lists, owner
    model = docs.sparkSession.sparkContext.broadcast((weights, posterior))  # half a MB
    discard(voted)

    def score(batches):
        w, posterior = model.value
        for b in batches:
            n_all, p_all, s_all = [], [], []
            for _, data, cuts in text_slices(b[1]):
                m, n_words = measures(data, cuts)
                at = np.column_stack([f(m, n_words) for f in labellers]) + 1
                p_all.append(np.where(n_words > 0, posterior[at @ 3 ** np.arange(len(labellers))], 0.0))
                z = np.array([w[i] @ v for i, v in features(data, cuts, m)]) + w[-1]
                s_all.append(np.where(n_words > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0))
                n_all.append(n_words)
            join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
            n_words, p, s = join(n_all, pa.int64()), join(p_all, pa.float64()), join(s_all, pa.float64())
            sn, ss, sp = n_words.to_numpy(), s.to_numpy(), p.to_numpy()
            kept = (sn > 0) & ((ss >= REJECT) | (sp >= 0.5) & (ss >= REJECT / 2) | (sn < LEAST_WORDS) & (sp >= 0.05))
            yield pa.RecordBatch.from_arrays([b[0], n_words, p, s, pa.array(kept), *b.columns[2:]], names=["doc_id", "n_words", "posterior", "score", "kept", *through])
        trim()

    through = [row] if row else []
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"), *through)
    return rows.mapInArrow(score, "doc_id bigint, n_words bigint, posterior double, score double, kept boolean" + "".join(f", `{c}` bigint" for c in through))
