"""Quality rules: fixed limits on document statistics, then gradient-boosted trees over them.

Statistics are taken from whole texts. Words are runs of bytes other than space and \\t \\n \\v \\f \\r. Trees are grown in
numpy by second-order gain on binned features, flattened into node arrays, and scored a batch at a time by stepping all
rows down together. On the features named in ``DECREASING`` the score never rises with the feature: a split that would
is not made, and children keep to either side of the middle between their values.

Training uses the labels of at most ``rows`` documents, as a classifier's bounded sample; every document is scored.
The score is the probability of good quality. A document is rejected under ``threshold``, fitted on rows kept from
training so that at most ``good_loss`` of the good ones fall under it.

Defined results: null text counts as empty: all statistics 0, base_failed. Without labels of both kinds nothing can be
learned and the base rules alone decide (score null). Several labels of a document count as good if any is 1; null labels
and ids are not learned from. Repeated rows are judged alike; an empty table gives an empty table. Results are added in
one struct column, so names of other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_sample, small_batches

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share",
    "digit_share", "punctuation_share", "bar_share", "words_per_line", "top_word_share", "exclaim_share",
)
DECREASING = ("symbols_per_word", "dup_line_share", "repeat_share", "bar_share", "exclaim_share")
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
PUNCTUATION = np.isin(np.arange(256), list(b".,;:!?'\"()-"))


def statistics(raw: bytes) -> tuple[list[int], list[float]]:
    """The base counts and the features of a UTF-8 text."""
    words = raw.split()
    n = len(words)
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(bytes_of[~SPACES].sum() - bytes_of[128:192].sum())  # continuation bytes are not characters
    symbols = int(bytes_of[SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeats = 0
    if n >= 3:
        v = len(number)
        pair = ids[:-1] * v + ids[1:]
        if v > 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1]
        _, kind, times = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
        twice = np.nonzero(times[kind] > 1)[0]
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[twice + k] = True
        repeats = int(covered.sum())
    w, c = max(n, 1), max(chars, 1)
    top = int(np.bincount(ids).max()) if n else 0
    return [n, chars, symbols, dup, repeats], [
        np.log1p(n), chars / w, symbols / w, dup / max(len(lines), 1), repeats / w, len(number) / w,
        bytes_of[65:91].sum() / c, bytes_of[48:58].sum() / c, bytes_of[PUNCTUATION].sum() / c, bytes_of[124] / w,
        n / max(len(lines), 1), top / w, bytes_of[33] / w,
    ]


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf is its own child."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    threshold: float = 0.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, decreasing: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Logistic boosting with a sign constraint on the features ``decreasing``."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    margin = np.full(len(y), np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, limit, left, right, value
    roots = []

    def value(g, h, low, high):
        return float(np.clip(-g / (h + ridge), low, high))

    def node(rows, g, h, level, low, high) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        nodes.append([0, 0.0, me, me, rate * value(gs, hs, low, high)])
        if level == depth or hs < 2 * least:
            return me
        best = None
        for f, e in enumerate(edges):
            if not len(e):
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs**2 / (hs + ridge)
            gain[(hl < least) | (hr < least) | ((vr > vl) if f in decreasing else False)] = 0
            k = int(gain.argmax())
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = gain[k], f, k, (vl[k] + vr[k]) / 2
        if best is None:
            return me
        _, f, k, middle = best
        goes = binned[rows, f] <= k
        sided = f in decreasing
        left = node(rows[goes], g, h, level + 1, middle if sided else low, high)
        right = node(rows[~goes], g, h, level + 1, low, middle if sided else high)
        nodes[me][:4] = [f, float(edges[f][k]), left, right]
        return me

    flat = None
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(node(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        flat = np.array(nodes)
        one = Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array([first]), depth, 0.0)
        q = one.probability(x)
        margin += np.log(q / (1 - q))
    return Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots), depth, float(np.log(share / (1 - share))))


def train(x: np.ndarray, y: np.ndarray, good_loss: float = 0.01) -> Trees | None:
    """Every fourth row is kept to fit the threshold, which is at most one half."""
    kept = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[~kept])) < 2:
        return None
    model = grow(x[~kept], y[~kept], [FEATURES.index(f) for f in DECREASING])
    good = model.probability(x[kept])[y[kept] == 1]
    model.threshold = min(0.5, float(np.quantile(good, good_loss))) if len(good) else 0.0
    return model


def _columns(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = [statistics(x or b"") for x in texts.cast(pa.binary()).to_pylist()]
    return np.array([a for a, _ in found], np.int64).reshape(-1, len(BASE)), np.array([b for _, b in found], float).reshape(-1, len(FEATURES))


def fit_quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 20_000, good_loss: float = 0.01) -> Trees | None:
    """Learns from the statistics of at most ``rows`` labelled documents; only those reach the driver."""

    def features(texts: pa.Array) -> pa.Array:
        x = _columns(texts)[1]
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))

    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    known = known.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")  # before the bound: labels may be of other documents
    known = known.select(F.col("doc_id").alias("id"), "good").orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(rows)
    picked = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    found = bounded_sample(picked, rows).select("good", "__h", F.arrow_udf(features, "array<double>")("text").alias("x")).dropDuplicates(["__h"]).collect()
    found = sorted(found, key=lambda r: r["__h"])
    if not found:
        return None
    return train(np.array([r["x"] for r in found]), np.array([float(r["good"] > 0) for r in found]), good_loss)


def quality(docs: DataFrame, text: Column, model: Trees | None, least_words: int = 50, most_repeats: int = 50) -> Column:
    """text -> struct of the base counts, base_failed, score and kept."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)  # nodes of some sixty small trees

    def run(texts: pa.Array) -> pa.Array:
        base, x = _columns(texts)
        failed = (base[:, 0] < least_words) | (100 * base[:, 4] > most_repeats * base[:, 0])
        trees = shared.value
        if trees is None:
            score, kept = pa.nulls(len(base), pa.float64()), ~failed
        else:
            p = trees.probability(x) if len(x) else np.zeros(0)
            score, kept = pa.array(np.round(p, 6)), ~failed & (p >= trees.threshold)
        return pa.StructArray.from_arrays([*(pa.array(c) for c in base.T), pa.array(failed), score, pa.array(kept)], [*BASE, "base_failed", "score", "kept"])

    kind = ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, score double, kept boolean"
    return F.arrow_udf(run, kind).asNondeterministic()(text)
