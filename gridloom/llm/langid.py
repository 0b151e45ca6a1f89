"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent.

Subwords are runs of 3 and 4 bytes of the UTF-8 text with A-Z in lower case, hashed to buckets. A document is the mean
of its subwords' embeddings. Once trained, embedding and output layer are multiplied out, so that scoring a text adds up
one row of logits a subword. Scores are softmax probabilities at a temperature fitted on rows kept from training; a
prediction is rejected if its score is under a threshold that ``reject_rate`` of the right predictions on those rows
fall short of.

Training uses at most ``rows`` labelled documents of at most ``max_chars`` characters (longer ones are not cut but left
out), as a classifier's bounded sample; every document is scored over its whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; if nothing can be learned,
so is every text. A null id is in no fold and not learned from. Repeated rows are scored alike; an empty table gives an
empty table. Results are added in one struct column, so names of other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_sample, fold_of, small_batches

UNKNOWN = "und"
SIZES = (3, 4)
BITS = 16
CHUNK = 1 << 20
LOWER = np.arange(256, dtype=np.uint32)
LOWER[65:91] += 32


def _subwords(raw: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the subword that begins at each byte (the last size - 1 bytes begin none)."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    key = raw[:n] + np.uint32(size)
    for k in range(1, size):
        key = key * np.uint32(0x01000193) ^ raw[k : n + k]
    return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


@dataclass
class LanguageModel:
    labels: list[str]
    logits: np.ndarray  # a row for each bucket
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of the texts that lie in ``data`` (bytes) between ``offsets``."""
        return softmax(self.mean_logits(data, offsets) / self.temperature)

    def mean_logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """What the softmax is taken of, but for the temperature."""
        texts = len(offsets) - 1
        total = np.zeros((texts, len(self.labels)))
        seen = np.zeros(texts, np.int64)
        for size in SIZES:
            seen += np.maximum(0, np.diff(offsets) - size + 1)
        for low in range(int(offsets[0]), int(offsets[-1]), CHUNK):
            high = min(low + CHUNK, int(offsets[-1]))
            raw = LOWER[data[low : min(high + max(SIZES) - 1, int(offsets[-1]))]]
            first, last = np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, high, "left")
            edges = offsets[first : last + 1]
            full = np.nonzero(np.diff(edges))[0]  # reduceat needs texts that are not empty
            starts = np.maximum(edges[full], low) - low
            for size in SIZES:
                rows = self.logits[_subwords(raw, size)][: high - low]
                if len(rows) < high - low:
                    rows = np.concatenate([rows, np.zeros((high - low - len(rows), len(self.labels)), np.float32)])
                for k in range(1, size):  # those that run over a text's end
                    over = edges[1:] - k - low
                    rows[over[(over >= 0) & (over < high - low)]] = 0
                total[first + full] += np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
        return total / np.maximum(seen, 1)[:, None] + self.bias


def _has_letter(raw: bytes) -> bool:
    return any(map(str.isalpha, raw.decode("utf-8", "replace")))


def train(texts: list[str], langs: list[str], dimensions: int = 16, epochs: int = 4, rate: float = 3.0, reject_rate: float = 0.001, seed: int = 5) -> LanguageModel | None:
    """Every fourth row is kept for calibration."""
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / dimensions, 1 / dimensions, (1 << BITS, dimensions))
    output, bias = np.zeros((dimensions, len(labels))), np.zeros(len(labels))
    target = np.array([labels.index(x) for x in langs])
    raws = [np.frombuffer(x.encode(), np.uint8) for x in texts]
    fit = [i for i in range(len(raws)) if i % 4 != 3 or len(raws) < 8]
    bags = {}
    for i in fit:
        found, counts = np.unique(np.concatenate([_subwords(LOWER[raws[i]], s) for s in SIZES]), return_counts=True)
        if len(found):
            bags[i] = found, counts / counts.sum()
    steps, step = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(list(bags)).tolist():
            found, share = bags[i]
            mean = share @ embedding[found]
            z = mean @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            now = rate * (1 - step / steps) + 0.05
            back = output @ p
            output -= now * np.outer(mean, p)
            bias -= 0.1 * now * p
            embedding[found] -= now * np.outer(share, back)
            step += 1
    model = LanguageModel(labels, (embedding @ output).astype(np.float32), bias, 1.0, 0.0)
    kept = [i for i in range(len(raws)) if i % 4 == 3] if len(raws) >= 8 else fit
    data = np.concatenate([raws[i] for i in kept]) if kept else np.zeros(0, np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(raws[i]) for i in kept]))).astype(np.int64)
    best, z = None, model.mean_logits(data, offsets)
    for t in np.geomspace(0.05, 4, 24):
        p = softmax(z / t)
        loss = -np.log(np.maximum(p[np.arange(len(kept)), target[kept]], 1e-12)).mean()
        if best is None or loss < best[0]:
            best = loss, float(t), p
    model.temperature, p = best[1], best[2]
    right = p.max(axis=1)[p.argmax(axis=1) == target[kept]]
    model.threshold = float(np.quantile(right, reject_rate)) if len(right) else 0.0
    return model


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 4000, max_chars: int = 20_000, held_out: int = 2, **options) -> LanguageModel | None:
    """Learns from the documents outside fold ``held_out``, at most ``rows`` of them."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        (fold_of(F.col("id")) != held_out) & F.col("lang").isNotNull() & (F.length("text").between(1, max_chars))
    )
    found = sorted(bounded_sample(known, rows).select("text", "lang", "__h").dropDuplicates(["__h"]).collect(), key=lambda r: r["__h"])
    return train([r["text"] for r in found], [r["lang"] for r in found], **options)


def language(docs: DataFrame, text: Column, model: LanguageModel | None) -> Column:
    """text -> struct<lang, score, rejected>."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)  # buckets x languages

    def run(texts: pa.Array) -> pa.Array:
        model, n = shared.value, len(texts)
        texts = texts.cast(pa.binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        known = np.zeros(n, bool)
        if model is not None:
            letter = np.zeros(256, np.int64)
            letter[65:91] = letter[97:123] = 1
            for i in range(n):
                raw = data[offsets[i] : offsets[i + 1]]
                known[i] = letter[raw[:64]].any() or letter[raw].any() or _has_letter(raw.tobytes())
        if not known.any():
            lang, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        else:
            p = model.scores(data, offsets)
            score = np.where(known, np.round(p.max(axis=1), 6), 0.0)
            best = p.argmax(axis=1)
            lang = [model.labels[best[i]] if known[i] else UNKNOWN for i in range(n)]
            rejected = ~known | (score < round(model.threshold, 6))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["lang", "score", "rejected"])

    return F.arrow_udf(run, "lang string, score double, rejected boolean").asNondeterministic()(text)
