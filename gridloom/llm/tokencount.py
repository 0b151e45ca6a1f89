"""Token counts by offset-mapped attribution.

A whole document is encoded once. Token lengths in bytes give byte spans, and those give character spans (a token that
holds part of a character spans it). The spans are interval-joined to the document's sections, which lie end to end, by
binary search of both ends. A token within a section counts there; one that crosses a boundary is allocated by ``rule``:

* ``majority``: to the section with most of its characters, the earlier one on ties (the default);
* ``first`` or ``last``: to the section of its first or last character;
* ``split``: to each in proportion to its characters.

So counts add up to the tokens of the whole, which sums of separately encoded sections don't.

Defined results: null text counts as empty; an empty text has one empty section without tokens; an empty section gets
none. Fields that are null are empty sections. Rows are independent, so repeats are alike; an empty table gives an empty
table. Results are added in one array column, so names of other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import BATCH_BYTES

RULES = ("majority", "first", "last", "split")
RESULT = "array<struct<section:int,char_start:bigint,char_end:bigint,n_tokens:double,n_crossing:bigint>>"
ARROW = pa.list_(pa.struct([("section", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64())]))


#: The encoder in use and its token lengths, by digest and pattern; one at a time.
_encoders: dict[tuple, tuple] = {}


def _encoder(digest: str, data, pattern: str):
    if (digest, pattern) not in _encoders:
        _encoders.clear()
        _encoders[digest, pattern] = _built(data.value, pattern)
    return _encoders[digest, pattern]


def _built(data: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, lengths


def token_spans(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of consecutive tokens of the given lengths in bytes."""
    ends = np.cumsum(lengths)
    characters = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return characters[ends - lengths] - 1, characters[ends - 1]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and boundary-crossing tokens that touch it; section k spans bounds[k] to bounds[k + 1]."""
    sections = len(bounds) - 1
    low = np.searchsorted(bounds, starts, "right") - 1
    high = np.searchsorted(bounds, ends - 1, "right") - 1
    crosses = low != high
    tokens = np.bincount(low[~crosses], minlength=sections).astype(float)
    touched = np.zeros(sections, np.int64)
    for i in np.nonzero(crosses)[0]:
        own = np.arange(low[i], high[i] + 1)
        shared = np.minimum(bounds[own + 1], ends[i]) - np.maximum(bounds[own], starts[i])
        touched[own[shared > 0]] += 1
        if rule == "split":
            tokens[own] += shared / shared.sum()
        else:
            tokens[own[{"majority": int(shared.argmax()), "first": 0, "last": -1}[rule]]] += 1
    return tokens, touched


class TokenCounter:
    """Column functions for one vocabulary of ranks; ``path`` is read once, on the driver."""

    def __init__(self, spark: SparkSession, path: str, pattern: str, rule: str = "majority"):
        if rule not in RULES:
            raise ValueError(f"rule must be one of {RULES}")
        with open(path, "rb") as f:
            data = f.read()
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        self._parts = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data), pattern  # under a megabyte
        self.rule = rule

    def _count(self, pairs) -> pa.Array:
        encode, lengths = _encoder(*self._parts)
        out = []
        for text, bounds in pairs:
            raw = text.encode()
            starts, ends = token_spans(raw, lengths[encode(text)]) if raw else (np.zeros(0, np.int64),) * 2
            tokens, touched = attribute(starts, ends, bounds, self.rule)
            out.append([
                {"section": k, "char_start": a, "char_end": b, "n_tokens": t, "n_crossing": c}
                for k, (a, b, t, c) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), tokens.tolist(), touched.tolist()))
            ])
        return pa.array(out, ARROW)

    def by_section(self, text: Column, separator: str = "\n") -> Column:
        """Counts of each piece that ``separator`` ends; the separator belongs to the piece before it."""
        me, width = self, len(separator)

        def run(texts: pa.Array) -> pa.Array:
            def pairs():
                for text in texts.to_pylist():
                    parts = (text or "").split(separator)
                    sizes = [len(x) + width for x in parts]
                    sizes[-1] -= width
                    yield text or "", np.concatenate(([0], np.cumsum(sizes)))

            return me._count(pairs())

        return F.arrow_udf(run, RESULT)(text)

    def by_field(self, *fields: Column, joiner: str = "\n") -> Column:
        """Counts of each field of a document made of fields; the joiner belongs to the field before it."""
        me, width = self, len(joiner)

        def run(*columns: pa.Array) -> pa.Array:
            def pairs():
                for row in zip(*(c.to_pylist() for c in columns)):
                    parts = [x or "" for x in row]
                    sizes = [len(x) + width for x in parts]
                    sizes[-1] -= width
                    yield joiner.join(parts), np.concatenate(([0], np.cumsum(sizes)))

            return me._count(pairs())

        return F.arrow_udf(run, RESULT)(*(f.cast("string") for f in fields))
