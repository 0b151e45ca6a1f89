"""SentencePiece encoding and decoding by a merge-type prefix table.

For every prefix of a word the table holds the one token that ends the prefix's encoding. An automaton reports the
pieces that end at a position; of these, exactly one is compatible with the last token of the prefix before it.
Two tokens are compatible if merging their joined characters gives the same two tokens again; a sequence is the
encoding of its text just when all its neighbours are compatible. Ids are recovered from the table backwards.
Time is linear in the text, however long a word is.

Defined results: null text encodes as no ids and decodes to the empty string, as the empty text does; a character
without a piece becomes its UTF-8 byte pieces; control pieces written in a text are ordinary characters. Rows are
independent, so ties, repeats and extra columns have no effect; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import BATCH_BYTES

SPACE = "▁"
NORMAL, CONTROL, USER, UNUSED, BYTE = 1, 3, 4, 5, 6
#: Words kept with their ids in each worker, in each of two generations; a word in use moves to the younger one.
WORDS_KEPT = 250_000
PAIRS_KEPT = 500_000


def _one_by_one(error):
    return "�", error.start + 1


codecs.register_error("gridloom-each-byte", _one_by_one)


class PieceTable:
    """Encoder and decoder of one merge-type model without normalisation rules of its own."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("a merge-type model with byte fallback is needed")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("the model normalises text; only identity normalisation is supported")
        if any(p.type in (USER, UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.text = [p.piece for p in proto.pieces]
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.as_bytes = [
            bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE
            else b"" if p.type == CONTROL
            else " ⁇ ".encode() if p.type == 2
            else p.piece.replace(SPACE, " ").encode()
            for p in proto.pieces
        ]
        self.size = len(self.text)
        self.pairs: dict[int, bool] = {}
        self.words = _Words(self)
        if not all(set(x) == {SPACE} for x in self.ids if SPACE in x[1:]):
            raise ValueError("a piece goes over a word border")
        breaks = "" if any("\n" in x for x in self.ids) else "\n"
        self.segments = re.compile(f"{breaks or '(?!)'}|{SPACE}+[^{SPACE}{breaks}]*|[^{SPACE}{breaks}]+").findall
        self.automaton = self._automaton()

    def _automaton(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or self.merged(piece) == [piece]:  # others are never the outcome of merging
                automaton.add_word(piece, (i, len(piece)))
        automaton.make_automaton()
        return automaton

    def merged(self, text: str) -> list[str]:
        """The merging procedure itself, for texts of a few pieces: best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self.pairs.get(key)
        if known is None:
            a, b = self.text[left], self.text[right]
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(a + b) == [a, b]
        return known

    def word_ids(self, word: str) -> list[int]:
        """Ids of one segment by the prefix table."""
        size, pairs, width = len(word), self.pairs, self.size
        last, lengths = [-1] * size, [1] * size
        for end, (token, length) in self.automaton.iter(word):
            if last[end] >= 0:
                continue
            before = end - length
            if before >= 0 and (left := last[before]) >= 0:
                fits = pairs.get(left * width + token)
                if not (self.compatible(left, token) if fits is None else fits):
                    continue
            last[end], lengths[end] = token, length
        out, at = [], size - 1
        while at >= 0:
            token = last[at]
            if token >= 0:
                out.append(token)
            else:  # no piece has this character
                out.extend(self.byte_ids[x] for x in reversed(word[at].encode()))
            at -= lengths[at]
        return out[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        found = self.segments(self.prefix + text.replace(" ", SPACE))
        return np.frombuffer(b"".join(map(self.words.__getitem__, found)), np.int32)

    def decode(self, ids) -> str:
        raw = b"".join(map(self.as_bytes.__getitem__, ids))
        if self.prefix and len(ids) and self.text[ids[0]].startswith(SPACE):
            raw = raw[1:]
        return raw.decode("utf-8", "gridloom-each-byte")


class _Words(dict):
    """Segment -> ids as int32 bytes."""

    def __init__(self, table: PieceTable):
        super().__init__()
        self.table, self.older = table, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("i", self.table.word_ids(word)).tobytes()
        if len(word) <= 64:
            if len(self) >= WORDS_KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


#: The model in use, by its digest; one at a time.
_tables: dict[str, PieceTable] = {}


def _table(digest: str, model) -> PieceTable:
    if digest not in _tables:
        _tables.clear()
        _tables[digest] = PieceTable(model.value)
    return _tables[digest]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


class PieceCodec:
    """Column functions for one model; ``model_path`` is read once, on the driver."""

    def __init__(self, spark: SparkSession, model_path: str):
        with open(model_path, "rb") as f:
            model = f.read()
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        self._key = hashlib.sha256(model).hexdigest()
        self._model = spark.sparkContext.broadcast(model)  # half a megabyte, whatever the data

    def encode(self, text: Column) -> Column:
        """text -> array<int> of ids."""
        key, model = self._key, self._model

        def run(texts: pa.Array) -> pa.Array:
            table = _table(key, model)
            return _lists([table.encode(x) for x in texts.to_pylist()])

        return F.arrow_udf(run, "array<int>")(text)

    def decode(self, ids: Column) -> Column:
        """array<int> -> text; null ids decode to the empty string."""
        key, model = self._key, self._model

        def run(lists: pa.Array) -> pa.Array:
            table = _table(key, model)
            return pa.array([table.decode(x or []) for x in lists.to_pylist()], pa.string())

        return F.arrow_udf(run, "string")(ids)

    def round_trip(self, text: Column) -> Column:
        """text -> struct<ids, decoded>: both directions in one pass, ``decoded`` made from the ids alone."""
        key, model = self._key, self._model

        def run(texts: pa.Array) -> pa.Array:
            table = _table(key, model)
            ids = [table.encode(x) for x in texts.to_pylist()]
            decoded = pa.array([table.decode(x) for x in ids], pa.string())
            return pa.StructArray.from_arrays([_lists(ids), decoded], ["ids", "decoded"])

        return F.arrow_udf(run, "ids array<int>, decoded string")(text)
