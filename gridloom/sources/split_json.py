"""Features of large GeoJSON files, read by several tasks a file.

A file is cut into byte ranges. Whether a range begins inside a string, and how deep in brackets, follows from the ranges
before: each range tells where it ends for either way it may begin, in one pass over all of them at once, and the driver
follows these answers from range to range (some numbers a range). Then every range hands on the features that begin in it,
reading over its end for the last one. So a feature comes once, whatever the size of ranges, and brackets or quotes in texts
mislead nothing.

Tasks read the files with ``pyarrow.fs``, so paths must be of a file system that it knows (local, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.session import saved

#: A text, the quote of one that doesn't end, or a bracket.
TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|["\[\]{}]', re.S)
TEXT_REST = re.compile(rb'(?:[^"\\]|\\.)*"', re.S)
#: How a range may begin: outside texts, in one, or in one just after a backslash.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
#: Depth at which features lie: in the collection's object and its list.
ELEMENTS = 2


def passes(raw: bytes, state: int) -> tuple[int, int]:
    """(state at the end, brackets opened less closed) of bytes that begin in ``state``."""
    at = 1 if state == ESCAPED else 0
    if state != OUTSIDE and raw:
        rest = TEXT_REST.match(raw, at)
        if rest is None:
            return _open_text(raw, at), 0
        at = rest.end()
    depth = 0
    for m in TOKEN.finditer(raw, at):
        if m.group() == b'"':
            return _open_text(raw, m.end()), depth
        kind = raw[m.start()]
        depth += (kind in b"[{") - (kind in b"]}")
    return OUTSIDE, depth


def _open_text(raw: bytes, at: int) -> int:
    """State at the end of a text that doesn't end."""
    slashes = len(raw) - max(at, len(raw.rstrip(b"\\"))) if len(raw) > at else 0
    return ESCAPED if slashes % 2 else INSIDE


def elements(read, size: int, start: int, end: int, state: int, depth: int, step: int = 1 << 20) -> Iterator[bytes]:
    """The objects at depth ``ELEMENTS`` that begin in [start, end). ``read(offset, length)`` gives bytes of the file."""
    raw, base = read(start, end - start), start
    at = 1 if state == ESCAPED else 0
    begun = -1  # where the object at hand begins in raw
    in_text = state != OUTSIDE
    while True:
        m = TEXT_REST.match(raw, at) if in_text else TOKEN.search(raw, at)
        if m is None or m.group() == b'"' and not in_text:
            # the rest holds no whole token: read on if an object is open
            if begun < 0 or base + len(raw) >= size:
                if begun >= 0:
                    raise ValueError("a feature has no end")
                return
            keep = begun
            raw, base, at, begun = raw[keep:] + read(base + len(raw), step), base + keep, at - keep, 0
            continue
        if in_text:
            in_text, at = False, m.end()
            continue
        kind, at = raw[m.start()], m.end()
        if kind in b"[{":
            if depth == ELEMENTS and kind in b"{":
                if base + m.start() >= end:
                    return
                begun = m.start()
            depth += 1
        elif kind in b"]}":
            depth -= 1
            if depth == ELEMENTS and begun >= 0:
                yield raw[begun:at]
                begun = -1
                raw, base, at = raw[at:], base + at, 0
                if base >= end:
                    return


def _opened(path: str):
    where, name = fs.FileSystem.from_uri(path)
    file = where.open_input_file(name)
    return file, lambda offset, length: file.read_at(length, offset)


def split_features(spark: SparkSession, path: str, range_bytes: int = 32 << 20) -> DataFrame:
    """(file, position, feature): the JSON text of each feature of FeatureCollections, numbered from 0 in each file. Files are
    uncompressed. Objects of other lists than the features are left out by their ``type``."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # a row a file
    rows = [(k, r["path"], r["length"], a, min(a + range_bytes, r["length"])) for k, r in enumerate(files) for a in range(0, r["length"], range_bytes)]
    schema = "file int, path string, size bigint, start bigint, end bigint"
    ranges = spark.createDataFrame(rows, schema).repartition(max(1, len(rows)), "file", "start")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                file, read = _opened(r["path"])
                with file:
                    raw = read(r["start"], r["end"] - r["start"])
                out += [(r["file"], r["start"], s, *passes(raw, s)) for s in (OUTSIDE, INSIDE, ESCAPED)]
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "start", "state", "after", "depth"), o)) for o in out], pa.schema([("file", pa.int32()), ("start", pa.int64()), ("state", pa.int32()), ("after", pa.int32()), ("depth", pa.int64())]))

    answers = {(r["file"], r["start"], r["state"]): (r["after"], r["depth"]) for r in ranges.mapInArrow(told, "file int, start bigint, state int, after int, depth bigint").collect()}  # three rows a range
    begun, now = [], {}
    for file, name, size, start, end in rows:
        state, depth = now.get(file, (OUTSIDE, 0))
        begun.append((file, name, size, start, end, state, depth))
        after, more = answers[file, start, state]
        now[file] = (after, depth + more)

    def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                file, read = _opened(r["path"])
                with file:
                    held, size, n = [], 0, 0
                    for raw in elements(read, r["size"], r["start"], r["end"], r["state"], r["depth"]):
                        if json.loads(raw).get("type") != "Feature":
                            continue
                        held.append((n, raw.decode()))
                        n, size = n + 1, size + len(raw)
                        if size > 4 << 20:
                            yield _batch(r, held)
                            held, size = [], 0
                    yield _batch(r, held)

    parts = spark.createDataFrame(begun, schema + ", state int, depth bigint").repartition(max(1, len(begun)), "file", "start")
    found = saved(parts.mapInArrow(read_ranges, "path string, start bigint, nth bigint, feature string"), "features")
    counts = sorted((r["path"], r["start"], r["n"]) for r in found.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a range
    before, offsets = {}, []
    for name, start, n in counts:
        offsets.append((name, start, before.get(name, 0)))
        before[name] = before.get(name, 0) + n
    first = spark.createDataFrame(offsets, "path string, start bigint, first bigint")
    return found.join(F.broadcast(first), ["path", "start"]).select(F.col("path").alias("file"), (F.col("first") + F.col("nth")).cast("int").alias("position"), "feature")


def _batch(r: dict, held: list[tuple[int, str]]) -> pa.RecordBatch:
    n = len(held)
    return pa.RecordBatch.from_arrays([pa.array([r["path"]] * n, pa.string()), pa.array([r["start"]] * n, pa.int64()), pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.string())], ["path", "start", "nth", "feature"])
