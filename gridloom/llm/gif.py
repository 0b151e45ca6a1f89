"""GIF columns: write samples as animated GIF, decode GIF into timed frames with colour histograms.

The decoder reads the LZW code streams, applies global and local palettes, interlacing, transparency and the disposal
rules (leave, clear, restore), and gives for each frame its delay, rectangle, the composed RGBA canvas and a histogram
of its visible colours. ``samples`` are the palette indexes of all frames in order, which is what the writer was given.

The writer stores a payload as 8-bit samples, 96 in a line and up to 96 lines in a frame, under a palette of 256 colours.

Defined results: null bytes are written as the empty payload; a payload that isn't a whole number of lines is refused,
as the caller pads it; media that is null or no GIF decodes to null, and a cut-off code stream leaves the rest of its
frame at index 0. Rows are independent, so repeats are alike; an empty table gives an empty table. The results carry
the id and the documented columns only, so names of other columns cannot clash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches

WIDTH, LINES = 96, 96
FULL = 4096
#: Red, green and blue each cut into four: 64 colour bins.
BINS = 64
OPAQUE = np.full((256, 4), 255, np.uint8)
PALETTE = np.stack([np.arange(256), np.arange(256) * 7 % 256, np.arange(256) * 31 % 256], axis=1).astype(np.uint8)


@lru_cache(maxsize=16)
def _code_bits(smallest: int) -> tuple[np.ndarray, np.ndarray]:
    """Width and first bit of each code after a clear code; codes widen as the table fills."""
    first = (1 << smallest) + 2
    held = first + np.maximum(np.arange(FULL + 1) - 1, 0)  # table size as the reader sees it before each code
    width = np.minimum(np.maximum(smallest + 1, np.floor(np.log2(np.maximum(held, 1))).astype(np.int64) + 1), 12)
    return width, np.concatenate(([0], np.cumsum(width)))


#: Code of each (code, sample); all 0 between two calls. A task's Python has one thread.
_children = [0] * (FULL << 8)


def lzw_encode(data: bytes, smallest: int = 8) -> bytes:
    """Code stream of ``data``: begins with a clear code, clears again when the table is full, ends with the end code."""
    clear, end = 1 << smallest, (1 << smallest) + 1
    widths, starts = _code_bits(smallest)
    parts, runs = [np.array([clear])], [np.array([smallest + 1])]
    table, keys = _children, []  # each code given and the sample after it, since the last clear
    note = keys.append
    size = end + 1
    samples = iter(data)
    prefix = next(samples, -1)
    for byte in samples:
        key = prefix << 8 | byte
        if code := table[key]:
            prefix = code
            continue
        note(key)
        prefix = byte
        if size < FULL:
            table[key] = size
            size += 1
        else:
            parts += [np.array(keys) >> 8, np.array([clear])]
            runs.append(widths[: len(keys) + 1])
            for key in keys:
                table[key] = 0
            keys.clear()
            size = end + 1
    for key in keys:
        table[key] = 0
    last = [prefix, end] if prefix >= 0 else [end]
    parts += [np.array(keys, np.int64) >> 8, np.array(last)]
    runs.append(widths[: len(keys) + len(last)])
    value, width = np.concatenate(parts), np.concatenate(runs)
    return _pack(value, width)


def _pack(value: np.ndarray, width: np.ndarray) -> bytes:
    first = np.cumsum(width) - width
    total = int(width.sum())
    out = np.zeros(total // 8 + 4, np.uint8)
    shifted = value << (first & 7)
    for k in range(3):
        np.bitwise_or.at(out, (first >> 3) + k, ((shifted >> (8 * k)) & 255).astype(np.uint8))
    return out[: -(-total // 8)].tobytes()


def lzw_decode(stream: bytes, smallest: int, most: int) -> bytes:
    """The samples of a code stream, ``most`` at the most."""
    clear, end = 1 << smallest, (1 << smallest) + 1
    widths, starts = _code_bits(smallest)
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    bits, at, made = len(stream) * 8, 0, 0
    out: list[bytes] = []
    while at + smallest < bits and made < most:
        first = at + starts[:-1]
        beyond = max(0, (bits - at - int(starts[-1])) // 12)  # codes of a full table that isn't cleared
        width = widths
        if beyond:
            beyond = min(beyond, most - made)
            first = np.concatenate([first, at + starts[-1] + 12 * np.arange(beyond)])
            width = np.concatenate([widths, np.full(beyond, 12)])
        n = int(np.searchsorted(first + width, bits, "right"))
        codes = _unpack(raw, first[:n], width[:n])
        stop = np.nonzero((codes == clear) | (codes == end))[0]
        used = int(stop[0]) if len(stop) else n
        own, sound = _expand(codes[:used], end + 1)
        out.append(own)
        made += len(own)
        if not sound or not len(stop) or codes[used] == end:
            break
        at = int(first[used] + width[used])
    return b"".join(out)[:most]


def _unpack(raw: np.ndarray, first: np.ndarray, width: np.ndarray) -> np.ndarray:
    byte = first >> 3
    return ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (first & 7)) & ((1 << width) - 1)


def _expand(codes: np.ndarray, free: int) -> tuple[bytes, bool]:
    """The samples of the codes between two clears; false if it stops at a code that the table can't have.

    Entry k of the table is what code k gave and the sample after it, so it lies in the output itself: every sample of a
    code is a copy of an earlier sample. Lengths, then copies, are resolved by doubling pointers."""
    step = np.arange(len(codes))
    entry = codes - free
    wrong = np.nonzero((entry >= step) | ((entry < 0) & (codes >= free - 2)))[0]
    sound = not len(wrong)
    if not sound:
        codes, entry, step = codes[: wrong[0]], entry[: wrong[0]], step[: wrong[0]]
    if not len(codes):
        return b"", sound
    literal = entry < 0
    parent = np.where(literal, step, entry)
    length = (~literal).astype(np.int64)
    while True:
        above = parent[parent]
        if (above == parent).all():
            length += length[parent]
            break
        length += length[parent]
        parent = above
    length += 1
    start = np.cumsum(length) - length
    of = np.repeat(step, length)
    source = np.arange(len(of))
    source += np.where(literal, 0, start[np.where(literal, 0, entry)] - start)[of]
    while True:
        further = source[source]
        if (further == source).all():
            return codes[of[source]].astype(np.uint8).tobytes(), sound
        source = further


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def write_gif(payload: bytes, delay_ms: int = 100) -> bytes:
    """An animated GIF whose frames hold ``payload`` line by line."""
    lines, rest = divmod(len(payload), WIDTH)
    if rest:
        raise ValueError(f"the payload must be a multiple of {WIDTH} bytes")
    height = max(1, min(LINES, lines))
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), PALETTE.tobytes(), b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for at in range(0, lines, LINES):
        own = payload[at * WIDTH : (at + LINES) * WIDTH]
        out.append(b"!\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay_ms // 10, 0, 0))
        out.append(struct.pack("<cHHHHBB", b",", 0, 0, WIDTH, len(own) // WIDTH, 0, 8))
        out.append(_blocks(lzw_encode(own)))
    return b"".join([*out, b";"])


@dataclass
class Frame:
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    samples: bytes
    canvas: np.ndarray  # RGBA, composed
    histogram: np.ndarray


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    colours = np.zeros((256, 3), np.uint8)
    found = np.frombuffer(data[at : at + 3 * n], np.uint8)
    colours[: len(found) // 3] = found[: len(found) // 3 * 3].reshape(-1, 3)
    return colours, at + 3 * n


def _unblock(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def read_gif(data: bytes) -> Iterator[Frame]:
    """Frames in order. Raises ValueError for what is no GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, colours = 13, None
    if flags & 0x80:
        colours, at = _palette(data, at, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, -1
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1] if at + 1 < len(data) else 0
            body, at = _unblock(data, at + 2)
            if kind == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, 10 * (body[1] | body[2] << 8)
                clear_index = body[3] if body[0] & 1 else -1
            continue
        if data[at] != 0x2C or at + 11 > len(data):
            break
        left, top, w, h, own = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        local = colours
        if own & 0x80:
            local, at = _palette(data, at, own)
        stream, end = _unblock(data, at + 1)
        samples = lzw_decode(stream, min(max(data[at], 1), 11), w * h) if at < len(data) else b""
        at = end
        index = np.zeros(w * h, np.uint8)
        index[: len(samples)] = np.frombuffer(samples, np.uint8)
        index = index.reshape(h, w)
        if own & 0x40:
            order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, step)]
            turned = np.empty_like(index)
            turned[order] = index
            index = turned
        before = canvas.copy() if disposal == 3 else None
        y, x = min(top + h, height), min(left + w, width)
        shown = index[: max(0, y - top), : max(0, x - left)]
        visible = shown != clear_index
        colour = OPAQUE.copy()
        colour[:, :3] = PALETTE if local is None else local
        if clear_index < 0:
            canvas[top:y, left:x] = colour[shown]
        else:
            canvas[top:y, left:x][visible] = colour[shown[visible]]
        bins = colour[:, 0].astype(np.int64) >> 6 << 4 | colour[:, 1] >> 6 << 2 | colour[:, 2] >> 6
        histogram = np.bincount(bins, np.bincount(shown[visible].ravel(), minlength=256), BINS).astype(np.int64)
        yield Frame(delay, left, top, w, h, disposal, index.tobytes(), canvas.copy(), histogram)
        if disposal == 2:
            canvas[top:y, left:x] = 0
        elif before is not None:
            canvas = before
        delay, disposal, clear_index = 0, 0, -1


FRAME = pa.struct([
    ("delay_ms", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()),
    ("disposal", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int32())),
])
FRAME_SQL = "delay_ms int, left int, top int, width int, height int, disposal int, rgba binary, histogram array<int>"
#: Bytes of media or payload turned into one output batch.
BATCH = 1 << 20


def _batches(batches, make, names):
    """Rows of ``make(id, bytes)`` in batches of bounded size."""
    for batch in batches:
        raw = batch.column(1)
        ids, size, first = batch.column(0), 0, 0
        rows: list[tuple] = []
        for i in range(batch.num_rows):
            value = raw[i].as_py()
            rows.append(make(value))
            size += len(value or b"")
            if size >= BATCH or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(rows)), *(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(names))], ["id", *(n for n, _ in names)])
                rows, size, first = [], 0, i + 1


def as_gif(rows: DataFrame, id_col: str, payload_col: str, delay_ms: int = 100) -> DataFrame:
    """(id, media): each payload as a GIF."""
    source = small_batches(rows).select(F.col(id_col).alias("id"), F.col(payload_col).alias("payload"))

    def run(batches):
        yield from _batches(batches, lambda x: (write_gif(x or b"", delay_ms),), [("media", pa.binary())])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, media binary")


def _decoded(media: bytes | None) -> tuple:
    try:
        frames = list(read_gif(media or b""))
    except ValueError:
        return None, None, None
    total = sum((f.histogram for f in frames), np.zeros(BINS, np.int64))
    told = [
        {"delay_ms": f.delay_ms, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "disposal": f.disposal, "rgba": f.canvas.tobytes(), "histogram": f.histogram}
        for f in frames
    ]
    return told, total, b"".join(f.samples for f in frames)


def decode_gif(rows: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, media, frames, histogram, samples) of stored GIFs."""
    source = small_batches(rows).select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kinds = [("media", pa.binary()), ("frames", pa.list_(FRAME)), ("histogram", pa.list_(pa.int32())), ("samples", pa.binary())]

    def run(batches):
        yield from _batches(batches, lambda x: (x, *_decoded(x)), kinds)

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, media binary, frames array<struct<{FRAME_SQL.replace(' ', ':').replace(',:', ',')}>>, histogram array<int>, samples binary")
