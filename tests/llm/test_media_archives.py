import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import gif, queries, warc
from oracle import check


def plain_lzw(stream, smallest, most):
    """The textbook decoder, code by code."""
    bits = "".join(f"{b:08b}"[::-1] for b in stream)
    clear, end, at, out, width = 1 << smallest, (1 << smallest) + 1, 0, b"", smallest + 1
    table, last = [bytes([i]) for i in range(clear)] + [b"", b""], None
    while at + width <= len(bits) and len(out) < most:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, last, width = table[: clear + 2], None, smallest + 1
            continue
        if code == end:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        out += entry
        last = entry
    return out[:most]


@pytest.mark.parametrize("size", [0, 1, 2, 3, 300, 5000, 40000])
def test_lzw(size):
    r = random.Random(size)
    for alphabet in (2, 5, 256):
        data = bytes(r.randrange(alphabet) for _ in range(size))
        stream = gif.lzw_encode(data)
        assert gif.lzw_decode(stream, 8, size) == data == plain_lzw(stream, 8, size)
    small = bytes(r.randrange(4) for _ in range(size))
    assert gif.lzw_decode(gif.lzw_encode(small, 2), 2, size) == small


def picture(frames, size=(2, 2), colours=((255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9))):
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x81, 0, 0), bytes(v for c in colours for v in c)]
    for (x, y, w, h), samples, disposal, clear in frames:
        out.append(b"!\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), 7, clear or 0, 0))
        out.append(struct.pack("<cHHHHBB", b",", x, y, w, h, 0, 2) + gif._blocks(gif.lzw_encode(bytes(samples), 2)))
    return b"".join([*out, b";"])


def test_disposal_and_transparency():
    f = list(gif.read_gif(picture([((0, 0, 2, 2), [0, 0, 0, 0], 1, None), ((1, 1, 1, 1), [1], 2, None), ((0, 0, 1, 2), [3, 2], 3, 3), ((0, 1, 1, 1), [1], 0, None)])))
    red, green, blue, nothing = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert f[1].canvas.tolist() == [[red, red], [red, green]]
    assert f[2].canvas.tolist() == [[red, red], [blue, nothing]]  # the second was cleared; index 3 is transparent
    assert f[3].canvas.tolist() == [[red, red], [green, nothing]]  # the third was restored
    assert [x.delay_ms for x in f] == [70] * 4 and f[2].histogram.sum() == 1


def test_interlace_and_broken():
    data = bytearray(picture([((0, 0, 1, 4), [0, 1, 2, 3], 0, None)], (1, 4)))
    at = data.index(b",") + 9
    data[at] |= 0x40
    assert next(gif.read_gif(bytes(data))).samples == bytes([0, 2, 1, 3])
    assert len(list(gif.read_gif(picture([((0, 0, 2, 2), [0, 1, 2, 3], 0, None)])[:-6]))) == 1
    with pytest.raises(ValueError):
        list(gif.read_gif(b"no"))


def test_columns(spark):
    df = spark.createDataFrame([(1, b"\x01" * 96 * 200), (2, None), (3, bytes(range(96)))], "k int, p binary").withColumn("media", F.lit(1))
    stored = gif.as_gif(df, "k", "p")
    rows = {r["id"]: r for r in gif.decode_gif(stored, "id", "media").collect()}
    assert bytes(rows[1]["samples"]) == b"\x01" * 96 * 200 and [f["height"] for f in rows[1]["frames"]] == [96, 96, 8]
    assert bytes(rows[3]["samples"]) == bytes(range(96)) and bytes(rows[2]["samples"]) == b""
    assert sum(rows[1]["histogram"]) == 96 * 200
    bad = spark.createDataFrame([(1, b"x"), (2, None)], "k int, m binary")
    assert [r["frames"] for r in gif.decode_gif(bad, "k", "m").collect()] == [None, None]
    assert gif.as_gif(df.where("false"), "k", "p").count() == 0


def test_query_digests(spark, data):
    import zlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op3_gif_media(spark, data).collect():
        raw = texts[r["doc_id"]].encode()
        padded = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r["media_sha256"] == hashlib.sha256(gif.write_gif(padded)).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_archives(n):
    r = random.Random(n)
    records = [f"record {i} ".encode() * r.randrange(1, 300) for i in range(n)]
    archive = warc.archive_of(records)
    assert list(warc.records_of(archive)) == records
    if n == 40:
        assert archive[:4] == struct.pack("<I", 0x184D2A5D)
        with pytest.raises(ValueError):
            list(warc.records_of(archive[:-3]))


def test_round_trip(spark):
    long = "y" * 1000
    rows = [(1, "http://a/\nb", long), (5, "u", long), (3, None, long), (4, "u", None), (6, "u", "short"), (7, "u", "short"), (None, "u", long), (5, "again", long), (8, "u", "é" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    back = warc.read_archives(warc.archive_pages(spark, pages)).collect()
    assert len(back) == len(rows)
    found = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back)
    assert found == [(0, "revisit", 5, 1000), (1, "revisit", 5, 1000), (3, "revisit", 5, 1000), (4, "response", None, 0), (5, "response", None, 1000), (5, "response", None, 1000), (6, "response", None, 5), (7, "response", None, 5), (8, "response", None, 1000)]
    assert all(r["payload_digest"] == hashlib.sha1(long.encode()).hexdigest() for r in back if r["page_id"] in (1, 5))
    assert warc.read_archives(warc.archive_pages(spark, pages.where("false"))).count() == 0
    # more repeated digests than may be broadcast, and ids that are strings
    salted = warc.read_archives(warc.archive_pages(spark, pages, broadcast_digests=0)).collect()
    assert sorted(map(str, salted)) == sorted(map(str, back))
    named = pages.withColumn("page_id", F.concat(F.lit('"\r\n'), F.col("page_id").cast("string")))
    told = warc.read_archives(warc.archive_pages(spark, named), "string").collect()
    assert sorted((r["page_id"] or "", r["refers_to"] or "") for r in told) == sorted((f'"\r\n{r["page_id"]}' if r["page_id"] else "", f'"\r\n{r["refers_to"]}' if r["refers_to"] else "") for r in back)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, data, name):
    check(spark, data, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_histogram_bins_cover_all():
    f = next(gif.read_gif(gif.write_gif(bytes(range(192)))))
    assert f.histogram.sum() == 192 and isinstance(f.canvas, np.ndarray)
