"""WARC archives of individually compressed records under an embedded Zstandard dictionary.

Each archive is one file: a skippable frame (magic 0x184D2A5D) with a dictionary built from the archive's own records,
then one Zstandard frame a record. Payloads of at least ``revisit_from`` bytes that are equal become one response, of
the row with the largest page id, and revisits of it. Tasks write below the shared folder under names of their own
attempt and return what they wrote; readers open the files that the finished tasks returned, so a repeated or killed
attempt leaves files that nobody reads.

Which payloads repeat is found on digests and lengths alone. Payloads are written where they were read: the table of
repeated digests goes to them if it is small, and only a large one makes rows move, by digest and a salt, so that copies
of one payload spread over tasks.

Defined results: null html is the empty payload; null ids are less than all others, and several rows with the largest id
are all responses, as a record doesn't revisit itself; line breaks in a url are percent-encoded. Ids may be whole numbers
or strings. Archives are cut at ``archive_bytes`` of records, so a task holds one archive; a longer record is an archive of
its own. If too few records come together to train a dictionary, their own bytes serve as one. An empty table writes no
archive. Columns other than those named are not read, so names cannot clash. Archives are the result: they stay in the
shared folder until the caller removes them.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.session import saved, scratch_path
from gridloom.llm.common import small_batches

SKIPPABLE = 0x184D2A5D
#: Records that a dictionary is trained on: spread evenly over the archive.
TRAINING_BYTES = 2 << 20
#: A dictionary has at most so many bytes, and at most an eighth of its archive's.
DICTIONARY_BYTES = 32 << 10
#: Repeated digests up to which their table is broadcast (under 100 bytes each).
BROADCAST_DIGESTS = 100_000
SALTS = 16
#: Bytes of archives that a task reads, one archive after the other, once all cores have some.
READ_BYTES = 64 << 20


def record_kinds(pages: DataFrame, revisit_from: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to)."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = rows.where(F.octet_length("payload") >= revisit_from).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    first = saved(first.select("digest", "first_id"), "warc-repeated")
    if first.limit(broadcast_digests + 1).count() <= broadcast_digests:
        joined = rows.join(F.broadcast(first), "digest", "left")
    else:
        spread = first.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(spread, ["digest", "__salt"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "payload", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page:{page_id}'.encode()).digest())}>"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"Page-Id: {json.dumps(page_id)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}", f"Refers-To-Page: {json.dumps(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]):
    """A dictionary trained on at most ``TRAINING_BYTES`` of whole records; their bytes as they are if training fails."""
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // TRAINING_BYTES))
    chosen, size = records[::step], max(256, min(DICTIONARY_BYTES, total // 8))
    try:
        return zstandard.train_dictionary(size, chosen, k=256, d=8, level=3)
    except zstandard.ZstdError:
        raw = b"".join(chosen)[:size]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


def archive_of(records: list[bytes], level: int = 3) -> bytes:
    import zstandard

    known = build_dictionary(records)
    frames = []
    if known is not None:
        content = known.as_bytes()
        frames.append(struct.pack("<II", SKIPPABLE, len(content)) + content)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
    frames.extend(map(compressor.compress, records))
    return b"".join(frames)


def records_of(archive: bytes):
    """The records of an archive, one frame at a time."""
    import zstandard

    at, known = 0, None
    if archive[:4] == struct.pack("<I", SKIPPABLE):
        size = struct.unpack("<I", archive[4:8])[0]
        content, at = archive[8 : 8 + size], 8 + size
        trained = content[:4] == b"\x37\xa4\x30\xec"
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    reader = zstandard.ZstdDecompressor(dict_data=known)
    view = memoryview(archive)
    while at < len(archive):
        one, parts = reader.decompressobj(), []
        while not one.eof:
            piece = view[at : at + 65536]
            if not len(piece):
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def _file(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(kinds: DataFrame, folder: str, date: str, archive_bytes: int = 16 << 20) -> DataFrame:
    """Writes the rows of ``record_kinds`` and returns the stored list (path, records, bytes) of the archives."""

    def write(batches):
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(k) for k in range(6)]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, kind, refers_to = (c[i].as_py() for c in columns)
                held.append(record_bytes(page_id, url, payload, digest, kind, refers_to, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)

    def put(records):
        data = archive_of(records)
        path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        store, inner = _file(path)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        with store.open_output_stream(inner) as f:
            f.write(data)
        return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(records)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    return saved(small_batches(kinds).mapInArrow(write, "path string, records bigint, bytes bigint"), "warc-list")


FIELD = re.compile(rb"^([A-Za-z-]+): ?(.*)$", re.M)


def parse_record(record: bytes) -> dict:
    """Fields of a record; payload is None for revisits."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.decode().lower(): v.rstrip(b"\r").decode() for k, v in FIELD.findall(head)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = {k.decode().lower(): v.rstrip(b"\r").decode() for k, v in FIELD.findall(http)}
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(told["content-length"])):
        raise ValueError(f"damaged payload in {fields['warc-record-id']}")
    return {
        "page_id": json.loads(fields["page-id"]),
        "url": fields["warc-target-uri"],
        "payload": None if revisit else payload,
        "payload_bytes": int(told["content-length"]),
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": json.loads(fields["refers-to-page"]) if revisit else None,
    }


def read_archives(archives: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The records of the listed archives (columns ``path`` and ``bytes``), payloads verified against their digests.
    ``id_type``: bigint or string, as the ids were."""
    ids = {"bigint": pa.int64(), "string": pa.string()}[id_type]
    kinds = {"page_id": ids, "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": ids}

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = _file(path)
                with store.open_input_stream(inner) as f:
                    archive = f.read()
                rows, size = [], 0
                for record in records_of(archive):
                    rows.append(parse_record(record))
                    size += len(record)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds.items()))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds.items()))

    sums = archives.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).first()
    cores = archives.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(sums["n"], max(cores, -(-(sums["b"] or 0) // READ_BYTES))))
    schema = f"page_id {id_type}, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_type}"
    return archives.select("path").repartition(parts).mapInArrow(read, schema)


def archive_pages(spark: SparkSession, pages: DataFrame, date: str = "2024-01-01T00:00:00Z", **options) -> DataFrame:
    """Writes all pages to new archives in the shared folder; the list of the archives."""
    return write_archives(record_kinds(pages, **options), scratch_path(spark, "warc"), date)
