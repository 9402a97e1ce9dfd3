"""Zstandard WARC archives: writer and dictionary-aware reader (operator 5).

An archive is a leading skippable frame (magic 0x184D2A5D) that holds a dictionary, then one
Zstandard frame a record: a warcinfo record and one response or revisit record a page. The reader
loads the dictionary, walks the frames by their block headers, decodes each on its own, and checks
version line, mandatory headers, block length, record end, payload length and payload digest.

Writing goes through Spark's text writer, so any file system Spark can write serves, and commits and
retries are Spark's. That writer ends every row with a newline; each row therefore ends with the
header of a one-byte skippable frame, whose content the newline is. Every decoder skips it.

Of pages with equal payloads of ``LEAST`` bytes or more the one with the largest page_id is the
response, the others are revisits that refer to it and carry no payload; their HTTP header keeps the
full payload's length. Pages are not shuffled: only (digest, page_id) pairs are aggregated.

Rows: null html is the empty payload; null urls have no target URI; pages with a null id are never
referred to, but revisit an equal page that has one; repeated rows get one record each, and rows that
share the largest id of their payload are all responses; an empty table gives archives without pages
or none at all, and an empty result; other columns are not archived.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_batches, checkpointed, pick_ids, scratch_path

LEAST = 1000  # bytes of payload from which equal ones are revisits
ARCHIVE_BYTES = 8 << 20  # bytes of records after which a task begins a new archive
ARROW_BYTES = 4 << 20
DICTIONARY_BYTES = 32 << 10
TRAIN_BYTES = 2 << 20  # first bytes of an archive that train its dictionary

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
PADDING_MAGIC = 0x184D2A50
FRAME_MAGIC = 0xFD2FB528
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


def small_batches(spark: SparkSession) -> None:
    """``bounded_batches``, and a batch is sent after ``ARROW_BYTES`` whatever its rows; one longer row is
    a batch of its own. A smaller setting of the session stays."""
    bounded_batches(spark)
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now <= 0 or now > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, holder: the page that a revisit refers to, else null."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    size = F.octet_length("html")
    same = p.filter(size >= least).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND holder IS NOT NULL")
    same = pick_ids(checkpointed(same.select("digest", "holder")))
    p = p.join(same, "digest", "left")
    first = F.col("page_id").eqNullSafe(F.col("holder"))
    return p.select("page_id", "url", "html", "digest", F.when(~first, F.col("holder")).alias("holder"))


def record(kind: str, name: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_name(page_id) -> str:
    return f"<urn:page:{quote(str(page_id), safe='')}>"


def page_record(page_id, url: str | None, payload: bytes, digest: str, holder) -> bytes:
    name = page_name(page_id) if page_id is not None else f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}|{digest}').urn}>"
    headers = [] if url is None else [("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))]
    if page_id is not None:
        headers.append(("Page-ID", quote(str(page_id), safe="")))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if holder is None:
        return record("response", name, headers, http + payload)
    return record("revisit", name, [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", page_name(holder))], http)


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from the samples; their bytes themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archives(records, archive_bytes: int = ARCHIVE_BYTES):
    """(archive number, row) from an iterator of records; rows lack the newline that ends them."""
    pad = struct.pack("<II", PADDING_MAGIC, 1)
    number, held, waiting, written, compress = 0, 0, [], 0, None

    def opened(samples):
        d = trained(samples)
        body = d.as_bytes()
        return zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=True, write_content_size=True).compress, struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body

    def flush():
        nonlocal compress
        info = record("warcinfo", f"<{uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha1(waiting[0]).hexdigest()).urn}>", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        compress, head = opened(waiting)
        yield number, head + pad
        for r in [info, *waiting]:
            yield number, compress(r) + pad

    for r in records:
        written += len(r)
        if compress is None:
            waiting.append(r)
            held += len(r)
            if held >= min(TRAIN_BYTES, archive_bytes):
                yield from flush()
                waiting, held = [], 0
        else:
            yield number, compress(r) + pad
        if compress is not None and written >= archive_bytes:
            number, written, compress = number + 1, 0, None
    if waiting:
        yield from flush()


def write(pages: DataFrame, path: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the archives of ``pages`` (page_id, url, html) below ``path``, one folder an archive."""
    small_batches(pages.sparkSession)

    def run(batches):
        def records():
            for batch in batches:
                for page_id, url, html, digest, holder in zip(*[c.to_pylist() for c in batch.columns]):
                    yield page_record(page_id, url, html.encode("utf-8"), digest, holder)

        base = TaskContext.get().partitionId() << 24
        rows, size, seq = [], 0, 0
        for number, row in archives(records(), archive_bytes):
            rows.append((base + number, seq, row))
            size, seq = size + len(row), seq + 1
            if size >= 1 << 20:
                yield batch_of(rows)
                rows, size = [], 0
        yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["archive", "seq", "body"])

    rows = planned(pages, least).mapInArrow(run, "archive long, seq long, body binary")
    rows = rows.sortWithinPartitions("archive", "seq").select("archive", F.col("body").cast("string").alias("value"))
    rows.write.partitionBy("archive").text(path)


def frame_end(data: memoryview, at: int) -> int:
    """End of the Zstandard frame at ``at``, from its block headers."""
    size = zstandard.frame_header_size(bytes(data[at : at + 18]))
    checksum = data[at + 4] >> 2 & 1
    at += size
    while True:
        if at + 3 > len(data):
            raise ValueError("truncated frame")
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise ValueError("truncated frame")
    return at


def frames(data: bytes | memoryview):
    """Decoded frames of an archive that leads with a dictionary in a skippable frame (or has none).

    One decoder serves all frames and reads them where they lie.
    """
    data, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        if at > len(data):
            raise ValueError("truncated dictionary")
        body = bytes(data[8:at])
        if body[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=64 << 20)
        dictionary = zstandard.ZstdCompressionDict(body)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"{len(data) - at} stray bytes at the end")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
            if at > len(data):
                raise ValueError("truncated skippable frame")
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
            frame = data[at:end]
            if zstandard.frame_content_size(bytes(frame[:18])) >= 0:
                yield decoder.decompress(frame)
            else:  # other writers need not state the size
                yield decoder.decompressobj().decompress(frame)
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


def fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n"):
        key, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise ValueError(f"header line without a colon: {line[:80]!r}")
        out[key.strip().lower()] = value.strip()
    return out


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; its headers and lengths are validated."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, head = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"no WARC version line: {version[:40]!r}")
    h = fields(head)
    missing = [k for k in MANDATORY if k not in h]
    if missing:
        raise ValueError(f"record without {', '.join(missing)}")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{h['warc-record-id']}: Content-Length {n}, block and end of {len(rest)} bytes")
    return h, rest[:n]


def page_row(h: dict[str, str], block: bytes):
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of a page record."""
    http, gap, payload = block.partition(b"\r\n\r\n")
    n = int(fields(http.partition(b"\r\n")[2])["content-length"])
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError(f"{h['warc-record-id']}: no HTTP header")
    if h["warc-type"] == "response":
        if len(payload) != n:
            raise ValueError(f"{h['warc-record-id']}: payload of {len(payload)} bytes, Content-Length {n}")
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{h['warc-record-id']}: payload differs from its digest")
        refers = None
    else:
        refers = h["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">")
    return h.get("page-id"), h.get("warc-target-uri"), n, digest, h["warc-type"], refers, payload if refers is None else None


COLUMNS = (("page_id", "string"), ("url", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "string"), ("payload", "binary"))
ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """page_id, url (strings), payload_bytes, payload_digest, record_type, refers_to and, if asked for,
    payload of all page records.

    One archive is one row of Spark's binary reader, so archives must stay below 2 GB; an Arrow batch
    holds few of them (``small_batches``), and rows leave a task in batches of about 1 MB.
    """
    small_batches(spark)
    columns = COLUMNS if payload else COLUMNS[:-1]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ARROW[t]) for i, (_, t) in enumerate(columns)], names=[c for c, _ in columns])

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                try:
                    for body in frames(memoryview(data.as_buffer())):
                        h, block = parsed(body)
                        if h["warc-type"] in ("response", "revisit"):
                            rows.append(page_row(h, block)[: len(columns)])
                            size += 200 + len(block) * payload
                        if size >= 1 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                except (ValueError, KeyError, zstandard.ZstdError) as wrong:
                    raise ValueError(f"{name}: {wrong}") from wrong
                yield batch_of(rows)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return found.select("path", "content").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in columns))


def round_trip(pages: DataFrame, path: str | None = None, payload: bool = True) -> DataFrame:
    """Write ``pages`` to archives and read them back, ids in their own type, with or without payloads."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(pages, path)
    kind = pages.schema["page_id"].dataType
    ident = lambda c: F.url_decode(c).cast(kind).alias(c)
    return read(spark, path, payload).withColumns({"page_id": ident("page_id"), "refers_to": ident("refers_to")})


#: DuckDB: sizes and digests from the table; the response of equal payloads is the largest page_id.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS holder FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {LEAST} AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST} AND page_id <> holder THEN holder END AS refers_to
FROM h
"""
