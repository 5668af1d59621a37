"""WARC: archives of one gzip member per record, written and read sequentially."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import _common as C

MIN_REVISIT, ARCHIVE_BYTES, STEP = 100, 16 << 20, 1 << 18
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def encode_record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member; a revisit keeps the HTTP headers and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time; never the whole archive."""
    rest = b""
    while True:
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            data = rest or stream.read(STEP)
            rest = b""
            if not data:
                if out:
                    raise ValueError("the archive ends within a record")
                return
            out.append(unpacker.decompress(data))
        rest = unpacker.unused_data
        yield b"".join(out)


def decode_record(raw: bytes) -> dict:
    """A record by its content length; raises ValueError where framing or a digest is wrong."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    block, end = rest[:n], rest[n:]
    if len(block) != n or end != b"\r\n\r\n":
        raise ValueError(f"content length {n} doesn't frame {fields.get('warc-record-id')}")
    if "sha256:" + hashlib.sha256(block).hexdigest() != fields["warc-block-digest"]:
        raise ValueError(f"block digest of {fields.get('warc-record-id')} is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    revisit, digest = fields["warc-type"] == "revisit", fields["warc-payload-digest"].removeprefix("sha256:")
    if not revisit and (hashlib.sha256(payload).hexdigest() != digest or sizes != [len(payload)]):
        raise ValueError(f"payload digest of {fields.get('warc-record-id')} is wrong")
    strip = lambda x: x and x.strip("<>")
    return {
        "record_id": strip(fields["warc-record-id"]),
        "record_type": fields["warc-type"],
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": strip(fields.get("warc-refers-to")),
        "payload_digest": digest,
        "payload_bytes": sizes[0],
        "payload": None if revisit else payload,
    }


def _writer(folder: str):
    """Writes rows to archives. An archive's name is the attempt's own, and the manifest that Spark commits has one attempt's archives only."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = C.open_fs(folder)
        part, attempt, made = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        held, size = [], 0

        def flush() -> pd.DataFrame:
            name = f"part-{part:06d}-{made:05d}-{attempt}.warc.gz"
            C.put(fs, f"{top}/{name}", b"".join(held))
            return pd.DataFrame({"path": [f"{folder}/{name}"], "records": [len(held)]})

        for pdf in batches:
            for i, url, html, digest, to in zip(pdf["rid"], pdf["url"], pdf["html"], pdf["digest"], pdf["refers_to"]):
                held.append(encode_record(i, url, html.encode(), digest, to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    made, held, size = made + 1, [], 0
        if held:
            yield flush()

    return write


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    for pdf in batches:
        for path in pdf["path"]:
            fs, p = C.open_fs(path)
            with fs.open_input_stream(p, compression=None) as stream:
                rows, size = [], 0
                for raw in members(stream):
                    rows.append(decode_record(raw))
                    size += len(raw)
                    if size >= 4 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Write a record per row to archives in the shared folder; returns (path, records).

    Of equal payloads of MIN_REVISIT bytes or more the smallest id is the
    response and the others revisit it; rows that repeat that id are responses
    too. Null text is an empty payload, a null url has no target URI, a null id
    is written as none, sorts last and never counts as the smallest beside
    another. An empty table writes no archive. Other columns are not read.
    """
    spark = pages.sparkSession
    C.small_batches(spark)
    folder = folder or C.new_path(spark, "warc")
    html = F.coalesce(F.col(text_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("num"), F.col(url_col).alias("url"), html.alias("html"))
    base = base.withColumn("digest", F.sha2("html", 256))
    long = base.filter(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("num").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = C.cut(long.filter("n > 1").select("digest", "first"), "warc-shared")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c, F.lit("none")))
    # the left side's hot digests are split by the skew join of adaptive execution, as the right side is a table
    revisit = F.col("first").isNotNull() & ~F.col("num").eqNullSafe(F.col("first"))
    to = F.when(revisit, urn(F.col("first").cast("string"))).alias("refers_to")
    full = base.join(shared, "digest", "left").select(urn(F.col("id")).alias("rid"), "num", "url", "html", "digest", to)
    full = full.sortWithinPartitions("digest", "num").drop("num")  # records don't follow the order in which blocks were fetched
    return C.cut(full.mapInPandas(_writer(folder), "path string, records long"), "warc-manifest")


def read_warc(archives: DataFrame) -> DataFrame:
    """The records of the archives in column path, in RECORD's columns; each archive is one task's stream."""
    spark = archives.sparkSession
    n = archives.count()
    return archives.select("path").repartition(max(1, min(n, 4 * C.parts_of(spark))), "path").mapInPandas(_reader, RECORD)


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """What the archives say of each page: id, size and digest of the full payload, type and reference."""
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    own = F.col("record_type") == "response"
    size = F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    digest = F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    return read_warc(write_warc(pages)).select(
        number("record_id").alias("page_id"),
        size.alias("payload_bytes"),
        digest.alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
