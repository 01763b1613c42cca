"""WARC archives: writing, and a normaliser for monolithic gzip files.

An archive that was compressed as one stream can only be read from its start. The normaliser inflates such
a file once, writes every record as a gzip member of its own, and keeps a sidecar index of the members'
places, so that any record can be read by itself afterwards.

All files go through Spark's readers and writers, so they may lie in any store that Spark reaches.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir

END = "\r\n\r\n"
HEAD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)\r?$", re.M)
#: A gzip member without content. It ends in a zero byte, as does any member of under 16 MiB of content.
EMPTY_MEMBER = (lambda c: c.flush())(zlib.compressobj(1, zlib.DEFLATED, 31))
URN = "urn:page"
#: Payloads with copies (about 60 bytes each) that are broadcast at most; more are joined by shuffle.
MOST_BROADCAST = 200_000


def base32(hexed: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: five hex digits (20 bits) make four base32 digits."""
    fives = (F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8))
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, refers_to (null for responses).

    Of equal payloads of at least ``least_bytes`` bytes the least page_id responds and the others refer to it. Rows that share that id and
    payload all respond. A null id refers to the least id, or responds where its group has no other.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("_sha1"))
    slim = rows.filter(F.col("payload_bytes") >= least_bytes).select("page_id", "_sha1", "payload_bytes")
    first = materialise(slim.groupBy("_sha1", "payload_bytes").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "warc-first")
    if first.count() <= MOST_BROADCAST:
        first = F.broadcast(first)
    joined = rows.join(first, ["_sha1", "payload_bytes"], "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", "payload", "payload_bytes", base32(F.col("_sha1")).alias("digest"), refers.alias("refers_to"))


def urn(page_id: Column) -> Column:
    """The record id of a page, whatever characters the page's id has; a null id is the bare name."""
    return F.concat(F.lit(f"<{URN}"), F.coalesce(F.concat(F.lit(":"), F.url_encode(page_id.cast("string"))), F.lit("")), F.lit(">"))


def record_text(rows: DataFrame) -> DataFrame:
    """One column ``value``: a WARC record without its closing blank lines."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " ")), line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_monolithic(rows: DataFrame, path: str) -> None:
    """Gzip archives, one stream each and one for each partition. Spark's text writer serves: a record's closing blank lines are its line end."""
    record_text(rows).write.option("compression", "gzip").option("lineSep", END).text(path)


def inflate(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The inflated stream in steps; further members, if any, follow on. A file that ends too early is an error."""
    at, stream = 0, zlib.decompressobj(31)
    view = memoryview(content)
    while at < len(view):
        piece = view[at : at + step]
        yield stream.decompress(piece)
        at += len(piece) - len(stream.unused_data)
        if stream.eof and at < len(view):
            stream = zlib.decompressobj(31)
    if len(view) and not stream.eof:
        raise ValueError("the gzip stream ends early")


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields by lower-case name, block, the record's bytes) for each record of an archive, in one pass over it."""
    held, at, pieces = b"", 0, inflate(content)
    while True:
        head_end = held.find(b"\r\n\r\n", at)
        if head_end >= 0:
            fields = {k.decode("latin-1").strip().lower(): v.decode("utf-8", "replace") for k, v in HEAD.findall(held[at:head_end])}
            end = head_end + 4 + int(fields.get("content-length", 0)) + 4
            if end <= len(held):
                if not held.startswith(b"WARC/", at) or held[end - 4 : end] != b"\r\n\r\n":
                    raise ValueError("not a WARC record")
                yield fields, held[head_end + 4 : end - 4], held[at:end]
                at = end
                continue
        if (piece := next(pieces, None)) is None:
            if held[at:].strip():
                raise ValueError("the archive ends within a record")
            return
        held, at = held[at:] + piece, 0


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member that ends in a zero byte; content of 16 MiB or more gets an empty member after it for that."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = c.compress(record) + c.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


INDEX = "offset long, length long, record_type string, record_id string, uri string, digest string"
NORMAL = "kind string, archive string, seq long, value binary"


def normalise(batches):
    """For each record of each archive a row with its member, less the closing zero byte, and a row with its line of the index."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            name = re.sub(r"^.*/|\..*$", "", path)
            rows, offset, used = [], 0, 0
            for seq, (fields, _, whole) in enumerate(records(content.as_buffer().to_pybytes())):
                packed = member(whole)
                line = {"offset": offset, "length": len(packed), "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
                rows += [("warc", name, seq, packed[:-1]), ("index", name, seq, json.dumps(line).encode())]
                offset += len(packed)
                used += len(packed)
                if used > 4 << 20:
                    yield _batch(rows)
                    rows, used = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in NORMAL.split(", ")])


def normalise_archives(spark: SparkSession, source: str, target: str, pattern: str = "*.gz") -> None:
    """Rewrite the archives under ``source``: files of one member a record under ``target``/kind=warc, their indexes under ``target``/kind=index.

    Every archive is inflated once and by one task, which writes its file (its name is the folder ``archive=...``)
    and its index (JSON lines, each ended by a zero byte). Spark's text writer puts down the bytes: a
    member's last byte, always zero, is the line end. A source without archives gives no files; an archive that is cut short, or holds anything but
    WARC records, is an error. Spark hands a file over as one value, so an archive of 2 GB or more (compressed) is an error, too.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(source).select("path", "content")
    rows = files.mapInArrow(normalise, NORMAL).sortWithinPartitions("kind", "archive", "seq")
    rows.select("kind", "archive", F.col("value").cast("string").alias("value")).write.partitionBy("kind", "archive").option("lineSep", "\0").text(target)


READ = "archive string, offset long, length long, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def page_of(urn: str | None) -> str | None:
    """The page's id, as text, of a record id; None for the bare name and for no record id."""
    _, colon, page = (urn or "").strip("<>").removeprefix(URN).partition(":")
    return unquote_plus(page) if colon else None


def members(content: bytes, step: int = 8192) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each member of a file; an empty member belongs to the one before it."""
    at = 0
    while at < len(content):
        begin, whole = at, []
        while at < len(content) and (at == begin or content[at : at + len(EMPTY_MEMBER)] == EMPTY_MEMBER):
            stream = zlib.decompressobj(31)
            while not stream.eof:
                piece = content[at : at + step]
                if not piece:
                    raise ValueError("the gzip stream ends early")
                whole.append(stream.decompress(piece))
                at += len(piece) - len(stream.unused_data)
        yield begin, at - begin, b"".join(whole)


def read_records(batches):
    for batch in batches:
        for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content")):
            out = []
            for offset, length, whole in members(content.as_buffer().to_pybytes()):
                head, _, block = whole[:-4].partition(b"\r\n\r\n")
                fields = {k.decode().strip().lower(): v.decode("utf-8", "replace") for k, v in HEAD.findall(head)}
                if fields["warc-type"] == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                else:  # a revisit has no payload; its header has the full payload's figures
                    size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                out.append((archive, offset, length, page_of(fields["warc-record-id"]), size, digest, fields["warc-type"], page_of(fields.get("warc-refers-to"))))
            names = [x.split()[0] for x in READ.split(", ")]
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in READ.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], names)


def read_archives(spark: SparkSession, target: str, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; page ids have the type ``id_type``.

    Every member has to stand where the index says it does, and the index may name no other: a difference is an error.
    """
    archive = F.regexp_extract("path", "archive=([^/]+)/", 1).alias("archive")
    under = lambda kind, form: spark.read.format(form).option("recursiveFileLookup", "true").option("lineSep", "\0").load(f"{target}/kind={kind}")
    try:
        lines, files = under("index", "text"), under("warc", "binaryFile")
    except AnalysisException as e:  # no record, no folder
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return _typed(spark.createDataFrame([], READ), id_type)
    index = lines.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", INDEX).alias("i")).select(archive, "i.offset", "i.length", F.lit(True).alias("_listed"))
    found = files.select(archive, "content").mapInArrow(read_records, READ)
    joined = found.join(index, ["archive", "offset", "length"], "full")
    both = F.col("_listed") & F.col("record_type").isNotNull()
    said = F.concat(F.lit("index and archive differ at "), F.col("archive"), F.lit(" "), F.col("offset"))
    return _typed(joined.withColumn("record_type", F.when(both, F.col("record_type")).otherwise(F.raise_error(said))), id_type)


def _typed(read: DataFrame, id_type: str) -> DataFrame:
    kinds = {c: id_type for c in ("page_id", "refers_to")}
    return read.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as monolithic archives, normalise these, read the records back. Other columns may have any names; ids may be numbers or text."""
    spark = pages.sparkSession
    raw, target = shared_dir(spark, "warc-raw"), shared_dir(spark, "warc")
    write_monolithic(with_revisits(pages, least_bytes), raw)
    normalise_archives(spark, raw, target)
    return read_archives(spark, target, dict(pages.dtypes)["page_id"])
