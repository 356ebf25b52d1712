"""WARC archives: write records in segments, read them back whole.

Writing: of the rows with an equal payload the one with the largest page_id
becomes a ``response`` record, and every other row a ``revisit`` record that
names it and carries no payload.  Bodies are HTTP messages in chunked transfer
framing; a body longer than ``segment_chars`` is cut into a first segment and
``continuation`` records.  The archive is written by Spark's own text writer
(records are the rows, the blank line that ends every record is the line
separator), so any file system that Spark can write to will do.

Reading: an archive file holds at most ``records_per_file`` records of at most
``segment_chars`` characters, so files are bounded by bytes, and the parser
inflates them as a stream.  Continuation records are grouped by their origin
identifier, ordered by segment number, checked against the total length, and
the chunked framing is decoded.

Every row is a record with an identifier of its own: page_id, payload digest,
a hash of the url and, for rows that repeat all three, a running number.

Edge cases: a null payload is empty; a null url omits the target URI; a null
page_id is smaller than any other; of rows that repeat the largest page_id the
one with the largest url (null smallest) is the response and the rest revisit
it; repeated rows are records like any other; very long payloads take as many
segments as they need; an empty table gives an empty archive and result; other
columns (also ones named like the result's) are left out.  Records whose
segments are missing or whose length or digest does not fit are returned with
``intact`` false.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, ship, trimmed

END = "\r\n\r\n"
_STATUS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: str, size: int) -> str:
    """HTTP/1.1 chunked framing; chunks end between characters, sizes are in bytes."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts) + "0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """Payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        eol = body.index(b"\r\n", at)
        n = int(body[at:eol].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if body[eol + 2 + n : eol + 4 + n] != b"\r\n":
            raise ValueError("chunk length does not fit")
        out.append(body[eol + 2 : eol + 2 + n])
        at = eol + 4 + n


def _record(kind: str, ident: str, body: str, more: list[str]) -> str:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", "WARC-Date: 2024-01-01T00:00:00Z", *more]
    return "\r\n".join([*head, f"Content-Length: {len(body.encode())}"]) + END + body


def records_of(base: str, url: str | None, html: str | None, digest: str, refers_to: str | None, segment_chars: int, chunk_chars: int) -> list[str]:
    """The WARC records of one row, without the blank line after each."""
    ident = f"urn:page:{base}"
    shown = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    head = [f"WARC-Target-URI: {shown}"] * (shown is not None) + [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record("revisit", ident, "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", [*head, profile, f"WARC-Refers-To: <urn:page:{refers_to}>"])]
    body = _STATUS + chunked(html or "", chunk_chars)
    if len(body) <= segment_chars:
        return [_record("response", ident, body, head)]
    parts = [body[i : i + segment_chars] for i in range(0, len(body), segment_chars)]
    out = [_record("response", ident, parts[0], [*head, "WARC-Segment-Number: 1"])]
    for n, part in enumerate(parts[1:], 2):
        more = [f"WARC-Segment-Origin-ID: <{ident}>", f"WARC-Segment-Number: {n}"]
        if n == len(parts):
            more.append(f"WARC-Segment-Total-Length: {len(body.encode())}")
        out.append(_record("continuation", f"urn:segment:{n}:{base}", part, more))
    return out


def with_roles(pages: DataFrame) -> DataFrame:
    """(url, html, hex, base, refers): one row to write for every row of ``pages``.

    ``base`` identifies the record and ``refers`` the response that a revisit
    names.  Only digests, ids and urls are aggregated, and combined before the
    shuffle, so the rows of one payload may be any share of all rows.  Payloads
    travel only with responses; of payloads that several rows hold, one travels.
    """
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    full = full.withColumn("hex", F.sha1(F.encode("html", "UTF-8")))
    rows = materialize(full.groupBy("hex", "page_id", "url").agg(F.count(F.lit(1)).alias("n")), "warc-rows")
    base = lambda pid, url, k: F.concat_ws(":", F.coalesce(pid.cast("string"), F.lit("-")), F.col("hex"), F.hex(F.xxhash64(url)), k.cast("string"))
    first = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", F.col("url").isNotNull().alias("named"), "url")).alias("top")
    shared = rows.groupBy("hex").agg(first, F.sum("n").alias("rows")).filter("rows > 1")
    shared = materialize(shared.select("hex", F.col("top.page_id").alias("top_id"), F.col("top.url").alias("top_url")), "warc-shared")
    held = shared.select(F.col("hex").alias("_k"), "top_id", "top_url")
    met = full.join(held, full["hex"] == held["_k"], "left")
    is_top = F.col("page_id").eqNullSafe(F.col("top_id")) & F.col("url").eqNullSafe(F.col("top_url"))
    write = ["url", "html", "hex", base(F.col("page_id"), F.col("url"), F.lit(0)).alias("base"), F.lit(None).cast("string").alias("refers")]
    alone = met.filter(F.col("_k").isNull()).select(*write)
    responses = met.filter(F.col("_k").isNotNull() & is_top).groupBy("hex", "page_id", "url").agg(F.min("html").alias("html")).select(*write)
    others = rows.join(held, rows["hex"] == held["_k"]).withColumn("_own", is_top.cast("long")).filter("n > _own")
    others = others.withColumn("_i", F.explode(F.sequence(F.col("_own"), F.col("n") - 1)))
    revisits = others.select("url", F.lit(None).cast("string").alias("html"), "hex", base(F.col("page_id"), F.col("url"), F.col("_i")).alias("base"), base(F.col("top_id"), F.col("top_url"), F.lit(0)).alias("refers"))
    return alone.unionByName(responses).unionByName(revisits)


def write_warc(pages: DataFrame, path: str, segment_chars: int = 16_384, chunk_chars: int = 4_096, records_per_file: int = 2_000) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files under ``path``."""
    ship(pages.sparkSession)

    def base32(hexed: str) -> str:
        return base64.b32encode(bytes.fromhex(hexed)).decode()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for url, html, hexed, base, refers in zip(*(b.column(c) for c in range(5))):
                rows = records_of(base.as_py(), url.as_py(), html.as_py(), base32(hexed.as_py()), refers.as_py(), segment_chars, chunk_chars)
                out += rows
                held += sum(map(len, rows))
                if held > 8_000_000:
                    yield pa.RecordBatch.from_pydict({"value": out})
                    out, held = [], 0
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    rows = with_roles(pages).mapInArrow(trimmed(build), "value string")
    rows.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


_RECORD_SCHEMA = "kind string, record_id string, origin_id string, refers_to string, digest string, segment int, total long, body binary"


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """(kind, id, origin, refers_to, digest, segment, total length, body) of each record."""
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            continue  # the blank lines after a record
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        body = stream.read(int(head.get("content-length", 0)))
        number, total = head.get("warc-segment-number"), head.get("warc-segment-total-length")
        ref = head.get("warc-refers-to")
        yield (
            head.get("warc-type"), head.get("warc-record-id", "").strip("<>"), head.get("warc-segment-origin-id", "").strip("<>") or None, ref and ref.strip("<>"),
            head.get("warc-payload-digest", "").removeprefix("sha1:") or None, number and int(number), total and int(total), body,
        )


def inflated(data: bytes) -> io.BufferedIOBase:
    """The bytes of an archive as a stream; gzip members are inflated as they are read."""
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)), 1 << 20) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def read_records(spark, path: str) -> DataFrame:
    """One row per record of the archives below ``path``, segments still apart."""
    ship(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORD_SCHEMA.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            for blob in b.column("content"):
                rows, held = [], 0
                for r in parse_warc(inflated(blob.as_py())):
                    rows.append(r)
                    held += len(r[-1])
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content").mapInArrow(trimmed(parse), _RECORD_SCHEMA)


_WHOLE_SCHEMA = "record_id string, kind string, refers_to string, digest string, payload binary, intact boolean"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join ordered segments, verify total length and digest, decode the framing."""
    kinds = [pa.string()] * 4 + [pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in _WHOLE_SCHEMA.split(", ")]
    for b in batches:
        rows = []
        for r in b.to_pylist():
            parts = sorted({p["segment"]: p for p in r["parts"]}.items())
            body = b"".join(p["body"] for _, p in parts)
            total = next((p["total"] for _, p in parts if p["total"] is not None), None)
            ok = [n for n, _ in parts] == list(range(1, len(parts) + 1)) and (total == len(body) if len(parts) > 1 else True)
            payload, first = None, parts[0][1] if parts else {}
            if first.get("kind") != "revisit":
                try:
                    head, sep, rest = body.partition(b"\r\n\r\n")
                    payload = unchunk(rest) if b"transfer-encoding: chunked" in head.lower() else rest
                    ok &= bool(sep) and base64.b32encode(hashlib.sha1(payload).digest()).decode() == first.get("digest")
                except ValueError:
                    ok = False
            rows.append((r["record_id"], first.get("kind"), first.get("refers_to"), first.get("digest"), payload, ok))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_warc(spark, path: str) -> DataFrame:
    """Whole records: one row each with decoded payload (null for revisits).

    Records that are not segmented are finished where they were parsed; only
    segments are shuffled, by origin identifier.  A group is one payload, which
    was one row before.
    """
    rec = read_records(spark, path)
    part = F.struct(F.coalesce("segment", F.lit(1)).alias("segment"), "total", "kind", "refers_to", "digest", "body")
    alone = rec.filter("segment IS NULL").select("record_id", F.array(part).alias("parts"))
    cut = rec.filter("segment IS NOT NULL").select(F.coalesce("origin_id", "record_id").alias("record_id"), part.alias("part"))
    cut = cut.groupBy("record_id").agg(F.collect_list("part").alias("parts"))
    return alone.unionByName(cut).mapInArrow(trimmed(_finish), _WHOLE_SCHEMA)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back; one row per page.

    A revisit's length is its response's, looked up by the identifier it
    refers to; its digest comes from its own record.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(pages, path)
    whole = read_warc(spark, path).select("record_id", "kind", "refers_to", "digest", "intact", F.octet_length("payload").cast("long").alias("_n"))
    whole = materialize(whole, "warc-records")
    origins = whole.filter("kind = 'response'").groupBy("record_id").agg(F.max("_n").alias("_m")).withColumnRenamed("record_id", "_o")
    shared = whole.filter("kind = 'revisit'").groupBy("refers_to").agg(F.count(F.lit(1)).alias("_c")).withColumnRenamed("refers_to", "_t")
    shared = shared.join(origins, F.col("_t") == F.col("_o")).select("_t", "_m")
    joined = whole.join(shared, whole["refers_to"] == shared["_t"], "left")
    number = lambda c: F.expr(f"try_cast(split({c}, ':')[2] AS bigint)")
    return joined.select(
        number("record_id").alias("page_id"),
        F.coalesce("_n", "_m").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        number("refers_to").alias("refers_to"),
        F.col("intact"),
    )
