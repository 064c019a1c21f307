"""WARC: reading and writing records, and resolving not-modified revisits.

A revisit takes the body of the latest earlier full response with the same canonical URL (an
as-of join), if its validators agree: entity tags by weak comparison where the revisit has one,
else Last-Modified, else the payload digest. Headers that a 304 response may renew replace those
of the full response; the others stay.

Null URLs match nothing. Of responses at the same time the one with the larger record id
counts as the later; a response at the revisit's own time is not earlier. Repeated rows each
resolve alike. Records that cannot be read have a row with `error` set, and reading goes on at the
next one. Files may be gzipped, a member a record. Times are whole seconds; fractions and missing
parts of a date are cut off. Empty tables and files give no rows; columns other than the named
ones are not read.
"""

from __future__ import annotations

import base64
import calendar
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Headers that a 304 response renews (RFC 9110, 15.4.5), and its date.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified", "age", "server", "set-cookie")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
BUCKET_S = 4096
MOST_SECONDS = 1 << 37


def canonical(url: Column) -> Column:
    """The URL without scheme, user, www., default port, trailing slash, fragment and campaign parameters; host in lower case, parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def payload_digest(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def record(kind: str, record_id: str, url: str, seconds: int, headers: list[tuple[str, str]], body: bytes = b"", refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record that holds an HTTP response, or a revisit of one (304, no body)."""
    from datetime import UTC, datetime

    status = "HTTP/1.1 200 OK" if kind == "response" else "HTTP/1.1 304 Not Modified"
    block = "\r\n".join([status, *(f"{k}: {v}" for k, v in headers), "", ""]).encode() + body
    date = datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", url), ("WARC-Date", date), ("Content-Type", "application/http;msgtype=response")]
    head += [("WARC-Payload-Digest", payload_digest(body))] if kind == "response" else [("WARC-Profile", PROFILE)]
    head += [("WARC-Refers-To", f"<{refers_to}>")] * bool(refers_to) + [("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def _fields(block: bytes) -> tuple[str, list[tuple[str, str]]]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return lines[0], [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:] if x)]


DATE = re.compile(r"([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2})(?:T([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.][0-9]+)?)?Z)?)?)?")
START = re.compile(rb"WARC/1[.][0-9]\r\n[A-Za-z-]+:")


def seconds_of(date: str) -> int:
    """Seconds since 1970 of a date of WARC/1.1, of any precision."""
    m = DATE.fullmatch(date.strip())
    if not m:
        raise ValueError("the date is wrong")
    part = [int(x) if x else least for x, least in zip(m.groups(), (1970, 1, 1, 0, 0, 0), strict=True)]
    if not (1 <= part[1] <= 12 and 1 <= part[2] <= calendar.monthrange(part[0], part[1])[1] and part[3] < 24 and part[4] < 60 and part[5] <= 60):
        raise ValueError("the date is wrong")
    return calendar.timegm((*part, 0, 0, 0))


def unzipped(data: bytes) -> bytes:
    """The bytes of a file's gzip members; of one that is damaged what can be read of it, and on with the next."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at = [], 0
    while at >= 0:
        member = zlib.decompressobj(31)
        rest = memoryview(data)[at:]
        try:
            out.append(member.decompress(rest))
            at = len(data) - len(member.unused_data) if member.eof and member.unused_data else -1
        except zlib.error:
            at = data.find(b"\x1f\x8b\x08", at + 1)
    return b"".join(out)


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file; for one that cannot be read one with `error`."""
    data = unzipped(data)
    at = 0
    while at < len(data):
        try:
            end = data.index(b"\r\n\r\n", at)
            version, pairs = _fields(data[at:end])
            head = dict(pairs)
            if not version.startswith("WARC/1."):
                raise ValueError("no record starts here")
            size = int(head["content-length"])
            block = data[end + 4 : end + 4 + size]
            if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
                raise ValueError("a record is cut")
            cut = block.find(b"\r\n\r\n")
            http, headers = _fields(block[:cut]) if cut >= 0 else ("", [])
            body = block[cut + 4 :] if cut >= 0 else block
            merged: dict[str, str] = {}
            for k, v in headers:
                merged[k] = f"{merged[k]}, {v}" if k in merged else v
            if head["warc-type"] == "response" and "warc-payload-digest" in head and head["warc-payload-digest"].startswith("sha1:") and payload_digest(body) != head["warc-payload-digest"]:
                raise ValueError("the payload digest is wrong")
            time = seconds_of(head["warc-date"])
            status = http.split(" ")
            yield {"record_id": head["warc-record-id"].strip("<>"), "type": head["warc-type"], "url": head.get("warc-target-uri"), "seconds": time, "profile": head.get("warc-profile"), "status": int(status[1]) if len(status) > 1 and status[1].isdigit() else None, "headers": merged, "digest": head.get("warc-payload-digest"), "body_sha256": hashlib.sha256(body).hexdigest(), "body_bytes": len(body), "error": None}
            at = end + 8 + size
        except (ValueError, KeyError) as e:
            yield {"record_id": None, "type": None, "url": None, "seconds": None, "profile": None, "status": None, "headers": {}, "digest": None, "body_sha256": None, "body_bytes": None, "error": f"{type(e).__name__}: {e} at byte {at}"}
            further = START.search(data, at + 1)
            at = further.start() if further else len(data)


RECORDS = "record_id string, type string, url string, seconds long, profile string, status int, headers map<string,string>, digest string, body_sha256 string, body_bytes long, error string"
_KINDS = [("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("seconds", pa.int64()), ("profile", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("digest", pa.string()), ("body_sha256", pa.string()), ("body_bytes", pa.int64()), ("error", pa.string())]


def read_records(files: DataFrame, column: str = "content") -> DataFrame:
    """The records of WARC files, given as rows of bytes (as from the binaryFile source)."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [r for data in batch.column(0).slice(at, 256).to_pylist() for r in parse(data or b"")]
                yield pa.RecordBatch.from_arrays([pa.array([list(r[k].items()) if k == "headers" else r[k] for r in rows], t) for k, t in _KINDS], names=[k for k, _ in _KINDS])

    return files.select(column).mapInArrow(parsed, RECORDS)


def tag(value: Column) -> Column:
    return F.regexp_replace(value, "^W/", "")


def resolve(records: DataFrame, bucket_s: int = BUCKET_S) -> DataFrame:
    """record_id, canonical_url, seconds, status (full, resolved, mismatch, unresolved), refers_to, body_sha256, body_bytes and headers.

    The as-of join is a running last over the URL's records in each stretch of time, and over
    the stretches' last responses before; so a URL with very many captures is many tasks' work.
    """
    r = records.where(F.col("error").isNull() & F.col("type").isin("response", "revisit")).withColumn("canonical_url", canonical(F.col("url"))).withColumn("_bucket", F.floor(F.col("seconds") / bucket_s))
    # bodies stay behind; what is left is small and read several times
    r = materialize(r.select("record_id", "type", "canonical_url", "seconds", "_bucket", "headers", "digest", "body_sha256", "body_bytes"), "warc-records")
    known = r.where("canonical_url is not null")
    inside = Window.partitionBy("canonical_url", "_bucket").orderBy("seconds").rangeBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.when(F.col("type") == "response", F.struct("seconds", "record_id"))).over(inside)
    stretches = known.where("type = 'response'").groupBy("canonical_url", "_bucket").agg(F.max(F.struct("seconds", "record_id")).alias("_last"))
    # a stretch without responses of its own still needs what came before
    every = known.select("canonical_url", "_bucket").distinct().join(stretches, ["canonical_url", "_bucket"], "left")
    before = F.max("_last").over(Window.partitionBy("canonical_url").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    every = every.select("canonical_url", "_bucket", before.alias("_earlier"))
    revisits = known.withColumn("_near", latest).where("type = 'revisit'").join(every, ["canonical_url", "_bucket"]).withColumn("_to", F.coalesce("_near", "_earlier"))
    source = known.where("type = 'response'").select(F.col("canonical_url").alias("_url"), F.col("seconds").alias("_seconds"), F.col("record_id").alias("_id"), F.col("headers").alias("_headers"), F.col("digest").alias("_digest"), F.col("body_sha256").alias("_sha"), F.col("body_bytes").alias("_bytes")).dropDuplicates(["_url", "_seconds", "_id"])
    joined = revisits.join(source, (F.col("canonical_url") == F.col("_url")) & (F.col("_to.seconds") == F.col("_seconds")) & (F.col("_to.record_id") == F.col("_id")), "left")
    mine, other = (lambda k: F.element_at("headers", k)), (lambda k: F.element_at("_headers", k))
    agrees = F.when(mine("etag").isNotNull(), tag(mine("etag")).eqNullSafe(tag(other("etag")))).when(mine("last-modified").isNotNull(), mine("last-modified").eqNullSafe(other("last-modified"))).otherwise(F.col("digest").isNotNull() & F.col("digest").eqNullSafe(F.col("_digest")))
    found = F.col("_id").isNotNull()
    renewed = F.map_filter("headers", lambda k, v: k.isin(*RENEWED))
    kept = F.map_filter("_headers", lambda k, v: ~(k.isin(*RENEWED) & F.map_contains_key("headers", k)))
    ok = found & agrees
    out = joined.select(
        "record_id", "canonical_url", "seconds", F.when(~found, "unresolved").when(agrees, "resolved").otherwise("mismatch").alias("status"), F.col("_id").alias("refers_to"),
        F.when(ok, F.col("_sha")).alias("body_sha256"), F.when(ok, F.col("_bytes")).alias("body_bytes"), F.when(ok, F.map_concat(kept, renewed)).otherwise(F.col("headers")).alias("headers"),
    )
    fulls = r.where("type = 'response'").select("record_id", "canonical_url", "seconds", F.lit("full").alias("status"), F.lit(None).cast("string").alias("refers_to"), "body_sha256", "body_bytes", "headers")
    lost = r.where("type = 'revisit' and canonical_url is null").select("record_id", "canonical_url", "seconds", F.lit("unresolved").alias("status"), F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("string").alias("body_sha256"), F.lit(None).cast("long").alias("body_bytes"), "headers")
    return fulls.unionByName(out).unionByName(lost)


def captures(pages: DataFrame) -> DataFrame:
    """A WARC file of each page: its capture at second page_id, and a later or earlier conditional request for it.

    The request's time is page_id and a hash of the URL less 16,384, at least 0, so some come
    before the capture. Seconds are modulo 2 ** 37, as dates have years of four digits. Pages
    whose URL has parameters give Last-Modified and no entity tag; a null page_id is at 0.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for key, url, html in zip(*(part.column(k).to_pylist() for k in ("page_id", "url", "html")), strict=True):
                    url, body, name, key = url or "", (html or "").encode(), "null" if key is None else key, (key or 0) % MOST_SECONDS
                    mark = hashlib.md5(body).hexdigest()
                    checked = [("Last-Modified", f"v{name}")] if "?" in url else [("ETag", f'"{mark}"')]
                    seconds = max(0, key + int(hashlib.md5(url.encode()).hexdigest()[:4], 16) - 16384)
                    own = [("Content-Type", "text/html"), ("Content-Length", str(len(body))), ("Cache-Control", "max-age=60"), *checked]
                    again = [("Cache-Control", f"max-age={key % 7}"), ("Content-Length", "0"), *[(k, "W/" + v if k == "ETag" else v) for k, v in checked]]
                    out.append(record("response", f"r:{name}", url, key, own, body) + record("revisit", f"v:{name}", url, seconds, again))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["content"])

    return pages.select("page_id", "url", "html").mapInArrow(written, "content binary")
