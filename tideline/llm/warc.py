"""Legacy archives to WARC: ARC images are parsed record by record and rewritten as WARC.

``convert`` reads an ARC image of version 1 or 2: the version block names the
version, each URL record line, whose fields are told by their form, declares the
length of what follows, and nothing but that length decides where it ends. Blank
lines and padding between records are skipped; what is no record is a row with an
error, or left out of the conversion, never a failure. HTTP headers end at their
first empty line, of whatever line ends; records without an HTTP header become
resources, all of which is payload. Each record becomes a WARC/1.1 record with a synthesised identifier (a UUID of its
key, URL, date and digest), an ISO timestamp, type, content type and digests.
Records with equal payloads of ``MIN_REVISIT`` bytes or more are written once as
a response; the others revisit it, and name its identifier, URL and date.

``convert_archives`` takes ARC files from disk, plain or gzipped;
``write_archives`` takes a table of pages and puts each through an ARC image.
WARC files are written by Spark itself, plain or as gzip files, whose record
separator is the one that WARC prescribes, so any store that Spark writes to
will do; they are read back with Spark's binary reader and parsed by declared
lengths. A gzip file is one member, since Spark's writer has no end of a record.
Records are written by classes of size, each with as many to a file as keep it
under ``FILE_BYTES``, unless a single record is larger.

Copies of a page find their first one by digest: payloads with very many copies,
a bounded number of them, by a broadcast, others by a join; pages that are too
small for a revisit take no part in it.

Defined results: a null page has an empty payload and is a response; a null URL
is written as ``unknown:``, and bytes of a URL that are not printable ASCII are
percent-encoded; rows with equal payloads that all have the smallest id
are all responses; an empty table gives an empty table; further columns are
ignored, whatever their names; a very long page is one record, which one task
holds in memory. A page without an id keeps a record without one, revisits a
page that has an id, and is never referred to.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, map_rows

#: Least payload that is worth a revisit record.
MIN_REVISIT = 100
#: Fields of an ARC URL record, by version.
FIELDS = {1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"), 2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Pages that are given no date in their table are stamped with this one.
DATE = "20240101000000"
#: Bytes of a file, about; upper bounds of the size classes, the last of which has no other.
FILE_BYTES, CLASSES = 128 << 20, (32 << 10, 1 << 20, 16 << 20, 1 << 62)
#: Copies from which a payload is popular, and how many popular ones there may be; with more pages the limit is raised.
POPULAR, MOST_POPULAR = 4096, 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(url: str | None) -> str:
    """The URL with every byte that is not printable ASCII percent-encoded."""
    return "".join(f"%{b:02X}" if b <= 32 or b >= 127 else chr(b) for b in (url or "unknown:").encode("utf-8", "surrogatepass"))


def arc_image(name: str, version: int, pages: list[tuple[str | None, bytes]], date: str = DATE) -> bytes:
    """An ARC file of (url, HTTP response) pairs."""
    block = f"{version} 0 Archive\n{' '.join(FIELDS[version])}\n".encode()
    out = [_arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", "200", name, 0, len(block)), block, b"\n"]
    offset = sum(map(len, out))
    for url, body in pages:
        line = _arc_line(version, _clean(url), "0.0.0.0", date, "text/html", "200", name, offset, len(body))
        out += [line, body, b"\n"]
        offset += len(line) + len(body) + 1
    return b"".join(out)


def _arc_line(version: int, url: str, ip: str, date: str, kind: str, code: str, name: str, offset: int, length: int) -> bytes:
    values = (url, ip, date, kind, str(length)) if version == 1 else (url, ip, date, kind, code, "-", "-", str(offset), name, str(length))
    return " ".join(values).encode() + b"\n"


#: A URL record line by the form of its fields: addresses, dates and numbers are told by what they are, so that URLs and
#: content types may hold spaces.
_START = rb"(?P<url>[^\n]*) (?P<ip>[0-9.]+|[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*|-) (?P<date>[0-9]{4,14}) "
LINES = {
    1: re.compile(_START + rb"(?P<type>[^\n]*) (?P<length>[0-9]+)\r?"),
    2: re.compile(_START + rb"(?P<type>[^\n]*?) (?P<code>[0-9]+|-) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>[0-9]+|-) (?P<filename>\S+) (?P<length>[0-9]+)\r?"),
}
#: What may stand between records besides the one newline that is prescribed.
PADDING = b"\n\r\0"


def arc_records(image: bytes) -> Iterator[tuple[int, dict[str, str], memoryview, str | None]]:
    """(place, header fields, content, error) of each record after the version block, and of what is no record.

    Blank lines and zero bytes between and after records are skipped. A line that no URL record could be, or a record that
    is longer than what is left, is one entry with its bytes, no fields and an error; reading goes on with the next line
    that has the form of a URL record. A file without a version block of a known version is one such entry.
    """
    view = memoryview(image)
    end = image.find(b"\n")
    version, at = None, 0
    last = image[: max(end, 0)].rstrip(b"\r").rsplit(b" ", 1)[-1]
    if image.startswith(b"filedesc:") and last.isdigit():
        block = image[end + 1 : end + 1 + int(last)]
        number = block.split(b" ", 1)[0]
        version, at = int(number) if number.isdigit() else None, end + 1 + int(last)
    if version not in LINES:
        if image.strip(PADDING):
            yield 0, {}, view, "no version block of ARC 1 or 2"
        return
    line, place = LINES[version], 0
    while True:
        while at < len(image) and image[at] in PADDING:
            at += 1
        if at == len(image):
            return
        end = image.find(b"\n", at)
        end = len(image) if end < 0 else end
        m = line.fullmatch(image, at, end)
        stop = end + 1 + int(m["length"]) if m else 0
        if m and stop <= len(image):
            text = {k: v.decode("utf-8", "surrogateescape") for k, v in m.groupdict().items()}
            names = {"URL": "url", "IP-address": "ip", "Archive-date": "date", "Content-type": "type", "Result-code": "code", "Checksum": "checksum", "Location": "location", "Offset": "offset", "Filename": "filename", "Archive-length": "length"}
            yield place, {f: text[names[f]] for f in FIELDS[version]}, view[end + 1 : stop], None
        else:
            stop = _next_line(image, end + 1, line)
            yield place, {}, view[at:stop], "a record is shorter than its declared length" if m else "no URL record line"
        at, place = stop, place + 1


def _next_line(image: bytes, at: int, line: re.Pattern[bytes]) -> int:
    """Where the next line begins that has the form of a URL record and names a scheme, or the image's end."""
    while at < len(image):
        end = image.find(b"\n", at)
        end = len(image) if end < 0 else end
        if b":" in image[at : at + 32] and line.fullmatch(image, at, end):
            return at
        at = end + 1
    return len(image)


def read_arc(image: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """(place, header fields, content) of each record after the version block; what is no record raises ``ValueError``."""
    for place, header, content, error in arc_records(image):
        if error:
            raise ValueError(error)
        yield place, header, content


def _http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


_HEAD_END = re.compile(rb"\r?\n\r?\n")


def _split_http(block: memoryview | bytes) -> tuple[bytes, bytes]:
    """(header, payload) of an HTTP response, whose header ends at its first empty line, of whatever line ends; other content is payload."""
    raw = bytes(block)
    if not raw.startswith(b"HTTP/"):
        return b"", raw
    end = _HEAD_END.search(raw)
    return (raw[: end.end()], raw[end.end() :]) if end else (raw, b"")


def _timestamp(date: str) -> str:
    d = (date + DATE[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(name: str, place: object, url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{name} {place} {url} {date} {digest}')}>"


def convert(image: bytes, name: str, keys: list[object] | None = None, firsts: list[tuple[object, str | None] | None] | None = None, strict: bool = True) -> Iterator[bytes]:
    """WARC records, without the closing separator, of an ARC image's records.

    HTTP responses become responses; what has no HTTP header, such as the answers of a name server, becomes a resource of
    its own content type, and the whole of it is the payload. What is no record raises, or is left out if not ``strict``.

    ``keys``: the caller's key of each record, by default the archive's name and the record's place.
    ``firsts``: for a record that revisits another, that one's key and URL.
    """
    for place, header, content, error in arc_records(image):
        if error:
            if strict:
                raise ValueError(error)
            continue
        head, payload = _split_http(content)
        kind = "application/http; msgtype=response" if head else re.sub(r"[\x00-\x1f\x7f-\U0010ffff]", "", header["Content-type"]) or "application/octet-stream"
        digest, url, date = hashlib.sha256(payload).hexdigest(), _recoded(header["URL"]), header["Archive-date"]
        key, first = f"{name}#{place}" if keys is None else keys[place], firsts[place] if firsts else None
        block = head if first else head + payload
        lines = [
            "WARC/1.1",
            f"WARC-Type: {'revisit' if first else 'response' if head else 'resource'}",
            f"WARC-Record-ID: {record_id('page', key, url, date, digest)}",
            f"WARC-Date: {_timestamp(date)}",
            f"WARC-Target-URI: {url}",
            f"WARC-IP-Address: {header['IP-address']}",
            f"Content-Type: {kind}",
            f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
            f"WARC-Payload-Length: {len(payload)}",
            f"WARC-Source: {name}",
            f"WARC-Page-Key: {'' if key is None else key}",
        ]
        if first:
            first_key, first_url = first[0], _clean(first[1])
            lines += [
                f"WARC-Profile: {PROFILE}",
                f"WARC-Refers-To: {record_id('page', first_key, first_url, date, digest)}",
                f"WARC-Refers-To-Target-URI: {first_url}",
                f"WARC-Refers-To-Date: {_timestamp(date)}",
                f"WARC-Refers-To-Key: {first_key}",
            ]
        lines.append(f"Content-Length: {len(block)}")
        yield ("\r\n".join(lines) + "\r\n\r\n").encode() + block


def _recoded(url: str) -> str:
    """An archive's URL with bytes that are not printable ASCII percent-encoded; others stay as they are."""
    return "".join(chr(b) if 32 < b < 127 else f"%{b:02X}" for b in url.encode("utf-8", "surrogateescape"))


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a WARC file, by their declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *rest = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in rest)
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it declares")
        yield headers, block
        at = end + 8 + size


def _placed(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html, size, and ``first``: the key and URL of the response that a page revisits, else null."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.octet_length(payload).alias("size"))
    small = rows.filter(F.col("size") < least)
    large = rows.filter(F.col("size") >= least).withColumn("digest", F.sha2(payload, 256))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    copies = large.groupBy("digest").agg(first, F.count(F.lit(1)).alias("copies")).filter((F.col("copies") > 1) & F.col("first").isNotNull())
    limit = max(POPULAR, pages.count() // MOST_POPULAR)
    popular = F.broadcast(copies.filter(F.col("copies") > limit).select("digest", F.col("first").alias("popular")))  # MOST_POPULAR rows at most
    marked = large.join(popular, "digest", "left")
    others = marked.filter("popular IS NULL").join(copies.filter(F.col("copies") <= limit).select("digest", "first"), "digest", "left")
    found = marked.filter("popular IS NOT NULL").withColumn("first", F.col("popular")).unionByName(others).drop("popular", "digest")
    return found.unionByName(small.withColumn("first", F.lit(None).cast(found.schema["first"].dataType)))


def write_archives(pages: DataFrame, path: str, least: int = MIN_REVISIT, compression: str = "gzip", file_bytes: int = FILE_BYTES) -> None:
    """Writes one WARC record per row of (page_id, url, html) to files under ``path``, a folder for each class of sizes."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            n, at, version = len(b["page_id"]), 0, 1
            while at < n:  # images of some megabytes, or of one page
                stop, held = at, 0
                while stop < n and stop - at < 256 and (stop == at or held + len(b["html"][stop]) <= 4 << 20):
                    held += len(b["html"][stop])
                    stop += 1
                ids, urls, texts, firsts = (b[c][at:stop] for c in ("page_id", "url", "html", "first"))
                name = f"pages-v{version}-{zlib.crc32(repr(ids).encode()):08x}.arc"
                image = arc_image(name, version, [(u, _http(t.encode("utf-8", "surrogatepass"))) for u, t in zip(urls, texts, strict=True)])
                refers = [None if f is None or f["page_id"] == i else (f["page_id"], f["url"]) for i, f in zip(ids, firsts, strict=True)]
                yield {"record": list(convert(image, name, ids, refers))}
                at, version = stop, 3 - version  # both versions are in use among old archives

    rows, low = _placed(pages, least), 0
    size = F.octet_length(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    there = {r[0] for r in pages.select(_class(size)).distinct().collect()} or {1}
    for k, high in enumerate(CLASSES):
        if k + 1 in there:
            records = map_rows(rows.filter((F.col("size") >= low) & (F.col("size") < high) if low else F.col("size") < high).select("page_id", "url", "html", "first"), "record binary", work)
            _write(records, f"{path}/{k}", max(1, file_bytes // (high + 4096)), compression)
        low = high


def _write(records: DataFrame, path: str, file_records: int, compression: str) -> None:
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", file_records).text(path)


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """archive, place, url, date, content_type, content, error of all records of the ARC files (``*.arc``, ``*.arc.gz``) under ``path``.

    What ``arc_records`` cannot read has an error, its bytes as content, and no url, date and content type; a file that
    cannot be unpacked has one such row, with what could be as content.
    """
    names = ("archive", "place", "url", "date", "content_type", "content", "error")

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for name, image, broken in _images(batches):
            rows = [(name, k, _recoded(h["URL"]), _timestamp(h["Archive-date"]), h["Content-type"].encode("utf-8", "surrogateescape").decode("utf-8", "replace"), bytes(c), None) if e is None else (name, k, None, None, None, bytes(c), e) for k, h, c, e in arc_records(image)]
            rows += [(name, len(rows), None, None, None, b"", broken)] if broken else []
            yield {n: [r[j] for r in rows] for j, n in enumerate(names)}

    return map_rows(_arc_files(spark, path), "archive string, place long, url string, date string, content_type string, content binary, error string", work)


def convert_archives(spark: SparkSession, path: str, target: str, compression: str = "gzip", file_bytes: int = FILE_BYTES) -> None:
    """Rewrites the ARC files under ``path`` as WARC files of about ``file_bytes`` under ``target``.

    HTTP answers become responses, others resources; what cannot be read is left out, and ``read_arcs`` tells what it was.
    """

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for name, image, _ in _images(batches):
            for record in convert(image, name, strict=False):
                yield {"record": [record]}

    scratch = Scratch(spark, "arc")
    records = scratch.save(map_rows(_arc_files(spark, path), "record binary", work).withColumn("size", F.octet_length("record")), "records")
    there, low = {r[0] for r in records.select(_class(F.col("size"))).distinct().collect()}, 0  # as many as there are classes
    for k, high in enumerate(CLASSES):
        if k + 1 in there:
            _write(records.filter((F.col("size") >= low) & (F.col("size") < high)).select("record"), f"{target}/{k}", max(1, file_bytes // high), compression)
        low = high
    scratch.clear()


def _class(size: F.Column) -> F.Column:
    """The number of a size's class, from 1; a size that equals a bound belongs to the next."""
    return F.lit(1) + sum(((size >= high).cast("int") for high in CLASSES[:-1]), F.lit(0))


def _arc_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{arc,arc.gz}").load(path).select("path", "content")


def _images(batches: Iterator[dict[str, list]]) -> Iterator[tuple[str, bytes, str | None]]:
    """(name, image, error) of files, one gzip member after the other where they are gzipped; of a broken one what comes before."""
    for b in batches:
        for path, raw in zip(b["path"], b["content"], strict=True):
            image, error = (raw, None) if raw[:2] != b"\x1f\x8b" else _unpacked(raw)
            yield path.rsplit("/", 1)[-1], image, error


def _unpacked(raw: bytes) -> tuple[bytes, str | None]:
    out: list[bytes] = []
    while raw.strip(b"\0"):
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(raw))
        except zlib.error as e:
            return b"".join(out), f"gzip: {e}"
        if not member.eof:
            return b"".join(out), "gzip: the last member is cut off"
        raw = member.unused_data
    return b"".join(out), None


def read_archives(spark: SparkSession, path: str, key: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_id, date, url of every record under ``path``.

    The payload of a response is measured and digested anew and checked against its headers; a revisit's come from its headers.
    """

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            for raw in b["content"]:
                out: dict[str, list] = {c: [] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id", "date", "url")}
                for h, block in read_warc(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["WARC-Payload-Length"])
                    if h["WARC-Type"] != "revisit":
                        payload = _split_http(block)[1]
                        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                            raise ValueError(f"{h['WARC-Record-ID']} does not fit its digest")
                    own, refers = h["WARC-Page-Key"], h.get("WARC-Refers-To-Key")
                    values = (own or None, size, digest, h["WARC-Type"], refers, h["WARC-Record-ID"], h.get("WARC-Refers-To"), h["WARC-Date"], h["WARC-Target-URI"])
                    for c, v in zip(out, values, strict=True):
                        out[c].append(v)
                yield out

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,gz}").load(path).select("content")
    out = map_rows(files, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string, refers_to_id string, date string, url string", work)
    return out.withColumns({"page_id": F.col("page_id").cast(key), "refers_to": F.col("refers_to").cast(key)})


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.path("archives"))
    return read_archives(spark, scratch.path("archives")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM f"""
