"""Legacy archive converter: ARC files to WARC records, written and read back.

ARC: each file begins with a version block whose second line names the version, and each record is one header line and as many
bytes as it declares. Version 1 lines have five fields (url, address, date, type, length), version 2 lines ten (result code,
checksum, location, offset and file name stand between type and length).

WARC: each ARC record becomes a ``response`` with an identifier derived from its file and place in it, the date as ISO time, and the
payload's SHA-1. Payloads are bytes throughout and need not be text. Of records with equal payloads of at least ``REVISIT_BYTES`` the one of the largest page is the response and the
others become ``revisit`` records that name it. Which one that is is found from digests alone (an aggregate with partial sums and
a join back), so payloads are not grouped. Records are written through Spark's text sink into gzip files in the shared folder; a
file ends with the record that brings it to ``FILE_BYTES``, so that it and a reader's memory are bounded by that and one record. Reading
takes whole files, follows declared lengths and checks digests.

Cases: NULL html is an empty payload, a NULL url is written as ``-``, white space in a url is percent-encoded, as are its bytes where
they are not UTF-8. Header lines are read around the date, so spaces in a url or type do no harm. Rows without a
page id take part and are never preferred; repeated rows of the largest page are all responses, each with an identifier of its own, and
revisits name the last of them. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.plans.materialize import fresh_path, materialize

REVISIT_BYTES = 1000
FILE_BYTES = 16_000_000
ARC_RECORDS = 64
DATE = "20000101000000"  # of pages, which carry no fetch time
# The field lines that name the two versions' header lines.
FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
# A header line: url, address, date, type, what version 2 adds, length.
LINES = {v: re.compile(r"(.*) (\S+) (\d{14}) (.*)" + r" \S+" * (len(names.split()) - 5) + r" (\d+)") for v, names in FIELDS.items()}
END = b"\r\n\r\n"


def _plain(url: str | None) -> str:
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "".join(chr(b) if b < 128 else f"%{b:02X}" for b in raw)


def arc_file(name: str, rows, version: str = "1", date: str = DATE) -> bytes:
    """An ARC file of (page_id, url, html) rows; the page id stands in the address field as an IPv6-like suffix."""
    block = f"{version} 0 archive\n{FIELDS[version]}\n"
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain {'' if version == '1' else '200 - - 0 ' + name + ' '}{len(block)}\n{block}\n".encode()]
    for page, url, html in rows:
        body = html if isinstance(html, bytes) else (html or "").encode()
        host = "-" if page is None or page != page else str(int(page))
        between = "" if version == "1" else f" 200 - - {sum(map(len, out))} {name}"
        out.append(f"{_plain(url)} {host} {date} text/html{between} {len(body)}\n".encode() + body + b"\n")
    return b"".join(out)


def read_arc(raw: bytes) -> Iterator[tuple[int, str, str, str, str, bytes]]:
    """(offset, url, address, date, type, payload) of each record, by the version that the file declares."""
    at = 0
    version = None
    while at < len(raw):
        stop = raw.index(b"\n", at)
        line = _text(raw[at:stop].rstrip(b"\r"))
        size = int(line.rsplit(" ", 1)[-1])
        body = raw[stop + 1 : stop + 1 + size]
        if len(body) != size:
            raise ValueError("the record is shorter than declared")
        if version is None:
            version = body.split(b" ", 1)[0].decode()
            if version not in FIELDS:
                raise ValueError(f"no ARC version {version!r}")
        elif (found := LINES[version].fullmatch(line)) is None:
            raise ValueError(f"not a header line of version {version}: {line!r}")
        else:
            yield at, _plain(found[1]), found[2], found[3], found[4], body
        at = stop + 1 + size + 1


def to_arc(pages: DataFrame, version: str = "1") -> DataFrame:
    """(name, arc): ARC files of ``ARC_RECORDS`` pages each, named by partition and number."""

    def pack(batches):
        number = 0
        for batch in batches:
            out = []
            for lo in range(0, len(batch), ARC_RECORDS):
                part = batch.iloc[lo : lo + ARC_RECORDS]
                name = f"{TaskContext.get().partitionId():06d}-{number:08d}.arc"
                number += 1
                out.append((name, arc_file(name, zip(part["page_id"], part["url"], part["html"], strict=True), version)))
            yield pd.DataFrame(out, columns=["name", "arc"])

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    return rows.mapInPandas(pack, "name string, arc binary")


def records(archives: DataFrame) -> DataFrame:
    """The records of ARC files (columns ``name`` and ``arc``): name, offset, url, address, date, type, payload_bytes, digest, payload."""
    names = ["name", "offset", "url", "address", "date", "type", "payload_bytes", "digest", "payload"]

    def parse(batches):
        for batch in batches:
            for name, raw in zip(batch["name"], batch["arc"], strict=True):
                out = [(name, o, u, a, d, t, len(p), hashlib.sha1(p).hexdigest(), p) for o, u, a, d, t, p in read_arc(bytes(raw))]
                yield pd.DataFrame(out, columns=names)

    schema = "name string, offset long, url string, address string, date string, type string, payload_bytes long, digest string, payload binary"
    return archives.select("name", "arc").mapInPandas(parse, schema)


def warc_files(arcs: DataFrame) -> DataFrame:
    """WARC records of the records of ARC files, as many in a row (``value``, bytes) as make a file."""
    found = records(arcs).withColumns({"page_id": F.expr("try_cast(address as bigint)"), "place": F.concat_ws(" ", "name", "offset")})
    largest = F.max(F.struct("page_id", "place")).alias("first")
    groups = found.where(f"payload_bytes >= {REVISIT_BYTES}").groupBy("digest", "payload_bytes").agg(largest, F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups, "payloads")  # read back, the join may split a payload that many records hold
    joined = found.join(groups.select("digest", "payload_bytes", "first"), ["digest", "payload_bytes"], "left")
    revisit = F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))

    def write(batches):
        held, size = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                held.append(_record(*r))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield pd.DataFrame({"value": [END.join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"value": [END.join(held)]})

    return joined.select("place", "url", "address", "date", "type", "payload_bytes", "digest", F.when(~revisit, F.col("payload")).alias("payload"),
                         F.when(revisit, F.col("first.place")).alias("refers"), F.when(revisit, F.col("first.page_id").cast("string")).alias("page")).mapInPandas(write, "value binary")


def _identifier(place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"


def _record(place, url, address, date, kind, size, digest, payload, refers, page) -> bytes:
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    time = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    again = isinstance(refers, str)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {_identifier(place)}", f"WARC-Date: {time}",
            f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Page: {address}", f"X-Payload-Length: {size}"]
    if again:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_identifier(refers)}", f"X-Refers-To-Page: {page}"]
    head += [f"Content-Type: {kind}", f"Content-Length: {0 if again else size}"]
    return "\r\n".join(head).encode() + END + (b"" if again else bytes(payload or b""))


def write_warc(arcs: DataFrame, path: str) -> None:
    """The records of ARC files as gzip WARC files under ``path``."""
    # Text is written as the bytes it holds, UTF-8 or not.
    options = {"lineSep": END.decode(), "compression": "gzip", "maxRecordsPerFile": 1}
    warc_files(arcs).select(F.col("value").cast("string")).write.options(**options).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to, record_id, date and payload of each record."""

    def parse(batches):
        for batch in batches:
            for raw in batch["content"]:
                out = list(_read(gzip.decompress(bytes(raw))))
                for lo in range(0, len(out), 256):
                    yield pd.DataFrame(out[lo : lo + 256], columns=names)

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string, date string, payload binary"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    out = files.mapInPandas(parse, schema)
    return out.withColumns({c: F.expr(f"try_cast({c} as bigint)") for c in ("page_id", "refers_to")})


def _read(raw: bytes):
    stream = io.BytesIO(raw)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            head[name.lower()] = value
        size = int(head["content-length"])
        body = stream.read(size)
        if len(body) != size or stream.read(4) != END:
            raise ValueError("the record is not as long as declared")
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        kind = head["warc-type"]
        if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
            raise ValueError("the payload has another digest")
        yield (head["x-page"], head["warc-target-uri"], int(head["x-payload-length"]), digest, kind, head.get("x-refers-to-page"),
               head["warc-record-id"], head["warc-date"], body if kind == "response" else None)


def archive(pages: DataFrame, version: str = "1") -> DataFrame:
    """``pages`` (page_id, url, html) as ARC files, converted to WARC in the shared folder and read back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_warc(materialize(to_arc(pages, version), "arcs"), path)  # read twice, with the same names and places
    return read_warc(pages.sparkSession, path)
