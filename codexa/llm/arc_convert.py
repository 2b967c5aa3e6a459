"""Legacy archive converter: ARC (version 1 and 2) to WARC 1.1.

An ARC file opens with a version block whose second line says which fields a header line has; each record is such a
line, then as many bytes as its last field declares, then a newline. From these the converter synthesises what WARC
asks for and ARC lacks: record identifiers (from the archive's name, the record's place in it, its URL and date), ISO
timestamps, record types and digests. Archives are binary columns of bounded size, gzip members or plain, so they are
written and read by Spark alone and any store will do.

A row's number travels beside that identity: in a head field of the archives written here, and in fields of the WARC
records. Archives of others have none.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import hot_safe_join, slices, written

#: The header fields of the two ARC versions.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Payloads from this size on are stored once.
REVISIT_FROM = 100
ARCHIVE_BYTES = 4 << 20
EPOCH = "20240101000000"
NUMBER_HEADER = "X-Record-Number"
RECORD_SCHEMA = "record_id string, number long, place long, url string, warc_date string, mime string, http_headers binary, payload binary, payload_bytes long, payload_digest string"
READ_SCHEMA = "record_id string, number long, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, refers_to_number long, payload binary"


def _word(value: str | None) -> str:
    """A header field: no blanks or control characters, never empty."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "") or "-"


def write_arc(name: str, rows: list[tuple[int | None, str | None, bytes]], version: int) -> bytes:
    """An ARC file of one HTTP response a row (number, URL, body)."""
    block = f"{version} 0 codexa\n{' '.join(FIELDS[version])}\n".encode()
    last = " ".join(["text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(block))])
    parts = [f"filedesc://{name} 0.0.0.0 {EPOCH} {last}\n".encode(), block, b"\n"]
    at = sum(map(len, parts))
    for number, url, body in rows:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{NUMBER_HEADER}: {'-' if number is None else number}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        size = len(http) + len(body)
        middle = f"200 - - {at} {name} " if version == 2 else ""
        parts += [line := f"{_word(url)} 0.0.0.0 {EPOCH} text/html {middle}{size}\n".encode(), http, body, b"\n"]
        at += len(line) + size + 1
    return b"".join(parts)


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str, int]]:
    """The header fields and the block of each record, the archive's name and the record's place, without the version block.

    Raises ValueError where a line has other fields than its version declares, a length runs past the end or a date is none.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, version, name = 0, 0, ""
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line without end at byte {at}")
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        size = int(values[-1]) if values[-1].isdigit() else -1
        if size < 0 or end + 1 + size > len(data):
            raise ValueError(f"ARC length that doesn't fit at byte {at}")
        block = data[end + 1 : end + 1 + size]
        if not version:
            first = block.split(b" ", 1)[0]
            version = int(first) if values[0].startswith("filedesc:") and first.isdigit() else 0
            if version not in FIELDS:
                raise ValueError("no ARC version block")
            name = values[0]
        elif len(values) != len(FIELDS[version]):
            raise ValueError(f"ARC {version} header line with {len(values)} fields at byte {at}")
        else:
            fields = dict(zip(FIELDS[version], values, strict=True))
            if not fields["Archive-date"].isdigit() or len(fields["Archive-date"]) < 8:
                raise ValueError(f"no ARC date at byte {at}")
            yield fields, block, name, at
        at = end + 1 + size


def _http(block: bytes) -> tuple[bytes, bytes, dict[str, str]] | None:
    """The HTTP head with its blank line, the body, the head's fields in lower case; None where the block is no response."""
    if not block.startswith(b"HTTP/"):
        return None
    ends = [(i + len(x), x) for x in (b"\r\n\r\n", b"\n\n") if (i := block.find(x)) >= 0]
    end = min(ends)[0] if ends else len(block)
    lines = block[:end].decode("latin-1").replace("\r\n", "\n").split("\n")[1:]
    return block[:end], block[end:], {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def warc_record(kind: str, record: dict, first: dict | None = None) -> bytes:
    """One WARC record of the columns RECORD_SCHEMA; a revisit of `first` (record_id, number, url, warc_date) keeps the HTTP head alone."""
    http, payload = record["http_headers"], record["payload"] or b""
    block = (http or b"") if kind == "revisit" else (http or b"") + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record['record_id']}>", f"WARC-Target-URI: {record['url']}", f"WARC-Date: {record['warc_date']}",
        f"WARC-Payload-Digest: sha256:{record['payload_digest']}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Type: {'application/http; msgtype=response' if http is not None else record['mime']}", f"X-Payload-Length: {len(payload)}",
    ]
    if record["number"] is not None:
        head.append(f"{NUMBER_HEADER}: {record['number']}")
    if first:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{first['record_id']}>", f"WARC-Refers-To-Target-URI: {first['url']}", f"WARC-Refers-To-Date: {first['warc_date']}"]
        if first["number"] is not None:
            head.append(f"X-Refers-To-Number: {first['number']}")
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The named fields and the block of each record; ValueError where the file doesn't follow the format."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        size = fields.get("Content-Length", "")
        stop = end + 4 + int(size) if size.isdigit() else -1
        if not lines[0].startswith("WARC/") or stop < 0 or data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"not a WARC record at byte {at}")
        yield fields, data[end + 4 : stop]
        at = stop + 4


def arc_archives(rows: DataFrame, number: str, url: str, body: str) -> DataFrame:
    """ARC archives (name, arc) of all rows; versions 1 and 2 take turns. A null body is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(slices(batches, body, ARCHIVE_BYTES)):
            own = [(i, u, (t or "").encode()) for i, u, t in zip(*(b.column(c).to_pylist() for c in (number, url, body)), strict=True)]
            name = f"part-{part:06d}-{k:06d}.arc"
            yield pa.RecordBatch.from_pydict({"name": [name], "arc": [write_arc(name, own, 1 + k % 2)]})

    return rows.select(F.col(number).cast("long"), url, body).mapInArrow(run, "name string, arc binary")


def arc_records(archives: DataFrame, arc: str = "arc", payloads: bool = True) -> DataFrame:
    """What a WARC record needs of each ARC record: RECORD_SCHEMA. Without payloads these columns are null.

    A record that is no HTTP response has no http_headers, and its whole block is its payload. Null archives give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(arc).to_pylist():
                out: list[tuple] = []
                for fields, block, name, place in read_arc(data or b""):
                    http, payload, named = _http(block) or (None, block, {})
                    d = fields["Archive-date"].ljust(14, "0")
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{name} {place} {fields['Archive-date']} {fields['URL']}").urn
                    digest = hashlib.sha256(payload).hexdigest()
                    out.append((own, _number(named.get(NUMBER_HEADER.lower())), place, fields["URL"], date, fields["Content-type"], http if payloads else http and b"", payload if payloads else None, len(payload), digest))
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in RECORD_SCHEMA.split(", ")])

    return archives.select(arc).mapInArrow(run, RECORD_SCHEMA)


def to_warc(archives: DataFrame) -> DataFrame:
    """WARC archives (warc) of all records of ARC archives, each HTTP payload of REVISIT_FROM bytes or more stored once.

    The first record of a payload is its response, the others revisit it: the first by number, where archives have numbers
    (records without one come after), else by date, place and identifier. Rows that repeat the smallest number are responses
    each. Records of other protocols are resources, always stored. Empty and null archives give none.
    """
    small = arc_records(archives, payloads=False).where((F.col("payload_bytes") >= REVISIT_FROM) & F.col("http_headers").isNotNull())
    by = F.struct(F.col("number").isNull().alias("no_number"), "number", "warc_date", "place", "record_id", "url")
    firsts = small.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("rows"), F.min(by).alias("first")).where("rows > 1")
    firsts = written(firsts, "payloads")
    typed = hot_safe_join(arc_records(archives), firsts.select("payload_digest", "first"), "payload_digest", firsts.select("payload_digest", "rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "payload", ARCHIVE_BYTES):
            out = []
            for r in b.to_pylist():
                first, key = r["first"], "record_id" if r["number"] is None else "number"
                again = first and r["http_headers"] is not None and r["payload_bytes"] >= REVISIT_FROM and first[key] != r[key]
                out.append(warc_record("resource" if r["http_headers"] is None else "revisit" if again else "response", r, first if again else None))
            yield pa.RecordBatch.from_pydict({"warc": [b"".join(out)]})

    return typed.mapInArrow(run, "warc binary")


def warc_records(archives: DataFrame, warc: str = "warc", payloads: bool = True) -> DataFrame:
    """READ_SCHEMA for each record read; stored payloads are held against their digests (ValueError if they differ).

    A revisit's payload is null; its size is null too where neither an extension field nor the HTTP head tells it. Null
    archives give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(warc).to_pylist():
                out: list[tuple] = []
                for fields, block in read_warc(data or b""):
                    _, payload, named = _http(block) or (b"", block, {})
                    kind, digest = fields.get("WARC-Type", ""), fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
                    size = len(payload) if kind != "revisit" else _number(fields.get("X-Payload-Length") or named.get("content-length"))
                    found = hashlib.sha256(payload).hexdigest() if kind != "revisit" else digest
                    if digest and found != digest:
                        raise ValueError(f"damaged payload of {fields.get('WARC-Record-ID')}")
                    own, refers = (fields[k].strip("<>") if k in fields else None for k in ("WARC-Record-ID", "WARC-Refers-To"))
                    out.append((own, _number(fields.get(NUMBER_HEADER)), fields.get("WARC-Target-URI"), kind, size, found, refers, _number(fields.get("X-Refers-To-Number")), payload if payloads and kind != "revisit" else None))
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=[x.split()[0] for x in READ_SCHEMA.split(", ")])

    return archives.select(warc).mapInArrow(run, READ_SCHEMA)


def convert(rows: DataFrame, number: str, url: str, body: str, payloads: bool = True) -> DataFrame:
    """Rows as ARC archives, converted to WARC archives in the shared folder and read back (READ_SCHEMA).

    Null bodies are empty, a null URL is `-`, a null number stays null; other columns play no part; no rows give none.
    """
    return warc_records(written(to_warc(arc_archives(rows, number, url, body)), "warc"), payloads=payloads)
