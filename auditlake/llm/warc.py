"""Web pages as WARC archives: written with segments and revisits, read back and put together again.

A page becomes a ``response`` record whose block is an HTTP response with a chunked body, or a
``revisit`` of the response that holds the same payload. A block longer than a segment is continued in
``continuation`` records, which lie in a file of their own. Reading groups the segments of a record by
its origin's id, orders them by number, compares their joint length with the stated total, and takes
the chunked framing off.

Null payloads count as empty. A null page id or address is left out of the record and comes back as
null. Repeated rows are written and come back as often as they were given; of records with equal
payloads those with the largest page id are responses. Payloads of any length are written whole. An
empty table makes no files and no rows. A record with a missing or doubtful segment comes back with a
null payload and the reason in ``error``. Columns other than the three named ones are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.shared import shared_folder, stored

# Payloads from this size on are stored once.
REVISIT_BYTES = 1000
# A block's bytes in one record, a chunk's bytes in a body.
SEGMENT, CHUNK = 32_768, 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORD = (
    "type string, record_id string, page_id bigint, uri string, refers_to string, digest string, "
    "origin string, number int, total bigint, block binary"
)
PAGE = "type string, record_id string, page_id bigint, uri string, refers_to string, digest string, payload binary, error string"


# --- one record ---------------------------------------------------------------------


def record_id(page_id: int | None, digest: bytes) -> str:
    name = b"%s/%s" % (b"" if page_id is None else str(page_id).encode(), digest)
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(name).digest(), version=5)}>"


def chunked(payload: bytes) -> bytes:
    parts = (payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK))
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; an error if the framing is broken or has no end."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without end")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response, whether its body is chunked or plain."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("response without a body")
    fields = dict(line.lower().split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return unchunked(body) if fields.get(b"transfer-encoding", b"").strip() == b"chunked" else body


def _record(kind: str, block: bytes, **fields: object) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    lines += [f"{name.replace('_', '-')}: {value}" for name, value in fields.items() if value is not None]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 1, mtime=0)


def records_of(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields, with names in lower case, and block of every record of an archive."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:60]!r}")
        fields = {}
        while (line := file.readline().strip()) :
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, file.read(int(fields["content-length"]))


# --- writing ------------------------------------------------------------------------


def write(pages: DataFrame, page_id: str = "page_id", uri: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page to archives in a new shared folder; a row per archive, with its path."""
    folder = shared_folder(pages.sparkSession, "warc")
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(uri).alias("uri"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    large = F.octet_length("payload") >= REVISIT_BYTES
    shared = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1")
    dealt = rows.join(shared.drop("n"), "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        name, first, rest = uuid.uuid4().hex, None, None
        for batch in batches:
            if first is None:
                first = files.open_output_stream(f"{root}/{name}-1.warc.gz", compression=None)
                rest = files.open_output_stream(f"{root}/{name}-2.warc.gz", compression=None)
            for row in batch.to_pylist():
                _write_page(row, date, first, rest)
        if first is not None:
            first.close()
            rest.close()
            yield pa.RecordBatch.from_pydict({"folder": [folder] * 2, "name": [f"{name}-1.warc.gz", f"{name}-2.warc.gz"]})

    return stored(dealt.select("page_id", "uri", "payload", "digest", "holder").mapInArrow(run, "folder string, name string"), "archives")


def _write_page(row: dict, date: str, first, rest) -> None:
    page, holder, digest = row["page_id"], row["holder"], row["digest"]
    own = record_id(page, digest)
    fields = {
        "WARC_Record_ID": own, "WARC_Date": date, "WARC_Target_URI": row["uri"], "Page_ID": page,
        "WARC_Payload_Digest": "sha1:" + base64.b32encode(digest).decode(),
        "Content_Type": "application/http; msgtype=response",
    }
    if holder is not None and holder != page:
        first.write(_record("revisit", HTTP_HEAD, **fields, WARC_Profile=PROFILE, WARC_Refers_To=record_id(holder, digest)))
        return
    block = HTTP_HEAD + chunked(row["payload"])
    if len(block) <= SEGMENT:
        first.write(_record("response", block, **fields))
        return
    first.write(_record("response", block[:SEGMENT], **fields, WARC_Segment_Number=1))
    for number, at in enumerate(range(SEGMENT, len(block), SEGMENT), start=2):
        last = at + SEGMENT >= len(block)
        rest.write(_record(
            "continuation", block[at : at + SEGMENT],
            WARC_Record_ID=f"<urn:uuid:{uuid.uuid4()}>", WARC_Date=date, WARC_Segment_Origin_ID=own,
            WARC_Segment_Number=number, WARC_Segment_Total_Length=len(block) if last else None,
        ))


# --- reading ------------------------------------------------------------------------


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def read_records(archives: DataFrame) -> DataFrame:
    """A row per record of the archives, as they stand in the files."""
    schema = archives.sparkSession.createDataFrame([], RECORD).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        for batch in batches:
            for archive in batch.to_pylist():
                files, root = pyarrow.fs.FileSystem.from_uri(archive["folder"])
                with files.open_input_file(f"{root}/{archive['name']}") as raw, gzip.GzipFile(fileobj=raw) as file:
                    yield from _batches((_read(*record) for record in records_of(file)), names)

    # Archives hold about as much as a task reads; each is dealt to a task of its own.
    count = max(1, archives.count())
    dealt = archives.withColumn("nr", F.row_number().over(Window.orderBy("name")) - 1).repartitionById(count, F.col("nr"))
    return dealt.select("folder", "name").mapInArrow(run, RECORD)


def _read(fields: dict[str, str], block: bytes) -> tuple:
    get = fields.get
    return (
        get("warc-type"), get("warc-record-id"), _number(get("page-id")), get("warc-target-uri"),
        get("warc-refers-to"), get("warc-payload-digest"), get("warc-segment-origin-id"),
        _number(get("warc-segment-number")), _number(get("warc-segment-total-length")), block,
    )


def _batches(rows: Iterator[tuple], names: list[str], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    kinds = {"page_id": pa.int64(), "number": pa.int32(), "total": pa.int64(), "block": pa.binary(), "payload": pa.binary()}
    held, size = [], 0

    def made() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names=names)

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes)) + 200
        if size >= most:
            yield made()
            held, size = [], 0
    if held:
        yield made()


_PAGE_NAMES = ["type", "record_id", "page_id", "uri", "refers_to", "digest", "payload", "error"]


def _page(head: dict, block: bytes | None, error: str | None) -> tuple:
    payload = None
    if error is None and head["type"] == "response":
        try:
            payload = payload_of(block)
        except ValueError as broken:
            error = str(broken)
    return (*(head[n] for n in _PAGE_NAMES[:6]), payload, error)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _batches((_page(row, row["block"], None) for row in batch.to_pylist()), _PAGE_NAMES)


def _join_segments(segments: list[dict]) -> Iterator[tuple]:
    """The record of segments with one origin; repeated records come back as often as they were written."""
    heads = [s for s in segments if s["number"] == 1 and s["type"] != "continuation"]
    by_number = {s["number"]: s for s in segments}
    total = next((s["total"] for s in segments if s["total"] is not None), None)
    block = b"".join(by_number[n]["block"] for n in sorted(by_number))
    error = None
    if sorted(by_number) != list(range(1, len(by_number) + 1)):
        error = "segment missing"
    elif total is None:
        error = "no last segment"
    elif total != len(block):
        error = f"length {len(block)}, not {total}"
    for head in heads:
        yield _page(head, block, error)
    if not heads:
        lost = dict.fromkeys(_PAGE_NAMES) | {"record_id": segments[0]["origin"], "type": "response"}
        yield _page(lost, None, "first segment missing")


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        held: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if held and held[0]["origin"] != row["origin"]:
                    yield from _join_segments(held)
                    held = []
                held.append(row)
        if held:
            yield from _join_segments(held)

    yield from _batches(rows(), _PAGE_NAMES)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole responses and revisits from records, with the payload free of framing."""
    whole = records.filter("number IS NULL AND type IN ('response', 'revisit')").mapInArrow(_whole, PAGE)
    parts = records.filter("number IS NOT NULL").withColumn("origin", F.coalesce("origin", "record_id"))
    joined = parts.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(_segmented, PAGE)
    return whole.unionByName(joined)


def read_pages(archives: DataFrame) -> DataFrame:
    """A row per page: size and digest of the full payload, and for a revisit the page it refers to.

    Payloads themselves are in ``reassemble(read_records(archives))``.
    """
    pages = reassemble(read_records(archives)).select(
        "type", "record_id", "page_id", "refers_to", "error",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )
    # Both sides below read these narrow rows, not the archives.
    kept = stored(pages, "pages")
    shape = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"]
    responses = kept.filter("type = 'response'").withColumns({"record_type": F.col("type"), "refers_to": F.lit(None).cast("bigint")})
    wanted = kept.filter("type = 'revisit'").select("page_id", F.col("refers_to").alias("target"), "error")
    targets = responses.groupBy(F.col("record_id").alias("target")).agg(
        F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest")
    )
    revisits = wanted.join(targets, "target", "left").withColumns({
        "record_type": F.lit("revisit"),
        "error": F.coalesce("error", F.when(F.col("payload_digest").isNull(), "response missing")),
    })
    return responses.select(shape).unionByName(revisits.select(shape))
