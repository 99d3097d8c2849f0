"""WARC archives of pages: written as one gzip stream, normalised to a member a record, and read.

``written`` makes archives: a portion of records each, compressed as one stream. ``normalised``
inflates an archive once, from its start, and rewrites every record as a gzip member of its own; the
side index has each record's offset and length, so one record can be read without the rest.
``read_back`` takes records by the index.

An archive is a row (name, content) of a table in the scratch folder and is of bounded size, so no
task holds more than one archive, and one record, at a time.

Of the records with equal payloads of ``least`` bytes or more, the one with the largest id is a
response and the others revisit it; they carry its id and the payload's length and digest, not the
payload. Only digests and ids are compared across pages; a common payload is one row a task then.

A record's id is made of the page's id and of the place of its row in the input, so pages with one id,
or none, have records of their own. All records are dated with one given time, so reruns agree.

Defined cases: null html is an empty payload; a null id is less than any other, so a page without one
revisits an equal page that has one, and refers to no page if none has; of equal pages with the
largest id the first in the input is the response, the others revisit it; empty tables give no
archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.shared import as_bytes, settled

#: Bytes of records that an archive takes before it is closed.
ARCHIVE_BYTES = 4 << 20
#: When the records say that they were written.
DATE = "2024-01-01T00:00:00Z"
_GZIP = 31
_LEVEL = 1
BREAK = b"\r\n"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None, row: int) -> bytes:
    return b"<urn:page:%s:%d>" % (b"" if page_id is None else b"%d" % page_id, row)


def record(
    page_id: int | None,
    row: int,
    url: str | None,
    payload: bytes,
    answer: tuple[int | None, int] | None = None,
    date: str = DATE,
) -> bytes:
    """A WARC 1.1 record; a revisit if ``answer``, the response's page id and row, is given."""
    revisit = answer is not None
    block = b"" if revisit else payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + _urn(page_id, row),
        b"WARC-Date: " + date.encode(),
        b"WARC-Target-URI: " + " ".join((url or "").split()).encode(),
        b"WARC-Payload-Digest: sha1:" + digest(payload).encode(),
        b"X-Payload-Length: %d" % len(payload),
    ]
    if revisit:
        head.append(b"WARC-Refers-To: " + _urn(*answer))
        head.append(
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        )
    head.append(b"Content-Length: %d" % len(block))
    return BREAK.join(head) + BREAK * 2 + block + BREAK * 2


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives from rows (page_id, url, html, row, answer): one gzip stream each."""
    task, serial, held, size = TaskContext.get().partitionId(), 0, [], 0
    packer = None

    def closed() -> pa.RecordBatch:
        nonlocal packer, held, size, serial
        content = b"".join([*held, packer.flush()])
        name = f"{task:06d}-{serial:06d}.warc.gz"
        packer, held, size, serial = None, [], 0, serial + 1
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([content], type=pa.binary())], names=["name", "content"]
        )

    for batch in batches:
        pages, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        places, answers = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        for k, html in enumerate(as_bytes(batch.column(2))):
            packer = packer or zlib.compressobj(_LEVEL, zlib.DEFLATED, _GZIP)
            answer = answers[k] and (answers[k]["page_id"], answers[k]["row"])
            raw = record(pages[k], places[k], urls[k], html or b"", answer)
            held.append(packer.compress(raw))
            size += len(raw)
            if size >= ARCHIVE_BYTES:
                yield closed()
    if packer:
        yield closed()


def records_of(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream that comes in pieces, whole and one after another."""
    data = b""
    wanted = None
    for piece in stream:
        data += piece
        while True:
            if wanted is None:
                end = data.find(BREAK * 2)
                if end < 0:
                    break
                wanted = end + 4 + int(fields(data[:end])["content-length"]) + 4
            if len(data) < wanted:
                break
            yield data[:wanted]
            data, wanted = data[wanted:], None
    if data.strip():
        raise ValueError("the archive ends within a record")


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a record's head, by lower-case name."""
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}


def inflated(content: bytes) -> Iterator[bytes]:
    """A gzip file's bytes in pieces; its members, one or many, in turn."""
    rest = content
    while rest:
        unpacker = zlib.decompressobj(_GZIP)
        while rest and not unpacker.eof:
            piece = unpacker.decompress(rest, 1 << 20)
            rest = unpacker.unconsumed_tail
            yield piece
        if not unpacker.eof:
            yield unpacker.flush()
            if not unpacker.eof:
                raise ValueError("the gzip stream is cut off")
        rest = unpacker.unused_data


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives with a member a record, and their side index (offset and length)."""
    for batch in batches:
        for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            members, offset, places = [], 0, []
            for raw in records_of(inflated(content)):
                packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, _GZIP)
                members.append(packer.compress(raw) + packer.flush())
                places.append({"offset": offset, "length": len(members[-1])})
                offset += len(members[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name]),
                    pa.array([b"".join(members)], type=pa.binary()),
                    pa.array(
                        [places],
                        type=pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])),
                    ),
                ],
                names=["name", "content", "index"],
            )


NORMALISED = "name string, content binary, index array<struct<offset: bigint, length: bigint>>"
READ = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string,"
    " refers_to bigint, url string, payload binary"
)


def _read(payloads: bool):
    """Records by the side index; a response's payload is checked against its head."""

    def number(urn: str | None) -> int | None:
        name = (urn or "").removeprefix("<urn:page:").partition(":")[0]
        return int(name) if name else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, content, index in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for place in index:
                    begin, end = place["offset"], place["offset"] + place["length"]
                    head, _, block = zlib.decompress(content[begin:end], _GZIP).partition(BREAK * 2)
                    own = fields(head)
                    payload = block[: int(own["content-length"])]
                    stated = own["warc-payload-digest"].removeprefix("sha1:")
                    if own["warc-type"] == "response" and digest(payload) != stated:
                        raise ValueError(f"record {own['warc-record-id']} is damaged")
                    rows.append(
                        (
                            number(own["warc-record-id"]),
                            int(own["x-payload-length"]),
                            stated,
                            own["warc-type"],
                            number(own.get("warc-refers-to")),
                            own["warc-target-uri"],
                            payload if payloads else None,
                        )
                    )
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                kinds += [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), type=kind) for c, kind in zip(columns, kinds, strict=True)],
                    names=[column.split()[0] for column in READ.split(", ")],
                )

    return read


def written(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives (name, content) of ``pages`` (page_id, url, html), a gzip stream each; settled."""
    html = "coalesce(html, '')"
    rows = pages.selectExpr(
        "page_id", "url", f"{html} as html", "monotonically_increasing_id() as row",
        f"if(octet_length({html}) >= {least}, sha1({html}), null) as sha",
    )
    rank = "struct(coalesce(page_id, -9223372036854775808L) as rank, -row as place, page_id, row)"
    first = (
        rows.groupBy("sha")
        .agg(F.expr(f"max({rank}) as first"), F.count("*").alias("copies"))
        .where("copies > 1")
        .selectExpr("sha as of", "struct(first.page_id as page_id, first.row as row) as first")
    )
    rows = rows.join(first, F.expr("sha = of"), "left").selectExpr(
        "page_id", "url", "html", "row", "if(row = first.row, null, first) as answer"
    )
    return settled(rows.mapInArrow(_archives, "name string, content binary"), "archives")


def normalised(archives: DataFrame) -> DataFrame:
    """Archives (name, content) with a member a record, and their side index; settled."""
    return settled(archives.mapInArrow(_normalised, NORMALISED), "normalised")


def read_back(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record of normalised archives; without ``payloads`` that column is null."""
    return archives.select("name", "content", "index").mapInArrow(_read(payloads), READ)
