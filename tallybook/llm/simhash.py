"""SimHash fingerprints of whole texts, and all fingerprints within a Hamming radius.

Terms are runs of ``size`` words; a term weighs 1 + ln of how often it occurs. The hash of a term
votes for or against each of the 128 bits with its weight. The likeness of two fingerprints is the
share of equal bits.

The search keeps ``radius + 1`` tables, each with another block of the bits permuted to the front as
its key: fingerprints within the radius agree on one block at least. A pair is reported by the first
table whose block it agrees on, so no pair is made twice. Equal fingerprints are one row with a
count.

Defined cases: null texts count as empty; texts without words have the fingerprint of zeros; equal
texts have equal fingerprints, whatever their ids; a null id counts as the least; repeated rows are
rows each, in the order of their ids and then of their text hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.shared import as_bytes, settled
from tallybook.llm.tokens import blocks, mixed

BITS = 128
SIZE = 2
#: Rows that one task orders at a time.
BUCKET_ROWS = 20_000
_CHUNK = 4096


def fingerprints(texts: list[bytes | None]) -> Iterator[bytes]:
    """The fingerprint of each text, 16 bytes."""
    for _, words in blocks(texts):
        terms, bounds = words.shingles(SIZE)
        for a, b in zip(bounds, bounds[1:], strict=False):
            own = np.sort(terms[a:b])
            begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if b > a else []
            if not len(begins):
                yield bytes(BITS // 8)
                continue
            times = np.diff(np.append(begins, len(own)))
            # Whole numbers, so that sums do not depend on their order.
            weights = np.rint(16 * (1 + np.log(times))).astype(np.float32)
            own = own[begins]
            halves = np.stack((mixed(own, 51), mixed(own, 52)), axis=1).view(np.uint8)
            votes = np.zeros(BITS)
            for start in range(0, len(own), _CHUNK):
                bits = np.unpackbits(halves[start : start + _CHUNK], axis=1).astype(np.float32)
                votes += weights[start : start + _CHUNK] @ bits
            yield np.packbits(2 * votes > weights.sum(dtype=np.float64)).tobytes()


def _printed(edges: list[int], tops: dict[int, tuple[int, int]]):
    """Rows with bucket and fingerprint; the first row of a bucket also ends the bucket before it.

    Buckets go by descending id between ``edges``; ``tops`` has the first (id, tie) of each bucket.
    """
    order = sorted(tops, reverse=True)
    before = {bucket: order[k - 1] for k, bucket in enumerate(order)}  # the first ends the last
    firsts = {first: before[bucket] for bucket, first in tops.items()}

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(1).to_numpy()
            bucket = np.searchsorted(edges, place, side="right")
            prints = pa.array(list(fingerprints(as_bytes(batch.column(3)))), type=pa.binary())
            keys = list(zip(place.tolist(), batch.column(2).to_pylist(), strict=True))
            first = [k for k, key in enumerate(keys) if key in firsts]
            columns = [*batch.columns, prints]
            names = [*batch.schema.names, "print", "bucket", "copy"]
            zeros = np.zeros(batch.num_rows, dtype=bool)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bucket), pa.array(zeros)], names)
            if first:
                moved = pa.array([firsts[keys[k]] for k in first], type=pa.int64())
                rows = [column.take(pa.array(first)) for column in columns]
                ones = pa.array(np.ones(len(first), dtype=bool))
                yield pa.RecordBatch.from_arrays([*rows, moved, ones], names)

    return printed


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Likenesses; columns doc_id, n_chars, edited_sha256, print, next_print, edited."""

    def likeness(left: list[bytes], right: list[bytes]) -> pa.Array:
        a, b = (np.frombuffer(b"".join(x), dtype=np.uint64).reshape(-1, 2) for x in (left, right))
        return pa.array(1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS)

    for batch in batches:
        own, after = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        edited = list(fingerprints(as_bytes(batch.column(5))))
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:3],
                pa.array([x.hex() for x in own]),
                pa.array([x.hex() for x in edited]),
                likeness(own, edited),
                likeness(own, after),
            ],
            names=[column.split()[0] for column in EDITED.split(", ")],
        )


EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, near_edited double, near_next double"
)


def _buckets(documents: DataFrame) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Edges that split the ids evenly, and the first (id, tie) in each bucket.

    The driver gets two numbers for every ``BUCKET_ROWS`` documents.
    """
    places = documents.select("place")
    count = places.count() // BUCKET_ROWS
    shares = [k / (count + 1) for k in range(1, count + 1)]
    edges = places.approxQuantile("place", shares, 0.2 / (count + 1)) if shares else []
    edges = sorted(set(map(int, edges)))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = np.searchsorted(edges, batch.column(0).to_numpy(), side="right")
            columns = [pa.array(bucket), *batch.columns]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "place", "tie"])

    tops = (
        documents.select("place", "tie")
        .mapInArrow(numbered, "bucket bigint, place bigint, tie bigint")
        .groupBy("bucket")
        .agg(F.max(F.struct("place", F.expr("-1 - tie as tie"))).alias("top"))
    )
    return edges, {row.bucket: (row.top.place, -1 - row.top.tie) for row in tops.collect()}


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): fingerprints of its text and of its edited text.

    The edited text has its last half of code points replaced by as many first ones of the next
    document by descending id (the first, after the last). A text travels once: tasks take ranges of
    ids, and the first row of a range is copied to the end of the range before.
    """
    rows = documents.selectExpr(
        "doc_id",
        "coalesce(doc_id, -9223372036854775808L) as place",
        "xxhash64(text) as tie",
        "coalesce(text, '') as text",
    )
    edges, tops = _buckets(rows)
    schema = (
        "doc_id bigint, place bigint, tie bigint, text string, print binary, bucket bigint,"
        " copy boolean"
    )
    after = Window.partitionBy("bucket").orderBy("copy", F.desc("place"), "tie")
    half = "cast(length(text) div 2 as int)"
    return (
        rows.mapInArrow(_printed(edges, tops), schema)
        .withColumn("next_text", F.lead("text").over(after))
        .withColumn("next_print", F.lead("print").over(after))
        .where("not copy")
        .withColumn(
            "edited",
            F.expr(
                f"concat(substring(text, 1, length(text) - {half}), substring(next_text, 1, {half}))"
            ),
        )
        .selectExpr(
            "doc_id",
            "cast(length(text) as bigint) as n_chars",
            "sha2(cast(edited as binary), 256) as edited_sha256",
            "print",
            "next_print",
            "edited",
        )
        .mapInArrow(_edited, EDITED)
    )


def within_radius(queries: DataFrame, known: DataFrame, radius: int = 7) -> DataFrame:
    """All pairs (fingerprint, near, n) of distinct fingerprints, hex, within ``radius`` bits.

    ``queries`` and ``known`` have a column fingerprint; ``n`` rows of ``known`` have ``near``.
    """
    digits, blocks_ = BITS // 4, radius + 1
    edges = [digits * k // blocks_ for k in range(blocks_ + 1)]

    def block(name: str, k: int) -> str:
        return f"substring({name}, {edges[k] + 1}, {edges[k + 1] - edges[k]})"

    def tables(rows: DataFrame, name: str) -> DataFrame:
        keys = ", ".join(f"struct({k} as k, {block(name, k)} as v)" for k in range(blocks_))
        return rows.selectExpr("*", f"explode(array({keys})) as key_{name}")

    def half(name: str, at: int) -> str:
        return f"cast(conv(substring({name}, {at}, 16), 16, -10) as bigint)"

    wanted = tables(queries.selectExpr("fingerprint as own").distinct(), "own")
    index = tables(known.groupBy(F.expr("fingerprint as near")).agg(F.count("*").alias("n")), "near")
    apart = " + ".join(f"bit_count({half('own', at)} ^ {half('near', at)})" for at in (1, 17))
    before = " or ".join(
        ["false"]
        + [f"(key_own.k > {k} and {block('own', k)} = {block('near', k)})" for k in range(radius)]
    )
    return (
        wanted.join(index, F.expr("key_own = key_near"))
        .where(f"not ({before}) and {apart} <= {radius}")
        .selectExpr("own as fingerprint", "near", "n")
    )


def fingerprint_report(documents: DataFrame, radius: int = 7, every: int = 100) -> DataFrame:
    """Edited fingerprints, and for ids divisible by ``every`` the rows within ``radius`` of it."""
    rows = settled(edited_fingerprints(documents), "fingerprints")
    asked = rows.where(f"doc_id % {every} = 0")
    near = within_radius(asked, rows, radius).groupBy("fingerprint").agg(
        F.sum("n").alias("rows_within")
    )
    asked = asked.select("doc_id", "fingerprint").distinct().join(near, "fingerprint")
    asked = asked.selectExpr("doc_id as asked_id", "fingerprint as asked_print", "rows_within")
    return rows.join(
        asked, F.expr("doc_id = asked_id and fingerprint = asked_print"), "left"
    ).drop("asked_id", "asked_print")
