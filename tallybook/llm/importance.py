"""Importance resampling towards a target: the documents whose words look like the target's.

Features of a text are its runs of consecutive words, hashed into buckets. A bucket's gain is the
scaled log ratio of its smoothed share among the target's features to that among all documents'; a
document's weight is the sum of its features' gains. Adding Gumbel noise, derived from the id alone,
and taking the highest scores draws documents without replacement in proportion to their weights.

Weights are array work: a table of gains, indexed by the buckets of all features of a block of texts.
The draw is a radix sort over composite digits of score and id (``radix``), so that ranks come from
counts and offsets and no task sees more than a chunk of rows.

Defined cases: a null text has no features, weight 0; a text with fewer than ``least_words`` words, or
a row with a null id, which has no noise, is never drawn (nor counted among those drawn from), but its
features count; equal scores go to the smaller id; a repeated id is drawn for each of its rows, in any
order among equals; an empty target leaves smoothing alone in its shares; empty tables give no rows;
other columns may have any names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.radix import Key, numbered
from tallybook.llm.shared import as_bytes, settled
from tallybook.llm.tokens import BLOCK_BYTES

Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Draw:
    """``runs``: longest run of words that is a feature. ``percent`` of the texts are drawn."""

    runs: int = 1
    buckets: int = 10_000
    scale: int = 1_000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10


# Words are runs of small letters, digits and everything beyond ASCII, after A-Z became a-z.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
_LONG = 64


def _crc_table() -> np.ndarray:
    """``[k, b]``: what byte ``b`` changes in a CRC-32 if ``k`` bytes follow it, against byte 0."""
    zeros = [zlib.crc32(bytes(k + 1)) for k in range(_LONG)]
    return np.array(
        [[zlib.crc32(bytes([b]) + bytes(k)) ^ zeros[k] for b in range(256)] for k in range(_LONG)],
        dtype=np.uint32,
    )


_CRC = _crc_table()
_CRC_OF_ZEROS = np.array([zlib.crc32(bytes(k)) for k in range(_LONG + 1)], dtype=np.uint32)


def crcs(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each of the not empty, ordered slices of ``buffer``.

    A CRC is linear: it is the CRC of as many zeros, changed by each byte as its distance from the
    end says.
    """
    if not len(starts):
        return np.empty(0, dtype=np.uint32)
    lengths = ends - starts
    long = lengths > _LONG
    letters = np.frombuffer(buffer, dtype=np.uint8)
    bounds = np.cumsum(lengths) - lengths
    left = np.repeat(ends, lengths) - 1  # the last byte of each byte's own slice
    at = np.arange(len(left)) + np.repeat(starts - bounds, lengths)
    changes = _CRC[np.minimum(left - at, _LONG - 1), letters[at]]
    found = np.bitwise_xor.reduceat(changes, bounds)
    found ^= _CRC_OF_ZEROS[np.minimum(lengths, _LONG)]
    for i in np.flatnonzero(long):
        found[i] = zlib.crc32(buffer[starts[i] : ends[i]])
    return found


class Features:
    """Buckets of the features of a block of texts; ``bounds`` says which are each text's own."""

    def __init__(self, texts: list[bytes | None], spec: Draw):
        lengths = np.fromiter((len(t or b"") for t in texts), dtype=np.int64, count=len(texts))
        offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
        buffer = b" ".join(t or b"" for t in texts).lower() + b" "
        inside = np.concatenate(([False], _IN_WORD[np.frombuffer(buffer, dtype=np.uint8)]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        bounds = np.searchsorted(starts, offsets)
        self.words = np.diff(bounds)
        buckets = crcs(buffer, starts, ends) % np.uint32(spec.buckets)
        if spec.runs > 1:
            buckets, bounds = self._runs(buffer, starts, ends, bounds, buckets, spec)
        self.buckets, self.bounds = buckets.astype(np.int64), bounds

    def _runs(self, buffer, starts, ends, bounds, single, spec: Draw):
        """Buckets of runs of up to ``runs`` words, joined by one space, text by text."""
        words = [buffer[a:b] for a, b in zip(starts, ends, strict=True)]
        own, counts = [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            longer = [
                zlib.crc32(b" ".join(words[i : i + n])) % spec.buckets
                for n in range(2, spec.runs + 1)
                for i in range(a, b - n + 1)
            ]
            own += [single[a:b], np.array(longer, dtype=np.uint32)]
            counts.append(b - a + len(longer))
        return np.concatenate(own or [single]), np.concatenate(([0], np.cumsum(counts)))

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """The sum of each text's gains."""
        totals = np.concatenate(([0], np.cumsum(gains[self.buckets])))
        return totals[self.bounds[1:]] - totals[self.bounds[:-1]]


def _blocks(texts: list[bytes | None], spec: Draw) -> Iterator[tuple[int, int, Features]]:
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text or b"") > BLOCK_BYTES:
            yield start, i, Features(texts[start:i], spec)
            start, held = i, 0
        held += len(text or b"")
    if start < len(texts):
        yield start, len(texts), Features(texts[start:], spec)


def bucket_counts(texts: DataFrame, spec: Draw) -> np.ndarray:
    """How many features of the table's ``text`` fall into each bucket; the driver gets one number a
    bucket."""

    def run(batches: Batches) -> Batches:
        counts = np.zeros(spec.buckets, dtype=np.int64)
        for batch in batches:
            for _, _, own in _blocks(as_bytes(batch["text"]), spec):
                counts += np.bincount(own.buckets, minlength=spec.buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(run, "bucket bigint, n bigint")
    found = np.zeros(spec.buckets, dtype=np.int64)
    for row in counted.groupBy("bucket").agg(F.expr("sum(n) as n")).collect():
        found[row.bucket] = row.n
    return found


def gains_of(raw: np.ndarray, target: np.ndarray, spec: Draw) -> np.ndarray:
    """Each bucket's gain, as a whole number."""
    all_raw, all_target = float(raw.sum()), float(target.sum())
    ratios = ((target + 1.0) * (all_raw + spec.buckets)) / (
        (raw + 1.0) * (all_target + spec.buckets)
    )
    logs = (math.floor(spec.scale * math.log(ratio)) for ratio in ratios.tolist())
    return np.fromiter(logs, dtype=np.int64, count=spec.buckets)


def noise(doc_id: int, spec: Draw) -> int:
    """Gumbel noise that depends on the id and the seed only."""
    h = int(hashlib.sha256(f"{spec.seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-spec.scale * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(documents: DataFrame, target: DataFrame, spec: Draw | None = None) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    spec = spec or Draw()
    gains = gains_of(bucket_counts(documents, spec), bucket_counts(target, spec), spec)
    return documents.select("doc_id", "text").mapInArrow(
        _weighing(gains, spec),
        "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint",
    )


def _weighing(gains: np.ndarray, spec: Draw) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), as_bytes(batch["text"])
            for start, stop, own in _blocks(texts, spec):
                weights = own.sums(gains)
                scores = [
                    None if i is None else w + noise(i, spec)
                    for i, w in zip(ids[start:stop], weights.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(start, stop - start), pa.array(own.words),
                     pa.array(np.diff(own.bounds)), pa.array(weights), pa.array(scores, pa.int64())],
                    ["doc_id", "n_words", "n_features", "weight", "score"],
                )

    return run


def importance_ranks(
    documents: DataFrame, target: DataFrame, spec: Draw | None = None
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; ``rank`` counts the drawn from 1."""
    spec = spec or Draw()
    scored = settled(weighed(documents, target, spec), "weighed")
    drawable = f"n_words >= {spec.least_words} and score is not null"
    quota = spec.percent * scored.where(drawable).count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    placed = numbered(
        scored.where(drawable).select(*columns), [Key("score", descending=True), Key("doc_id")]
    )
    ranked = placed.selectExpr(*columns, f"if(place < {quota}, place + 1, null) as rank")
    others = scored.where(f"not ({drawable})").selectExpr(*columns, "cast(null as bigint) as rank")
    return ranked.union(others)


def resampled(documents: DataFrame, target: DataFrame, spec: Draw | None = None) -> DataFrame:
    """The rows of ``documents`` that are drawn, with all their columns.

    Rows are told by their id: if one with a repeated id is drawn, all of them are in the result.
    """
    drawn = importance_ranks(documents, target, spec).where("rank is not null")
    return documents.join(drawn.select("doc_id").distinct(), "doc_id", "left_semi")
