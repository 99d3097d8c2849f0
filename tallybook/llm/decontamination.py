"""Documents that contain benchmark items, by SimHash over item-sized windows.

An item's fingerprint is the SimHash of its words. A document's windows of the item's length have
theirs, and windows and items meet by multi-index Hamming blocks: a fingerprint of 64 bits falls
into ``radius + 1`` blocks, and two fingerprints within ``radius`` agree on one block at least, so
none within the radius is missed. A window that meets an item is compared with it exactly: the
weighted Jaccard similarity of their shingles, each shingle weighing its words' letters together as
often as it occurs.

The radius is tighter than the similarity asked for, so a window also meets every item of whose
weight its shingles have ``percent`` / 100: no window that is similar enough has less, so no match
is missed.

Windows that share no shingle with any item have similarity 0 and are not fingerprinted.

Items are indexed on the driver and broadcast, in slices of ``SLICE_BYTES`` of text at most: a larger
benchmark takes several passes over the documents, never a larger broadcast.

Defined cases: null and blank texts and items match nothing; an item of fewer words than ``size`` is
one shingle and matches a text of exactly these words; equal items each give their rows; repeated
rows of documents give the same row once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.shared import as_bytes
from tallybook.llm.tokens import Words, blocks, mixed

SLICE_BYTES = 4 << 20
BITS = 64
MATCHES = "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, similarity double"


@dataclass(frozen=True)
class Windows:
    """Windows ``percent`` / 100 alike an item are matches; SimHash looks within ``radius`` bits."""

    size: int = 5
    percent: int = 80
    radius: int = 9


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 and -1 for the bits of each hash."""
    bits = np.unpackbits(mixed(hashes, 41).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _fingerprints(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1).view(np.uint64).ravel()


class Index:
    """Items by length, each with its fingerprint, weighted shingles, and blocks to find it by."""

    def __init__(self, items: list[tuple[int, bytes]], how: Windows):
        self.how = how
        words = Words([text for _, text in items])
        self.ids = [item for item, _ in items]
        shingles, bounds = words.shingles(how.size)
        weights = shingle_weights(words, bounds, how.size)
        self.lengths = np.diff(words.bounds)
        self.known = np.unique(shingles)
        signs = _signs(words.hashes)
        votes = [signs[a:b].sum(axis=0) for a, b in zip(words.bounds, words.bounds[1:], strict=False)]
        self.prints = _fingerprints(np.array(votes).reshape(-1, BITS))
        self.parts = [
            (shingles[a:b], weights[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)
        ]
        # Items by shingle, each once: those of known[k] are owners[owned[k] : owned[k + 1]].
        own = np.repeat(np.arange(len(self.ids)), np.diff(bounds))
        pairs = np.unique(np.stack((np.searchsorted(self.known, shingles), own)), axis=1)
        self.owners = pairs[1]
        self.owned = np.searchsorted(pairs[0], np.arange(len(self.known) + 1))
        self.totals = np.array([own_weights.sum() for _, own_weights in self.parts])
        # Block tables: per length and block, the items in the order of that block's value.
        self.tables = {}
        for length in np.unique(self.lengths):
            own = np.flatnonzero(self.lengths == length)
            for block in range(how.radius + 1):
                values = self.block(self.prints[own], block)
                order = np.argsort(values, kind="stable")
                self.tables[int(length), block] = values[order], own[order]

    def block(self, prints: np.ndarray, block: int) -> np.ndarray:
        blocks_ = self.how.radius + 1
        low, high = BITS * block // blocks_, BITS * (block + 1) // blocks_
        return (prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)

    def near(self, length: int, prints: np.ndarray) -> np.ndarray:
        """(window, item) of all fingerprints within the radius."""
        found = []
        for block in range(self.how.radius + 1):
            values, items = self.tables[length, block]
            own = self.block(prints, block)
            low, high = np.searchsorted(values, own), np.searchsorted(values, own, side="right")
            count = high - low
            window = np.repeat(np.arange(len(prints)), count)
            at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(
                np.cumsum(count) - count, count
            )
            item = items[at]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.how.radius
            found.append(np.stack((window[close], item[close]), axis=1))
        return np.unique(np.concatenate(found), axis=0)


    def sharing(self, shingles: np.ndarray, weights: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """(start, item) of all windows that have enough of an item's weight in its shingles."""
        at = np.flatnonzero(shared)
        known = np.searchsorted(self.known, shingles[at])
        count = self.owned[known + 1] - self.owned[known]
        ends = np.cumsum(count)
        item = self.owners[np.repeat(self.owned[known] - ends + count, count) + np.arange(ends[-1])]
        at = np.repeat(at, count)
        whole = np.bincount(item, weights[at], len(self.ids))
        found = [np.empty((0, 2), dtype=np.int64)]
        rows = np.argsort(item, kind="stable")
        item, at = item[rows], at[rows]
        for k in np.flatnonzero((whole * 100 >= self.how.percent * self.totals) & (whole > 0)):
            inside = max(int(self.lengths[k]) - self.how.size + 1, 1)
            if inside > len(shingles):
                continue
            low, high = np.searchsorted(item, k), np.searchsorted(item, k, side="right")
            sums = np.zeros(len(shingles) + 1, dtype=np.int64)
            sums[at[low:high] + 1] = weights[at[low:high]]
            np.cumsum(sums, out=sums)
            has = sums[inside:] - sums[:-inside]
            start = np.flatnonzero(has * 100 >= self.how.percent * self.totals[k])
            found.append(np.stack((start, np.full(len(start), k)), axis=1))
        return np.concatenate(found)


def shingle_weights(words: Words, bounds: np.ndarray, size: int) -> np.ndarray:
    """The letters (bytes) of each shingle."""
    letters = np.concatenate(([0], np.cumsum(words.ends - words.starts)))
    per_text = np.diff(bounds)
    first = np.repeat(words.bounds[:-1] - bounds[:-1], per_text) + np.arange(bounds[-1])
    last = np.minimum(first + size, np.repeat(words.bounds[1:], per_text))
    return letters[last] - letters[first]


def weighted_similarity(left, right) -> float:
    """Weighted Jaccard similarity of two (shingles, weights), a shingle counted as it occurs."""
    names = np.unique(np.concatenate((left[0], right[0])))
    a = np.bincount(np.searchsorted(names, left[0]), left[1], len(names))
    b = np.bincount(np.searchsorted(names, right[0]), right[1], len(names))
    return float(np.minimum(a, b).sum() / np.maximum(a, b).sum())


def _matches(index: Index):
    """Matches in the documents (doc_id, text): the best window of each document and item."""
    how = index.how
    names = [column.split()[0] for column in MATCHES.split(", ")]

    def searched(ids: pa.Array, texts: list[bytes | None]) -> Iterator[tuple]:
        for start, words in blocks(texts):
            shingles, bounds = words.shingles(how.size)
            place = np.minimum(np.searchsorted(index.known, shingles), len(index.known) - 1)
            shared = index.known[place] == shingles
            if not shared.any():
                continue
            weights = shingle_weights(words, bounds, how.size)
            sums = np.concatenate(([0], np.cumsum(shared)))
            for i in np.flatnonzero(np.diff(sums[bounds])):
                yield from matched(
                    ids[start + i].as_py(),
                    words.hashes[words.bounds[i] : words.bounds[i + 1]],
                    shingles[bounds[i] : bounds[i + 1]],
                    weights[bounds[i] : bounds[i + 1]],
                    shared[bounds[i] : bounds[i + 1]],
                )

    def matched(doc, hashes, shingles, weights, shared) -> Iterator[tuple]:
        best: dict[int, tuple] = {}
        sums = np.concatenate(([0], np.cumsum(shared)))
        votes = None
        sharing = index.sharing(shingles, weights, shared)
        for length in np.unique(index.lengths):
            length = int(length)
            if not length or length > len(hashes):
                continue
            inside = max(length - how.size + 1, 1)
            if length < how.size and length != len(hashes):
                continue  # such a shingle is a whole text
            starts = np.arange(len(hashes) - length + 1)
            starts = starts[sums[starts + inside] > sums[starts]]
            if not len(starts):
                continue
            if votes is None:
                votes = np.zeros((len(hashes) + 1, BITS), dtype=np.int32)
                np.cumsum(_signs(hashes), axis=0, out=votes[1:])
            prints = _fingerprints(votes[starts + length] - votes[starts])
            near = index.near(length, prints)
            near[:, 0] = starts[near[:, 0]]
            also = sharing[index.lengths[sharing[:, 1]] == length]
            for a, item in np.unique(np.concatenate((near, also)), axis=0):
                own = shingles[a : a + inside], weights[a : a + inside]
                alike = weighted_similarity(own, index.parts[item])
                if alike * 100 >= how.percent and alike > best.get(item, (0,))[0]:
                    best[item] = (alike, int(a), int(a) + length)
        for item, (alike, a, b) in best.items():
            yield doc, index.ids[item], a, b, alike

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(searched(batch.column(0), as_bytes(batch.column(1))))
            if rows:
                columns = [pa.array(list(c)) for c in zip(*rows, strict=True)]
                columns[0] = columns[0].cast(pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return found


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items that have words, in slices that fit a broadcast."""
    items = benchmark.selectExpr("item_id", "encode(text, 'UTF-8') as text").where(
        "text is not null"
    )
    size = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    count = -(-size // SLICE_BYTES)
    for k in range(count):
        rows = items.where(F.expr(f"pmod(xxhash64(item_id, text), {count}) = {k}")).distinct()
        held = [(row.item_id, bytes(row.text)) for row in rows.toLocalIterator()]
        held = [(item, text) for item, text in sorted(held, key=str) if text.split()]
        if held:
            yield held


def contaminations(
    documents: DataFrame, benchmark: DataFrame, how: Windows | None = None
) -> DataFrame:
    """Per document (doc_id, text) and item (item_id, text) found in it: the best window."""
    spark, how = documents.sparkSession, how or Windows()
    texts = documents.select("doc_id", "text").where("text is not null")
    passes = [
        texts.mapInArrow(_matches(Index(items, how)), MATCHES) for items in _slices(benchmark)
    ]
    if not passes:
        return spark.createDataFrame([], MATCHES)
    return reduce(DataFrame.union, passes).distinct()


def decontaminated(
    documents: DataFrame, benchmark: DataFrame, how: Windows | None = None
) -> DataFrame:
    """``documents`` without those that contain an item; rows stay where they are."""
    how = how or Windows()
    position = documents.columns.index("text")

    def clean(index: Index):
        found = _matches(index)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(batch.num_rows)), batch.column(position)],
                    names=["doc_id", "text"],
                )
                keep = np.ones(batch.num_rows, dtype=bool)
                for hits in found(iter([rows])):
                    keep[hits.column(0).to_numpy()] = False
                yield batch.filter(pa.array(keep))

        return kept

    for items in _slices(benchmark):
        documents = documents.mapInArrow(clean(Index(items, how)), documents.schema)
    return documents
