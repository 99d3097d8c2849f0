"""Two tokenizers' tokens of the same texts, aligned by the bytes they cover.

*Encoding.* A is a byte-level BPE, B a BPE of pieces that puts a space before the text; A is given the
text after a space, so that both cover the same bytes. Texts are encoded in parts that both
tokenizers provably treat alone: a single space between two other characters begins a token of A
(its pattern says so) and of B (if no token has a space after another character, which is checked
when both are loaded). A part that was seen before is not encoded again.

*Merging.* The documents of a batch are merged in lockstep: one vector holds each document's place in
A, one its place in B. A step emits a link between the two tokens at these places, which overlap, and
moves on past whichever ends first, or past both, which is a cut: a byte where both end. Documents that
are through are taken out of the vectors.

*Corpus.* How many documents hold a pair of ids linked is summed over all documents, with partial sums
in each task. The links of each document are then looked up in that table.

Defined cases: a text that is null, empty, or not given back by its tokens' bytes has no tokens, and
zeros for counts; a null id is an id like any other; repeated rows are aligned and counted each; a
part's length bounds nothing, so texts without spaces are encoded whole; an empty table gives no rows;
other columns may have any names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.shared import settled

Batches = Iterator[pa.RecordBatch]

BATCH_BYTES = 4 << 20  # texts that are merged in lockstep, or one longer text
CACHED_PARTS = 300_000  # parts kept from batch to batch, and their characters
CACHED_CHARS = 8 << 20
PARTS_AT_ONCE = 5_000
PAIRS_HELD = 1 << 20
# The pair table is broadcast if its counted rows take no more than this; beyond that links are
# joined to it by a shuffle.
TABLE_BYTES = 64 << 20

_PART = re.compile(r"(?<=\S) (?=\S)")
_ENDS_ARE_PLAIN = re.compile(r"\S(?:.*\S)?", re.DOTALL)
_SPACE_INSIDE = re.compile(r"\S ")


@dataclass(frozen=True)
class Tokenizers:
    """The files of the two tokenizers, as the driver sees them; executors get their contents."""

    a_path: str = "/opt/tokenizers/byte_bpe_50k.json"
    b_path: str = "/opt/tokenizers/piece_bpe_32k.model"


def _letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for
    themselves, the others for characters from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class _Side:
    """One tokenizer: ids of the parts seen so far, and what each id stands for."""

    def __init__(self, token_bytes: list[bytes], encode: Callable[[list[str]], list[list[int]]]):
        self.token_bytes = pa.array(token_bytes, pa.binary())
        self.lengths = np.array([len(t) for t in token_bytes], dtype=np.int64)
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.ids, self.bounds = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def learn(self, parts: list[str]) -> None:
        found, counts = [self.ids], []
        for start in range(0, len(parts), PARTS_AT_ONCE):
            ids, own = self._encoded(parts[start : start + PARTS_AT_ONCE])
            found.append(ids)
            counts.append(own)
        ends = self.bounds[-1] + np.cumsum(np.concatenate(counts))
        self.ids, self.bounds = np.concatenate(found), np.concatenate([self.bounds, ends])

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``parts``, and how many each has.

        Parts without white space at their ends are encoded as one text and told apart by their
        bytes, which are those of the tokens unless a tokenizer changed some. Else each is encoded.
        """
        if all(_ENDS_ARE_PLAIN.fullmatch(part) for part in parts):
            text = " ".join(parts)
            (ids,) = self.encode([text])
            ids = np.array(ids, dtype=np.int32)
            ends = np.cumsum(self.lengths[ids])
            part_ends = np.cumsum([1 + len(part.encode()) for part in parts])
            at = np.searchsorted(ends, part_ends)
            joined = self.token_bytes.take(pa.array(ids)).buffers()[2] or b""
            whole = memoryview(joined).cast("B")[: ends[-1] if len(ends) else 0]
            if whole == b" " + text.encode():
                if at[-1] == len(ids) - 1 and (ends[at] == part_ends).all():
                    return ids, np.diff(at, prepend=-1)
        ids = self.encode(parts)
        counts = np.array([len(own) for own in ids], dtype=np.int64)
        return np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=counts.sum()), counts

    def of(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of parts, and how many each part has."""
        starts, counts = self.bounds[parts], self.bounds[parts + 1] - self.bounds[parts]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)
        return self.ids[at], counts


class Encoder:
    """Both tokenizers and the parts they have seen: up to the cache's bounds, and a batch's own."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a = Tokenizer.from_str(a_file.decode())
        a.encode_special_tokens = True
        a.no_padding()
        a.no_truncation()
        names = {i: token for token, i in a.get_vocab(with_added_tokens=True).items()}
        letters = _letters()
        a_bytes = [
            bytes(letters[c] for c in names[i]) if i in names else b""
            for i in range(max(names) + 1)
        ]
        b = SentencePieceProcessor(model_proto=b_file)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        b_bytes = [
            bytes([int(piece[3:-1], 16)])
            if b.is_byte(i)
            else piece.replace("▁", " ").encode()
            for i, piece in enumerate(pieces)
        ]
        self.a = _Side(
            a_bytes,
            lambda parts: [
                e.ids
                for e in a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)
            ],
        )
        self.b = _Side(b_bytes, lambda parts: b.encode(parts, out_type=int, num_threads=1))
        tokens = (t.decode("utf-8", "replace") for t in (*a_bytes, *b_bytes))
        self.whole = any(_SPACE_INSIDE.search(t) for t in tokens)
        self.known: dict[str, int] = {}
        self.held = 0

    def parts_of(self, text: str) -> list[str]:
        return [text] if self.whole else _PART.split(text)

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The parts of all texts, by number, and how many each text has."""
        own = [self.parts_of(text) for text in texts]
        if len(self.known) > CACHED_PARTS or self.held > CACHED_CHARS:
            self.known, self.held = {}, 0
            self.a.forget()
            self.b.forget()
        flat = list(chain.from_iterable(own))
        new = [part for part in dict.fromkeys(flat) if part not in self.known]
        if new:
            new.sort(key=lambda part: _ENDS_ARE_PLAIN.fullmatch(part) is None)
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            self.held += sum(map(len, new))
            self.a.learn(new)
            self.b.learn(new)
        numbers = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        return numbers, np.array([len(parts) for parts in own], dtype=np.int64)


@dataclass
class Aligned:
    """The alignment of a batch of documents.

    Tokens of all documents lie one after the other in ``a`` and ``b`` (ids); document ``i`` owns those
    from ``a_bounds[i]`` to ``a_bounds[i + 1]``. Links are pairs of places in ``a`` and ``b``, cuts the
    numbers of tokens before them; both come in the order of the steps that found them.
    """

    a: np.ndarray
    b: np.ndarray
    a_bounds: np.ndarray
    b_bounds: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def merged(a_ends: np.ndarray, b_ends: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray):
    """Links and cuts of all documents, in lockstep: ``link_a, link_b, cut_a, cut_b``.

    ``a_ends`` and ``b_ends`` are the bytes where tokens end, counted through all documents; both
    tokens' ends of a document reach the same last byte.
    """
    size = len(a_ends) + len(b_ends)
    links = np.empty((2, size), dtype=np.int32)
    is_cut = np.empty(size, dtype=bool)
    alive = np.flatnonzero(np.diff(a_bounds))
    at_a, at_b, stop = a_bounds[alive], b_bounds[alive], a_bounds[alive + 1]
    first = 0
    while len(at_a):
        last = first + len(at_a)
        links[0, first:last] = at_a
        links[1, first:last] = at_b
        end_a, end_b = a_ends[at_a], b_ends[at_b]
        np.equal(end_a, end_b, out=is_cut[first:last])
        at_a = at_a + (end_a <= end_b)
        at_b = at_b + (end_b <= end_a)
        go_on = at_a < stop
        if not go_on.all():
            at_a, at_b, stop = at_a[go_on], at_b[go_on], stop[go_on]
        first = last
    links, is_cut = links[:, :first], is_cut[:first]
    return links[0], links[1], links[0][is_cut] + 1, links[1][is_cut] + 1


def _per_text(counts: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Sums of ``counts`` over each text's parts."""
    sums = np.concatenate(([0], np.cumsum(counts)))
    ends = np.cumsum(parts)
    return sums[ends] - sums[ends - parts]


def align(texts: list[str | None], encoder: Encoder) -> Aligned:
    """The alignment of ``texts``."""
    own = [text or "" for text in texts]
    numbers, parts = encoder.places(own)
    parts[[not text for text in own]] = 0
    if not all(own):  # the empty part of an empty text has no tokens
        numbers = np.delete(numbers, np.flatnonzero(numbers == encoder.known.get("", -1)))
    sides = []
    fits = np.ones(len(own), dtype=bool)
    wanted = [b" " + text.encode() for text in own]
    for side in (encoder.a, encoder.b):
        ids, counts = side.of(numbers)
        bounds = np.concatenate(([0], np.cumsum(_per_text(counts, parts))))
        joined = side.token_bytes.take(pa.array(ids))
        data = memoryview(joined.buffers()[2] or b"").cast("B")
        bytes_at = np.concatenate(([0], np.cumsum(side.lengths[ids])))[bounds].tolist()
        for i, text in enumerate(wanted):
            if data[bytes_at[i] : bytes_at[i + 1]] != text:
                fits[i] = False
        sides.append((side, ids, bounds))
    found = []
    for side, ids, bounds in sides:
        counts = np.diff(bounds)
        ids = ids[np.repeat(fits, counts)]
        bounds = np.concatenate(([0], np.cumsum(np.where(fits, counts, 0))))
        found.append((ids, bounds, np.cumsum(side.lengths[ids])))
    (a, a_bounds, a_ends), (b, b_bounds, b_ends) = found
    return Aligned(a, b, a_bounds, b_bounds, *merged(a_ends, b_ends, a_bounds, b_bounds))


def _texts_of_groups(batch: Aligned, encoder: Encoder) -> list[memoryview]:
    """Each document's groups written as ``a1,a2|b1;a3|b2,b3``.

    Ids with the sign that follows them are taken from one table, in the order of groups, A first.
    """
    if not hasattr(encoder, "written"):
        ids = max(len(encoder.a.lengths), len(encoder.b.lengths))
        encoder.written = pa.array(
            [f"{i}{sign}".encode() for sign in (",", "|", ";", "") for i in range(ids)], pa.binary()
        )
        encoder.signs = ids
    a_last, b_last = np.sort(batch.cut_a), np.sort(batch.cut_b)  # tokens before each cut
    # A's tokens are preceded by B's of earlier groups, B's by A's of their own group as well.
    a_sizes, b_sizes = np.diff(a_last, prepend=0), np.diff(b_last, prepend=0)
    a_at = np.arange(len(batch.a)) + np.repeat(b_last - b_sizes, a_sizes)
    b_at = np.arange(len(batch.b)) + np.repeat(a_last, b_sizes)
    a_sign = np.zeros(len(batch.a), dtype=np.int64)
    a_sign[a_last - 1] = 1
    b_sign = np.zeros(len(batch.b), dtype=np.int64)
    b_sign[b_last - 1] = 2
    ends = batch.b_bounds[1:][np.diff(batch.b_bounds) > 0]
    b_sign[ends - 1] = 3
    order = np.empty(len(a_at) + len(b_at), dtype=np.int64)
    order[a_at] = batch.a + a_sign * encoder.signs
    order[b_at] = batch.b + b_sign * encoder.signs
    written = encoder.written.take(pa.array(order))
    data = memoryview(written.buffers()[2] or b"").cast("B")
    offsets = np.frombuffer(written.buffers()[1], dtype=np.int32)
    at = offsets[batch.a_bounds + batch.b_bounds].tolist()
    return [data[x:y] for x, y in zip(at, at[1:], strict=False)]


def _owners(bounds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The document of each token place."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[places]


def _batches_of(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text or "") > BATCH_BYTES:
            yield start, i
            start, held = i, 0
        held += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def _files(tokenizers: Tokenizers) -> tuple[bytes, bytes]:
    with open(tokenizers.a_path, "rb") as a, open(tokenizers.b_path, "rb") as b:
        return a.read(), b.read()


def _encoders(documents: DataFrame, tokenizers: Tokenizers) -> Callable[[], Encoder]:
    """Makes a task's encoder from the files' contents, a few megabytes that are broadcast."""
    files = documents.sparkSession.sparkContext.broadcast(_files(tokenizers))
    return lambda: Encoder(*files.value)


def aligned(documents: DataFrame, tokenizers: Tokenizers | None = None) -> DataFrame:
    """Per row its tokens and their alignment: ``doc_id, a, b`` (ids), ``cuts`` (numbers of A and B
    tokens before each) and ``links`` (places of an A and a B token, from 0), in text order."""
    encoder_of = _encoders(documents, tokenizers or Tokenizers())

    def pairs(x: np.ndarray, y: np.ndarray, names: tuple[str, str]) -> pa.StructArray:
        return pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=list(names))

    def run(batches: Batches) -> Batches:
        encoder = encoder_of()
        for batch in batches:
            texts = batch["text"].to_pylist()
            for start, stop in _batches_of(texts):
                own = align(texts[start:stop], encoder)
                columns = [batch["doc_id"].slice(start, stop - start)]
                for ids, bounds in ((own.a, own.a_bounds), (own.b, own.b_bounds)):
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)))
                for x, y, back in ((own.cut_a, own.cut_b, 1), (own.link_a, own.link_b, 0)):
                    order = np.lexsort((y, x))
                    x, y = x[order], y[order]
                    doc = _owners(own.a_bounds, x - back)
                    bounds = np.searchsorted(doc, np.arange(len(texts[start:stop]) + 1))
                    x = (x - own.a_bounds[doc]).astype(np.int32)
                    y = (y - own.b_bounds[doc]).astype(np.int32)
                    columns.append(
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs(x, y, ("a", "b")))
                    )
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a", "b", "cuts", "links"])

    pair = "array<struct<a: int, b: int>>"
    schema = f"doc_id bigint, a array<int>, b array<int>, cuts {pair}, links {pair}"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


_SUMMARY = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs binary, times binary, pair bigint, n bigint"
)


def _packed(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, the bytes of each rank together, which compresses well."""
    steps = np.diff(values, prepend=0).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel()).astype(np.int64)


def _summaries(encoder_of: Callable[[], Encoder]) -> Callable[[Batches], Batches]:
    """A row for each document, with its distinct linked pairs and how often each is linked; and rows
    with a pair and how many documents hold it, summed over many documents of the task."""

    def document_rows(ids: pa.Array, own: Aligned, encoder: Encoder, counts: list) -> pa.RecordBatch:
        size = len(ids)
        doc = _owners(own.a_bounds, own.link_a)
        key = own.a[own.link_a].astype(np.int64) * len(encoder.b.lengths) + own.b[own.link_b]
        span = len(encoder.a.lengths) * len(encoder.b.lengths)
        n_links = np.bincount(doc, minlength=size)
        both, times = np.unique(doc * span + key, return_counts=True)
        doc, key = both // span, both % span
        bounds = np.searchsorted(doc, np.arange(size + 1))
        counts.append(np.unique(key, return_counts=True))
        cuts = _owners(own.a_bounds, own.cut_a - 1)
        written = _texts_of_groups(own, encoder)
        steps = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        small = np.minimum(times, 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(np.diff(own.a_bounds)),
                pa.array(np.diff(own.b_bounds)),
                pa.array(np.bincount(cuts, minlength=size)),
                pa.array(n_links),
                pa.array([hashlib.sha256(w).hexdigest() if len(w) else "" for w in written]),
                pa.array([_packed(key[x:y]) for x, y in steps], pa.binary()),
                # Times over 254 follow the bytes, in order.
                pa.array(
                    [
                        small[x:y].tobytes() + times[x:y][times[x:y] > 254].astype("<u8").tobytes()
                        for x, y in steps
                    ],
                    pa.binary(),
                ),
                pa.nulls(size, pa.int64()),
                pa.nulls(size, pa.int64()),
            ],
            names=names,
        )

    names = [part.split()[0] for part in _SUMMARY.split(", ")]

    def pair_rows(counts: list) -> pa.RecordBatch:
        pairs, n = _summed(counts)
        nothing = [pa.nulls(len(pairs), kind) for kind in kinds[:-2]]
        return pa.RecordBatch.from_arrays([*nothing, pa.array(pairs), pa.array(n)], names=names)

    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Batches) -> Batches:
        encoder = None
        counts: list = []
        for batch in batches:
            encoder = encoder or encoder_of()
            texts = batch["text"].to_pylist()
            for start, stop in _batches_of(texts):
                own = align(texts[start:stop], encoder)
                yield document_rows(batch["doc_id"].slice(start, stop - start), own, encoder, counts)
                if sum(len(pairs) for pairs, _ in counts) > PAIRS_HELD:
                    counts = [_summed(counts)]
                    if len(counts[0][0]) > PAIRS_HELD // 2:
                        yield pair_rows(counts)
                        counts = []
        if counts:
            yield pair_rows(counts)

    return run


def _summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, at = np.unique(np.concatenate([p for p, _ in counts]), return_inverse=True)
    n = np.concatenate([n for _, n in counts])
    return pairs, np.bincount(at, weights=n, minlength=len(pairs)).astype(np.int64)


def _times(packed: bytes, size: int) -> np.ndarray:
    times = np.frombuffer(packed, dtype=np.uint8, count=size).astype(np.int64)
    times[times == 255] = np.frombuffer(packed, dtype="<u8", offset=size)
    return times


def _looked_up(table) -> Callable[[Batches], Batches]:
    """``n_best`` and ``count_sum`` of each document, by the table of pairs (sorted), their counts
    and which are the highest of their A id."""

    def run(batches: Batches) -> Batches:
        pairs, n, best = (np.frombuffer(column, dtype=kind) for column, kind in table.value)
        for batch in batches:
            found = []
            packed = zip(batch["pairs"].to_pylist(), batch["times"].to_pylist(), strict=True)
            for keys, times in packed:
                at = np.searchsorted(pairs, _unpacked(keys))
                times = _times(times, len(at))
                found.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
            columns = [batch[name] for name in names[:-2]]
            columns += [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [part.split()[0] for part in _REPORT.split(", ")]
    return run


_REPORT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "n_best bigint, count_sum bigint"
)


def _spread(batches: Batches) -> Batches:
    """The pairs of each document as rows."""
    for batch in batches:
        columns = (batch[name].to_pylist() for name in ("row", "pairs", "times"))
        for row, keys, times in zip(*columns, strict=True):
            own = _unpacked(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), row)), pa.array(own), pa.array(_times(times, len(own)))],
                names=["row", "pair", "times"],
            )


def alignment_report(
    documents: DataFrame, tokenizers: Tokenizers | None = None, table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """Per row: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``.

    A pair's count is the number of documents that hold it linked. ``n_best`` counts the links whose
    count is the highest of their A id, ties included; ``count_sum`` adds up the counts of all links.
    """
    from sentencepiece import SentencePieceProcessor

    tokenizers = tokenizers or Tokenizers()
    encoder_of = _encoders(documents, tokenizers)
    made = documents.select("doc_id", "text").mapInArrow(_summaries(encoder_of), _SUMMARY)
    made = settled(made, "aligned")
    b_size = SentencePieceProcessor(model_file=tokenizers.b_path).get_piece_size()
    own = made.where("pair is null")
    table = (
        made.where("pair is not null")
        .groupBy("pair")
        .agg(F.expr("sum(n) as n"))
        .selectExpr("pair", "n", f"n = max(n) over (partition by pair div {b_size}) as best")
    )
    table = settled(table, "pairs")
    if table.count() * 17 <= table_bytes:
        rows = table.orderBy("pair").toArrow()
        columns = [
            (rows["pair"].to_numpy().tobytes(), "<i8"),
            (rows["n"].to_numpy().tobytes(), "<i8"),
            (rows["best"].to_numpy().astype(np.uint8).tobytes(), "?"),
        ]
        held = documents.sparkSession.sparkContext.broadcast(columns)
        return own.mapInArrow(_looked_up(held), _REPORT)
    numbered = settled(own.withColumn("row", F.monotonically_increasing_id()), "numbered")
    sums = (
        numbered.select("row", "pairs", "times")
        .mapInArrow(_spread, "row bigint, pair bigint, times bigint")
        .join(table, "pair")
        .groupBy("row")
        .agg(F.expr("sum(if(best, times, 0)) as n_best"), F.expr("sum(times * n) as count_sum"))
    )
    return numbered.join(sums, "row", "left").selectExpr(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
        "coalesce(n_best, 0L) as n_best", "coalesce(count_sum, 0L) as count_sum",
    )
