"""Exact duplicates, combined in three stages so that no copied text is hot in any of them.

1. *Locally*: a task groups the rows it reads, a block at a time, by their whole text. A block sends
   one row per distinct text, however many copies it holds: its best row, how many there are, their
   ids, and a salt that the block was dealt.
2. *Salted*: these rows meet by digest and salt, and equal texts become one salt winner. A text that
   every block of the corpus holds is spread over ``salts`` tasks.
3. *Globally*: the winners of a digest, at most ``salts`` for each of its texts, meet and are
   combined to the row that stays. What they decide goes back to the members by digest and salt, so
   members of one text are never together in one task either.

The SHA-256 digest only says where rows meet. At each stage whole texts are compared, and different
texts under one digest are kept apart as variants.

Of equal texts the row with the largest id stays. Defined cases: a null text counts as empty; a null
id is less than any other; of rows that repeat text and largest id one stays; all rows are reported,
repeated ones too; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallybook.llm.shared import as_bytes

Batches = Iterator[pa.RecordBatch]

OUT_BYTES = 4 << 20
OUT_ROWS = 5_000
_LEAST = -(2**63)  # stands for a null id


@dataclass(frozen=True)
class Combining:
    """``salts`` spread a hot text; a block ends at ``block_bytes`` of texts or ``block_rows``."""

    salts: int = 64
    block_bytes: int = 16 << 20
    block_rows: int = 50_000


@dataclass
class _Group:
    """Rows with one text: how many, and the best of them."""

    n: int
    top: int
    row: int
    rest: pa.Array | None

    def add(self, n: int, top: int, row: int, rest: pa.Array | None) -> None:
        self.n += n
        if (top, -row) > (self.top, -self.row):
            self.top, self.row, self.rest = top, row, rest


def _rest_of(batch: pa.RecordBatch, i: int) -> pa.Array | None:
    return batch["rest"].slice(i, 1) if "rest" in batch.schema.names else None


class _Out:
    """Rows put together to batches of about ``OUT_BYTES`` of texts or ``OUT_ROWS``."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.columns: list[list] = [[] for _ in schema]
        self.held = 0

    def add(self, *values) -> Batches:
        """The row, with the whole row it stands for last if the schema has ``rest``."""
        for column, value in zip(self.columns, values, strict=False):
            column.append(value)
            if isinstance(value, bytes):
                self.held += len(value)
        if self.held >= OUT_BYTES or len(self.columns[0]) >= OUT_ROWS:
            yield from self.rest()

    def rest(self) -> Batches:
        if self.columns[0]:
            arrays = [
                pa.concat_arrays(values)
                if field.name == "rest"
                else pa.array(values, pa.binary()).cast(pa.string())
                if field.type == pa.string()
                else pa.array(values, field.type)
                for field, values in zip(self.schema, self.columns, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)
        self.columns, self.held = [[] for _ in self.schema], 0


def _with_rest(schema: pa.Schema, batch: pa.RecordBatch) -> pa.Schema:
    """``schema`` and, if ``batch`` carries whole rows, its column ``rest``."""
    return schema.append(batch.schema.field("rest")) if "rest" in batch.schema.names else schema


_LOCAL = pa.schema(
    [("digest", pa.binary()), ("salt", pa.int32()), ("text", pa.string()), ("n", pa.int64()),
     ("top", pa.int64()), ("row", pa.int64()), ("ids", pa.list_(pa.int64()))]
)


def _local(spec: Combining) -> Callable[[Batches], Batches]:
    """Stage 1 over ``doc_id, text`` and perhaps ``rest``: a row for each text of a block."""

    def flushed(block: dict[bytes, tuple[_Group, list]], number: int, schema: pa.Schema) -> Batches:
        salt = (TaskContext.get().partitionId() * 31 + number) % spec.salts
        out = _Out(schema)
        for text, (group, ids) in block.items():
            best = ids.index(None if group.top == _LEAST else group.top)
            ids[0], ids[best] = ids[best], ids[0]  # the block's best row is told by its place
            digest = hashlib.sha256(text).digest()
            yield from out.add(digest, salt, text, group.n, group.top, group.row, ids, group.rest)
        yield from out.rest()

    def run(batches: Batches) -> Batches:
        block: dict[bytes, tuple[_Group, list]] = {}
        row, rows, held, number = TaskContext.get().partitionId() << 40, 0, 0, 0
        schema = _LOCAL
        for batch in batches:
            schema = _with_rest(_LOCAL, batch)
            ids, texts = batch["doc_id"].to_pylist(), as_bytes(batch["text"])
            for i, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
                top = _LEAST if doc_id is None else doc_id
                if (known := block.get(text)) is None:
                    block[text] = _Group(1, top, row, _rest_of(batch, i)), [doc_id]
                    held += len(text)
                else:
                    known[0].add(1, top, row, _rest_of(batch, i))
                    known[1].append(doc_id)
                row, rows = row + 1, rows + 1
                if held >= spec.block_bytes or rows >= spec.block_rows:
                    yield from flushed(block, number, schema)
                    block, rows, held, number = {}, 0, 0, number + 1
        if block:
            yield from flushed(block, number, schema)

    return run


_WINNERS = pa.schema(
    [("digest", pa.binary()), ("salt", pa.int32()), ("variant", pa.int32()), ("text", pa.string()),
     ("n", pa.int64()), ("top", pa.int64()), ("row", pa.int64())]
)


def _salted(winners: bool) -> Callable[[Batches], Batches]:
    """Stage 2 over rows sorted by digest and salt: the salt winners, or the members by variant."""

    def merged(batches: Batches) -> Batches:
        key, texts, out = None, {}, None

        def won() -> Batches:
            for variant, (text, group) in enumerate(texts.items()):
                yield from out.add(*key, variant, text, group.n, group.top, group.row, group.rest)

        for batch in batches:
            out = out or _Out(_with_rest(_WINNERS, batch))
            keys = zip(batch["digest"].to_pylist(), batch["salt"].to_pylist(), strict=True)
            bests = (batch[name].to_pylist() for name in ("n", "top", "row"))
            variants = []
            rows = zip(keys, as_bytes(batch["text"]), *bests, strict=True)
            for i, (own, text, n, top, row) in enumerate(rows):
                if own != key:
                    if winners and key:
                        yield from won()
                    key, texts = own, {}
                rest = _rest_of(batch, i) if winners else None
                if (known := texts.get(text)) is None:
                    texts[text] = _Group(n, top, row, rest)
                    variants.append(len(texts) - 1)
                else:
                    known.add(n, top, row, rest)
                    variants.append(list(texts).index(text))
            if not winners:
                yield pa.RecordBatch.from_arrays(
                    [batch["digest"], batch["salt"], pa.array(variants, pa.int32()),
                     batch["row"], batch["ids"]],
                    names=["digest", "salt", "variant", "row", "ids"],
                )
        if winners and key:
            yield from won()
            yield from out.rest()

    return merged


_NAMED = pa.schema(
    [("digest", pa.binary()), ("salt", pa.int32()), ("variant", pa.int32()),
     ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())]
)


def _global(whole_rows: bool) -> Callable[[Batches], Batches]:
    """Stage 3 over winners sorted by digest: what each was combined to, or the rows that stay."""

    def combined(batches: Batches) -> Batches:
        digest, own, texts, out = None, [], {}, None

        def decided() -> Batches:
            if whole_rows:
                for group in texts.values():
                    yield from out.add(group.rest)
                return
            for salt, variant, text in own:
                group = texts[text]
                keep_id = None if group.top == _LEAST else group.top
                yield from out.add(digest, salt, variant, keep_id, group.row, group.n)

        names = ("digest", "salt", "variant", "n", "top", "row")
        for batch in batches:
            if out is None:
                out = _Out(pa.schema([batch.schema.field("rest")]) if whole_rows else _NAMED)
            columns = (batch[name].to_pylist() for name in names)
            rows = zip(as_bytes(batch["text"]), *columns, strict=True)
            for i, (text, at, salt, variant, n, top, row) in enumerate(rows):
                if at != digest:
                    yield from decided()
                    digest, own, texts = at, [], {}
                own.append((salt, variant, text))
                if (known := texts.get(text)) is None:
                    texts[text] = _Group(n, top, row, _rest_of(batch, i))
                else:
                    known.add(n, top, row, _rest_of(batch, i))
        if out is not None:
            yield from decided()
            yield from out.rest()

    return combined


_LOCAL_ROW = (
    "digest binary, salt int, text string, n bigint, top bigint, row bigint, ids array<bigint>"
)
_MEMBER_ROW = "digest binary, salt int, variant int, row bigint, ids array<bigint>"
_WINNER_ROW = (
    "digest binary, salt int, variant int, text string, n bigint, top bigint, row bigint"
)
_NAMED_ROW = (
    "digest binary, salt int, variant int, keep_id bigint, keep_row bigint, group_size bigint"
)


def _schema(row: str, rows: DataFrame) -> T.StructType:
    """``row`` and the column ``rest`` of ``rows``, if they have it."""
    schema = T.StructType.fromDDL(row)
    return schema.add(rows.schema["rest"]) if "rest" in rows.columns else schema


def _by_salt(rows: DataFrame, spec: Combining) -> DataFrame:
    """Stage 1, its rows dealt and sorted for stage 2; variants are numbered in the order of texts."""
    local = rows.mapInArrow(_local(spec), _schema(_LOCAL_ROW, rows))
    return local.repartition("digest", "salt").sortWithinPartitions("digest", "salt", "text")


def _by_digest(by_salt: DataFrame) -> DataFrame:
    """Stage 2's winners, dealt and sorted for stage 3."""
    winners = by_salt.mapInArrow(_salted(winners=True), _schema(_WINNER_ROW, by_salt))
    return winners.repartition("digest").sortWithinPartitions("digest")


def exact_duplicates(
    documents: DataFrame, text: str = "text", spec: Combining | None = None
) -> DataFrame:
    """For each row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``text`` is the SQL expression whose value is compared; the digest is of that value in UTF-8.
    """
    rows = documents.selectExpr("doc_id", f"coalesce({text}, '') as text")
    by_salt = _by_salt(rows, spec or Combining())
    members = by_salt.mapInArrow(_salted(winners=False), _MEMBER_ROW)
    named = _by_digest(by_salt).mapInArrow(_global(whole_rows=False), _NAMED_ROW)
    told = members.join(named, ["digest", "salt", "variant"]).selectExpr(
        "keep_id", "group_size", "row = keep_row as best", "digest",
        "posexplode(ids) as (at, doc_id)",
    )
    return told.selectExpr(
        "doc_id", "keep_id", "group_size", "best and at = 0 as kept",
        "lower(hex(digest)) as text_sha256",
    )


def without_copies(
    documents: DataFrame, text: str = "text", spec: Combining | None = None
) -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns."""
    names = ("`" + name.replace("`", "``") + "`" for name in documents.columns)
    rows = documents.selectExpr(
        "doc_id", f"coalesce({text}, '') as text", f"struct({', '.join(names)}) as rest"
    )
    by_salt = _by_salt(rows, spec or Combining())
    kept = T.StructType([rows.schema["rest"]])
    return _by_digest(by_salt).mapInArrow(_global(whole_rows=True), kept).select("rest.*")
