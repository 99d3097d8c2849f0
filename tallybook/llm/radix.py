"""A distributed LSD radix sort: rows of a table numbered in the order of integer keys.

Rows lie in chunks of ``CHUNK_ROWS`` consecutive places, spread over the tasks. A pass is a stable
counting sort by one digit of the composite key, least significant digit first:

1. each chunk puts its rows in the order of their places, reads their digits, and counts for each row
   how many rows of its chunk with the same digit come before it;
2. the counts by chunk and digit are summed up: a row's place is the number of rows with smaller
   digits, plus those of its digit in chunks before its own, plus those before it in its own;
3. rows go to the chunks of their new places.

Nothing is ever sorted or held as a whole: a task holds a chunk, and the counts are at most a digit's
values for each chunk. A key that a third of the rows share makes a digit with many rows, which still
lie in as many chunks as any other rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.shared import settled

CHUNK_ROWS = 1 << 13
DIGIT_BITS = 11


@dataclass(frozen=True)
class Key:
    """An integer column without nulls and how it is ordered."""

    column: str
    descending: bool = False


@dataclass(frozen=True)
class _Digit:
    """``bits`` bits of a key from ``shift`` on, counted from ``origin``, the key's first value."""

    column: str
    descending: bool
    origin: int
    shift: int
    bits: int

    def of(self, rows: pa.RecordBatch | pa.Table) -> np.ndarray:
        values = rows[self.column].to_numpy().astype(np.int64).view(np.uint64)
        origin = np.uint64(self.origin % (1 << 64))
        away = origin - values if self.descending else values - origin  # modulo 2**64
        return (away >> np.uint64(self.shift)).astype(np.int64) & ((1 << self.bits) - 1)


def digits(keys: Sequence[Key], bounds: dict[str, tuple[int, int]], digit_bits: int) -> list[_Digit]:
    """The digits of the composite key, least significant first, as wide as the keys' ranges need."""
    found = []
    for key in reversed(keys):
        least, most = bounds[key.column]
        width = (most - least).bit_length()
        passes = -(-width // digit_bits)
        for k in range(passes):
            low, high = width * k // passes, width * (k + 1) // passes
            origin = most if key.descending else least
            found.append(_Digit(key.column, key.descending, origin, low, high - low))
    return found


def before_in_chunk(digit: np.ndarray) -> np.ndarray:
    """For each place, how many places before it have the same digit."""
    counts = np.bincount(digit)
    order = np.argsort(digit, kind="stable")
    starts = np.cumsum(counts) - counts
    before = np.empty(len(digit), dtype=np.int64)
    before[order] = np.arange(len(digit)) - starts[digit[order]]
    return before


def _counted(rows: pa.Table, digit: _Digit, chunk: int, names: list[str]) -> pa.Table:
    """A chunk's rows in their order, with digit and count."""
    own = digit.of(rows)
    columns = [rows[name] for name in names]
    columns += [pa.array(np.full(len(own), chunk)), pa.array(own), pa.array(before_in_chunk(own))]
    return pa.table(columns, names=[*names, "chunk", "digit", "before"])


def _first(digit: _Digit, names: list[str]) -> Callable:
    """Step 1 of the first pass: rows have no places yet, and batches serve as chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                rows = pa.Table.from_batches([batch.slice(start, CHUNK_ROWS)])
                yield from _counted(rows, digit, chunk, names).combine_chunks().to_batches()
                chunk += 1

    return run


def _next(digit: _Digit, names: list[str]) -> Callable:
    """Step 1 of a later pass, over one chunk: every row is put where its place says."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        at = np.empty(rows.num_rows, dtype=np.int64)
        at[rows["place"].to_numpy() % CHUNK_ROWS] = np.arange(rows.num_rows)
        return _counted(rows.take(pa.array(at)), digit, rows["chunk"][0].as_py(), names)

    return run


def _placed(counted: DataFrame, names: list[str]) -> DataFrame:
    """Steps 2 and 3: rows with their new ``place`` and ``chunk``."""
    counts = counted.groupBy("digit", "chunk").agg(F.expr("count(*) as n"))
    by_digit = counts.groupBy("digit").agg(F.expr("sum(n) as n"))
    smaller = by_digit.selectExpr(  # as many rows as a digit has values
        "digit", "sum(n) over (order by digit) - n as smaller"
    )
    in_digit = "sum(n) over (partition by digit order by chunk) - n"
    starts = counts.selectExpr("digit", "chunk", f"{in_digit} as earlier").join(
        F.broadcast(smaller), "digit"
    )
    starts = starts.selectExpr("digit", "chunk", "smaller + earlier as start")
    return (
        counted.join(starts, ["digit", "chunk"])
        .selectExpr(*names, "start + before as place")
        .selectExpr("*", f"place div {CHUNK_ROWS} as chunk")
    )


def numbered(rows: DataFrame, keys: Sequence[Key], digit_bits: int = DIGIT_BITS) -> DataFrame:
    """``rows`` (settled) with ``place``, 0 for the first in the order of ``keys``, the first of
    which decides first.

    Rows with equal keys are numbered in any order. The names ``place``, ``chunk``, ``digit`` and
    ``before`` must be free.
    """
    names = rows.columns
    ends = [f"{f}({key.column}) as {f}_{i}" for i, key in enumerate(keys) for f in ("min", "max")]
    found = rows.selectExpr("count(*) as n", *ends).first()
    if not found.n:
        return rows.selectExpr("*", "0L as place")
    bounds = {key.column: (found[f"min_{i}"], found[f"max_{i}"]) for i, key in enumerate(keys)}
    steps = digits(keys, bounds, digit_bits) or [_Digit(keys[0].column, False, 0, 0, 1)]
    added = T.StructType.fromDDL("chunk bigint, digit bigint, before bigint")
    schema = T.StructType([*rows.schema, *added])
    counted = settled(rows.mapInArrow(_first(steps[0], names), schema), "counted")
    for step in steps[1:]:
        by_chunk = _placed(counted, names).groupBy("chunk")
        counted = settled(by_chunk.applyInArrow(_next(step, names), schema), "counted")
    return _placed(counted, names).drop("chunk")
