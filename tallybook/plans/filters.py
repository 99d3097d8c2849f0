"""Bloom filters that reduce a fact before it is rolled up or shuffled.

A filter over the keys of the other side is worked out by a scalar subquery, when the query runs, and
every row of the fact whose key is surely not among them is dropped where it is read. Rows that pass
by chance meet no partner in the join that follows, so the filter never changes a result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The filter's size is fixed, so that it is always small enough to be sent to every task.
WORDS = 1 << 17
BITS = WORDS * 64
PROBES = 2


def _bit(key: str, probe: int) -> str:
    return f"pmod(xxhash64({key}, {probe}), {BITS}L)"


def members(keys: DataFrame, key: str) -> DataFrame:
    """One row, one column: the words of a Bloom filter over the ``key`` column of ``keys``."""
    bits = ", ".join(_bit(key, probe) for probe in range(PROBES))
    marked = keys.selectExpr(f"explode(array({bits})) as bit").selectExpr(
        "bit div 64 as word", "shiftleft(1L, cast(bit % 64 as int)) as marks"
    )
    empty = keys.sparkSession.range(WORDS).selectExpr("id as word", "0L as marks")
    words = marked.union(empty).groupBy("word").agg(F.expr("bit_or(marks) as marks"))
    in_order = "array_sort(collect_list(struct(word, marks)))"
    return words.agg(F.expr(f"transform({in_order}, w -> w.marks) as words"))


def reduced(fact: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """``fact`` without most of the rows whose ``column`` is not among the ``key`` values of ``keys``.

    Adding a random number that is always 0 makes Catalyst leave the condition where it is. It would
    else apply it to the other side of the join as well, where every row passes, and where a roll-up
    with a condition of its own would no longer be the one that the filter is made of.
    """
    words = members(keys, key).scalar()

    def marked(probe: int) -> Column:
        bit = F.expr(_bit(column, probe)) + F.rand(0).cast("int")
        return F.getbit(F.get(words, F.floor(bit / 64).cast("int")), bit % 64) == 1

    return fact.where(reduce(and_, map(marked, range(PROBES))))
