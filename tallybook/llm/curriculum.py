"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

1. Shares. Sources by name weigh ``weights`` in turn and share ``percent`` of all words. A target
   stops at ``repeats`` times its source; the excess goes to the others by weight. That is filling
   vessels to one level: with t the words for one unit of weight, a target is the lesser of weight
   times t and its cap, and t follows from cumulative sums over the sources by cap per weight.
2. Take. A source's documents form a stream in the order of hashed ids, as often as it repeats, and
   the mix takes the stream's first words up to the target, so a document gives at most ``repeats``
   times its words. The cumulative sums a stream needs are taken per bucket of the hash first and
   within a bucket then, so a hot source is many tasks' work.
3. Positions. A source's weight over training time s in 0..1 is its share times 1 + a (2 s - 1): rising,
   falling or steady by its slope a. The integral, s + a (s**2 - s), is the part of the source's words
   demanded by time s; inverting it at the middle of a document's words in the stream gives the time
   at which the document is due. Rows are range-sorted by that time.

Source tables have a row per distinct source; only they are ordered in one task.

Defined cases: null text has no words and is taken 0 times; a null source is a source and comes last;
empty tables give empty results; ties of the hash are ordered by id and text hash; repeated rows are
documents each; a source without words has target 0; other columns, whatever their names, are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.shared import BROADCAST_BYTES, settled

# Buckets of a source's hashed ids; a bucket is what one task orders at a time.
BUCKETS = 4096
WORDS = r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)
    percent: int = 150
    repeats: int = 2
    #: Slopes in turn: the weight of a source falls, stays or rises over training.
    slopes: tuple[float, ...] = (-0.5, 0.0, 0.5)


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """Per source (source_, source_size): weight, target and slope."""
    turn = f"cast(pmod(place, {len(mix.weights)}) as int)"
    bend = f"cast(pmod(place, {len(mix.slopes)}) as int)"
    # The order of strings is that of their UTF-8 bytes, which is that of code points.
    by_name = Window.orderBy(F.col("source_").asc_nulls_last())
    weighed = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.expr(f"array({', '.join(f'{w}D' for w in mix.weights)})[{turn}]"))
        .withColumn("slope", F.expr(f"array({', '.join(f'{s}D' for s in mix.slopes)})[{bend}]"))
        .withColumn("cap", F.expr(f"cast(source_size * {mix.repeats} as double)"))
    )
    every = Window.partitionBy()
    filling = Window.orderBy(F.expr("cap / weight"), "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    # Sources in the order in which they fill up. The level is what is left after the caps of those
    # before, for the weights from here on, at the first source that this does not fill.
    level = F.expr("if(level * weight <= cap, struct(nth, level), null)")
    return (
        weighed.withColumn("nth", F.row_number().over(filling))
        .withColumn("share", F.sum("source_size").over(every) * (mix.percent / 100))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("closed", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.col("closed"))
        .withColumn("level", F.expr("(share - full) / open"))
        .withColumn("level", F.min(level).over(every))
        .withColumn("target", F.expr("coalesce(least(cap, level.level * weight), cap)"))
        .select("source_", "source_size", "weight", "slope", "target")
    )


def _streamed(documents: DataFrame, mix: Mix) -> DataFrame:
    """Rows of ``documents`` as own_, with size_, source_size, target, slope, and begin_ in the
    source's stream."""
    own = ", ".join(f"`{name}`" for name in documents.columns)
    rows = documents.selectExpr(
        f"struct({own}) as own_",
        "doc_id as id_",
        "source as source_",
        f"coalesce(cast({WORDS} as bigint), 0L) as size_",
        "xxhash64(doc_id) as hash_",
        "xxhash64(text) as tie_",
    ).withColumn("bucket_", F.expr(f"pmod(hash_, {BUCKETS})"))
    sums = rows.groupBy(F.col("source_").alias("of_source_"), F.col("bucket_").alias("of_bucket_"))
    sums = settled(sums.agg(F.sum("size_").alias("words_")), "bucket-words")
    sizes = sums.groupBy(F.col("of_source_").alias("source_")).agg(
        F.sum("words_").alias("source_size")
    )
    per_source = Window.partitionBy("of_source_").orderBy("of_bucket_")
    earlier = per_source.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sums.withColumn("offset_", F.coalesce(F.sum("words_").over(earlier), F.lit(0)))
        .join(targets(sizes, mix), F.expr("of_source_ <=> source_"))
        .drop("words_", "source_")
    )
    if sums.count() * 100 <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)  # else the texts are shuffled once more, for the join
    within = Window.partitionBy("source_", "bucket_").orderBy("hash_", "id_", "tie_")
    up_to = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("within_", F.sum("size_").over(up_to) - F.col("size_"))
        .join(offsets, F.expr("source_ <=> of_source_ and bucket_ = of_bucket_"))
        .withColumn("begin_", F.expr("offset_ + within_"))
    )


def _taken(turn: str) -> str:
    """Words of a document that the mix takes in one pass over its source."""
    left = f"cast(round(target) as bigint) - begin_ - {turn} * source_size"
    return f"greatest(0L, least(size_, {left}))"


def _due(streamed: DataFrame, mix: Mix) -> DataFrame:
    """A row for each document and pass that takes words of it: pass_, taken_ and due_ are added."""
    part = "least(1D, (begin_ + pass_ * source_size + taken_ / 2D) / target)"
    # s + a (s**2 - s) = part; for a = 0 that is s = part.
    root = f"(slope - 1 + sqrt(power(1 - slope, 2) + 4 * slope * {part})) / (2 * slope)"
    return (
        streamed.selectExpr("*", f"explode(sequence(0, {mix.repeats - 1})) as pass_")
        .withColumn("taken_", F.expr(_taken("pass_")))
        .where("taken_ > 0")
        .withColumn("due_", F.expr(f"if(slope = 0, {part}, {root})"))
    )


def curriculum(documents: DataFrame, mix: Mix | None = None) -> DataFrame:
    """A row for each document and pass over its source, with words taken, and when they are due.

    ``documents`` (doc_id, text, source) with size, source_size, target, pass (from 0), taken and due
    (time in 0..1) in place of its own columns of these names, sorted by due. Documents of which
    nothing is taken are not in it.
    """
    mix = mix or Mix()
    added = ("size", "source_size", "target", "pass", "taken", "due")
    kept = [name for name in documents.columns if name not in added]
    return (
        _due(_streamed(documents.selectExpr(*(f"`{name}`" for name in kept)), mix), mix)
        .selectExpr(
            "own_.*",
            "size_ as size",
            "source_size",
            "target",
            "pass_ as pass",
            "taken_ as taken",
            "due_ as due",
        )
        .orderBy("due", "doc_id", "pass")
    )


def taken_words(documents: DataFrame, mix: Mix | None = None) -> DataFrame:
    """Per document: doc_id, size, source_size, target, and words taken in all passes.

    The training order is written first, without texts: documents and passes with words taken, sorted
    by when they are due. What it takes of a document is read back by its place in its source's stream.
    """
    mix = mix or Mix()
    streamed = _streamed(documents.select("doc_id", "text", "source"), mix).select(
        "id_", "source_", "size_", "source_size", "target", "slope", "begin_"
    )
    streamed = settled(streamed, "streams")
    order = _due(streamed, mix).orderBy("due_", "id_", "pass_")
    order = settled(
        order.select("id_", "source_", "begin_", "pass_", "taken_", "due_"), "training-order"
    )
    taken = order.groupBy(F.col("source_").alias("of_"), F.col("begin_").alias("place_")).agg(
        F.sum("taken_").alias("taken_")
    )
    # A document without words shares its place with the next one.
    return streamed.join(
        taken, F.expr("source_ <=> of_ and begin_ = place_ and size_ > 0"), "left"
    ).selectExpr(
        "id_ as doc_id",
        "size_ as size",
        "source_size",
        "target",
        "coalesce(taken_, 0L) as taken",
    )
