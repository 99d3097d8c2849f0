"""What the operators share: scratch tables, and connected components of a link table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its rows were counted and found to fit in this.
BROADCAST_BYTES = 32 << 20
ROWS_PER_FILE = 100_000
# Texts that go to Python at a time; a portion is at least one row.
PORTION_BYTES = 4 << 20
LINKS_PER_TASK = 500_000


def scratch_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session's ``spark.checkpoint.dir`` names it.

    Only a session on one machine may leave it unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="checkpoints-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# Whether Spark removes a query's shuffle files as soon as the query is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PORTION = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_portions(spark: SparkSession) -> None:
    """From now on, rows of the session go to Python ``PORTION_BYTES`` at a time."""
    spark.conf.set(_PORTION, str(PORTION_BYTES))


def settled(
    frame: DataFrame,
    name: str,
    rows: int | None = None,
    clean: bool = False,
    portions: bool = False,
) -> DataFrame:
    """``frame`` written as a table to the scratch folder, and read from there.

    Later steps neither recompute it nor depend on the executors that made it. ``rows``, if known,
    is about how many there are; a few rows are then written by a few tasks. With ``clean`` the
    shuffle files that writing it took go at once, not when the driver happens to collect its garbage.
    With ``portions`` rows go to Python ``PORTION_BYTES`` at a time, not as many as ten thousand texts.
    """
    if rows is not None:
        frame = frame.coalesce(1 + rows // ROWS_PER_FILE)
    spark = frame.sparkSession
    path = f"{scratch_folder(spark)}/tallybook-llm/{name}-{uuid.uuid4().hex}"
    own = ({_CLEANUP: "true"} if clean else {}) | ({_PORTION: str(PORTION_BYTES)} if portions else {})
    before = {key: spark.conf.get(key, None) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        frame.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(frame.schema).parquet(path)


def discarded(frame: DataFrame) -> None:
    """Deletes the table that ``settled`` wrote for ``frame``, which nothing reads any more."""
    spark = frame.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def narrow(frame: DataFrame, key: str, keys: DataFrame, row_bytes: int) -> DataFrame:
    """Rows of ``frame`` whose ``key`` is among ``keys`` (distinct, settled).

    ``keys`` is broadcast if its counted rows fit ``BROADCAST_BYTES``; beyond that both sides are
    shuffled by the key.
    """
    if keys.count() * row_bytes <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    return frame.join(keys, key, "left_semi")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column in UTF-8."""
    return column.cast(pa.binary()).to_pylist()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's links (a, b) with the same components, each as a star around its least node."""
    rows = [batch for batch in batches if batch.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    both = pa.chunked_array([*table["a"].chunks, *table["b"].chunks]).combine_chunks()
    coded = both.dictionary_encode()
    names = coded.dictionary
    places = pc.array_sort_indices(names).to_numpy()
    rank = np.empty(len(names), dtype=np.int64)
    rank[places] = np.arange(len(names))
    ends = rank[coded.indices.to_numpy()]
    parent = list(range(len(names)))
    for a, b in zip(ends[: table.num_rows].tolist(), ends[table.num_rows :].tolist(), strict=True):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        else:
            parent[a] = b
    for k, above in enumerate(parent):  # a parent is never greater
        parent[k] = parent[above]
    names = names.take(pa.array(places))
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(parent))], names=["a", "b"])


def components(links: DataFrame, kind: str) -> DataFrame:
    """Connected components of ``links`` (a, b): each node with its component's label, a node.

    Tasks first reduce their links, so many each, to stars. If that took several tasks, rounds join
    the stars: each gives every node the least node around it, in a fresh random order, and carries
    the links over to those; a round at least halves the nodes left in expectation. Minima are
    combined before the shuffle, so a hub is one row per task.
    """
    tasks = 1 + links.count() // LINKS_PER_TASK
    links = links.select("a", "b").where("a <> b")
    stars = links.repartition(tasks).mapInArrow(_stars, f"a {kind}, b {kind}")
    stars = settled(stars, "stars")
    if tasks == 1:
        return stars.selectExpr("a as node", "b as label")
    rest = settled(stars.where("a <> b").distinct(), "links")
    steps, salt = [], 0
    while count := rest.count():
        salt += 1

        def ranked(node: str, salt: int = salt) -> str:
            return f"struct(xxhash64({node}, {salt}) as h, {node} as n)"

        step = (
            rest.selectExpr(f"stack(2, a, {ranked('b')}, b, {ranked('a')}) as (node, near)")
            .groupBy("node")
            .agg(F.min("near").alias("near"))
            .selectExpr("node", f"least(near, {ranked('node')}).n as label")
        )
        step = settled(step, "labels", count)
        steps.append(step)
        rest = (
            rest.join(step.selectExpr("node as a", "label as la"), "a")
            .join(step.selectExpr("node as b", "label as lb"), "b")
            .where("la <> lb")
            .selectExpr("least(la, lb) as a", "greatest(la, lb) as b")
            .distinct()
        )
        rest = settled(rest, "links", count)
    if not steps:
        return stars.selectExpr("a as node", "b as label")

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        onward = second.selectExpr("node as label", "label as onward")
        return first.join(onward, "label", "left").selectExpr(
            "node", "coalesce(onward, label) as label"
        )

    return settled(reduce(then, steps), "components")
