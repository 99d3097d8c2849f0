"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with equal shingle sets are one node. A node's signature is ``trees`` orders of ``depth``
MinHash values. For each tree, the nodes are sorted by their values (a range sort, so no prefix,
however common, stays in one task), and neighbours with a long enough common prefix are candidates.
How far a node looks follows from the crowding of its region, the nodes that share ``shortest`` values in
a tree: up to ``reach`` + 1 of them all meet; in a crowd, a node meets the next ones on either side, and
farther ones only if they share all its values.

A pair whose sketches, half a byte of each MinHash value, differ by five standard deviations more than
those of a link is none; that is looked at first, and no order brings such a pair to the texts.

Candidates come in three rounds. The first takes direct neighbours in a few trees; its confirmed links
already join most copies. The second takes all trees, and only neighbours of different components:
a group of many near copies costs a few candidates for each member, never all pairs. After each,
candidates that are still apart meet the most copied and best linked nodes of each other's component:
in a crowd of variants of one text, a far variant may be a near copy of that text alone.

The third round is exact for all that crowds have left out. Every node that is in a crowd in any tree
takes part, with its shingles ordered from the rarest among those nodes to the most frequent. Let two
texts of sizes m and n be a link; they share at least percent / (100 + percent) of m + n shingles. Where
their first common shingle is the i-th of one and the j-th of the other, counting from 0, they share
min(m - i, n - j) at most. So all pairs of different components meet that have a shingle at places which
allow that many, which the last fifth of a text's shingles never does, nor, for the smaller text, any
but its first ninth. Texts on one template differ in their rarest shingles, so just below a link even
a shingle that all of them have brings no two together.

Every candidate is confirmed on full shingle sets.

A region that is no crowd is in one task of the sort as a whole, so all its nodes meet wherever the
tasks' bounds are; only crowds are dealt to several tasks.

Chance of missing a link of similarity 0.8: (1 - 0.8**3)**20, under 1e-6, that its ends share three
values in no tree.

Defined cases: a null or blank text has an empty set and no links; fewer words than ``size``: one
shingle; repeated rows: one node; a null id never names a component with other ids in it, and a
component without any id has the id null. ``kept`` holds for the rows whose id is their component's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.shared import BROADCAST_BYTES, as_bytes, components, narrow, settled
from tallybook.llm.tokens import blocks, mixed

NODES_PER_TASK = 50_000
ROW = "xxhash64(doc_id, text)"
# Nodes of one component that a node of a crowd meets on a side of it, if others of both lie between.
CROWD = 3
# Nodes with one shingle in an early place that one task compares with all that have it.
NODES_PER_BLOCK = 4_096


@dataclass(frozen=True)
class Forest:
    """``size`` words a shingle; links have a Jaccard similarity of ``percent`` / 100 or more."""

    size: int = 5
    percent: int = 80
    trees: int = 20
    depth: int = 6
    first_trees: int = 4
    shortest: int = 3
    reach: int = 12

    @property
    def crowd(self) -> int:
        """Nodes in a region from which on it is a crowd: not all of them meet by the order alone."""
        return self.reach + 2

    @property
    def sketch(self) -> int:
        """Bytes of a sketch, each of two MinHash values."""
        return self.trees * self.depth // 2


def distinct(shingles: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    ordered = np.sort(shingles)
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))] if len(ordered) else ordered


def _signatures(forest: Forest):
    """Per document: number of shingles, name of its set, MinHash values of all trees, and a sketch
    of half a byte of each value."""
    functions = forest.trees * forest.depth
    odd = mixed(np.arange(functions, dtype=np.uint64), seed=1).astype(np.uint32) | np.uint32(1)
    other = mixed(np.arange(functions, dtype=np.uint64), seed=2).astype(np.uint32) | np.uint32(1)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, texts = batch.column(0), batch.column(1), as_bytes(batch.column(2))
            for start, words in blocks(texts):
                shingles, bounds = words.shingles(forest.size)
                counts, names = np.zeros(len(words), dtype=np.int64), [None] * len(words)
                signed, looks = [None] * len(words), [None] * len(words)
                full = np.flatnonzero(np.diff(bounds))
                if len(full):
                    short = (shingles >> np.uint64(32)).astype(np.uint32)
                    values = np.empty((len(full), functions), dtype=">u4")
                    for k in range(functions):
                        least = np.minimum.reduceat(short * odd[k], bounds[:-1][full])
                        values[:, k] = least * other[k]  # spread evenly, for the range sort
                    halves = values.view(np.uint8)[:, : 8 * forest.sketch : 4] & 15
                    halves = halves[:, ::2] | halves[:, 1::2] << 4
                    for row, i in enumerate(full):
                        own = distinct(shingles[bounds[i] : bounds[i + 1]])
                        counts[i] = len(own)
                        names[i] = blake2b(own.tobytes(), digest_size=16).digest()
                        signed[i], looks[i] = values[row].tobytes(), halves[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, len(words)),
                        rows.slice(start, len(words)),
                        pa.array(counts),
                        pa.array(names, type=pa.binary()),
                        pa.array(signed, type=pa.binary()),
                        pa.array(looks, type=pa.binary()),
                    ],
                    names=["doc_id", "row", "n_shingles", "node", "signature", "sketch"],
                )

    return described


def _alike(left: pa.Array, right: pa.Array, forest: Forest) -> np.ndarray:
    """Which pairs of sketches do not rule the similarity out by five standard deviations."""
    a, b = (
        np.frombuffer(b"".join(side.to_pylist()), dtype=np.uint8).reshape(-1, forest.sketch)
        for side in (left, right)
    )
    differ = a ^ b
    same = (((differ & 15) == 0).mean(axis=1) + ((differ & 240) == 0).mean(axis=1)) / 2
    wanted = (1 + 15 * forest.percent / 100) / 16  # half bytes may agree by chance
    return same >= wanted - 5 * (wanted * (1 - wanted) / (2 * forest.sketch)) ** 0.5


def _neighbours(forest: Forest, reach: int):
    """Candidates from rows sorted by tree and values: (a, b), nodes of different components."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            known = 0 if held is None else held.num_rows
            if known:
                rows = pa.concat_tables([held, rows])
            held = rows.slice(max(0, rows.num_rows - reach - 1))
            size = forest.depth * 4 + 1
            joined = b"".join(rows["key"].to_pylist())
            keys = np.frombuffer(joined, dtype=np.uint8).reshape(-1, size)
            tree, values = keys[:, 0], np.ascontiguousarray(keys[:, 1:]).view(np.uint32)
            sketches = rows["sketch"].combine_chunks()
            labels = pc.coalesce(rows["label"], rows["node"])
            names = b"".join(labels.to_pylist())
            codes = np.frombuffer(names, dtype=np.uint64)[::2]  # half a label tells them apart
            regions = np.ascontiguousarray(keys[:, : 1 + 4 * forest.shortest])
            new = np.concatenate(([True], (regions[1:] != regions[:-1]).any(axis=1)))
            region = np.cumsum(new) - 1
            crowded = (np.bincount(region) >= forest.crowd)[region]
            ahead = []
            for offset in range(1, min(reach, len(keys) - 1) + 1):
                near = (tree[:-offset] == tree[offset:]) & (
                    values[:-offset, : forest.shortest] == values[offset:, : forest.shortest]
                ).all(axis=1)
                near &= codes[:-offset] != codes[offset:]
                if offset > 1:  # in a crowd only those with all values
                    whole = (values[:-offset] == values[offset:]).all(axis=1)
                    near &= ~crowded[:-offset] | whole
                # Of a component that crowds between, the nearest are enough; its hubs come later.
                left, right = codes[:-offset], codes[offset:]
                crowd = np.zeros((2, len(left)), dtype=np.int8)
                for between in range(1, offset):
                    middle = codes[between : len(codes) - offset + between]
                    crowd[0] += middle == right
                    crowd[1] += middle == left
                near &= ~crowded[:-offset] | (crowd < CROWD).any(axis=0)
                near[: max(0, known - offset)] = False  # seen with the batch before
                first = np.flatnonzero(near)
                ahead.append(np.stack((first, first + offset)))
            if not ahead:
                continue
            a, b = np.concatenate(ahead, axis=1)
            alike = _alike(sketches.take(pa.array(a)), sketches.take(pa.array(b)), forest)
            a, b = a[alike], b[alike]
            nodes = rows["node"].combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["a", "b"]
            )

    return found


def _regions(nodes: DataFrame, forest: Forest) -> DataFrame:
    """(node, region) for each tree; nodes share a region if they share ``shortest`` values there."""
    width = forest.depth * 4
    prefix = f"substring(signature, tree * {width} + 1, {4 * forest.shortest})"
    return nodes.selectExpr(
        "node", "signature", f"explode(sequence(0, {forest.trees - 1})) as tree"
    ).selectExpr("node", f"concat(unhex(lpad(hex(tree), 2, '0')), {prefix}) as region")


def _crowds(nodes: DataFrame, forest: Forest) -> DataFrame:
    """The regions that are crowds, settled."""
    counts = _regions(nodes, forest).groupBy("region").count()
    return settled(counts.where(f"count >= {forest.crowd}").select("region"), "crowds")


def _candidates(
    nodes: DataFrame, crowds: DataFrame, forest: Forest, trees: int, reach: int, count: int
) -> DataFrame:
    """Distinct candidate pairs from the first ``trees`` trees; ``nodes``: node, label, sketch, signature."""
    width = forest.depth * 4
    rows = nodes.selectExpr(
        "node", "label", "sketch", "signature", f"explode(sequence(0, {trees - 1})) as tree"
    ).selectExpr(
        "node",
        "label",
        "sketch",
        f"concat(unhex(lpad(hex(tree), 2, '0')),"
        f" substring(signature, tree * {width} + 1, {width})) as key",
    ).withColumn("region", F.expr(f"substring(key, 1, {1 + 4 * forest.shortest})"))
    tasks = max(1, count * trees // NODES_PER_TASK)
    crowds = crowds.withColumn("crowded", F.lit(True))
    if crowds.count() * 80 <= BROADCAST_BYTES:
        crowds = F.broadcast(crowds)
    rows = rows.join(crowds, "region", "left").withColumn(
        "spread", F.expr("if(crowded, concat(key, node), region)")
    )
    pairs = (
        rows.repartitionByRange(tasks, "spread")
        .sortWithinPartitions("key", "node")
        .select("node", "label", "sketch", "key")
        .mapInArrow(_neighbours(forest, reach), "a binary, b binary")
    )
    return pairs.selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()


def _in_crowds(labelled: DataFrame, crowds: DataFrame, forest: Forest) -> DataFrame:
    """(row, node, label) of the nodes that share ``shortest`` values with a crowd in any tree."""
    found = narrow(_regions(labelled, forest), "region", crowds, 80).select("node").distinct()
    return settled(
        labelled.join(found, "node").selectExpr("row", "node", "coalesce(label, node) as label"),
        "crowded",
    )


def _shingles_of(size: int):
    """The distinct shingles of each node's text, as rows, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, words in blocks(as_bytes(batch["text"])):
                shingles, bounds = words.shingles(size)
                own = [distinct(shingles[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                counts = np.array([len(s) for s in own])
                at = pa.array(np.repeat(np.arange(len(own)) + start, counts))
                hashes = pa.array(np.concatenate(own).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch["code"].take(at), pa.array(np.repeat(counts, counts)), hashes],
                    names=["code", "n", "shingle"],
                )

    return run


def _crowd_candidates(crowded: DataFrame, documents: DataFrame, forest: Forest) -> DataFrame:
    """All pairs of crowded nodes of different components that the places of a shingle allow."""
    wanted = forest.percent
    code = "cast(conv(hex(substring({}, 1, 8)), 16, -10) as bigint)"
    codes = crowded.selectExpr(
        "node", f"{code.format('node')} as code", f"{code.format('label')} as label"
    )
    texts = texts_of(documents, crowded.select("row", "node"))
    shingles = settled(
        texts.selectExpr(f"{code.format('node')} as code", "text").mapInArrow(
            _shingles_of(forest.size), "code bigint, n bigint, shingle bigint"
        ),
        "shingles",
        portions=True,
    )
    # A shingle that one node has brings no two together: only the number of those is needed.
    shared = shingles.groupBy("shingle").count().where("count > 1")
    placed = (
        shingles.join(shared, "shingle")
        .groupBy("code", "n")
        .agg(F.expr("array_sort(collect_list(struct(count, shingle))) as own"))
        .selectExpr("code", "n", "posexplode(own) as (place, one)", "n - size(own) as alone")
        .selectExpr("code", "n", "n - alone - place as rest", "one.shingle")
        .where(f"100 * rest >= {wanted} * n")
        .join(codes.select("code", "label"), "code")
    )
    placed = settled(placed, "places")
    # The smaller text of a pair has the shingle early.
    early = f"rest * {100 + wanted} >= {2 * wanted} * n"
    met = placed.groupBy("shingle").agg(
        F.expr(f"1 + count(*) div {NODES_PER_BLOCK} as blocks"),
        F.expr(f"count_if({early}) as early"),
        F.expr("min(label) <> max(label) as apart"),
    )
    met = settled(met.where("early > 0 and apart").select("shingle", "blocks"), "meetings")
    placed = placed.join(met, "shingle")
    smaller = placed.where(early).selectExpr(
        "shingle", "pmod(code, blocks) as block", "code as a", "n as na", "rest as ra", "label as la"
    )
    larger = placed.selectExpr(
        "shingle", "explode(sequence(0L, blocks - 1)) as block",
        "code as b", "n as nb", "rest as rb", "label as lb",
    )
    allowed = f"least(ra, rb) * {100 + wanted} >= {wanted} * (na + nb)"
    pairs = (
        smaller.join(larger, ["shingle", "block"])
        .where(f"la <> lb and (na < nb or na = nb and a < b) and {allowed}")
        .select("a", "b")
        .distinct()
    )
    return (
        pairs.join(codes.selectExpr("code as a", "node as x"), "a")
        .join(codes.selectExpr("code as b", "node as y"), "b")
        .selectExpr("least(x, y) as a", "greatest(x, y) as b")
    )


def _confirmed(size: int, percent: int):
    """Pairs whose full shingle sets reach ``percent``; columns a, b, text_a, text_b."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = as_bytes(batch.column(2)), as_bytes(batch.column(3))
            sure = np.zeros(batch.num_rows, dtype=bool)
            texts = [text for pair in zip(left, right, strict=True) for text in pair]
            at = 0
            last: np.ndarray | None = None
            for _, words in blocks(texts):
                shingles, bounds = words.shingles(size)
                for i in range(len(words)):
                    own = distinct(shingles[bounds[i] : bounds[i + 1]])
                    if at % 2:
                        both = len(np.intersect1d(last, own, assume_unique=True))
                        sure[at // 2] = 100 * both >= percent * (len(last) + len(own) - both)
                    last, at = own, at + 1
            yield batch.select([0, 1]).filter(pa.array(sure))

    return compared


def texts_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) for the ``wanted`` (row, node), settled."""
    if wanted.count() * 80 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    return documents.join(wanted, "row").select("node", "text")


def _likely(pairs: DataFrame, nodes: DataFrame, forest: Forest) -> DataFrame:
    """Those of ``pairs`` whose sketches are alike, settled."""

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = _alike(batch.column(2), batch.column(3), forest)
            yield batch.select([0, 1]).filter(pa.array(alike))

    pairs = (
        pairs.join(nodes.selectExpr("node as a", "sketch as sa"), "a")
        .join(nodes.selectExpr("node as b", "sketch as sb"), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(looked, "a binary, b binary")
    )
    return settled(pairs, "candidates")


def _links(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, forest: Forest) -> DataFrame:
    """Those of the candidate ``pairs`` that are links, settled."""
    count = pairs.count()
    used = pairs.selectExpr("a as node").union(pairs.selectExpr("b as node")).distinct()
    wanted = settled(nodes.join(used, "node").select("row", "node"), "wanted", count)
    texts = texts_of(documents, wanted)
    return settled(
        pairs.join(texts.selectExpr("node as a", "text as text_a"), "a")
        .join(texts.selectExpr("node as b", "text as text_b"), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(_confirmed(forest.size, forest.percent), "a binary, b binary"),
        "confirmed",
        portions=True,
    )


def _members(documents: DataFrame, forest: Forest) -> DataFrame:
    """Per row of ``documents``: row (a hash of id and text), doc_id, n_shingles, and the label of its
    component, null without shingles."""
    documents = documents.selectExpr("doc_id", f"{ROW} as row", "text")
    described = settled(
        documents.mapInArrow(
            _signatures(forest),
            "doc_id bigint, row bigint, n_shingles bigint, node binary, signature binary,"
            " sketch binary",
        ),
        "signatures",
        portions=True,
    )
    nodes = settled(
        described.where("node is not null")
        .groupBy("node")
        .agg(
            F.min("row").alias("row"),
            F.first("sketch").alias("sketch"),
            F.first("signature").alias("signature"),
            F.count("*").alias("copies"),
        ),
        "nodes",
    )
    count = nodes.count()
    crowds = _crowds(nodes, forest)
    links = labels = None
    for trees, reach in ((forest.first_trees, 1), (forest.trees, forest.reach)):
        labelled = (
            nodes.withColumn("label", F.lit(None).cast("binary"))
            if labels is None
            else nodes.join(labels, "node", "left")
        )
        pairs = settled(_candidates(labelled, crowds, forest, trees, reach, count), "neighbours")
        found = _links(pairs, nodes, documents, forest)
        links = found if links is None else links.union(found)
        labels = components(links, "binary")
        pairs = _hub_candidates(pairs, links, labels, nodes)
        links = links.union(_links(_likely(pairs, nodes, forest), nodes, documents, forest))
        labels = components(links, "binary")

    crowded = _in_crowds(nodes.join(labels, "node", "left"), crowds, forest)
    if crowded.count():
        pairs = _likely(_crowd_candidates(crowded, documents, forest), nodes, forest)
        links = links.union(_links(pairs, nodes, documents, forest))
        labels = components(links, "binary")
    members = described.join(labels, "node", "left")
    return members.selectExpr("row", "doc_id", "n_shingles", "coalesce(label, node) as label")


def near_duplicates(documents: DataFrame, forest: Forest | None = None) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    members = _members(documents, forest or Forest())
    named = members.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return members.join(named, "label", "left").selectExpr(
        "doc_id",
        "n_shingles",
        "if(label is null, doc_id, least) as component_id",
        "doc_id <=> if(label is null, doc_id, least) as kept",
    )


def _hub_candidates(
    pairs: DataFrame, links: DataFrame, labels: DataFrame, nodes: DataFrame
) -> DataFrame:
    """The ends of ``pairs`` still apart, each with the hubs around the other end.

    Hubs of a component are its most copied and its most linked node, in each of two halves of it.
    """
    ends = links.selectExpr("explode(array(a, b)) as node").groupBy("node").count()
    hubs = (
        ends.join(labels, "node")
        .join(nodes.select("node", "copies"), "node")
        .groupBy("label", F.expr("pmod(xxhash64(node), 2)"))
        .agg(
            F.min(F.struct(-F.col("copies"), "node")).alias("copied"),
            F.min(F.struct(-F.col("count"), "node")).alias("linked"),
        )
        .selectExpr("label", "explode(array(copied.node, linked.node)) as hub")
    )
    apart = (
        pairs.join(labels.selectExpr("node as a", "label as la"), "a", "left")
        .join(labels.selectExpr("node as b", "label as lb"), "b", "left")
        .selectExpr("a", "b", "coalesce(la, a) as la", "coalesce(lb, b) as lb")
        .where("la <> lb")
    )
    around = apart.selectExpr("stack(2, a, lb, b, la) as (node, label)").distinct()
    return (
        around.join(hubs, "label")
        .selectExpr("least(node, hub) as a", "greatest(node, hub) as b")
        .distinct()
    )


def deduplicated(documents: DataFrame, forest: Forest | None = None) -> DataFrame:
    """``documents`` with one row for each group of near-duplicates, repeated rows included.

    The row with the least id stays, one without an id only if none has one; of rows with that id and
    different texts the one with the least hash, of equal rows any. Rows without shingles are in no
    group; repeated ones are one.
    """
    members = _members(documents, forest or Forest())
    first = "min(struct(doc_id is null as unknown, doc_id, row)).row as row"
    kept = (
        members.where("label is not null")
        .groupBy("label")
        .agg(F.expr(first))
        .select("row")
        .union(members.where("label is null").select("row"))
    )
    rows = members.groupBy("row").agg(F.expr("count(*) as times"))
    kept = settled(kept.distinct().join(rows, "row"), "kept")
    kept = kept.withColumnsRenamed({"row": "kept_row_", "times": "kept_times_"})
    if kept.count() * 40 <= BROADCAST_BYTES:
        kept = F.broadcast(kept)
    found = documents.join(kept, F.expr(f"{ROW} = kept_row_"))
    repeated = found.where("kept_times_ > 1").dropDuplicates(["kept_row_"])
    return found.where("kept_times_ = 1").union(repeated).select(*(f"`{name}`" for name in documents.columns))
