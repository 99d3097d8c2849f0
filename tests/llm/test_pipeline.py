"""The pipeline over small tables with planted cases, against plain versions of its stages."""

from __future__ import annotations

import random

import corpus_pipeline
import pyarrow as pa
import pytest

from tallybook.llm.shared import PORTION_BYTES

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, count, kind="w"):
    return [f"{kind}{rng.randrange(4_000)}" for _ in range(count)]


def shingles(text):
    own = text.lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and poor documents, near copies, a shared passage, and benchmark items."""
    rng = random.Random(5)
    rows, labels, planted = [], [], {}
    items = [" ".join(prose(rng, 30, "b")) for _ in range(6)]
    passage = " ".join(prose(rng, 70, "p"))

    def add(doc_id, text, quality=1):
        rows.append((doc_id, text, "en", f"s{doc_id % 2}", len(text)))
        labels.append((doc_id, quality, 0))

    for i in range(160):
        add(i, " ".join(prose(rng, rng.randrange(60, 160))))
    for i in range(160, 240):
        add(i, " ".join(prose(rng, rng.randrange(60, 160), "junk")), quality=0)
    for i in range(0, 20, 2):
        words = rows[i][1].split()
        words[len(words) // 2] = "changed"
        planted[300 + i] = "copy"
        add(300 + i, " ".join(words) if i % 4 else rows[i][1])
    for k, item in enumerate(items):
        planted[400 + k] = "benchmark"
        add(400 + k, " ".join([*prose(rng, 40), item, *prose(rng, 40)]))
    for k in range(5):
        planted[500 + k] = "passage"
        add(500 + k, " ".join([*prose(rng, 60), passage, *prose(rng, 60)]))
    target = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{target}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{target}/labels.parquet"
    )
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(
        f"{target}/benchmark.parquet"
    )
    return str(target), rows, planted, passage


def test_stages_take_what_their_predecessor_kept(spark, folder):
    path, rows, planted, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, texts = docs.columns, {r[0]: r[1] for r in rows}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        found = [r.asDict() for r in docs.collect()]
        if name != "mixing_to_weights":
            assert docs.columns == columns
            assert len({r["doc_id"] for r in found}) == len(found)
            kept[name] = {r["doc_id"]: r["text"] for r in found}
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    judged, distinct, cut, clean = kept.values()
    good = {i for i in texts if not 160 <= i < 240}
    assert len(good & set(judged)) > 0.95 * len(good) and len(set(judged) - good) < 8
    # Near copies, by all pairs of what came in.
    sets = {i: shingles(t) for i, t in judged.items()}
    for i in judged:
        for j in judged:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                assert j not in distinct and i in distinct
    assert set(judged) - set(distinct) == {i for i in judged if planted.get(i) == "copy"}
    # One text keeps the passage; the others lose it, and what is around it stays.
    holders = [i for i in distinct if passage in distinct[i]]
    assert len(holders) >= 4 and sum(passage in cut[i] for i in cut) == 1
    assert set(cut) == set(distinct)
    for i in cut:
        if i not in holders:
            assert cut[i] == distinct[i]
    assert set(cut) - set(clean) == {i for i in cut if planted.get(i) == "benchmark"}
    last = found
    assert {r["doc_id"] for r in last} <= set(clean)
    size = {i: len(t.split()) for i, t in clean.items()}
    for r in last:
        assert 0 < r["taken"] <= size[r["doc_id"]] and 0 <= r["due"] <= 1


def test_run_is_all_stages(spark, folder):
    path, _, planted, _ = folder
    found = corpus_pipeline.run(spark, path).collect()
    ids = {r.doc_id for r in found}
    assert ids and not {i for i in ids if planted.get(i) in ("copy", "benchmark")}
    assert [r.due for r in found] == sorted(r.due for r in found)


def test_run_on_empty_tables(spark, folder, tmp_path):
    path, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_texts_go_to_python_in_portions(spark, folder):
    """Also in the query that the caller of a stage runs."""
    path, *_ = folder
    rng = random.Random(6)
    texts = [(i, " ".join(prose(rng, 2_000)), "en", "s", 0) for i in range(1_600)]
    docs = spark.createDataFrame(texts, DOCUMENTS).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    portion = "spark.sql.execution.arrow.maxBytesPerBatch"
    for stage in (corpus_pipeline.quality, corpus_pipeline.decontaminate):
        spark.conf.unset(portion)
        kept = stage(spark, docs, path)
        portions = [r.n for r in kept.mapInArrow(sizes, "n bigint").collect()]
        assert sum(portions) > 2 * PORTION_BYTES and max(portions) < 1.2 * PORTION_BYTES
    spark.conf.unset(portion)


def test_texts_are_not_shuffled_to_the_offsets_of_their_streams(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plan = corpus_pipeline.mix(spark, docs, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    # What is sorted and merged are targets and offsets of sources; the texts' join is the other one.
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1
