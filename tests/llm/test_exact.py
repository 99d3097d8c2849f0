"""Exact duplicates against a plain grouping, on awkward rows and under digests that collide."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from types import SimpleNamespace

import pytest

from tallybook.llm import exact
from tallybook.llm.exact import Combining, exact_duplicates, without_copies

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPECS = {"one block": Combining(), "many blocks": Combining(salts=3, block_bytes=40, block_rows=7)}
specs = pytest.mark.parametrize("spec", SPECS.values(), ids=SPECS.keys())


def plain(rows):
    """keep_id and group_size by text."""
    ids = defaultdict(list)
    for doc_id, text in rows:
        ids[text or ""].append(doc_id)
    return {
        text: (max((i for i in own if i is not None), default=None), len(own))
        for text, own in ids.items()
    }


def crowd(seed, count=600):
    """A third of the rows hold one text, a few texts hold the rest."""
    rng = random.Random(seed)
    texts = ["hot"] + [f"text {i} " * rng.randrange(1, 9) for i in range(120)]
    ids = rng.sample(range(10_000), count)
    return [(i, "hot" if rng.random() < 0.34 else rng.choice(texts)) for i in ids]


@specs
def test_against_plain_grouping(spark, spec):
    rows = crowd(1)
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    expected = plain(rows)
    found = {r.doc_id: r for r in exact_duplicates(table, spec=spec).collect()}
    assert len(found) == len(rows)
    for doc_id, text in rows:
        row = found[doc_id]
        assert (row.keep_id, row.group_size) == expected[text]
        assert row.kept == (doc_id == row.keep_id)
        assert row.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    stay = without_copies(table, spec=spec).collect()
    assert sorted(tuple(r) for r in stay) == sorted((k, t) for t, (k, _) in expected.items())


@specs
def test_different_texts_under_one_digest_stay_apart(spark, spec, monkeypatch):
    def sha256(text):
        return SimpleNamespace(digest=lambda: bytes([len(text) % 2]))

    monkeypatch.setattr(exact, "hashlib", SimpleNamespace(sha256=sha256))
    rows = crowd(2, 300)
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    expected = plain(rows)
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_duplicates(table, spec=spec).collect()}
    assert found == {doc_id: expected[text] for doc_id, text in rows}
    assert without_copies(table, spec=spec).count() == len(expected)


@specs
def test_awkward_rows(spark, awkward, clashing, nothing, spec):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    expected = plain(rows)
    found = exact_duplicates(clashing, spec=spec).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.group_size) for r in found) == sorted(
        (str(i), *expected[t or ""]) for i, t in rows
    )
    assert [r.kept for r in found if r.doc_id == 2].count(True) == 1  # it repeats
    assert sum(r.kept for r in found) == len(expected)
    stay = without_copies(clashing, spec=spec)
    assert stay.schema == clashing.schema
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(k) for k, _ in expected.values())
    assert exact_duplicates(nothing, spec=spec).collect() == []
    assert without_copies(nothing, spec=spec).collect() == []


def test_null_ids_and_a_compared_expression(spark):
    rows = [(None, "A"), (None, "a"), (3, "b"), (None, "B"), (-5, "B"), (None, None), (None, "")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = exact_duplicates(table, text="lower(text)").collect()
    by_digest = defaultdict(list)
    for r in found:
        by_digest[r.text_sha256].append((r.doc_id, r.keep_id, r.group_size, r.kept))
    groups = sorted(by_digest.values(), key=str)
    assert [len(g) for g in groups] in ([3, 2, 2], [2, 3, 2], [2, 2, 3])
    for own in groups:
        assert [r[3] for r in own].count(True) == 1
        assert {r[1] for r in own} == ({3} if len(own) == 3 else {None})
    kept = without_copies(table, text="lower(text)").collect()
    assert len(kept) == 3 and (3, "b") in [tuple(r) for r in kept]
