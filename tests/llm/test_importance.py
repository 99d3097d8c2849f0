"""Radix sort, hashed features and the draw, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallybook.llm import radix
from tallybook.llm.importance import (
    Draw,
    Features,
    crcs,
    importance_ranks,
    resampled,
)
from tallybook.llm.radix import Key, before_in_chunk, digits, numbered

TEXTS = "doc_id bigint, text string"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").encode().lower())


def features_of(text, runs):
    own = words_of(text)
    return [b" ".join(own[i : i + n]) for n in range(1, runs + 1) for i in range(len(own) - n + 1)]


def plain(documents, target, spec):
    """doc_id, n_features, weight, score and rank of each row, ranks in the order of ids."""

    def buckets(text):
        return [zlib.crc32(f) % spec.buckets for f in features_of(text, spec.runs)]

    raw = Counter(b for _, text in documents for b in buckets(text))
    wanted = Counter(b for text in target for b in buckets(text))
    all_raw, all_wanted = sum(raw.values()), sum(wanted.values())

    def gain(b):
        up = (wanted[b] + 1.0) * (all_raw + spec.buckets)
        return math.floor(spec.scale * math.log(up / ((raw[b] + 1.0) * (all_wanted + spec.buckets))))

    rows = []
    for doc_id, text in documents:
        weight, score = sum(map(gain, buckets(text))), None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{spec.seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            noise = math.floor(-spec.scale * math.log(-math.log((h + 0.5) / 2**32)))
            score = weight + noise
        rows.append([doc_id, len(buckets(text)), weight, score, None, len(words_of(text))])
    able = [r for r in rows if r[5] >= spec.least_words and r[3] is not None]
    able.sort(key=lambda r: (-r[3], r[0]))
    for place, row in enumerate(able[: spec.percent * len(able) // 100], 1):
        row[4] = place
    return [tuple(r[:5]) for r in rows]


def found(frame):
    return [(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in frame.collect()]


def test_crcs_of_slices():
    rng = random.Random(1)
    buffer = bytes(rng.randrange(256) for _ in range(5_000))
    starts, ends, at = [], [], 0
    while at < 4_700:
        starts.append(at + rng.randrange(3))
        ends.append(starts[-1] + rng.choice((1, 2, 7, 63, 64, 65, 200)))
        at = ends[-1]
    expected = [zlib.crc32(buffer[a:b]) for a, b in zip(starts, ends, strict=True)]
    assert crcs(buffer, np.array(starts), np.array(ends)).tolist() == expected
    assert crcs(b"", np.empty(0, np.int64), np.empty(0, np.int64)).tolist() == []


@pytest.mark.parametrize("runs", [1, 3])
def test_features_of_a_block(runs):
    spec = Draw(runs=runs)
    texts = [b"", None, "Äb c-D 9é_x".encode(), b"one", b" \n", b"a b c d e", b"X" * 300]
    block = Features(texts, spec)
    own = [block.buckets[a:b].tolist() for a, b in zip(block.bounds, block.bounds[1:], strict=False)]
    for got, text in zip(own, texts, strict=True):
        words = features_of((text or b"").decode(), runs)
        assert sorted(got) == sorted(zlib.crc32(w) % spec.buckets for w in words)
    assert block.words.tolist() == [len(words_of((t or b"").decode())) for t in texts]


def test_digits_cover_the_keys_and_no_more():
    keys = [Key("a", descending=True), Key("b")]
    own = digits(keys, {"a": (-5, 2**20), "b": (7, 7)}, 11)
    assert [(d.column, d.shift, d.bits) for d in own] == [("a", 0, 10), ("a", 10, 11)]
    assert before_in_chunk(np.array([2, 0, 2, 2, 0])).tolist() == [0, 0, 1, 2, 1]


@pytest.mark.parametrize("spread", [3, 2**63 - 1], ids=["ties", "whole range"])
def test_radix_sort(spark, monkeypatch, spread):
    monkeypatch.setattr(radix, "CHUNK_ROWS", 64)
    rng = random.Random(spread)
    rows = [(rng.randint(-spread - 1, spread), rng.randint(-40, 40), i) for i in range(900)]
    rows += [(1, 1, i) for i in range(900, 1400)]  # a third of the rows has one key
    table = spark.createDataFrame(rows, "a bigint, b bigint, i bigint").repartition(7)
    placed = numbered(table, [Key("a", descending=True), Key("b")], digit_bits=16).collect()
    placed = sorted(placed, key=lambda r: r.place)
    assert [r.place for r in placed] == list(range(1400))
    order = sorted(((a, b) for a, b, _ in rows), key=lambda r: (-r[0], r[1]))
    assert [(r.a, r.b) for r in placed] == order
    assert sorted(r.i for r in placed) == list(range(1400))


def test_radix_sort_of_one_key_value_and_of_nothing(spark):
    same = spark.createDataFrame([(4,)] * 5, "a bigint")
    assert sorted(r.place for r in numbered(same, [Key("a")]).collect()) == [0, 1, 2, 3, 4]
    assert numbered(same.where("a = 0"), [Key("a")]).collect() == []


@pytest.mark.parametrize("spec", [Draw(), Draw(runs=2, buckets=50, scale=3, percent=40)])
def test_draw_against_plain(spark, monkeypatch, spec):
    monkeypatch.setattr(radix, "CHUNK_ROWS", 32)
    rng = random.Random(4)
    texts = [
        (i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice((0, 5, 19, 20, 21, 90)))))
        for i in rng.sample(range(-1_000, 5_000), 260)
    ]
    texts += [(9_000 + i, "same words " * 12) for i in range(120)]
    target = [" ".join(f"W{rng.randrange(20)}" for _ in range(30)) for _ in range(9)]
    documents = spark.createDataFrame(texts, TEXTS).repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    expected = plain(texts, target, spec)
    assert sorted(found(importance_ranks(documents, wanted, spec))) == sorted(expected)
    drawn = resampled(documents, wanted, spec)
    assert drawn.columns == documents.columns
    assert {r.doc_id for r in drawn.collect()} == {r[0] for r in expected if r[4]}


def test_awkward_rows(spark, awkward, clashing, nothing):
    target = spark.createDataFrame([(1, "w1 w2 same"), (2, None)], "item_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    spec = Draw(percent=100)
    expected = plain(rows, ["w1 w2 same"], spec)
    got = found(importance_ranks(clashing, target, spec))
    assert sorted(map(str, (r[:4] for r in got))) == sorted(map(str, (r[:4] for r in expected)))
    assert sorted(r[4] for r in got if r[4]) == [1, 2, 3, 4, 5, 6]  # document 2 has two rows
    assert [r[4] for r in got if r[0] is None] == [None]
    assert resampled(clashing, target, spec).columns == ["doc_id", *clashing.columns[1:]]
    assert importance_ranks(nothing, target).collect() == []
    without = found(importance_ranks(awkward, target.where("false"), spec))
    assert sorted(map(str, (r[:4] for r in without))) == sorted(
        map(str, (r[:4] for r in plain(rows, [], spec)))
    )
