"""Each operator against a plain version of what it computes, and on awkward tables."""

from __future__ import annotations

import hashlib
import html
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tallybook.llm import passages, shared
from tallybook.llm import curriculum as curriculum_module
from tallybook.llm.curriculum import curriculum, taken_words
from tallybook.llm.decontamination import contaminations, decontaminated
from tallybook.llm.language_model import code_of, scored
from tallybook.llm.licenses import notices_found, oracle_sql
from tallybook.llm.minhash_forest import Forest, deduplicated, near_duplicates
from tallybook.llm.passages import Passages, repeated_passages, windows, without_repeats
from tallybook.llm.quality import accepted, assessed
from tallybook.llm.simhash import edited_fingerprints, fingerprint_report
from tallybook.llm.tokens import Words
from tallybook.llm.warc import fields, inflated, normalised, read_back, records_of, written
from tallybook.llm.wrappers import aligned, content_of, folded, main_text, main_texts, stream

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts: dict[int, str]):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCUMENTS)


def prose(rng, count, size=5000):
    return [f"w{rng.randrange(size)}" for _ in range(count)]


def shingles(text, size):
    own = (text or "").lower().split()
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1)))


def test_words_and_shingles():
    own = Words([b"The the\ta \xc3\x84", None, b"x", b"THE a"])
    assert [own.word(i) for i in range(7)] == [
        b"the", b"the", b"a", b"\xc3\x84", b"x", b"the", b"a",
    ]
    assert own.hashes[0] == own.hashes[1] == own.hashes[5]
    hashes, bounds = own.shingles(2)
    assert bounds.tolist() == [0, 3, 3, 4, 5]
    assert hashes[1] == hashes[4] and len(set(hashes.tolist())) == 4


def test_components_in_one_task_and_many(spark, monkeypatch):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    links = [link for link in links if link[0] != link[1]]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    table = spark.createDataFrame(links, "a bigint, b bigint")
    for per_task in (10_000, 40):
        monkeypatch.setattr(shared, "LINKS_PER_TASK", per_task)
        found = {row.node: row.label for row in shared.components(table, "bigint").collect()}
        assert set(found) == {x for link in links for x in link}
        for a in found:
            for b in found:
                assert (found[a] == found[b]) == (root(a) == root(b))


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(1)
    texts, n = {}, 0
    for group in range(12):
        base = prose(rng, rng.choice((8, 40, 120)))
        for _ in range(rng.choice((1, 2, 9))):
            own = list(base)
            for _ in range(rng.choice((0, 1, 1, 2))):
                own[rng.randrange(len(own))] = f"n{rng.randrange(9)}"
            texts[n] = " ".join(own)
            n += 1
    found = {r.doc_id: r for r in near_duplicates(frame(spark, texts), Forest(size=4)).collect()}
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    least = {i: i for i in texts}
    for _ in texts:
        for i in texts:
            for j in texts:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    least[i] = min(least[i], least[j])
    assert {i: r.component_id for i, r in found.items()} == least
    assert all(r.n_shingles == len(sets[i]) for i, r in found.items())
    assert all(r.kept == (least[i] == i) for i, r in found.items())


def test_near_duplicates_on_awkward_rows(spark, awkward, clashing, nothing):
    rows = near_duplicates(clashing).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 12 and by_id[3].component_id == 1 and not by_id[2].kept
    assert by_id[4].n_shingles == 0 and by_id[4].kept and by_id[5].kept and by_id[6].kept
    assert by_id[None].component_id is None and by_id[None].kept
    assert by_id[10].n_shingles == 1 and by_id[7].n_shingles == 1
    assert near_duplicates(nothing).count() == 0
    kept = deduplicated(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 10]


def test_compact_windows_against_their_definition():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    bounds = np.array([0, 90, 95, 200])
    expected = set()
    for k in range(3):
        own = hashes[bounds[k] : bounds[k + 1]].tolist()
        for c, value in enumerate(own):
            left, right = c, c
            while left and own[left - 1] > value:
                left -= 1
            while right + 1 < len(own) and own[right + 1] > value:
                right += 1
            if right - left + 1 >= 12:
                expected.add((k, left, c, right))
    assert set(map(tuple, windows(hashes, bounds, 12).tolist())) == expected


def test_repeated_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(4)
    line = prose(rng, 9)
    shared_ = [prose(rng, 70) for _ in range(4)]
    texts = {}
    for i in range(60):
        own = prose(rng, 80) + line + prose(rng, 30)
        if i % 3 == 0:
            passage = list(shared_[i % 4])
            if i % 2:
                passage[35] = "edited"
            own[20:20] = passage
        texts[i] = " ".join(own)
    found = repeated_passages(frame(spark, texts)).collect()
    keepers = {r.source_id for r in found}
    assert {r.doc_id for r in found} <= {i for i in texts if i % 3 == 0}
    for k in range(4):
        group = {i for i in texts if i % 3 == 0 and i % 4 == k}
        cut = {r.doc_id for r in found if r.start_word <= 24 and r.end_word >= 86}
        assert len(group - cut) == 1 and (group - cut) <= keepers
    kept = {r.doc_id: r for r in without_repeats(frame(spark, texts)).collect()}
    assert set(kept) == set(texts)
    for i in texts:
        if i % 3:
            assert kept[i].text == texts[i]
        assert kept[i].n_chars == len(kept[i].text)
    spans = {r.doc_id: r for r in found}
    for i, span in spans.items():
        own = texts[i].split()
        assert kept[i].text.split() == own[: span.start_word] + own[span.end_word :]


def test_passages_in_a_crowd_of_variants_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 64)
    rng = random.Random(12)
    passage = prose(rng, 60, 100_000)
    texts = {}
    for i in range(200):
        own = list(passage)
        if i != 100:
            own[15 + i % 30] = f"changed{i}"
        texts[i] = " ".join(prose(rng, 40, 100_000) + own + prose(rng, 40, 100_000))
    order = {r.doc_id: r.h for r in frame(spark, texts).selectExpr("doc_id", "xxhash64(text) as h").collect()}
    near = {
        (i, j)
        for i in texts
        for j in texts
        if order[j] < order[i]
        if len((a := shingles(" ".join(texts[i].split()[40:100]), 5)) & (b := shingles(" ".join(texts[j].split()[40:100]), 5)))
        >= 0.8 * len(a | b)
    }
    expected = {i for i, _ in near}
    assert len(expected) > 50
    found = {r.doc_id for r in repeated_passages(frame(spark, texts)).collect() if r.start_word <= 44 and r.end_word >= 96}
    assert len(expected - found) <= len(expected) // 100


def test_passages_around_a_line_that_only_some_portions_have_often(spark):
    rng = random.Random(13)
    line, size = prose(rng, 40, 100_000), 100_000
    around = [(prose(rng, 5, size), prose(rng, 5, size)) for _ in range(12)]

    def text(left, right):
        return " ".join(prose(rng, 30, size) + left + line + right + prose(rng, 30, size))

    # The first quarter of the rows, a portion, has the line often and the last one seldom.
    texts = {i: text(*around[i]) for i in range(12)}
    texts |= {i: text([], []) for i in range(12, 100)}
    texts |= {i: " ".join(prose(rng, 90, size)) for i in range(100, 400)}
    texts |= {300 + i: text(*around[i]) for i in range(12)}
    found = {frozenset((r.doc_id, r.source_id)) for r in repeated_passages(frame(spark, texts)).collect()}
    assert {frozenset((i, 300 + i)) for i in range(12)} <= found


def test_passages_on_awkward_rows(spark, awkward, clashing, nothing):
    found = repeated_passages(clashing).collect()
    assert {(r.doc_id, r.source_id) for r in found} <= {(2, 1), (3, 1), (1, 3), (2, 3)}
    assert (2, 1) in {(r.doc_id, r.source_id) for r in found}
    assert repeated_passages(nothing).count() == 0
    assert without_repeats(nothing).count() == 0
    rest = without_repeats(awkward)
    assert rest.columns == awkward.columns
    assert {r.doc_id for r in rest.collect()} >= {4, 5, 7, 8, 9, 10, None}
    assert repeated_passages(clashing, Passages(words=100)).count() == 0


def test_contaminations_against_every_window(spark):
    rng = random.Random(6)
    items = {k: " ".join(prose(rng, rng.choice((4, 20, 45)))) for k in range(8)}
    texts = {}
    for i in range(40):
        own = prose(rng, 60)
        if i % 4 == 0:
            own[30:30] = items[i % 8].upper().split()
        if i % 4 == 1:
            part = items[1 + i % 7].split()
            own[10:10] = part[: len(part) // 2]
        texts[i] = " ".join(own)
    texts[99] = items[0]
    bench = spark.createDataFrame(
        [*items.items(), (50, None), (51, " "), (52, items[0])], "item_id bigint, text string"
    )
    docs = frame(spark, texts)
    expected = set()
    for i, text in texts.items():
        own = text.lower().split()
        for k, item in [*items.items(), (52, items[0])]:
            wanted = item.lower().split()
            n = len(wanted)
            if n < 5:
                expected |= {(i, k)} if own == wanted else set()
                continue
            target = Counter(tuple(wanted[j : j + 5]) for j in range(n - 4))
            weigh = lambda c: sum(v * sum(map(len, s)) for s, v in c.items())
            for a in range(len(own) - n + 1):
                window = Counter(tuple(own[a + j : a + j + 5]) for j in range(n - 4))
                if weigh(target & window) >= 0.8 * weigh(target | window):
                    expected.add((i, k))
    found = contaminations(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    kept = {r.doc_id for r in decontaminated(docs, bench).collect()}
    assert kept == set(texts) - {i for i, _ in expected}


def test_contaminations_of_edited_items_against_every_window(spark):
    rng = random.Random(15)
    items, texts = {}, {}
    for k in range(400):
        item = [f"x{rng.randrange(10 ** rng.randrange(1, 9))}" for _ in range(rng.randrange(15, 60))]
        own = list(item)
        for j in range(rng.randrange(1, 6)):
            own[j if k % 2 else -1 - j] = f"other{rng.randrange(1000)}"
        items[k] = " ".join(item)
        texts[k] = " ".join(prose(rng, 20) + own + prose(rng, 20))
    expected = set()
    for k, item in items.items():
        own, wanted = texts[k].split(), item.split()
        n = len(wanted)
        weigh = lambda c: sum(v * sum(map(len, s)) for s, v in c.items())
        target = Counter(tuple(wanted[j : j + 5]) for j in range(n - 4))
        for a in range(len(own) - n + 1):
            window = Counter(tuple(own[a + j : a + j + 5]) for j in range(n - 4))
            if weigh(target & window) >= 0.8 * weigh(target | window):
                expected.add((k, k))
    assert 100 < len(expected) < 400
    bench = spark.createDataFrame([*items.items()], "item_id bigint, text string")
    found = contaminations(frame(spark, texts), bench).collect()
    assert len(expected - {(r.doc_id, r.item_id) for r in found}) == 0
    assert {(r.doc_id, r.item_id) for r in found} == expected


def test_contaminations_on_awkward_rows(spark, clashing, nothing):
    bench = spark.createDataFrame([(1, "one"), (2, "no id here at all for once")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in contaminations(clashing, bench).collect()} == {(7, 1), (None, 2)}
    assert contaminations(nothing, bench).count() == 0
    assert contaminations(clashing, bench.where("false")).count() == 0
    assert decontaminated(clashing, bench).count() == 10
    assert decontaminated(clashing, bench.where("false")).count() == 12


def test_classifier_on_held_out_labels(spark):
    rng = random.Random(7)
    texts, labels = {}, []
    for i in range(600):
        own = prose(rng, 60, 300)
        quality, toxic = int(rng.random() > 0.3), int(rng.random() > 0.8)
        if not quality:
            own = [own[0]] * 40 + own[:5]
        if toxic:
            for k in range(0, len(own), 12):
                own[k] = rng.choice(("vile", "rotten", "nasty"))
        texts[i] = " ".join(own)
        labels.append((i, quality, toxic))
    known = spark.createDataFrame(
        [*labels[:400], (0, 1, 0), (9999, 1, 1), (5, None, 1), (None, 0, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    found = {r.doc_id: r for r in assessed(frame(spark, texts), known).collect()}
    right = [found[i].kept == (q == 1 and t == 0) for i, q, t in labels[400:]]
    assert sum(right) / len(right) >= 0.97
    assert {r.doc_id for r in accepted(frame(spark, texts), known).collect()} == {
        i for i, r in found.items() if r.kept
    }


def test_classifier_on_awkward_rows(spark, clashing, nothing):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (4, 0, 0), (5, 0, 1), (9, 1, 0)], "doc_id bigint, quality int, toxic int"
    )
    assert assessed(clashing, labels).count() == 12
    assert accepted(clashing, labels).columns == clashing.columns
    none = labels.where("false")
    assert all(r.kept for r in assessed(clashing, none).collect())
    assert assessed(nothing, labels).count() == 0


def test_fingerprints_of_edited_texts(spark, clashing, nothing):
    rng = random.Random(8)
    texts = {i: " ".join(prose(rng, rng.randrange(120))) for i in range(0, 300, 5)}
    texts |= {100: "é" * 7, 105: "", 110: None}
    rows = {r.doc_id: r for r in fingerprint_report(frame(spark, texts)).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        own, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].n_chars == len(own)
    for i in texts:
        if i % 100 == 0:
            own = int(rows[i].fingerprint, 16)
            near = sum((own ^ int(r.fingerprint, 16)).bit_count() <= 7 for r in rows.values())
            assert rows[i].rows_within == near
        else:
            assert rows[i].rows_within is None
    awkward_rows = edited_fingerprints(clashing).collect()
    assert len(awkward_rows) == 12
    by_id = {r.doc_id: r for r in awkward_rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint != by_id[7].fingerprint
    assert by_id[4].fingerprint == by_id[5].fingerprint == "0" * 32
    assert fingerprint_report(nothing).count() == 0


def test_edited_texts_across_buckets(spark, monkeypatch):
    from tallybook.llm import simhash

    monkeypatch.setattr(simhash, "BUCKET_ROWS", 7)
    texts = {i * 3: f"text number {i} " * (i % 5) for i in range(100)}
    rows = {r.doc_id: r for r in edited_fingerprints(frame(spark, texts)).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        own, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_licences_against_sql(spark, awkward, nothing):
    texts = {
        1: "Intro\nReleased under the MIT License.\nAll rights reserved",
        2: "released under the *MIT* licence!\nAll all rights reserved.",
        3: "This work is licensed under the GNU General Public License version 3",
        4: None,
        5: "Licensed under CC\nBY-NC 4.0",
        6: "it's\\n",
    }
    docs = frame(spark, texts).union(awkward)
    rows = sorted(map(tuple, notices_found(docs).select("doc_id", "line", "licence", "dice").collect()))
    connection = duckdb.connect()
    connection.register("documents", docs.toPandas())
    sql = f"select doc_id, line, licence, dice from ({oracle_sql()})"
    assert rows == sorted(connection.execute(sql).fetchall())
    assert {r[0] for r in rows} == {1, 2, 3, 5}
    assert notices_found(nothing).count() == 0 and notices_found(docs, {}).count() == 0


def test_language_model_base_and_gain(spark, awkward, nothing):
    rng = random.Random(9)
    parts = ["ka", "lo", "mi", "tra", "sen", "du"]
    vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    texts = {i: " ".join(rng.choices(vocabulary, k=80)) for i in range(200)}
    texts[7], texts[8] = None, ""
    rows = {r.doc_id: r for r in scored(frame(spark, texts)).collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 10 == 0}
    tokens = {i: [*(t or "").lower().split(), None] for i, t in texts.items()}
    counts = Counter(w for i in texts if i not in held for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        row = rows[i]
        assert row.base_score == pytest.approx(base) and row.held_out == (i in held)
        assert (row.n_tokens, row.train_tokens) == (len(own), n)
        assert row.n_known == sum(counts[w] > 0 for w in own) and row.score < 0
    assert sum(rows[i].score for i in held) > 1.05 * sum(rows[i].base_score for i in held)
    assert scored(awkward).count() == 12 and scored(nothing).count() == 0
    assert scored(awkward.selectExpr("*", "1 as hash", "2 as n", "3 as row", "4 as `odd name`")).count() == 12
    lengths, nodes, bits = code_of(np.arange(256))
    paths = {tuple(bits[b, : lengths[b]]) for b in range(256)}
    assert len(paths) == 256 and sum(2.0 ** -len(p) for p in paths) == 1


def test_language_model_learns_sequences(spark):
    rng = random.Random(10)
    follows = {i: [rng.randrange(300) for _ in range(4)] for i in range(300)}

    def walk(count):
        out = [rng.randrange(300)]
        while len(out) < count:
            out.append(rng.choice(follows[out[-1]]))
        return [f"w{i}" for i in out]

    texts = {i: " ".join(walk(120)) for i in range(300)}
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 10 == 0]
    # Each held-out text again as another held-out row, its words in another order.
    more = (i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 10 == 0)
    shuffled = dict(zip(held, more, strict=False))
    for i, j in shuffled.items():
        texts[j] = " ".join(rng.sample(texts[i].split(), 120))
    rows = {r.doc_id: r for r in scored(frame(spark, texts)).collect()}
    for i, j in shuffled.items():
        assert rows[i].base_score == pytest.approx(rows[j].base_score)
        assert rows[i].score > rows[j].score
    assert sum(rows[i].score for i in held) > 0.7 * sum(rows[i].base_score for i in held)
    for i in held:
        bits = -rows[i].score * math.log2(10) / (len(texts[i]) + 1)
        assert rows[i].bits_per_byte == pytest.approx(bits)


def test_language_model_spells_a_distribution(spark):
    from tallybook.llm import language_model as lm

    words = [b"anna", b"banana", b"nab", b"ban"] * 3
    code = lm.code_of(np.bincount(np.frombuffer(b" ".join(words), dtype=np.uint8), minlength=256))
    mixer = lm.Mixer(code)
    rng = np.random.default_rng(0)
    mixer.zeros, mixer.ones = (rng.integers(0, 5, lm.SLOTS).astype(np.float32) for _ in range(2))
    # The first bytes of words have probabilities that add up to one.
    symbols, contexts, _, _ = lm.spelled([bytes([b]) for b in range(256)])
    first = mixer.log10(symbols, contexts)[::2]
    assert (10**first).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_gains_on_held_out_documents(spark):
    rows = scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    model, base = rows.selectExpr("sum(score)", "sum(base_score)").first()
    assert model > base


def test_mix_reaches_its_targets(spark, awkward, clashing, nothing):
    rng = random.Random(10)
    rows = [
        (i, " ".join(prose(rng, rng.randrange(200))), "en", rng.choice(["é", "b", "A", None, "A", "A"]), 0)
        for i in range(400)
    ]
    rows.append((400, None, "en", "empty", 0))
    docs = spark.createDataFrame(rows, DOCUMENTS)
    found = {r.doc_id: r for r in taken_words(docs).collect()}
    size, source = {r[0]: len((r[1] or "").split()) for r in rows}, {r[0]: r[3] for r in rows}
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    full: set = set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        unit = left / max(sum(weight[s] for s in names if s not in full), 1e-9)
        more = {s for s in names if s not in full and unit * weight[s] > 2 * total[s]}
        if not more:
            break
        full |= more
    target = {s: 2 * total[s] if s in full else unit * weight[s] for s in names}
    taken = Counter()
    for i, r in found.items():
        assert (r.size, r.source_size) == (size[i], total[source[i]])
        assert r.target == pytest.approx(target[source[i]]) and 0 <= r.taken <= 2 * r.size
        taken[source[i]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    order = curriculum(docs).collect()
    again = Counter()
    for r in order:
        again[r.doc_id] += r.taken
        assert 0 <= r.due <= 1
    assert again == Counter({i: r.taken for i, r in found.items() if r.taken})
    assert [r.due for r in order] == sorted(r.due for r in order)
    assert len(taken_words(awkward).collect()) == 12
    assert set(clashing.columns) <= set(curriculum(clashing).columns)
    assert curriculum(nothing).count() == 0 and taken_words(nothing).count() == 0


def test_taken_words_are_read_back_from_the_training_order(spark, awkward, monkeypatch):
    tables = {}

    def noted(frame, name, *args, **kwargs):
        tables[name] = settled(frame, name, *args, **kwargs)
        return tables[name]

    settled = curriculum_module.settled
    monkeypatch.setattr(curriculum_module, "settled", noted)
    repeated = awkward.union(awkward.where("doc_id is null or doc_id in (4, 7)"))
    found = taken_words(repeated).collect()
    order = tables["training-order"].collect()
    assert [r.due_ for r in order] == sorted(r.due_ for r in order)
    key = lambda r: (str(r["doc_id"]), r["pass"], r.taken, r.due)
    expected = sorted(map(key, curriculum(repeated).collect()))
    assert sorted((str(r.id_), r.pass_, r.taken_, r.due_) for r in order) == expected
    assert len(found) == repeated.count()
    assert sum(r.taken for r in found) == sum(r.taken_ for r in order) > 0


def test_archives_round_trip(spark):
    schema = "page_id bigint, url string, html string, page string"
    rows = [
        (1, "http://a/x y", "<p>é\r\n\r\nWARC/1.1</p>", "?"),
        (2, None, "", "?"),
        (3, "u", None, "?"),
        (4, "u", "<p>é\r\n\r\nWARC/1.1</p>", "?"),
        (5, "u", "big " * 900_000, "?"),
        (6, "u", "big " * 900_000, "?"),
        (None, "u", "no id", "?"),
    ]
    pages = spark.createDataFrame(rows, schema)
    archives = written(pages)
    for row in archives.collect():
        assert len(list(records_of(inflated(bytes(row.content))))) >= 1
    found = read_back(normalised(archives)).collect()
    by_id = {r.page_id: r for r in found}
    assert len(found) == 7
    kinds = {i: (r.record_type, r.refers_to) for i, r in by_id.items()}
    assert kinds == {
        1: ("revisit", 4), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None),
        5: ("revisit", 6), 6: ("response", None), None: ("response", None),
    }
    for i, _, text, _ in rows:
        assert by_id[i].payload_bytes == len((text or "").encode())
        if by_id[i].record_type == "response":
            assert bytes(by_id[i].payload).decode() == (text or "")
    for row in normalised(archives).collect():
        content, ids = bytes(row.content), []
        for place in row["index"]:
            head = zlib.decompress(content[place.offset : place.offset + place.length], 31)
            own = fields(head.partition(b"\r\n\r\n")[0])
            assert own["warc-date"].endswith("Z") and "warc-type" in own
            ids.append(own["warc-record-id"])
        assert len(set(ids)) == len(ids) == len(row["index"])
    least = read_back(normalised(written(pages, least=1))).collect()
    assert sum(r.record_type == "revisit" for r in least) == 2
    assert read_back(normalised(written(pages.where("false")))).count() == 0


def test_archives_of_equal_pages(spark):
    rows = [(1, "x"), (None, "x"), (7, "x"), (7, "x"), (None, "y"), (None, "y"), (2, "z")]
    pages = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id bigint, url string, html string")
    found = read_back(normalised(written(pages))).collect()
    by_digest = {}
    for r in found:
        by_digest.setdefault(r.payload_digest, []).append((str(r.page_id), r.record_type, r.refers_to))
    assert sorted(sorted(own, key=str) for own in by_digest.values()) == [
        [("1", "revisit", 7), ("7", "response", None), ("7", "revisit", 7), ("None", "revisit", 7)],
        [("2", "response", None)],
        [("None", "response", None), ("None", "revisit", None)],
    ]


PAGE = (
    "<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
    "<nav><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></nav><!-- x --><div class='ad'>Buy"
    "</div>{before}<{main}><h1>Head {i}</h1><p>First <b>bo</b>ld &amp; {i}<br>line<p>Se\n cond"
    "<aside>Side</aside><form>Name</form></p>{more}</{end}><div id=comments>Me too</div>"
    "<footer>&copy; me</footer></body></html>"
)


def page(i, main="article", before="", more=""):
    return PAGE.format(i=i, main=main, end=main.split()[0], before=before, more=more)


def test_wrappers_fold_and_align():
    one = stream(page(1))
    two = stream(page(2, more="<p>x</p><p>y</p><p>z</p>"))
    wrapper = aligned(one, two)
    assert content_of(wrapper) == "article"
    names = [item[0] for item in wrapper]
    assert names.count("<p") < 5 and any(item[2] for item in wrapper)
    constant = [item for item in wrapper if item[0] == "#" and item[3] is not None]
    assert all(item[4] for item in constant)
    repeat = folded([[t, False, False, None, 1] for t in "abababc"])
    assert [item[0] for item in repeat] == ["a", "b", "c"] and repeat[0][2]


def test_main_text_of_pages(spark):
    expected = "Head {0} First bold & {0} line Se cond"
    rows = [(i, f"http://h{i % 2}/p", page(i)) for i in range(6)]
    rows += [
        (10, "http://div/", page(10, "div class='post'", "<div class='top'>Welcome</div>")),
        (11, "http://div/", page(11, "div class='post'", "<div class='top'>Welcome</div>")),
        (20, "http://h0/", None),
        (21, None, ""),
        (22, "not a url", "just &lt;text&gt; &am"),
        (22, "not a url", "just &lt;text&gt; &am"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages = pages.selectExpr("*", "'x' as host", "'y' as content", "'z' as text")
    found = main_texts(pages).collect()
    by_id = {r.page_id: r for r in found}
    assert len(found) == len(rows)
    for i in (*range(6), 10, 11):
        assert by_id[i].text == expected.format(i), i
    assert by_id[20].text == "" and by_id[21].n_chars == 0
    assert by_id[22].text == html.unescape("just &lt;text&gt; &am")
    assert main_texts(pages.where("false")).count() == 0
    assert main_text("<p>a</p>" * 3, "missing") == "a a a"
