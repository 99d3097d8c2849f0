"""Alignment of two tokenizers' tokens against a plain merge of plainly encoded texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallybook.llm import alignment
from tallybook.llm.alignment import (
    Encoder,
    Tokenizers,
    _packed,
    _unpacked,
    align,
    aligned,
    alignment_report,
)

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
FILES = Tokenizers()
TEXTS = "doc_id bigint, text string"


class Plain:
    """Both tokenizers, used on whole texts one by one."""

    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(FILES.a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=FILES.b_path)
        self.letters = alignment._letters()

    def tokens(self, text):
        """(ids, ends) of A and B, or None."""
        if not text:
            return None
        whole = b" " + text.encode()
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        sides = []
        a_bytes = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in a]
        b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:-1], 16)])
            if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        for ids, own in ((a, a_bytes), (b, b_bytes)):
            if b"".join(own) != whole:
                return None
            sides.append((ids, np.cumsum([len(t) for t in own]).tolist()))
        return sides

    def alignment(self, text):
        """(links as places, groups as id lists)."""
        sides = self.tokens(text)
        if sides is None:
            return [], [], 0, 0
        (a, a_ends), (b, b_ends) = sides
        links = []
        for i, end in enumerate(a_ends):
            start = a_ends[i - 1] if i else 0
            for j, other in enumerate(b_ends):
                if (b_ends[j - 1] if j else 0) < end and start < other:
                    links.append((i, j))
        cuts = sorted(set(a_ends) & set(b_ends))
        groups, done = [], (0, 0)
        for cut in cuts:
            now = (a_ends.index(cut) + 1, b_ends.index(cut) + 1)
            groups.append((a[done[0] : now[0]], b[done[1] : now[1]]))
            done = now
        return [(a[i], b[j]) for i, j in links], groups, len(a), len(b)


def expected(plain, texts):
    found = [plain.alignment(text) for text in texts]
    counts = Counter(pair for links, *_ in found for pair in set(links))
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    rows = []
    for links, groups, n_a, n_b in found:
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        rows.append(
            (n_a, n_b, len(groups), len(links),
             hashlib.sha256(written.encode()).hexdigest() if n_a else "",
             sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links))
        )
    return rows


def rows_of(report):
    return {
        r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum)
        for r in report.collect()
    }


@pytest.fixture(scope="module")
def plain():
    return Plain()


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a b ", "\n", "a\n b", "a \n b", "x\ty  z",
    "<|endoftext|> and <s> or </s> <unk> <0x41>", "it's 10.000,50 we'll", "日本語 のテスト 。 ok",
    "a▁b c", "é ́x café", "ﬁ ligature", " no break 　 wide",
    "emoji 👩‍👩‍👧 🙂x 🙂", "\x1c a \x85 b\x00c", "ÄÖ ß ẞ", "1 2  3   4    5",
]


def texts_of(seed, count):
    rng = random.Random(seed)
    signs = ["", ",", ".", "'s", "-", "?!", " ", "\n", "  ", "é", "日", "́", "7", " "]
    letters = "abcdefghij ABC"

    def word():
        return "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) + rng.choice(signs)

    return [" ".join(word() for _ in range(rng.randrange(30))) for _ in range(count)]


def test_encoding_by_parts_is_encoding_of_whole_texts(plain):
    encoder = Encoder(*alignment._files(FILES))
    assert not encoder.whole
    texts = ODD + texts_of(1, 400)
    own = align(texts, encoder)
    for i, text in enumerate(texts):
        sides = plain.tokens(text) or (([], []), ([], []))
        assert own.a[own.a_bounds[i] : own.a_bounds[i + 1]].tolist() == sides[0][0], repr(text)
        assert own.b[own.b_bounds[i] : own.b_bounds[i + 1]].tolist() == sides[1][0], repr(text)


@pytest.mark.parametrize("table_bytes", [1 << 20, 0], ids=["broadcast", "shuffled"])
def test_report_against_plain(spark, plain, monkeypatch, table_bytes):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 700)
    monkeypatch.setattr(alignment, "CACHED_PARTS", 100)
    monkeypatch.setattr(alignment, "PAIRS_HELD", 200)
    texts = ODD + texts_of(2, 60) + ["the same words " * 400, "the same"] + ["copy of this"] * 40
    rows = list(enumerate(texts))
    table = spark.createDataFrame(rows, TEXTS).repartition(5)
    found = rows_of(alignment_report(table, table_bytes=table_bytes))
    wanted = expected(plain, texts)
    assert len(found) == len(texts)
    for i, text in rows:
        assert found[i] == wanted[i], repr(text)


def test_tokens_cuts_and_links(spark, plain):
    texts = ODD + texts_of(3, 20)
    table = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    for row in aligned(table).collect():
        links, groups, n_a, n_b = plain.alignment(texts[row.doc_id])
        assert [(row.a[p.a], row.b[p.b]) for p in row.links] == links
        assert (len(row.a), len(row.b)) == (n_a, n_b)
        done, own = (0, 0), []
        for cut in row.cuts:
            own.append((row.a[done[0] : cut.a], row.b[done[1] : cut.b]))
            done = (cut.a, cut.b)
        assert own == groups


def test_awkward_rows(spark, plain, awkward, clashing, nothing):
    texts = [r.text for r in awkward.collect() if r.doc_id != 9]
    wanted = expected(plain, texts)
    got = alignment_report(clashing.where("doc_id is null or doc_id <> 9")).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(
        (a, b, g, n, sha, best, total) for a, b, g, n, sha, best, total in wanted
    )
    (long,) = alignment_report(awkward.where("doc_id = 9")).collect()
    assert long.n_links == long.n_a + long.n_b - long.n_groups and long.n_a > 60_000
    assert alignment_report(nothing).collect() == [] and aligned(nothing).collect() == []


def test_packing():
    for values in ([], [0], [5], [0, 1, 2**40, 2**62]):
        assert _unpacked(_packed(np.array(values, dtype=np.int64))).tolist() == values
