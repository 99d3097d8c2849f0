"""The language model's tables and look-ups against their plain definitions."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tallybook.llm import language_model as lm
from tallybook.llm.tokens import Words

HOLDING = SimpleNamespace


def test_predictions_and_how_often_they_were_seen_are_read_at_once():
    rng = np.random.default_rng(1)
    zeros, ones = (rng.integers(0, top, lm.SLOTS).astype(np.float32) for top in (4, 90))
    zeros[:5], ones[:5] = (0, 1 << 24, 0, 1 << 24, (1 << 24) - 1), (0, 0, 1 << 24, 1 << 24, 1 << 24)
    every, others = lm._tables(zeros, ones)
    for bit in (None, 0, 1):
        zero = zeros if bit is None else np.maximum(zeros - (1 - bit), 0)
        one = ones if bit is None else np.maximum(ones - bit, 0)
        entries = every if bit is None else others[bit::2]
        gate, x, _ = lm.Mixer(lm.code_of(np.arange(4))).mix([entries.copy() for _ in range(lm.INPUTS)])
        plain = np.clip(np.log((one + lm.DOUBT) / (zero + lm.DOUBT)), -8, 8)
        assert all((own == plain).all() for own in x)
        seen = zero + one
        assert (gate == 85 * ((seen > 0).astype(int) + (seen > 3))).all()


@pytest.mark.parametrize("count", [0, 1, 2, 1000])
def test_hashes_are_found_where_they_stand(count):
    rng = np.random.default_rng(2)
    hashes = np.unique(rng.integers(0, 1 << 64, count, dtype=np.uint64))
    hashes[: count // 4] >>= np.uint64(30)  # a crowd under one beginning
    hashes = np.unique(np.append(hashes, hashes[:1] * 0 + np.uint64((1 << 64) - 1)))
    asked = np.concatenate((hashes, hashes + np.uint64(1), rng.integers(0, 1 << 64, 500, dtype=np.uint64)))
    asked = np.append(asked, np.uint64((1 << 64) - 1))
    at, found = lm.Places(hashes).of(asked)
    assert (at == np.searchsorted(hashes, asked)).all() and (found == np.isin(asked, hashes)).all()


def test_contexts_of_tokens_stay_in_their_text():
    rng = np.random.default_rng(3)
    words = [b"w%d" % k for k in range(600)]
    coded = lm.Coded(lm._hashes(words))
    texts = [b" ".join(words[k] for k in rng.integers(0, 600, n)) for n in (0, 1, 2, 60, 0, 300, 5)]
    tokens, (symbols, contexts, owner, count) = coded.stream(Words(texts))
    assert count == len(texts)
    expected = [[], [], []]
    for k in range(len(texts)):
        own, before = tokens[owner == k], []
        for i, token in enumerate(own):
            common = [t for t, s in before if lm.LAST < s <= lm.LAST + lm.COMMON][-2:]
            last, second = ([np.uint64(0)] * 2 + common)[::-1][:2]
            one, two = own[i - 1] if i else 0, own[i - 2] if i > 1 else 0
            last, second, one, two = (np.array([v], dtype=np.uint64) for v in (last, second, one, two))
            expected[0] += [lm._context(lm.mixed(last, 71) + lm.mixed(second, 71), 72)]
            expected[1] += [lm._context(one, 73)]
            expected[2] += [lm._context(one + lm.mixed(two, 74), 75)]
            before.append((token, symbols[owner == k][i]))
    for own, plain in zip(contexts, expected, strict=True):
        assert (own == np.concatenate(plain)).all()


def test_slot_counts_are_those_of_every_bit(monkeypatch):
    monkeypatch.setattr(lm, "COUNTED", 1000)
    rng = np.random.default_rng(4)
    words = [b"w%d" % k for k in range(300)]
    coded = lm.Coded(lm._hashes(words[:200]))
    code = lm.code_of(np.arange(202)[::-1])
    texts = [b" ".join(words[k] for k in rng.integers(0, 300, 80)).decode() for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    read = lm._token_reader(HOLDING(value=coded))
    packed = list(lm._counting(HOLDING(value=lm.Mixer(code)), read)([batch]))
    size = 2 * lm.SLOTS // lm.CHUNKS
    found = np.concatenate([lm._unpacked(p.column(1)[0].as_py(), np.int32, size) for p in packed])
    plain = np.zeros(2 * lm.SLOTS, dtype=np.int64)
    lengths, nodes, bits = code
    for symbols, contexts, _, _ in read(batch):
        none = np.full(len(symbols), lm.NO_CONTEXT, dtype=np.uint32)
        for k, symbol in enumerate(symbols):
            for step in range(lengths[symbol]):
                node = nodes[symbol, step : step + 1].astype(np.uint32)
                for context in (none, *contexts):
                    plain[2 * int(lm.Mixer.slots(context[k : k + 1], node)[0]) + bits[symbol, step]] += 1
    assert (found == plain).all()
