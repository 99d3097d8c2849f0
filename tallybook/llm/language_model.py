"""A language model by logistic mixing of hashed-context bit predictors, and a unigram base.

A text is a sequence of tokens: its words and one end. Words that training has twice or more, the
``CODED`` most frequent of them, and the end have a Huffman code; any other word is an escape and then
its spelling, byte by byte and closed by a space, each byte by a Huffman code as well. So a text is a
sequence of bits, frequent things taking few, and its probability is the product over its bits.

Every bit is predicted in four contexts. For tokens: none; the last two words among the ``COMMON``
most frequent, in either order, which tell language and subject; the word before; the two words
before. For spelling: the last 1, 2, 3 and 5 bytes of the word. A context and the bits of the code so
far hash to a slot of a table that counts zeros and ones over all training text. The stretched
predictions are combined by weights, one set for each gate (how often each context was seen), and the
result is refined by an adaptive table over the mixed prediction and the bit's place in the code.

Steps, each over all training text: counts of words; then for the spelling of all distinct words, and
for the sequence of all tokens, slot counts, summed over tasks, and one pass in which every task learns
mixing weights online and fills its refining table, each prediction without the bit's own occurrence.
Weights are averaged and refining tables summed over tasks. Slot tables have 2**22 slots whatever the
corpus, so they may be collected and broadcast; the counts of words grow with the corpus and stay
tables.

Scoring runs the tokens of every text through the mix. Spellings do not depend on the text, so they are
worked out per distinct word and looked up: those of the ``FREQUENT`` most frequent words are broadcast,
the other words of a document, with their number, are shuffled to the table of words and summed per
document after.

Defined cases: a null text is empty, one end; a null id counts as training; without training text
every word has probability by the untrained mix and the base has N = 0 and V = 0.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.shared import as_bytes, settled
from tallybook.llm.tokens import Words, blocks, mixed

SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
INPUTS = 4  # contexts of a bit
ORDERS = (1, 2, 3, 5)  # bytes before, for spelling
CODED = 1 << 16
COMMON = 256
ESCAPE, LAST = 0, 1  # the first two tokens of the code
GATES = 4**INPUTS  # of a context: never seen, up to three times, more; a digit is free
STEPS = 33  # of the refining table, over the stretched prediction -8..8
CELLS = STEPS * 8
FREQUENT = 1 << 19
SYMBOLS = 4096  # predicted at a time
COUNTED = 1 << 22  # places of the slot table that are sorted at a time
FIRST = 1024  # symbols of a task's first learning steps
CHUNKS = 64  # of the slot table, on its way between tasks
RATE = 0.1
DOUBT = np.float32(0.15)  # added to the zeros and ones of a slot
END = np.uint64(0x6A09E667F3BCC908)  # stands for the hash of the end of a text
NO_CONTEXT = np.uint32(0x51ED270B)

HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 10 = 0, false)"

Code = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Symbols, their contexts (without the one that is none), the row each belongs to, and the number
#: of rows.
Stream = tuple[np.ndarray, np.ndarray, np.ndarray, int]
Reader = Callable[[pa.RecordBatch], Iterator[Stream]]


def code_of(counts: np.ndarray) -> Code:
    """A Huffman code of symbols: lengths, and per symbol the node and bit of each step.

    Frequent symbols take fewer binary decisions; any symbol can be coded.
    """
    size = len(counts)
    parent, side = (np.zeros(2 * size - 1, dtype=np.int64) for _ in range(2))
    heap = [(int(count) + 1, symbol) for symbol, count in enumerate(counts)]
    heapq.heapify(heap)
    for node in range(size, 2 * size - 1):
        left, right = heapq.heappop(heap), heapq.heappop(heap)
        parent[left[1]] = parent[right[1]] = node
        side[right[1]] = 1
        heapq.heappush(heap, (left[0] + right[0], node))
    depth = np.zeros(2 * size - 1, dtype=np.int64)
    for node in range(2 * size - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    lengths = depth[:size]
    nodes, bits = (np.zeros((size, int(lengths.max())), dtype=np.int64) for _ in range(2))
    at, symbols = np.arange(size), np.arange(size)
    while len(symbols):
        step = depth[at] - 1
        nodes[symbols, step], bits[symbols, step] = parent[at] - size, side[at]
        at = parent[at]
        inner = depth[at] > 0
        at, symbols = at[inner], symbols[inner]
    return lengths, nodes, bits


def _context(value: np.ndarray, seed: int) -> np.ndarray:
    return (mixed(value, seed) >> np.uint64(32)).astype(np.uint32)


def _packed(array: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(array), "zstd", asbytes=True)


def _unpacked(packed: bytes, kind: type, size: int) -> np.ndarray:
    raw = pa.decompress(packed, size * np.dtype(kind).itemsize, "zstd")
    return np.frombuffer(raw, dtype=kind)


class Places:
    """Finds hashes among sorted ones; the first bits of a hash tell where to begin."""

    def __init__(self, hashes: np.ndarray):
        bits = max(len(hashes), 1).bit_length()
        self.shift = np.uint64(64 - bits)
        self.hashes = np.append(hashes, np.uint64((1 << 64) - 1))
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.searchsorted(hashes, edges).astype(np.int32)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash would stand, and whether it does."""
        at = self.first.take((hashes >> self.shift).astype(np.int64)).astype(np.int64)
        found = self.hashes.take(at)
        late = np.flatnonzero(found < hashes)
        while len(late):
            at[late] += 1
            found[late] = self.hashes.take(at[late])
            late = late[found[late] < hashes[late]]
        return at, (found == hashes) & (at < len(self.hashes) - 1)


def spelled(words: list[bytes]) -> Stream:
    """The bytes of words, each closed by a space."""
    letters = np.frombuffer(b" ".join([*words, b""]), dtype=np.uint8)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(letters)) - (np.cumsum(lengths) - lengths)[owner]
    codes = letters.astype(np.uint64) + np.uint64(1)
    contexts, value = [], np.zeros(len(codes), dtype=np.uint64)
    for back in range(1, max(ORDERS) + 1):
        before = np.concatenate((np.zeros(back, dtype=np.uint64), codes))[: len(codes)]
        value = (value << np.uint64(9)) + np.where(place >= back, before, np.uint64(0))
        if back in ORDERS:
            contexts.append(_context(value, 62 + back))
    return letters.astype(np.int64), np.stack(contexts), owner, len(words)


def _spellings(batch: pa.RecordBatch) -> Iterator[Stream]:
    """Words (word) in parts of about a megabyte, or one longer word."""
    words = batch.column(0).to_pylist()
    start, held = 0, 0
    for i, word in enumerate(words):
        if i > start and held + len(word) > 1 << 20:
            yield spelled(words[start:i])
            start, held = i, 0
        held += len(word)
    if start < len(words):
        yield spelled(words[start:])


class Coded:
    """The words of the token code, most frequent first, by their hashes."""

    def __init__(self, hashes: np.ndarray):
        hashes = np.concatenate((np.array([END], dtype=np.uint64), hashes))
        order = np.argsort(hashes)
        self.places, self.symbols = Places(hashes[order]), np.append(order + 1, ESCAPE)

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        """The symbol of each word, an escape for the others."""
        at, known = self.places.of(hashes)
        return np.where(known, self.symbols.take(at), ESCAPE)

    def stream(self, words: Words) -> tuple[np.ndarray, Stream]:
        """The hashes of all tokens of a block of texts, and their stream."""
        m = len(words)
        lengths = np.diff(words.bounds) + 1
        owner = np.repeat(np.arange(m), lengths)
        starts = np.cumsum(lengths) - lengths
        ends = starts + lengths - 1
        tokens = np.empty(len(owner), dtype=np.uint64)
        word = np.ones(len(owner), dtype=bool)
        word[ends] = False
        tokens[word], tokens[ends] = words.hashes, END
        symbols = self.symbols_of(tokens)
        # Between two common words of a text the subject is the same, and so is its context.
        common = (symbols > LAST) & (symbols <= LAST + COMMON)
        edges = np.sort(np.concatenate((starts, np.flatnonzero(common) + 1)))
        own = owner[edges]
        after = edges > starts[own]  # a common word of the text
        last = np.where(after, tokens[edges - 1], np.uint64(0))
        second = np.concatenate((np.zeros(1, dtype=np.uint64), last))[:-1]
        second = np.where(after, second, np.uint64(0))
        subject = _context(mixed(last, 71) + mixed(second, 71), 72)
        subject = np.repeat(subject, np.diff(np.append(edges, len(tokens))))
        one = np.concatenate((np.zeros(1, dtype=np.uint64), tokens))[:-1]
        one[starts] = 0
        two = np.concatenate((np.zeros(1, dtype=np.uint64), one))[:-1]
        two[starts] = 0
        return tokens, (symbols, [subject, _context(one, 73), _context(one + mixed(two, 74), 75)], owner, m)


def _token_reader(coded: Broadcast) -> Reader:
    def read(batch: pa.RecordBatch) -> Iterator[Stream]:
        for _, words in blocks(as_bytes(batch.column(0))):
            yield coded.value.stream(words)[1]

    return read


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of texts (text, training) with their number in training texts, per block of text."""
    for batch in batches:
        training = np.array(batch.column(1).to_pylist(), dtype=bool)
        for start, words in blocks(as_bytes(batch.column(0))):
            own = training[start : start + len(words)]
            learns = np.repeat(own, np.diff(words.bounds))
            order = np.argsort(words.hashes)
            ordered = words.hashes[order]
            begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(order)])
            times = np.add.reduceat(learns[order], begin, dtype=np.int64) if len(begin) else begin
            found = [words.word(i) for i in order[begin].tolist()] + [b""]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, type=pa.binary()), pa.array(np.append(times, own.sum()))],
                names=["word", "n"],
            )


def _hashes(words: list[bytes]) -> np.ndarray:
    """The hash of each word, the end's for the empty word."""
    hashes = np.full(len(words), END)
    for start, own in blocks(words):
        hashes[start + np.flatnonzero(np.diff(own.bounds))] = own.hashes
    return hashes


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = _hashes(batch.column(0).to_pylist()).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hashes), batch.column(1)], names=["hash", "n"])


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte occurs in the task's words."""
    counts = np.zeros(256, dtype=np.int64)
    for batch in batches:
        joined = b" ".join([*batch.column(0).to_pylist(), b""])
        counts += np.bincount(np.frombuffer(joined, dtype=np.uint8), minlength=256)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(256)), pa.array(counts)], names=["at", "n"]
    )


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


# The mixed prediction that each cell of the refining table stands for.
_CENTRES = _squash(np.linspace(-8, 8, STEPS)).repeat(8)
# A prediction is 0 or has a size of 2**-24 to 8, so its exponent leaves two bits free.
_SMALLER, _LARGER = np.float32(2.0**-96), np.float32(2.0**96)
_KIND = np.uint32(3 << 29)


def _predictions(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Stretched predictions, and how often they were seen (never, up to three times, more) in the
    free bits of their exponents, so that both are read at once."""
    seen = zeros + ones
    kinds = (seen > 0).astype(np.uint32) + (seen > 3)
    x = np.clip(np.log((ones + DOUBT) / (zeros + DOUBT)), -8, 8)
    return (x * _SMALLER).view(np.uint32) | (kinds << np.uint32(29))


def _tables(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predictions of all slots; and of each slot's zeros and ones, without the bit's own occurrence."""
    every, others = np.empty(SLOTS, dtype=np.uint32), np.empty((SLOTS, 2), dtype=np.uint32)
    for start in range(0, SLOTS, SLOTS // CHUNKS):
        part = slice(start, start + SLOTS // CHUNKS)
        zero, one = zeros[part], ones[part]
        every[part] = _predictions(zero, one)
        others[part, 0] = _predictions(np.maximum(zero - 1, 0), one)
        others[part, 1] = _predictions(zero, np.maximum(one - 1, 0))
    return every, others.ravel()


class Mixer:
    """Predictions of bits from slot counts, mixing weights, and the refining table.

    ``table`` has the predictions of slots, or of slots and bits for learning.
    """

    def __init__(
        self,
        code: Code,
        zeros: np.ndarray | None = None,
        ones: np.ndarray | None = None,
        table: np.ndarray | None = None,
    ):
        none = np.zeros(1, dtype=np.float32)
        self.code = code
        self.zeros, self.ones = none if zeros is None else zeros, none if ones is None else ones
        self.table = table
        lengths, nodes, bits = code
        self.lengths = lengths.astype(np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        # The steps of all symbols in a row: node, bit (1 bit), and place in the code (3 bits).
        used = np.arange(nodes.shape[1]) < self.lengths[:, None]
        places = np.minimum(np.nonzero(used)[1], 7)
        self.steps = (nodes[used] << 4 | bits[used] << 3 | places).astype(np.uint32)
        self.fixed: np.ndarray | None = None
        self.weights = np.full((INPUTS, GATES), 0.3)
        self.refined = _CENTRES

    def __reduce__(self):
        """Code and table, compressed; weights and the refining table travel by themselves."""
        code = pickle.dumps(tuple(part.astype(np.int32) for part in self.code), 5)
        table = None if self.table is None else _packed(self.table)
        size = 0 if self.table is None else len(self.table)
        return _arrived, (len(code), _packed(np.frombuffer(code, dtype=np.uint8)), size, table)

    @staticmethod
    def slots(contexts: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        hashes = nodes + np.uint32(1)
        hashes *= np.uint32(0x9E3779B1)
        hashes += contexts
        hashes *= np.uint32(0x85EBCA6B)
        hashes >>= np.uint32(32 - SLOT_BITS)
        return hashes

    def portions(self, symbols: np.ndarray, contexts, size: int = SYMBOLS):
        """(first symbol, bits of each, the bits' steps, slots by context) for so many at a time."""
        lengths, begins = self.lengths.take(symbols), self.begins.take(symbols)
        for start in range(0, len(symbols), size):
            count = lengths[start : start + size]
            at = np.repeat(begins[start : start + size] - np.cumsum(count) + count, count)
            at += np.arange(len(at))
            steps = self.steps.take(at, mode="clip")
            nodes = steps >> np.uint32(4)
            slots = (
                self.slots(np.repeat(context[start : start + size], count), nodes)
                for context in contexts
            )
            yield start, count, steps, slots

    def entries(self, steps: np.ndarray, slots, contexts: int, learns: bool = False):
        """Entries of the table by context; ``learns`` if it has them by slot and bit.

        With one context less, the first one is none, and its entries are as few as nodes.
        """
        both = steps >> np.uint32(3)
        if contexts < INPUTS:
            if self.fixed is None:
                nodes = np.arange(int(self.steps.max() >> 4) + 1, dtype=np.uint32)
                own = self.slots(NO_CONTEXT, nodes).astype(np.int64).repeat(2)
                self.fixed = self.table[2 * own + np.arange(len(own)) % 2 if learns else own]
            yield self.fixed.take(both.astype(np.int64), mode="clip")
        bits = both & np.uint32(1)
        for own in slots:
            if learns:
                own <<= np.uint32(1)
                own |= bits
            yield self.table.take(own.astype(np.int64), mode="clip")

    def mix(self, found) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Gates, predictions and their mix, from entries of the table by context."""
        gate, x = None, []
        for k, entry in enumerate(found):
            kinds = entry & _KIND
            entry ^= kinds
            x.append(entry.view(np.float32))
            x[k] *= _LARGER
            kinds >>= np.uint32(29 - 2 * k)
            gate = kinds if gate is None else np.bitwise_or(gate, kinds, out=gate)
        gate = gate.astype(np.int64)
        weights = self.weights.astype(np.float32)
        score = weights[0].take(gate, mode="clip")
        score *= x[0]
        for k in range(1, INPUTS):
            own = weights[k].take(gate, mode="clip")
            own *= x[k]
            score += own
        return gate, x, np.clip(score, -8, 8, out=score)

    @staticmethod
    def cells(score: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Twice the cells of the refining table: by prediction, bit, and place in the code."""
        cells = np.rint((score + 8) * ((STEPS - 1) / 16)).astype(np.uint32)
        cells <<= np.uint32(4)
        cells |= steps & np.uint32(15)
        return cells.astype(np.int64)

    def log10(self, symbols: np.ndarray, contexts) -> np.ndarray:
        """log10 of each symbol's probability."""
        if self.table is None:
            self.table, _ = _tables(self.zeros, self.ones)
        refined = self.refined.astype(np.float32).reshape(STEPS, 1, 8).repeat(2, axis=1).ravel()
        out = np.zeros(len(symbols))
        for start, count, steps, slots in self.portions(symbols, contexts):
            _, _, score = self.mix(self.entries(steps, slots, len(contexts)))
            one = refined.take(self.cells(score, steps), mode="clip")
            one += _squash(score)
            one /= 2
            # The probability of a zero is what the one's lacks.
            one -= (steps >> np.uint32(3) & np.uint32(1) ^ np.uint32(1)).astype(np.float32)
            likely = np.log10(np.clip(np.abs(one, out=one), 1e-6, 1, out=one), out=one)
            # Every symbol has a bit, so no stretch is empty.
            out[start : start + SYMBOLS] = np.add.reduceat(likely, np.cumsum(count) - count, dtype=float)
        return out


def _arrived(length: int, code: bytes, size: int, table: bytes | None) -> Mixer:
    code = pickle.loads(_unpacked(code, np.uint8, length).tobytes())
    return Mixer(code, table=None if table is None else _unpacked(table, np.uint32, size).copy())


@dataclass(frozen=True)
class Trained:
    """A mixer whose counts executors take from the broadcast."""

    shared: Broadcast
    weights: np.ndarray
    refined: np.ndarray

    def mixer(self) -> Mixer:
        mixer: Mixer = self.shared.value
        mixer.weights, mixer.refined = self.weights, self.refined
        return mixer


def _added(counts: np.ndarray, places: list[np.ndarray]) -> None:
    """One more for each of ``places``; sorted ones are met in the order of memory."""
    rows = np.concatenate(places)
    rows.sort()
    begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    times = np.append(begin[1:], len(rows)).astype(np.int32)
    times -= begin.astype(np.int32)
    counts[rows[begin]] += times


def _counting(shared: Broadcast, read: Reader):
    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's slot counts, zero and one in turn, in ``CHUNKS`` compressed parts."""
        mixer: Mixer = shared.value
        counts = np.zeros(2 * SLOTS, dtype=np.int32)
        often = np.zeros(len(mixer.lengths), dtype=np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for symbols, contexts, _, _ in read(batch):
                if len(contexts) < INPUTS:
                    often += np.bincount(symbols, minlength=len(often))
                for _, _, steps, slots in mixer.portions(symbols, contexts):
                    bits = steps >> np.uint32(3) & np.uint32(1)
                    for own in slots:
                        own <<= np.uint32(1)
                        own |= bits
                        held.append(own)
                        size += len(own)
                    if size > COUNTED:
                        _added(counts, held)
                        held, size = [], 0
        if held:
            _added(counts, held)
        # Without a context a symbol's slots are its nodes'.
        of_node = np.bincount(mixer.steps >> np.uint32(3), np.repeat(often, mixer.lengths))
        used = np.flatnonzero(of_node)
        slot = mixer.slots(NO_CONTEXT, (used >> 1).astype(np.uint32)).astype(np.int64)
        np.add.at(counts, 2 * slot + (used & 1), of_node[used].astype(np.int32))
        for chunk, part in enumerate(np.split(counts, CHUNKS)):
            columns = [pa.array([chunk], pa.int32()), pa.array([_packed(part)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "counts"])

    return counting


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each of the task's chunks summed over the tasks that counted."""
    size = 2 * SLOTS // CHUNKS
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if chunk not in sums:
                sums[chunk] = np.zeros(size, dtype=np.int64)
            sums[chunk] += _unpacked(packed, np.int32, size)
    for chunk, part in sums.items():
        columns = [pa.array([chunk], pa.int32()), pa.array([_packed(part)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["chunk", "counts"])


def _learning(shared: Broadcast, read: Reader):
    def learning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's weights, each with its number of steps, and its refining table.

        Weights take a step for each gate and portion, at a rate that falls with what it has seen.
        """
        mixer: Mixer = shared.value
        weights = mixer.weights = np.full((INPUTS, GATES), 0.3)
        square, done = np.zeros((INPUTS, GATES)), np.zeros(GATES)
        refining = np.zeros(2 * CELLS, dtype=np.int64)
        for batch in batches:
            for symbols, contexts, _, _ in read(batch):
                size = SYMBOLS if done.max() > 200 else FIRST
                for _, _, steps, slots in mixer.portions(symbols, contexts, size):
                    found = mixer.entries(steps, slots, len(contexts), learns=True)
                    gate, x, score = mixer.mix(found)
                    refining += np.bincount(mixer.cells(score, steps), minlength=2 * CELLS)
                    error = (steps >> np.uint32(3) & np.uint32(1)).astype(np.float32)
                    error -= _squash(score)
                    total = np.bincount(gate, minlength=GATES)
                    done += total > 0
                    for k in range(INPUTS):
                        slope = np.bincount(gate, error * x[k], GATES) / (total + 8)
                        square[k] += slope**2
                        weights[k] += RATE * slope / np.sqrt(square[k] + 1e-6)
        zeros, ones = (part.ravel() for part in refining.reshape(STEPS, 2, 8).swapaxes(0, 1))
        every = zeros + ones
        at = np.arange(INPUTS * GATES + CELLS)
        value = np.concatenate(((weights * done).ravel(), ones))
        weight = np.concatenate((np.tile(done, INPUTS), every))
        columns = [pa.array(at), pa.array(value), pa.array(weight)]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "value", "weight"])

    return learning


def trained(rows: DataFrame, code: Code, read: Reader) -> Trained:
    """A mixer of fixed size from the streams that ``read`` makes of ``rows``."""
    context = rows.sparkSession.sparkContext
    empty = context.broadcast(Mixer(code))
    schema = "chunk int, counts binary"
    counted = (
        rows.mapInArrow(_counting(empty, read), schema)
        .repartition(CHUNKS, "chunk")
        .mapInArrow(_chunks, schema)
        .toArrow()
    )
    counts = np.zeros((CHUNKS, 2 * SLOTS // CHUNKS), dtype=np.float32)
    for chunk, packed in zip(*(column.to_pylist() for column in counted.columns), strict=True):
        counts[chunk] = _unpacked(packed, np.int64, counts.shape[1])
    del counted
    zeros, ones = counts.reshape(SLOTS, 2).T
    every, others = _tables(zeros, ones)
    del counts, zeros, ones
    learning = context.broadcast(Mixer(code, table=others))
    del others
    sums = (
        rows.mapInArrow(_learning(learning, read), "at bigint, value double, weight double")
        .groupBy("at")
        .agg(F.sum("value").alias("value"), F.sum("weight").alias("weight"))
        .toArrow()
    )
    value, weight = np.zeros((2, INPUTS * GATES + CELLS))
    at = sums["at"].to_numpy()
    value[at], weight[at] = sums["value"].to_numpy(), sums["weight"].to_numpy()
    done = weight[:-CELLS]
    learned = np.where(done > 0, value[:-CELLS] / np.maximum(done, 1), 0.3)
    refined = (value[-CELLS:] + 4 * _CENTRES) / (weight[-CELLS:] + 4)
    learning.destroy()
    empty.destroy()
    shared = context.broadcast(Mixer(code, table=every))
    return Trained(shared, learned.reshape(INPUTS, GATES), refined)


def _valued(spelling: Trained, coded: Broadcast):
    """Each word's hash, training count, and log10 of its spelling's probability, 0 if it is coded."""

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = spelling.mixer()
        for batch in batches:
            words = batch.column(0).to_pylist()
            hashes = _hashes(words)
            likely = np.zeros(len(words))
            rare = np.flatnonzero(coded.value.symbols_of(hashes) == ESCAPE)
            start = 0
            for symbols, contexts, owner, count in _spellings(
                pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rare))], names=["word"])
            ):
                own = np.bincount(owner, mixer.log10(symbols, contexts), count)
                likely[rare[start : start + count]] = own
                start += count
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), batch.column(1), pa.array(likely)],
                names=["hash", "n", "log10"],
            )

    return valued


LOOKED_UP = (
    "row bigint, hash bigint, times bigint, doc_id bigint, held_out boolean, n_tokens bigint,"
    " n_bytes bigint, known bigint, base double, model double"
)


def _looked_up(frequent: Broadcast, coded: Broadcast, mixing: Trained):
    """Documents with the sums over their tokens, and their words to look up as rows."""

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, counts, base, spelling = frequent.value
        mixer = mixing.mixer()
        serial = TaskContext.get().partitionId() << 40
        names = [column.split()[0] for column in LOOKED_UP.split(", ")]
        for batch in batches:
            for start, words in blocks(as_bytes(batch.column(2))):
                tokens, (symbols, contexts, owner, m) = coded.value.stream(words)
                model = np.bincount(owner, mixer.log10(symbols, contexts), m)
                place, hit = places.of(tokens)
                own, at = owner[hit], place[hit]
                rows = serial + np.arange(m)
                serial += m
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows),
                        # A document's own row goes anywhere: no word has this hash.
                        pa.array(mixed(rows.astype(np.uint64), 81).view(np.int64)),
                        pa.array(np.zeros(m, dtype=np.int64)),
                        batch.column(0).slice(start, m),
                        batch.column(1).slice(start, m),
                        pa.array(np.diff(words.bounds) + 1),
                        pa.array(np.diff(words.offsets) - 1),
                        pa.array(np.bincount(own, counts[at] > 0, m).astype(np.int64)),
                        pa.array(np.bincount(own, base[at], m)),
                        pa.array(model + np.bincount(own, spelling[at], m)),
                    ],
                    names=names,
                )
                rest = np.flatnonzero(~hit)
                if not len(rest):
                    continue
                order = rest[np.lexsort((tokens[rest], owner[rest]))]
                new = (np.diff(owner[order]) != 0) | (tokens[order][1:] != tokens[order][:-1])
                first = np.flatnonzero(np.concatenate(([True], new)))
                times = np.diff(np.append(first, len(order)))
                n = len(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[owner[order[first]]]),
                        pa.array(tokens[order[first]].view(np.int64)),
                        pa.array(times),
                        pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.bool_()),
                        *(pa.nulls(n, pa.int64()) for _ in range(3)),
                        *(pa.nulls(n, pa.float64()) for _ in range(2)),
                    ],
                    names=names,
                )

    return looked_up


def scored(documents: DataFrame) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): tokens, base score, model score, and the model's bits
    a byte of the text and its end."""
    spark = documents.sparkSession
    context = spark.sparkContext
    rows = documents.selectExpr(
        "doc_id", f"{HELD_OUT} as held_out", "coalesce(text, '') as text"
    )
    vocabulary = settled(
        rows.selectExpr("text", "not held_out as training")
        .mapInArrow(_counted, "word binary, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n")),
        "vocabulary",
    )
    known = vocabulary.where("n > 0")
    total, distinct, ends = known.agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.count("*"),
        F.expr("coalesce(sum(n) filter (where word = cast('' as binary)), 0)"),
    ).first()
    letters = known.mapInArrow(_letters, "at bigint, n bigint").groupBy("at").agg(F.sum("n")).toArrow()
    counts = np.zeros(256, dtype=np.int64)
    counts[letters.column(0).to_numpy()] = letters.column(1).to_numpy()
    spelling = trained(known.select("word"), code_of(counts), _spellings)

    top = (
        known.where("n > 1 and word <> cast('' as binary)")
        .orderBy(F.desc("n"), "word")
        .limit(CODED)
        .mapInArrow(_hashed, "hash bigint, n bigint")
        .toArrow()
    )
    times = top["n"].to_numpy()
    order = np.argsort(-times, kind="stable")
    coded = context.broadcast(Coded(top["hash"].to_numpy().view(np.uint64)[order]))
    code = code_of(np.concatenate(([total - ends - times.sum(), ends], times[order])))
    mixing = trained(rows.where("not held_out").select("text"), code, _token_reader(coded))

    values = settled(
        vocabulary.mapInArrow(_valued(spelling, coded), "hash bigint, n bigint, log10 double"),
        "values",
    )
    ground = 0.1 * (distinct + 1) + total
    top = values.orderBy(F.desc("n"), "hash").limit(FREQUENT).toArrow()
    order = np.argsort(top["hash"].to_numpy().view(np.uint64))
    counts = top["n"].to_numpy()[order]
    frequent = context.broadcast(
        (
            Places(top["hash"].to_numpy().view(np.uint64)[order]),
            counts,
            np.log10((counts + 0.1) / ground),
            top["log10"].to_numpy()[order],
        )
    )
    found = rows.select("doc_id", "held_out", "text").mapInArrow(
        _looked_up(frequent, coded, mixing), LOOKED_UP
    )
    return (
        found.join(values.withColumnRenamed("hash", "of"), F.expr("hash = of"), "left")
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            F.expr("sum(coalesce(known, 0L) + if(n > 0, times, 0L))").alias("n_known"),
            F.lit(total).cast("bigint").alias("train_tokens"),
            F.expr(
                f"sum(coalesce(base, 0D) + coalesce(times * log10((n + 0.1D) / {ground!r}D), 0D))"
            ).alias("base_score"),
            F.expr("sum(coalesce(model, 0D) + coalesce(times * log10, 0D))").alias("score"),
            F.max("n_bytes").alias("n_bytes"),
        )
        .selectExpr("* except (row)", "-score * log2(10) / (n_bytes + 1) as bits_per_byte")
    )
