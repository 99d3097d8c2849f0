"""Quality of documents: a document classifier whose evidence is combined with what their sites show.

Evidence of a document is the log-odds, against the rate among the labelled, that it is good and not
toxic: two logistic regressions on its words and its shape (repetition, symbols, capitals), trained
on ``sample`` labelled rows at most, those with the least hashed ids.

Sites are levels: all documents, a host, a path of the host. The good rate of a level is a
Beta posterior whose prior has the mean of the level above and a strength taken from how much the
rates of all groups of that level differ, beyond what their sizes explain (method of moments). A
sparse site thus shrinks to what is above it, and a large one speaks for itself. The rates come from
sums per path over all documents, combined before the shuffle. A document is kept if its evidence
and the logit of its path's rate are above 0 together.

Defined cases: without labels of both kinds the evidence is 0 and every document is kept; null texts
count as empty; null hosts and paths are groups of their own; of repeated labels the worst counts;
labels of unknown documents and null labels are left out; repeated rows are documents each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.shared import as_bytes, settled
from tallybook.llm.tokens import Words, blocks

SHAPES = 7
#: Least number of steps of a regression, for small samples.
STEPS = 600
_CLASSES = np.zeros((3, 256), dtype=np.uint8)
_CLASSES[0, 65:91] = 1
_CLASSES[1, 48:58] = 1
_CLASSES[2, [*b"#$%&*+/<=>@[]^_`{|}~!\\"]] = 1


@dataclass(frozen=True)
class Sites:
    """SQL expressions of a document's host and path, and the bound of the training sample."""

    host: str = "source"
    path: str = "lang"
    sample: int = 20_000


def _described(texts: list[bytes], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words as (document, 32-bit hash), and the shape of each document."""
    counts = np.diff(words.bounds)
    owners = np.repeat(np.arange(len(words), dtype=np.uint64), counts)
    pairs = np.sort((owners << np.uint64(32)) | (words.hashes >> np.uint64(32)))
    if len(pairs):
        pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
    owner = (pairs >> np.uint64(32)).astype(np.int64)
    again = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    again[2:] = np.cumsum(words.hashes[1:] == words.hashes[:-1])
    first = np.minimum(words.bounds[:-1] + 1, len(again) - 1)
    repeats = again[words.bounds[1:]] - again[first]
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    size = np.maximum(np.diff(words.offsets) - 1, 1)
    shapes = np.empty((len(words), SHAPES))
    for k, kind in enumerate(_CLASSES):
        shapes[:, k] = np.add.reduceat(kind[raw], words.offsets[:-1], dtype=np.int64) / size
    some = np.maximum(counts, 1)
    shapes[:, 3] = np.maximum(repeats, 0) / some
    shapes[:, 4] = np.bincount(owner, minlength=len(words)) / some
    shapes[:, 5] = np.log1p(counts)
    shapes[:, 6] = np.minimum(size / some, 50) / 10
    return owner, (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), shapes


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and shape of the labelled documents (text, good, toxic)."""
    for batch in batches:
        texts = [text or b"" for text in as_bytes(batch.column(0))]
        for start, words in blocks(texts):
            owner, hashed, shapes = _described(texts[start : start + len(words)], words)
            bounds = np.searchsorted(owner, np.arange(len(words) + 1))
            own = [hashed[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own, type=pa.binary()),
                    pa.array([row.tobytes() for row in shapes], type=pa.binary()),
                    batch.column(1).slice(start, len(words)),
                    batch.column(2).slice(start, len(words)),
                ],
                names=["words", "shape", "good", "toxic"],
            )


def _fitted(features, bounds, shapes, labels, size, seed) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by Adagrad over shuffled portions: weights of words, of shape, and bias."""
    rng = np.random.default_rng(seed)
    weights, form = np.zeros(size), np.zeros(shapes.shape[1])
    rate = np.clip(labels.mean(), 1e-4, 1 - 1e-4)
    bias = float(np.log(rate / (1 - rate)))
    square, square_form, square_bias = np.full(size, 1e-6), np.full(len(form), 1e-6), 1e-6
    per = 256
    for _ in range(max(12, STEPS * per // len(labels))):
        order = rng.permutation(len(labels))
        for start in range(0, len(labels), per):
            rows = order[start : start + per]
            counts = bounds[rows + 1] - bounds[rows]
            own = np.repeat(np.arange(len(rows)), counts)
            at = np.repeat(bounds[rows], counts) + np.arange(counts.sum()) - np.repeat(
                np.cumsum(counts) - counts, counts
            )
            word = features[at]
            score = np.bincount(own, weights[word], len(rows)) + shapes[rows] @ form + bias
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[rows]
            slope = np.bincount(word, error[own], size) / len(rows) + 1e-5 * weights
            slope_form = error @ shapes[rows] / len(rows)
            slope_bias = float(error.mean())
            square += slope**2
            square_form += slope_form**2
            square_bias += slope_bias**2
            weights -= 0.1 * slope / np.sqrt(square)
            form -= 0.1 * slope_form / np.sqrt(square_form)
            bias -= 0.1 * slope_bias / square_bias**0.5
    return weights, form, bias


class Model:
    """Evidence of documents, trained on their words and shapes; ``None`` labels give none."""

    #: Words of fewer labelled documents tell nothing.
    FEWEST = 5

    def __init__(self, rows: pa.Table):
        good = np.array(rows["good"].to_pylist(), dtype=float)
        toxic = np.array(rows["toxic"].to_pylist(), dtype=float)
        self.heads: list = []
        self.known = np.empty(0, dtype=np.uint32)
        fine = good * (1 - toxic)
        if not 0 < fine.sum() < len(fine):
            return
        lists = [np.frombuffer(own, dtype=np.uint32) for own in rows["words"].to_pylist()]
        shapes = np.stack([np.frombuffer(own) for own in rows["shape"].to_pylist()])
        every = np.concatenate(lists)
        names, times = np.unique(every, return_counts=True)
        self.known = names[times >= self.FEWEST]
        self.middle, self.spread = shapes.mean(axis=0), shapes.std(axis=0) + 1e-6
        shapes = self.standard(shapes)
        counts = np.array([len(own) for own in lists])
        owner = np.repeat(np.arange(len(lists)), counts)
        place, hit = self.places(every)
        owner, place = owner[hit], place[hit]
        bounds = np.searchsorted(owner, np.arange(len(lists) + 1))
        for seed, labels in enumerate((good, 1 - toxic)):
            if 0 < labels.sum() < len(labels):
                own = _fitted(place, bounds, shapes, labels, len(self.known), seed)
                self.heads.append((own[0].astype(np.float32), *own[1:]))
        rate = fine.mean()
        self.base = float(np.log(rate / (1 - rate)))

    def standard(self, shapes: np.ndarray) -> np.ndarray:
        return np.clip((shapes - self.middle) / self.spread, -5, 5)

    def places(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return np.zeros(len(hashed), dtype=np.int64), np.zeros(len(hashed), dtype=bool)
        place = np.minimum(np.searchsorted(self.known, hashed), len(self.known) - 1)
        return place, self.known[place] == hashed

    def evidence(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        if not self.heads:
            return out
        texts = [text or b"" for text in texts]
        for start, words in blocks(texts):
            owner, hashed, shapes = _described(texts[start : start + len(words)], words)
            place, hit = self.places(hashed)
            owner, place, shapes = owner[hit], place[hit], self.standard(shapes)
            odds = np.zeros(len(words))  # of being bad in one way or another
            for weights, form, bias in self.heads:
                score = np.bincount(owner, weights[place], len(words)) + shapes @ form + bias
                odds += np.exp(-np.clip(score, -30, 30))
            out[start : start + len(words)] = -np.log(odds) - self.base
        return out


def trained(documents: DataFrame, labels: DataFrame, sample: int) -> Model:
    """A model from ``sample`` rows of ``labels`` (doc_id, quality, toxic) at most."""
    chosen = (
        labels.dropna(subset=["doc_id", "quality", "toxic"])
        .groupBy("doc_id")
        .agg(F.min("quality").alias("good"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = (
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of three numbers
        .select("text", "good", "toxic")
        .mapInArrow(_features, "words binary, shape binary, good int, toxic int")
    )
    return Model(rows.toArrow())


def _scored(model: Model, names: list[str]):
    """The rows without the text they are scored by (the first column), with their evidence."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence = pa.array(model.evidence(as_bytes(batch.column(0))))
            columns = [*batch.columns[1:], evidence]
            yield pa.RecordBatch.from_arrays(columns, names=[*names[1:], "evidence_"])

    return scored


def _thin(documents: DataFrame, columns: tuple, sites: Sites) -> DataFrame:
    """The text, the wanted ``columns`` as one, host and path."""
    own = f"struct({', '.join(f'`{name}`' for name in columns)}) as own_"
    return documents.selectExpr(
        "text as text_", own, f"{sites.host} as host_", f"{sites.path} as path_"
    )


def _schema(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields[1:], T.StructField("evidence_", T.DoubleType())])


def _strength(groups: DataFrame, above: str) -> float:
    """How strongly groups (n, good) hold to the rate ``above`` them: a Beta prior's weight.

    The rates differ by chance, about r (1 - r) / n, and beyond that; the less beyond, the stronger.
    """
    chance = f"sum({above} * (1 - {above}))"
    row = groups.selectExpr(
        f"sum(n * power(good / n - {above}, 2)) as seen",
        f"{chance} as chance",
        f"sum(n * {above} * (1 - {above})) as whole",
        "sum(n) as n",
    ).first()
    if not row.n or not row.whole:
        return 1.0
    beyond = (row.seen - row.chance) / row.n
    return float(np.clip(row.whole / row.n / max(beyond, 1e-9) - 1, 1.0, 1e6))


def site_rates(evidence: DataFrame, model: Model) -> DataFrame:
    """Per host_ and path_: the good rate, shrunk to the host's, shrunk to that of all; settled."""
    base = getattr(model, "base", 0.0)
    good = f"1 / (1 + exp(-least(greatest(evidence_ + {base!r}D, -30D), 30D)))"
    paths = settled(
        evidence.groupBy("host_", "path_").agg(
            F.count("*").cast("double").alias("n"), F.sum(F.expr(good)).alias("good")
        ),
        "paths",
    )
    row = paths.selectExpr("sum(good) / sum(n) as rate").first()
    overall = float(np.clip(0.5 if row.rate is None else row.rate, 1e-6, 1 - 1e-6))
    hosts = paths.groupBy("host_").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    hold = _strength(hosts, f"{overall!r}D")
    hosts = hosts.selectExpr(
        "host_ as of_host", f"(good + {hold!r}D * {overall!r}D) / (n + {hold!r}D) as host_rate"
    )
    paths = paths.join(hosts, F.expr("host_ <=> of_host")).drop("of_host")
    hold = _strength(paths, "host_rate")
    rates = paths.selectExpr(
        "host_ as of_host",
        "path_ as of_path",
        "host_rate",
        f"(good + {hold!r}D * host_rate) / (n + {hold!r}D) as path_rate",
    )
    return settled(rates, "rates")


def _judged(
    documents: DataFrame, labels: DataFrame, sites: Sites, columns: tuple[str, ...]
) -> DataFrame:
    """``columns`` of ``documents`` as own_, evidence, host_rate, path_rate, score and kept."""
    model = trained(documents, labels, sites.sample)
    thin = _thin(documents, (), sites)
    rates = site_rates(thin.mapInArrow(_scored(model, thin.columns), _schema(thin)), model)
    rows = _thin(documents, columns, sites)
    scored = rows.mapInArrow(_scored(model, rows.columns), _schema(rows))
    # Spark broadcasts the rates if their table is small enough, and else splits hot hosts.
    return (
        scored.join(rates, F.expr("host_ <=> of_host and path_ <=> of_path"), "left")
        .selectExpr(
            "own_",
            "evidence_ as evidence",
            "host_rate",
            "path_rate",
            "evidence_ + ln(path_rate / (1 - path_rate)) as score",
        )
        .withColumn("kept", F.col("score") > 0 if model.heads else F.lit(True))
    )


def assessed(documents: DataFrame, labels: DataFrame, sites: Sites | None = None) -> DataFrame:
    """Per row of ``documents``: doc_id, evidence, host_rate, path_rate, score and kept."""
    rows = _judged(documents, labels, sites or Sites(), ("doc_id",))
    return rows.select("own_.doc_id", "evidence", "host_rate", "path_rate", "score", "kept")


def accepted(documents: DataFrame, labels: DataFrame, sites: Sites | None = None) -> DataFrame:
    """``documents`` without those the classifier rejects."""
    rows = _judged(documents, labels, sites or Sites(), tuple(documents.columns))
    return rows.where("kept").select("own_.*")
