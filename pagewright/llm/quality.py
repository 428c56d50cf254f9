"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score = w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2), so the
low-rank interactions of all feature pairs cost time linear in a document's
distinct words. The model is fitted on the driver from at most ``max_labelled``
labelled documents, taken in the order of a hash of doc_id; a quarter of these is
held out to set the threshold, below which at most ``max_false_rejects`` of the
good ones fall. Its size is fixed, so what goes to the workers does not grow.

Defined results: a null or empty text has no words and is scored on its structure
and metadata; a null lang or source is a value of its own; a label given several
times counts once, with its lowest quality; with no labels, or labels of one class
only, every document gets the share of good labels (1.0 without any) and is kept.
Repeated rows and null doc_ids are scored like any other row; texts of any length
are read whole; a score at the threshold is kept; columns besides doc_id, text, lang
and source are not read, and keep_good returns them as they were; an empty table
gives no rows. Where several documents carry one labelled doc_id, each is a row of
the sample, which stays within ``max_labelled`` rows in all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import pieces, prepare, text_buffers, word_hashes
from pagewright.llm.dedup import shingles

WORD_BITS, BINS, STATS, META_BITS = 14, 24, 9, 8
WORDS = 1 << WORD_BITS
SIZE = WORDS + STATS * BINS + (2 << META_BITS)
RANK, EPOCHS, BATCH, RATE, DECAY, SEED = 8, 12, 128, 0.08, 1e-5, 7
MAX_LABELLED = 8000
MAX_FALSE_REJECTS = 0.002
_UPPER, _DIGIT, _MARK, _PIPE, _SPACE = (np.zeros(256, bool) for _ in range(5))
for _b in range(128):
    _UPPER[_b], _DIGIT[_b], _SPACE[_b] = chr(_b).isupper(), chr(_b).isdigit(), chr(_b).isspace()
    _MARK[_b] = not chr(_b).isalnum() and chr(_b) not in " \t\r\n.,;:'\"()-|"
_PIPE[ord("|")] = True


@dataclass(frozen=True)
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    threshold: float


def _per_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def features(raw: np.ndarray, off: np.ndarray, lang: list, source: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature indices, their values and the rows' offsets into both; off starts at 0."""
    n = len(off) - 1
    hashes, _, _, at = word_hashes(raw, off)
    row = np.repeat(np.arange(n), np.diff(at))
    key, count = np.unique((row << WORD_BITS) | (hashes & np.uint64(WORDS - 1)).astype(np.int64), return_counts=True)
    owner, index, value = key >> WORD_BITS, key & (WORDS - 1), np.log1p(count)
    norm = np.sqrt(np.bincount(owner, value * value, n))
    value = value / norm[owner]

    size = np.maximum(np.diff(off), 1)
    words = np.diff(at)
    runs, run_at = shingles(raw, off)
    run_row = np.repeat(np.arange(n), np.diff(run_at))
    order = np.lexsort((runs, run_row))
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[order][1:] != runs[order][:-1]) | (run_row[order][1:] != run_row[order][:-1])
    shares = [
        _per_row(_UPPER[raw], off) / size * 2,
        _per_row(_DIGIT[raw], off) / size * 4,
        _per_row(_MARK[raw], off) / size * 4,
        _per_row(_PIPE[raw], off) / size * 8,
        _per_row(_SPACE[raw], off) / size * 2,
        np.bincount(run_row[order][fresh], minlength=n) / np.maximum(np.diff(run_at), 1),
        np.bincount(owner, minlength=n) / np.maximum(words, 1),
        np.log1p(words) / 12,
        (np.diff(off) / np.maximum(words, 1)) / 16,
    ]
    bins = np.stack([WORDS + s * BINS + np.minimum((x * BINS).astype(np.int64), BINS - 1) for s, x in enumerate(shares)], 1)
    base = WORDS + STATS * BINS
    name = lambda x: -1 if x is None else xxhash.xxh32_intdigest(x.encode()) & ((1 << META_BITS) - 1)
    meta = np.array([[base + (name(a) + 1) % (1 << META_BITS), base + (1 << META_BITS) + (name(b) + 1) % (1 << META_BITS)] for a, b in zip(lang, source)], np.int64).reshape(n, 2)
    fixed = np.concatenate([bins, meta], 1)
    weight = np.concatenate([np.full((n, STATS), 0.5), np.full((n, 2), 0.2)], 1)
    owner = np.concatenate([owner, np.repeat(np.arange(n), STATS + 2)])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([index, fixed.ravel()])[order], np.concatenate([value, weight.ravel()])[order].astype(np.float32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def score(model: Model, index: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probability of good quality for each row, by the sum-of-squares identity."""
    if len(at) == 1:
        return np.zeros(0)
    weighted = model.factors[index] * value[:, None]
    sums = np.add.reduceat(weighted, at[:-1], axis=0, dtype=np.float64)
    squares = np.add.reduceat((weighted * weighted).sum(1), at[:-1], dtype=np.float64)
    z = model.bias + np.add.reduceat(model.linear[index] * value, at[:-1], dtype=np.float64) + 0.5 * ((sums * sums).sum(1) - squares)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(index: np.ndarray, value: np.ndarray, at: np.ndarray, good: np.ndarray, max_false_rejects: float = MAX_FALSE_REJECTS) -> Model:
    """AdaGrad on the logistic loss; every fourth row is held out and sets the threshold."""
    if not len(good) or good.min() == good.max():
        share = min(max(float(good.mean()) if len(good) else 1.0, 1e-9), 1 - 1e-9)
        return Model(math.log(share / (1 - share)), np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32), 0.0)
    rng = np.random.default_rng(SEED)
    bias, linear, factors = 0.0, np.zeros(SIZE, np.float32), (rng.standard_normal((SIZE, RANK)) * 0.05).astype(np.float32)
    seen = [1e-3, np.full(SIZE, 1e-3, np.float32), np.full((SIZE, RANK), 1e-3, np.float32)]
    train, held = np.flatnonzero(np.arange(len(good)) % 4 < 3), np.flatnonzero(np.arange(len(good)) % 4 == 3)
    size = np.diff(at)
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for lo in range(0, len(train), BATCH):
            rows = train[lo : lo + BATCH]
            pick = np.concatenate([np.arange(at[r], at[r + 1]) for r in rows])
            here = np.concatenate([[0], np.cumsum(size[rows])])
            i, x = index[pick], value[pick]
            weighted = factors[i] * x[:, None]
            sums = np.add.reduceat(weighted, here[:-1], axis=0)
            z = bias + np.add.reduceat(linear[i] * x, here[:-1]) + 0.5 * ((sums * sums).sum(1) - np.add.reduceat((weighted * weighted).sum(1), here[:-1]))
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good[rows]) / len(rows)
            each = np.repeat(slope, size[rows]).astype(np.float32)
            used, place = np.unique(i, return_inverse=True)
            to_linear = np.bincount(place, each * x, len(used)) + DECAY * linear[used]
            whole = (each * x)[:, None] * (np.repeat(sums, size[rows], axis=0) - weighted)
            to_factors = np.stack([np.bincount(place, whole[:, f], len(used)) for f in range(RANK)], 1) + DECAY * factors[used]
            seen[0] += float(slope.sum()) ** 2
            seen[1][used] += to_linear**2
            seen[2][used] += to_factors**2
            bias -= RATE * float(slope.sum()) / math.sqrt(seen[0])
            linear[used] -= RATE * to_linear / np.sqrt(seen[1][used])
            factors[used] -= RATE * to_factors / np.sqrt(seen[2][used])
    model = Model(bias, linear, factors, 0.5)
    if len(held):
        part = np.concatenate([np.arange(at[r], at[r + 1]) for r in held])
        p = score(model, index[part], value[part], np.concatenate([[0], np.cumsum(size[held])]))
        of_good = np.sort(p[good[held] == 1])
        if len(of_good):
            model = Model(bias, linear, factors, float(min(0.5, of_good[int(max_false_rejects * len(of_good))])))
    return model


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")


def _over(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple]]:
    raw, off = text_buffers(batch.column("text"))
    for lo, hi in pieces(off):
        lang, source = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("lang", "source"))
        yield lo, hi, features(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lang, source)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, (index, value, at) in _over(batch):
            at = pa.array(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("good").slice(lo, hi - lo), batch.column("mark").slice(lo, hi - lo), pa.ListArray.from_arrays(at, pa.array(index.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value))], ["doc_id", "good", "mark", "at", "x"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_false_rejects: float = MAX_FALSE_REJECTS) -> Model:
    """The model from a bounded sample of the labelled documents."""
    prepare(docs.sparkSession)
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("good"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # The sample's bound makes it fit for broadcasting at any size of the corpus.
    known = _rows(docs).join(F.broadcast(sample), "doc_id").withColumn("mark", F.xxhash64("text", "lang", "source"))
    made = known.mapInArrow(_labelled, "doc_id long, good int, mark long, at array<int>, x array<float>")
    found = made.orderBy("doc_id", "mark").limit(max_labelled).toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("mark", "ascending")])
    if not found.num_rows:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(1, np.int64), np.zeros(0))
    sizes = np.array(found.column("at").combine_chunks().value_lengths())
    return fit(found.column("at").combine_chunks().flatten().to_numpy().astype(np.int64), found.column("x").combine_chunks().flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]), (found.column("good").to_numpy() > 0).astype(float), max_false_rejects)


def _scorer(model: Model, out: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found in _over(batch):
                p = np.round(score(model, *found), 6)
                yield from out(batch.slice(lo, hi - lo), p, p >= model.threshold)

    return run


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, quality, keep) for each row."""
    model = train(docs, labels, **options)
    give = lambda batch, p, keep: [pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(keep)], ["doc_id", "quality", "keep"])]
    return _rows(docs).mapInArrow(_scorer(model, give), "doc_id long, quality double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows, all their columns, that the classifier does not reject."""
    model, names = train(docs, labels, **options), docs.columns

    def give(batch: pa.RecordBatch, p: np.ndarray, keep: np.ndarray) -> list[pa.RecordBatch]:
        return [batch.filter(pa.array(keep))]

    return docs.mapInArrow(_scorer(model, give), docs.schema).select(*names)
