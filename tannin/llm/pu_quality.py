"""Quality from trusted positives and unlabelled web text.

Texts become vectors of shares: shapes (runs of character classes), marks, repetition and
length.  A linear score g is learned with squared loss by the non-negative unbiased risk

    prior * R+(trusted, g) + max(0, R-(all, g) - prior * R-(trusted, g)),

where R+ and R- are mean losses for calling texts good and bad (Kiryo et al., 2017).  With
this loss every risk is a quadratic form of second moments, so one pass over all texts
gathers all that fitting needs; no text is sampled and nothing but moments reaches the
driver.  The prior is the best-bin estimate (Garg et al., 2021): above some bound of a
score that tells trusted texts from all, the share of all texts over that of trusted ones
is smallest, and bounds the share of good texts from above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tannin.llm.words import byte_slices, segment_sums, split_words, text_column, tidy
from tannin.sources import sinks

THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
PENALTY = 1e-4
#: Bins of the score that the prior is read from, between these ends.
BINS, LOW, HIGH = 2000, -1.0, 2.0
#: Chance that the prior's bound fails.
DELTA = 0.1
BATCH_BYTES = 4 << 20

# classes of characters; runs of one class are one symbol of a shape
_MARKS = (".", ",", "!", "?", ";:", "'\"`", "()[]{}", "|", "-_", "/\\", "<>", "#$%&*@^~+=")
LETTER, CAPITAL, DIGIT, SPACE, LINE = range(5)
CLASSES = 5 + len(_MARKS) + 1
#: Shapes of three symbols are hashed to so many places.
SHAPES = 128


def _classes() -> np.ndarray:
    """The class of each byte of UTF-8; 255 for the bytes inside a character."""
    table = np.full(256, CLASSES - 1, np.uint8)
    table[0x61:0x7B], table[0x41:0x5B], table[0x30:0x3A] = LETTER, CAPITAL, DIGIT
    table[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], table[0x0A] = SPACE, LINE
    for i, marks in enumerate(_MARKS):
        table[[ord(m) for m in marks]] = 5 + i
    table[0xC0:], table[0x80:0xC0] = LETTER, 255
    return table


_CLASS = _classes()


def _steps(values: np.ndarray, bounds: Sequence[float]) -> np.ndarray:
    """One column per interval between the bounds, 1 where the value lies in it."""
    return np.eye(len(bounds) + 1)[np.searchsorted(bounds, values, side="right")]


_LOW_SHARES = (1e-9, 0.003, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7)
_SHARES = tuple(i / 10 for i in range(1, 10))
_SIZES = (1, 5, 20, 50, 100, 200, 500, 1000, 3000, 10000)
WIDTH = 1 + CLASSES + SHAPES + 4 * (len(_LOW_SHARES) + 1) + 2 * (len(_SHARES) + 1) + len(_SIZES) + 1


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each."""
    wide = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.zeros(0, np.uint8)
    return data, ends.astype(np.int64) - int(ends[0])


def features_of(texts: pa.Array) -> np.ndarray:
    """A row of ``WIDTH`` shares per text; the first is 1."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return np.zeros((0, WIDTH))
    data, ends = _bytes_of(texts)
    kind = _CLASS[data]
    own = kind != 255
    kind, of = kind[own].astype(np.int64), np.repeat(np.arange(n), np.diff(ends))[own]
    size = np.maximum(1, np.bincount(of, minlength=n))
    held = np.bincount(of * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / size[:, None]

    begins = np.flatnonzero((np.diff(kind, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
    run, run_of = kind[begins], of[begins]
    shape = ((run[:-2] * CLASSES + run[1:-1]) * CLASSES + run[2:]) * 2654435761 % 4294967296 % SHAPES \
        if len(run) > 2 else np.zeros(0, np.int64)
    whole = np.flatnonzero(run_of[:-2] == run_of[2:]) if len(run) > 2 else shape
    shapes = np.bincount(run_of[whole] * SHAPES + shape[whole], minlength=n * SHAPES).reshape(n, SHAPES)
    shapes = shapes / np.maximum(1, shapes.sum(axis=1))[:, None]

    words = split_words(texts)
    count = np.diff(words.offsets)
    names, index = words.distinct()
    word_of = np.repeat(np.arange(n), count)
    pairs, times = np.unique(word_of * max(1, len(names)) + index, return_counts=True)
    pair_of = pairs // max(1, len(names))
    some = np.maximum(1, count)
    distinct = np.bincount(pair_of, minlength=n) / some
    most = np.zeros(n)
    np.maximum.at(most, pair_of, times)
    again = np.concatenate([[False], (index[1:] == index[:-1]) & (word_of[1:] == word_of[:-1])]) \
        if len(index) else np.zeros(0, bool)
    again = segment_sums(again, words.offsets) / some
    letters = np.maximum(1e-9, held[:, LETTER] + held[:, CAPITAL])
    marks = held[:, 5:].sum(axis=1)
    odd = marks - held[:, 5] - held[:, 6]  # but for full stops and commas
    return np.concatenate([
        np.ones((n, 1)), np.sqrt(held), np.sqrt(shapes), _steps(held[:, CAPITAL] / letters, _LOW_SHARES),
        _steps(odd, _LOW_SHARES), _steps(again, _LOW_SHARES), _steps(most / some, _LOW_SHARES),
        _steps(distinct, _SHARES), _steps(marks / (marks + held[:, SPACE] + 1e-9), _SHARES),
        _steps(count, _SIZES)], axis=1)


def vectors(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Struct ``_row`` of the named columns and ``features``, a row per row of ``docs``."""
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row")
    read = docs.select(row, text_column().alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for a, b in byte_slices(batch.column("_text"), BATCH_BYTES):
                found = features_of(batch.column("_text").slice(a, b - a)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("_row").slice(a, b - a),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(b - a + 1, dtype=np.int32) * WIDTH), pa.array(found.ravel()))],
                    ["_row", "features"])

    kind = read.schema["_row"].dataType.simpleString()
    return read.mapInArrow(run, f"_row {kind}, features array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)


def _of_kinds(batch: pa.RecordBatch) -> Iterator[tuple[bool, np.ndarray]]:
    trusted = batch.column("trusted").to_numpy(zero_copy_only=False)
    x = _matrix(batch.column("features"))
    for kind in (False, True):
        if (trusted == kind).any():
            yield kind, x[trusted == kind]


def moments(known: DataFrame) -> dict[bool, np.ndarray]:
    """Second moments, summed over the rows without and with trust; WIDTH x WIDTH each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bool, np.ndarray] = {}
        for batch in tidy(batches):
            for kind, x in _of_kinds(batch):
                sums[kind] = sums.get(kind, 0) + x.T @ x
        for kind, total in sums.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([kind] * WIDTH), pa.array(np.arange(WIDTH, dtype=np.int32)),
                pa.ListArray.from_arrays(pa.array(np.arange(WIDTH + 1, dtype=np.int32) * WIDTH),
                                         pa.array(total.ravel()))], ["trusted", "line", "v"])

    # the lines of the tasks' matrices are added up by the executors, line by line
    lines = known.mapInArrow(run, "trusted boolean, line int, v array<double>")
    summed = lines.groupBy("trusted", "line").agg(
        *(F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(WIDTH)))
    found = {kind: np.zeros((WIDTH, WIDTH)) for kind in (False, True)}
    for r in summed.collect():  # 2 x WIDTH lines
        found[r["trusted"]][r["line"]] = r[2:]
    return found


def histogram(known: DataFrame, weights: np.ndarray) -> dict[bool, np.ndarray]:
    """Rows by bin of their score, without and with trust."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for kind, x in _of_kinds(batch):
                place = np.clip((x @ weights - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
                bins, count = np.unique(place, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(bins)), pa.array(bins), pa.array(count)], ["trusted", "bin", "n"])

    counted = known.mapInArrow(run, "trusted boolean, bin int, n long").groupBy("trusted", "bin").agg(F.sum("n").alias("n"))
    found = {kind: np.zeros(BINS, np.int64) for kind in (False, True)}
    for r in counted.collect():  # 2 x BINS rows
        found[r["trusted"]][r["bin"]] = r["n"]
    return found


def class_prior(trusted: np.ndarray, every: np.ndarray, delta: float = DELTA) -> float:
    """The share of good texts among all, from rows by bin of ascending score."""
    n_trusted, n_every = trusted.sum(), every.sum()
    if not n_trusted or not n_every:
        return 0.5
    above_trusted = np.cumsum(trusted[::-1]) / n_trusted
    above_every = np.cumsum(every[::-1]) / n_every
    slack = math.sqrt(math.log(4 / delta) / (2 * n_trusted)) + math.sqrt(math.log(4 / delta) / (2 * n_every))
    some = above_trusted > 0
    ratio, bound = np.full(len(some), np.inf), np.full(len(some), np.inf)
    ratio[some] = above_every[some] / above_trusted[some]
    bound[some] = ratio[some] + slack / above_trusted[some]
    return float(np.clip(ratio[np.argmin(bound)], 0.01, 0.99))


def _solve(matrix: np.ndarray, right: np.ndarray, scale: np.ndarray, penalty: float) -> np.ndarray:
    """The solution with a penalty on all but the first weight, in units of the scale."""
    a = matrix / np.outer(scale, scale)
    a[np.arange(1, len(a)), np.arange(1, len(a))] += penalty
    return np.linalg.lstsq(a, right / scale, rcond=None)[0] / scale


def non_negative_fit(trusted: np.ndarray, every: np.ndarray, prior: float, penalty: float = PENALTY,
                     rounds: int = 2000) -> np.ndarray:
    """Weights that minimise the non-negative risk; both matrices are mean second moments.

    The loss of score g for label y is (g y - 1)^2 / 4.  Where the second term is positive
    at the unbiased optimum, that is the solution; else both terms are descended together,
    and where the second is negative only the first, as the maximum demands.
    """
    scale = np.sqrt(np.maximum(np.diag(every), 1e-6))
    mean_t, mean_e = trusted[0], every[0]
    ridge = penalty * np.append(0.0, scale[1:] ** 2)
    negative = lambda w: 0.25 * (
        (w @ every @ w + 2 * mean_e @ w + 1) - prior * (w @ trusted @ w + 2 * mean_t @ w + 1))
    risk = lambda w: 0.25 * prior * (w @ trusted @ w - 2 * mean_t @ w + 1) \
        + max(0.0, negative(w)) + 0.25 * ridge @ (w * w)
    weights = _solve(every, 2 * prior * mean_t - mean_e, scale, penalty)
    if negative(weights) >= 0:
        return weights
    best, least = weights, risk(weights)
    step = 1.0 / max(1.0, np.linalg.eigvalsh(every / np.outer(scale, scale))[-1])
    for _ in range(rounds):
        gradient = 0.5 * prior * (trusted @ weights - mean_t) + 0.5 * ridge * weights
        if negative(weights) > 0:
            gradient = gradient + 0.5 * (every @ weights + mean_e - prior * (trusted @ weights + mean_t))
        weights = weights - step * gradient / scale ** 2
        if risk(weights) < least:
            best, least = weights, risk(weights)
    return best


@dataclass
class Model:
    weights: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Half of g + 1, which estimates the probability of a good text, from 0 to 1."""
        return np.clip((x @ self.weights + 1) / 2, 0.0, 1.0)


def in_fold(doc_id: Column) -> Column:
    """Whether a document is held out; null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(found: DataFrame, labels: DataFrame, positive: int = 1) -> Model:
    """Fit on ``vectors(docs, [.., "doc_id"])``, best stored, and on trusted positives.

    Trusted are documents with a label ``quality`` of ``positive`` outside the held-out
    fold; of other labels nothing is used.  Unlabelled are all documents.  Without trusted
    documents, or without documents, every score is one half.
    """
    doc_id = F.col("_row.doc_id")
    trusted = labels.filter((F.col("quality") == positive) & F.col("doc_id").isNotNull()
                            & ~in_fold(F.col("doc_id"))).select(F.col("doc_id").alias("_id")).distinct()
    known = found.join(trusted, doc_id == F.col("_id"), "left").select(
        F.col("_id").isNotNull().alias("trusted"), "features")
    sums = moments(known)
    n_trusted, n_every = sums[True][0, 0], sums[True][0, 0] + sums[False][0, 0]
    if not n_trusted:
        return Model(np.zeros(WIDTH), 0.5)
    trusted, every = sums[True] / n_trusted, (sums[True] + sums[False]) / n_every
    scale = np.sqrt(np.maximum(np.diag(every), 1e-6))
    penalty = PENALTY + 1 / n_trusted  # few trusted documents must not be learned by heart
    apart = _solve((trusted + every) / 2, trusted[0] / 2, scale, penalty)
    bins = histogram(known, apart)
    prior = class_prior(bins[True], bins[True] + bins[False])
    return Model(non_negative_fit(trusted, every, prior, penalty), prior)


def score(found: DataFrame, model: Model) -> DataFrame:
    """Struct ``_row`` and score of every row of ``vectors``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(model.scores(_matrix(batch.column("features"))))], ["_row", "score"])

    return found.mapInArrow(run, f"_row {found.schema['_row'].dataType.simpleString()}, score double")


def judge(docs: DataFrame, labels: DataFrame, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Struct ``_row`` of the named columns, ``doc_id`` among them, and score of every document.

    Whole texts are scored; null and empty texts have the score of a text without
    characters.  Repeated rows count and are scored each; a label holds for all rows with
    its doc_id, and several labels of a doc_id are one.  Other columns are not read.  The
    vectors are stored when this is called.
    """
    found = sinks.store(vectors(docs, columns), "vectors")
    return score(found, fit(found, labels))
