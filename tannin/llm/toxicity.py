"""Toxic spans by a linear-chain conditional random field.

Tags of a word are 0 and 1 (toxic).  A word's own features are its form, prefixes and a
suffix; the chain runs over the words of a sentence.  Labels are given per document, so
the words of toxic training documents that carry a significant sign of toxicity are the
labelled tokens.  Marginals come from forward and backward products of 2 x 2 matrices,
scanned over all sentences of a batch at once; a document's score is a logistic function
of its words' marginals.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tannin.llm.words import WORD, byte_slices, segment_sums, split_words, text_column, tidy

#: Labelled documents that a model is fitted on, at most.
MAX_DOCS = 3000
#: Words in sentences that the weights are fitted on, at most, about.
MAX_WORDS = 200_000
THRESHOLD = 0.7
#: Words whose own score a worker remembers.
MAX_KNOWN = 400_000
ROUNDS, RATE, PENALTY = 60, 0.7, 1e-4
BATCH_BYTES = 1 << 20
_WORD = re.compile(WORD)


def features(word: str) -> list[str]:
    """The form of a word without marks around it, its prefixes and its suffix."""
    form = word.lower()
    start, stop = 0, len(form)
    while start < stop and not form[start].isalnum():
        start += 1
    while stop > start and not form[stop - 1].isalnum():
        stop -= 1
    form = form[start:stop]
    return ["w" + form, *(f"p{form[:n]}" for n in (3, 4, 5, 6, 7) if len(form) > n), *(
        ["s" + form[-3:]] if len(form) > 3 else [])] if form else []


def _combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of matrices given as rows (m00, m01, m10, m11), scaled to a largest of 1."""
    out = np.empty_like(b)
    out[0], out[1] = a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3]
    out[2], out[3] = a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]
    return out / out.max(axis=0)


def _products(matrices: np.ndarray, place: np.ndarray, longest: int) -> np.ndarray:
    """Product of each sentence's matrices up to each word, by doubling steps."""
    found, step = matrices, 1
    while step < longest:
        of = np.flatnonzero(place >= step)
        new = found.copy()
        new[:, of] = _combine(found[:, of - step], found[:, of])
        found, step = new, step * 2
    return found


def marginals(emission: np.ndarray, offsets: np.ndarray, start: np.ndarray, moves: np.ndarray):
    """Probability of tag 1 of each word, and pair probabilities of each word and the one before.

    ``emission`` is the score of tag 1; sentence i is offsets[i]:offsets[i + 1], none empty.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((4, 0))
    sizes = np.diff(offsets)
    first = np.repeat(offsets[:-1], sizes)
    place = np.arange(n) - first
    height = np.maximum(emission, 0.0)
    off, on = np.exp(-height), np.exp(emission - height)
    m = np.exp(moves)
    matrices = np.stack([m[0, 0] * off, m[0, 1] * on, m[1, 0] * off, m[1, 1] * on])
    opening = place == 0
    s = np.exp(start)
    begin = matrices.copy()
    begin[0, opening] = begin[2, opening] = s[0] * off[opening]
    begin[1, opening] = begin[3, opening] = s[1] * on[opening]
    forward = _products(begin, place, int(sizes.max()))[:2]
    # backward: the same scan over the reversed words with transposed matrices
    after = np.empty_like(matrices)
    after[:, :-1] = matrices[:, 1:]
    last = np.repeat(offsets[1:], sizes) - 1
    closing = np.arange(n) == last
    after[:, closing] = 1.0
    turned = after[[0, 2, 1, 3]][:, ::-1]
    products = _products(turned, (last - np.arange(n))[::-1], int(sizes.max()))[:, ::-1]
    # rows of the transposed product summed: what follows the word, for each of its tags
    backward = np.stack([products[0] + products[2], products[1] + products[3]])
    both = forward * backward
    p = both[1] / both.sum(axis=0)
    pairs = np.zeros((4, n))
    inner = np.flatnonzero(~opening)
    before = forward[:, inner - 1]
    pairs[:, inner] = np.stack([before[0], before[0], before[1], before[1]]) * matrices[:, inner] \
        * backward[[0, 1, 0, 1]][:, inner]
    pairs[:, inner] /= pairs[:, inner].sum(axis=0)
    return p, pairs


def sentences(words: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """Ends of sentences: after words that end in . ! or ?, and at the end of each text."""
    closing = pc.match_substring_regex(words, r"[.!?][\"')\]]*$").to_numpy(zero_copy_only=False)
    return np.unique(np.concatenate([[0], np.flatnonzero(closing) + 1, offsets]))


@dataclass
class Tagger:
    """A fitted field: weights of features, of starts and moves, and of the document score."""

    weights: dict[str, float]
    start: np.ndarray
    moves: np.ndarray
    document: np.ndarray
    known: dict[str, float] = field(default_factory=dict, repr=False)  # emissions so far

    def emission(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MAX_KNOWN:
                self.known.clear()
            found = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return found

    def tag(self, texts: pa.Array):
        """Words of the texts and the marginal of each."""
        words = split_words(texts)
        distinct, index = words.distinct()
        scores = np.array([self.emission(w) for w in distinct.to_pylist()])
        emission = scores[index] if len(index) else np.zeros(0)
        p, _ = marginals(emission, sentences(words.words, words.offsets), self.start, self.moves)
        return words, p

    def scores(self, p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_summary(p, offsets) @ self.document))


def _summary(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document: one, log odds of the largest marginal, the logarithm of the expected toxic words."""
    sizes = np.diff(offsets)
    largest = np.zeros(len(sizes))
    if len(p):
        some = sizes > 0
        largest[some] = np.maximum.reduceat(p, offsets[:-1][some])
    expected = segment_sums(np.where(p >= 0.2, p, 0.0), offsets)
    largest = np.clip(largest, 1e-3, 1 - 1e-3)
    return np.stack([np.ones(len(sizes)), np.log(largest / (1 - largest)), np.log1p(expected)], axis=1)


def signs(docs_with: np.ndarray, toxic_with: np.ndarray, n_docs: int, n_toxic: int) -> np.ndarray:
    """Whether each feature's documents are toxic far more often than by chance.

    At least half are, and the divergence from the share of toxic documents holds against
    as many trials as there are features.
    """
    if not 0 < n_toxic < n_docs:
        return np.zeros(len(docs_with), bool)
    share, needed = n_toxic / n_docs, np.log(max(1, len(docs_with))) + 5
    rate = toxic_with / np.maximum(docs_with, 1)
    other = 1 - rate
    divergence = np.where(rate > 0, rate * np.log(np.maximum(rate, 1e-12) / share), 0) + np.where(
        other > 0, other * np.log(np.maximum(other, 1e-12) / (1 - share)), 0)
    return (rate >= 0.5) & (rate > share) & (docs_with * divergence > needed)


def _descend(gradient, parameters: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    """Gradient steps, each scaled by the sizes of the gradients so far."""
    seen = np.full(len(parameters), 1e-8)
    for _ in range(rounds):
        g = gradient(parameters)
        seen += g * g
        parameters = parameters - rate * g / np.sqrt(seen)
    return parameters


def fit_tagger(texts: Sequence[str], labels: Sequence[int]) -> Tagger:
    """Fit on whole labelled texts.  Without both labels, all scores are the share of 1."""
    labels = np.array(labels, dtype=np.int64)
    words = split_words(pa.array(list(texts), pa.large_string()))
    distinct, index = words.distinct()
    sizes = np.diff(words.offsets)
    doc = np.repeat(np.arange(len(labels)), sizes)

    # features of each distinct word as numbers, one word after another; only their hashes are
    # held, as the names of all are many times larger than the texts
    hashes, counts = array("Q"), []
    for word in distinct.to_pylist():
        found = features(word)
        counts.append(len(found))
        hashes.extend(map(xxhash.xxh64_intdigest, found))
    every_hash = np.frombuffer(hashes, np.uint64) if hashes else np.zeros(0, np.uint64)
    names, flat = np.unique(every_hash, return_inverse=True)
    del hashes, every_hash
    flat, ends = flat.astype(np.int32), np.cumsum([0, *counts])

    def features_of(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of words, and for each of them the place of its word in ``kinds``."""
        size = ends[kinds + 1] - ends[kinds]
        upto = np.cumsum(size)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(ends[kinds] - upto + size, size)
        return flat[at], np.repeat(np.arange(len(kinds)), size)

    docs_with, toxic_with = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for i, label in enumerate(labels):
        held = np.unique(features_of(np.unique(index[words.offsets[i]:words.offsets[i + 1]]))[0])
        docs_with[held] += 1
        toxic_with[held] += label
    cues = signs(docs_with, toxic_with, len(labels), int(labels.sum()))
    has_cue = np.zeros(len(distinct), bool)
    every, word_of = features_of(np.arange(len(distinct)))
    has_cue[word_of[cues[every]]] = True
    sign = has_cue[index] if len(index) else np.zeros(0, bool)
    y = sign & (labels[doc] == 1)

    # sentences with and without signs, each evenly spread, up to half of MAX_WORDS
    closes = sentences(words.words, words.offsets)
    size, positive = np.diff(closes), segment_sums(sign, closes) > 0
    order = np.argsort(np.arange(len(size)) * 2654435761 % 4294967291)
    picked = [part[np.cumsum(size[part]) <= MAX_WORDS // 2]
              for part in (order[positive[order]], order[~positive[order]])]
    chosen = np.sort(np.concatenate(picked))
    length = size[chosen]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    of = np.arange(offsets[-1]) + np.repeat(closes[chosen] - offsets[:-1], length)
    kinds, kind = np.unique(index[of], return_inverse=True) if len(of) else (np.zeros(0, int), np.zeros(0, int))
    tags = y[of].astype(np.float64)

    own, rows = features_of(kinds)
    used, columns = np.unique(own, return_inverse=True)
    opening = np.zeros(len(of), bool)
    opening[offsets[:-1]] = True
    before = np.concatenate([[0.0], tags[:-1]]) if len(tags) else tags
    seen_moves = np.array([[np.sum((before == a) & (tags == b) & ~opening) for b in (0, 1)] for a in (0, 1)])
    seen_start = np.array([np.sum(opening & (tags == b)) for b in (0, 1)])

    def gradient(parameters: np.ndarray) -> np.ndarray:
        weights, start, moves = parameters[:-6], parameters[-6:-4], parameters[-4:].reshape(2, 2)
        scores = np.bincount(rows, weights[columns], len(kinds))
        p, pairs = marginals(scores[kind], offsets, start, moves)
        by_kind = np.bincount(kind, p - tags, len(kinds))
        own_g = np.bincount(columns, by_kind[rows], len(weights))
        opened = p[opening].sum()
        start_g = np.array([opening.sum() - opened, opened]) - seen_start
        moves_g = pairs.sum(axis=1) - seen_moves.ravel()
        scale = max(1, len(tags))
        return np.concatenate([own_g, start_g, moves_g]) / scale + PENALTY * parameters / scale

    start_at = np.zeros(len(used) + 6)
    fitted = _descend(gradient, start_at, ROUNDS, RATE) if len(of) else start_at
    # names are made again for the features that have a weight
    weighing = np.flatnonzero(np.abs(fitted[:-6]) > 1e-6)
    weight_of = dict(zip(names[used[weighing]].tolist(), fitted[weighing].tolist()))
    weights = {}
    for word in distinct.take(pa.array(kinds)).to_pylist():
        for f in features(word):
            weight = weight_of.get(xxhash.xxh64_intdigest(f))
            if weight is not None:
                weights[f] = weight
    tagger = Tagger(weights, fitted[-6:-4], fitted[-4:].reshape(2, 2), np.zeros(3))

    # the document score, on the same documents
    given = pa.array(list(texts), pa.large_string())
    parts = [np.zeros((0, 3))]
    for a, b in byte_slices(given, BATCH_BYTES):
        tagged, p = tagger.tag(given[a:b])
        parts.append(_summary(p, tagged.offsets))
    summary = np.concatenate(parts)

    def slope(w: np.ndarray) -> np.ndarray:
        return summary.T @ (1 / (1 + np.exp(-summary @ w)) - labels) / max(1, len(labels)) + 1e-5 * w

    tagger.known = {}
    tagger.document = _descend(slope, np.zeros(3), 2000, RATE) if len(labels) else np.array([-5.0, 0, 0])
    return tagger


def in_fold(doc_id: Column, folds: int, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold``; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Tagger:
    """Fit on at most ``max_docs`` labelled documents, the first by a hash of their ids.

    Only labels outside the held-out fold (crc32(doc_id) mod 3 = 1) are used.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
                          & ~in_fold(F.col("doc_id"), 3)).select("doc_id", "toxic")
    found = docs.select("doc_id", text_column().alias("text")).join(
        known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    order = F.xxhash64("doc_id")
    chosen = found.select("doc_id").distinct().orderBy(order, "doc_id").limit(max_docs)
    sample = found.join(F.broadcast(chosen), "doc_id", "left_semi") \
        .groupBy("doc_id").agg(F.max(F.struct("text", "toxic")).alias("v")).select("doc_id", "v.*")
    rows = sample.toArrow().sort_by("doc_id")
    return fit_tagger(rows.column("text").to_pylist(), rows.column("toxic").to_pylist())


SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()),
    T.StructField("probability", T.DoubleType())]))


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of words that are more likely toxic than not: character offsets, largest marginal."""
    spans, last = [], -2
    for k, (word, q) in enumerate(zip(_WORD.finditer(text), p)):
        if q >= 0.5:
            if k == last + 1:
                spans[-1]["stop"] = word.end()
                spans[-1]["probability"] = max(spans[-1]["probability"], float(q))
            else:
                spans.append({"start": word.start(), "stop": word.end(), "probability": float(q)})
            last = k
    return spans


def tag(docs: DataFrame, tagger: Tagger, columns: Sequence[str]) -> DataFrame:
    """Score and toxic spans of every whole text.

    Result: struct ``_row`` of the named columns, score (0 to 1) and spans (start and stop
    in characters, probability), a row per row of ``docs``.  Null and empty texts have no
    spans and the score of a text without toxic words.  Nothing but the text is scored.
    """
    # at most the features of the fitted sample
    model = docs.sparkSession.sparkContext.broadcast(tagger)
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row")
    read = docs.select(row, text_column().alias("_text"))
    schema = T.StructType([read.schema["_row"], T.StructField("score", T.DoubleType()),
                           T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = model.value
        for batch in tidy(batches):
            for a, b in byte_slices(batch.column("_text"), BATCH_BYTES):
                texts = batch.column("_text").slice(a, b - a)
                words, p = tagger.tag(texts)
                marked = segment_sums(p >= 0.5, words.offsets) > 0
                spans = [[] for _ in range(b - a)]
                for i in np.flatnonzero(marked):
                    spans[i] = _spans(texts[i].as_py(), p[words.offsets[i]:words.offsets[i + 1]])
                yield pa.RecordBatch.from_arrays([
                    batch.column("_row").slice(a, b - a), pa.array(tagger.scores(p, words.offsets)),
                    pa.array(spans, pa.list_(pa.struct([
                        ("start", pa.int32()), ("stop", pa.int32()), ("probability", pa.float64())]))),
                ], ["_row", "score", "spans"])

    return read.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with its columns."""
    kept = tag(docs, fit(docs, labels), docs.columns).filter(F.col("score") < threshold)
    return kept.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
