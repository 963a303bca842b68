"""Quality rules: repetition and length, and bands of n-gram perplexity per language.

The n-grams are pairs of words (``word_grams``).  ``grams`` and ``KneserNey`` are a model of
characters folded to 128 symbols, which no query uses.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tannin.llm import word_grams
from tannin.llm.words import byte_slices, segment_sums, split_words, text_column, tidy
from tannin.sources import sinks

ORDER = 3
BITS = 7  # of a symbol
START, END = 10, 0
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
#: Half a band in robust standard deviations of log perplexity, and its least value.
WIDTH, LEAST = 5.0, 0.02
#: Log perplexities are ranked in steps of this size.
STEP = 0.0005
BATCH_BYTES = 4 << 20


def fold(code_points: np.ndarray) -> np.ndarray:
    """Symbols 0 to 127: ASCII as it is, control characters as space, others in 20 classes."""
    symbols = np.where(code_points < 128, code_points, 11 + code_points % 20)
    control = (code_points < 32) & (code_points != 10)
    return np.where(control, 32, symbols).astype(np.int32)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character and at the end of each text, as a number.

    Those of text i are codes[offsets[i]:offsets[i + 1]].
    """
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = "".join(texts.to_pylist())
    symbols = fold(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32))
    ends = np.cumsum(lengths)
    n, pad = len(lengths), ORDER - 1
    # a text stands after pad starts and before an end
    line = np.empty(len(symbols) + n * (pad + 1), np.int32)
    place = np.arange(len(symbols)) + np.repeat(np.arange(n) * (pad + 1) + pad, lengths)
    line[:] = START
    line[place] = symbols
    last = ends + np.arange(n) * (pad + 1) + pad
    line[last] = END
    code = line.copy()
    for back in range(1, ORDER):
        code[back:] |= line[:-back] << (BITS * back)
    kept = np.ones(len(line), bool)
    for back in range(pad):
        kept[last - lengths - 1 - back] = False
    return code[kept], np.concatenate([[0], ends + np.arange(1, n + 1)])


def mixed_hash(codes: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers, so different n-grams never share a hash."""
    x = codes.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class HashArray:
    """Numbers by key: keys as sorted hashes, values beside them."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        hashes = mixed_hash(keys)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], [v[order].astype(np.float64) for v in values]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Whether each key is there, and its values (0 where it is not)."""
        if not len(self.hashes):
            return np.zeros(len(keys), bool), *(np.zeros(len(keys)) for _ in self.values)
        hashes = mixed_hash(keys)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        there = self.hashes[at] == hashes
        return there, *(np.where(there, v[at], 0.0) for v in self.values)


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more; fixed ones where they are undefined."""
    n = [np.count_nonzero(counts == i) for i in (1, 2, 3, 4)]
    if not all(n[:3]):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    found = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1))])


@dataclass
class KneserNey:
    """Interpolated modified Kneser-Ney probabilities of order ``ORDER``.

    ``levels[k]`` has the (k + 1)-grams with their share without the lower order, and
    ``weights[k]`` the contexts of k symbols with the weight of the lower order.
    """

    levels: list[HashArray]
    weights: list[HashArray]

    @classmethod
    def of_counts(cls, codes: np.ndarray, counts: np.ndarray) -> KneserNey:
        levels, weights = [], []
        for k in range(ORDER, 0, -1):
            context = codes >> BITS
            d = discounts(counts)[np.minimum(counts, 3)]
            contexts, of = np.unique(context, return_inverse=True)
            total = np.bincount(of, counts, len(contexts))
            levels.insert(0, HashArray(codes, np.maximum(counts - d, 0) / total[of]))
            weights.insert(0, HashArray(contexts, np.bincount(of, d, len(contexts)) / total))
            # the next order counts the different symbols before its n-grams
            codes, counts = np.unique(codes & ((1 << BITS * (k - 1)) - 1), return_counts=True)
        return cls(levels, weights)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Probability of the last symbol of each n-gram after those before it."""
        p = np.full(len(codes), 1.0 / (1 << BITS))
        for k, (level, weight) in enumerate(zip(self.levels, self.weights), 1):
            own = codes & ((1 << BITS * k) - 1)
            _, share = level.find(own)
            known, rest = weight.find(own >> BITS)
            p = np.where(known, share + rest * p, p)
        return p


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tidy(batches):
        for start, stop in byte_slices(batch.column("_text"), BATCH_BYTES):
            yield batch.slice(start, stop - start)


def repeats(index: np.ndarray, doc: np.ndarray, size: int, window: int = 3) -> np.ndarray:
    """Whether each word lies in a window of words that its text has twice or more."""
    covered = np.zeros(len(index), bool)
    n = len(index) - window + 1
    if n < 2:
        return covered
    key = index[:n].astype(np.int64)
    for k in range(1, window):
        if size and int(key.max()) >= (1 << 62) // size:
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + index[k:n + k]
    inside = np.flatnonzero(doc[:n] == doc[window - 1:])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for k in range(window):
        covered[k:n + k] |= twice
    return covered


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of words, characters, symbols, repeated lines and repeated words per text."""
    words = split_words(texts)
    distinct, index = words.distinct()
    n_words = np.diff(words.offsets)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    chars = pc.utf8_length(words.words).to_numpy(zero_copy_only=False)
    lines = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    coded = lines.flatten().dictionary_encode()
    line = coded.indices.to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(n_words)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    with_word = np.diff(split_words(coded.dictionary).offsets) > 0
    kept = with_word[line]
    pairs = np.unique(of[kept] * max(1, len(with_word)) + line[kept]) // max(1, len(with_word))
    repeated = repeats(index, doc, len(distinct))
    return {
        "n_words": n_words,
        "word_chars": segment_sums(chars, words.offsets),
        "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False),
        "n_dup_lines": np.bincount(of[kept], minlength=len(n_words)) - np.bincount(pairs, minlength=len(n_words)),
        "n_repeat_words": segment_sums(repeated, words.offsets),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _scored(docs: DataFrame, model, apart: DataFrame) -> DataFrame:
    """Of every document the digest of its text, its language ``_of``, base counts and log_perplexity."""
    read = docs.select(F.col("lang").alias("_of"), text_column().alias("_text"))
    schema = T.StructType([T.StructField("_text_digest", T.BinaryType()), read.schema["_of"],
                           *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("_kept", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in _batches(batches):
            texts = batch.column("_text")
            kept, _ = known.kept(texts)
            counts = base_counts(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word_grams.digests(texts), pa.binary()), batch.column("_of"),
                 *(pa.array(counts[c], pa.int64()) for c in COUNTS), pa.array(kept)],
                ["_text_digest", "_of", *COUNTS, "_kept"])

    # every text has a row there
    joined = read.mapInArrow(score, schema).join(apart, F.col("_text_digest") == F.col("_digest"))
    mean = -(F.col("_kept") + F.col("_apart")) / (F.col("n_words") + 1)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return joined.select("_text_digest", "_of", *COUNTS, mean.alias("log_perplexity")).withColumn("base_failed", failed)


def _named(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns as struct ``_row``, language ``_of`` and the digest of the text."""
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row")
    read = docs.select(row, F.col("lang").alias("_of"), text_column().alias("_text"))
    schema = T.StructType([read.schema["_row"], read.schema["_of"], T.StructField("_digest", T.BinaryType())])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            digests = pa.array(word_grams.digests(batch.column("_text")), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_of"), digests], ["_row", "_of", "_digest"])

    return read.mapInArrow(name, schema)


def _middle(bins: DataFrame, value: str, n: str) -> DataFrame:
    """The lower median of ``value`` for each language, from counts of its values."""
    upto = F.sum(n).over(W.partitionBy("lang").orderBy(value))
    total = F.sum(n).over(W.partitionBy("lang"))
    ranked = bins.withColumn("_upto", upto).withColumn("_total", total)
    return ranked.filter(2 * F.col("_upto") >= F.col("_total")) \
        .groupBy("lang").agg(F.min(value).alias("middle"))


def bands(scored: DataFrame, width: float = WIDTH) -> DataFrame:
    """Lower and upper log perplexity of each language (lang, lower, upper).

    Around the median by ``width`` times the scaled median deviation, of the documents
    that pass the base rules.  Values are counted in steps of ``STEP`` first, so a language
    has a few thousand counts at most.  A null language is one of its own.
    """
    step = F.round(F.col("log_perplexity") / STEP).cast("long")
    bins = scored.filter(~F.col("base_failed")).select(F.col("_of").alias("lang"), step.alias("bin")) \
        .groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = sinks.materialize(bins)
    middle = _middle(bins, "bin", "n").withColumnRenamed("middle", "median")
    far = bins.join(middle.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang"))) \
        .groupBy("lang", "median", F.abs(F.col("bin") - F.col("median")).alias("far")) \
        .agg(F.sum("n").alias("n"))
    deviation = _middle(far, "far", "n")
    half = F.greatest(F.col("middle") * (1.4826 * STEP * width), F.lit(LEAST))
    return middle.select(F.col("lang").alias("_lang"), "median") \
        .join(deviation, F.col("_lang").eqNullSafe(F.col("lang"))) \
        .select("lang", (F.col("median") * STEP - half).alias("lower"),
                (F.col("median") * STEP + half).alias("upper"))


def judge(docs: DataFrame, columns: Sequence[str], width: float = WIDTH) -> DataFrame:
    """Quality of every document: struct ``_row`` of the named columns, counts and verdict.

    kept is false for documents that fail the base rules (fewer than 50 words, or over half
    of the words in repeated windows of three) and for those whose log perplexity per
    word (and end) lies outside the band of their language.  Null and empty texts have no words
    and fail.  Repeated rows count each.  The corpus is read for the model, for the counts and
    perplexities, which equal texts share, and for the rows; all but these are stored when this is
    called.
    """
    fitted, apart = word_grams.fit(docs.select(text_column().alias("_text")))
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    measured = sinks.store(_scored(docs, model, apart), "measured")
    limits = sinks.store(bands(measured, width).select(F.col("lang").alias("_lang"), "lower", "upper"), "bands")
    # equal texts have equal perplexities but for rounding
    values = [*COUNTS, "log_perplexity", "base_failed"]
    texts = measured.groupBy("_text_digest").agg(*(F.max(c).alias(c) for c in values))
    scored = _named(docs, columns).join(texts, F.col("_text_digest") == F.col("_digest")).select("_row", "_of", *values)
    # a row per language; broadcast if its stored size allows, and else hot ones are split
    joined = scored.join(limits, F.col("_of").eqNullSafe(F.col("_lang")), "left")
    inside = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return joined.withColumn("kept", F.coalesce(~F.col("base_failed") & inside, F.lit(False))) \
        .drop("_of", "_lang")


def good_documents(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns."""
    kept = judge(docs, docs.columns, width).filter("kept")
    return kept.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
