"""Log probabilities of whole texts by a modified Kneser-Ney model of word pairs.

Tokens are words and an end of text, contexts are words and the start.  A pair has an owner:
its context, or its word where the context is one of the ``TOP`` most frequent ones, so no
owner has more than a bounded share of the corpus.  Pairs of a frequent context and one of the
``STAYING`` most frequent words or the end are counts in one bounded matrix instead.

One pass packs the pairs of each block of documents by part of the owners, in which equal
pairs of all documents meet.  Counts of a context are then known in its part, those of the
frequent contexts are summed up for all.  How many contexts a word follows is summed in a
shuffle between the parts, and each part gets back the numbers of the words that it holds.
With these every part has the probabilities of its pairs and sums their logarithms by text.
Texts are named by 128-bit digests, since equal texts have equal probabilities.

What is stored is mostly names of words.  A name is the first bits of a word's 64-bit hash; a
pass before finds the words that share these, which get names of their own, and how many bits
leave only some of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tannin.llm.pitman_yor import (
    AGAIN, APART, MOST_DOCS, _bucketed, _counts, _distinct, _keys, _lists, _rows, _small, _stored, word_hash,
)
from tannin.llm.words import byte_slices, segment_sums, split_words, tidy

END = "\n"
TOP, STAYING = 4095, 255
BLOCK_BYTES = 16 << 20
#: Parts for each shuffle partition; the numbers of as many parts are summed together.
PARTS = 4
#: Sums by document that a task holds at most, about.
MOST_SUMS = 4_000_000
#: Bits of a name, and how many words may share theirs, about; more than ``GROUP_BITS``, by which words meet.
WIDTHS, MOST_SHARED, GROUP_BITS = (28, 32, 40, 48), 1 << 18, 20
#: Packing tasks for each core: each writes a file per bucket.
PACKING = 4


def digests(texts: pa.Array) -> list[bytes]:
    return [xxhash.xxh3_128_digest(t) for t in texts.cast(pa.binary()).to_pylist()]


def _tight(values: np.ndarray, kind: str) -> bytes:
    """Numbers compressed by the place of their bytes."""
    planes = np.ascontiguousarray(values, kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T.tobytes()
    return len(planes).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True) if planes else b""


def _loose(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def discounts_of(ones: float, twos: float, threes: float, fours: float) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more; fixed ones where they are undefined."""
    n = [ones, twos, threes, fours]
    if not all(n[:3]):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    found = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1))])


def _by_size(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [np.count_nonzero(counts == k) for k in (1, 2, 3, 4)]


def chains(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names, and of each token its name and the one before; the start is numbered after all names.

    The tokens of text i, the last one its end, are those from offsets[i] up to offsets[i + 1].
    """
    words = split_words(texts)
    distinct, index = words.distinct()
    names = distinct.to_pylist() + [END]
    token = np.insert(index.astype(np.int32), words.offsets[1:], len(names) - 1)
    offsets = words.offsets + np.arange(len(words.offsets))
    before = np.empty(len(token), np.int32)
    before[1:] = token[:-1]
    before[offsets[:-1]] = len(names)
    return names, token, before, offsets


@dataclass
class Frequent:
    """Slots of the most frequent words, from 1; the end and the start have the one after."""

    slots: dict[str, int]
    bits: int  # of the names of words
    shared: np.ndarray  # ascending hashes of the words that are numbered apart

    def __post_init__(self):
        self.last = len(self.slots) + 1
        self.staying = min(len(self.slots), STAYING)
        names = self.named(list(self.slots)) if self.slots else np.zeros(1, np.uint64)
        order = np.argsort(names)
        self.names, self.of_name = names[order], np.array(list(self.slots.values()) or [0])[order]

    def named(self, words: list[str]) -> np.ndarray:
        """The name of each word: first bits of its hash, or a number above all those."""
        hashes = np.array([word_hash(w) for w in words], np.uint64)
        names = hashes >> np.uint64(64 - self.bits)
        if len(self.shared):
            at = np.minimum(np.searchsorted(self.shared, hashes), len(self.shared) - 1)
            names = np.where(self.shared[at] == hashes, np.uint64(1 << self.bits) + at.astype(np.uint64), names)
        return names

    def of_names(self, names: list[str]) -> np.ndarray:
        """Slots of names and of the start, 0 for others."""
        return np.array([self.slots.get(w, 0) for w in names[:-1]] + [self.last] * 2, np.int32)

    def slots_of(self, names: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, self.of_name[at], 0)

    def stays(self, slot: np.ndarray) -> np.ndarray:
        return ((slot > 0) & (slot <= self.staying)) | (slot == self.last)

    def cell(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Place in the matrix: a row for the end and one for each staying word, a column per context."""
        return np.where(word == self.last, 0, word).astype(np.int64) * (self.last + 1) + before

    @property
    def cells(self) -> tuple[int, int]:
        return self.staying + 1, self.last + 1


def frequent_words(docs: DataFrame, top: int) -> Frequent:
    """About the most frequent words, and how words are named: no result depends on either, but for rounding.

    A block brings its ``2 * top`` most frequent words only, but the hashes of all.
    """
    groups = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most_shared = max(2, MOST_SHARED // groups)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for a, b in byte_slices(batch.column("_text"), BLOCK_BYTES):
                words, index = split_words(batch.column("_text").slice(a, b - a)).distinct()
                n = np.bincount(index, minlength=len(words))
                hashes = np.array([word_hash(w) for w in words.to_pylist()], np.uint64)
                to = ((hashes >> np.uint64(64 - GROUP_BITS)) % np.uint64(groups)).astype(np.int32)
                most = np.argsort(-n, kind="stable")[:2 * top]
                most = most[np.argsort(to[most], kind="stable")]
                order = np.lexsort((hashes, to))
                every = np.arange(groups + 1)
                cuts, offsets = np.searchsorted(to[order], every), np.searchsorted(to[most], every)
                hashes = hashes[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every[:-1].astype(np.int32)),
                     pa.array([_tight(np.diff(hashes[lo:hi], prepend=np.uint64(0)), "<u8") for lo, hi in zip(cuts, cuts[1:])], pa.binary()),
                     _lists(offsets, words.take(pa.array(most)), pa.string()), _lists(offsets, n[most], pa.int64())],
                    ["to", "hashes", "words", "n"])

    def meet(table: pa.Table) -> pa.Table:
        """The most frequent words of those that meet here, and for each width the hashes with the same first bits."""
        table = table.combine_chunks()
        hashes = np.unique(np.concatenate([
            np.cumsum(_loose(h, "<u8"), dtype=np.uint64) for h in table.column("hashes").to_pylist()]))
        shared = []
        for bits in WIDTHS:
            equal = np.diff(hashes >> np.uint64(64 - bits)) == 0
            same = hashes[np.append(equal, False) | np.insert(equal, 0, False)] if len(hashes) else hashes
            shared.append(same.astype("<u8").tobytes() if len(same) <= most_shared else None)
        counted = pa.table({c: table.column(c).combine_chunks().flatten() for c in ("words", "n")}) \
            .group_by("words").aggregate([("n", "sum")]).sort_by([("n_sum", "descending"), ("words", "ascending")]).slice(0, top)
        none = len(counted), len(WIDTHS)
        return pa.table({
            "word": pa.concat_arrays([counted.column("words").combine_chunks(), pa.nulls(none[1], pa.string())]),
            "n": pa.concat_arrays([counted.column("n_sum").combine_chunks(), pa.nulls(none[1], pa.int64())]),
            "bits": pa.concat_arrays([pa.nulls(none[0], pa.int32()), pa.array(WIDTHS, pa.int32())]),
            "shared": pa.concat_arrays([pa.nulls(none[0], pa.binary()), pa.array(shared, pa.binary())])})

    sent = docs.select("_text").mapInArrow(send, "to int, hashes binary, words array<string>, n array<long>")
    found = _stored(sent.groupBy("to").applyInArrow(meet, "word string, n long, bits int, shared binary"), "words")
    rows = found.filter("word is not null").orderBy(F.desc("n"), "word").limit(top).collect()
    # a bounded number: groups with too many leave them out, and the width with them
    widths = found.filter("bits is not null").groupBy("bits") \
        .agg(F.collect_list("shared").alias("shared"), F.count(F.lit(1)).alias("groups")) \
        .filter(F.size("shared") == F.col("groups")).orderBy("bits").limit(1).collect()
    bits = widths[0]["bits"] if widths else 64
    shared = np.sort(np.frombuffer(b"".join(widths[0]["shared"]) if widths else b"", "<u8"))
    return Frequent({r["word"]: k for k, r in enumerate(rows, 1)}, bits, shared)


_FIELDS = ("owners", "sizes", "other", "rare", "place", "count", "more")
_PACKED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("follows", pa.bool_()), *((f, pa.binary()) for f in _FIELDS)])
_PACKED_SQL = "part int, block long, follows boolean, " + ", ".join(f"{f} binary" for f in _FIELDS)


def _pack(docs: DataFrame, frequent: Frequent, parts: int) -> DataFrame:
    """A row per block, part and kind of owner: where ``follows``, the owner is the word after.

    An entry is (owner, other word, document of the block, count).  Others that are frequent
    are slots, the rest names in ``rare``, one for each run of entries of the same pair.  Rows
    below 0 have the digests of a block's texts, or of a task the counts of the matrix.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number, matrix = task << 32, np.zeros(np.prod(frequent.cells), np.int64)
        aside = -1 - task % parts
        for batch in tidy(batches):
            for a, b in byte_slices(batch.column("_text"), BLOCK_BYTES):
                for at in range(a, b, MOST_DOCS):
                    texts = batch.column("_text").slice(at, min(b - at, MOST_DOCS))
                    yield from block(texts, number, aside, matrix)
                    number += 1
        some = np.flatnonzero(matrix)
        yield pa.RecordBatch.from_pylist([{
            "part": aside, "block": -1, "owners": some.astype("<u4").tobytes(), "count": matrix[some].astype("<u8").tobytes()}],
            _PACKED)

    def block(texts: pa.Array, number: int, aside: int, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        # long texts first: most entries then have small numbers, which compress better
        texts = texts.take(pa.array(np.argsort(-pc.binary_length(texts).to_numpy(zero_copy_only=False), kind="stable")))
        yield pa.RecordBatch.from_pylist([{"part": aside, "block": number, "owners": b"".join(digests(texts))}], _PACKED)
        names, token, before, offsets = chains(texts)
        n, slot = len(texts), frequent.of_names(names)
        named = frequent.named(names)
        own = (named % np.uint64(parts)).astype(np.int64)
        by_own = np.lexsort((named, own))
        rank = np.empty(len(names), np.int32)
        rank[by_own] = np.arange(len(names))
        place = np.repeat(np.arange(n, dtype=np.uint16), np.diff(offsets))
        # others that are not frequent are numbered after the slots
        code = np.where(slot > 0, slot, frequent.last + 1 + np.arange(len(slot))).astype(np.int32)
        known, stays = (slot > 0)[before], frequent.stays(slot)[token]
        both = known & stays
        matrix += np.bincount(frequent.cell(slot[token[both]], slot[before[both]]), minlength=len(matrix))
        width = frequent.last + 1 + len(slot)
        for follows, some in ((False, ~known), (True, known & ~stays)):
            owner, other = (token, before) if follows else (before, token)
            keys, counts = _distinct(_keys(rank[owner[some]], code[other[some]], place[some], width, n))
            at = (keys % n).astype(np.uint16)
            keys //= n
            first = np.diff(keys, prepend=-1) != 0
            held, others = (keys // width).astype(np.int32), (keys % width).astype(np.int32)
            del keys
            apart = others > frequent.last
            heads = np.flatnonzero(first & apart)
            rare = named[others[heads] - frequent.last - 1]
            others[apart] = AGAIN
            others[heads] = APART
            cuts = np.flatnonzero(np.diff(own[by_own[held]], prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(held)]):
                which, size = np.unique(held[lo:hi], return_counts=True)
                which = by_own[which]
                small, more = _small(counts[lo:hi])
                yield pa.RecordBatch.from_pylist([{
                    "part": int(own[which[0]]), "block": number, "follows": follows,
                    "owners": _tight(np.diff(named[which] // np.uint64(parts), prepend=np.uint64(0)), "<u8"),
                    "sizes": _tight(size, "<u4"), "other": _tight(others[lo:hi], "<u2"), "place": _tight(at[lo:hi], "<u2"),
                    "rare": _tight(rare[slice(*np.searchsorted(heads, (lo, hi)))], "<u8"),
                    "count": _tight(np.frombuffer(small, np.uint8), "u1"), "more": more}], _PACKED)

    return docs.select("_text").mapInArrow(run, _PACKED_SQL)


class Pairs:
    """Different pairs of the rows of a part with one kind of owner, and their entries."""

    def __init__(self, rows: list[dict], number: int, last: int, parts: int):
        none = [np.zeros(0, np.uint64)]
        owners = [np.cumsum(_loose(r["owners"], "<u8"), dtype=np.uint64) * np.uint64(parts) + np.uint64(number) for r in rows]
        rare = [_loose(r["rare"], "<u8") for r in rows]
        self.owners = np.unique(np.concatenate(none + owners))
        self.rare = np.unique(np.concatenate(none + rare))
        keys, counts, self.entries = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for r, owned, named in zip(rows, owners, rare):
            owner = np.repeat(np.searchsorted(self.owners, owned), _loose(r["sizes"], "<u4"))
            other = _loose(r["other"], "<u2").astype(np.int64)
            which = np.cumsum(other == APART) - 1
            apart = (other == APART) | (other == AGAIN)
            if apart.any():
                other[apart] = last + 1 + np.searchsorted(self.rare, named)[which[apart]]
            key, count = owner << 32 | other, _counts(_loose(r["count"], "u1").tobytes(), r["more"])
            first = np.flatnonzero(np.diff(key, prepend=-1))
            keys.append(key[first])
            counts.append(np.add.reduceat(count, first))
            self.entries.append((r["block"], np.diff(first, append=len(key)).astype(np.int32), _loose(r["place"], "<u2"), count))
        every, self.at = np.unique(np.concatenate(keys), return_inverse=True)
        self.owner, self.other = every >> 32, every & 0xFFFFFFFF
        self.counts = np.bincount(self.at, np.concatenate(counts), len(every)).astype(np.int64)

    def sums(self, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """By block the sums of the values of its documents' pairs."""
        upto = 0
        for block, runs, place, count in self.entries:
            of = np.repeat(values[self.at[upto:upto + len(runs)]], runs)
            upto += len(runs)
            yield block, np.bincount(place, of * count)


class Part:
    """All pairs of a part: after its own contexts, and its own words after frequent contexts."""

    def __init__(self, row: dict, frequent: Frequent, parts: int):
        last, rows = frequent.last, sorted(row["rows"], key=lambda r: r["block"])
        self.after, self.follows = (
            Pairs([r for r in rows if r["follows"] == kind], row["part"], last, parts) for kind in (False, True))
        self.slot = frequent.slots_of(self.follows.owners)
        own = self.follows.owners[self.slot == 0]
        names = np.unique(np.concatenate([self.after.rare, own]))
        order = np.lexsort((names, self.to(names, parts)))
        self.names = names[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = lambda some: rank[np.searchsorted(names, some)]
        # words numbered by slot, then as in ``names``
        self.word_after = np.concatenate([np.arange(last + 1), last + 1 + place(self.after.rare)])[self.after.other]
        words = self.slot.astype(np.int64)
        words[self.slot == 0] = last + 1 + place(own)
        self.word_follows = words[self.follows.owner]
        #: How many contexts here each word follows.
        size = last + 1 + len(self.names)
        self.contexts = np.bincount(self.word_after, minlength=size) + np.bincount(self.word_follows, minlength=size)

    @staticmethod
    def to(names: np.ndarray, parts: int) -> np.ndarray:
        return (names % np.uint64(parts) // np.uint64(PARTS)).astype(np.int32)


def context_sums(context: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Of each context its tokens, and the pairs seen once, twice and more often."""
    kind = np.minimum(counts, 3)
    return np.stack([np.bincount(context, counts, size), *(np.bincount(context[kind == k], minlength=size) for k in (1, 2, 3))])


def pair_probabilities(counts: np.ndarray, context: np.ndarray, sums: np.ndarray, discounts: np.ndarray,
                       lower: np.ndarray) -> np.ndarray:
    """Of each pair, given the sums of its context and the probability of its word in the lower order."""
    total = np.maximum(sums[0], 1)
    rest = (discounts[1:, None] * sums[1:]).sum(axis=0) / total
    return (counts - discounts[np.minimum(counts, 3)]) / total[context] + rest[context] * lower


@dataclass
class Model:
    """What all parts share."""

    frequent: Frequent
    sums: np.ndarray  # of the frequent contexts
    discounts: np.ndarray
    lower_discounts: np.ndarray
    follows: np.ndarray  # contexts before each frequent word
    pairs: int  # different pairs
    words: int  # different words that follow, the end among them
    lower_rest: float
    matrix: np.ndarray

    def lower(self, contexts: np.ndarray) -> np.ndarray:
        """Probability of a word that follows so many contexts."""
        return (contexts - self.lower_discounts[np.minimum(contexts, 3)]) / self.pairs + self.lower_rest / self.words

    def log_matrix(self) -> np.ndarray:
        """log10 probabilities of staying words after frequent contexts, 0 where a pair does not occur."""
        rows, columns = self.frequent.cells
        word, before = np.divmod(np.flatnonzero(self.matrix), columns)
        slot = np.where(word == 0, self.frequent.last, word)
        counts = self.matrix[self.matrix > 0]
        found = np.zeros(rows * columns)
        found[self.matrix > 0] = np.log10(pair_probabilities(
            counts, before, self.sums, self.discounts, self.lower(self.follows[slot])))
        return found

    def kept(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sum over the tokens of each text whose pairs are in the matrix, and its number of tokens."""
        names, token, before, offsets = chains(texts)
        slot = self.frequent.of_names(names)
        both = (slot > 0)[before] & self.frequent.stays(slot)[token]
        if not hasattr(self, "_log"):
            self._log = self.log_matrix()
        values = np.zeros(len(token))
        values[both] = self._log[self.frequent.cell(slot[token[both]], slot[before[both]])]
        return segment_sums(values, offsets), np.diff(offsets)


def _sums(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int64()), pa.array([v.astype("<f8").tobytes() for v in held.values()], pa.binary())], ["block", "sums"])


def fit(docs: DataFrame, top: int = TOP, parts: int | None = None) -> tuple[Model, DataFrame]:
    """The model of all texts of ``_text``, and by digest the sums of log10 probabilities that are not of its matrix."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or PARTS * partitions
    frequent = frequent_words(docs, top)
    last, size = frequent.last, frequent.last + 1
    # stored by part as it is written: a shuffle would hold all of it a second time
    few = docs.coalesce(PACKING * spark.sparkContext.defaultParallelism)
    packed = _bucketed(_pack(few, frequent, parts), partitions)
    inside = packed.filter("part >= 0").groupBy("part").agg(F.collect_list(F.struct("block", "follows", *_FIELDS)).alias("rows"))
    alone = packed.filter("part < 0")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["owners"], "<u4").astype(np.int64)),
                                              pa.array(np.frombuffer(row["count"], "<u8").astype(np.int64))], ["cell", "n"])

    summed = alone.filter("block < 0").mapInArrow(cells, "cell long, n long") \
        .groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # a bounded number
    matrix = np.zeros(np.prod(frequent.cells), np.int64)
    matrix[summed.column("cell").to_numpy()] = summed.column("n").to_numpy()

    sent_schema = pa.schema([("value", pa.list_(pa.float64())), ("to", pa.int32()), ("part", pa.int32()),
                             ("names", pa.binary()), ("n", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(5 * size + 4)
        for row in _rows(batches):
            part = Part(row, frequent, parts)
            total[:4 * size] += context_sums(part.follows.other, part.follows.counts, size).ravel()
            total[4 * size:5 * size] += part.contexts[:size]
            total[5 * size:] += np.add(_by_size(part.after.counts), _by_size(part.follows.counts))
            to = Part.to(part.names, parts)
            cuts = np.flatnonzero(np.diff(to, prepend=-1))
            k, each = len(cuts), [slice(*ends) for ends in zip(cuts, [*cuts[1:], len(to)])]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.list_(pa.float64())), pa.array(to[cuts]), pa.array(np.full(k, row["part"], np.int32)),
                 pa.array([_tight(np.diff(part.names[some], prepend=np.uint64(0)), "<u8") for some in each], pa.binary()),
                 pa.array([_tight(part.contexts[size:][some], "<u4") for some in each], pa.binary())], schema=sent_schema)
        yield pa.RecordBatch.from_pylist([{"value": total}], sent_schema)

    sent = _stored(inside.mapInArrow(count, "value array<double>, to int, part int, names binary, n binary"), "sent")

    def add(table: pa.Table) -> pa.Table:
        values = table.column("value").combine_chunks().flatten().to_numpy().reshape(len(table), -1).sum(axis=0)
        return pa.table({"value": _lists(np.array([0, len(values)]), values, pa.float64())})

    def gather(table: pa.Table) -> pa.Table:
        """To each part the numbers of its words; once for all how many words follow 1, 2, 3, 4 and any contexts."""
        table = table.combine_chunks()
        names = [np.cumsum(_loose(v, "<u8"), dtype=np.uint64) for v in table.column("names").to_pylist()]
        keys, at = np.unique(np.concatenate(names), return_inverse=True)
        counts = np.concatenate([_loose(v, "<u4") for v in table.column("n").to_pylist()])
        found = np.bincount(at, counts, len(keys)).astype(np.int64)
        ends = np.cumsum([0, *map(len, names)])
        sizes = [*_by_size(found), len(found), np.count_nonzero(found > 2), found.sum()]
        return pa.table({
            "part": pa.concat_arrays([table.column("part").combine_chunks(), pa.array([-1], pa.int32())]),
            "to": pa.array([table.column("to")[0].as_py()] * (len(table) + 1), pa.int32()),
            "n": pa.array([*(_tight(found[at[a:b]], "<u4") for a, b in zip(ends, ends[1:])), None], pa.binary()),
            "sizes": pa.array([*[None] * len(table), sizes], pa.list_(pa.int64()))})

    met = _stored(sent.filter("to is not null").groupBy("to").applyInArrow(
        gather, "part int, to int, n binary, sizes array<long>"), "met")
    sizes = np.array([v or 0 for v in met.filter("part < 0").select(*(F.sum(F.get("sizes", F.lit(k))) for k in range(7))).first()])
    totals = sent.filter("value is not null").withColumn("all", F.lit(0)).groupBy("all") \
        .applyInArrow(add, "value array<double>").collect()
    totals = np.array(totals[0]["value"] if totals else np.zeros(5 * size + 4))

    # those of the matrix
    word, before = np.divmod(np.flatnonzero(matrix), size)
    counts = matrix[matrix > 0]
    sums = totals[:4 * size].reshape(4, size) + context_sums(before, counts, size)
    follows = totals[4 * size:5 * size].astype(np.int64) + np.bincount(np.where(word == 0, last, word), minlength=size)
    there = follows[follows > 0]
    lower_sizes = sizes[:4] + _by_size(there)
    words, more = int(sizes[4]) + len(there), int(sizes[5]) + np.count_nonzero(there > 2)
    lower = discounts_of(*lower_sizes)
    by_size = totals[5 * size:] + _by_size(counts)

    # as many contexts as all words follow together
    pairs = int(sizes[6]) + int(follows.sum())
    model = Model(frequent, sums, discounts_of(*by_size), lower, follows, max(1, pairs), max(1, words),
                  float(lower[1] * lower_sizes[0] + lower[2] * lower_sizes[1] + lower[3] * more) / max(1, pairs), matrix)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held: dict[int, np.ndarray] = {}
        for row in _rows(batches):
            part, numbers = Part(row, frequent, parts), [_loose(n, "<u4").astype(np.int64) for n in row["numbers"] or ()]
            lower = known.lower(np.concatenate([known.follows, *numbers]))
            own = part.after
            for pairs, context, sums, word in (
                    (own, own.owner, context_sums(own.owner, own.counts, len(own.owners)), part.word_after),
                    (part.follows, part.follows.other, known.sums, part.word_follows)):
                p = pair_probabilities(pairs.counts, context, sums, known.discounts, lower[word])
                for block, values in pairs.sums(np.log10(p)):
                    had = held.get(block, values[:0])
                    some, more = sorted((had, values), key=len)
                    held[block] = more
                    more[:len(some)] += some
            # a task's parts are added up before they are handed on
            if sum(map(len, held.values())) > MOST_SUMS:
                yield _sums(held)
                held = {}
        yield _sums(held)

    listed = met.filter("part >= 0").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("to", "n"))).alias("met")) \
        .select("part", F.col("met.n").alias("numbers"))
    scored = inside.join(listed.hint("shuffle_hash"), "part", "left").mapInArrow(score, "block long, sums binary")

    def named(digest: pa.Table, found: pa.Table) -> pa.Table:
        """The texts of one block."""
        texts = digest.column("owners")[0].as_py()
        total = np.zeros(len(texts) // 16)
        for sums in sorted(found.column("sums").to_pylist()):
            total[:len(sums) // 8] += np.frombuffer(sums, "<f8")
        return pa.table({"_digest": pa.array([texts[k:k + 16] for k in range(0, len(texts), 16)], pa.binary()), "_apart": total})

    blocks = alone.filter("block >= 0").select("block", "owners").groupBy("block")
    by_text = blocks.cogroup(scored.groupBy("block")).applyInArrow(named, "_digest binary, _apart double")
    # equal texts have equal sums but for the order of their terms
    return model, _stored(by_text.groupBy("_digest").agg(F.max("_apart").alias("_apart")), "log_probabilities")
