"""Scores of texts by a hierarchical Pitman-Yor language model.

Tokens are words and an end of text.  Every previous token (all words and the start of a
text) has a restaurant, whose parent is the root restaurant of all words.  The root's own
base is uniform over the V training words and one unknown word.

One pass packs the tokens of each block of documents by parts of the vocabulary, so all
that concerns a word meets in one part.  The contexts' own words and the end token, which
would make a part as large as the corpus, stay with their documents: their counts after
each context are one bounded matrix.  Each round samples the seatings of all words part by
part and of the matrix row by row: dishes are independent given the numbers of tables of
the restaurants, which are summed up between the rounds.  Those of the ``contexts`` most
frequent words and of the start are known to every part.  Those of all other contexts, the
contexts apart, are summed in a shuffle, and each part gets back those that it holds; what
the staying words have after them lies in parts by context.  The last pass samples the same
seatings as the round before, whose sums are then known, so the probabilities after a context
sum to one; it averages them over the samples and returns sums per document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tannin.llm.words import byte_slices, split_words, text_column, tidy
from tannin.sources import sinks

#: The end of a text as a token; no word holds this character.
END = "\n"
CONTEXTS = 4095
#: The most frequent words whose tokens stay with their documents, at most.
STAYING = 255
ROUNDS, BURN_IN, SAMPLES = 2, 2, 3
STRENGTH = 1.0
BLOCK_BYTES = 8 << 20
#: Documents of a block are numbered in two bytes.
MOST_DOCS = (1 << 16) - 1
SEED = 42
#: In place of a frequent previous token: one of the contexts apart, and the same once more.
APART, AGAIN = 0, (1 << 16) - 1
#: Rows of a packed block that are handed on together.
LOT = 32
#: Parts for each shuffle partition; the contexts of as many parts are summed together.
PARTS = 4
#: Of dishes up to so many customers the number of tables is drawn exactly.
SMALL = 1024
#: Numbers in a matrix of such draws.
CELLS = 1 << 18
#: So many dishes are drawn one number of tables after another.
MANY = 2048
#: Documents whose sums a task holds at most, about.
MOST_HELD = 1_000_000


# --- seatings ---------------------------------------------------------------

_STEPS: dict[float, np.ndarray] = {}


def log_ways(discount: float) -> np.ndarray:
    """log S(c, t): weight of all seatings of c customers at t tables, for c up to ``SMALL``.

    S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t), the generalised Stirling numbers.
    """
    found = np.full((SMALL + 1, SMALL + 1), -np.inf)
    found[1, 1] = 0.0
    t = np.arange(1, SMALL + 1)
    for c in range(1, SMALL):
        joins = np.where(t <= c, np.log(np.maximum(c - t * discount, 1e-300)), -np.inf)
        found[c + 1, 1:] = np.logaddexp(found[c, :-1], joins + found[c, 1:])
    return found


def steps(discount: float) -> np.ndarray:
    """S(c, t + 1) / S(c, t) in row c, column t - 1; 0 from t = c on."""
    found = _STEPS.get(discount)
    if found is None:
        ways = log_ways(discount)
        found = np.zeros((SMALL + 1, SMALL))
        for c in range(2, SMALL + 1):
            found[c, :c - 1] = np.exp(np.diff(ways[c, 1:c + 1]))
        _STEPS[discount] = found
    return found


def pick_tables(customers: np.ndarray, weight: np.ndarray, discount: float, random: np.ndarray) -> np.ndarray:
    """Numbers t of tables, with probabilities proportional to w^t S(c, t), at uniform ``random`` numbers.

    ``customers`` are ascending, from 2 to ``SMALL``.  Dishes of like numbers are drawn
    together: in a matrix with a row for each, or, if they are many, one t after another.
    """
    picked = np.ones(len(customers), np.int64)
    step = steps(discount)
    at = 0
    while at < len(customers):
        # a quarter more columns than the first of them needs, at most
        most = min(int(customers[at]) * 5 // 4, SMALL)
        stop = min(int(np.searchsorted(customers, most, "right")), at + max(1, CELLS // most))
        c, w, u = customers[at:stop], weight[at:stop], random[at:stop]
        wide = int(c[-1]) - 1
        if stop - at >= MANY:
            single = c[0] == c[-1]
            mass, sums = np.ones(len(c)), np.empty((wide + 1, len(c)))
            sums[0] = 1.0
            with np.errstate(over="ignore", invalid="ignore"):
                for t in range(wide):
                    mass *= w
                    mass *= step[c[0], t] if single else step[c, t]
                    np.add(sums[t], mass, out=sums[t + 1])
                u = u * sums[-1]
            total = sums[-1]
            picked[at:stop] += np.count_nonzero(sums[:-1] <= u, axis=0) if wide > 8 else sum(sums[t] <= u for t in range(wide))
        else:
            rows = step[c, :wide] * w[:, None]
            with np.errstate(over="ignore", invalid="ignore"):
                sums = np.cumprod(rows, axis=1)
                np.cumsum(sums, axis=1, out=sums)
                total = 1 + sums[:, -1]
                u = u * total
                picked[at:stop] += (u >= 1) + (sums[:, :-1] <= (u - 1)[:, None]).sum(axis=1)
        for k in np.flatnonzero(~np.isfinite(total)):
            # masses beyond the range of doubles
            mass = np.cumsum(np.log(step[c[k], :c[k] - 1] * w[k]))
            mass = np.append(0.0, mass)
            mass = np.exp(mass - mass.max()).cumsum()
            picked[at + k] = 1 + np.count_nonzero(mass <= random[at + k] * mass[-1])
        at = stop
    return picked


class Seating:
    """Numbers of tables of many dishes, each with its own customers and weight of a new table.

    Dishes of one customer have one table.  Of dishes up to ``SMALL`` customers the number
    of tables is drawn at once from its conditional distribution given the weight w, which
    is proportional to w^t S(c, t).  Larger ones keep the sizes of their tables and move
    their customers in lots of a few hundredths, within which the numbers of tables are
    held fixed.
    """

    def __init__(self, customers: np.ndarray, discount: float, random: np.random.Generator):
        self.customers, self.discount, self.random = customers, discount, random
        self.tables = (customers > 0).astype(np.int64)
        small = np.flatnonzero((customers > 1) & (customers <= SMALL))
        self.small = small[np.argsort(customers[small], kind="stable")]
        self.large = np.flatnonzero(customers > SMALL)
        self.sizes = {int(i): np.zeros(0, np.int64) for i in self.large}

    def seat(self, weight: np.ndarray, swept: bool = False) -> None:
        """Seat all customers; ``weight`` is that of a new table.

        With ``swept`` a sweep follows, so of dishes up to ``SMALL`` only the random numbers are drawn.
        """
        if swept:
            self.random.random(len(self.small))
        else:
            self._draw(weight)
        self._seat_large(weight)
        self._count()

    def _draw(self, weight: np.ndarray) -> None:
        self.tables[self.small] = pick_tables(
            self.customers[self.small], weight[self.small], self.discount, self.random.random(len(self.small)))

    def _seat_large(self, weight: np.ndarray) -> None:
        """Seat the large dishes together, in rows of a matrix; full ones leave it."""
        order = self.large[np.argsort(-self.customers[self.large], kind="stable")]
        customers, weight = self.customers[order], weight[order]
        sizes = np.zeros((len(order), 8), np.int64)
        sizes[:, 0] = 1
        seated = 1
        while len(sizes):
            step = max(1, seated // 16)
            lot = np.minimum(customers - seated, step)
            held = np.where(sizes > 0, sizes - self.discount, 0.0)
            taken = held.sum(axis=1)
            new = self.random.binomial(lot, weight / (weight + taken))
            sizes += self.random.multinomial(lot - new, held / taken[:, None])
            free = sizes == 0
            lack = int((new - free.sum(axis=1)).max())
            if lack > 0:
                sizes = np.pad(sizes, ((0, 0), (0, max(lack, sizes.shape[1] // 2))))
                free = sizes == 0
            sizes += free & (np.cumsum(free, axis=1) <= new[:, None])
            seated += step
            left = int(np.count_nonzero(customers > seated))
            for row in range(left, len(sizes)):
                self.sizes[int(order[row])] = sizes[row][sizes[row] > 0]
            sizes, customers, weight = sizes[:left], customers[:left], weight[:left]

    def sweep(self, weight: np.ndarray) -> None:
        """Seat customers again given all others."""
        self._draw(weight)
        for i in self.large:
            sizes = self.sizes[int(i)]
            away = self.random.multivariate_hypergeometric(
                sizes, int(self.customers[i]) // 8, method="marginals")
            rest = sizes - away
            self.sizes[int(i)] = self._add_lots(rest[rest > 0], int(away.sum()), weight[i])
        self._count()

    def _count(self) -> None:
        for i in self.large:
            self.tables[i] = len(self.sizes[int(i)])

    def _add_lots(self, sizes: np.ndarray, customers: int, weight: float) -> np.ndarray:
        while customers:
            seated = int(sizes.sum())
            lot = min(customers, max(1, seated // 16))
            taken = seated - self.discount * len(sizes)
            new = self.random.binomial(lot, weight / (weight + taken))
            if lot > new:
                shares = sizes - self.discount
                sizes = sizes + self.random.multinomial(lot - new, shares / shares.sum())
            sizes = np.concatenate([sizes, np.ones(new, np.int64)])
            customers -= lot
        return sizes


# --- packed tokens ----------------------------------------------------------

#: Spark removes the shuffle files of a query when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned and run within go at its end; only its result is read on."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Like ``sinks.store``; small numbers in bytes are worth a stronger compression."""
    path = sinks.scratch_path(df.sparkSession, label)
    with _shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, as each may hold megabytes; lists named met_ as arrays."""
    for batch in tidy(batches):
        met = [c for c in batch.schema.names if c.startswith("met_")]
        plain = batch.select([c for c in batch.schema.names if c not in met])
        for k in range(len(batch)):
            yield plain.slice(k, 1).to_pylist()[0] | {
                c: batch.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False) for c in met}


def word_hash(word: str | bytes) -> int:
    """64 bits that name a word in other parts; the remainder by the parts is its own part."""
    return xxhash.xxh64_intdigest(word, SEED)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))


def train_row(doc_id: Column) -> Column:
    """Whether a document is learned from: crc32 of its id mod 5 is not 1; null ids are."""
    return ~F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, of bounded bytes and documents."""
    for a, b in byte_slices(batch.column("text"), BLOCK_BYTES):
        for at in range(a, b, MOST_DOCS):
            yield batch.slice(at, min(b - at, MOST_DOCS))


def word_counts(docs: DataFrame) -> DataFrame:
    """All words of the training rows with their counts: word, n."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for block in _blocks(batch):
                words, index = split_words(pc.ascii_lower(block.column("text"))).distinct()
                n = np.bincount(index, minlength=len(words))
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], ["word", "n"])

    counted = docs.filter("train").select("text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _small(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as a byte each, and those above 254 as (place, count) apart."""
    large = np.flatnonzero(counts > 254)
    apart = np.stack([large, counts[large]], axis=1).astype("<u4") if len(large) else np.zeros(0, "<u4")
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), apart.tobytes()


def _counts(small: bytes, apart: bytes) -> np.ndarray:
    counts = np.frombuffer(small, np.uint8).astype(np.int64)
    if apart:
        place, count = np.frombuffer(apart, "<u4").reshape(-1, 2).T
        counts[place] = count
    return counts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like ``np.unique`` with counts, sorting in place: ``keys`` may be as long as a block."""
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys)).astype(np.int32)


def _keys(high: np.ndarray, middle: np.ndarray, low: np.ndarray, width: int, n: int) -> np.ndarray:
    """(high * width + middle) * n + low in one array."""
    keys = high.astype(np.int64)
    keys *= width
    keys += middle
    keys *= n
    keys += low
    return keys


_PACKED = pa.schema([
    ("part", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("sizes", pa.binary()),
    ("before", pa.binary()), ("rare", pa.binary()), ("place", pa.binary()), ("count", pa.binary()), ("more", pa.binary()),
    ("n_trained", pa.int32()), ("lengths", pa.binary())])
_PACKED_SQL = "part int, block long, words binary, sizes binary, before binary, rare binary, place binary, count binary, " \
    "more binary, n_trained int, lengths binary"


def _pack(docs: DataFrame, frequent: list[str], parts: int) -> DataFrame:
    """Rows of a block's entries: one per part of the vocabulary, and one below 0 with what stays.

    An entry is (word, previous token, document of the block, count); documents are numbered
    from 0, those that are learned from first.  The row of ``words`` has the number of
    entries of each in ``sizes``.  The contexts apart are in ``rare`` by their hashes, one for
    each run of entries with the same word.  The row below 0 has slots in place of words, the
    ids of the documents in their order and their ``lengths``.  Rows from ``parts`` on hold the
    words that stay after contexts apart: hashes of the contexts in place of words, and slots
    of the words in place of the previous tokens.
    """
    known = pa.array([w.encode() for w in frequent], pa.large_binary())  # slots from 1 on; 0: a context apart
    start = len(frequent) + 1
    end = min(len(frequent), STAYING) + 1  # the slots of words that stay end with that of the end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in tidy(batches):
            for block in _blocks(batch):
                train = np.asarray(block.column("train").to_numpy(zero_copy_only=False), bool)
                order = np.argsort(~train, kind="stable")
                n = len(train)
                place_of = np.empty(n, np.int64)
                place_of[order] = np.arange(n)
                # what is as long as the tokens of a block is kept in few bytes, and no longer than needed
                words = split_words(pc.ascii_lower(block.column("text")))
                offsets = words.offsets
                distinct, index = words.distinct()
                names = pa.concat_arrays([distinct, pa.array([END], distinct.type)]).cast(pa.large_binary())
                # each text with its end
                token = np.insert(index.astype(np.int32), offsets[1:], len(names) - 1)
                place = np.repeat(place_of.astype(np.uint16), np.diff(offsets) + 1)
                slot = pc.fill_null(pc.index_in(names, known), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                del words, distinct, index
                pa.default_memory_pool().release_unused()
                hashes = word_hashes(names.to_pylist())
                own = (hashes % np.uint64(parts)).astype(np.int64)
                # contexts apart are numbered after the start, as the words of the block
                code = np.where(slot > 0, slot, start + 1 + np.arange(len(names))).astype(np.int32)
                before = np.empty(len(token), np.int32)
                before[1:] = code[token[:-1]]
                before[offsets[:-1] + np.arange(n)] = start
                slot = np.where(slot < end, slot, 0)
                slot[-1] = end
                common = {"block": number, "n_trained": int(train.sum())}

                def row(part, named, size, previous, rare, place, counts, common=common, **more):
                    return common | {
                        "part": part, "words": named, "sizes": size.astype("<u4").tobytes(),
                        "before": previous.astype("<u2").tobytes(), "rare": rare.tobytes(),
                        "place": place.astype("<u2").tobytes(), **dict(zip(("count", "more"), _small(counts)))} | more

                # words by part, those that stay first
                part = np.where(slot > 0, -1, own)
                by_part = np.argsort(part, kind="stable")
                rank = np.empty(len(names), np.int32)
                rank[by_part] = np.arange(len(names))
                width = start + 1 + len(names)
                aside = (slot > 0)[token]
                aside &= before > start
                apart = tuple(values[aside] for values in (before, token, place))
                np.logical_not(aside, out=aside)
                token, before, place = token[aside], before[aside], place[aside]
                del aside
                runs, counts = _distinct(_keys(rank[token], before, place, width, n))
                del token, before, place
                at = (runs % n).astype(np.uint16)
                runs //= n
                first = np.diff(runs, prepend=-1) != 0
                held, previous = (runs // width).astype(np.int32), (runs % width).astype(np.int32)
                del runs
                other = previous > start
                heads = np.flatnonzero(first & other)
                rare = hashes[previous[heads] - start - 1]
                previous[other] = AGAIN
                previous[heads] = APART
                del first, other
                # the first row is of what stays, be it nothing
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(part[by_part[held]], prepend=-1))])
                lengths = np.diff(offsets)[order] + 1
                schema = _PACKED.append(pa.field("doc_ids", pa.list_(block.schema.field("doc_id").type)))
                lot: list[dict] = []
                # entries are in the order of words, so those of a word are one run
                heads_of = np.flatnonzero(np.diff(held, prepend=-1))
                named = by_part[held[heads_of]]
                sizes = np.diff(heads_of, append=len(held))
                upto = np.searchsorted(heads_of, [*cuts, len(held)])
                spelled = pc.binary_join(
                    pa.ListArray.from_arrays(pa.array(upto[1:] - upto[1], pa.int32()), names.take(pa.array(named[upto[1]:]))),
                    pa.scalar(b" ", names.type)).to_pylist()
                for k, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(held)])):
                    which, size = named[upto[k]:upto[k + 1]], sizes[upto[k]:upto[k + 1]]
                    stays = k == 0
                    some = slice(*np.searchsorted(heads, (lo, hi)))
                    lot.append(row(
                        -1 - number % (1 << 32) % parts if stays else int(part[which[0]]),
                        slot[which].astype("<u2").tobytes() if stays else spelled[k - 1],
                        size, previous[lo:hi], rare[some], at[lo:hi], counts[lo:hi],
                        lengths=lengths.astype("<u4").tobytes() if stays else None,
                        doc_ids=block.column("doc_id").take(pa.array(order)).to_pylist() if stays else None))
                    if len(lot) == LOT:
                        yield pa.RecordBatch.from_pylist(lot, schema)
                        lot = []
                # words that stay after contexts apart, by the part of these
                by_own = np.argsort(own, kind="stable")
                rank[by_own] = np.arange(len(names))
                before, token, place = apart
                keys, counts = _distinct(_keys(rank[before - start - 1], slot[token], place, end + 1, n))
                held, at = np.divmod(keys, n)
                held, stayed = np.divmod(held, end + 1)
                cuts = np.flatnonzero(np.diff(own[by_own[held]], prepend=-1))
                heads_of = np.flatnonzero(np.diff(held, prepend=-1))
                named, sizes = by_own[held[heads_of]], np.diff(heads_of, append=len(held))
                upto = np.searchsorted(heads_of, [*cuts, len(held)])
                for k, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(keys)])):
                    which, size = named[upto[k]:upto[k + 1]], sizes[upto[k]:upto[k + 1]]
                    lot.append(row(
                        parts + int(own[which[0]]), hashes[which].tobytes(), size, stayed[lo:hi], hashes[:0],
                        at[lo:hi], counts[lo:hi]))
                    if len(lot) == LOT:
                        yield pa.RecordBatch.from_pylist(lot, schema)
                        lot = []
                if lot:
                    yield pa.RecordBatch.from_pylist(lot, schema)
                number += 1

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "train").mapInArrow(run, f"{_PACKED_SQL}, doc_ids array<{id_type}>")


@dataclass
class Part:
    """Dishes of a part of the vocabulary, in an order that depends on its words alone.

    A dish is a word after a context (at the root after 0).
    """

    words: np.ndarray  # word of each dish, ascending
    before: np.ndarray
    learned: np.ndarray  # times in training

    def __post_init__(self):
        self.n_words = int(self.words[-1]) + 1 if len(self.words) else 0
        self.word_count = np.bincount(self.words, self.learned, self.n_words).astype(np.int64)


def _merge(packed: DataFrame, parts: int, n: int) -> DataFrame:
    """One row per part: its dishes, and by block the entries as runs of dishes.

    The contexts apart are numbered from n, in the order of ``rare``: by part, then by hash.
    Rows below 0 pass as they are.
    """
    def entries(r: dict, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word and previous token of each entry, the hashes, and for each entry which (-1: none)."""
        size = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
        before = np.frombuffer(r["before"], "<u2").astype(np.int64)
        if r["part"] >= parts:
            return before, before, np.frombuffer(r["words"], "<u8"), np.repeat(np.arange(len(size)), size)
        word = np.repeat(np.fromiter(map(number.__getitem__, r["words"].split(b" ")), np.int64, len(size)), size)
        which = np.where((before == APART) | (before == AGAIN), np.cumsum(before == APART) - 1, -1)
        return word, before, np.frombuffer(r["rare"], "<u8"), which

    def merged(rows: list[dict]) -> dict:
        names = [] if rows[0]["part"] >= parts else sorted(set().union(*(r["words"].split(b" ") for r in rows)))
        # words with one hash would meet here, as it decides on the part
        if len(np.unique(word_hashes(names))) < len(names):
            raise ValueError("two words have one hash: take another SEED")
        number = {w: i for i, w in enumerate(names)}
        found = [entries(r, number) for r in rows]
        rare = np.unique(np.concatenate([hashes for _, _, hashes, _ in found]))
        order = np.lexsort((rare, rare % np.uint64(parts)))
        code = np.empty(len(rare), np.int64)
        code[order] = n + np.arange(len(rare))
        dish, trained, blocks = [], [], []
        for r, (word, before, hashes, which) in zip(rows, found):
            if len(hashes):
                before = np.where(which >= 0, code[np.searchsorted(rare, hashes)][which], before)
            key = word << 32 | before
            place = np.frombuffer(r["place"], "<u2")
            learned = np.where(place < r["n_trained"], _counts(r["count"], r["more"]), 0)
            first = np.flatnonzero(np.diff(key, prepend=-1))
            dish.append(key[first])
            trained.append(np.add.reduceat(learned, first))
            blocks.append((r, np.diff(first, append=len(key))))
        every, at = np.unique(np.concatenate(dish), return_inverse=True)
        learned = np.bincount(at, np.concatenate(trained), len(every)).astype("<u8")
        ends = np.cumsum([0, *map(len, dish)])
        return {
            "words": (every >> 32).astype("<u4").tobytes(), "before": (every & 0xFFFFFFFF).astype("<u4").tobytes(),
            "learned": learned.tobytes(), "rare": rare[order].tobytes(), "blocks": [{
                "block": r["block"], "dishes": at[a:b].astype("<u4").tobytes(), "sizes": runs.astype("<u2").tobytes(),
                "place": r["place"], "count": r["count"], "more": r["more"]}
                for (r, runs), a, b in zip(blocks, ends, ends[1:])]}

    binary = pa.binary()
    entry = pa.struct([("block", pa.int64()), *((name, binary) for name in ("dishes", "sizes", "place", "count", "more"))])
    ids = packed.schema["doc_ids"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = None, []
        for batch in tidy(batches):
            if schema is None:
                schema = pa.schema([*batch.schema, ("learned", binary), ("blocks", pa.list_(entry))])
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                if held and row["part"] != held[0]["part"]:
                    yield pa.RecordBatch.from_pylist([{"part": held[0]["part"], **merged(held)}], schema)
                    held = []
                if row["part"] < 0:
                    yield pa.RecordBatch.from_pylist([row], schema)
                else:
                    held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([{"part": held[0]["part"], **merged(held)}], schema)

    return packed.mapInArrow(
        run, f"{_PACKED_SQL}, doc_ids {ids}, learned binary, "
             "blocks array<struct<block:long,dishes:binary,sizes:binary,place:binary,count:binary,more:binary>>")


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """A stored table that is joined by part without a shuffle of its rows."""
    name = f"tannin_merged_{uuid.uuid4().hex}"
    with _shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").format("parquet").bucketBy(buckets, "part").saveAsTable(name)
    return df.sparkSession.table(name)


def _kept(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word slot, context, place and count of the entries that stay with their documents."""
    size = np.frombuffer(row["sizes"], "<u4")
    word = np.repeat(np.frombuffer(row["words"], "<u2").astype(np.int64), size)
    return (word, np.frombuffer(row["before"], "<u2").astype(np.int64),
            np.frombuffer(row["place"], "<u2").astype(np.int64), _counts(row["count"], row["more"]))


def _kept_counts(staying: DataFrame, m: int, n: int) -> np.ndarray:
    """How often each of m word slots follows each of n contexts in training."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m * n, np.int64)
        for row in _rows(batches):
            word, before, place, count = _kept(row)
            total += np.bincount(word * n + before, np.where(place < row["n_trained"], count, 0), m * n).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array((some // n).astype(np.int32)), pa.array((some % n).astype(np.int32)), pa.array(total[some])],
            ["word", "before", "n"])

    found = np.zeros((m, n), np.int64)
    summed = staying.mapInArrow(run, "word int, before int, n long").groupBy("word", "before").agg(F.sum("n").alias("n"))
    for row in summed.collect():  # m x n rows at most
        found[row["word"], row["before"]] = row["n"]
    return found


# --- sampling ---------------------------------------------------------------

@dataclass
class Globals:
    """What the parts share: totals of customers and tables by context (slot 0 is the root)."""

    customers: np.ndarray
    tables: np.ndarray
    vocabulary: int
    tokens: int
    discounts: tuple[float, float]  # of the root and of the contexts
    #: Root probabilities of the words that stay, and their tables in the contexts apart.
    kept: np.ndarray | None = None
    aside: np.ndarray | None = None

    @property
    def base_weight(self) -> float:
        """Weight of a new table of the root: the base is uniform over all words and an unknown one."""
        return (STRENGTH + self.discounts[0] * self.tables[0]) / (self.vocabulary + 1)

    @property
    def unknown(self) -> float:
        """Root probability of a word that no table serves."""
        return self.base_weight / (STRENGTH + self.customers[0])

    def at_root(self, served: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Root probabilities of words with so many customers and tables there."""
        return (served - self.discounts[0] * tables + self.base_weight) / (STRENGTH + self.customers[0])

    def after(self, context: np.ndarray, learned: np.ndarray, tables: np.ndarray, at_root: np.ndarray) -> np.ndarray:
        """Probabilities of words after contexts; after 0 the root speaks."""
        d = self.discounts[1]
        own = (learned - d * tables + (STRENGTH + d * self.tables[context]) * at_root) / (
            STRENGTH + self.customers[context])
        return np.where(context > 0, own, at_root)


def _states(part: Part, shared: Globals, random: np.random.Generator, burn_in: int, samples: int, aside: int = 0):
    """Sampled seatings of a part: tables by dish, root customers and tables by word.

    ``aside`` customers of the root, tables in other parts, are added to each word.
    """
    inner = (part.before > 0) & (part.learned > 0)
    of, word = np.flatnonzero(inner), part.words[inner]
    direct = np.bincount(part.words, np.where(part.before == 0, part.learned, 0), part.n_words).astype(np.int64) + aside
    contexts = Seating(part.learned[of], shared.discounts[1], random)
    after = STRENGTH + shared.discounts[1] * shared.tables[part.before[of]]
    root_weight = np.full(part.n_words, shared.base_weight)
    served = direct + np.bincount(word, minlength=part.n_words)
    contexts.seat(after * shared.at_root(served, np.minimum(served, 1))[word])
    for sample in range(burn_in + samples):
        served = direct + np.bincount(word, contexts.tables, part.n_words).astype(np.int64)
        root = Seating(served, shared.discounts[0], random)
        root.seat(root_weight, swept=True)
        root.sweep(root_weight)
        if sample >= burn_in:
            tables = np.zeros(len(part.words), np.int64)
            tables[of] = contexts.tables
            yield tables, served, root.tables.copy()
        if sample < burn_in + samples - 1:
            contexts.sweep(after * shared.at_root(served, root.tables)[word])


def _states_aside(part: Part, shared: Globals, random: np.random.Generator, burn_in: int, samples: int):
    """Sampled tables by dish of words that stay, whose root probabilities are known."""
    of = np.flatnonzero(part.learned > 0)
    contexts = Seating(part.learned[of], shared.discounts[1], random)
    weight = (STRENGTH + shared.discounts[1] * shared.tables[part.before[of]]) * shared.kept[part.words[of]]
    contexts.seat(weight)
    for sample in range(burn_in + samples):
        if sample >= burn_in:
            tables = np.zeros(len(part.words), np.int64)
            tables[of] = contexts.tables
            yield tables
        if sample < burn_in + samples - 1:
            contexts.sweep(weight)


def _part(row: dict) -> Part:
    return Part(np.frombuffer(row["words"], "<u4").astype(np.int64), np.frombuffer(row["before"], "<u4").astype(np.int64),
                np.frombuffer(row["learned"], "<u8").astype(np.int64))


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values).cast(kind))


def _total(dishes: DataFrame, work, parts: int, numbers: int) -> tuple[dict[str, np.ndarray], DataFrame]:
    """Sums of what ``work`` gives for each part: by name, and for the contexts apart.

    ``work`` returns arrays by name, of a few numbers per context that all know, and arrays of
    ``numbers`` integers per context apart of the part.  These are summed where all parts that
    have a context meet, by its hash at first and by its rank then.  The second result has
    for each part its sums, met_0 and so on, and at first the ranks, met_rank.
    """
    names = [f"met_{k}" for k in range(numbers)]
    schema = pa.schema([("name", pa.string()), ("value", pa.list_(pa.float64())), ("to", pa.int32()), ("part", pa.int32()),
                        ("met_rank", pa.list_(pa.int64())), *((name, pa.list_(pa.int32())) for name in names)])
    arrays = "met_rank array<long>, " + ", ".join(f"{name} array<int>" for name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for row in _rows(batches):
            sums, own = work(row, _part(row))
            for name, values in sums.items():
                found[name] = found.get(name, 0.0) + np.asarray(values, np.float64)
            rare = np.frombuffer(row["rare"], "<u8")
            if len(rare):
                key = row["met_rank"] if "met_rank" in row else rare.view(np.int64)
                to = (rare % np.uint64(parts) // np.uint64(PARTS)).astype(np.int32)
                cuts = np.flatnonzero(np.diff(to, prepend=-1))
                offsets, k = np.append(cuts, len(rare)), len(cuts)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(k, pa.string()), pa.nulls(k, pa.list_(pa.float64())), pa.array(to[cuts]),
                     pa.array(np.full(k, row["part"], np.int32)), _lists(offsets, key, pa.int64()),
                     *(_lists(offsets, values, pa.int32()) for values in own)], schema=schema)
        yield pa.RecordBatch.from_pylist([{"name": name, "value": values} for name, values in found.items()], schema)

    def gather(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy()
        keys, at = np.unique(flat("met_rank"), return_inverse=True)
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(table.column("met_rank")).to_numpy())])
        sums = {name: np.bincount(at, flat(name), len(keys)).astype(np.int64)[at] for name in names}
        return pa.table({"part": table.column("part"), "to": table.column("to"),
                         **({"met_rank": _lists(offsets, at, pa.int64())} if "met_rank" in lists else {}),
                         **{name: _lists(offsets, values, pa.int32()) for name, values in sums.items()}})

    sent = _stored(dishes.mapInArrow(run, f"name string, value array<double>, to int, part int, {arrays}"), "sent")
    def add(table: pa.Table) -> pa.Table:
        """A row per task, all of one length."""
        values = table.column("value").combine_chunks().flatten().to_numpy().reshape(len(table), -1).sum(axis=0)
        return pa.table({"name": table.column("name")[:1], "value": _lists(np.array([0, len(values)]), values, pa.float64())})

    rows = sent.filter("name is not null").select("name", "value").groupBy("name") \
        .applyInArrow(add, "name string, value array<double>").collect()
    found = {row["name"]: np.array(row["value"]) for row in rows}
    # the ranks do not change
    lists = names if "met_rank" in dishes.columns else ["met_rank", *names]
    summed = sent.filter("to is not null").drop("name", "value").groupBy("to").applyInArrow(
        gather, ", ".join(["part int, to int", *(f"{name} array<{'long' if name == 'met_rank' else 'int'}>" for name in lists)]))
    met = summed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("to", *lists))).alias("met")) \
        .select("part", *(F.flatten(f"met.{name}").alias(name) for name in lists))
    return found, _stored(met, "met")


def _discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def score_texts(docs: DataFrame, contexts: int = CONTEXTS, rounds: int = ROUNDS, burn_in: int = BURN_IN,
                samples: int = SAMPLES, parts: int | None = None, seed: int = SEED) -> DataFrame:
    """Log10 probability of every whole text, learned from the documents outside the fold.

    Texts are taken with A-Z lower-cased; a null or empty text has one token, its end.
    Documents whose crc32(doc_id) mod 5 is 1 are held out of all counts; null ids are not.
    Every word of every text is counted and scored.  If no document is learned from, every
    token is unknown.  Repeated rows count each for itself.  The packed tokens are stored
    when this is called.

    ``parts`` of the vocabulary are sampled one at a time (default: four for each shuffle
    partition).  Seatings depend on ``seed``, ``parts``, the round and the counts, not on
    how the rows of ``docs`` are dealt.  Every previous token has a restaurant.  The ``contexts``
    only say of how many words, 65,000 at most, all parts know the numbers of tables.

    Result: doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens,
    base_score (unigrams with 0.5 added) and score.
    """
    spark = docs.sparkSession
    parts = parts or PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", text_column().alias("text"), train_row(F.col("doc_id")).alias("train"))
    with _shuffles_freed(spark):
        top = word_counts(read).orderBy(F.desc("n"), "word").limit(contexts)
        frequent = [r["word"] for r in top.collect()]
    n, m = len(frequent) + 2, min(len(frequent), STAYING) + 2
    packed = _pack(read, frequent, parts).repartition("part").sortWithinPartitions("part", "block")
    merged = _bucketed(_merge(packed, parts, n), int(spark.conf.get("spark.sql.shuffle.partitions")))
    staying = merged.filter("part < 0")
    merged = merged.filter("part >= 0").select("part", "words", "before", "learned", "rare", "blocks")
    kept = _kept_counts(staying, m, n)
    # a row per word that stays with its documents
    rows = spark.createDataFrame([
        (-slot, np.zeros(n, "<u4").tobytes(), np.arange(n).astype("<u4").tobytes(), kept[slot].astype("<u8").tobytes(), b"")
        for slot in range(1, m)], "part int, words binary, before binary, learned binary, rare binary")
    # as many tasks as there are shuffle partitions, at most a few rows each
    rows = rows.repartition("part")
    dishes = merged.drop("blocks").union(rows)

    def met_by(sums: DataFrame, to: DataFrame) -> DataFrame:
        """With what the contexts apart have; the stored rows stay where they are."""
        return to.join(sums.hint("shuffle_hash"), "part", "left")

    def apart(row: dict, part: Part, values: np.ndarray) -> np.ndarray:
        """Sums by context apart."""
        return np.bincount(part.before, values, n + len(row["rare"]) // 8)[n:].astype(np.int64)

    def within(row: dict, known: Globals, tables: str) -> Globals:
        """The totals with those of the contexts apart that the part has."""
        if not row["rare"]:
            return known
        return replace(known, customers=np.concatenate([known.customers, row["met_customers"]]),
                       tables=np.concatenate([known.tables, row[tables]]))

    def by_slot(row: dict, part: Part, values: np.ndarray) -> np.ndarray:
        """Sums by word that stays."""
        words = part.words - row["part"] if row["part"] < 0 else part.words
        return np.bincount(words, values, m)

    def count(row: dict, part: Part) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
        inner, there = part.before > 0, part.learned > 0
        sums = {"customers": np.bincount(part.before, part.learned, n)[:n],
                "tables": np.bincount(part.before, there, n)[:n],
                "apart": [(there & (part.before >= n)).sum()],
                "ones and twos": [((part.learned == k) & inner).sum() for k in (1, 2)]}
        if 0 <= row["part"] < parts:
            sums["totals"] = [(part.word_count > 0).sum(), part.word_count.sum(),
                              *((part.word_count == k).sum() for k in (1, 2))]
        else:
            sums["slots"] = by_slot(row, part, part.learned)
            sums["served"] = by_slot(row, part, there)
            if row["part"] >= parts:
                sums["aside"] = by_slot(row, part, there)
        return sums, [apart(row, part, part.learned), apart(row, part, there)]

    found, met = _total(dishes, count, parts, 2)
    customers, tables = found["customers"], found["tables"]
    slots = found["slots"].astype(np.int64)  # counts of the words that stay
    totals = np.array([np.count_nonzero(slots), slots.sum(), *(np.count_nonzero(slots == k) for k in (1, 2))]) \
        + found.get("totals", 0)
    vocabulary, total = (int(v) for v in totals[:2])
    # at first every dish of a context has one table, and the root serves those
    customers[0] += tables[1:].sum() + found["apart"][0]
    tables[0] = vocabulary
    shared = Globals(customers, tables, vocabulary, total, (_discount(*totals[2:]), _discount(*found["ones and twos"])))
    shared.kept = shared.at_root(found["served"], np.minimum(found["served"], 1))
    shared.aside = found.get("aside", np.zeros(m)).astype(np.int64)
    known = met.withColumnsRenamed({"met_0": "met_customers", "met_1": "met_tables"})

    def sampled(row: dict, part: Part, shared: Globals, turn: int, first: int, many: int):
        """The seatings of a part in a round, the root's of words that stay after contexts apart as none."""
        here = within(row, shared, "met_tables")
        random = np.random.default_rng([seed, turn, row["part"] + n])
        if row["part"] >= parts:
            return ((tables, None, None) for tables in _states_aside(part, here, random, first, many))
        return _states(part, here, random, first, many, int(shared.aside[-row["part"]]) if row["part"] < 0 else 0)

    for turn in range(1, rounds + 1):
        # the rounds before the last only bring the totals near
        first, many = (burn_in, samples) if turn == rounds else (1, 1)

        def sample(row: dict, part: Part, shared=shared, turn=turn, first=first, many=many):
            sums, own = {}, []
            for k, (tables, served, root) in enumerate(sampled(row, part, shared, turn, first, many)):
                by_context = np.bincount(part.before, tables, n)[:n]
                by_context[0] = 0 if root is None else root.sum()
                sums[f"tables {k}"] = by_context
                if root is None:
                    sums[f"aside {k}"] = by_slot(row, part, tables)
                else:
                    sums[f"served {k}"] = [served.sum()]
                if row["part"] < 0:
                    at = np.arange(m) == -row["part"]
                    sums[f"kept served {k}"], sums[f"kept root {k}"] = at * served.sum(), at * root.sum()
                own.append(apart(row, part, tables))
            return sums, own

        # joined before the union, which would deal the stored rows out again
        found, met = _total(
            met_by(known, merged.drop("blocks")).unionByName(rows, allowMissingColumns=True), sample, parts, many)
        # of each sample its own totals
        states = []
        for k in range(many):
            customers = shared.customers.copy()
            customers[0] = found[f"served {k}"][0]
            state = Globals(customers, found[f"tables {k}"], vocabulary, total, shared.discounts)
            state.kept = state.at_root(found[f"kept served {k}"], found[f"kept root {k}"])
            state.aside = found.get(f"aside {k}", np.zeros(m)).astype(np.int64)
            states.append(state)
        before = shared
        if turn < rounds:
            shared = states[0]
            known = known.drop("met_tables").join(met.select("part", F.col("met_0").alias("met_tables")), "part")

    def probabilities(row: dict, part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each dish log10 of its mean probability, of its word whether it is known, and its base score."""
        mean = np.zeros(len(part.words))
        for k, (tables, served, root) in enumerate(sampled(row, part, before, rounds, burn_in, samples)):
            state = within(row, states[k], f"met_{k}")
            at_root = state.kept[part.words] if root is None else state.at_root(served, root)[part.words]
            mean += state.after(part.before, part.learned, tables, at_root) / samples
        stays = not 0 <= row["part"] < parts
        counted = slots[part.words - min(row["part"], 0)] if stays else part.word_count[part.words]
        return np.log10(mean), counted > 0, np.log10((counted + 0.5) / (total + 0.5 * (vocabulary + 1)))

    def of_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([v] if isinstance(v, int) else [v.astype("<f8").tobytes()], t)
                 for v, t in zip((row["part"], *probabilities(row, _part(row))),
                                 (pa.int32(), *[pa.binary()] * 3))], ["part", "score", "known", "base"])

    table = {name: np.zeros((m, n)) for name in ("score", "known", "base")}
    for row in rows.mapInArrow(of_kept, "part int, score binary, known binary, base binary").collect():
        for name in table:
            table[name][-row["part"]] = np.frombuffer(row[name], "<f8")
    sums = "block long, place binary, known binary, base binary, score binary"

    kinds = {"known": "<u4", "base": "<f8", "score": "<f8"}

    def summed(block: int, place: np.ndarray, values: dict[str, np.ndarray]) -> dict:
        """One row of sums by document."""
        return row_of(block, np.bincount(place), {name: np.bincount(place, v) for name, v in values.items()})

    def row_of(block: int, entries: np.ndarray, sums: dict[str, np.ndarray]) -> dict:
        """The documents that have entries, of sums by place."""
        some = np.flatnonzero(entries)
        return {"block": block, "place": some.astype("<u2").tobytes(),
                **{name: v[some].astype(kinds[name]).tobytes() for name, v in sums.items()}}

    def score_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            word, context, place, count = _kept(row)
            yield pa.RecordBatch.from_pylist([summed(
                row["block"], place, {name: count * table[name][word, context] for name in kinds})])

    def score_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's parts are added up before they are handed on: some bytes per document that has their words
        held: dict[int, np.ndarray] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for block, (entries, *values) in held.items():
                yield pa.RecordBatch.from_pylist([row_of(block, entries, dict(zip(kinds, values)))])
            held.clear()

        total_held = 0
        for row in _rows(batches):
            values = dict(zip(("score", "known", "base"), probabilities(row, _part(row))))
            for block in row["blocks"]:
                dishes, runs = np.frombuffer(block["dishes"], "<u4"), np.frombuffer(block["sizes"], "<u2")
                place, count = np.frombuffer(block["place"], "<u2"), _counts(block["count"], block["more"])
                sums = np.stack([np.bincount(place), *(
                    np.bincount(place, count * np.repeat(values[name][dishes], runs)) for name in kinds)])
                had = held.get(block["block"], sums[:, :0])
                some, more = sorted((had, sums), key=lambda v: v.shape[1])
                more[:, :some.shape[1]] += some
                held[block["block"]] = more
                total_held += more.shape[1] - had.shape[1]
                if total_held > MOST_HELD:
                    yield from handed()
                    total_held = 0
        yield from handed()

    last = known.drop("met_rank").join(met, "part")
    scored = met_by(last, merged).mapInArrow(score_parts, sums).union(staying.mapInArrow(score_kept, sums))

    def add(named: pa.Table, parts_: pa.Table) -> pa.Table:
        """The documents of one block: a few thousand."""
        row = named.to_pylist()[0]
        size = len(row["doc_ids"])
        found = {name: np.zeros(size) for name in kinds}
        for part in sorted(parts_.to_pylist(), key=lambda r: (r["place"], r["score"])):
            place = np.frombuffer(part["place"], "<u2")
            for name, values in found.items():
                values[place] += np.frombuffer(part[name], kinds[name])
        return pa.table({
            "doc_id": named.column("doc_ids").combine_chunks().flatten(),
            "n_tokens": np.frombuffer(row["lengths"], "<u4").astype(np.int64),
            "n_known": found["known"].round().astype(np.int64), "base_score": found["base"], "score": found["score"]})

    named = staying.select("block", "doc_ids", "lengths").groupBy("block")
    joined = named.cogroup(scored.groupBy("block")).applyInArrow(
        add, f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double")
    return joined.select(
        "doc_id", (~train_row(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
