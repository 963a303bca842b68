"""Ranked lexical search with hashed max-sketches.

A document's terms are hashed to 65,536 coordinates; its sketch holds, of each coordinate
that is hit, the largest impact folded into it.  As impacts grow with the number of
occurrences alone, the largest number is kept, which does not depend on the corpus.  A
query looks its terms' coordinates up in the sketches of a whole batch: the weighted sum
is at least the document's score.  Documents are rescored exactly in descending order of
that bound, until it falls below the k-th best score.

The first scan rescores a few documents of every task, those of the highest bounds; the
k-th best of them is where the second scan starts, in every task alike.  Both scans read
stored sketches and counts, never texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tannin.llm.words import LOWER, UPPER, WordLists, byte_slices, split_words, tidy
from tannin.sources import sinks

#: A term is a maximal run of ASCII letters and digits and of characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
COORDINATES = 1 << 16
#: Counts above this share one mark, whose impact is the limit of all impacts.
MOST = 255
LIMIT = 1_000_000
#: Bytes of query texts that are looked up together; a longer query is alone.
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
#: Cells of the table of sketches that a batch is unfolded to.
CELLS = 4 << 20
#: Documents rescored at once, before the threshold is looked at again.
STEP = 64
_TERM = re.compile(TERM)
_TO_LOWER = str.maketrans(UPPER, LOWER)


def _folded() -> np.ndarray:
    """For each byte of UTF-8 what it becomes: A-Z lowered, bytes outside terms a space."""
    table = np.arange(256, dtype=np.uint8)
    outside = [b for b in range(128) if not chr(b).isalnum()]
    table[outside] = 0x20
    table[0x41:0x5B] += 0x20
    return table


_FOLDED = _folded()


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_TO_LOWER))


def split_terms(texts: pa.Array) -> WordLists:
    """Terms of each text; null texts have none."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return split_words(texts)
    wide = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1] \
        .astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.zeros(0, np.uint8)
    return split_words(pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(_FOLDED[data])))


@dataclass
class Block:
    """Queries that are looked up together; term c of the vocabulary has code c."""

    first: int  # number of the first query
    ids: list
    vocabulary: list[str]
    terms: list[np.ndarray]  # codes of each query

    def __post_init__(self):
        self.places = np.array([_place(t) for t in self.vocabulary], np.int64)
        # rows of the unfolded sketches: only coordinates that a query asks for
        self.used, self.row_of_code = np.unique(self.places, return_inverse=True)
        self.row_of_place = np.full(COORDINATES, -1, np.int32)
        self.row_of_place[self.used] = np.arange(len(self.used))


def _place(term: str) -> int:
    return xxhash.xxh32_intdigest(term.encode()) % COORDINATES


def blocks(queries: DataFrame, max_bytes: int) -> Iterator[Block]:
    """The queries as blocks of bounded size, one after another."""
    first, ids, texts, size = 0, [], [], 0

    def made() -> Block:
        codes: dict[str, int] = {}
        terms = [np.array([codes.setdefault(t, len(codes)) for t in dict.fromkeys(terms_of(text))], np.int64)
                 for text in texts]
        return Block(first, ids, list(codes), terms)

    for row in queries.select("item_id", "text").toLocalIterator():
        grown = size + len((row["text"] or "").encode())
        if ids and grown > max_bytes:
            yield made()
            first, ids, texts, grown = first + len(ids), [], [], grown - size
        ids.append(row["item_id"])
        texts.append(row["text"])
        size = grown
    if ids:
        yield made()


def _cut(keys: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the n groups of sorted group numbers."""
    return np.searchsorted(keys, np.arange(n + 1)).astype(np.int32)


def sketches(docs: DataFrame, block: Block) -> DataFrame:
    """Of every document with a term: doc_id, n (terms), its sketch, and its counts of the block's terms.

    The sketch is of all terms: ``places`` are ascending coordinates of two bytes, ``tops``
    the largest counts there, of one byte.  ``codes`` and ``counts`` hold the terms that
    the block's queries ask for.
    """
    vocabulary = pa.array(block.vocabulary, pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for start, stop in byte_slices(batch.column("text"), BATCH_BYTES):
                part = batch.slice(start, stop - start)
                terms = split_terms(part.column("text"))
                size = len(part)
                names, index = terms.distinct()
                n = np.diff(terms.offsets)
                of = np.repeat(np.arange(size), n)
                keys, counts = np.unique(of * max(1, len(names)) + index, return_counts=True)
                of, term = np.divmod(keys, max(1, len(names)))
                place = np.array([_place(t) for t in names.to_pylist()], np.int64)[term] if len(names) \
                    else np.zeros(0, np.int64)
                at = of * COORDINATES + place
                order = np.argsort(at, kind="stable")
                cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
                tops = np.maximum.reduceat(np.minimum(counts, MOST)[order], cuts) if len(cuts) else counts
                at = at[order][cuts]
                ends = _cut(at // COORDINATES, size)
                places = (at % COORDINATES).astype("<u2")
                code = pc.fill_null(pc.index_in(names, vocabulary), -1).to_numpy(zero_copy_only=False)[term] \
                    if len(names) else term
                asked = code >= 0
                of, code, counts = of[asked], code[asked], counts[asked]
                order = np.lexsort((code, of))
                lists = pa.array(_cut(of, size))
                found = pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(n.astype(np.int64)),
                    pa.BinaryArray.from_buffers(pa.binary(), size, [
                        None, pa.py_buffer(ends * np.int32(2)), pa.py_buffer(places)]),
                    pa.BinaryArray.from_buffers(pa.binary(), size, [
                        None, pa.py_buffer(ends), pa.py_buffer(tops.astype(np.uint8))]),
                    pa.ListArray.from_arrays(lists, pa.array(code[order].astype(np.int32))),
                    pa.ListArray.from_arrays(lists, pa.array(counts[order].astype(np.int32))),
                ], ["doc_id", "n", "places", "tops", "codes", "counts"])
                yield found.filter(pa.array(n > 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n long, places binary, tops binary, codes array<int>, counts array<int>")


@dataclass
class Corpus:
    """Totals over all documents, and a weight per code of the block."""

    documents: int
    terms: int
    weights: np.ndarray

    def spans(self, n: np.ndarray) -> np.ndarray:
        return 50 + (50 * n * self.documents) // self.terms


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impact(counts: np.ndarray, spans: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 20 * spans)


def corpus_of(index: DataFrame, block: Block) -> Corpus:
    total = index.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    holding = np.zeros(len(block.vocabulary), np.int64)
    # a row per term of the block at most
    for row in index.select(F.explode("codes").alias("code")).groupBy("code").count().toLocalIterator():
        holding[row["code"]] = row["count"]
    weights = np.array([weight(total["documents"], int(h)) for h in holding], np.int64)
    return Corpus(total["documents"], total["terms"] or 0, weights)


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a binary column of values of one kind."""
    width = np.dtype(kind).itemsize
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind) if data else np.zeros(0, kind)
    return np.repeat(np.arange(len(column)), np.diff(ends) // width), data


class Sketches:
    """Unfolded sketches of a batch, and its counts for exact scores."""

    def __init__(self, batch: pa.RecordBatch, block: Block, corpus: Corpus):
        self.block, self.corpus = block, corpus
        self.spans = corpus.spans(batch.column("n").to_numpy())
        of, places = _flat(batch.column("places"), "<u2")
        _, tops = _flat(batch.column("tops"), "u1")
        rows = block.row_of_place[places]
        asked = rows >= 0
        of, rows, tops = of[asked], rows[asked], tops[asked].astype(np.int64)
        self.table = np.zeros((len(block.used), len(batch)), np.int64)
        self.table[rows, of] = np.where(tops == MOST, LIMIT, impact(tops, self.spans[of]))
        codes = batch.column("codes")
        ends = codes.offsets.to_numpy()
        held = slice(int(ends[0]), int(ends[-1]))
        self.width = max(1, len(block.vocabulary))
        # a mark at the end, beyond all keys, keeps places of the search inside
        self.keys = np.append(np.repeat(np.arange(len(batch)), np.diff(ends)) * self.width
                              + codes.values.to_numpy(zero_copy_only=False)[held], len(batch) * self.width)
        self.counts = np.append(
            batch.column("counts").values.to_numpy(zero_copy_only=False)[held].astype(np.int64), 1)

    def bounds(self, query: int) -> np.ndarray:
        """At least the score of every document of the batch."""
        codes = self.block.terms[query]
        return self.corpus.weights[codes] @ self.table[self.block.row_of_code[codes]]

    def scores(self, query: int, rows: np.ndarray) -> np.ndarray:
        """The exact scores of some documents."""
        codes = self.block.terms[query]
        keys = rows[:, None] * self.width + codes
        at = np.searchsorted(self.keys, keys)
        counts = np.where(self.keys[at] == keys, self.counts[at], 0)
        return impact(counts, self.spans[rows][:, None]) @ self.corpus.weights[codes]


def _batches(batches: Iterator[pa.RecordBatch], block: Block, corpus: Corpus, cells: int):
    rows = max(1, cells // max(1, len(block.used)))
    for batch in batches:
        for at in range(0, len(batch), rows):
            part = batch.slice(at, rows)
            yield part, Sketches(part, block, corpus)


def first_scores(index: DataFrame, block: Block, corpus: Corpus, k: int, cells: int = CELLS) -> np.ndarray:
    """Of each query a score that at least k documents reach, 1 where that is not known.

    Every task rescores its documents of the highest bounds, about 2 k over all tasks.
    """
    each = -(-2 * k // max(1, index.rdd.getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in block.ids]
        for _, part in _batches(batches, block, corpus, cells):
            for query, (highest, scores) in enumerate(best):
                bounds = part.bounds(query)
                rows = np.argpartition(-bounds, each - 1)[:each] if len(bounds) > each else np.arange(len(bounds))
                bounds = np.concatenate([highest, bounds[rows]])
                scores = np.concatenate([scores, part.scores(query, rows)])
                kept = np.argsort(-bounds, kind="stable")[:each]
                best[query] = bounds[kept], scores[kept]
        of = np.repeat(np.arange(len(best)), [len(s) for _, s in best]).astype(np.int32)
        if len(of):
            yield pa.RecordBatch.from_arrays(
                [pa.array(of), pa.array(np.concatenate([s for _, s in best]))], ["query", "score"])

    place = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc()))
    reached = index.mapInArrow(run, "query int, score long").withColumn("place", place).filter(F.col("place") <= k)
    least = np.ones(len(block.ids), np.int64)
    for row in reached.filter(F.col("place") == k).collect():  # a row per query of the block at most
        least[row["query"]] = max(1, row["score"])
    return least


def best_of_tasks(index: DataFrame, block: Block, corpus: Corpus, k: int, least: np.ndarray,
                  cells: int = CELLS) -> DataFrame:
    """Of each task and query the k best documents that reach ``least``, at most."""
    kind = index.schema["doc_id"].dataType.simpleString()

    def order(found: tuple) -> tuple:
        score, doc_id = found
        return -score, doc_id is None, doc_id if doc_id is not None else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in block.ids]
        id_type = None
        for batch, part in _batches(batches, block, corpus, cells):
            ids = batch.column("doc_id")
            id_type = ids.type
            for query, held in enumerate(best):
                bounds = part.bounds(query)
                low = max(int(least[query]), held[-1][0] if len(held) == k else 0)
                rows = np.flatnonzero(bounds >= low)
                rows = rows[np.argsort(-bounds[rows], kind="stable")]
                for at in range(0, len(rows), STEP):
                    some = rows[at:at + STEP]
                    if bounds[some[0]] < low:
                        break
                    scores = part.scores(query, some)
                    hits = np.flatnonzero(scores >= low)
                    held += zip(scores[hits].tolist(), ids.take(pa.array(some[hits])).to_pylist())
                    held.sort(key=order)
                    del held[k:]
                    if len(held) == k:
                        low = max(low, held[-1][0])
        rows = [(query, *found) for query, held in enumerate(best) for found in held]
        if rows:
            query, score, doc_id = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int32()), pa.array(doc_id, id_type), pa.array(score, pa.int64())],
                ["query", "doc_id", "score"])

    return index.mapInArrow(run, f"query int, doc_id {kind}, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 50, block_bytes: int = BLOCK_BYTES,
           cells: int = CELLS) -> DataFrame:
    """The k highest-scoring documents of every query, exactly.

    ``docs`` has doc_id and text, ``queries`` item_id and text.  Terms are lower-cased in
    A-Z only.  A query's terms count once each.  Null and empty texts have no terms: such
    documents are neither counted nor found, such queries have no rows.  Equal scores go by
    ascending doc_id, null ids last.  Every row is a document or a query of its own, so
    repeated rows are found, or answered, as often as they occur.  Other columns are not
    read.  Sketches are stored when this is called, once for each ``block_bytes`` of query
    texts, and unfolded ``cells`` numbers at a time; neither changes a result.

    Result: item_id, rank (from 1), doc_id, score (above 0).
    """
    spark = docs.sparkSession
    item = queries.schema["item_id"].dataType
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"query int, item_id {item.simpleString()}, doc_id {kind}, score long")
    for block in blocks(queries, block_bytes):
        index = sinks.store(sketches(docs, block), "sketches")
        corpus = corpus_of(index, block)
        if not corpus.documents or not block.vocabulary:
            continue
        least = first_scores(index, block, corpus, k, cells)
        best = best_of_tasks(index, block, corpus, k, least, cells)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"query int, item_id {item.simpleString()}")
        # a row per query of the block
        best = best.join(F.broadcast(names), "query").select(
            (F.col("query") + block.first).alias("query"), "item_id", "doc_id", "score")
        found = found.union(best)
    ranked = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k) \
        .select("item_id", "rank", "doc_id", "score")
