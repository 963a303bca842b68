"""Near-duplicates by SimHash, compared exactly in tiles.

Distinct fingerprints lie in tiles of one population count.  Pairs of tiles whose counts
differ by more than the radius are skipped, since the distance is at least that; all
others are compared in full, by exclusive-or and bit counts in numpy.  The work grows
with the square of the number of distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tannin.llm.components import components
from tannin.llm.words import sliced, split_words, text_column, tidy
from tannin.sources import sinks

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of a tile, about.
TILE = 16384
#: A pair of tiles is compared in squares that stay in the processor's cache.
ROWS, COLUMNS = 128, 1024
BATCH_BYTES = 4 << 20
_VOTES = 1 << 18


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit SimHash of each text; 0 for texts without words."""
    # lowered before any cast: Arrow reads a slice that was cast beyond its values
    words = split_words(pc.ascii_lower(texts))
    ends, space = (pa.scalar(s, pa.large_string()) for s in ("", " "))
    spaced = pc.binary_join_element_wise(words.words, ends, space)
    ends = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset:spaced.offset + len(spaced) + 1] \
        if len(spaced) else np.zeros(1, np.int64)
    data = spaced.buffers()[2].to_pybytes() if len(spaced) else b""
    count = np.diff(words.offsets)
    size = np.where(count == 0, 0, np.maximum(count - shingle + 1, 1))
    upto = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(size)), size)
    votes = np.zeros((len(size), 64), np.int64)
    for at in range(0, len(doc), _VOTES):
        of = doc[at:at + _VOTES]
        first = words.offsets[of] + np.arange(at, at + len(of)) - upto[of]
        last = np.minimum(first + shingle, words.offsets[of + 1])
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(data[a:b], SEED)
             for a, b in zip(ends[first].tolist(), (ends[last] - 1).tolist())), "<u8", len(of))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.flatnonzero(np.diff(of, prepend=-1))
        votes[of[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    ones = (2 * votes > size[:, None]).astype(np.uint8)
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tie (a hash of the text) and fingerprint (long) of every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(tidy(batches), "text", BATCH_BYTES):
            found = fingerprints_of(batch.column("text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array(found)],
                ["doc_id", "tie", "fingerprint"])

    text = text_column()
    read = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(run, f"doc_id {kind}, tie long, fingerprint long")


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent = above


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Parents after joining the nodes a and b, each pointing at its smallest root."""
    while True:
        high, low = np.maximum(parent[a], parent[b]), np.minimum(parent[a], parent[b])
        open_ = high > low
        if not open_.any():
            return parent
        np.minimum.at(parent, high[open_], low[open_])
        parent = _roots(parent)


def links_between(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs within the radius join, at most one per fingerprint."""
    parent = np.arange(len(left) + len(right))
    for i in range(0, len(left), ROWS):
        rows = left[i:i + ROWS, None]
        for j in range(0, len(right), COLUMNS):
            near = np.bitwise_count(rows ^ right[None, j:j + COLUMNS]) <= radius
            if near.any():
                a, b = np.nonzero(near)
                parent = _unite(parent, a + i, b + j + len(left))
    every = np.concatenate([left, right])
    linked = np.flatnonzero(parent != np.arange(len(parent)))
    return every[linked], every[parent[linked]]


def near_pairs(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all within the radius."""
    counted = distinct.groupBy(F.bit_count("fingerprint").alias("ones")).count().collect()  # 65 rows at most
    tiles = [0] * 65
    for row in counted:
        tiles[row["ones"]] = -(-row["count"] // tile)
    of = F.array(*map(F.lit, tiles))
    placed = distinct.select("fingerprint", F.bit_count("fingerprint").cast("int").alias("ones")) \
        .withColumn("part", F.pmod(F.xxhash64("fingerprint"), of[F.col("ones")]).cast("int"))
    packed = sinks.materialize(placed.groupBy("ones", "part").agg(
        F.collect_list("fingerprint").alias("fingerprints")))
    # each tile meets those of its own and higher counts within the radius
    other = F.explode(F.sequence(F.col("ones"), F.least(F.col("ones") + radius, F.lit(64))))
    meets = packed.withColumn("ones2", other) \
        .filter(of[F.col("ones2")] > 0) \
        .withColumn("part2", F.explode(F.sequence(F.lit(0), of[F.col("ones2")] - 1))) \
        .filter((F.col("ones2") > F.col("ones")) | (F.col("part2") >= F.col("part")))
    facing = packed.select(F.col("ones").alias("ones2"), F.col("part").alias("part2"),
                           F.col("fingerprints").alias("others"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("fingerprints"), batch.column("others")):
                a, b = (x.values.to_numpy().view(np.uint64) for x in (left, right))
                a, b = links_between(a, b, radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    pairs = meets.join(facing, ["ones2", "part2"]).select("fingerprints", "others")
    # pairs of tiles differ in cost, and few of them share a key: deal them out one by one
    return pairs.repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism) \
        .mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    tile: int = TILE) -> DataFrame:
    """Groups of documents whose fingerprints are linked within ``radius`` bits.

    Texts are taken with A-Z lower-cased, as words, in shingles of ``shingle`` words with
    repeats; a shorter text is one shingle.  A bit is 1 if it is set in over half of the
    shingles' hashes.  Null, empty and white texts have fingerprint 0 and are linked like
    any other.  Copies share one fingerprint before anything is compared.

    Result: doc_id, tie (a hash of the text), fingerprint (long), root (the smallest
    fingerprint of the group) and component_id (the smallest doc_id of the group, null only
    if all are), a row per row of ``docs``.  Fingerprints are stored when this is called.
    """
    found = sinks.materialize(fingerprints(docs, shingle))
    distinct = sinks.materialize(found.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    joined = components(near_pairs(distinct, radius, tile))
    groups = distinct.join(joined, distinct["fingerprint"] == joined["node"], "left") \
        .select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    smallest = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = groups.join(smallest, "root").select("fingerprint", "root", "component_id")
    return found.join(groups, "fingerprint").select(
        "doc_id", "tie", "fingerprint", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the smallest doc_id stays.

    Null ids count as the largest; of rows with one doc_id the smallest hash of a text
    stays, and of equal rows one.
    """
    found = near_duplicates(docs, shingle, radius)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    # null ids as a flag and a value, so that the join and the removal of equal rows, both by
    # these columns, need one partitioning
    kind = docs.schema["doc_id"].dataType
    place = lambda doc_id, tie: (
        doc_id.isNull().alias("_none"), F.coalesce(doc_id, F.lit(0).cast(kind)).alias("_id"), tie.alias("_tie"))
    kept = found.groupBy("root").agg(F.min(order).alias("kept")) \
        .select(*place(F.col("kept.doc_id"), F.col("kept.tie")))
    row = docs.select(F.struct("*").alias("_row"), *place(F.col("doc_id"), F.xxhash64(text_column())))
    keys = ["_none", "_id", "_tie"]
    once = row.join(kept, keys, "left_semi").dropDuplicates(keys)
    return once.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
