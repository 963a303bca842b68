"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors x are hashed by floor((a . x + b) / w) with normal a, ``HASHES`` values a table.
A query visits its own bucket and the perturbed buckets of each table in the order of
their estimated success (Lv et al., 2007).  What the tables give is merged, and exact
inner products decide.  For the largest inner product, vectors get one more component
that brings them all to the largest norm, so that it is the nearest point.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tannin.sources import sinks

TABLES, HASHES, PROBES = 6, 5, 20
#: Width of a hash cell, in units of the largest norm.
WIDTH = 2.0
#: Vectors of a bucket that one task compares; larger buckets are split.
PART = 8192
SEED = 42
#: Queries multiplied at once.
ROWS = 256


def probe_order(fractions: np.ndarray, probes: int) -> list[tuple[tuple[int, int], ...]]:
    """Perturbations in ascending order of cost: the own bucket, then sets of (hash, -1 or 1).

    ``fractions`` are the places of the query within its cells.  The cost of a step over a
    border is the squared distance to it, and that of a set the sum.
    """
    steps = sorted([(f * f, i, -1) for i, f in enumerate(fractions)]
                   + [((1 - f) ** 2, i, 1) for i, f in enumerate(fractions)])
    found: list[tuple[tuple[int, int], ...]] = [()]
    heap = [(steps[0][0], (0,))] if steps else []
    while heap and len(found) < probes:
        cost, chosen = heapq.heappop(heap)
        if len({steps[j][1] for j in chosen}) == len(chosen):
            found.append(tuple(steps[j][1:] for j in chosen))
        last = chosen[-1]
        if last + 1 < len(steps):
            more = steps[last + 1][0]
            heapq.heappush(heap, (cost - steps[last][0] + more, (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + more, (*chosen, last + 1)))
    return found


class Hashes:
    """The hash tables of vectors with ``size`` components; the same in every task."""

    def __init__(self, size: int, norm: float, tables: int, hashes: int, width: float, seed: int):
        random = np.random.default_rng([seed, size])
        self.tables, self.hashes, self.norm = tables, hashes, norm
        self.a = random.normal(size=(tables * hashes, size + 1)) / (width * norm)
        self.b = random.uniform(size=tables * hashes)

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Places of the rows of x on each line, in cells: rows x tables x hashes."""
        rest = np.zeros(len(x)) if query else np.sqrt(
            np.maximum(self.norm ** 2 - np.einsum("ij,ij->i", x, x), 0.0))
        lines = np.column_stack([x, rest]) @ self.a.T + self.b
        return lines.reshape(len(x), self.tables, self.hashes)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column, as vectors."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles), size and norm of the rows that take part in searches.

    Null vectors and ids, zero vectors and those with null or non-finite components do not.
    """
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", v.alias("vector")) \
        .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad) \
        .withColumn("size", F.size("vector")).withColumn("norm", norm) \
        .filter((F.col("norm") > 0) & (F.col("norm") < float("inf")))


def _hashed(rows: DataFrame, norms: dict[int, float], tables: int, hashes: int, width: float,
            seed: int, probes: int) -> DataFrame:
    """A row per table, or per table and probe: size, table, bucket, vec_id, vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Hashes] = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            vectors = _vectors(batch.column("vector"))
            ids = batch.column("vec_id")
            for size in np.unique(sizes).tolist():
                if size not in made:
                    made[size] = Hashes(size, norms[size], tables, hashes, width, seed)
                of = np.flatnonzero(sizes == size)
                places = made[size].places(np.stack([vectors[i] for i in of]), probes > 0)
                cells = np.floor(places).astype(np.int64)
                row, table, keys = [], [], []
                for n in range(len(of)):
                    for t in range(tables):
                        own = cells[n, t]
                        for steps in probe_order(places[n, t] - own, probes) if probes else [()]:
                            key = own.copy()
                            for hash_, step in steps:
                                key[hash_] += step
                            row.append(of[n])
                            table.append(t)
                            keys.append(key)
                keys = pa.array(list(np.array(keys)), pa.list_(pa.int64()))
                at = pa.array(np.array(row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("size").take(at), pa.array(table, pa.int32()), keys,
                     ids.take(at), batch.column("vector").take(at)],
                    ["size", "table", "cells", "vec_id", "vector"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"size int, table int, cells array<long>, vec_id {kind}, vector array<double>"
    return rows.select("size", "vec_id", "vector").mapInArrow(run, schema)


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """The k best vectors of each query but itself: places of query and vector, score.

    A matrix product finds all that may be among them; their scores are then summed row by
    row, so that equal vectors have equal scores, and ties go to the smaller id.
    """
    found = []
    for at in range(0, len(queries), ROWS):
        block = queries[at:at + ROWS]
        rough = block @ vectors.T
        for i, scores in enumerate(rough):
            scores[ids == query_ids[at + i]] = -np.inf
            some = np.flatnonzero(scores > -np.inf)
            if len(some) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                some = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))
            exact = (vectors[some] * block[i]).sum(axis=1)
            first = np.lexsort((ids[some], -exact))[:k]
            found.append((np.full(len(first), at + i), some[first], exact[first]))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, int)] * 2 + [np.zeros(0)]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES,
           hashes: int = HASHES, probes: int = PROBES, width: float = WIDTH, part: int = PART,
           seed: int = SEED) -> DataFrame:
    """The k nearest vectors of each query by largest inner product, as far as they are found.

    ``vectors`` and ``queries`` have vec_id and embedding; every usable row of ``vectors``
    is indexed.  A query meets all but rows of its own id, of its own length only.  Of equal
    vectors only the k + 1 smallest ids can be among the nearest, so the others stay out of
    the index, and that is exact.  Buckets beyond ``part`` vectors are split over tasks,
    each of which compares all their queries; nothing is capped.

    Result: query_id, rank (from 1), vec_id, score.  Ties go to the smaller vec_id.  A query
    that is not usable has no rows, and one with fewer candidates fewer rows.
    """
    kept = usable(vectors)
    by_vector = W.partitionBy("_hash", "vector").orderBy("vec_id")
    # Spark limits each task's rows of a group before they are shuffled
    kept = kept.withColumn("_hash", F.xxhash64("vector")) \
        .withColumn("_copy", F.row_number().over(by_vector)).filter(F.col("_copy") <= k + 1) \
        .drop("_hash", "_copy")
    kept = sinks.materialize(kept)
    norms = {r["size"]: r["norm"] for r in kept.groupBy("size").agg(F.max("norm").alias("norm")).collect()}
    asked = usable(queries).filter(F.col("size").isin(list(norms)))
    make = (norms, tables, hashes, width, seed)
    bucket = F.xxhash64("size", "table", "cells").alias("bucket")
    indexed = _hashed(kept, *make, 0).select(bucket, "size", "table", "cells", "vec_id", "vector")
    probing = _hashed(asked, *make, probes).select(
        bucket, "size", "table", "cells", F.col("vec_id").alias("query_id"), "vector")
    # buckets by size, without their vectors; only those beyond one part are of interest
    split = indexed.groupBy("bucket").count().filter(F.col("count") > part) \
        .select(F.col("bucket").alias("_bucket"), F.ceil(F.col("count") / part).alias("_parts"))
    split = sinks.materialize(split)
    parts = lambda df: df.join(split, df["bucket"] == split["_bucket"], "left") \
        .withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    indexed = parts(indexed).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("_parts")))
    probing = parts(probing).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": left.column("query_id").slice(0, 0),
                         "vec_id": right.column("vec_id").slice(0, 0), "score": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return none
        # different buckets may share a hash
        left_key, right_key = (
            [(a, b, tuple(c)) for a, b, c in zip(*(t.column(n).to_pylist() for n in ("size", "table", "cells")))]
            for t in (left, right))
        q, v = _vectors(left.column("vector").combine_chunks()), _vectors(right.column("vector").combine_chunks())
        query_ids, ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        found = [none]
        for key in set(left_key):
            a = np.array([i for i, x in enumerate(left_key) if x == key])
            b = np.array([i for i, x in enumerate(right_key) if x == key], dtype=np.int64)
            if len(b):
                i, j, score = best(np.stack([q[n] for n in a]), query_ids[a], np.stack([v[n] for n in b]), ids[b], k)
                found.append(pa.table({"query_id": query_ids[a][i], "vec_id": ids[b][j], "score": score},
                                      schema=none.schema))
        return pa.concat_tables(found)

    keys = ("bucket", "part")
    scored = probing.select(*keys, "size", "table", "cells", "query_id", "vector").groupBy(*keys).cogroup(
        indexed.select(*keys, "size", "table", "cells", "vec_id", "vector").groupBy(*keys)
    ).applyInArrow(compare, f"query_id {kind}, vec_id {kind}, score double")
    ranked = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.distinct().withColumn("rank", F.row_number().over(ranked)) \
        .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
