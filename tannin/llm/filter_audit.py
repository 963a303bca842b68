"""Interactions of filters: what each order of five filters removes, at which step.

Documents are counted by part and by the set of filters that they fail.  Those counts are
the leaves of a decision diagram per part: a level per filter, a pass and a fail branch at
each node, equal subdiagrams shared, and on every node the documents below it.  Swapping
two adjacent levels changes the order of two filters; 119 swaps visit all 120 orders.  In
every order the path of pass branches from the top gives the steps: the weight of a node
is what is left, that of its fail branch what the filter removes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tannin.llm.words import WORD, text_column

FILTERS = "ABCDE"
#: Failure conditions of the first four; the last is that a smaller doc_id has the text.
LEAST_WORDS = 100
DISTINCT_SHARE = 80
CAPITAL_SHARE = 10
SYMBOLS = "[#$%&*|]"

Weight = tuple[int, int, int]  # documents, good ones, toxic ones
NOTHING: Weight = (0, 0, 0)


def text_failures(text: Column) -> Column:
    """The filters A to D that a text fails, as bits."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counted = F.transform(F.array(words), lambda w: F.struct(
        F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    conditions = [
        counted["n"] < LEAST_WORDS,
        100 * counted["distinct"] < DISTINCT_SHARE * counted["n"],
        100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_SHARE * F.length(text),
        text.rlike(SYMBOLS),
    ]
    return sum((c.cast("int") * (1 << i) for i, c in enumerate(conditions)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part, failed filters (bits), good and toxic: at most 128 rows a part.

    Texts are compared by their SHA-256.  Copies are counted before their smallest id is
    looked for, so a text with very many copies is no large group.  A null doc_id is
    smaller than none and has none before it.
    """
    text = text_column()
    marked = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        text_failures(text).alias("mask"), F.sha2(text, 256).alias("digest"))
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        is_one("quality"), is_one("toxic"))
    rows = marked.join(known, F.col("doc_id") == F.col("_id"), "left").groupBy(
        "digest", "doc_id", "part", "mask", F.coalesce("quality", F.lit(0)).alias("quality"),
        F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))
    kind = ["part", "mask", "quality", "toxic"]
    # per kind of copies: all of them, and those that hold the kind's smallest id
    kinds = rows.groupBy("digest", *kind).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    smallest = kinds.groupBy("digest").agg(F.min("least.doc_id").alias("smallest"))
    first = F.when(F.col("least.doc_id") == F.col("smallest"), F.col("least.n")).otherwise(0) + F.col("unnamed")
    split = kinds.join(smallest, "digest").select(*kind, F.explode(F.array(
        F.struct(F.lit(0).alias("copy"), first.alias("n")),
        F.struct(F.lit(1).alias("copy"), (F.col("n") - first).alias("n")))).alias("v"))
    failed = (F.col("mask") + F.col("v.copy") * (1 << FILTERS.index("E"))).alias("mask")
    return split.groupBy("part", failed, "quality", "toxic").agg(F.sum("v.n").alias("n")).filter("n > 0")


class Diagram:
    """A decision diagram over filters; nodes are numbers, equal ones are one.

    Node k has ``below[k]`` (pass branch, fail branch) and ``weights[k]``.  Leaves, equal by
    their weight, have no branches.  Weights are sums, so no level may be skipped, but for
    subdiagrams without documents: they are node 0.
    """

    def __init__(self, counts: dict[int, Weight], order: str = FILTERS):
        self.order = list(order)
        self.below: list[tuple[int, int] | None] = [None]
        self.weights: list[Weight] = [NOTHING]
        self.numbers: dict[tuple, int] = {}
        nodes = [self._leaf(counts.get(mask, NOTHING)) for mask in range(1 << len(order))]
        # leaves stand in ascending order of their masks: the first filter is the lowest bit
        for _ in order:
            half = len(nodes) // 2
            nodes = [self._node(nodes[i], nodes[i + half]) for i in range(half)]
        self.top = nodes[0]

    def _leaf(self, weight: Weight) -> int:
        return 0 if weight == NOTHING else self._number((weight,), None, weight)

    def _node(self, passed: int, failed: int) -> int:
        if not passed and not failed:
            return 0
        weight = tuple(a + b for a, b in zip(self.weights[passed], self.weights[failed]))
        return self._number((passed, failed), (passed, failed), weight)

    def _number(self, key: tuple, below: tuple[int, int] | None, weight: Weight) -> int:
        found = self.numbers.get(key)
        if found is None:
            found = self.numbers[key] = len(self.weights)
            self.below.append(below)
            self.weights.append(weight)
        return found

    def branches(self, node: int) -> tuple[int, int]:
        return self.below[node] or (0, 0)

    def swap(self, level: int) -> None:
        """Exchange the filters of two adjacent levels; only nodes of these are made anew."""
        done: dict[int, int] = {0: 0}

        def moved(node: int, above: int) -> int:
            if node not in done:
                passed, failed = self.branches(node)
                if above:
                    done[node] = self._node(moved(passed, above - 1), moved(failed, above - 1))
                else:
                    (a, b), (c, d) = self.branches(passed), self.branches(failed)
                    done[node] = self._node(self._node(a, c), self._node(b, d))
            return done[node]

        self.top = moved(self.top, level)
        self.order[level:level + 2] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[str, Weight, Weight]]:
        """Per level of the all-pass path: its filter, what is kept and what is removed."""
        node, found = self.top, []
        for name in self.order:
            passed, failed = self.branches(node)
            found.append((name, self.weights[passed], self.weights[failed]))
            node = passed
        return found


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap, one after another, that lead through all orders of n levels once.

    The last element walks through each order of the others, to and fro.
    """
    if n < 2:
        return
    inner = adjacent_swaps(n - 1)
    down = True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        # at the top it stands above the others, whose levels then begin one below
        yield step + 1 if down else step
        down = not down


def audit_part(counts: dict[int, Weight]) -> list[tuple]:
    """Rows of one part: order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    failing = {name: sum(w[0] for m, w in counts.items() if m >> i & 1) for i, name in enumerate(FILTERS)}
    alone = {name: counts.get(1 << i, NOTHING)[0] for i, name in enumerate(FILTERS)}
    diagram = Diagram(counts)
    found, share = [], dict.fromkeys(FILTERS, 0)
    for level in (None, *adjacent_swaps(len(FILTERS))):
        if level is not None:
            diagram.swap(level)
        order = "".join(diagram.order)
        for step, (name, kept, removed) in enumerate(diagram.steps(), 1):
            share[name] += removed[0]
            found.append((order, step, kept[0], removed[0], failing[name] - removed[0], alone[name], *removed[1:]))
    return [(*row, share[row[0][row[1] - 1]]) for row in found]


COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, " \
    "unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order of the filters A to E over every part of the documents, step by step.

    A part is a value of ``lang``, null as the empty string.  Null texts are empty.  A
    document is good or toxic if any row of ``labels`` with its doc_id says so; unlabelled
    ones are neither.  Repeated rows count each; of rows with the smallest doc_id of a text
    none fails E.  Without documents there are no rows.  Other columns are not read.

    Result: 600 rows a part, as described in the module.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # 128 rows at most, whatever the size of the part
        counts: dict[int, Weight] = {}
        for mask, quality, toxic, n in rows[["mask", "quality", "toxic", "n"]].itertuples(index=False):
            before = counts.get(int(mask), NOTHING)
            counts[int(mask)] = tuple(int(b + n * f) for b, f in zip(before, (1, quality, toxic)))
        return pd.DataFrame([(key[0], *row) for row in audit_part(counts)], columns=names)

    return failure_counts(docs, labels).groupBy("part").applyInPandas(run, COLUMNS)
