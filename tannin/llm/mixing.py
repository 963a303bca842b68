"""Mixing sources to target weights by Sainte-Laguë apportionment.

Only DataFrame expressions.  Words are cut into blocks of ``block`` words.  Targets give
each source a whole number of blocks, a source's blocks go to its shards, both by highest
quotients size / (2 k + 1).  Inside a shard the documents follow each other in a seeded
order; the shard's quota takes whole rounds over its blocks and then a run of blocks that
starts at a seeded place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tannin.llm.words import WORD, text_column, word_count
from tannin.sources import sinks

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
#: Words of a block.
BLOCK = 16
#: Words of a source with a single shard; a shard is what one task orders.
SHARD = 4096


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            repeat: float = REPEAT) -> DataFrame:
    """Target words of each source, from its words (source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn.  The total is
    ``share`` of all words; a target stops at ``repeat`` times the source's words and the
    excess goes to the others by weight.  The level at which this settles is found by
    ordering sources by cap / weight: all before it are at their caps.
    One row per source is ordered in one task.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (turn % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(repeat))
    ordered = W.orderBy("ratio", F.col("source").asc_nulls_last())
    known = sizes.withColumn("turn", turn).withColumn("weight", weight).withColumn("cap", cap) \
        .withColumn("ratio", cap / F.col("weight"))
    everything = W.partitionBy()
    left = F.greatest(
        F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("cap_before"), F.lit(0.0))
    level = known.withColumn("cap_before", F.coalesce(
        F.sum("cap").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) \
        .withColumn("weight_from", F.sum("weight").over(ordered.rowsBetween(0, W.unboundedFollowing))) \
        .withColumn("level", left / F.col("weight_from"))
    # the level of the first source that is not above its cap holds for all after it
    first = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "turn", "level"))
    settled = F.min(first).over(everything)["level"]
    return level.withColumn("settled", settled).select(
        "source", "source_size", "turn",
        F.when(F.col("settled").isNull() | (F.col("settled") * F.col("weight") >= F.col("cap")), F.col("cap"))
        .otherwise(F.col("settled") * F.col("weight")).alias("target"))


def apportion(parties: DataFrame, weight: str, seats: Column, within: Sequence[str],
              order: Sequence[Column], quota: str = "quota") -> DataFrame:
    """Give ``seats`` to the parties of each group by highest quotients weight / (2 k + 1).

    Equal quotients go by ``order``.  Two divisors bound the right one: with the larger no
    more than ``seats`` are given, with the smaller no fewer.  Seats of the larger are
    certain, and only quotients between the two, at most two a party on average, are ranked.
    """
    group = W.partitionBy(*within)
    total = F.sum(weight).over(group)
    half = (F.count(F.lit(1)).over(group) + 1) / 2
    rounded = lambda n: F.floor(F.col(weight) * F.greatest(n, F.lit(0.0)) / F.col("_total") + 0.5)
    bounds = parties.withColumn("_seats", seats).withColumn("_total", total).withColumn("_half", half)
    certain = F.when(F.col("_total") > 0, F.greatest(
        rounded(F.col("_seats") - F.col("_half")) - 1, F.lit(0))).otherwise(F.lit(0)).cast("long")
    possible = F.when(F.col("_total") > 0, rounded(F.col("_seats") + F.col("_half")) + 1) \
        .otherwise(F.lit(0)).cast("long")
    keys = [c for c in parties.columns]
    rows = bounds.withColumn("_certain", certain).withColumn("_possible", possible) \
        .withColumn("_left", F.col("_seats") - F.sum("_certain").over(group)) \
        .withColumn("_k", F.explode_outer(F.when(
            F.col("_possible") > F.col("_certain"),
            F.sequence(F.col("_certain"), F.col("_possible") - 1)))) \
        .withColumn("_quotient", F.col(weight) / (2 * F.col("_k") + 1))
    rank = F.row_number().over(group.orderBy(F.col("_quotient").desc_nulls_last(), *order, "_k"))
    won = F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_left")), 1).otherwise(0)
    ranked = rows.withColumn("_rank", rank)
    return ranked.groupBy(*keys).agg(
        (F.first("_certain") + F.sum(won)).cast("long").alias(quota))


def _sized(docs: DataFrame, seed: int, *kept: Column) -> DataFrame:
    return docs.select(*kept, "source", word_count(text_column()).alias("_size"),
                       F.xxhash64(F.lit(seed), "doc_id", text_column()).alias("_order"))


def _placed(sized: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    # a row per source; Spark broadcasts it if its measured size allows, and else splits hot sources
    found = sized.join(goals, sized["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    return found.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.col("_shards")))


def mix(docs: DataFrame, columns: Sequence[str] | None = None, weights: Sequence[float] = WEIGHTS,
        share: float = SHARE, repeat: int = REPEAT, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """What the mix takes of every document.

    The rows of ``docs`` as struct ``_row`` (all columns, whatever their names, or those
    in ``columns``) with a struct ``mix``: size
    (words), source_size, target, taken (words, repeats counted), rounds (whole rounds
    over the document) and the ranges of words [lo, hi), [lo2, hi2) taken once more.

    A source of w words has about sqrt(w / SHARD) shards, so neither the number of shards
    nor the largest shard grows as fast as the data.

    Null sources are a source of their own, the last.  A document without words has size 0
    and takes nothing.  Rows with the same doc_id and text count each for itself, in any
    order, since they are alike.  No document exceeds ``repeat`` times its size.  An empty
    table gives an empty result.  A rerun gives the same.  The sizes are stored when this
    is called.
    """
    sizes = sinks.materialize(_sized(docs, seed))
    by_source = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"))
    goals = targets(by_source, weights, share, repeat) \
        .withColumn("_shards", F.ceil(F.sqrt((F.col("source_size") + 1) / SHARD)))
    seats = F.round(F.sum("target").over(W.partitionBy()) / block).cast("long")
    goals = sinks.store(apportion(goals, "target", seats, [], [F.col("turn")], "_blocks"), "goals")
    row = F.struct(*(F.col(f"`{c}`") for c in columns or docs.columns)).alias("_row")
    placed = _placed(_sized(docs, seed, row), goals, seed)

    shards = _placed(sizes, goals, seed).groupBy("turn", "_shard").agg(
        F.sum("_size").alias("_words"), F.first("_blocks").alias("_blocks"))
    quotas = apportion(shards, "_words", F.col("_blocks"), ["turn"], [F.col("_shard")], "_quota")
    quotas = quotas.select(F.col("turn").alias("_turn"), F.col("_shard").alias("_part"), "_words", "_quota")
    joined = placed.join(quotas, (placed["turn"] == quotas["_turn"]) & (placed["_shard"] == quotas["_part"]))

    ordered = W.partitionBy("turn", "_shard").orderBy("_order")
    begin = F.coalesce(F.sum("_size").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    count = F.ceil(F.col("_words") / block)
    start = F.when(F.col("_n") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "turn", "_shard"), F.col("_n"))) \
        .otherwise(0) * block
    run = joined.withColumn("_begin", begin).withColumn("_n", count) \
        .withColumn("_quota", F.least(F.col("_quota"), F.col("_n") * repeat)) \
        .withColumn("_rounds", F.when(F.col("_n") > 0, F.floor(F.col("_quota") / F.col("_n"))).otherwise(0)) \
        .withColumn("_more", (F.col("_quota") - F.col("_rounds") * F.col("_n")) * block) \
        .withColumn("_from", start)
    inside = lambda place: F.least(F.greatest(place - F.col("_begin"), F.lit(0)), F.col("_size"))
    reach = F.col("_from") + F.col("_more")
    over = reach - F.col("_n") * block  # what goes round to the first block
    lo, hi = inside(F.col("_from")), inside(F.least(reach, F.col("_n") * block))
    lo2, hi2 = F.lit(0), inside(F.greatest(over, F.lit(0)))
    taken = F.col("_rounds") * F.col("_size") + hi - lo + hi2
    mixed = F.struct(
        F.col("_size").alias("size"), F.col("source_size"), F.col("target"),
        taken.cast("long").alias("taken"), F.col("_rounds").cast("long").alias("rounds"),
        lo.cast("long").alias("lo"), hi.cast("long").alias("hi"),
        lo2.cast("long").alias("lo2"), hi2.cast("long").alias("hi2"))
    return run.select("_row", mixed.alias("mix"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: columns of ``docs``, a row for each round that takes a part.

    A whole document keeps its text; of one taken in part the text holds the words taken
    in that round, each with the white space after it.  A document taken in two rounds
    appears twice, one not taken is gone; a document without words is never taken.
    """
    mixed = mix(docs, **options).filter(F.col("mix.taken") > 0)
    extra = F.col("mix.taken") > F.col("mix.rounds") * F.col("mix.size")
    copies = F.col("mix.rounds") + F.when(extra, 1).otherwise(0)
    rows = mixed.withColumn("_round", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    whole = (F.col("_round") <= F.col("mix.rounds")) | (
        F.col("mix.hi") - F.col("mix.lo") + F.col("mix.hi2") >= F.col("mix.size"))
    pieces = F.regexp_extract_all(F.col("_row.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    held = F.concat_ws("", F.filter(pieces, lambda _, i: (
        (i >= F.col("mix.lo")) & (i < F.col("mix.hi"))) | (i < F.col("mix.hi2"))))
    text = F.when(whole, F.col("_row.text")).otherwise(held)
    return rows.select(*(
        text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
