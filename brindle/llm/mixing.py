"""Mixing sources to target weights along a time-varying curriculum.

1. Sizes are words. A source's target is its weight's share of all sizes, at most
   LIMIT times its size; the excess goes to the others by weight.
2. A source's words form a stream: its documents in the order of a hash, whole
   passes first, then a part of one more. The hash order is cut into equal
   ranges so that no task holds a whole source: totals of ranges are summed
   first, running totals follow within each range.
3. A weight schedule says how fast a source is drawn at each moment of the
   training. Its integral, inverted, gives the moment at which each copy of a
   document is due; documents are range-sorted by it.

Only sums per source and per (source, range) are gathered; no text is shuffled
before the copies are known.

Defined results: a null text has size 0; a null source is a source of its own,
the last; a source without words has target 0; very long texts are counted whole;
repeated rows count each; ties in the hash order go by doc_id, then size, and equal
rows are interchangeable; an empty table gives none. Extra columns are kept by
mix(), not read by the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.shared import row_key, word_count, written

WEIGHTS, LIMIT = (5.0, 2.0, 1.0), 3
#: Documents that a range of one source's hash order holds on average, at most.
RANGE_ROWS = 1_000
#: Documents over so many times their source's mean size are taken before shorter ones, which then even out.
TIERS = (1.0, 0.25)
#: Of a schedule that falls (or rises) linearly: the rate at the start; at the end it is 2 less that.
START_RATES = (0.5, 1.0, 1.5)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row per source: source, weight, start_rate, n_rows, source_size, target.

    sizes: source and size. Targets are weight * level, where they are below
    limit * source_size. The sources in the order of the level at which they
    fill up, with the sums before each, give the one level at which all targets
    together are the total.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    # UTF-8's byte order is that of code points.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by_place = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (place % len(xs) + 1).cast("int"))
    per = per.select("*", by_place(list(map(float, weights))).alias("weight"), by_place(list(START_RATES)).alias("start_rate"))
    cap = limit * F.col("source_size")
    per = per.withColumn("fills_at", cap / F.col("weight"))
    every = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    upto, after, all_rows = every.rowsBetween(Window.unboundedPreceding, 0), every.rowsBetween(0, Window.unboundedFollowing), every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select("*", (F.sum(cap).over(upto) - cap).alias("filled"), F.sum("weight").over(after).alias("open_weight"), F.sum("source_size").over(all_rows).alias("total"))
    level = (F.col("total") - F.col("filled")) / F.col("open_weight")
    # Levels fall once sources count as filled that are not, so the largest feasible one is right.
    per = per.withColumn("level", F.max(F.when(level <= F.col("fills_at"), level)).over(all_rows))
    target = F.when(F.col("fills_at") <= F.col("level"), cap.cast("double")).otherwise(F.col("weight") * F.col("level"))
    return per.select("source", "weight", "start_rate", "n_rows", "source_size", F.least(target, cap.cast("double")).alias("target"))


def stream_positions(docs: DataFrame, targets: DataFrame, key: Sequence[str]) -> DataFrame:
    """docs (source, size, the columns of key) with tier and before: the words of its source and tier ahead of it.

    The order is that of a hash of key, then key itself: the same in each run
    and for any number of ranges.
    """
    salt = F.xxhash64(*key, F.lit(7)).bitwiseAND(F.lit(2**62 - 1))
    mean = F.col("source_size") / F.col("n_rows")
    tier = F.lit(len(TIERS)) - sum((F.col("size") > mean * t).cast("int") for t in TIERS)
    ranged = docs.withColumn("__h", salt).join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    ranged = ranged.withColumns({"tier": tier, "__r": F.floor(F.col("__h") / F.lit(float(2**62)) * F.ceil(F.col("n_rows") / RANGE_ROWS))})
    totals = ranged.groupBy("source", "tier", "__r").agg(F.sum("size").alias("__sum"))
    ahead = Window.partitionBy("source", "tier").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("__s"), F.col("tier").alias("__t"), F.col("__r").alias("__q"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    within = Window.partitionBy("source", "tier", "__r").orderBy("__h", *key, "size").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("tier") == F.col("__t")) & (F.col("__r") == F.col("__q"))
    both = ranged.withColumn("__upto", F.sum("size").over(within)).join(totals, same)
    return both.withColumn("before", F.col("__ahead") + F.col("__upto") - F.col("size")).drop("__h", "__r", "__s", "__t", "__q", "__ahead", "__upto")


def with_copies(placed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """placed (of stream_positions) with copies: how often a document is taken, what place() needs.

    All documents are taken in whole passes. Of the part that is left of the
    target each tier, long documents first, gives its share and what the tiers
    before it gave too little (or too much): documents whose middle lies before
    that mark. What is missed in the end is half a short document.
    """
    part = F.when(F.col("passes") < limit, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0)
    placed = placed.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("part", part)
    taken = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2.0 <= F.col("mark"))
    per_tier = placed.groupBy("source", "tier").agg(F.sum("size").alias("tier_size"), F.first("part").alias("part"), F.first("source_size").alias("source_size"))
    share = F.when(F.col("source_size") > 0, F.col("part") * F.col("tier_size") / F.col("source_size")).otherwise(0.0)
    marks = per_tier.select(F.col("source").alias("__s"), F.col("tier").alias("__t"), share.alias("share"))
    here = F.col("source").eqNullSafe(F.col("__s")) & (F.col("tier") == F.col("__t"))
    owed, done = None, None
    for t in range(len(TIERS) + 1):
        mine = marks.filter(F.col("__t") == t)
        if owed is None:
            mark = mine.withColumn("mark", F.col("share"))
        else:
            mark = mine.join(owed, F.col("__s").eqNullSafe(F.col("__o")), "left").withColumn("mark", F.col("share") + F.coalesce(F.col("owed"), F.lit(0.0))).drop("__o", "owed")
        mark = written(mark, "mark")
        done = mark if done is None else done.unionByName(mark)
        got = placed.join(mark, here).groupBy("source").agg(F.sum(F.when(taken, F.col("size")).otherwise(0)).alias("got"), F.first("mark").alias("mark"))
        gave = got.select(F.col("source").alias("__g"), (F.col("mark") - F.col("got")).alias("gap"))
        every = written(placed.select(F.col("source").alias("__o")).distinct() if owed is None else owed, "sources")
        before = F.lit(0.0) if owed is None else F.col("owed")
        owed = every.join(gave, F.col("__o").eqNullSafe(F.col("__g")), "left").select("__o", F.coalesce(F.col("gap"), before).alias("owed"))
    sizes = per_tier.select(F.col("source").alias("__b"), F.col("tier").alias("__u"), "tier_size")
    found = placed.join(done.drop("share"), here).join(sizes, F.col("source").eqNullSafe(F.col("__b")) & (F.col("tier") == F.col("__u")))
    return found.withColumn("copies", (F.col("passes") + taken.cast("int")).cast("int")).drop("__s", "__t", "__b", "__u")


def place(copy: Column | int = 0) -> Column:
    """The words that a source has given before a copy (from 0) of a document.

    The tiers of a pass interleave: a document's share of its tier's words (in
    the last, partial pass: of those taken) is its share of the pass.
    """
    copy = F.lit(copy) if isinstance(copy, int) else copy
    whole = copy < F.col("passes")
    share = F.col("before") / F.greatest(F.when(whole, F.col("tier_size").cast("double")).otherwise(F.col("mark")), F.lit(1.0))
    return copy * F.col("source_size") + F.least(share, F.lit(1.0)) * F.when(whole, F.col("source_size")).otherwise(F.col("part"))


def due(words_before: Column, target: Column, start_rate: Column) -> Column:
    """The moment (0 to 1) at which a source has given so many words.

    A rate that runs linearly from a to 2 - a has the integral a t + (1 - a) t^2;
    the share of the target, put equal to it, is solved for t.
    """
    share = F.least(F.greatest(words_before / target, F.lit(0.0)), F.lit(1.0))
    bend = 1.0 - start_rate
    root = F.sqrt(F.greatest(start_rate * start_rate + 4.0 * bend * share, F.lit(0.0)))
    return F.when(target <= 0, F.lit(0.0)).otherwise(2.0 * share / (start_rate + root))


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and what due(place()) needs: one row per document."""
    rows = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return with_copies(written(stream_positions(rows, source_targets(rows), ["doc_id"]), "streams"))


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, first_due (the moment of the first copy; null if none is taken), range-sorted by it.

    The rows stand in training order: those of a partition before all of the next, documents that are not taken last.
    """
    first = F.when(F.col("copies") > 0, due(place(), F.col("target"), F.col("start_rate")))
    plan = mix_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", first.alias("first_due"))
    order = [F.col("first_due").asc_nulls_last(), F.col("doc_id").asc_nulls_first()]
    return plan.repartitionByRange(*order).sortWithinPartitions(*order)


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents in training order: each row of docs as often as it is taken, range-sorted by the moment due.

    The plan is made from sizes alone and joined to the rows by a hash of the whole row; equal rows are interchangeable.
    """
    keyed = docs.withColumn("__key", row_key(docs))
    rows = keyed.select("__key", "source", word_count(F.col("text")).alias("size")).groupBy("__key", "source").agg(F.sum("size").alias("size"))
    # Equal rows stand side by side in the stream, as one of their joint size.
    stream = written(rows, "sizes")
    placed = with_copies(written(stream_positions(stream, source_targets(stream), ["__key"]), "streams"))
    plan = placed.filter("copies > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("__copy"))
    plan = plan.select("__key", due(place(F.col("__copy")), F.col("target"), F.col("start_rate")).alias("__due"))
    mixed = keyed.join(plan, "__key")
    return mixed.repartitionByRange("__due", "__key").sortWithinPartitions("__due", "__key").select(*(F.col(f"`{c}`") for c in docs.columns))
