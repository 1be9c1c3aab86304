"""Mixing sources to target weights along a curriculum, with DataFrame functions only.

Each source has a schedule: a weight that changes over training time, from 0 to 1, linearly
between knots. Its integral is the source's share of the mix, and so gives its target; the
integral up to a time is the demand for its words by then. A document lies at some place among its
source's words, and the time at which the demand reaches that place is its training position:
the inverse of a quadratic on one segment of the schedule. Sorting by position by ranges gives the
training order, whose mix at any time is that of the weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import keyed_join, written
from .sharding import string_ranks

#: About so many documents are put in order by one task, of all sources together.
PIECE_ROWS = 20_000
#: Bits of a document's place by hash, and of a piece's number at most (a source's pieces are summed up in one window).
_ORDER_BITS, _PIECE_BITS = 60, 20
WORD = r"[^\x20\x09-\x0D]+"


def cycled_schedules(docs: DataFrame, curves: list[list[tuple[float, float]]], source: str = "source") -> DataFrame:
    """A schedule for every source of docs: its sources by code point, null last, take the curves in turn.

    A curve is a list of knots (time, weight). Returns source, time and weight.
    """
    ranks = string_ranks(docs, source)
    values = ranks.select(F.col("value").alias("source"), F.col("rank"))
    if not docs.where(F.col(source).isNull()).isEmpty():
        last = ranks.agg((F.count("*") + 1).alias("rank")).select(F.lit(None).cast("string").alias("source"), "rank")
        values = values.unionByName(last)
    knots = F.array(*[F.array(*[F.struct(F.lit(float(t)).alias("time"), F.lit(float(w)).alias("weight")) for t, w in curve]) for curve in curves])
    picked = F.element_at(knots, (F.pmod(F.col("rank") - 1, F.lit(len(curves))) + 1).cast("int"))
    return values.select("source", F.explode(picked).alias("knot")).select("source", "knot.time", "knot.weight")


def integrals(schedule: DataFrame) -> DataFrame:
    """For each source of a schedule its weight, the integral over training time, and its segments.

    Weights are constant before the first knot and after the last, and never below 0; knots outside
    0 to 1 or with nulls are an error of the schedule and are left out. Of several knots at one
    time that of the greatest weight counts.
    """
    knots = schedule.where("time between 0 and 1 and weight is not null").groupBy("source", "time").agg(F.greatest(F.max("weight"), F.lit(0.0)).alias("weight"))
    ordered = Window.partitionBy("source").orderBy("time")
    steps = knots.withColumn("t1", F.lead("time").over(ordered)).withColumn("w1", F.lead("weight").over(ordered)).withColumn("n", F.row_number().over(ordered))
    inner = steps.where("t1 is not null").select("source", F.col("time").alias("t0"), "t1", F.col("weight").alias("w0"), "w1")
    first = steps.where("n = 1 and time > 0").select("source", F.lit(0.0).alias("t0"), F.col("time").alias("t1"), F.col("weight").alias("w0"), F.col("weight").alias("w1"))
    last = steps.where("t1 is null and time < 1").select("source", F.col("time").alias("t0"), F.lit(1.0).alias("t1"), F.col("weight").alias("w0"), F.col("weight").alias("w1"))
    upto = F.sum((F.col("w0") + F.col("w1")) / 2 * (F.col("t1") - F.col("t0"))).over(Window.partitionBy("source").orderBy("t0").rowsBetween(Window.unboundedPreceding, 0))
    areas = inner.unionByName(first).unionByName(last).withColumn("upto", upto)
    return areas.groupBy("source").agg(F.max("upto").alias("weight"), F.sort_array(F.collect_list(F.struct("t0", "t1", "w0", "w1", "upto"))).alias("segments"))


def capped_targets(sources: DataFrame, total: float, cap: float) -> DataFrame:
    """Add to each source (source_size, weight) its target: total shared by weight, cap times its size at most.

    What is above goes to the others by weight until no target is above. Each round sums up all
    sources; what reaches the driver is one row. The words a unit of weight gets only rise from
    round to round, so a source that was held once stays held.
    """
    room = F.col("source_size") * F.lit(float(cap))
    weight = F.col("weight").cast("decimal(38,12)")  # sums of decimals don't depend on their order
    level, held = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > room
        row = sources.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)).alias("size"), F.coalesce(F.sum(F.when(~over, weight)), F.lit(0)).cast("double").alias("weight")).collect()[0]
        if row["n"] <= held or not row["weight"]:
            break
        held, level = row["n"], (float(total) - float(cap) * row["size"]) / row["weight"]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), room))


def _inverse(segments: Column, area: Column) -> Column:
    """The time at which the integral of a schedule reaches an area."""
    at = F.coalesce(F.get(F.filter(segments, lambda s: s["upto"] >= area), F.lit(0)), F.element_at(segments, -1))

    def solved(s: Column) -> Column:
        span = s["t1"] - s["t0"]
        into = F.greatest(area - (s["upto"] - (s["w0"] + s["w1"]) / 2 * span), F.lit(0.0))
        slope = (s["w1"] - s["w0"]) / span
        root = s["w0"] + F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * into, F.lit(0.0)))
        return s["t0"] + F.least(F.when(root > 0, 2 * into / root).otherwise(F.lit(0.0)), span)

    return F.element_at(F.transform(F.array(at), solved), 1)


def curriculum(docs: DataFrame, schedule: DataFrame, share: float = 1.0, cap: float = 2.0, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """What a mix takes of each document, and at which training positions.

    The mix has ``share`` times the words of docs. schedule: source, time, weight (see
    integrals); sources that it doesn't name have a target of 0. Returns doc_id, source, size
    (words of the whole text), source_size, target (words that the mix is to take of the source),
    taken, copies (copy from 0, words, position from 0 to 1) and place (a hash, in whose order a
    source's documents are laid end to end, again and again until the target is reached, to the word).

    So a source's words differ from its target by less than one, and of each document as many copies
    are taken as of any other, or one more, of which one in each source is cut off. Places hang on
    doc_id and text alone: reruns agree, and so do all ways of partitioning. Null texts are empty,
    and texts without a word have no copies; a null source is a source; rows alike in doc_id, source
    and text are laid side by side. An empty table gives no rows; further columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    name = F.md5(F.encode(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(" "), body), "UTF-8"))
    place = F.conv(F.substring(name, 1, _ORDER_BITS // 4), 16, 10).cast("long")
    # one small row for each document: the texts are read once
    base = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), place.alias("order")), "mix-rows")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    known = integrals(schedule).withColumnRenamed("source", "_source")
    joined = sizes.join(known, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    sources = written(joined.withColumn("weight", F.coalesce("weight", F.lit(0.0))), "mix-sources")
    totals = sources.agg(F.sum("source_size").alias("size"), F.sum("n").alias("n")).collect()[0]
    targets = written(capped_targets(sources, float(share) * (totals["size"] or 0), cap).drop("n"), "mix-targets")

    bits = min(_PIECE_BITS, max(0, math.ceil(math.log2(max(1, (totals["n"] or 0) / PIECE_ROWS)))))
    counted = base.groupBy("source", F.shiftright("order", _ORDER_BITS - bits).alias("piece"), "order", "doc_id", "size").agg(F.count("*").alias("n"))
    inside = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("source", "piece").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    pieces = base.groupBy("source", F.shiftright("order", _ORDER_BITS - bits).alias("piece")).agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = pieces.select(F.col("source").alias("_source"), F.col("piece").alias("_piece"), F.coalesce(before, F.lit(0)).alias("before"))
    laid = counted.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("piece") == F.col("_piece")))
    # rows alike were counted once; here they are listed again, one after the other
    spread = laid.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    spread = spread.select("doc_id", "source", "size", "order", (F.col("before") + F.col("inside") + F.col("nth") * F.col("size")).alias("start"))

    named = targets.withColumnRenamed("source", "_source")
    mixed = keyed_join(spread, named, F.col("source").eqNullSafe(F.col("_source")), F.col("order")).drop("_source")
    goal = F.floor(F.col("target") + F.lit(0.5))
    rounds = F.when(F.col("source_size") > 0, F.ceil(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("int")

    def copy(k: Column) -> Column:
        at = k * F.col("source_size") + F.col("start")
        words = F.greatest(F.least(F.col("size"), goal - at), F.lit(0).cast("long"))
        area = (at + words / F.lit(2.0)) / goal * F.col("weight")
        return F.struct(k.cast("int").alias("copy"), words.alias("words"), F.when(words > 0, _inverse(F.col("segments"), area)).alias("position"))

    every = F.when(rounds > 0, F.transform(F.sequence(F.lit(0), rounds - 1), copy)).otherwise(F.array())
    out = mixed.withColumn("copies", F.filter(every, lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", F.col("order").alias("place"))


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each copy, sorted by its training position: doc_id, source, copy, words, position."""
    return mixed.select("doc_id", "source", "place", F.inline("copies")).orderBy("position", "place", "copy").drop("place")
