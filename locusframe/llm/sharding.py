"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

Every node of the tree is split across its widest metadata dimension at the weighted median
of the sizes, all nodes of a level at once, until the leaves reach the target bytes. Nodes and their cuts are
tables, joined to the rows by the node that these have come to. The medians come from
distributed histograms that are refined to single positions; of nodes and cells only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import keyed_join, written

DIMENSIONS = ("source", "lang", "n_chars")
#: Cells of a pass over all open nodes together, and of one node at most.
CELLS, NODE_CELLS = 1 << 18, 1 << 12
SLOT_ROWS = 20_000
_TIE_BITS = 24
#: Positions of numbers: steps of this share of a doubling.
_STEPS = 1024
#: Ranks of up to so many values (about 100 bytes each) are broadcast; beyond, the join is salted.
BROADCAST_VALUES = 100_000
SALTS = 64


def string_ranks(docs: DataFrame, name: str) -> DataFrame:
    """value and rank (from 1, in order, without gaps) of the distinct values of a column, but null."""
    values = docs.select(F.col(name).alias("value")).where("value is not null").distinct().orderBy("value")
    # numbers grow with the order inside a partition of the sort, and from one to the next
    placed = written(values.select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("number")), "kd-values")
    sizes = placed.groupBy("part").count()  # a row for each partition
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = F.broadcast(sizes.select("part", before.alias("before")))
    return placed.join(firsts, "part").select("value", (F.col("before") + F.col("number").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))


def _with_ranks(rows: DataFrame, docs: DataFrame, name: str, out: str) -> DataFrame:
    """Replace the column ``out`` of rows, a value of the dimension, by its rank; null has 0."""
    ranks = written(string_ranks(docs, name), "kd-ranks")
    if ranks.count() <= BROADCAST_VALUES:
        joined = rows.join(F.broadcast(ranks), F.col(out) == F.col("value"), "left")
    else:  # each rank in SALTS copies, so that a frequent value is dealt to as many tasks
        copies = ranks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(copies, (F.col(out) == F.col("value")) & (F.pmod("tie", F.lit(SALTS)) == F.col("copy")), "left")
    return joined.select(*[F.coalesce("rank", F.lit(0)).alias(c) if c == out else rows[c] for c in rows.columns])


def _number(name: str) -> Column:
    """A number's position: by its logarithm, 0 for null and for what isn't above 0."""
    number = F.col(name).cast("double")
    return F.coalesce(F.floor(F.log2(F.when((number > 0) & ~F.isnan(number), number) + 1.0) * _STEPS), F.lit(0)).cast("long")


def _key(axes: list[str]) -> Column:
    """A row's place along the axis of its node (column ``axis``): the position, then the tie hash."""
    return F.element_at(F.array(*[F.shiftleft(F.col(a), _TIE_BITS) + F.col("tie") for a in axes]), F.col("axis") + 1)


def _at_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows with the columns of their node."""
    return keyed_join(rows, nodes.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), F.col("tie")).drop("_node")


def _split_axes(rows: DataFrame, nodes: DataFrame, axes: list[str], span: dict[str, int]) -> DataFrame:
    """The open nodes (node, leaves) with their widest axis, the range of its keys (low, high) and the size that goes left (goal)."""
    bounds = rows.groupBy("node").agg(F.sum("size").alias("size"), *[f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max)])
    wide = F.array_max(F.array(*[F.struct(((F.col(f"max_{a}") - F.col(f"min_{a}")) / F.lit(span[a])).alias("width"), F.lit(-i).alias("at")) for i, a in enumerate(axes)]))
    opened = bounds.join(nodes.where("leaves > 1"), "node").withColumn("axis", -wide["at"])
    ends = [F.element_at(F.array(*[F.col(f"{f}_{a}") for a in axes]), F.col("axis") + 1) for f in ("min", "max")]
    goal = F.greatest(F.lit(1), F.expr("(size * (leaves div 2)) div leaves"))
    return opened.select("node", "leaves", "axis", F.shiftleft(ends[0], _TIE_BITS).alias("low"), (F.shiftleft(ends[1] + 1, _TIE_BITS) - 1).alias("high"), goal.cast("long").alias("goal"), F.lit(None).cast("long").alias("cut"))


def _cuts(rows: DataFrame, opened: DataFrame, axes: list[str]) -> DataFrame:
    """The open nodes with their cut: the key whose sizes up to and with it come nearest to the goal.

    Each pass cuts the range that holds a node's median into cells, sums them up by one aggregation and goes on
    with the cell in which the goal is reached. All nodes' cells together are CELLS at most (two for each node at least).
    """
    nodes = written(opened, "kd-nodes")
    while n := nodes.where("cut is null").count():
        bins = max(2, min(NODE_CELLS, CELLS // n))
        wide = nodes.where("cut is null").withColumn("width", F.expr(f"(high - low) div {bins} + 1"))
        at = _at_nodes(rows.select("node", "size", "tie", *axes), written(wide, "kd-open")).withColumn("key", _key(axes)).where("key between low and high")
        cells = at.groupBy("node", F.expr("(key - low) div width").alias("cell")).agg(F.sum("size").alias("cell_size"))
        upto = cells.withColumn("upto", F.sum("cell_size").over(Window.partitionBy("node").orderBy("cell")))  # NODE_CELLS rows of a node at most
        found = upto.join(wide, "node").where("upto >= goal and upto - cell_size < goal")
        start = F.col("low") + F.col("cell") * F.col("width")
        left = F.col("goal") - (F.col("upto") - F.col("cell_size"))
        last = F.least(F.col("high"), start + F.col("width") - 1)
        cut = F.when(last == start, F.when(2 * left < F.col("cell_size"), start - 1).otherwise(start))
        narrowed = found.select("node", "leaves", "axis", start.alias("low"), last.alias("high"), left.alias("goal"), cut.alias("cut"))
        nodes = written(nodes.where("cut is not null").unionByName(narrowed), "kd-nodes")
    return nodes


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Assign each document to a leaf of a k-d tree of near equal bytes.

    Give ``shards``, the number of leaves, or ``target_bytes``, the size that no leaf exceeds
    by more than rounding. Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32,
    the position in each dimension, tie, shard, and slot (gapless from 0 in each shard).

    A string's position is its rank among the distinct values, a number's its logarithm.
    Documents that agree in the dimension which is split are told apart by a hash of text and
    doc_id, so no value, however frequent, is bound to one shard, and equal texts of different
    documents are spread. Rows with one position and one hash stay together; so do rows alike
    in text and doc_id. Null texts count as empty, null metadata as the least value; an empty
    table has no shards; further columns are ignored.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    dimensions = tuple(d for d in dimensions if d in docs.columns)
    body = F.coalesce(F.col(text), F.lit(""))
    tie = F.shiftrightunsigned(F.xxhash64(body, F.col(doc_id)), 64 - _TIE_BITS)
    strings = [d for d in dimensions if dict(docs.dtypes)[d] == "string"]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        tie.cast("long").alias("tie"),
        *[(F.col(d) if d in strings else _number(d)).alias(f"at_{d}") for d in dimensions],
    )
    for d in strings:
        rows = _with_ranks(rows, docs, d, f"at_{d}")
    # one small row for each document: the texts are read once, and not again for each level
    base = written(rows, "kd-rows")
    if shards is None:
        total = base.agg(F.sum("size")).collect()[0][0] or 0
        shards = max(1, -(-total // target_bytes))
    axes = [f"at_{d}" for d in dimensions] or ["tie"]
    whole = base.agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes]).collect()[0]
    span = {a: max(1, whole[a] or 0) for a in axes}

    # a node is named by the first of its leaves, so rows that go left keep their node's name, and a leaf's name is its shard
    rows = base.withColumn("node", F.lit(0).cast("long"))
    nodes = docs.sparkSession.range(1).select(F.col("id").alias("node"), F.lit(shards).cast("long").alias("leaves"))
    for _ in range((shards - 1).bit_length()):
        cuts = _cuts(rows, _split_axes(rows, nodes, axes, span), axes)
        half = F.expr("leaves div 2")
        known = nodes.join(cuts.select("node", "axis", "cut"), "node", "left").select("node", "leaves", F.coalesce("axis", F.lit(0)).alias("axis"), "cut", half.alias("half"))
        known = written(known, "kd-cuts")
        moved = F.when(F.col("cut").isNotNull() & (_key(axes) > F.col("cut")), F.col("node") + F.col("half")).otherwise(F.col("node"))
        # one written table a level: a level's work is one join with its nodes, however many there are
        rows = written(_at_nodes(rows, known).withColumn("node", moved).select(*base.columns, "node"), "kd-rows")
        split = known.where("leaves > 1")
        nodes = known.where("leaves = 1").select("node", "leaves").unionByName(split.select("node", F.col("half").alias("leaves"))).unionByName(split.select((F.col("node") + F.col("half")).alias("node"), (F.col("leaves") - F.col("half")).alias("leaves")))
    rows = rows.withColumn("shard", F.col("node").cast("int"))
    return _slots(rows).select("doc_id", "size", "text_crc32", *[f"at_{d}" for d in dimensions], "tie", "shard", "slot")


def _slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without a gap.

    Rows are numbered inside small pieces of a shard (by ranges of the tie hash); a piece's
    first number comes from the sum over the pieces before it.
    """
    pieces = max(1, min(1 << 20, rows.count() // SLOT_ROWS))
    cut = rows.withColumn("piece", F.expr(f"(tie * {pieces}) div {1 << _TIE_BITS}"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    first = cut.groupBy("shard", "piece").count().select("shard", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("tie", "doc_id"))
    numbered = cut.withColumn("inside", inside)
    return numbered.join(first, ["shard", "piece"]).withColumn("slot", (F.col("first") + F.col("inside") - 1).cast("long"))
