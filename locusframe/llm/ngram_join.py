"""Similarity self-join on word shingles: MinHash LSH forest and exact verification.

Texts with equal shingle sets form one class. Each class gets a MinHash signature for every
tree of the forest. A tree is the sorted order of its signatures, in which the prefixes that
neighbours share are the nodes of a prefix trie. Classes that share a prefix of the full depth
meet first, and are verified by the exact Jaccard similarity of their shingle sets. The least
similar links found so tell how far prefixes have to be shortened until such links are found
with the target recall; classes that share the shorter prefix meet next, and so on.

Verification runs on pairs of blocks of bounded size. Blocks are laid so that classes that meet
lie together where possible; a large group of near copies spans several blocks, and each
pair of blocks is one small task. Links are counted there, and never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_batches, skewed_join, written
from .textscan import mix, shingle_sets, slices

TREES = 32
#: Hash values of a signature, and bytes of each.
DEPTH, VALUE_BYTES = 8, 2
TARGET_RECALL = 0.9999
#: Links are told apart by similarity in bands of this width.
BAND = 0.05
BLOCK = 256
#: A node that lies in more blocks, and a block that is in more pairs, is dealt to several tasks.
DEAL = 64


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that two sets of the given similarity share a prefix of some depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortened(bands: list[float], depth: int, trees: int = TREES, target: float = TARGET_RECALL) -> int:
    """The longest prefix, up to depth, that finds links of all the given similarities with the target recall."""
    while depth > 1 and any(recall(s, depth, trees) < target for s in bands):
        depth -= 1
    return depth


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def signature(shingles: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The least value of each of trees x depth hash functions."""
    a, b = _factors(trees * depth)
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 256):
        values = (low[k : k + 256] * a[:, None] + b[:, None]) ^ high[k : k + 256]
        np.minimum(least, values.min(axis=1), out=least)
    return least.reshape(trees, depth)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text the 128-bit hash of its shingle set, and its signatures: for each tree DEPTH values."""
    for batch in batches:
        h1, h2, signatures = [], [], []
        for part in slices(batch["text"]):
            for s in shingle_sets(part):
                if not len(s):
                    h1.append(None)
                    h2.append(None)
                    signatures.append(None)
                    continue
                h1.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                h2.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(len(s)))).astype(np.int64)))
                signatures.append(signature(s, TREES, DEPTH).astype(">u2").tobytes())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(signatures, pa.binary())], ["doc_id", "text_key", "h1", "h2", "signatures"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for part in slices(batch["text"]) for s in shingle_sets(part)]
        yield pa.RecordBatch.from_arrays([batch["rep"], pa.array(sets, pa.binary())], ["rep", "shingles"])


def _tries(shortest: int):
    """Walk over sorted (tree, label, rep); keeps those that share a prefix of the shortest length or
    more with a neighbour, with its length.

    The first and last row of a partition may share theirs with the partition next to it, and
    are kept with the full length. Any other row that shares a prefix with a row of another
    partition shares it with the first or last of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "label", "rep", "shared"]

        def lengths(tree: np.ndarray, values: np.ndarray) -> np.ndarray:
            """Lengths of the prefixes that each row shares with the next."""
            same = values[1:] == values[:-1]
            upto = np.where(same.all(axis=1), DEPTH, same.argmin(axis=1))
            return np.where(tree[1:] == tree[:-1], upto, 0)

        held, before = None, DEPTH
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            values = np.frombuffer(b"".join(whole["label"].to_pylist()), ">u2").reshape(-1, DEPTH)
            after = lengths(whole["tree"].to_numpy(), values)
            longest = np.maximum(np.concatenate([[before], after[:-1]]), after) if len(after) else after
            keep = np.flatnonzero(longest >= shortest)
            ready = whole.slice(0, len(longest)).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*ready.columns, pa.array(longest[keep].astype(np.int32))], names)
            held = whole.slice(len(longest))
            before = int(after[-1]) if len(after) else before
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([DEPTH], pa.int32())], names)

    return run


def forest(classes: DataFrame, shortest: int = 1) -> DataFrame:
    """The sorted signatures of all trees: tree, label, rep, and the longest prefix shared with a neighbour.

    Ranges are cut by rep, too, so that a label that very many classes have is dealt to several tasks.
    """
    width = DEPTH * VALUE_BYTES
    label = F.expr(f"posexplode(transform(sequence(0, {TREES - 1}), t -> substring(signatures, t * {width} + 1, {width})))").alias("tree", "label")
    rows = classes.select(label, "rep")
    return rows.repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label", "rep").mapInArrow(_tries(shortest), "tree int, label binary, rep long, shared int")


def _keys(signatures: np.ndarray, depth: int) -> np.ndarray:
    """A 64-bit key for each row's and tree's prefix of some depth."""
    key = np.zeros(signatures.shape[:2], np.uint64)
    for k in range(depth):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, :, k] + np.uint64(1))
    return key


def _meetings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a and of b share a key in some tree."""
    met = np.zeros((len(a), len(b)), bool)
    for t in range(a.shape[1]):
        met |= a[:, t, None] == b[None, :, t]
    return met


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, by way of their common shingles."""
    va, oa = np.concatenate(a), np.repeat(np.arange(len(a)), [len(x) for x in a])
    vb, ob = np.concatenate(b), np.repeat(np.arange(len(b)), [len(x) for x in b])
    common = np.intersect1d(va, vb)
    shared = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, len(common), 4096):
        piece = common[k : k + 4096]
        sides = []
        for v, o, n in ((va, oa, len(a)), (vb, ob, len(b))):
            at = np.searchsorted(piece, v)
            hit = (at < len(piece)) & (piece[np.minimum(at, len(piece) - 1)] == v)
            grid = np.zeros((n, len(piece)), np.float32)
            grid[o[hit], at[hit]] = 1
            sides.append(grid)
        shared += sides[0] @ sides[1].T
    return shared


_FOUND = "rep long, links long, other long, band int"


def _verify(threshold: float, depth: int, above: int | None):
    """Verify the pairs of two blocks that share a prefix of ``depth``, but none of length ``above``."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of each class, edges of a spanning forest, and links (of classes) by band."""
        first, second = key
        pdf = pdf.sort_values("rep", kind="stable").reset_index(drop=True)
        left = pdf[pdf["block"] == first].reset_index(drop=True)
        right = left if first == second else pdf[pdf["block"] == second].reset_index(drop=True)
        empty = pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("rep", "int64"), ("links", "int64"), ("other", "int64"), ("band", "Int32"))})
        if not len(left) or not len(right):
            return empty
        labels = [np.frombuffer(b"".join(x["signatures"]), ">u2").astype(np.uint64).reshape(len(x), TREES, DEPTH) for x in (left, right)]
        met = _meetings(*(_keys(x, depth) for x in labels))
        if above is not None:
            met &= ~_meetings(*(_keys(x, above) for x in labels))
        met &= left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :]
        if first == second:
            met &= np.triu(np.ones(met.shape, bool), 1)
        if not met.any():
            return empty
        rows, columns = np.flatnonzero(met.any(axis=1)), np.flatnonzero(met.any(axis=0))
        a = [np.frombuffer(left["shingles"][i], np.uint64) for i in rows]
        b = [np.frombuffer(right["shingles"][j], np.uint64) for j in columns]
        shared = _shared(a, b)
        union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - shared
        inner = met[np.ix_(rows, columns)] & (shared >= threshold * union - 1e-6)
        linked = np.zeros(met.shape, bool)
        linked[np.ix_(rows, columns)] = inner
        if not linked.any():
            return empty
        ids = (left["rep"].to_numpy(), right["rep"].to_numpy())
        count = [linked @ right["copies"].to_numpy(np.int64), linked.T @ left["copies"].to_numpy(np.int64)]
        frames = [pd.DataFrame({"rep": x[n > 0], "links": n[n > 0], "other": x[n > 0]}) for x, n in zip(ids, count, strict=True)]
        i, j = np.nonzero(linked)
        frames.append(pd.DataFrame(_forest(ids[0][i], ids[1][j]), columns=["rep", "other"]).assign(links=0)[["rep", "links", "other"]])
        found = pd.concat(frames, ignore_index=True).assign(band=pd.Series(dtype="Int32"))
        band, n = np.unique(((shared[inner] / union[inner] - threshold) / BAND + 1e-6).astype(int).clip(0), return_counts=True)
        return pd.concat([found, pd.DataFrame({"rep": -1, "links": n, "other": -1, "band": pd.Series(band, dtype="Int32")})], ignore_index=True)

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(member, least id of its component), for the graph of the given edges, without the least themselves."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in root if find(x) != x]


def connected(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: id, root (the least id of its component).

    edges has columns rep and other. Least labels spread along the edges and each node then
    takes its label's label, so the rounds grow with the logarithm of a path's length. Every
    round is written to the shared folder; only the number of changes reaches the driver.
    """
    both = written(edges.select(F.col("rep").alias("id"), "other").union(edges.select(F.col("other").alias("id"), F.col("rep").alias("other"))).distinct(), "edges")
    labels = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("root"), F.count("*").alias("degree")), "labels")
    while True:
        # the middle of a star is met by all its edges, and a root by all its nodes
        told = skewed_join(both, labels.select(F.col("id").alias("other"), F.col("root").alias("seen"), "degree"), ["other"], "degree")
        seen = told.groupBy("id").agg(F.min("seen").alias("seen"))
        near = written(labels.join(seen, "id").select("id", F.least("root", "seen").alias("near"), F.col("root").alias("before"), "degree"), "near-labels")
        up = labels.select(F.col("id").alias("near"), F.col("root").alias("up"))
        ups = written(near.groupBy("near").agg(F.count("*").alias("n")).join(up, "near"), "labels-of-labels")
        after = written(skewed_join(near, ups, ["near"], "n").select("id", F.least("near", "up").alias("root"), "before", "degree"), "labels")
        changed = after.where("root <> before").limit(1).count()
        labels = after.select("id", "root", "degree")
        if not changed:
            return labels.drop("degree")


def _blocks(live: DataFrame) -> DataFrame:
    """rep, place and block of the classes in ``live`` (rep, node, least).

    Classes that meet get the same place, as far as two rounds of least labels tell. Small
    places share blocks; a large place is cut into blocks of bounded size, the first of which is
    its ``main`` one.
    """
    place = live.groupBy("rep").agg(F.min("least").alias("place"))
    lower = live.join(place, "rep").groupBy("node").agg(F.min("place").alias("place"))
    place = live.join(lower, "node").groupBy("rep").agg(F.min("place").alias("place"))
    placed = written(place, "places")
    sizes = written(placed.groupBy("place").agg(F.count("*").alias("size")), "place-sizes")
    small = F.pmod(F.xxhash64("place"), F.lit(max(1, 2 * placed.count() // BLOCK)))
    cut = F.pmod(F.xxhash64("rep"), F.expr(f"(size + {BLOCK - 1}) div {BLOCK}"))
    own = lambda k: -1 - F.pmod(F.xxhash64("place", k), F.lit((1 << 62) - 1))
    large = F.col("size") > BLOCK
    joined = skewed_join(placed, sizes, ["place"], "size")
    return written(joined.select("rep", "place", F.when(large, own(cut)).otherwise(small).alias("block"), F.when(large, own(F.lit(0).cast("long"))).alias("main")), "blocks")


def _dealt(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Two sides of a self-join on ``key``: each row once with a deal, and once for each deal of its key."""
    sizes = written(rows.groupBy(key).agg(F.count("*").alias("n"), ((F.count("*") - 1) / DEAL).cast("int").alias("deals")), "deals")
    sized = skewed_join(rows, sizes, [key], "n").drop("n")
    once = sized.withColumn("deal", F.pmod(F.xxhash64("block"), F.col("deals") + 1).cast("int")).drop("deals")
    return once, sized.withColumn("deal", F.explode(F.sequence(F.lit(0), "deals"))).drop("deals")


def _pairs_at_nodes(live: DataFrame, blocks: DataFrame, mark: Column) -> DataFrame:
    """Pairs of blocks that have classes at one node, of which at least one side is marked."""
    touched = written(live.join(blocks.select("rep", "block"), "rep").groupBy("node", "block").agg(F.max(mark).alias("mark")), "touched")
    once, copies = _dealt(touched, "node")
    other = copies.select("node", "deal", F.col("block").alias("second"), F.col("mark").alias("marked"))
    pairs = once.withColumnRenamed("block", "first").join(other, ["node", "deal"]).where("mark or marked")
    return pairs.select(F.least("first", "second").alias("first"), F.greatest("first", "second").alias("second")).distinct()


def _pairs_with_main(blocks: DataFrame) -> DataFrame:
    """Each block with itself, and those of a large place with its main block."""
    own = blocks.select(F.col("block").alias("first"), F.col("block").alias("second"))
    star = blocks.where("main is not null").select(F.least("block", "main").alias("first"), F.greatest("block", "main").alias("second"))
    return own.union(star).distinct()


def _verified(pairs: DataFrame, members: DataFrame, threshold: float, depth: int, above: int | None) -> DataFrame:
    """The results of _verify for pairs of blocks (first, second) of members."""
    sides = pairs.select("first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("block"))
    numbered = sides.withColumn("number", F.xxhash64("first", "second"))
    sizes = written(numbered.groupBy("block").agg(F.count("*").alias("n"), ((F.count("*") - 1) / DEAL).cast("int").alias("deals")), "deals")
    deals = sizes.drop("n")
    once = skewed_join(numbered, sizes, ["block"], "n").select("first", "second", "block", F.pmod("number", F.col("deals") + 1).cast("int").alias("deal"))
    copies = members.join(deals, "block").withColumn("deal", F.explode(F.sequence(F.lit(0), "deals"))).drop("deals")
    return written(copies.join(once, ["block", "deal"]).drop("deal").groupBy("first", "second").applyInPandas(_verify(threshold, depth, above), _FOUND), "links")


class _Classes:
    """Classes of equal shingle sets, and what is known of the links between them."""

    def __init__(self, docs: DataFrame, threshold: float):
        """docs: doc_id and text; links have a similarity of ``threshold`` or more."""
        self.threshold = threshold
        self.thin = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
        schema = "doc_id long, text_key long, h1 long, h2 long, signatures binary"
        self.signed = written(self.thin.mapInArrow(_signed, schema), "signatures")
        full = self.signed.where("h1 is not null")
        grouped = full.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.count("*").alias("copies"), F.first("signatures").alias("signatures"))
        # numbered as they are written, so a class keeps its number
        self.classes = written(grouped.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "least.*", "copies", "signatures"), "classes")
        self.forest = written(forest(self.classes, shortened([threshold], DEPTH)), "forest")
        self.rounds: list[int] = []

    def _live(self, depth: int, above: int | None) -> DataFrame:
        """rep, node, least (class of the node) for nodes at which classes meet anew: those whose classes aren't all below one longer prefix."""
        prefix = lambda k: F.xxhash64("tree", F.substring("label", 1, VALUE_BYTES * k))
        rows = self.forest.where(F.col("shared") >= depth).select("rep", prefix(depth).alias("node"), prefix(above or DEPTH).alias("child"))
        found = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("least"), F.min("child").alias("low"), F.max("child").alias("high"))
        found = written(found.where("n > 1" if above is None else "low <> high").select("node", "n", "least"), "nodes")
        return written(skewed_join(rows.select("rep", "node"), found, ["node"], "n").select("rep", "node", "least"), "live")

    def _members(self, blocks: DataFrame, roots: DataFrame | None) -> DataFrame:
        """rep, block, copies, signatures, root and shingles of the classes in blocks."""
        known = self.classes.join(blocks.select("rep", "block"), "rep")
        # one row of a class; the key of the join tells classes apart, so its shuffle serves for both
        texts = self.thin.join(known.select("rep", "doc_id", "text_key"), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("rep", "text")
        sets = texts.mapInArrow(_sets, "rep long, shingles binary")
        named = known.select("rep", "block", "copies", "signatures").join(sets, "rep")
        if roots is None:
            return named.withColumn("root", F.col("rep"))
        return named.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))

    def links(self, counts: bool) -> DataFrame:
        """rep, links, other: links of each class (with counts), and edges that connect linked classes.

        Without counts only edges are sought: a large place is first held against its main
        block, and then only pairs that are not connected so.
        """
        threshold, edges = self.threshold, "rep long, links long, other long"
        found, bands, depth, above = self.classes.sparkSession.createDataFrame([], edges), {1.0}, DEPTH, None
        while True:
            self.rounds.append(depth)
            live = self._live(depth, above)
            blocks = _blocks(live)
            steps = []
            if counts:
                members = written(self._members(blocks, None), "members")
                steps.append(_verified(_pairs_at_nodes(live, blocks, F.lit(True)), members, threshold, depth, above))
            else:
                known = self._members(blocks, connected(found.select("rep", "other")) if len(self.rounds) > 1 else None)
                members = written(known, "members")
                steps.append(_verified(_pairs_with_main(blocks), members, threshold, depth, above))
                roots = connected(found.unionByName(steps[0].where("rep <> other").select("rep", "links", "other")).select("rep", "other"))
                steps.append(self._beside(live, blocks, members.drop("root"), roots, threshold, depth, above))
            for step in steps:
                bands |= {min(1.0, threshold + BAND * r.band) for r in step.where("band is not null").groupBy("band").count().collect()}
                found = found.unionByName(step.where("band is null").select("rep", "links", "other"))
            above, depth = depth, shortened(sorted(bands), depth)
            if depth == above:
                return found

    def _beside(self, live: DataFrame, blocks: DataFrame, members: DataFrame, roots: DataFrame, threshold: float, depth: int, above: int | None) -> DataFrame:
        """Verify, at nodes whose classes aren't all connected, those beside the largest component with all others."""
        at = live.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "node", F.coalesce("root", "rep").alias("root"))
        sizes = at.groupBy("node", "root").agg(F.count("*").alias("n"))
        mixed = sizes.groupBy("node").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("roots"), F.sum("n").alias("size")).where("roots > 1")
        mixed = written(mixed, "mixed")
        left = written(skewed_join(at, mixed.select("node", "largest", "size"), ["node"], "size").select("rep", "node", (F.col("root") != F.col("largest")).alias("beside")), "beside")
        pairs = _pairs_at_nodes(left, blocks, F.col("beside"))
        named = members.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        return _verified(pairs, named, threshold, depth, above)

    def named(self, found: DataFrame) -> DataFrame:
        """For each class: rep, h1, h2, copies, doc_id (its least), links, root and class_id (its component, and the least doc_id there)."""
        links = found.where("rep = other").groupBy("rep").agg(F.sum("links").alias("links"))
        roots = connected(found.where("rep <> other").select("rep", "other"))
        slim = self.classes.select("rep", "h1", "h2", "doc_id", "copies").join(links, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
        slim = written(slim.withColumn("root", F.coalesce("root", "rep")), "components")
        least = slim.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
        return skewed_join(slim, written(least, "least"), ["root"], "n").drop("n")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """For each document: doc_id, copy_of, class_id and n_links.

    copy_of is the least doc_id with the same shingle set, class_id the least doc_id of the
    group that links connect, n_links the number of other documents whose five-word shingles
    have a Jaccard similarity of ``threshold`` or more. Words are lower-cased (ASCII) runs of
    letters and digits; texts of one to four words have one shingle of all their words. Texts
    without a word (and nulls) have no links and are classes of their own. Each row counts as a
    document, also where rows repeat a doc_id with the same or another text; rows without
    doc_id are left out; further columns are ignored. An empty table gives no rows.

    A pair at the threshold itself is found with the probability TARGET_RECALL, once a link of
    its band (BAND wide) has been found; more similar ones with a higher one.
    """
    bounded_batches(docs.sparkSession)
    known = _Classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null"), threshold)
    by_class = known.named(known.links(counts=True))
    by_class = written(by_class.select("h1", "h2", F.col("doc_id").alias("copy_of"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies"), "by-class")
    full = known.signed.where("h1 is not null").select("doc_id", "h1", "h2")
    joined = skewed_join(full, by_class, ["h1", "h2"], "copies").select("doc_id", "copy_of", "class_id", "n_links")
    alone = known.signed.where("h1 is null").select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return joined.unionAll(alone)


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents without near duplicates: of each class one row with the least doc_id, with all columns.

    Links inside large groups aren't counted here, only followed until the group is connected.
    Texts without a word are classes of their own; rows without doc_id all stay. Of rows that
    repeat a doc_id with one text, one stays; with different texts, each stands for its class.
    """
    bounded_batches(docs.sparkSession)
    known = _Classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null"), threshold)
    by_class = known.named(known.links(counts=False))
    leads = by_class.where("doc_id = class_id").join(known.classes.select("rep", "text_key"), "rep")
    leads = leads.groupBy("root", "class_id").agg(F.min("text_key").alias("text_key")).select("class_id", "text_key")
    inner = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, inner, strict=True)], F.col("doc_id").cast("long").alias("class_id"), F.xxhash64("text").alias("text_key"))
    wordless = known.signed.where("h1 is null").select(F.col("doc_id").alias("class_id"), "text_key").distinct()
    kept = rows.join(leads.unionByName(wordless), ["class_id", "text_key"], "left_semi").dropDuplicates(["class_id", "text_key"])
    whole = kept.unionByName(rows.where("class_id is null"))
    return whole.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, inner, strict=True)])
