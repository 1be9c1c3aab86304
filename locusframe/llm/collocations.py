"""Phrase collocations, mined by partitioning (SON).

The texts are dealt into a fixed number of shards. A shard that holds a share of a language's words is
mined completely at that share of the support: a phrase that is frequent on the whole is frequent
in some shard. The phrases frequent in any shard are the candidates, which are then counted exactly over all texts.

A shard may be of any size, so it is mined by all tasks that hold its texts, a phrase length at a time: a
phrase of n words is counted only if both its parts of n - 1 words are frequent in the shard. Counts come
together by a shuffle on hashes. What tasks know of frequent hashes is a bit map of bounded size, which lets
through all of them and some others; that costs time but changes no result, as the last count is of words, not hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import bounded_batches, keyed_join, new_path, written
from .textscan import LOWER, Hasher, mix, ranges, slices

#: Shards: with S as support about S / SHARDS is asked for in each, so few of them prune well, at any size of the corpus.
SHARDS = 16
#: Bits of a map for each hash, and of a map at most (32 MB); further candidates are counted in further rounds.
BITS_EACH, MAP_BITS = 16, 28
#: Hashes that a task gathers before it counts them, and bytes of text worked on at once.
HELD, PART_BYTES = 1 << 20, 1 << 20
TOP_SALTS = 64

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SHARD_MASK = 0xFFFF
#: Bytes that end a piece, and bytes of words.
STOP = np.zeros(256, bool)
STOP[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = ~STOP
WORD[[0x20, 0x09]] = False
_OTHER = np.random.default_rng(13).permutation(256).astype(np.uint8)


class Scan:
    """The words of some texts: bounds, number of the piece, key and number of language and shard, and hash."""

    def __init__(self, part, groups: np.ndarray, kinds: np.ndarray):
        self.data = LOWER[part.data]
        self.text, self.start, self.end = ranges(WORD[self.data], part.bounds)
        # texts and stops only add up, so two words share their sum only in one piece
        self.piece = self.text + np.cumsum(STOP[self.data])[self.start] if len(self.start) else self.text
        self.group, self.kind = groups[part.first + self.text], kinds[part.first + self.text]
        self.hash = self._hashes(self.data)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        return Hasher(data).of(self.start, self.end) if len(self.start) else np.zeros(0, _U)

    def second(self) -> np.ndarray:
        """Hashes that have nothing to do with the others, so that both together tell words apart."""
        return self._hashes(_OTHER[self.data])

    def windows(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """A hash for each run of ``size`` words, also of those that leave a piece."""
        n = max(0, len(hashes) - size + 1)
        total = hashes[:n].copy()
        for k in range(1, size):
            total = total * _BASE + hashes[k : k + n]
        return mix(total + _U(size))

    def inside(self, size: int) -> np.ndarray:
        """Which runs of ``size`` words lie in one piece."""
        n = max(0, len(self.piece) - size + 1)
        return self.piece[:n] == self.piece[size - 1 : size - 1 + n]

    def phrases(self, first: np.ndarray, size: int) -> pa.Array:
        """Runs of ``size`` words, each joined by a space; built from all their bytes at once."""
        word = (first[:, None] + np.arange(size)).ravel()
        length = self.end[word] - self.start[word] + 1  # with the byte after it, which becomes the space
        stop = np.cumsum(length)
        at = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.start[word] - (stop - length), length)
        data = self.data[np.minimum(at, len(self.data) - 1)]
        data[stop - 1] = 0x20
        keep = np.ones(len(data), bool)
        keep[stop[size - 1 :: size] - 1] = False
        bounds = np.zeros(len(first) + 1, np.int64)
        bounds[1:] = stop[size - 1 :: size] - np.arange(1, len(first) + 1)
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(data[keep])).cast(pa.string())


def _scans(batch: pa.RecordBatch, kinds: dict[tuple[str, int], int]) -> Iterator[Scan]:
    """Slices of a batch of lang, lang_key, shard and text; kinds numbers pairs of language and shard as they come."""
    pairs = zip(batch["lang"].to_pylist(), batch["shard"].to_pylist(), strict=True)
    numbers = np.array([kinds.setdefault(p, len(kinds)) for p in pairs], np.int64)
    groups = (batch["lang_key"].to_numpy() | batch["shard"].to_numpy()).view(_U)
    for part in slices(batch["text"], PART_BYTES):
        yield Scan(part, groups, numbers)


class BitMap:
    """Which leading bits hashes have; tells for any hash whether it may be one of them."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> _U(64 - self.bits)
        return (self.data[at >> _U(6)] >> (at & _U(63))) & _U(1) == 1


def _key(hashes: np.ndarray, groups: np.ndarray, local: bool) -> np.ndarray:
    """One value for a phrase of a language, or of a shard's texts of a language."""
    return mix(hashes + (groups if local else groups & _U(0xFFFFFFFFFFFFFFFF - _SHARD_MASK)))


def bit_map(hashes: DataFrame, local: bool) -> BitMap:
    """A map of group and hash, by BITS_EACH bits for each but 2 ** MAP_BITS bits at most; made in tasks, sent to the driver as words of bits."""
    bits = min(MAP_BITS, max(6, math.ceil(math.log2(BITS_EACH * max(1, hashes.count())))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _key(*(batch[c].to_numpy().astype(np.int64).view(_U) for c in ("hash", "group")), local) >> _U(64 - bits)
            word, place = np.unique(at >> _U(6), return_inverse=True)
            value = np.zeros(len(word), _U)
            np.bitwise_or.at(value, place, _U(1) << (at & _U(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(value.view(np.int64))], ["word", "bits"])

    words = hashes.select("group", "hash").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    data = np.zeros(1 << (bits - 6), _U)
    data[words["word"].to_numpy()] = words["bits"].to_numpy().view(_U)
    return BitMap(bits, data)


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct pairs of hashes, and how often each comes."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    new, other = a[1:] != a[:-1], b[1:] != b[:-1]
    if np.any(other & ~new):
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.concatenate([[0], np.flatnonzero(new) + 1]) if len(order) else np.zeros(0, np.int64)
    return order[starts], np.diff(np.append(starts, len(order)))


_PHRASES = "lang string, shard long, hash long, phrase string, n long"


def _phrases(sizes: tuple[int, ...], known=None, share: tuple[int, int] = (0, 1)) -> Callable:
    """Counts of phrases, as words, of these sizes: those that the map may hold (without one all) and whose hash belongs to the round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[tuple[str, int], int] = {}
        for batch in batches:
            for scan in _scans(batch, kinds):
                second, names = scan.second(), list(kinds)
                for size in sizes:
                    hashes = scan.windows(scan.hash, size)
                    pick = scan.inside(size)
                    if known is not None:
                        pick &= known.value.holds(_key(hashes, scan.group[: len(hashes)], False))
                    if share[1] > 1:
                        pick &= hashes % _U(share[1]) == _U(share[0])
                    at = np.flatnonzero(pick)
                    others = scan.windows(second, size)[at]
                    for kind in np.unique(scan.kind[at]).tolist():
                        mine = np.flatnonzero(scan.kind[at] == kind)
                        firsts, n = _distinct(hashes[at[mine]], others[mine])
                        first = at[mine[firsts]]
                        lang, shard = (pa.repeat(pa.scalar(x, t), len(first)) for x, t in zip(names[kind], (pa.string(), pa.int64()), strict=True))
                        columns = [lang, shard, pa.array(hashes[first].view(np.int64)), scan.phrases(first, size), pa.array(n)]
                        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PHRASES.split(", ")])

    return run


_WINDOWS = "group long, hash long, n long"


def _windows(size: int, shorter) -> Callable:
    """Counts of hashes of runs of ``size`` words whose two parts, each a word shorter, are frequent in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[tuple[str, int], int] = {}
        held: dict[int, list[np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for group, hashes in held.items():
                value, n = np.unique(np.concatenate(hashes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), group, _U).view(np.int64)), pa.array(value.view(np.int64)), pa.array(n)], [c.split()[0] for c in _WINDOWS.split(", ")])

        for batch in batches:
            for scan in _scans(batch, kinds):
                parts = scan.windows(scan.hash, size - 1)
                known = shorter.value.holds(_key(parts, scan.group[: len(parts)], True))
                at = np.flatnonzero(scan.inside(size) & known[:-1] & known[1:]) if len(parts) > 1 else np.zeros(0, np.int64)
                hashes, groups = scan.windows(scan.hash, size)[at], scan.group[at]
                for group in np.unique(groups).tolist():
                    held.setdefault(group, []).append(hashes[groups == group])
                if sum(len(h) for one in held.values() for h in one) >= HELD:
                    yield from out()
                    held = {}
        yield from out()

    return run


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, shards: int = SHARDS, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words found ``least`` times or more in their language, and each language's number of words.

    Returns (lang, phrase, size, n) and (lang, words); see collocations for what counts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    name = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    # written with its shard, as a text must lie in one shard in all passes
    shard = F.pmod(F.spark_partition_id(), F.lit(shards)).cast("long")
    texts = written(docs.select(name.alias("lang"), F.expr(f"xxhash64(coalesce(cast(`{lang}` as string), 'und')) & ~{_SHARD_MASK}L").alias("lang_key"), shard.alias("shard"), F.col(text).alias("text")).where(F.col("text") != ""), "phrase-texts")
    texts = texts.select("lang", "lang_key", "shard", "text")

    words = written(texts.mapInArrow(_phrases((1,)), _PHRASES).groupBy("lang", "shard", "phrase").agg(F.first("hash").alias("hash"), F.sum("n").alias("n")), "phrase-words")
    by_shard = words.groupBy("lang", "shard").agg(F.sum("n").alias("here"))
    by_lang = written(by_shard.groupBy("lang").agg(F.sum("here").alias("words")), "phrase-languages")
    key = F.xxhash64("lang").bitwiseAND(F.lit(~_SHARD_MASK).cast("long"))
    support = by_shard.join(by_lang, "lang").select(key.bitwiseOR(F.col("shard")).alias("group"), "here", "words").groupBy("group").agg(F.sum("here").alias("here"), F.sum("words").alias("words"))
    # a phrase with fewer than this in every shard has fewer than ``least`` in all
    limits = written(support.select(F.col("group").alias("_group"), F.expr(f"cast({least} as decimal(19, 0)) * here").alias("goal"), "words"), "phrase-limits")

    def local(counts: DataFrame) -> DataFrame:
        return keyed_join(counts, limits, F.col("group") == F.col("_group"), F.col("hash")).where(F.col("n").cast("decimal(19, 0)") * F.col("words") >= F.col("goal")).select("group", "hash")

    shorter = written(local(words.groupBy(key.bitwiseOR(F.col("shard")).alias("group"), "hash").agg(F.sum("n").alias("n"))), "phrase-local")
    candidates: list[DataFrame] = []
    for size in range(2, longest + 1):
        known = spark.sparkContext.broadcast(bit_map(shorter, True))
        counts = texts.mapInArrow(_windows(size, known), _WINDOWS).groupBy("group", "hash").agg(F.sum("n").alias("n"))
        shorter = written(local(counts), "phrase-local")
        known.unpersist()
        candidates.append(shorter.select(F.col("group").bitwiseAND(F.lit(~_SHARD_MASK).cast("long")).alias("group"), "hash", F.lit(size).alias("size")))
        if shorter.isEmpty():
            break

    out = new_path(spark, "phrases")
    once = words.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    once.select("lang", "phrase", F.lit(1).alias("size"), "n").write.parquet(out)
    every = None
    for part in candidates:
        every = part if every is None else every.unionByName(part)
    if every is not None:
        every = written(every.distinct(), "phrase-candidates")
        sizes = tuple(sorted(r["size"] for r in every.select("size").distinct().collect()))
        rounds = max(1, math.ceil(every.count() * BITS_EACH / (1 << MAP_BITS)))
        for turn in range(rounds if sizes else 0):
            mine = every.where(F.expr(f"pmod(cast(hash as decimal(20, 0)) + if(hash < 0, 18446744073709551616BD, 0BD), {rounds}BD) = {turn}"))
            known = spark.sparkContext.broadcast(bit_map(mine, False))
            counted = texts.mapInArrow(_phrases(sizes, known, (turn, rounds)), _PHRASES).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            counted.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "n").write.mode("append").parquet(out)
            known.unpersist()
    return spark.read.schema("lang string, phrase string, size int, n long").parquet(out), by_lang


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, contained: int = 100, top: int = 2000, shards: int = SHARDS, text: str = "text", lang: str = "lang") -> DataFrame:
    """The phrases of each language whose words meet more often than chance would have it.

    Texts are lower-cased (A to Z), split into pieces at any of ``. , ; : ! ?`` and line ends, and those
    into words at spaces and tabs; phrases don't leave a piece. A phrase of 2 to ``longest`` words with a = its occurrences
    (overlapping ones too) of ``least`` or more is a candidate. Cut after k words it scores floor(1000 * a * n / (l * r)),
    of the occurrences l and r of its two parts and the number n of words of the language; its
    least score counts, that of the smallest k among equal ones. A candidate goes if it lies
    inside a longer one with 100 times that one's occurrences at least ``contained`` times a. Returns for each language its
    first ``top`` by score, then a (both descending), then phrase: lang, rank from 1, phrase, a, l, r, n, score.

    A null language is ``und``. Null and empty texts have no words; repeated rows count again;
    an empty table gives no rows; further columns are ignored. Counts are exact: phrases are told apart by their
    words, inside one piece of work by 128 bits of hash.
    """
    frequent, by_lang = frequent_phrases(docs, least, longest, shards, text, lang)
    phrases = frequent.where("size >= 2").select("lang", "phrase", "size", F.split("phrase", " ").alias("words"), F.col("n").alias("a"))
    cut = phrases.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("head"), F.expr("array_join(slice(words, k + 1, size - k), ' ')").alias("rest"))
    heads = frequent.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    rests = frequent.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    total = by_lang.select(F.col("lang").alias("_lang"), F.col("words").alias("n"))
    both = keyed_join(cut.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]), total, F.col("lang") == F.col("_lang"), F.xxhash64("phrase")).drop("_lang")
    score = F.expr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(15, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    scored = both.withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("best")).select("lang", "phrase", "best.*")

    inner = phrases.where("size > 2").withColumn("part", F.explode(F.expr("flatten(transform(sequence(2, size - 1), w -> transform(sequence(1, size - w + 1), i -> array_join(slice(words, i, w), ' '))))")))
    outer = inner.groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(outer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a"))).drop("longer")
    # the first of each of some parts of a language, then of these: no task gets a whole language
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS)))
    first = first.withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
