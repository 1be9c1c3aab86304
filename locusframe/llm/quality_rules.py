"""Quality rules with thresholds that adapt to language and source.

Statistics of each document are summed up in mergeable quantile sketches (histograms with
logarithmic cells, as in DDSketch) for each language and source. A threshold is a quartile of a
sketch and so many times its spread beyond it; no rule has a fixed cutoff. Thresholds are
joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import bounded_batches, written
from .textscan import RAW_WORD, SHINGLE_WORDS, Hasher, Slice, mix, ranges, slices, windows, words

SYMBOLS = "#*$%&|<>"
_STATS = ["n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]
#: Width of a sketch's cells, as a ratio of its bounds.
GAMMA = 1.01
#: Thresholds lie this many interquartile ranges (of logarithms) beyond a quartile.
SPREAD = 2.5
#: A group or language of fewer documents takes the quartiles of the next larger group.
MIN_GROUP = 50
#: Thresholds of up to so many groups (about 100 bytes each) are broadcast; beyond, the join is salted.
BROADCAST_GROUPS = 100_000
SALTS = 64


def _table(flags: str) -> np.ndarray:
    marked = np.zeros(256, bool)
    marked[list(flags.encode())] = True
    return marked


_SYMBOL, _UPPER = _table(SYMBOLS), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _statistics(part: Slice) -> list[np.ndarray]:
    """One array for each of _STATS, with a value for each text of the slice."""
    n, data = len(part.bounds) - 1, part.data

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[part.bounds[1:]] - sums[part.bounds[:-1]]

    points = (data & 0xC0) != 0x80
    found = words(part, plain=False)
    n_words = np.bincount(found.text, minlength=n)

    # words in windows of five that occur twice or more in their text
    hashes, first = windows(found.hash, found.text, SHINGLE_WORDS)
    repeated = _repeats(mix(hashes + found.text[first].astype(np.uint64)), all_of_them=True)
    cover = np.zeros(len(found.hash) + 1, np.int64)
    np.add.at(cover, first[repeated], 1)
    np.add.at(cover, first[repeated] + SHINGLE_WORDS, -1)
    n_repeat = np.bincount(found.text[np.cumsum(cover[:-1]) > 0], minlength=n)

    # lines with a word that equal an earlier line of their text
    line_text, start, end = ranges(data != 0x0A, part.bounds)
    wordy = np.concatenate([[0], np.cumsum(RAW_WORD[data], dtype=np.int64)])
    full = wordy[end] > wordy[start]
    line_text, start, end = line_text[full], start[full], end[full]
    line_hash = Hasher(data).of(start, end) if len(start) else np.zeros(0, np.uint64)
    again = _repeats(mix(line_hash + line_text.astype(np.uint64)), all_of_them=False)
    return [
        per_text(points),
        n_words,
        per_text(points & RAW_WORD[data]),
        per_text(_SYMBOL[data]),
        np.bincount(line_text, minlength=n),
        np.bincount(line_text[again], minlength=n),
        n_repeat,
        per_text(_UPPER[data]),
    ]


def _repeats(keys: np.ndarray, all_of_them: bool) -> np.ndarray:
    """Which keys occur more than once; without all_of_them, the first occurrence doesn't count."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    flags = np.zeros(len(keys), bool)
    flags[order[1:][same]] = True
    if all_of_them:
        flags[order[:-1][same]] = True
    return flags


def _plain(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns as c0, c1, ...; language and source as g0 and g1; the text as body.

    So no name of an input column can meet one of the names used here.
    """
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    return docs.select(*columns, F.col("lang").alias("g0"), F.col("source").alias("g1"), F.col("text").alias("body"))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_statistics(p) for p in slices(batch["body"])]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(_STATS)
        names = [c for c in batch.schema.names if c != "body"]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], *[pa.array(c.astype(np.int64)) for c in columns]], [*names, *[f"q_{s}" for s in _STATS]])


def _measured(plain: DataFrame) -> DataFrame:
    """g0, g1, the c... columns, and q_... columns with each whole body's statistics (null: empty)."""
    bounded_batches(plain.sparkSession)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields if f.name != "body"), *(f"q_{s} long" for s in _STATS)])
    return plain.mapInArrow(_measure, schema)


#: Name of a rule, its value, and whether high or low values are bad.
RULES: list[tuple[str, str, str]] = [
    ("symbols", "q_n_symbols / greatest(q_n_words, 1)", "high"),
    ("dup_lines", "q_n_dup_lines / greatest(q_n_lines, 1)", "high"),
    ("repeats", "q_n_repeat_words / greatest(q_n_words, 1)", "high"),
    ("upper", "q_n_upper / greatest(q_word_chars, 1)", "high"),
    ("long_words", "q_word_chars / greatest(q_n_words, 1)", "high"),
    ("short_words", "q_word_chars / greatest(q_n_words, 1)", "low"),
]


def _cell(value: Column) -> Column:
    """Number of the logarithmic cell that holds a value; null for 0, which is in no cell."""
    return F.when(value > 0, F.ceil(F.log(value) / float(np.log(GAMMA)))).cast("int")


def sketches(stats: DataFrame) -> DataFrame:
    """Quantile sketches: for each group (g0, g1) and rule the documents n in each cell. They merge by adding."""
    cells = F.array(*[F.struct(F.lit(i).alias("rule"), _cell(F.expr(value)).alias("cell")) for i, (_, value, _) in enumerate(RULES)])
    return stats.select("g0", "g1", F.inline(cells)).where("cell is not null").groupBy("g0", "g1", "rule", "cell").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """For each group and rule the cells of the lower and upper quartile, low and high, and the documents n."""
    part = Window.partitionBy(*groups, "rule")
    ranked = sketch.withColumn("upto", F.sum("n").over(part.orderBy("cell"))).withColumn("all", F.sum("n").over(part))
    low, high = (F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("cell"))) for share in (0.25, 0.75))
    return ranked.groupBy(*groups, "rule").agg(F.max("all").alias("n"), low.alias("low"), high.alias("high"))


def thresholds(stats: DataFrame) -> DataFrame:
    """g0, g1 and the last good cell t_... of each rule, from sketches alone.

    Sketches hold the documents in which a rule's value isn't 0. A threshold lies SPREAD times
    the spread beyond a quartile of the group, where the spread is the group's interquartile
    range or its language's, whichever is wider: a group of documents that are all alike isn't
    cut. Groups with under MIN_GROUP documents in the sketch take their language's quartiles,
    such languages those of all documents. A rule without any value but 0 has no threshold.
    """
    own = sketches(stats)
    by_lang = own.groupBy("g0", "rule", "cell").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("rule", "cell").agg(F.sum("n").alias("n"))
    a = quartiles(own, ("g0", "g1")).alias("a")
    b = quartiles(by_lang, ("g0",)).alias("b")
    c = quartiles(by_all, ()).alias("c")
    joined = a.join(b, F.expr("a.g0 <=> b.g0 and a.rule = b.rule")).join(F.broadcast(c), F.expr("a.rule = c.rule"))  # c: a row for each rule
    own_wide, lang_wide, all_wide = (F.expr(f"{x}.high - {x}.low") for x in "abc")
    large, known = F.col("a.n") >= MIN_GROUP, F.col("b.n") >= MIN_GROUP

    def pick(name: str) -> Column:
        return F.when(large, F.col(f"a.{name}")).when(known, F.col(f"b.{name}")).otherwise(F.col(f"c.{name}"))

    spread = F.greatest(F.when(large, own_wide), F.when(known, lang_wide).otherwise(all_wide))
    out = []
    for i, (name, _, side) in enumerate(RULES):
        line = pick("high") + SPREAD * spread if side == "high" else pick("low") - SPREAD * spread
        out.append(F.max(F.when(F.col("a.rule") == i, line)).alias(f"t_{name}"))
    return joined.groupBy(F.col("a.g0").alias("g0"), F.col("a.g1").alias("g1")).agg(*out)


def _judged(stats: DataFrame) -> DataFrame:
    """Join the thresholds and add base_failed, failed and kept."""
    limits = written(thresholds(stats).select(F.col("g0").alias("h0"), F.col("g1").alias("h1"), *[f"t_{r[0]}" for r in RULES]), "thresholds")
    on = F.col("g0").eqNullSafe(F.col("h0")) & F.col("g1").eqNullSafe(F.col("h1"))
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    else:  # each group's thresholds in SALTS copies, so that a large source is dealt to as many tasks
        stats = stats.withColumn("salt", F.pmod(F.xxhash64(*stats.columns), F.lit(SALTS)))
        limits = limits.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = on & (F.col("salt") == F.col("copy"))
    base = (F.col("q_n_words") < 10) | (100 * F.col("q_n_repeat_words") > 20 * F.col("q_n_words"))
    broken = [F.when((_cell(F.expr(value)) > F.col(f"t_{name}")) if side == "high" else (_cell(F.expr(value)) < F.col(f"t_{name}")), F.lit(name)) for name, value, side in RULES]
    named = stats.join(limits, on, "left").withColumn("base_failed", base).withColumn("failed", F.array_compact(F.array(*broken)))
    return named.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def assess(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, q_... columns with each whole text's statistics, and the verdict.

    base_failed: fewer than ten words, or over a fifth of them in repeated five-word windows.
    failed: names of the adaptive rules that a document breaks; a value in the cell of the
    threshold itself is good. kept: neither. A null text counts as empty, and fails the base
    rule. Null languages and sources are groups of their own; repeated rows are judged each for
    itself; columns of docs not in ``keep`` go, and kept ones named like an output are replaced
    by it. An empty table gives no rows.
    """
    outputs = [*(f"q_{s}" for s in _STATS), "base_failed", "failed", "kept"]
    keep = tuple(c for c in keep if c not in outputs)
    found = _judged(written(_measured(_plain(docs, keep)), "quality-statistics"))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *outputs)


def kept(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects (see assess), with their columns."""
    names = [f"k{i}" for i in range(len(docs.columns))]
    inner = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], "lang", "source", "text")
    return assess(inner, tuple(names)).where("kept").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
