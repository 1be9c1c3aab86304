"""Token counts under a unigram model, by dynamic programming that shares prefixes.

The distinct pre-tokens of the whole corpus are put in order across the cluster. Each range of
them is a trie in depth-first order: a pass over it keeps the forward scores of the prefix under
way on a stack, so those of a shared prefix are computed once, and stores the token count at
the end of each pre-token. Counts of the most frequent pre-tokens go to all tasks (a bounded
number of bounded length); those of the others are joined to the documents that hold them.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import units
from .runtime import bounded_batches, written
from .textscan import slices

#: The counts of so many most frequent pre-tokens are broadcast, if they have at most so many bytes.
FREQUENT = 200_000
FREQUENT_BYTES = 32
#: Distinct units and pre-tokens that a worker holds before it hands its partial counts on.
HELD = 400_000
SALTS = 16
SLICE = 4 << 20


class Unigram:
    """A unigram model over byte pieces.

    The vocabulary file lists pieces by rank, without probabilities, and tokenizers aren't
    trained here; so a piece of rank r has the probability of Zipf's law, proportional to
    1 / (r + offset). All single bytes are pieces, so every text has a segmentation. Counted is
    the most probable one; of equally probable ones, that with the shorter last piece.
    """

    def __init__(self, ranks_path: str, offset: int = 2):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        total = math.log(sum(1 / (r + offset) for r in ranks.values()))
        self.score = {piece: -math.log(rank + offset) - total for piece, rank in ranks.items()}
        self.longest = max(map(len, self.score))


class Walk:
    """A depth-first walk over a trie, given as its words in order: the stack of forward scores and token counts."""

    def __init__(self, model: Unigram):
        self.model, self.before = model, b""
        self.best, self.count = [0.0], [0]
        self.steps = 0

    def tokens(self, word: bytes) -> int:
        """The token count of the next word; only what follows its shared prefix with the word before is scored."""
        shared = 0
        if self.before[: len(word)] == word:
            shared = len(word)
        else:
            for x, y in zip(self.before, word):  # noqa: B905
                if x != y:
                    break
                shared += 1
        best, count, score, longest = self.best, self.count, self.model.score, self.model.longest
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, n = -math.inf, 0
            for start in range(end - 1, max(-1, end - 1 - longest), -1):
                piece = score.get(word[start:end])
                if piece is not None and best[start] + piece > top:
                    top, n = best[start] + piece, count[start] + 1
            best.append(top)
            count.append(n)
        self.steps += len(word) - shared
        self.before = word
        return count[-1]


@lru_cache(1)
def _model(path: str, offset: int) -> Unigram:
    return Unigram(path, offset)


@lru_cache(1)
def _split():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-tokens of a task and how often each occurs, in parts of bounded size."""
    split = _split()
    seen: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        total: Counter[str] = Counter()
        for unit, n in seen.items():
            for part in split(unit):
                total[part] += n
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array([p.encode() for p in total], pa.binary()), pa.array(list(total.values()), pa.int64())], ["pretoken", "n"])

    for batch in batches:
        for part in slices(batch["text"], SLICE):
            coded, _ = units(part.data, part.bounds)
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            for unit, k in zip(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), n.tolist(), strict=True):
                seen[unit] += k
            if len(seen) > HELD:
                yield out()
    yield out()


def vocabulary_counts(docs: DataFrame, vocabulary: str, offset: int = 2) -> DataFrame:
    """The distinct pre-tokens of all texts: pretoken (its bytes), n (occurrences) and n_tokens.

    Every pre-token is counted once, in a range of the order of all of them.
    """
    bounded_batches(docs.sparkSession)
    distinct = docs.select("text").mapInArrow(_distinct, "pretoken binary, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    # written first: the ranges are found from a sample of what is there, not by a second run over the texts
    tries = written(distinct, "pretokens").repartitionByRange("pretoken").sortWithinPartitions("pretoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(_model(vocabulary, offset))
        for batch in batches:
            counts = list(map(walk.tokens, batch["pretoken"].to_pylist()))
            yield pa.RecordBatch.from_arrays([batch["pretoken"], batch["n"], pa.array(counts, pa.int64())], ["pretoken", "n", "n_tokens"])

    return tries.mapInArrow(run, "pretoken binary, n long, n_tokens long")


_SUMMED = "row long, doc_id long, n_bytes long, n_pretokens long, n_tokens long, others array<struct<pretoken: binary, n: long>>"


def _summed(shared):
    """Sum the broadcast counts over each text, and list the pre-tokens that aren't among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = shared.value, _split()
        memory: dict[str, tuple[int, int, tuple[bytes, ...]]] = {}

        def looked_up(unit: str) -> tuple[int, int, tuple[bytes, ...]]:
            """Pre-tokens, tokens of the known ones, and the others."""
            found = memory.get(unit)
            if found is None:
                parts = [p.encode() for p in split(unit)]
                found = len(parts), sum(known.get(p, 0) for p in parts), tuple(p for p in parts if p not in known)
                if len(unit) <= FREQUENT_BYTES:
                    memory[unit] = found
            return found

        others_type = pa.list_(pa.struct([("pretoken", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            if len(memory) > HELD:
                memory.clear()
            pre, tokens, others = [], [], []
            for part in slices(batch["text"], SLICE):
                coded, first = units(part.data, part.bounds)
                code = coded.indices.to_numpy()
                table = list(map(looked_up, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
                sums = np.zeros((len(code) + 1, 2), np.int64)
                if table:
                    np.cumsum(np.array([t[:2] for t in table], np.int64)[code], axis=0, out=sums[1:])
                edges = np.searchsorted(first, part.bounds)
                per_text = sums[edges[1:]] - sums[edges[:-1]]
                pre += per_text[:, 0].tolist()
                tokens += per_text[:, 1].tolist()
                rare = np.flatnonzero(np.array([bool(t[2]) for t in table], bool)[code]) if table else np.zeros(0, np.int64)
                at = np.searchsorted(rare, edges)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    found = Counter(p for k in rare[a:b].tolist() for p in table[code[k]][2])
                    others.append([{"pretoken": p, "n": n} for p, n in found.items()])
            columns = [batch["row"], batch["doc_id"], batch["n_bytes"], pa.array(pre, pa.int64()), pa.array(tokens, pa.int64()), pa.array(others, others_type)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_bytes", "n_pretokens", "n_tokens", "others"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, offset: int = 2, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_pretokens and n_tokens of each document's whole text.

    ``vocabulary`` is a file of base64 pieces and ranks. The counts of the ``frequent`` most
    frequent pre-tokens of at most FREQUENT_BYTES bytes are broadcast, so no other of that length
    has more than its small share of all occurrences; longer ones are salted in the join. Null and empty texts have no tokens; repeated rows are counted each for itself;
    further columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    counts = written(vocabulary_counts(docs, vocabulary, offset), "pretoken-counts")
    top = counts.where(F.octet_length("pretoken") <= FREQUENT_BYTES).orderBy(F.desc("n"), "pretoken").limit(frequent).select("pretoken", "n_tokens").toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(map(bytes, top["pretoken"].to_pylist()), top["n_tokens"].to_pylist(), strict=True)))
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes")
    thin = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), size, "text")
    # written, so that a row keeps its number
    rows = written(thin.mapInArrow(_summed(shared), _SUMMED), "known-tokens")
    # a long pre-token may be in very many documents: its count is dealt to several tasks
    long = F.octet_length("pretoken") > FREQUENT_BYTES
    held = rows.select("row", F.inline("others")).withColumn("salt", F.when(long, F.pmod("row", F.lit(SALTS))).otherwise(0).cast("int"))
    dealt = counts.select("pretoken", "n_tokens", F.explode(F.when(long, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    others = held.join(dealt, ["pretoken", "salt"])
    more = others.groupBy("row").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("more"))
    return rows.join(more, "row", "left").select("doc_id", "n_bytes", "n_pretokens", (F.col("n_tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
