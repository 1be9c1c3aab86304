"""Seeds: informative k-mers that sequences share with a few references, looked up in a packed and sorted index.

The index holds two bits a base. It is broadcast while the references have a bounded number
of bases; with more, the same seeds come from a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import positions as po
from ..storage import staged
from .sequences import informative_kmers

#: References of up to so many bases are broadcast (16 bytes each), and so many bases of sequences are looked up at once.
INDEX_BASES, PART_BASES = 1 << 23, 1 << 20
#: Diagonals of a pair lie within half of this.
_SPAN = 1 << 34
_CODES = np.full(256, 4, np.int64)
_CODES[[*b"ACGT"]] = range(4)


class Kmers(NamedTuple):
    """Packed informative k-mers, with the number of their sequence and their place in it."""

    kmer: np.ndarray
    owner: np.ndarray
    at: np.ndarray


def packed(seqs: list[bytes], k: int) -> Kmers:
    """The k-mers of some sequences of which every letter is A, C, G or T, and none makes up four fifths."""
    codes = _CODES[np.frombuffer(b"".join(s + b"\n" for s in seqs), np.uint8)]
    n = max(0, len(codes) - k + 1)
    kmer, good = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(k):
        kmer = kmer * 4 + (codes[j : j + n] & 3)
    for letter in range(5):
        upto = np.concatenate([[0], np.cumsum(codes == letter)])
        count = upto[k:] - upto[:-k] if n else upto[:0]
        good &= count == 0 if letter == 4 else 5 * count < 4 * k
    at = np.flatnonzero(good)
    starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in seqs])[:-1]]) if seqs else np.zeros(0, np.int64)
    owner = np.searchsorted(starts, at, "right") - 1
    return Kmers(kmer[at], owner, at - starts[owner])


class Index(NamedTuple):
    """K-mers of references in order, and the references' names."""

    kmers: Kmers
    refs: np.ndarray

    @classmethod
    def of(cls, refs: list[int], seqs: list[bytes], k: int) -> Index:
        found = packed(seqs, k)
        order = np.argsort(found.kmer, kind="stable")
        return cls(Kmers(*(x[order] for x in found)), np.array(refs, np.int64))

    def seeds(self, seqs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the sequence, name of the reference, and diagonal (place there less place here) of each shared k-mer."""
        own = packed(seqs, k)
        first = np.searchsorted(self.kmers.kmer, own.kmer, "left")
        n = np.searchsorted(self.kmers.kmer, own.kmer, "right") - first
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return np.repeat(own.owner, n), self.refs[self.kmers.owner[at]], self.kmers.at[at] - np.repeat(own.at, n)


def best_bands(owner: np.ndarray, ref: np.ndarray, diagonal: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """For each owner and ref: how many seeds the densest band of diagonals has, its first and last; the first of equal ones."""
    order = np.lexsort((diagonal, ref, owner))
    owner, ref, diagonal = owner[order], ref[order], diagonal[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (ref[1:] != ref[:-1])
    pair = np.cumsum(new) - 1
    place = pair * _SPAN + diagonal + _SPAN // 2
    low = np.searchsorted(place, place - width, "left")
    n = np.searchsorted(place, place, "right") - low
    best = np.lexsort((diagonal, -n, pair))
    best = best[np.flatnonzero(np.diff(pair[best], prepend=-1))]
    return owner[best], ref[best], n[best], diagonal[low[best]], diagonal[best]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    for batch in batches:
        ids, seqs = batch["id"], [s.encode("ascii", "replace") for s in batch["seq"].fill_null("").to_pylist()]
        ends = np.cumsum([len(s) for s in seqs])
        first = 0
        while first < len(seqs):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + PART_BASES, "right")))
            yield ids.slice(first, last - first), seqs[first:last]
            first = last


def _looked_up(sequences: DataFrame, references: DataFrame, k: int, columns: str, told: Callable) -> DataFrame:
    """A row for each of what ``told`` makes of a slice's seeds, with the ids of its sequences."""
    rows = references.select("ref", "seq").collect()  # bounded by the caller
    index = references.sparkSession.sparkContext.broadcast(Index.of([r["ref"] for r in rows], [(r["seq"] or "").encode("ascii", "replace") for r in rows], k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, seqs in _slices(batches):
            owner, *rest = told(*index.value.seeds(seqs, k))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), *(pa.array(np.asarray(x, np.int64)) for x in rest)], ["id", *columns.split()])

    kind = sequences.schema["id"].dataType.simpleString()
    return sequences.select("id", "seq").mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in columns.split()))


def _is_small(references: DataFrame) -> bool:
    return (references.agg(F.sum(F.length("seq"))).collect()[0][0] or 0) <= INDEX_BASES


def _joined(sequences: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """Seeds by a join. Sequences are written first: their expression would be worked out again for each k-mer."""
    own = staged(sequences.select("id", "seq"), "sequences").select("id", F.inline(informative_kmers(F.col("seq"), k))).withColumnRenamed("position", "q_at")
    index = staged(references.select("ref", "seq"), "references").select(F.col("ref").cast("long").alias("ref"), F.inline(informative_kmers(F.col("seq"), k))).withColumnRenamed("position", "c_at")
    return own.join(index, "kmer").select("id", "ref", (F.col("c_at") - F.col("q_at")).cast("long").alias("diagonal"))


def seeds(sequences: DataFrame, references: DataFrame, k: int = 11) -> DataFrame:
    """A row (id, ref, diagonal) for each informative k-mer of a sequence (id, seq) and place of it in a reference (ref, seq)."""
    if not _is_small(references):
        return _joined(sequences, references, k)
    return _looked_up(sequences, references, k, "ref diagonal", lambda *found: found)


def bands(sequences: DataFrame, references: DataFrame, k: int = 11, width: int = 20) -> DataFrame:
    """The densest band of the seeds of each sequence and reference: id, ref, seeds, first, last (see positions.densest_band).

    Ids are distinct, so a sequence's seeds never leave its task.
    """
    if not _is_small(references):
        return po.densest_band(_joined(sequences, references, k), ["id", "ref"], "diagonal", width)
    return _looked_up(sequences, references, k, "ref seeds first last", lambda *found: best_bands(*found, width))
