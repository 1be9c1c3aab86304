"""Junction contigs from reads, by a table of which letter follows which k - 1 letters; a pandas UDF over bounded sets of reads."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the method: k-mer size, least count, longest contig, letters before a long run,
# nearest and farthest seed, matches after a variant, least insert, longest duplicated site, least tail and its share.
K, LEAST, LONGEST, RUN_ANCHOR = 21, 2, 600, 8
NEAREST, FARTHEST, AFTER_VARIANT, INSERT, SITE = 3, 40, 8, 10, 50
_FLIP = str.maketrans("ACGT", "TGCA")
_KMERS = re.compile(f"(?=([ACGT]{{{K}}}))")
SCHEMA = "left_junction long, left_contig string, left_insert string, right_junction long, right_contig string, right_insert string, tail_base string, tail_length int"


def flipped(seq: str) -> str:
    """The other strand; letters besides A, C, G and T stay."""
    return seq[::-1].translate(_FLIP)


class Successors:
    """The k-mers of some reads, and the one letter that clearly follows each k - 1 letters."""

    def __init__(self, reads: list[str]):
        self.text = "\n".join(reads)
        self.counts = Counter(_KMERS.findall(self.text))
        self.next: dict[str, str] = {}
        for stem, kmers in groupby(sorted(self.counts), key=lambda k: k[:-1]):
            well_known = sorted((-self.counts[k], k[-1]) for k in kmers if self.counts[k] >= LEAST)
            if well_known and all(well_known[0][0] < 2 * n for n, _ in well_known[1:]):
                self.next[stem] = well_known[0][1]

    def path(self, stem: str, passed: set[str]) -> Iterator[str]:
        """Letters while each is clear, up to a k-mer that was passed before or a run as long as the stem."""
        while (letter := self.next.get(stem)) and stem.strip(letter) and stem + letter not in passed:
            passed.add(stem + letter)
            stem = stem[1:] + letter
            yield letter

    def beyond_run(self, contig: str) -> str:
        """The rest of the run that a contig ends with, and a letter; nothing if too few reads span the run.

        Reads are looked at that have the letters before the run, the run so far or more, and
        another letter: the median of their runs counts, and the letter that most have after it.
        """
        letter = contig[-1]
        before = contig.rstrip(letter)
        so_far = len(contig) - len(before)
        if len(before) < RUN_ANCHOR:
            return ""
        spans = re.findall(f"(?={before[-RUN_ANCHOR:]}({letter}{{{so_far},}})([^{letter}\n]))", self.text)
        if len(spans) < LEAST:
            return ""
        lengths = np.sort([len(run) for run, _ in spans])
        after, votes = np.unique([x for _, x in spans], return_counts=True)  # in order, so that the least of equals wins
        return letter * (int(lengths[(len(lengths) - 1) // 2]) - so_far) + str(after[votes.argmax()])

    def contig(self, seed: str) -> str:
        """The seed and what follows it: clear paths, and runs that reads lead over; to LONGEST letters, or an N after a run."""
        grown, passed, step = seed, {seed}, "?"
        while step and step[-1] != "N" and len(grown) < LONGEST:
            grown += "".join(islice(self.path(grown[1 - K :], passed), LONGEST - len(grown)))
            stem = grown[1 - K :]
            at_run = len(set(stem)) == 1 and self.next.get(stem) == stem[0]
            step = self.beyond_run(grown) if at_run else ""
            grown += step
        return grown[:LONGEST]


def on_flank(contig: str, reference: str) -> int | None:
    """Leading letters that lie on the flank: up to the first mismatch that isn't a lone variant. None if there is none.

    A lone variant has AFTER_VARIANT matches right after it.
    """
    n = min(len(contig), len(reference))
    equal = np.frombuffer(contig[:n].encode(), np.uint8) == np.frombuffer(reference[:n].encode(), np.uint8)
    wrong = np.flatnonzero(~equal)
    matches = np.diff(np.append(wrong, n)) - 1
    leaves = wrong[matches < AFTER_VARIANT]
    return int(leaves[0]) if len(leaves) else None


class Side(NamedTuple):
    junction: int
    contig: str
    insert: str


def leaving(reads: list[str], flank: str, edge: int) -> tuple[int, str, int] | None:
    """A contig that leaves a flank near ``edge``: where its seed begins, the contig, and its letters on the flank.

    The seed is the k-mer of the flank, of those that end NEAREST to FARTHEST before the edge, that is nearest and that the reads hold.
    """
    known = Successors(reads)
    ends = (edge - gap for gap in range(NEAREST, FARTHEST + 1))
    begin = next((e - K for e in ends if K <= e <= len(flank) and known.counts[flank[e - K : e]] >= LEAST), None)
    if begin is None:
        return None
    contig = known.contig(flank[begin : begin + K])
    inside = on_flank(contig, flank[begin:])
    return None if inside is None or len(contig) - inside < INSERT else (begin, contig, inside)


def tail_of(insert: str, at_end: bool, least: int, share: float) -> tuple[int, str] | None:
    """Length of the pure run and base of the A or T tail at the junction end of an insert, if the insert goes beyond it."""
    letters = np.frombuffer((insert[::-1] if at_end else insert).encode(), np.uint8)
    place = np.arange(1, len(letters) + 1)

    def reach(base: str) -> int:
        own = letters == ord(base)
        return int((place * (own & (np.cumsum(own) >= share * place))).max(initial=0))

    base = max("AT", key=reach)
    other = np.flatnonzero(letters != ord(base))
    return (int(other[0]), base) if reach(base) >= least and len(other) else None


def assemble(left_reads: list[str], right_reads: list[str], inside: list[str], window: str, start: int, left: int | None, right: int | None, least: int = 10, share: float = 0.8) -> tuple[Side | None, Side | None, tuple[int, str] | None]:
    """The sides that the reads assemble, and the tail; the window begins at ``start``.

    The right side is the left one of the other strand.
    """
    both = [x for r in inside for x in (r, flipped(r))]
    sides: list[Side | None] = [None, None]
    if left is not None and (found := leaving(left_reads + both, window, left - start)):
        at, contig, on = found
        sides[0] = Side(start + at + on, contig, contig[on:])
    if right is not None and (found := leaving([flipped(r) for r in right_reads] + both, flipped(window), start + len(window) - right)):
        at, contig, on = found
        sides[1] = Side(start + len(window) - at - on, flipped(contig), flipped(contig[on:]))
    tails = [tail_of(s.insert, k == 1, least, share) for k, s in enumerate(sides) if s]
    longest = max((t for t in tails if t), key=lambda t: t[0], default=None)
    if len(tails) == 2 and all(tails) and tails[0][0] == tails[1][0]:
        longest = tails[1]
    return sides[0], sides[1], longest


def assembled(columns: dict[str, Column], least: int = 10, share: float = 0.8) -> Column:
    """Struct of SCHEMA from the columns left_reads, right_reads, inside (arrays), window, start, left and right."""

    @F.pandas_udf(SCHEMA)
    def run(lefts: pd.Series, rights: pd.Series, insides: pd.Series, windows: pd.Series, starts: pd.Series, left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, c, window, start, x, y in zip(lefts, rights, insides, windows, starts, left, right, strict=True):
            one, two, tail = assemble(list(a), list(b), list(c), window, int(start), None if pd.isna(x) else int(x), None if pd.isna(y) else int(y), least, share)
            rows.append((*(one or (None,) * 3), *(two or (None,) * 3), tail[1] if tail else None, tail[0] if tail else None))
        frame = pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")])
        return frame.astype({"left_junction": "Int64", "right_junction": "Int64", "tail_length": "Int32"})

    return run(*[columns[c] for c in ("left_reads", "right_reads", "inside", "window", "start", "left", "right")])
