"""Local alignment with affine gaps, row by row of many pairs at once in numpy, as a pandas UDF over pairs of strings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring scheme: match, mismatch, opening a gap, each of its bases.
MATCH, MISMATCH, GAP_OPEN, GAP_BASE = 2, -3, 5, 2
SCHEMA = "score int, matches int, columns int, query_start int, query_end int, target_start int, target_end int"
_NONE = -(1 << 20)
#: Cells of the matrices that are worked on at once, 12 bytes each.
CELLS = 1 << 20


def _letters(seqs: list[str], filling: int) -> np.ndarray:
    """One row of letters for each sequence, filled up with one that no other row has."""
    out = np.full((len(seqs), max(map(len, seqs))), filling, np.uint8)
    for row, seq in zip(out, seqs, strict=True):
        row[: len(seq)] = np.frombuffer(seq.upper().encode("ascii", "replace"), np.uint8)
    return out


def _same_size(queries: list[str], targets: list[str]) -> np.ndarray:
    """Results of align for pairs of about the same size, all pairs of a row of the matrix at once.

    What a row is filled up with matches nothing, so no best alignment ends or passes there.
    """
    q, t = _letters(queries, 1), _letters(targets, 2)
    (pairs, n), m = q.shape, t.shape[1]
    best = np.zeros((n + 1, pairs, m + 1), np.int32)
    across, down = np.full_like(best, _NONE), np.full_like(best, _NONE)
    cost = GAP_BASE * np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        letter = q[:, i - 1 : i]
        pair = np.where((t == letter) & (letter != ord("N")), MATCH, MISMATCH).astype(np.int32)
        down[i] = np.maximum(best[i - 1] - GAP_OPEN, down[i - 1]) - GAP_BASE
        row = np.maximum(down[i], 0)
        row[:, 1:] = np.maximum(row[:, 1:], best[i - 1, :, :-1] + pair)
        row[:, 0] = 0
        # a gap along the row begins at the best cell before, less what each base since has cost
        reach = np.maximum.accumulate(row + cost, axis=1)
        across[i, :, 1:] = reach[:, :-1] - GAP_OPEN - cost[1:]
        best[i] = np.maximum(row, across[i])
    every = np.arange(pairs)
    i = best.max(axis=2).argmax(axis=0)
    j = best[i, every].argmax(axis=1)
    score, stop_i, stop_j = best[i, every, j], i.copy(), j.copy()
    matches, columns, gap, length = np.zeros((4, pairs), np.int64)  # gap: 0 none, 1 along the target, 2 along the query; length so far
    going = score > 0
    while going.any():
        # each pair goes back one step, or looks one cell further for where its gap began
        p = np.flatnonzero(going & (gap == 0))
        here, x, y = best[i[p], p, j[p]], i[p], j[p]
        same = (q[p, x - 1] == t[p, y - 1]) & (q[p, x - 1] != ord("N"))
        stepped = here == best[x - 1, p, y - 1] + np.where(same, MATCH, MISMATCH)
        on = p[stepped]
        matches[on] += same[stepped]
        columns[on], i[on], j[on] = columns[on] + 1, i[on] - 1, j[on] - 1
        off = ~stepped
        gap[p[off]] = np.where(here[off] == across[x[off], p[off], y[off]], 1, 2)
        length[p[off]] = 0
        for kind, table in ((1, across), (2, down)):
            p = np.flatnonzero(going & (gap == kind))
            length[p] += 1
            x, y = i[p] - length[p] * (kind == 2), j[p] - length[p] * (kind == 1)
            began = best[x, p, y] - GAP_OPEN - GAP_BASE * length[p] == table[i[p], p, j[p]]
            done = p[began]
            columns[done] += length[done]
            i[done], j[done], gap[done] = x[began], y[began], 0
        going &= (gap != 0) | (best[i, every, j] > 0)
    found = np.stack([score, matches, columns, i, stop_i, j, stop_j], axis=1)
    found[score <= 0] = 0
    return found


def align_all(queries: list[str], targets: list[str]) -> np.ndarray:
    """Score, matches, columns and half-open ranges of the best local alignment of each pair; all 0 without one.

    N matches nothing. Of equal scores the first end in query order, then target order, counts.
    Going back, a pair of bases is preferred to a gap in the query, and that to one in the target. Pairs
    are sorted by size and aligned together, CELLS of all their matrices at once (or one pair).
    """
    out = np.zeros((len(queries), 7), np.int64)
    filled = [k for k in range(len(queries)) if queries[k] and targets[k]]
    order = sorted(filled, key=lambda k: (len(targets[k]), len(queries[k])))
    while order:
        n = m = taken = 0
        for k in order:
            n, m = max(n, len(queries[k])), max(m, len(targets[k]))
            if taken and (taken + 1) * (n + 1) * (m + 1) > CELLS:
                break
            taken += 1
        some, order = order[:taken], order[taken:]
        out[some] = _same_size([queries[k] for k in some], [targets[k] for k in some])
    return out


def align(query: str, target: str) -> tuple[int, ...]:
    """See align_all."""
    return tuple(align_all([query], [target])[0].tolist())


def local_alignment(query: Column, target: Column) -> Column:
    """Struct of the best local alignment (see align); nulls count as empty."""

    @F.pandas_udf(SCHEMA)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pd.DataFrame(align_all([x or "" for x in a], [y or "" for y in b]), columns=names).astype("int32")

    return run(query, target)
