"""Whether a clip is explained by a longer tract of the reference, as a pandas UDF over short strings."""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the method: letters of an anchor, distinct ones in it, letters that may be skipped at the
# read's end and the room that each adds, the room without, the shortest homopolymer and its distance.
ANCHOR, DISTINCT, TRIMS, TRIM_ROOM, ROOM = 8, 3, 2, 3, 30
HOMOPOLYMER, REACH = 10, 3
LEFT = 0
_RUN = re.compile(r"(.)\1*", re.DOTALL)


def compressed(seq: str) -> tuple[str, list[int]]:
    """A sequence with each run as one letter, and where each run begins; the sequence's length comes last."""
    found = list(_RUN.finditer(seq))
    return "".join(m[1] for m in found), [*(m.start() for m in found), len(seq)]


class Window:
    """A piece of the reference, with an index of the anchors of its compressed form: where each begins and ends."""

    def __init__(self, seq: str):
        self.seq = seq
        letters, edges = compressed(seq)
        self.anchors: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i in range(len(letters) - ANCHOR + 1):
            self.anchors[letters[i : i + ANCHOR]].append((edges[i], edges[i + ANCHOR]))

    def explains(self, rest: str, side: int, expected: int) -> bool | None:
        """Whether the far end of a clip lies where a longer tract would put it; None if it tells nothing.

        The far end is the clip's outermost anchor. Letters at the read's very end may be
        wrong, so the anchors one and two letters further in are tried as well, with more room.
        """
        own = compressed(rest)[0]
        outermost = [own[t : t + ANCHOR] if side == LEFT else own[len(own) - t - ANCHOR : len(own) - t] for t in range(TRIMS + 1) if len(own) >= t + ANCHOR]
        telling = [(t, word) for t, word in enumerate(outermost) if len(set(word)) >= DISTINCT]
        if not telling:
            return None
        return any(abs(places[side != LEFT] - expected) <= ROOM + TRIM_ROOM * t for t, word in telling for places in self.anchors.get(word, ()))

    def has_run(self, boundary: int, base: str) -> bool:
        """Whether a long run of a base lies at a boundary."""
        runs = re.finditer(f"{re.escape(base)}{{{HOMOPOLYMER},}}", self.seq)
        return any(m.start() - REACH <= boundary <= m.end() + REACH for m in runs)


def against_reference(clip: Column, side: Column, boundary: Column, tail_base: Column, tail_length: Column, window: Column) -> Column:
    """Struct for a clip and the reference around it: found, beyond_tail and homopolymer.

    ``boundary`` is the junction in the window. found: see Window.explains, for the clip without the
    pure run of its tail. beyond_tail: whether what follows the whole tail tells anything;
    null without a tail. homopolymer: whether the tail's base makes a long run there.
    """

    @F.pandas_udf("found boolean, beyond_tail boolean, homopolymer boolean")
    def run(clips: pd.Series, sides: pd.Series, places: pd.Series, bases: pd.Series, lengths: pd.Series, windows: pd.Series) -> pd.DataFrame:
        known = {seq: Window(seq) for seq in windows.unique()}
        rows = []
        for seq, at_side, at, base, length, ref in zip(clips, sides, places, bases, lengths, windows, strict=True):
            around, left = known[ref], at_side == LEFT
            expected = at - len(seq) if left else at + len(seq)
            if not isinstance(base, str):
                rows.append((around.explains(seq, at_side, expected), None, False))
                continue
            bare = seq.rstrip(base) if left else seq.lstrip(base)
            after = seq[: max(len(seq) - int(length), 0)] if left else seq[int(length) :]
            rows.append((around.explains(bare, at_side, expected), around.explains(after, at_side, expected) is not None, around.has_run(at, base)))
        return pd.DataFrame(rows, columns=["found", "beyond_tail", "homopolymer"]).astype({"found": "boolean", "beyond_tail": "boolean", "homopolymer": "boolean"})

    return run(clip, side, boundary, tail_base, tail_length, window)
