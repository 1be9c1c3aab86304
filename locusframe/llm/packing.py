"""Harmonic packing of token sequences.

A document's whole sequences fill bins by themselves. What remains of it has a length of some
class: class k holds lengths above 1/(k + 1) and up to 1/k of the capacity. The bins of class k
hold exactly k remainders, uncut. The gap that is left there is filled from a reserve: a few
remainders that are set aside to be cut. Tasks fill their bins independently; what waits in
part-filled bins at a task's end is laid end to end into whole sequences, and the last of these
is split into sequences whose lengths are powers of two. So no sequence needs padding.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_batches
from .textscan import slices

if TYPE_CHECKING:
    from tokenizers import Tokenizer

END_ID = (0).to_bytes(4, "little")
#: Units (a word with the white space before it) whose ids a worker remembers, at about 250 bytes each.
MEMO = 600_000
#: Longer units are encoded without being remembered.
LONGEST = 256
#: Texts of about so many bytes are encoded together.
SLICE = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of UTF-8: the last, middle and first ones of white space beyond ASCII (U+0085, U+00A0, U+1680, U+20xx, U+3000).
_DOUBTFUL, _MIDDLE, _LEAD = np.zeros((3, 256), bool)
_DOUBTFUL[[*range(0x1C, 0x20), *range(0x80, 0xC0)]] = True
_MIDDLE[[0x80, 0x81, 0x9A]] = True
_LEAD[[0xE1, 0xE2, 0xE3]] = True
#: White space that isn't ASCII, and controls which some definitions count as such.
_OTHER_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def units(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The units of some texts in order, as a dictionary column, and where each begins.

    A unit is a run of white space and what follows it up to the next. It doesn't end in white
    space beyond ASCII (nor in some like characters), which belongs to one run with what follows.
    """
    space = _SPACE[data]
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    at = np.flatnonzero(starts)
    at = at[(at > 2) & _DOUBTFUL[data[at - 1]]]
    last, middle, lead = data[at - 1], data[at - 2], data[at - 3]
    starts[at[(last < 0x20) | (middle == 0xC2) | _MIDDLE[middle] & _LEAD[lead]]] = False
    if len(starts) > 2:
        starts[1:3] = False
    starts[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    first = np.flatnonzero(starts).astype(np.int32)
    offsets = np.append(first, np.int32(len(data)))
    column = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return column.dictionary_encode(), first


def _letters() -> dict[int, int]:
    """Characters that stand for bytes in byte-level BPE: printable ones for themselves, the others from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


class _Parts(dict):
    """Ids of pre-tokens as little-endian unsigned 32-bit bytes, from the tokenizer's model."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokens, self.letters = tokenizer.model.tokenize, _letters()
        self.space = chr(self.letters[0x20])

    def __missing__(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():
            spelled = part.replace(" ", self.space)
        else:
            spelled = part.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.tokens(spelled)]).tobytes()
        if len(part) <= LONGEST:
            self[part] = ids
        return ids


class _Encoder(dict):
    """Ids of units, and of pre-tokens; both memories have a bound.

    No pre-token reaches from other characters into white space, so the ids of a text are those
    of its units. A text
    that holds an added token or white space beyond ASCII goes to the tokenizer's own encode whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = _Parts(self.tokenizer)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = "|".join([*added, _OTHER_SPACE])
        self.split = regex.compile(public_tokenizers.PATTERN).findall

    def __missing__(self, unit: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.split(unit)))

    def learn(self, units: list[str]) -> None:
        """Remember units that begin with white space. Laid end to end they are split at once."""
        parts = self.split("".join(units))
        ids = list(map(self.parts.__getitem__, parts))
        upto = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        ends = np.searchsorted(upto, np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))) + 1
        begin = 0
        for unit, end in zip(units, ends.tolist(), strict=True):
            self[unit] = ids[begin] if end == begin + 1 else b"".join(ids[begin:end])
            begin = end

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, end to end, and the bounds of each text's; no text goes to encode whole."""
        for memory in (self, self.parts):
            if len(memory) > MEMO:
                memory.clear()
        coded, first = units(data, bounds)
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        self.learn([u for u in names if u not in self and len(u) <= LONGEST and u[0].isspace() and not u[-1].isspace()])
        known = list(map(self.__getitem__, names))
        values = np.frombuffer(b"".join(known), "<u4")
        length = np.array(list(map(len, known)), np.int64) // 4
        begin = np.cumsum(length) - length
        unit = coded.indices.to_numpy()
        per_unit = length[unit]
        upto = np.concatenate([[0], np.cumsum(per_unit)])
        place = np.repeat(begin[unit] - upto[:-1], per_unit) + np.arange(upto[-1])
        return values[place], upto[np.searchsorted(first, bounds)]

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column, with END_ID after them; nulls count as empty."""
        import pyarrow.compute as pc

        whole = pc.match_substring_regex(texts, self.apart).fill_null(False)
        plain = pc.if_else(whole, "", texts) if whole.true_count else texts
        at = 0
        for part in slices(plain, SLICE):
            ids, bounds = self.encode(part.data, part.bounds)
            for k in range(len(bounds) - 1):
                if whole[at].as_py():
                    own = np.array(self.tokenizer.encode(texts[at].as_py(), add_special_tokens=False).ids, "<u4")
                else:
                    own = ids[bounds[k] : bounds[k + 1]]
                yield own.tobytes() + END_ID
                at += 1


@lru_cache(1)
def _encoder(path: str) -> _Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _Encoder(path)


#: doc_id, first id in the document, the document's number of ids, ids.
Piece = tuple[int | None, int, int, bytes]


class Bins:
    """The bins of one task. Bin numbers are unique across tasks by the task's number in the upper bits."""

    def __init__(self, capacity: int, task: int):
        self.capacity, self.next = capacity, task << 36
        self.open: dict[int, list[Piece]] = {}
        self.reserve: deque[Piece] = deque()
        self.reserved = 0

    def _close(self, pieces: list[Piece]) -> list[tuple]:
        rows, offset = [], 0
        for p in pieces:
            rows.append((*p, self.next, offset))
            offset += len(p[3]) // 4
        self.next += 1
        return rows

    def _from_reserve(self, n: int) -> list[Piece]:
        """The first n ids of the reserve."""
        taken = []
        self.reserved -= n
        while n:
            doc, start, total, ids = self.reserve.popleft()
            if len(ids) > 4 * n:
                self.reserve.appendleft((doc, start + n, total, ids[4 * n :]))
                ids = ids[: 4 * n]
            taken.append((doc, start, total, ids))
            n -= len(ids) // 4
        return taken

    def put(self, doc: int | None, ids: bytes) -> list[tuple]:
        """Lay a document in; the pieces of the bins that are full by it."""
        total, rows = len(ids) // 4, []
        start = total - total % self.capacity
        for at in range(0, start, self.capacity):
            rows += self._close([(doc, at, total, ids[4 * at : 4 * (at + self.capacity)])])
        if start == total:
            return rows
        rest = (doc, start, total, ids[4 * start :])
        if self.reserved < self.capacity:
            self.reserve.append(rest)
            self.reserved += total - start
            return rows
        fit = self.capacity // (total - start)
        waiting = self.open.setdefault(fit, [])
        waiting.append(rest)
        if len(waiting) == fit:
            del self.open[fit]
            gap = self.capacity - sum(len(p[3]) // 4 for p in waiting)
            rows += self._close(waiting + self._from_reserve(gap))
        return rows

    def rest(self) -> Iterator[tuple]:
        """What waits at the end, in whole sequences and then in powers of two."""
        waiting = [p for _, pieces in sorted(self.open.items()) for p in pieces]
        self.reserve.extendleft(reversed(waiting))
        self.reserved += sum(len(p[3]) // 4 for p in waiting)
        self.open.clear()
        while self.reserved:
            yield from self._close(self._from_reserve(min(self.capacity, 1 << (self.reserved.bit_length() - 1))))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _rows(found: list[tuple]) -> pa.RecordBatch:
    doc, start, total, ids, sequence, offset = zip(*found, strict=True) if found else ((),) * 6
    columns = [doc, start, [len(x) // 4 for x in ids], total, ids, sequence, offset]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most ``capacity`` (a power of two) tokens.

    Returns for each piece: doc_id, start and length in its document's ids, doc_tokens, ids
    (little-endian unsigned 32-bit), sequence_id and offset there. Ids are those of the
    tokenizer's ``encode`` without special tokens around them; strings of added tokens in a text
    count as these tokens, as they do there. Each document ends with id 0, so a null or empty
    text has one token. Every sequence's length is ``capacity`` or, for up to ten sequences of a
    task, a lesser power of two, so no padding is needed. Repeated rows are packed each for
    itself; further columns are ignored; an empty table has no pieces.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = _encoder(tokenizer), Bins(capacity, TaskContext.get().partitionId())
        found: list[tuple] = []
        held = 0
        for batch in batches:
            for doc, ids in zip(batch["doc_id"].to_pylist(), encoder.batch(batch["text"]), strict=True):
                found += bins.put(doc, ids)
                held += len(ids)
                if held > 4 << 20:
                    yield _rows(found)
                    found, held = [], 0
        yield _rows(found + list(bins.rest()))

    schema = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
