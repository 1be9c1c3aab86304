"""Benchmark decontamination by SimHash over item-sized windows.

Benchmark items are grouped into size classes. Each text is read through windows of each
class's size, which is a little below what may be left of its shortest item (three fifths of its
longest at least): so also an item that is cut off holds a window whole. A window's 64-bit SimHash over its word pairs is looked up in a multi-index of
the items' fingerprints, which by the pigeonhole principle holds all items within the Hamming
radius: the fingerprint is cut into blocks, and two fingerprints within the radius differ in
some block by at most radius // blocks bits. A similarity doesn't bound the distance of two
fingerprints, so each item also has anchors: its rarest shingles that weigh together more than
may be missing at the similarity, so a window without any of them is below it. Pairs of a text
and an item that fingerprints or anchors point to are verified by the exact weighted Jaccard
similarity of five-word shingles (each shingle weighs as often as it occurs) of all windows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_batches
from .textscan import SHINGLE_WORDS, Slice, slices, windows, words

RADIUS = 11
BLOCKS = 4
BITS = 64
#: A class's window is this share of the similarity times its shortest item: what is left of an
#: item that is cut off within the similarity holds its first or its last window whole.
BASE_SHARE = 0.975
#: An item is represented by windows of at least this share of the similarity times its length.
CLASS_SHARE = 0.75
#: Items of the benchmark, and bytes of their texts, that are held by a task at once (a longer item stands alone).
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 32 << 20
#: Small slices keep the running sums in the processor's cache.
SLICE = 1 << 17
_BLOCK_BITS = BITS // BLOCKS
_NEAR = np.array([sum(1 << b for b in c) for d in range(RADIUS // BLOCKS + 1) for c in combinations(range(_BLOCK_BITS), d)], np.uint16)


def _pair_bits(hashes: np.ndarray, kind: type) -> np.ndarray:
    """Running sums of the 64 bits of each pair of neighbouring words, one row more than pairs.

    They wrap around in the given unsigned type; differences over windows it can count are right.
    """
    pairs = windows_all(hashes, 2)
    bits = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(pairs) + 1, BITS), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=sums[1:])
    return sums


def windows_all(hashes: np.ndarray, size: int) -> np.ndarray:
    """Window hashes at every word, also across the bounds of texts."""
    return windows(hashes, np.zeros(len(hashes), np.int8), size)[0]


def _prints(sums: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SimHash of ``size`` pairs from each of the given pairs on: a bit is set if it is in most of them."""
    if len(at) and at[-1] - at[0] + 1 == len(at):
        total = sums[at[0] + size : at[-1] + 1 + size] - sums[at[0] : at[-1] + 1]
    else:
        total = sums[at + size] - sums[at]
    return np.packbits(total > total.dtype.type(size // 2), axis=1, bitorder="little").view(np.uint64).ravel()


class Index:
    """The benchmark items by size class, with their fingerprints in a multi-index."""

    def __init__(self, ids: list[int], texts: list[str | None], threshold: float = 0.8):
        self.items: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        by_class: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        hashes = []
        for item_id, text in zip(ids, texts, strict=True):
            found = [words(p, plain=True).hash for p in slices(pa.array([text], pa.string()), 1 << 62)]
            h = found[0] if found else np.zeros(0, np.uint64)
            if len(h) >= SHINGLE_WORDS:
                self.items.append((item_id, len(h), *np.unique(windows_all(h, SHINGLE_WORDS), return_counts=True)))
                hashes.append(h)
        self.classes = []
        base = None
        for i in sorted(range(len(self.items)), key=lambda i: self.items[i][1]):
            pairs = self.items[i][1] - 1
            if base is None or base < CLASS_SHARE * threshold * pairs:
                base = max(1, int(BASE_SHARE * threshold * pairs))
            for offset in {0, pairs - base}:
                by_class[base].append((self._print(hashes[i], offset, base), i, offset))
        for base, rows in sorted(by_class.items()):
            prints = np.array([r[0] for r in rows], np.uint64)
            tables = []
            for b in range(BLOCKS):
                own = (prints >> np.uint64(b * _BLOCK_BITS)).astype(np.uint16)
                value = (own[:, None] ^ _NEAR[None, :]).ravel()
                entry = np.repeat(np.arange(len(rows)), len(_NEAR))
                order = np.argsort(value, kind="stable")
                bounds = np.searchsorted(value[order], np.arange((1 << _BLOCK_BITS) + 1))
                tables.append((bounds.astype(np.int32), entry[order].astype(np.int32)))
            self.classes.append((base, prints, [(r[1], r[2]) for r in rows], tables))
        self._anchor(threshold)
        self.counter = next(k for k in (np.uint8, np.uint16, np.uint32) if base is None or base <= np.iinfo(k).max)

    @staticmethod
    def _print(hashes: np.ndarray, offset: int, size: int) -> int:
        return int(_prints(_pair_bits(hashes, np.uint32), np.array([offset]), size)[0])

    def _anchor(self, threshold: float) -> None:
        """Sorted shingles of all items, and for each the items that it is an anchor of."""
        self.shingles, held = np.unique(np.concatenate([np.zeros(0, np.uint64), *(i[2] for i in self.items)]), return_counts=True)
        owners, slots = [], []
        for i, (_, length, known, weights) in enumerate(self.items):
            at = np.searchsorted(self.shingles, known)
            rarest = np.argsort(held[at], kind="stable")
            total = length - SHINGLE_WORDS + 1
            before = np.cumsum(weights[rarest]) - weights[rarest]
            chosen = at[rarest[total - before >= threshold * total - 1e-9]]
            slots.append(chosen)
            owners.append(np.full(len(chosen), i))
        slot, owner = np.concatenate([np.zeros(0, np.int64), *slots]), np.concatenate([np.zeros(0, np.int64), *owners])
        order = np.argsort(slot, kind="stable")
        self.anchors, self.bounds = owner[order], np.searchsorted(slot[order], np.arange(len(self.shingles) + 1))
        self.shift = np.uint64(64 - min(24, max(12, len(self.shingles).bit_length() + 3)))
        self.some = np.zeros(1 << (64 - int(self.shift)), bool)
        self.some[self.shingles >> self.shift] = True

    def _known(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the shingles that some item has, and their numbers among the items' shingles."""
        at = np.flatnonzero(self.some[shingles >> self.shift])
        slot = np.searchsorted(self.shingles, shingles[at])
        same = self.shingles[np.minimum(slot, len(self.shingles) - 1)] == shingles[at] if len(self.shingles) else np.zeros(0, bool)
        return at[same], slot[same]

    def near(self, prints: np.ndarray, known: np.ndarray, tables: list) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a window and an entry whose fingerprints differ in at most RADIUS bits."""
        at, entries = [], []
        for b, (bounds, entry) in enumerate(tables):
            block = (prints >> np.uint64(b * _BLOCK_BITS)).astype(np.uint16)
            some = np.flatnonzero((bounds[1:] > bounds[:-1])[block])
            low = bounds[block[some]]
            n = bounds[block[some].astype(np.int32) + 1] - low
            window = np.repeat(some, n)
            slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)
            e = entry[slot]
            close = np.bitwise_count(prints[window] ^ known[e]) <= RADIUS
            at.append(window[close])
            entries.append(e[close])
        both = np.unique(np.concatenate(at).astype(np.int64) << 32 | np.concatenate(entries))
        return both >> 32, both & 0xFFFFFFFF

    def search(self, part: Slice, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
        """Text number in the slice, item id, similarity, first word and number of words."""
        found = words(part, plain=True)
        n_words = len(found.hash)
        if n_words < 2:
            return
        sums = _pair_bits(found.hash, self.counter)
        shingles = windows_all(found.hash, SHINGLE_WORDS)
        begin = np.searchsorted(found.text, np.arange(len(part.bounds)))
        at, slot = self._known(shingles)
        inside = found.text[at] == found.text[at + SHINGLE_WORDS - 1]
        at, slot = at[inside], slot[inside]
        texts = found.text[at]
        n = self.bounds[slot + 1] - self.bounds[slot]
        anchor = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.bounds[slot], n)
        pairs = [np.repeat(texts, n).astype(np.int64) << 32 | self.anchors[anchor]]
        for base, known, places, tables in self.classes:
            if n_words <= base:
                break
            first = np.flatnonzero(found.text[: n_words - base] == found.text[base:])
            if not len(first):
                continue
            window, entry = self.near(_prints(sums, first, base), known, tables)
            pairs.append(found.text[first[window]].astype(np.int64) << 32 | np.array([i for i, _ in places])[entry])
        for pair in np.unique(np.concatenate(pairs)).tolist():
            text, i = pair >> 32, pair & 0xFFFFFFFF
            item_id, length, own, weights = self.items[i]
            low, high = np.searchsorted(texts, [text, text + 1])
            total = int(begin[text + 1] - begin[text])
            best = _best_window(at[low:high] - begin[text], shingles[at[low:high]], total, length, own, weights)
            if best and best[0] >= threshold:
                yield part.first + text, item_id, *best


def _best_window(at: np.ndarray, hashes: np.ndarray, n_words: int, length: int, own: np.ndarray, weights: np.ndarray) -> tuple[float, int, int] | None:
    """Weighted Jaccard similarity, first word and number of words of the most similar (then first) window of a text.

    ``at`` and ``hashes`` are shingles of the text, among them all of the item's (``own``, with
    their ``weights``). Windows have the item's length and are cut at the text's ends.
    """
    slot = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
    shared = own[slot] == hashes
    at, slot = at[shared], slot[shared]
    if not len(at):
        return None
    in_item, in_text = length - SHINGLE_WORDS + 1, n_words - SHINGLE_WORDS + 1
    order = np.argsort(slot, kind="stable")
    by_slot, place = slot[order], at[order]
    # An occurrence counts in windows that hold it, but not as many earlier ones as the item has.
    earlier = np.arange(len(place)) - weights[by_slot]
    full = (earlier >= 0) & (by_slot[earlier] == by_slot)
    last = np.sort(place)
    first = np.sort(np.where(full, np.maximum(place[earlier] + 1, place - in_item + 1), place - in_item + 1))
    # The count is constant between these starts, and the window's size monotonous between the others.
    starts = np.concatenate([first - 1, first, last, last + 1, [0, in_text - in_item]])
    starts = np.unique(np.clip(starts, 1 - in_item, in_text - 1))
    both = np.searchsorted(first, starts, "right") - np.searchsorted(last, starts, "left")
    begin, end = np.maximum(starts, 0), np.minimum(starts + in_item, in_text)
    similarity = both / (end - begin + in_item - both)
    k = int(similarity.argmax())
    return float(similarity[k]), int(begin[k]), int(end[k] - begin[k] + SHINGLE_WORDS - 1)


#: The index that a Python worker built last, kept for its next tasks.
_indexes: dict[str, Index] = {}

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, similarity, first_word, n_words.

    One row for each document row and item with a window of similarity ``threshold`` or more;
    the most similar (then the first) window is given. A window that would reach over the text's ends is cut there; words are lower-cased (ASCII) runs of
    letters and digits. Items of fewer than five words are not looked for; null texts hold
    nothing. The benchmark is a query set: it goes to the tasks in blocks of bounded size, and
    each block is held against all documents.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    places = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    n, total = places.agg(F.count("*"), size).collect()[0]
    blocks = max(1, -(-n // ITEMS_AT_ONCE), -(-2 * total // BYTES_AT_ONCE))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    heaviest = places.groupBy(number.alias("block")).agg(size.alias("bytes"), F.count("*").alias("n")).where(F.col("bytes") > BYTES_AT_ONCE).where("n > 1").count()
    while heaviest:  # uneven items: more blocks until each is within the bound or holds one item
        blocks *= 2
        number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
        heaviest = places.groupBy(number.alias("block")).agg(size.alias("bytes"), F.count_distinct("item_id", "text").alias("n")).where(F.col("bytes") > BYTES_AT_ONCE).where("n > 1").count()
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result = None
    for block in range(blocks):
        rows = places.where(number == block).toArrow().to_pydict()
        index = spark.sparkContext.broadcast((rows["item_id"], rows["text"]))

        def run(batches: Iterator[pa.RecordBatch], index=index, token=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            if token not in _indexes:
                _indexes.clear()
                _indexes[token] = Index(*index.value, threshold)
            searcher = _indexes[token]
            for batch in batches:
                ids = batch["doc_id"]
                hits = [h for p in slices(batch["text"], SLICE) for h in searcher.search(p, threshold)]
                columns = list(zip(*hits, strict=True)) if hits else [[]] * 5
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *[pa.array(c, f.type) for c, f in zip(columns[1:], list(_SCHEMA)[1:], strict=True)]], schema=_SCHEMA)

        found = thin.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        result = found if result is None else result.unionAll(found)
    return result


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns.

    A document that is found goes with all rows of its doc_id; a null doc_id never goes.
    """
    return docs.join(contaminated(docs, benchmark, threshold).select("doc_id").distinct(), "doc_id", "left_anti")
