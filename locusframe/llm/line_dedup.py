"""Removal of lines that recur across documents.

Line keys are hashed to 128 bits and range-partitioned with document and position as secondary
sort; one streaming pass over each sorted partition finds first occurrences and counts
documents. The result is a compressed bitmap of kept lines for each document, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_batches, skewed_join, written

STRIP = b" \t\n\x0b\x0c\r"
_LINES = "h1 long, h2 long, doc_id long, text_key long, at binary"


def line_key(line: bytes) -> bytes:
    """What two lines must share to count as the same: stripped, ASCII letters lower-cased."""
    return line.strip(STRIP).lower()


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and distinct key, with the key's positions."""
    for batch in batches:
        h, ids, keys, at = [], [], [], []
        for doc, text_key, text in zip(batch["doc_id"].to_pylist(), batch["text_key"].to_pylist(), batch["text"].to_pylist(), strict=True):
            found: dict[bytes, list[int]] = {}
            for i, line in enumerate(_split(text)):
                if key := line_key(line):
                    found.setdefault(key, []).append(i)
            for key, positions in found.items():
                h.append(xxhash.xxh3_128_digest(key))
                ids.append(doc)
                keys.append(text_key)
                at.append(np.array(positions, "<u4").tobytes())
        pair = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(at, pa.binary())], ["h1", "h2", "doc_id", "text_key", "at"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each key in a sorted partition: its documents there, and where it occurs first.

    Only the key under way is carried from batch to batch.
    """
    names = ["h1", "h2", "n_docs", "first_doc", "first_text", "first_at"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)], names)

    open_run, last_doc = None, object()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2 = (batch[c].to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        docs = batch["doc_id"]
        filled = docs.fill_null(0).to_numpy(zero_copy_only=False)
        null = docs.is_null().to_numpy(zero_copy_only=False)
        other = np.ones(n, bool)
        other[1:] = (filled[1:] != filled[:-1]) | (null[1:] != null[:-1])
        starts = np.flatnonzero(new)
        per_run = np.add.reduceat((new | other).astype(np.int64), starts)
        firsts = batch.take(pa.array(starts))
        at = [int.from_bytes(x[:4], "little") for x in firsts["at"].to_pylist()]
        rows = list(zip(firsts["h1"].to_pylist(), firsts["h2"].to_pylist(), per_run.tolist(), firsts["doc_id"].to_pylist(), firsts["text_key"].to_pylist(), at, strict=True))
        if open_run is not None:
            if open_run[:2] == rows[0][:2]:
                same_doc = docs[0].as_py() == last_doc
                rows[0] = (*open_run[:2], open_run[2] + rows[0][2] - same_doc, *open_run[3:])
            else:
                yield out([open_run])
        last_doc = docs[n - 1].as_py()
        open_run = rows.pop()
        yield out(rows)
    if open_run is not None:
        yield out([open_run])


def line_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct lines of each document, and for each line key its document count and first place."""
    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    lines = written(keyed.mapInArrow(_lines, _LINES), "lines")
    # sorted by key, document and position; a frequent key is cut into several partitions, but only between documents
    dealt = lines.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "text_key")
    runs = dealt.mapInArrow(_runs, "h1 long, h2 long, n_docs long, first_doc long, first_text long, first_at long")
    first = F.min(F.struct(F.col("first_doc").isNull(), "first_doc", "first_text", "first_at"))
    return lines, runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), first.alias("first"))


def _bitmap(n_positions: np.ndarray) -> bytes:
    """Compressed bits; bit i is set if line i goes. Lines after the last bit stay."""
    bits = np.zeros(int(n_positions.max()) + 1, bool)
    bits[n_positions] = True
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)


def _bitmaps(at: pa.Array) -> pa.Array:
    return pa.array([_bitmap(np.frombuffer(b"".join(x), "<u4")) for x in at.to_pylist()], pa.binary())


def line_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """Which lines each document loses: doc_id, text_key (xxhash64 of the text), dropped (bitmap).

    A key found in ``min_docs`` documents or more loses its lines in all of them; with
    ``keep_first`` its first line (by document, then position) stays. Keys without a character
    count nowhere. Documents that lose nothing have no row. A null text has one empty line;
    rows of one doc_id count as one document, also where their texts differ; all rows without
    a doc_id count as one more.
    """
    lines, counts = line_counts(docs)
    frequent = written(counts.where(F.col("n_docs") >= min_docs), "frequent-lines")
    # a line that a third of all documents share is no key of a shuffle
    hit = skewed_join(lines, frequent.select("h1", "h2", "first", "n_docs"), ["h1", "h2"], "n_docs")
    if keep_first:
        mine = F.col("doc_id").eqNullSafe(F.col("first.first_doc")) & (F.col("text_key") == F.col("first.first_text"))
        hit = hit.withColumn("at", F.when(mine, F.expr("substring(at, 5)")).otherwise(F.col("at"))).where(F.length("at") > 0)
    # a text's keys have different positions, so the set has one entry for each key, also where rows are repeated
    grouped = hit.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("at"))
    return grouped.select("doc_id", "text_key", F.arrow_udf(_bitmaps, "binary")("at").alias("dropped"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, before, gone = [], [], []
        for text, dropped in zip(batch["body"].to_pylist(), batch["dropped"].to_pylist(), strict=True):
            lines = _split(text)
            before.append(len(lines))
            if dropped is None:
                gone.append(0)
                kept.append(text)
                continue
            bits = np.unpackbits(np.frombuffer(zlib.decompress(dropped), np.uint8), bitorder="little")
            stay = [line for i, line in enumerate(lines) if i >= len(bits) or not bits[i]]
            gone.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay).decode())
        names = [c for c in batch.schema.names if c not in ("body", "dropped")]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(kept, pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64())], [*names, "body", "n_lines", "n_dropped"])


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Apply the bitmaps: the columns of docs with the text left over, n_lines (before) and n_dropped.

    The lines that stay keep their order and are joined by a newline; a null text stays null.
    Columns of docs named n_lines or n_dropped are replaced, all others stay.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    inner = [F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]
    left = docs.select(*inner, F.col("text").alias("body"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("key"))
    marks = bitmaps.select(F.col("doc_id").alias("doc_marked"), "text_key", "dropped")
    joined = left.join(marks, F.col("doc").eqNullSafe(F.col("doc_marked")) & (F.col("key") == F.col("text_key")), "left")
    ready = joined.select(*[f"c{i}" for i in range(len(rest))], "body", "dropped")
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"c{i} {types[c]}" for i, c in enumerate(rest)), "body string, n_lines long, n_dropped long"])
    return ready.mapInArrow(_apply, schema).toDF(*rest, "text", "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """Both steps: the documents without the lines that recur (see line_bitmaps and drop_lines)."""
    return drop_lines(docs, line_bitmaps(docs, min_docs, keep_first))
