"""Reads of a BAM file as a Spark data source, cut by bytes, without an index.

A task takes the records that begin in its range of the compressed file. Where the first of them
begins it finds by looking for a chain of plausible records; it finds the first record of the next
range alike, and must arrive exactly there. The first range begins after the header, so a place
found wrongly is never passed over in silence: the task before it fails. (Ranges that are left out because a file is
sorted and only other contigs are asked for aren't read to their ends.)

Sequences, qualities and tags are decoded only for records that the pushed filters leave, and only
where the schema names their columns.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .text import header_tables

_KINDS = {"string": StringType(), "int": IntegerType(), "long": LongType(), "boolean": BooleanType()}
_KINDS["place"] = StructType([StructField("file", StringType()), StructField("block", LongType()), StructField("line", LongType())])
_COLUMNS = (
    "name string, flag int, start long, mapq int, cigar string, mate_start long, tlen long, seq string, qual string, mq int, mc string, "
    "has_sa boolean, at place, contig int, contig_name string, mate_contig int, end long"
)
#: Built without DDL, which workers can't parse.
SCHEMA = StructType([StructField(c.split()[0], _KINDS[c.split()[1]]) for c in _COLUMNS.split(", ")])
PARTITION_BYTES = 64 << 20
#: Unpacked bytes that become one Arrow batch, and those first and at most looked at for the beginning of a record. A record
#: that is longer than that, and the first of a range, is an error; partitionbytes moves the ranges.
BATCH_BYTES, LOOK_BYTES, MOST_LOOK_BYTES = 4 << 20, 256 << 10, 64 << 20
#: So many plausible records must follow one another where a range begins.
CHAIN = 4

# Fixed values of the formats: letters of bases and CIGAR operations by code, operations that cover reference bases and
# those that cover bases of the read, sizes of tags' values, and the part of a record that has the same length in all.
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
ON_REFERENCE, ON_READ = (0, 2, 3, 7, 8), (0, 1, 4, 7, 8)
VALUE_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
INTEGERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
FIXED = np.dtype([("contig", "<i4"), ("start", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("operations", "<u2"), ("flag", "<u2"), ("bases", "<i4"), ("mate_contig", "<i4"), ("mate_start", "<i4"), ("tlen", "<i4")])

_PAIRS = np.array([[ord(BASES[i >> 4]), ord(BASES[i & 15])] for i in range(256)], np.uint8)
_PRINTED = bytes(min(i + 33, 126) for i in range(256))


class Place(NamedTuple):
    """Where a record begins: its block in the file, and the byte inside the unpacked block."""

    block: int
    within: int


class Header(NamedTuple):
    lines: list[str]
    names: list[str]
    lengths: list[int]
    first: Place


def _open(path: str) -> pa.NativeFile:
    """A file in any store that Arrow knows, or on a local disk."""
    if "://" in path or path.startswith("file:"):
        store, inner = pafs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return pafs.LocalFileSystem().open_input_file(os.path.abspath(path))


def _block_size(head: bytes) -> int | None:
    """Packed size of the block that begins with these bytes; null if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def _unpacked(block: bytes) -> bytes:
    """The content of one whole block, held against its checksum and length."""
    try:
        data = zlib.decompress(block[12 + int.from_bytes(block[10:12], "little") : -8], -15)
    except zlib.error as error:
        raise ValueError(f"a block doesn't unpack: {error}") from error
    if struct.unpack("<II", block[-8:]) != (zlib.crc32(data), len(data)):
        raise ValueError("a block differs from its checksum")
    return data


def _blocks(file: pa.NativeFile, at: int) -> Iterator[tuple[int, int, bytes]]:
    """(place, place of the next, content) of the blocks from ``at`` to the file's end."""
    held, base, size = b"", at, file.size()
    while at < size:
        if len(held) < 1 << 16 and base + len(held) < size:
            file.seek(base + len(held))
            held += file.read(1 << 20)
        length = _block_size(held[:1024])
        if length is None or length > len(held):
            raise ValueError(f"byte {at} doesn't begin a whole block: the file is cut off or no BAM")
        yield at, at + length, _unpacked(held[:length])
        held, at = held[length:], at + length
        base = at


def _next_block(file: pa.NativeFile, at: int) -> int:
    """The first block that begins at byte ``at`` or later; the file's size if there is none."""
    size = file.size()
    file.seek(at)
    held, base = file.read(4 << 16), at
    found = held.find(b"\x1f\x8b\x08\x04")
    while found >= 0:
        length = _block_size(held[found : found + 1024])
        if length and found + length <= len(held):
            try:
                _unpacked(held[found : found + length])
                return base + found
            except ValueError:
                pass
        found = held.find(b"\x1f\x8b\x08\x04", found + 1)
    if base + len(held) < size:  # a block has 64 KB at most, so a whole one lies in what was read
        raise ValueError(f"no block begins within {len(held)} bytes after byte {at}")
    return size


def read_header(path: str) -> Header:
    """Header lines, contigs, and where the first record begins."""
    with _open(path) as file:
        if _block_size(file.read(1024)) is None:
            raise ValueError(f"{path} is no BAM file")
        data, ends, held = bytearray(), [], _blocks(file, 0)

        def have(n: int) -> None:
            while len(data) < n:
                step = next(held, None)
                if step is None:
                    raise ValueError(f"{path} ends inside its header")
                at, after, content = step
                ends.append((len(data), at, after))
                data.extend(content)

        have(8)
        if data[:4] != b"BAM\x01":
            raise ValueError(f"{path} is no BAM file")
        at = 8 + int.from_bytes(data[4:8], "little")
        have(at + 4)
        lines = data[8:at].split(b"\0")[0].decode("utf-8", "replace").splitlines()
        n, at, names, lengths = int.from_bytes(data[at : at + 4], "little"), at + 4, [], []
        for _ in range(n):
            have(at + 4)
            size = int.from_bytes(data[at : at + 4], "little")
            have(at + 8 + size)
            names.append(data[at + 4 : at + 3 + size].decode("utf-8", "replace"))
            lengths.append(int.from_bytes(data[at + 4 + size : at + 8 + size], "little"))
            at += 8 + size
        begin, block, after = next(e for e in reversed(ends) if e[0] <= at)
        return Header(lines, names, lengths, Place(after, 0) if at == len(data) else Place(block, at - begin))


def _plausible(data: bytes, at: int, lengths: list[int]) -> int | None:
    """Where the next record begins if a plausible one begins here, -1 if too few bytes are there to tell; null if none does."""
    if at + 36 > len(data):
        return -1
    size = int.from_bytes(data[at : at + 4], "little", signed=True)
    f = np.frombuffer(data, FIXED, 1, at + 4)[0]
    contig, mate, bases, name, operations = (int(f[c]) for c in ("contig", "mate_contig", "bases", "name", "operations"))
    if not (-1 <= contig < len(lengths) and -1 <= mate < len(lengths) and name >= 1 and bases >= 0):
        return None
    if not (-1 <= f["start"] <= (lengths[contig] if contig >= 0 else f["start"]) and -1 <= f["mate_start"] <= (lengths[mate] if mate >= 0 else f["mate_start"])):
        return None
    tags = 32 + name + 4 * operations + (bases + 1) // 2 + bases
    if size < tags:
        return None
    known = data[at + 36 : at + 36 + name]
    if any(not 33 <= c <= 126 for c in known[: name - 1]):
        return None
    if len(known) < name:
        return -1
    if known[-1] != 0:
        return None
    cigar = struct.unpack_from(f"<{operations}I", data, at + 36 + name) if at + 36 + name + 4 * operations <= len(data) else ()
    if any(x & 15 > 8 for x in cigar) or (cigar and bases and sum(x >> 4 for x in cigar if x & 15 in ON_READ) != bases):
        return None
    return at + 4 + size


def _begins(data: bytes, at: int, lengths: list[int], whole: bool) -> bool | None:
    """Does a chain of records begin here? Null if too few bytes are there to tell; ``whole`` if the file ends with them."""
    for _ in range(CHAIN):
        after = _plausible(data, at, lengths)
        if after is None:
            return False
        if after == -1 or after > len(data):
            return False if whole else None
        if after == len(data) and whole:
            return True
        at = after
    return True


def first_record(file: pa.NativeFile, at: int, header: Header) -> Place:
    """The first record whose block begins at byte ``at`` or later; the file's end if there is none."""
    size = file.size()
    if at <= header.first.block:
        return header.first
    data, parts, look = b"", [], LOOK_BYTES
    blocks = _blocks(file, _next_block(file, at)) if at < size else iter(())
    whole, tried = False, 0
    while True:
        taken = [data]
        length = len(data)
        while not whole and length < look:
            step = next(blocks, None)
            if step is None:
                whole = True
            elif step[2]:
                parts.append((length, step[0]))
                taken.append(step[2])
                length += len(step[2])
        data = b"".join(taken)
        n = len(data) - 35
        candidates = np.empty(0, np.int64)
        if n > tried:
            # the numbers at every byte; most bytes begin no record by their contigs alone
            whole_numbers = np.ndarray((len(data) - 3,), "<i4", data, strides=(1,))
            contig, mate, start = (whole_numbers[k : k + n] for k in (4, 24, 8))
            most = len(header.lengths)
            candidates = np.flatnonzero((whole_numbers[:n] >= 32) & (contig >= -1) & (contig < most) & (mate >= -1) & (mate < most) & (start >= -1))
        for u in candidates[candidates >= tried].tolist():
            begins = _begins(data, u, header.lengths, whole)
            if begins is None and look < MOST_LOOK_BYTES:
                tried = u
                break
            if begins:
                begin, block = next(p for p in reversed(parts) if p[0] <= u)
                return Place(block, u - begin)
        else:
            tried = max(tried, n)
        if whole:
            return Place(size, 0)
        if look >= MOST_LOOK_BYTES:
            raise ValueError(f"no record begins in the {len(data)} bytes after byte {at}; try another partitionbytes")
        look *= 4


class Wanted:
    """What the pushed filters leave: bounds and sets of the whole-number columns, and flags that no record may have."""

    COLUMNS = ("contig", "flag", "start", "mapq", "end")

    def __init__(self, excluded: int = 0):
        self.excluded = excluded
        self.bounds: dict[str, tuple[int, int]] = {}
        self.sets: dict[str, set[int]] = {}

    def take(self, f: Filter) -> None:
        """Note a filter; Spark applies it again, so one that isn't known does no harm."""
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column not in self.COLUMNS:
            return
        if isinstance(f, In):
            own = {v for v in f.value if v is not None}
            self.sets[column] = self.sets.get(column, own) & own
            return
        low, high = self.bounds.get(column, (-(1 << 62), 1 << 62))
        if isinstance(f, EqualTo):
            low, high = max(low, f.value), min(high, f.value)
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            low = max(low, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, LessThan | LessThanOrEqual):
            high = min(high, f.value - isinstance(f, LessThan))
        else:
            return
        self.bounds[column] = (low, high)

    def holds(self, column: str, values: np.ndarray) -> np.ndarray:
        low, high = self.bounds.get(column, (-(1 << 62), 1 << 62))
        kept = (values >= low) & (values <= high)
        return kept & np.isin(values, list(self.sets[column])) if column in self.sets else kept

    def filtered(self, column: str) -> bool:
        return column in self.bounds or column in self.sets

    def contigs(self) -> tuple[int, int] | None:
        """The least and the greatest contig that is asked for; null if all are."""
        if not self.filtered("contig"):
            return None
        low, high = self.bounds.get("contig", (-(1 << 62), 1 << 62))
        own = self.sets.get("contig")
        return (low, high) if own is None else (max(low, min(own, default=1 << 62)), min(high, max(own, default=-(1 << 62))))


def _tags(data: bytes, at: int, end: int) -> dict[str, tuple[str, object]]:
    """Kind and value of the tags that are looked at."""
    found: dict[str, tuple[str, object]] = {}
    while at + 3 <= end:
        name, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            after = data.index(b"\0", at, end) + 1
            value = data[at : after - 1]
        elif kind == "B":
            n = int.from_bytes(data[at + 1 : at + 5], "little")
            after = at + 5 + n * VALUE_SIZES[chr(data[at])]
            value = data[at + 5 : after]
        elif kind in VALUE_SIZES:
            after = at + VALUE_SIZES[kind]
            value = struct.unpack_from(INTEGERS[kind], data, at)[0] if kind in INTEGERS else None
        else:
            raise ValueError(f"tag {name} has the unknown type {kind}")
        if name in ("MQ", "MC", "SA", "CG"):
            found.setdefault(name, (kind, value))
        at = after
    return found


def _text_cigar(operations: Iterable[int]) -> str | None:
    return "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in operations) or None


def _decoded(data: bytes, starts: np.ndarray, blocks: np.ndarray, within: np.ndarray, path: str, names: list[str], columns: set[str], wanted: Wanted) -> dict[str, list]:
    """Values of the columns for the records at ``starts`` (after their lengths) that are wanted."""
    raw = np.frombuffer(data, np.uint8)
    f = raw[starts[:, None] + np.arange(FIXED.itemsize)].view(FIXED)[:, 0]
    kept = (f["flag"] & wanted.excluded) == 0
    for name, none in (("contig", -1), ("flag", None), ("start", -1), ("mapq", 255)):
        if wanted.filtered(name):
            values = f[name].astype(np.int64)
            kept &= wanted.holds(name, values) & (values != none if none is not None else True)
    by_end = wanted.filtered("end")
    out: dict[str, list] = {c: [] for c in columns}
    need_tags, need_cigar = columns & {"mq", "mc", "has_sa"}, bool(columns & {"cigar", "end"}) or by_end
    for i in np.flatnonzero(kept).tolist():
        at = int(starts[i])
        r = f[i]
        size, n_name, n_ops, bases = int.from_bytes(data[at - 4 : at], "little"), int(r["name"]), int(r["operations"]), int(r["bases"])
        ops_at = at + 32 + n_name
        seq_at = ops_at + 4 * n_ops
        qual_at = seq_at + (bases + 1) // 2
        operations = struct.unpack_from(f"<{n_ops}I", data, ops_at)
        long = need_cigar and n_ops == 2 and operations[0] == bases << 4 | 4 and operations[1] & 15 == 3
        tags = _tags(data, qual_at + bases, at + size) if need_tags or long else {}
        if long and "CG" in tags and tags["CG"][0] == "B":  # more operations than the field for their number can tell
            operations = struct.unpack(f"<{len(tags['CG'][1]) // 4}I", tags["CG"][1])
        start = int(r["start"]) if r["start"] >= 0 else None
        end = start + (sum(x >> 4 for x in operations if x & 15 in ON_REFERENCE) or 1) if start is not None else None
        if by_end and (end is None or not wanted.holds("end", np.array([end]))[0]):
            continue
        row = {
            "flag": int(r["flag"]), "start": start, "end": end, "tlen": int(r["tlen"]),
            "mapq": int(r["mapq"]) if r["mapq"] != 255 else None,
            "contig": int(r["contig"]) if r["contig"] >= 0 else None,
            "mate_contig": int(r["mate_contig"]) if r["mate_contig"] >= 0 else None,
            "mate_start": int(r["mate_start"]) if r["mate_start"] >= 0 else None,
        }
        if "contig_name" in columns:
            row["contig_name"] = names[r["contig"]] if r["contig"] >= 0 else None
        if "name" in columns:
            row["name"] = data[at + 32 : ops_at - 1].decode("utf-8", "replace")
        if "cigar" in columns:
            row["cigar"] = _text_cigar(operations)
        if "seq" in columns:
            row["seq"] = _PAIRS[raw[seq_at:qual_at]].tobytes()[:bases].decode() if bases else None
        if "qual" in columns:
            row["qual"] = data[qual_at : qual_at + bases].translate(_PRINTED).decode() if bases and data[qual_at] != 255 else None
        if need_tags:
            mq, mc = tags.get("MQ"), tags.get("MC")
            row["mq"] = mq[1] if mq and mq[0] in INTEGERS else None
            row["mc"] = mc[1].decode("utf-8", "replace") or None if mc and mc[0] == "Z" else None
            row["has_sa"] = "SA" in tags and tags["SA"][0] == "Z" and len(tags["SA"][1]) > 0
        if "at" in columns:
            row["at"] = {"file": path, "block": int(blocks[i]), "line": int(within[i])}
        for c in columns:
            out[c].append(row[c])
    return out


class Range(InputPartition):
    """A range of the compressed file."""

    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class BamReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int, excluded: int):
        self.path, self.bytes, self.wanted = path, partition_bytes, Wanted(excluded)
        self.arrow = to_arrow_schema(schema)
        unknown = set(schema.names) - set(SCHEMA.names)
        if unknown:
            raise ValueError(f"a BAM file has no columns {', '.join(sorted(unknown))}")

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as file:
            size = file.size()
        return [Range(a, min(size, a + self.bytes)) for a in range(0, size, self.bytes)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Range)
        header = read_header(self.path)
        with _open(self.path) as file:
            size = file.size()
            begin = first_record(file, partition.begin, header)
            end = Place(size, 0) if partition.end >= size else first_record(file, partition.end, header)
            if begin >= end:
                return
            by_position = any(x.startswith("@HD") and "SO:coordinate" in x.split("\t") for x in header.lines)
            asked = self.wanted.contigs() if by_position else None
            if asked and end.block < size:
                if 0 <= _contig_at(file, end, size) < asked[0]:  # all that comes before it is on lower contigs
                    return
            yield from self._batches(file, header, begin, end, asked)

    def _batches(self, file: pa.NativeFile, header: Header, begin: Place, end: Place, asked: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
        columns, held, parts = set(self.arrow.names), b"", []
        for taken, last in _gathered(_blocks_between(file, begin, end)):
            # what the last batch left is the beginning of one record, in the block that parts still names
            length, pieces = len(held), [held]
            for place, content in taken:
                parts.append((length, place))
                pieces.append(content)
                length += len(content)
            data = b"".join(pieces)
            starts, at = [], 0
            while at + 4 <= len(data):
                n = int.from_bytes(data[at : at + 4], "little")
                if n < 32:
                    raise ValueError(f"{self.path}: a record of {n} bytes in the range from byte {begin.block}; try another partitionbytes")
                if at + 4 + n > len(data):
                    break
                starts.append(at + 4)
                at += 4 + n
            if last and at != len(data):
                raise ValueError(f"{self.path}: the records from byte {begin.block} on don't end where those from byte {end.block} on begin; try another partitionbytes")
            if starts:
                own = np.array(starts, np.int64)
                edges, offsets, blocks = (np.array(x, np.int64) for x in ([p[0] for p in parts], [p[1].within for p in parts], [p[1].block for p in parts]))
                k = np.searchsorted(edges, own - 4, "right") - 1
                values = _decoded(data, own, blocks[k], own - 4 - edges[k] + offsets[k], self.path, header.names, columns, self.wanted)
                yield pa.RecordBatch.from_arrays([pa.array(values[c.name], c.type) for c in self.arrow], schema=self.arrow)
                if asked:
                    contig = int.from_bytes(data[starts[-1] : starts[-1] + 4], "little", signed=True)
                    if contig > asked[1] or contig < 0:
                        return
            held = data[at:]
            # blocks of the bytes that stay; the first of them begins before, by as much as was used
            kept = [p for i, p in enumerate(parts) if i + 1 == len(parts) or parts[i + 1][0] > at]
            parts = [(max(0, b - at), Place(p.block, p.within + max(0, at - b))) for b, p in kept] if held else []


def _blocks_between(file: pa.NativeFile, begin: Place, end: Place) -> Iterator[tuple[Place, bytes]]:
    """The unpacked bytes from one place to another, block by block, each with its place."""
    for at, _, content in _blocks(file, begin.block):
        if at > end.block or (at == end.block and not end.within):
            return
        skip = begin.within if at == begin.block else 0
        piece = content[skip : end.within if at == end.block else None]
        if piece:
            yield Place(at, skip), piece


def _contig_at(file: pa.NativeFile, place: Place, size: int) -> int:
    """The contig of the record that begins at a place."""
    data = b""
    for _, piece in _blocks_between(file, place, Place(size, 0)):
        data += piece
        if len(data) >= 8:
            break
    return int.from_bytes(data[4:8], "little", signed=True)


def _gathered(blocks: Iterator[tuple[Place, bytes]]) -> Iterator[tuple[list[tuple[Place, bytes]], bool]]:
    """Blocks by BATCH_BYTES, and whether they are the last."""
    taken, size = [], 0
    for block in blocks:
        if size >= BATCH_BYTES:
            yield taken, False
            taken, size = [], 0
        taken.append(block)
        size += len(block[1])
    yield taken, True


class PushingReader(BamReader):
    """A reader for sessions that push filters to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            self.wanted.take(f)
            yield f


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``: one row for each record, with the columns of text.sam_reads.

    Options: ``partitionbytes`` (compressed, 64 MB), ``excludeflags`` (records with one of these bits go), and ``pushdown``
    (true where spark.sql.python.filterPushdown.enabled is set: comparisons of contig, flag, start, end and mapq then
    leave records out before their sequences are decoded; in a file sorted by position, ranges of other contigs are
    not unpacked at all). A schema with fewer columns decodes no others.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("give the path of a BAM file")
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else BamReader
        return kind(path, schema, max(1, int(self.options.get("partitionbytes", PARTITION_BYTES))), int(self.options.get("excludeflags", 0)))


def is_bam(path: str) -> bool:
    """Does the file begin with a block of the format, whatever its name?"""
    with _open(path) as file:
        return _block_size(file.read(1024)) is not None


def header(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tables of text.sam_header. Names and lengths are those of the file's list of contigs, checksums those of its lines."""
    found = read_header(path)
    digests = {}
    for line in found.lines:
        if line.startswith("@SQ"):
            fields = dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f)
            if "M5" in fields:
                digests[fields.get("SN")] = f"\tM5:{fields['M5']}"
    contigs = [f"@SQ\tSN:{name}\tLN:{length}{digests.get(name, '')}" for name, length in zip(found.names, found.lengths, strict=True)]
    return header_tables(spark, [*contigs, *(x for x in found.lines if not x.startswith("@SQ"))])


def reads(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES, exclude_flags: int = 0, columns: list[str] | None = None) -> DataFrame:
    """The reads of a BAM file, as text.sam_reads gives those of a SAM file; ``at`` grows in the file's order."""
    spark.dataSource.register(BamSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    schema = StructType([SCHEMA[c] for c in columns]) if columns is not None else SCHEMA
    return spark.read.format("bam").schema(schema).option("partitionbytes", partition_bytes).option("excludeflags", exclude_flags).option("pushdown", pushed).load(path)
