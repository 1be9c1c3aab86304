"""WARC archives with a Zstandard dictionary, written and read by Spark tasks.

Each task writes one archive. The file begins with a skippable frame that holds a dictionary
built from records of that archive; each record follows as a Zstandard frame of its own that
is compressed with the dictionary, so any record can be read by itself.

Files go through pyarrow's file systems, so the folder can be a shared disk or an object store.
Tasks that run again write a file of another name; only files in the manifest, which Spark
commits, count.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_batches, new_path

#: Fixed values of the formats: magic number of the skippable frame for a dictionary, and of WARC.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
#: The dictionary's size, and how many bytes of an archive's first records it is built from.
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LEVEL = 3
MIN_REVISIT_BYTES = 100
#: The copies of a payload are dealt to so many tasks.
SALTS = 16
_DATE = "1970-01-01T00:00:00Z"


def marked(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add payload_digest, payload_bytes, refers_to and refers_uri to pages (page_id, url, html).

    Of pages with equal payloads of ``min_bytes`` or more, that with the smallest page_id has a
    null refers_to, the others have its page_id. Rows that repeat the smallest page_id have
    null too. A null page_id is larger than all others.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    known = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    firsts = known.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_page"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    # short payloads match nothing, and are dealt by page; the copies of one payload by a salt
    dealt = F.when(F.col("payload_bytes") >= min_bytes, F.col("payload_digest")).otherwise(F.concat(F.lit("short "), F.xxhash64("page_id", "url").cast("string")))
    salted = known.withColumn("digest_key", dealt).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    copies = firsts.withColumnRenamed("payload_digest", "digest_key").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = salted.join(copies, ["digest_key", "salt"], "left")
    other = F.col("first_page").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_page")))
    return joined.select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(other, F.col("first_page")).alias("refers_to"), F.when(other, F.col("first_url")).alias("refers_uri"))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def _line(value: str | None) -> str:
    """A header's value has no line breaks."""
    return " ".join((value or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_uri: str | None) -> bytes:
    """A response or revisit record; a revisit has no payload, but its digest and length.

    Pages come without the server's header lines, so a response holds the bare payload and says
    so by its content type (other readers would call that a resource record); the length of
    the payload, which a revisit lacks, is in a header of our own.
    """
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(body))),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Target-URI", _line(refers_uri))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("no WARC record")
    fields = {k.decode().lower(): v.decode().strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:length]


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; where these are too few for training, their bytes are the dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or VERSION * 2, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


_MANIFEST = "path string, n_records long, n_bytes long, dictionary_bytes long"


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Archive pages (page_id, url, html) under ``folder``; returns the manifest of the archives written.

    A null html is an empty payload. Tasks without pages write no archive.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to", "refers_uri")), strict=True))
        head: list[bytes] = []
        held = 0
        for row in rows:
            head.append(record(*row))
            held += len(head[-1])
            if held >= SAMPLE_BYTES:
                break
        if not head:
            return
        trained = _dictionary(head)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.zst"
        raw = trained.as_bytes()
        n = size = 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            size += out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
            for data in head:
                size += out.write(compressor.compress(data))
                n += 1
            head = []
            for row in rows:
                size += out.write(compressor.compress(record(*row)))
                n += 1
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [size], "dictionary_bytes": [len(raw)]})

    manifest = f"{folder}/manifest"
    marked(pages, min_bytes).mapInArrow(run, _MANIFEST).write.parquet(manifest)
    return pages.sparkSession.read.schema(_MANIFEST).parquet(manifest)


def frames(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an open archive, one after the other."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary")
    raw = source.read(size)
    dictionary = zstandard.ZstdCompressionDict(raw)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    left = b""
    engine, parts = decompressor.decompressobj(), []
    while data := left or source.read(chunk):
        left = b""
        parts.append(engine.decompress(data))
        if engine.eof:
            yield b"".join(parts)
            left = engine.unused_data
            engine, parts = decompressor.decompressobj(), []
    if parts:
        raise ValueError("the archive is cut off")


_RECORDS = "page_id long, url string, record_type string, payload binary, payload_digest string, payload_bytes long, refers_to long"


def read(manifest: DataFrame) -> DataFrame:
    """The records of the archives in a manifest: page_id, url, record_type, payload, payload_digest, payload_bytes, refers_to.

    A response's digest and length come from its payload, and must agree with its header. A
    revisit has a null payload; its digest and length are those of its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for path in (p for batch in batches for p in batch["path"].to_pylist()):
            fs, at = _open(path)
            rows, held = [], 0
            with fs.open_input_stream(at, compression=None) as source:
                for data in frames(source):
                    fields, body = parse(data)
                    told = fields["warc-payload-digest"].removeprefix("sha256:")
                    kind = fields["warc-type"]
                    if kind == "response":
                        digest, length = hashlib.sha256(body).hexdigest(), len(body)
                        if digest != told:
                            raise ValueError(f"{path}: a payload doesn't have its digest")
                        rows.append((_page_id(fields["warc-record-id"]), fields["warc-target-uri"], kind, body, digest, length, None))
                    else:
                        rows.append((_page_id(fields["warc-record-id"]), fields["warc-target-uri"], kind, None, told, int(fields["warc-payload-length"]), _page_id(fields["warc-refers-to"])))
                    held += len(body)
                    if held > 4 << 20 or len(rows) >= 1000:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)

    files = max(1, manifest.count())
    return manifest.select("path").repartitionByRange(files, "path").mapInArrow(run, _RECORDS)  # an archive to a task


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Archive pages in a new folder of the shared one and read them back."""
    return read(write(pages, new_path(pages.sparkSession, "warc"), min_bytes))
