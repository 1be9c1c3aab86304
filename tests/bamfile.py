"""A writer of BAM files for the tests: SAM lines, in blocks of few bytes, so that records lie over several."""

import struct
import zlib

_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(content):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = packer.compress(content) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(data) + 25) + data + struct.pack("<II", zlib.crc32(content), len(content))


def _cigar(text):
    ops, n = [], ""
    for c in text if text != "*" else "":
        if c.isdigit():
            n += c
        else:
            ops.append(int(n) << 4 | "MIDNSHP=X".index(c))
            n = ""
    return ops


def _tag(text):
    name, kind, value = text.split(":", 2)
    if kind == "i":
        small = 0 <= int(value) < 256
        return name.encode() + (b"C" + struct.pack("<B", int(value)) if small else b"i" + struct.pack("<i", int(value)))
    if kind == "B":
        numbers = [int(x) for x in value.split(",")[1:]]
        return name.encode() + b"BI" + struct.pack(f"<I{len(numbers)}I", len(numbers), *numbers)
    if kind == "f":
        return name.encode() + b"f" + struct.pack("<f", float(value))
    return name.encode() + (b"A" + value.encode() if kind == "A" else kind.encode() + value.encode() + b"\0")


def record(line, ranks):
    name, flag, contig, start, mapq, cigar, mate, mate_start, tlen, seq, qual, *tags = line.split("\t")
    ops = _cigar(cigar)
    bases = 0 if seq == "*" else len(seq)
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] if bases else []
    codes += [0] * (bases % 2)
    tail = b"".join(_tag(t) for t in tags)
    if len(ops) > 65535:
        tail += b"CGBI" + struct.pack(f"<I{len(ops)}I", len(ops), *ops)
        ops = [bases << 4 | 4, sum(x >> 4 for x in ops if x & 15 in (0, 2, 3, 7, 8)) << 4 | 3]
    own = ranks.get(contig, -1)
    body = struct.pack("<iiBBHHHiiii", own, int(start) - 1, len(name) + 1, int(mapq), 0, len(ops), int(flag), bases, own if mate == "=" else ranks.get(mate, -1), int(mate_start) - 1, int(tlen))
    body += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    body += (b"\xff" * bases if qual == "*" else bytes(ord(c) - 33 for c in qual)) + tail
    return struct.pack("<i", len(body)) + body


def write_bam(path, lines, size=300):
    """Header and records of SAM lines, ``size`` unpacked bytes in a block."""
    head = [x for x in lines if x.startswith("@")]
    contigs = [dict(f.split(":", 1) for f in x.split("\t")[1:]) for x in head if x.startswith("@SQ")]
    ranks = {c["SN"]: i for i, c in enumerate(contigs)}
    text = "".join(x + "\n" for x in head).encode()
    data = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    for c in contigs:
        data += struct.pack("<i", len(c["SN"]) + 1) + c["SN"].encode() + b"\0" + struct.pack("<i", int(c["LN"]))
    data += b"".join(record(x, ranks) for x in lines if not x.startswith("@"))
    with open(path, "wb") as out:
        out.write(b"".join(block(data[i : i + size]) for i in range(0, len(data), size)) + _EOF)
