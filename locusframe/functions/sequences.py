"""Column expressions over DNA strings and CIGAR strings.

Everything here is built of Spark's own functions, so it stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CIGAR operations, and those that consume the reference.
CIGAR_OP = r"(\d+)([MIDNSHP=X])"
# possessive, so that CIGARs of a hundred thousand operations (long reads) don't exhaust the stack
WHOLE_CIGAR = r"^(?:\d++[MIDNSHP=X])++$"
REFERENCE_OPS = ("M", "D", "N", "=", "X")


def reverse_complement(seq: Column, others_to_n: bool = True) -> Column:
    """The other strand; letters besides A, C, G and T become N, or stay as they are."""
    flipped = F.translate(F.reverse(seq), "ACGT", "TGCA")
    return F.regexp_replace(flipped, "[^ACGT]", "N") if others_to_n else flipped


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length k in order; an empty array for shorter strings (and nulls).

    Give a column of a written table: an expression would be worked out again for each substring.
    """
    n = F.length(seq) - (k - 1)
    taken = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k)))
    return F.when(n >= 1, taken).otherwise(F.array().cast("array<string>"))


def _is_informative(kmer: Column, k: int) -> Column:
    """Only A, C, G and T, none of which makes up four fifths of it."""
    mixed = kmer.rlike(f"^[ACGT]{{{k}}}$")
    for base in "ACGT":
        mixed = mixed & (5 * (k - F.length(F.replace(kmer, F.lit(base), F.lit("")))) < 4 * k)
    return mixed


def informative_kmers(seq: Column, k: int = 11) -> Column:
    """Array of (kmer, position from 0) of the k-mers that can seed an alignment."""
    placed = F.transform(kmers(seq, k), lambda x, i: F.struct(x.alias("kmer"), i.alias("position")))
    return F.filter(placed, lambda x: _is_informative(x["kmer"], k))


def canonical_kmers(seq: Column, k: int = 20) -> Column:
    """Of each k-mer and its reverse complement the lesser; k-mers with other letters are left out."""
    plain = F.filter(kmers(seq, k), lambda x: x.rlike(f"^[ACGT]{{{k}}}$"))
    return F.transform(plain, lambda x: F.least(x, reverse_complement(x)))


def without_runs(seq: Column, least: int = 10) -> Column:
    """The sequence without its runs of A or of T of at least this length."""
    return F.regexp_replace(seq, f"A{{{least},}}|T{{{least},}}", "")


def longest_run(seq: Column) -> Column:
    """Length of the longest run of A or of T."""
    runs = F.transform(F.regexp_extract_all(seq, F.lit("(A+|T+)"), F.lit(1)), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def pure_run(seq: Column, base: str, at_end: bool) -> Column:
    """Length of the run of one base at the start, or at the end."""
    return F.length(F.regexp_extract(seq, f"({base}*)$" if at_end else f"^({base}*)", 1))


def without_tail(clip: Column, base: Column, at_end: Column) -> Column:
    """A clip without the pure run of its tail's base at the junction end; as it is where base is null."""
    end = F.when(base == "A", F.regexp_replace(clip, "A+$", "")).when(base == "T", F.regexp_replace(clip, "T+$", ""))
    start = F.when(base == "A", F.regexp_replace(clip, "^A+", "")).when(base == "T", F.regexp_replace(clip, "^T+", ""))
    return F.coalesce(F.when(at_end, end).otherwise(start), clip)


def masked_bases(seq: Column, qualities: Column, least: int = 10) -> Column:
    """The sequence in upper case with N for bases of a quality (Phred+33) below ``least``.

    Only where there are as many qualities as bases; else the bases stay.
    """
    letters = F.filter(F.split(F.upper(seq), ""), lambda x: x != "")
    marks = F.filter(F.split(qualities, ""), lambda x: x != "")
    hidden = F.array_join(F.zip_with(letters, marks, lambda x, q: F.when(F.ascii(q) - 33 < least, F.lit("N")).otherwise(x)), "")
    return F.when(F.length(seq) == F.length(qualities), hidden).otherwise(F.upper(seq))


def poly_tail(clip: Column, at_end: bool, least: int = 10, share: float = 0.8) -> Column:
    """The A or T tail that begins at the junction end of a clip: struct of base and length, or null.

    For either base, the longest stretch from that end that ends on the base and of which the
    base makes up at least ``share``. T wins only if its stretch is longer.
    """
    letters = F.split(F.upper(F.reverse(clip) if at_end else clip), "")
    letters = F.filter(letters, lambda x: x != "")

    def stretch(base: str) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("hits"), F.lit(0).alias("best"))

        def step(acc: Column, x: Column) -> Column:
            i, hits = acc["i"] + 1, acc["hits"] + F.when(x == base, 1).otherwise(0)
            good = (x == base) & (hits.cast("double") >= share * i)
            return F.struct(i.alias("i"), hits.alias("hits"), F.when(good, i).otherwise(acc["best"]).alias("best"))

        return F.aggregate(letters, start, step, lambda acc: acc["best"])

    a, t = stretch("A"), stretch("T")
    tail = F.when(t > a, F.struct(F.lit("T").alias("base"), t.alias("length"))).otherwise(F.struct(F.lit("A").alias("base"), a.alias("length")))
    return F.when(F.greatest(a, t) >= least, tail)


def _operations(cigar: Column) -> tuple[Column, Column]:
    lengths = F.regexp_extract_all(cigar, F.lit(CIGAR_OP), F.lit(1)).cast("array<long>")
    return lengths, F.regexp_extract_all(cigar, F.lit(CIGAR_OP), F.lit(2))


def soft_clips(cigar: Column) -> Column:
    """Struct (left, right) of the soft-clipped bases at both ends, inside of hard clips.

    A read whose only operation is a clip has none.
    """
    lengths, names = _operations(cigar)
    ops = F.filter(F.arrays_zip(lengths.alias("n"), names.alias("op")), lambda x: x["op"] != "H")

    def end(op: Column) -> Column:
        return F.when((F.size(ops) > 1) & (op["op"] == "S"), op["n"]).otherwise(F.lit(0)).cast("int")

    return F.struct(end(F.get(ops, F.lit(0))).alias("left"), end(F.try_element_at(ops, F.lit(-1))).alias("right"))


def reference_span(cigar: Column) -> Column:
    """Reference bases a CIGAR covers; null if it is none, covers none, or more than 32 bits hold."""
    lengths, names = _operations(cigar)
    used = F.filter(F.arrays_zip(lengths.alias("n"), names.alias("op")), lambda x: x["op"].isin(*REFERENCE_OPS))
    total = F.aggregate(used, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    return F.when(cigar.rlike(WHOLE_CIGAR) & (total > 0) & (total < 1 << 32), total)
