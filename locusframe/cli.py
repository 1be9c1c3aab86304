"""Command line: ``python -m locusframe.cli scan --bam reads.sam --bed targets.bed ...``.

Options of a scan are those of locusframe.options, with hyphens.
"""

from __future__ import annotations

import argparse
import dataclasses
import logging
import os
import sys

from pyspark.sql import SparkSession

from .options import Calling, Options, Reading
from .plans import scan
from .sinks import report
from .sources import bam, text
from .storage import staged

_log = logging.getLogger("locusframe")
_TYPES = {"int": int, "float": float, "str": str, "str | None": str, "int | None": int}


def _add(parser: argparse.ArgumentParser, kind: type, leave: tuple[str, ...] = ()) -> None:
    """An option for each field of a dataclass, with its default."""
    for f in dataclasses.fields(kind):
        if f.name in leave:
            continue
        name = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            parser.add_argument(name, action="store_true")
        else:
            parser.add_argument(name, type=_TYPES[f.type], default=f.default)


def parser() -> argparse.ArgumentParser:
    """The parser of the command line."""
    whole = argparse.ArgumentParser(prog="locusframe", description="Find mobile element insertions in targeted sequencing data.")
    whole.add_argument("--threads", type=int, help="cores of a local session; a submitted one has its own")
    whole.add_argument("--verbose", action="store_true")
    whole.add_argument("--quiet", action="store_true")
    one = whole.add_subparsers(dest="command", required=True).add_parser("scan", help="find insertions")
    one.add_argument("--bam", required=True, help="reads as BAM or SAM text")
    one.add_argument("--bed", required=True, help="targets")
    one.add_argument("--reference", help="FASTA")
    one.add_argument("--consensus", help="FASTA of element consensus sequences; without it nothing is typed")
    one.add_argument("--output", required=True, help="one local file; .gz packs it")
    one.add_argument("--format", choices=("tsv", "bed", "json", "vcf"), default="tsv")
    one.add_argument("--anonymize", action="store_true", help="read names in JSON as read_1, read_2, ...")
    _add(one, Options, ("reading", "calling"))
    _add(one, Reading)
    _add(one, Calling)
    return whole


def options(arguments: argparse.Namespace) -> Options:
    """The options of a scan; an error if some value is out of its range."""
    take = lambda kind, leave=(): {f.name: getattr(arguments, f.name) for f in dataclasses.fields(kind) if f.name not in leave}
    return Options(**take(Options, ("reading", "calling")), reading=Reading(**take(Reading)), calling=Calling(**take(Calling)))


def run(spark: SparkSession, arguments: argparse.Namespace, line: list[str]) -> int:
    """Scan and write the report; returns how many candidates it has."""
    chosen = options(arguments)
    packed = bam.is_bam(arguments.bam) if os.path.exists(arguments.bam) else arguments.bam.endswith(".bam")
    contigs, samples = (bam.header if packed else text.sam_header)(spark, arguments.bam)
    name, warning = text.sample_name(samples, os.path.basename(arguments.bam).split(".")[0])
    if warning:
        _log.warning("%s: %s", arguments.bam, warning)
    # a scan looks at the reads several times; blocks are unpacked once
    reads = staged(bam.reads(spark, arguments.bam), "reads") if packed else text.sam_reads(spark, arguments.bam, contigs)
    reference = text.fasta(spark, arguments.reference) if arguments.reference else None
    consensus = text.consensus(spark, arguments.consensus) if arguments.consensus else None
    found = scan.run(reads, contigs, text.checked_bed(spark, arguments.bed), chosen, consensus, reference)
    for counts, what in ((found.outcomes, "outcome"), (found.stages, "stage")):
        for r in counts.orderBy(what).collect():
            _log.info("%s %s: %d", what, r[what], r["n"])
    lengths = tuple((r["name"], r["length"]) for r in contigs.orderBy("rank").collect())
    heading = report.Heading(name, report.command_line(line), lengths, os.path.basename(arguments.reference) if arguments.reference else None)
    nested = report.nested_signals(found.signals, contigs, arguments.anonymize) if arguments.format == "json" else None
    return report.write(found.candidates, arguments.output, arguments.format, heading, nested)


def main(line: list[str] | None = None) -> int:
    line = sys.argv[1:] if line is None else line
    arguments = parser().parse_args(line)
    logging.basicConfig(level=logging.ERROR if arguments.quiet else logging.INFO if arguments.verbose else logging.WARNING)
    builder = SparkSession.builder.appName("locusframe").config("spark.sql.session.timeZone", "UTC")
    if arguments.threads:
        builder = builder.master(f"local[{arguments.threads}]")
    try:
        _log.info("%d candidates", run(builder.getOrCreate(), arguments, line))
    except ValueError as error:
        _log.error("%s", error)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
