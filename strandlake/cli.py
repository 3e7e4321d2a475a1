"""Command line: ``python -m strandlake.cli COMMAND``."""

from __future__ import annotations

import argparse
import sys

from strandlake import api
from strandlake.functions.modtags import Descriptor, parse_rename
from strandlake.sources import files, readers, writers


def _lines(path: str) -> list[str]:
    with open(path) as f:
        return f.read().splitlines()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake")
    sub = p.add_subparsers(dest="command", required=True)
    mp = sub.add_parser("methylation-pattern").add_subparsers(dest="kind", required=True)
    c = mp.add_parser("contig")
    c.add_argument("-p", "--pileup", required=True)
    c.add_argument("-a", "--assembly", required=True)
    c.add_argument("-m", "--motifs", nargs="+", required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--output-type", default="median", choices=["raw", "median", "weighted-mean"])
    c.add_argument("--contigs", nargs="+")
    c.add_argument("-t", "--threads", type=int, default=1)
    c.add_argument("--min-valid-read-coverage", type=int, default=3)
    c.add_argument("--batch-size", type=int, default=1000)
    c.add_argument("--min-valid-cov-to-diff-fraction", type=float, default=0.8)
    c.add_argument("--allow-mismatch", action="store_true")
    for kind in ("read-bam", "read-fastq"):
        r = mp.add_parser(kind)
        r.add_argument(*(("-b", "--bam", "-i", "--input") if kind == "read-bam" else ("-i", "--input")), dest="input", required=True)
        r.add_argument("-m", "--motifs", nargs="+", required=True)
        r.add_argument("-o", "--output", required=True)
        r.add_argument("-t", "--threads", type=int, default=1)
        r.add_argument("--compat", action="store_true")
        r.add_argument("--contig-ids" if kind == "read-bam" else "--read-ids")
        if kind == "read-bam":
            r.add_argument("-a", "--assembly", required=True)
    g = sub.add_parser("motif-cluster")
    g.add_argument("-m", "--motifs", nargs="+", required=True)
    g.add_argument("-o", "--output", required=True)
    z = sub.add_parser("bgzip").add_subparsers(dest="kind", required=True)
    k = z.add_parser("compress")
    k.add_argument("-i", "--input")
    k.add_argument("--stdin", action="store_true")
    k.add_argument("-o", "--output")
    k.add_argument("--stdout", action="store_true")
    k.add_argument("--keep", action="store_true")
    k.add_argument("--force", action="store_true")
    d = z.add_parser("decompress")
    d.add_argument("-i", "--input", required=True)
    d.add_argument("-o", "--output")
    d.add_argument("--ls", action="store_true")
    d.add_argument("-c", "--contigs", nargs="+")
    d.add_argument("-f", "--contigs-file")
    b = sub.add_parser("merge-tags")
    b.add_argument("--from-bam", required=True)
    b.add_argument("--to-bam", required=True)
    b.add_argument("-o", "--output", required=True)
    b.add_argument("--rename-tags-from-bam", "--rename-from", dest="rename_from", nargs="*", default=[])
    b.add_argument("--rename-tags-to-bam", "--rename-to", dest="rename_to", nargs="*", default=[])
    b.add_argument("--ignore-tags-from-bam", "--ignore-from", dest="ignore_from", nargs="*", default=[])
    return p


def _compress(a: argparse.Namespace) -> None:
    if bool(a.input) == a.stdin:
        raise SystemExit("give either --input or --stdin")
    if a.stdout and a.output:
        raise SystemExit("give either --output or --stdout")
    if a.stdin and a.keep:
        raise SystemExit("--keep is for files, not for --stdin")
    if not (a.stdin or a.stdout):
        api.bgzf_pileup(a.input, a.output, a.keep, a.force)
        return
    if a.stdin and not (a.stdout or a.output):
        raise SystemExit("--stdin needs --output or --stdout")
    target = sys.stdout.buffer if a.stdout else a.output
    if a.stdin:
        api.bgzf_lines(sys.stdin, target, a.force)
    else:
        with open(a.input) as f:
            api.bgzf_lines(f, target, a.force)
        if not a.keep:
            files.remove(a.input)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    mode = "compat" if getattr(a, "compat", False) else "spec"
    if a.command == "methylation-pattern" and a.kind == "contig":
        api.methylation_pattern(a.pileup, a.assembly, a.motifs, a.output_type, a.contigs, a.output, a.threads, a.min_valid_read_coverage, a.batch_size, a.min_valid_cov_to_diff_fraction, a.allow_mismatch)
    elif a.command == "methylation-pattern" and a.kind == "read-bam":
        spark = api._spark(None)
        assembly = readers.read_fasta(spark, a.assembly, _lines(a.contig_ids) if a.contig_ids else None)
        writers.write_tsv_file(api.read_bam_pattern(a.input, assembly, a.motifs, mode, spark), a.output, sort=False)
    elif a.command == "methylation-pattern":
        writers.write_tsv_file(api.read_fastq_pattern(a.input, a.motifs, _lines(a.read_ids) if a.read_ids else None, mode), a.output, sort=False)
    elif a.command == "motif-cluster":
        api.remove_child_motifs(a.output, a.motifs)
    elif a.command == "bgzip" and a.kind == "compress":
        _compress(a)
    elif a.command == "bgzip" and a.ls:
        print("\n".join(readers.indexed_contigs(a.input)))
    elif a.command == "bgzip":
        api.extract_pileup(a.input, a.output or sys.stdout, a.contigs, a.contigs_file)
    else:
        merged = api.merge_bam_tags(a.from_bam, a.to_bam, [parse_rename(x) for x in a.rename_from], [parse_rename(x) for x in a.rename_to], [Descriptor.parse(x) for x in a.ignore_from])
        api.write_alignments(merged, a.output, a.to_bam)
    return 0


if __name__ == "__main__":
    sys.exit(main())
