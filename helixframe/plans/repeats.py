"""Repeat finder over a genome or one sequence, as a command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..functions.sequence import merged_repeats, repeat_scan
from ..operators.cluster import shared_table
from ..operators.repeats import PIECE, contig_repeats
from ..sources.readers import read_fasta, read_sequence
from ..sources.sinks import write_repeats


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Direct and inverted repeats of sliding windows")
    group = p.add_mutually_exclusive_group(required=True)
    group.add_argument("--genome", help="FASTA file")
    group.add_argument("--seq", help="file with one sequence line")
    p.add_argument("--window", type=int, default=100_000)
    p.add_argument("--step", type=int, default=50_000)
    p.add_argument("--min-size", type=int, default=1)
    p.add_argument("--min-dist", type=int, default=5)
    p.add_argument("--whole", action="store_true", help="whole contigs instead of windows")
    p.add_argument("-o", "--out", required=True)
    a = p.parse_args(argv)
    if a.step > a.window:
        p.error("a step larger than the window would skip bases")
    spark = SparkSession.builder.getOrCreate()
    if a.whole:
        found = contig_repeats(read_fasta(spark, a.genome, PIECE).drop("chunk") if a.genome else read_sequence(spark, a.seq), a.min_size, a.min_dist)
    else:
        seqs = read_fasta(spark, a.genome) if a.genome else read_sequence(spark, a.seq)
        found = shared_table(repeat_scan(seqs, "contig", "seq", a.window, a.step, a.min_size, a.min_dist))
    dup, inv = merged_repeats(found)
    for name, rows in (("dup1", found.where("kind = 'dup'")), ("inv1", found.where("kind = 'inv'")), ("dup2", dup), ("inv2", inv)):
        write_repeats(rows, f"{a.out}/{name}", "overwrite")


if __name__ == "__main__":
    main()
