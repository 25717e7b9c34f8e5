"""Scoring a call set against a truth set."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import near_ids


def match_ids(a: DataFrame, b: DataFrame, tolerance: int = 1000, ratio: float = 0.7) -> DataFrame:
    """Ids of rows of ``a`` with a partner in ``b``.

    Same contig and type, a start or an end at most ``tolerance`` apart, and a ratio of the
    lengths of at least ``ratio``. Both need id, contig, svtype, pos1, pos2, svlen.
    """
    keys = ["contig", "svtype", "end"]
    ends = F.posexplode(F.array("pos1", "pos2"))
    # starts and ends of a row go one way, so that either side is read and dealt once
    cols = lambda df, t: df.select("contig", "svtype", F.col("id").alias(f"id_{t}"), F.col("svlen").alias(f"svlen_{t}"), ends.alias("end", f"pos_{t}"))
    close = F.least("svlen_a", "svlen_b") >= ratio * F.greatest("svlen_a", "svlen_b")
    return near_ids(cols(a, "a"), cols(b, "b"), keys, "id_a", "pos_a", "pos_b", tolerance, close).withColumnRenamed("id_a", "id")


def compare(base: DataFrame, calls: DataFrame, tolerance: int = 1000, ratio: float = 0.7, strict_contigs: bool = False) -> DataFrame:
    """One row per svtype: n_base, n_calls, tp_base, tp_calls, fp, fn, precision, recall, f1.

    With ``strict_contigs`` calls on contigs without truth do not count. Zero denominators give 0.
    """
    if strict_contigs:
        calls = calls.join(base.select("contig").distinct(), "contig", "left_semi")
    side = lambda df, other: df.select("id", "svtype").join(match_ids(df, other, tolerance, ratio).withColumn("hit", F.lit(1)), "id", "left").groupBy("svtype").agg(F.count("*").alias("n"), F.count("hit").alias("tp"))
    b, c = side(base, calls).toDF("svtype", "n_base", "tp_base"), side(calls, base).toDF("svtype", "n_calls", "tp_calls")
    zero = F.lit(0).cast("bigint")
    both = b.join(c, "svtype", "full").select("svtype", *[F.coalesce(x, zero).alias(x) for x in ("n_base", "n_calls", "tp_base", "tp_calls")])
    part = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(0.0)
    both = both.withColumns({"fp": F.col("n_calls") - F.col("tp_calls"), "fn": F.col("n_base") - F.col("tp_base"), "precision": part("tp_calls", "n_calls"), "recall": part("tp_base", "n_base")})
    p, r = F.col("precision"), F.col("recall")
    return both.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def false_positives(calls: DataFrame, base: DataFrame, tolerance: int = 1000, ratio: float = 0.7) -> DataFrame:
    """Distinct lines of calls without a partner."""
    return calls.join(match_ids(calls, base, tolerance, ratio), "id", "left_anti").select("line").distinct()


def with_ids(df: DataFrame) -> DataFrame:
    """``id`` from the record itself, so that repeated lines count once."""
    return df.withColumn("id", F.md5("line")).dropDuplicates(["id"])


def main(argv: list[str] | None = None) -> None:
    from ..sources.readers import read_truth, read_vcf
    from ..sources.sinks import write_report

    p = argparse.ArgumentParser(description="Score a call set against a truth set")
    p.add_argument("-b", "--base", required=True, help="truth VCF, or the first haplotype's BED")
    p.add_argument("--second", help="second haplotype's BED")
    p.add_argument("-c", "--calls", required=True)
    p.add_argument("-s", "--svtypes", default="DEL,INS,INV,DUP")
    p.add_argument("-r", "--tolerance", type=int, default=1000)
    p.add_argument("-o", "--out", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    types = a.svtypes.split(",")
    base = with_ids((read_vcf(spark, a.base) if a.base.endswith(".vcf") else read_truth(spark, a.base, a.second)).where(F.col("svtype").isin(*types)))
    calls = with_ids(read_vcf(spark, a.calls).where(F.col("svtype").isin(*types)))
    hit_b, hit_c = match_ids(base, calls, a.tolerance), match_ids(calls, base, a.tolerance)
    lists = {"tp_base": base.join(hit_b, "id", "left_semi"), "fn": base.join(hit_b, "id", "left_anti"), "tp_calls": calls.join(hit_c, "id", "left_semi"), "fp": calls.join(hit_c, "id", "left_anti")}
    write_report(compare(base, calls, a.tolerance), lists, a.out, "overwrite")


if __name__ == "__main__":
    main()
