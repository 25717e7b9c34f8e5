"""Sinks: VCF text, candidate and signal tables, repeat files, reports. All overwrite on request only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vcf_info(extra: dict[str, Column] | None = None) -> Column:
    """INFO of a call: ``k=v`` joined by semicolons, numbers rounded half to even to three places."""
    r = lambda c: F.bround(F.col(c), 3).cast("string")
    fields = {
        "SVTYPE": F.col("svtype"), "SVLEN": F.col("svlen").cast("string"), "END": F.col("stop").cast("string"), "SUPPORT": F.col("support").cast("string"), "AF": r("af"), "STD_POS1": r("pos1_std"), "STD_POS2": r("pos2_std"),
        "STD_SVLEN": r("svlen_std"), "mapQ_mean": r("mapq_mean"), "mapQ_std": r("mapq_std"), "MEDIAN_SVLEN": F.col("svlen_median").cast("string"), "READNAMES": F.array_join("reads", "|"), "RNAMES": F.lit("NULL"),
    } | (extra or {})
    return F.concat_ws(";", *[F.when(v.isNotNull(), F.concat(F.lit(k + "="), v)) for k, v in fields.items()])


def vcf_lines(calls: DataFrame) -> DataFrame:
    """One text line per call, ten VCF columns, sorted by contig and position."""
    name = F.concat_ws(".", "svtype", "contig", F.col("pos").cast("string"), F.col("svlen").cast("string"))
    sample = F.concat_ws(":", "gt1", "gt2", F.col("dr").cast("string"), F.col("support").cast("string"))
    alt = F.coalesce("alt", F.concat(F.lit("<"), F.col("svtype"), F.lit(">")))
    line = F.concat_ws("\t", "contig", F.col("pos").cast("string"), name, F.lit("N"), alt, F.lit("60"), F.lit("PASS"), vcf_info(), F.lit("GT1:GT2:DR:DV"), sample)
    return calls.repartitionByRange("contig", "pos").sortWithinPartitions("contig", "pos", "stop").select(line.alias("value"))


def write_vcf(calls: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    vcf_lines(calls).write.mode(mode).option("compression", compression).text(path)


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ("sample", "contig"), mode: str = "errorifexists") -> None:
    """Parquet partitioned by sample and contig; the rows should be sorted by position before."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_repeats(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated gzip text, sorted by contig and position."""
    cols = [F.col(c).cast("string") for c in df.columns]
    df.repartitionByRange("contig", "pos1").sortWithinPartitions("contig", "pos1").select(F.concat_ws("\t", *cols).alias("value")).write.mode(mode).option("compression", "gzip").text(path)


def write_report(summary: DataFrame, lists: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """The summary as JSON and each list of records as text below ``path``."""
    summary.write.mode(mode).json(f"{path}/summary")
    for name, rows in lists.items():
        rows.select("line").write.mode(mode).text(f"{path}/{name}")
