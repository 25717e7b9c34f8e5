"""Readers of the text formats, as DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """``contig, length`` from a FASTA index."""
    return spark.read.csv(path, sep="\t", schema="contig string, length bigint, offset bigint, bases bigint, width bigint").select("contig", "length")


def read_fasta(spark: SparkSession, path: str, chunk: int | None = None) -> DataFrame:
    """``contig, seq``, or ``contig, chunk, start, seq`` in pieces of ``chunk`` bases.

    The contig is the whole header line. Without ``chunk`` a contig is one row; with it no row holds more than a
    line or a chunk: blocks of the file are streamed in order, each from the contig and the bases of the blocks before it, so
    that lines are neither sorted nor shuffled; only chunks that a block's border cuts are put together by a shuffle. The names
    of the records have to differ.
    """
    if chunk:
        return _fasta_chunks(spark, path, chunk)
    raw = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    return raw.select(head.alias("contig"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "").alias("seq"))


def _fasta_chunks(spark: SparkSession, path: str, chunk: int) -> DataFrame:
    from ..operators.cluster import shared_table

    block = ["_f", "_o"]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_o"), "value")
    head = F.col("value").startswith(">")
    contig = F.when(head, F.regexp_replace(F.substring("value", 2, F.length("value")), "[\r\n]+$", ""))
    bases = F.when(head, "").otherwise(F.regexp_replace("value", r"\s", ""))
    lines = lines.select(*block, contig.alias("_c"), bases.alias("_s"))

    def runs(batches):
        """Stretches of a batch that lie in one block, with the block's key."""
        for b in batches:
            n = b.num_rows
            new = np.ones(n, bool)
            if n > 1:
                new[1:] = np.logical_or.reduce([pc.not_equal(b.column(k).slice(1), b.column(k).slice(0, n - 1)).to_numpy(zero_copy_only=False) for k in block])
            at = [*np.flatnonzero(new).tolist(), n]
            for x, y in zip(at[:-1], at[1:]):
                yield tuple(b.column(k)[x].as_py() for k in block), b.slice(x, y - x)

    def last(batches):
        """Of every block the last header, and the bases behind it (or all)."""
        key, name, n = None, None, 0
        for own, b in runs(batches):
            if own != key:
                if key is not None:
                    yield pa.RecordBatch.from_pylist([{"_f": key[0], "_o": key[1], "_c": name, "_n": n}], schema=kinds)
                key, name, n = own, None, 0
            size = pc.utf8_length(b.column("_s")).to_numpy().astype(np.int64)
            heads = np.flatnonzero(b.column("_c").is_valid().to_numpy(zero_copy_only=False))
            if len(heads):
                name, n, size = b.column("_c")[int(heads[-1])].as_py(), 0, size[heads[-1] :]
            n += int(size.sum())
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"_f": key[0], "_o": key[1], "_c": name, "_n": n}], schema=kinds)

    kinds = pa.schema([("_f", pa.string()), ("_o", pa.int64()), ("_c", pa.string()), ("_n", pa.int64())])
    ends = lines.mapInArrow(last, "_f string, _o bigint, _c string, _n bigint")
    along = Window.partitionBy("_f").orderBy("_o")
    ends = ends.withColumn("_group", F.sum(F.when(F.col("_c").isNotNull(), 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    sums = ends.withColumn("_open", F.sum("_n").over(Window.partitionBy("_f", "_group").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.withColumn("_name", F.last("_c", True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    before = along.rowsBetween(-1, -1)
    carry = sums.select(*block, F.first("_name").over(before).alias("_pc"), F.coalesce(F.first("_open").over(before), F.lit(0)).alias("_pn"))

    def cut(batches):
        """Pieces of chunks, streamed: only the open chunk is held."""
        key, name, at, held, carried = None, None, 0, "", False
        out: list[tuple] = []
        # a contig whose header ends the block before has an empty piece there, so its first chunk is put together
        apart = lambda: at % chunk == 0 and not (carried and at == 0)

        def leave(ended: bool):
            # the open piece; a header's is empty, and counts only where the contig has no bases
            if name is not None and (held or not at):
                out.append((name, at // chunk, at, held, ended and apart()))

        def sent():
            cols = list(zip(*out)) if out else [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_()))], ["contig", "chunk", "at", "s", "whole"])

        for own, b in runs(batches):
            if own != key:
                leave(False)
                key, name, at, held, carried = own, b.column("_pc")[0].as_py(), b.column("_pn")[0].as_py(), "", True
            heads = np.flatnonzero(b.column("_c").is_valid().to_numpy(zero_copy_only=False)).tolist()
            lines_ = b.column("_s").to_pylist()
            for x, y in zip([None, *heads], [*heads, len(lines_)]):
                if x is not None:
                    leave(True)
                    name, at, held, carried = b.column("_c")[x].as_py(), 0, "", False
                if name is None:
                    continue
                held += "".join(lines_[x or 0 : y])
                start = 0
                while len(held) - start >= chunk - at % chunk:
                    n = chunk - at % chunk
                    out.append((name, at // chunk, at, held[start : start + n], apart()))
                    start, at = start + n, at + n
                held = held[start:]
            if len(out) >= 1000:
                yield sent()
        leave(False)
        yield sent()

    # one row for each block of the files, so the lines keep their order
    placed = lines.join(F.broadcast(carry), block)
    pieces = shared_table(placed.mapInArrow(cut, "contig string, chunk int, at bigint, s string, whole boolean"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.length("s").alias("n"), "s"))), lambda x: x["s"]), "")
    rest = pieces.where("not whole").groupBy("contig", "chunk").agg(seq.alias("seq"))
    rows = pieces.where("whole").select("contig", "chunk", F.col("s").alias("seq")).union(rest)
    return rows.select("contig", "chunk", (F.col("chunk") * chunk).cast("bigint").alias("start"), "seq")


def fasta_region(chunks: DataFrame, regions: DataFrame, size: int) -> DataFrame:
    """``regions`` (contig, begin, end) with ``seq``: random access as an equi join on the chunk."""
    r = regions.withColumn("_id", F.monotonically_increasing_id())
    probe = r.withColumn("chunk", F.explode(F.sequence((F.col("begin") / size).cast("int"), ((F.greatest("end", F.col("begin") + 1) - 1) / size).cast("int"))))
    part = F.substring("seq", F.greatest(F.col("begin") - F.col("start"), F.lit(0)).cast("int") + 1, (F.least("end", F.col("start") + size) - F.greatest("begin", "start")).cast("int"))
    hit = probe.join(chunks, ["contig", "chunk"]).groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", part.alias("p")))), lambda x: x["p"]), "").alias("seq"))
    return r.join(hit, "_id", "left").drop("_id")


def parse_cigar(cigar: Column) -> Column:
    """CIGAR text to array<struct<op, len>>."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    return F.transform(ops, lambda o: F.struct((F.instr(F.lit("MIDNSHP=X"), F.right(o, F.lit(1))) - 1).cast("int").alias("op"), F.regexp_extract(o, r"\d+", 0).cast("int").alias("len")))


def read_sam(spark: SparkSession, path: str, sample: str = "sample") -> DataFrame:
    """Mapped alignments of SAM text in the alignment schema (0-based, half open)."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(f.alias("f")).where(F.size("f") >= 11)
    rows = rows.select(F.col("f")[0].alias("read"), F.col("f")[1].cast("int").alias("flag"), F.col("f")[2].alias("contig"), (F.col("f")[3].cast("bigint") - 1).alias("ref_start"), F.col("f")[4].cast("int").alias("mapq"), parse_cigar(F.col("f")[5]).alias("cigar"), F.col("f")[9].alias("seq"))
    total = lambda ops: F.aggregate("cigar", F.lit(0).cast("bigint"), lambda s, o: s + F.when(o["op"].isin(*ops), o["len"]).otherwise(0))
    lead = F.coalesce(F.get("cigar", F.lit(0)), F.struct(F.lit(0).alias("op"), F.lit(0).alias("len")))
    clip = F.when(lead["op"] == 4, lead["len"]).otherwise(0).cast("bigint")
    rows = rows.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("contig") != "*"))
    return rows.select(
        F.lit(sample).alias("sample"), "contig", "ref_start", (F.col("ref_start") + total((0, 2, 3, 7, 8))).alias("ref_end"), clip.alias("q_start"), (clip + total((0, 1, 7, 8))).alias("q_end"), total((0, 1, 4, 7, 8)).alias("q_len"),
        "mapq", (F.col("flag").bitwiseAND(16) != 0).alias("is_reverse"), (F.col("flag").bitwiseAND(2048) != 0).alias("is_supplementary"), "read", "cigar", "seq",
    )


def fetch(df: DataFrame, contig: str, start: int, stop: int, begin_col: str = "ref_start", end_col: str = "ref_end") -> DataFrame:
    """Region read: rows that overlap [start, stop). Plain predicates, so they reach a Parquet scan."""
    return df.where((F.col("contig") == contig) & (F.col(begin_col) < stop) & (F.col(end_col) > start))


def parse_info(info: Column) -> Column:
    """``k=v;...`` to a map; a flag without value maps to null."""
    return F.str_to_map(info, F.lit(";"), F.lit("="))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Compare records of a VCF: comment and short lines are skipped."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select("value", f.alias("f")).where(F.size("f") >= 8)
    rows = rows.select("value", "f", parse_info(F.col("f")[7]).alias("info"))
    pos, size = F.col("f")[1].cast("bigint"), F.abs(F.try_to_number(F.col("info")["SVLEN"], F.lit("S999999999999")).cast("bigint"))
    end = F.coalesce(F.col("info")["END"].try_cast("bigint"), pos + 1)
    return rows.select(F.col("f")[0].alias("contig"), pos.alias("pos1"), end.alias("pos2"), F.coalesce(F.abs(F.col("info")["SVLEN"].try_cast("bigint")), end - pos).alias("svlen"), F.upper(F.col("info")["SVTYPE"]).alias("svtype"), F.when(F.size("f") > 9, F.split_part(F.get("f", F.lit(9)), F.lit(":"), F.lit(1))).alias("gt"), F.col("value").alias("line"))


#: Event names of truth files.
TRUTH_TYPES = {"deletion": "DEL", "insertion": "INS", "inversion": "INV", "tandem duplication": "DUP"}


def read_truth(spark: SparkSession, first: str, second: str | None = None) -> DataFrame:
    """Compare records of one or two haplotype BEDs; an event of both is 1/1, of one 0/1."""
    schema = "contig string, pos1 bigint, pos2 bigint, name string, seq string"
    load = lambda p: spark.read.csv(p, sep="\t", schema=schema, comment="#")
    from ..operators.dominance import haplotype_genotypes

    rows = haplotype_genotypes(load(first), load(second)) if second else load(first).distinct().withColumn("gt", F.lit("1/1"))
    kind = F.create_map(*[F.lit(x) for kv in TRUTH_TYPES.items() for x in kv])[F.lower("name")]
    size = F.when(kind == "INS", F.length("seq")).otherwise(F.col("pos2") - F.col("pos1")).cast("bigint")
    return rows.where(kind.isNotNull()).select("contig", "pos1", "pos2", size.alias("svlen"), kind.alias("svtype"), "gt", F.concat_ws("\t", "contig", "pos1", "pos2", "name", "seq").alias("line"))


#: Codes of signal tuples.
SIGNAL_CODES = {1: "L", 2: "D", 3: "I", 4: "R"}


def read_signal_rows(spark: SparkSession, path: str, sample: str = "sample") -> DataFrame:
    """Signal rows of tab-separated text: ten fixed columns, then comma tuples, one row per tuple."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(f.alias("f"), F.md5("value").alias("hash")).where(F.size("f") > 10)
    rows = rows.select("f", "hash", F.explode(F.slice("f", F.lit(11), F.size("f"))).alias("t")).where(F.length("t") > 0).withColumn("t", F.split("t", ","))
    kind = F.create_map(*[F.lit(x) for kv in SIGNAL_CODES.items() for x in kv])[F.col("t")[2].cast("int")]
    g = lambda i: F.col("f")[i]
    rows = rows.withColumn("sig_type", kind)
    return rows.select(
        F.lit(sample).alias("sample"), g(0).alias("contig"), "sig_type", F.col("t")[0].cast("bigint").alias("start"), F.col("t")[1].cast("bigint").alias("stop"), F.when(F.col("sig_type") == "I", F.col("t")[3]).alias("seq"),
        F.element_at("t", -1).cast("bigint").alias("qpos"), F.when(F.col("sig_type") == "L", g(2)).when(F.col("sig_type") == "R", g(1)).cast("bigint").alias("other"), g(9).alias("read"), "hash", g(6).cast("int").alias("mapq"), (g(7) == "1").alias("is_reverse"), (g(8) == "1").alias("is_supplementary"), g(5).cast("bigint").alias("q_len"),
    )


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """The first line of a text file as a one-row ``contig, seq`` table."""
    return spark.read.text(path).limit(1).select(F.lit("seq").alias("contig"), F.trim("value").alias("seq"))
