"""Sources and sinks as queries: files are written from the given tables into the shared folder and read back.

Registered beside the operators' queries; the files go when the application ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import breakpoints as B
from ..operators import signals as G
from ..operators.aggregate import combined
from ..operators.cluster import shared_path, until_exit
from ..sources import readers as R
from ..sources import sinks as W
from .queries import _IV, _PAIRED, _SIGNALS, _alignments, _breakpoints, intervals, query, read

C = F.col
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"


def folder(spark: SparkSession) -> str:
    return until_exit_later(spark, shared_path(spark, "io"))


def until_exit_later(spark: SparkSession, path: str) -> str:
    """The folder is made at once, so that it can be named for deletion before it is written to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(p)
    return until_exit(spark, path)


def bases(text: Column) -> Column:
    """The letters of a text as bases."""
    return F.translate(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[^a-z]", ""), LOWER, BASES)


_SEQ = f"seqs AS (SELECT doc_id, translate(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z]', '', 'g'), '{LOWER}', '{BASES}') AS s FROM documents)"


def _fasta(spark: SparkSession, sf_dir: str) -> str:
    path = f"{folder(spark)}/fa"
    seq = F.regexp_replace(bases(C("text")), "(.{1,60})", "$1\n")
    rows = read(spark, sf_dir, "documents").select(F.concat(F.lit(">doc"), C("doc_id").cast("string"), F.lit("\n"), seq).alias("value"))
    rows.write.text(path)
    return path


@query(f"WITH {_SEQ} SELECT 'doc' || doc_id AS contig, CAST(greatest(1, ceil(length(s) / 1000)) AS BIGINT) AS n_chunks, length(s) AS n_bases, md5(left(s, 1000)) AS first FROM seqs")
def fasta_bases(spark, sf_dir):
    chunks = R.read_fasta(spark, _fasta(spark, sf_dir), 1000)
    return chunks.groupBy("contig").agg(F.count("*").alias("n_chunks"), F.sum(F.length("seq")).alias("n_bases"), F.max(F.when(C("chunk") == 0, F.md5("seq"))).alias("first"))


@query(f"WITH {_SEQ} SELECT 'doc' || doc_id AS contig, doc_id % 500 AS \"begin\", doc_id % 500 + 150 AS \"end\", substring(s, doc_id % 500 + 1, 150) AS seq FROM seqs WHERE length(s) >= 700")
def fasta_regions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where(F.length(bases(C("text"))) >= 700)
    wanted = docs.select(F.concat(F.lit("doc"), C("doc_id").cast("string")).alias("contig"), (C("doc_id") % 500).alias("begin"), (C("doc_id") % 500 + 150).alias("end"))
    return R.fasta_region(R.read_fasta(spark, _fasta(spark, sf_dir), 100), wanted, 100)


@query("SELECT 'c' || l_suppkey AS contig, CAST(sum(l_partkey) AS BIGINT) AS length FROM lineitem GROUP BY 1")
def fai_lengths(spark, sf_dir):
    path = f"{folder(spark)}/fai"
    rows = read(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("c"), C("l_suppkey").cast("string")).alias("contig")).agg(F.sum("l_partkey").alias("length"))
    rows.select(F.concat_ws("\t", "contig", C("length").cast("string"), F.lit("0"), F.lit("60"), F.lit("61")).alias("value")).write.text(path)
    return R.read_fai(spark, path)


@query(f"WITH {_SIGNALS} SELECT CAST(contig AS VARCHAR) AS contig, sig_type, count(*) AS n, CAST(sum(b) AS BIGINT) AS b, CAST(sum(e) AS BIGINT) AS e FROM s WHERE contig <= 9 AND b < 9000 AND e > 2000 GROUP BY 1, 2")
def signal_table(spark, sf_dir):
    """Signals sorted by position, written as a partitioned table over an older one, fetched by regions of it."""
    path = f"{folder(spark)}/signals"
    signals = G.extract(G.usable(_alignments(spark, sf_dir)))
    rows = G.sorted_by_position(signals)
    # suppliers are too many contigs for a folder each; the files are sorted by contig, so their statistics serve a fetch as well
    W.write_table(G.sorted_by_position(signals.limit(10)), path, ("sample",))
    W.write_table(rows, path, ("sample",), "overwrite")
    table = spark.read.schema(rows.schema).parquet(path)
    found = None
    for k in range(10):
        part = R.fetch(table, str(k), 2000, 9000, "start", "stop")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("contig", "sig_type").agg(F.count("*").alias("n"), F.sum("start").alias("b"), F.sum("stop").alias("e"))


@query(f"""WITH {_IV} SELECT 'c' || contig AS contig, sig_type, count(*) AS n, CAST(sum(x) AS BIGINT) AS b, CAST(sum(y) AS BIGINT) AS e, CAST(sum(q) AS BIGINT) AS q, CAST(sum(o) AS BIGINT) AS other, count(seq) AS n_seq FROM (
  SELECT contig, 'L' AS sig_type, b - line AS x, b AS y, line AS q, b + 1000 AS o, NULL AS seq FROM iv UNION ALL SELECT contig, 'D', b + 10, e + 10, mapq, NULL, NULL FROM iv UNION ALL SELECT contig, 'I', b + 5, b + 6, 7, NULL, 'ACGT' FROM iv
  UNION ALL SELECT contig, 'R', b + 1000, b + 1000 + line, 99, b, NULL FROM iv WHERE strand = 'A') GROUP BY 1, 2""")
def signal_rows(spark, sf_dir):
    path = f"{folder(spark)}/rows"
    t = lambda *cs: F.concat_ws(",", *[(c if isinstance(c, Column) else F.lit(c)).cast("string") for c in cs])
    tuples = [t(C("b") - C("line"), C("b"), 1, C("line")), t(C("b") + 10, C("e") + 10, 2, C("mapq")), t(C("b") + 5, C("b") + 6, 3, "ACGT", 7), F.when(C("strand") == "A", t(C("b") + 1000, C("b") + 1000 + C("line"), 4, 99))]
    head = [F.concat(F.lit("c"), C("contig").cast("string")), C("b"), C("b") + 1000, F.lit(0), F.lit(1000), F.lit(1100), C("mapq"), F.lit(0), F.lit(1), C("read")]
    rows = intervals(spark, sf_dir).select(F.concat_ws("\t", *[c.cast("string") for c in head], *tuples).alias("value"))
    rows.write.text(path)
    got = R.read_signal_rows(spark, path)
    return got.groupBy("contig", "sig_type").agg(F.count("*").alias("n"), F.sum("start").alias("b"), F.sum("stop").alias("e"), F.sum("qpos").alias("q"), F.sum("other").alias("other"), F.count("seq").alias("n_seq"))


_MODE = lambda r: f"CASE WHEN ev = 'BND' THEN CASE WHEN 2 * count(*) FILTER ({r} = 1) >= count(*) THEN 1 ELSE 4 END END"


@query(f"""WITH {_PAIRED}, g AS (SELECT contig, CASE WHEN contig <> c2 THEN c2 END AS contig2, ev, CASE WHEN contig = c2 THEN least(g1, g2) ELSE g1 END AS pos1, CASE WHEN contig = c2 THEN greatest(g1, g2) ELSE g2 END AS pos2, r1, r2 FROM k WHERE ev IS NOT NULL)
  SELECT 's' AS sample, contig, contig2, pos1, pos2, replace(ev, 'sub-', '') AS svtype, count(*) AS support, {_MODE('r1')} AS rl1, {_MODE('r2')} AS rl2, starts_with(ev, 'sub-') AS is_sub
  FROM g GROUP BY contig, contig2, pos1, pos2, ev HAVING count(*) > 1 OR NOT starts_with(ev, 'sub-')""")
def candidate_table(spark, sf_dir):
    """Candidates of events at equal places, as one table that is written and read; BND ones keep the modal orientations."""
    events = B.pair_events(_breakpoints(spark, sf_dir).withColumn("sample", F.lit("s")), ["sample", "read"])
    found = B.candidates(events, 0)
    path = f"{folder(spark)}/candidates"
    W.write_table(found, path, ("sample", "svtype"))
    return spark.read.schema(found.schema).parquet(path).select(*found.columns)


def _calls(spark, sf_dir):
    t = intervals(spark, sf_dir)
    d = lambda c: c.cast("double")
    kind = F.when(C("strand") == "A", "DEL").when(C("strand") == "R", "INS").otherwise("DUP")
    gt = F.when(C("status") == "O", "0/1").otherwise("1/1")
    return t.select(
        F.lit("s").alias("sample"), F.concat(F.lit("c"), C("contig").cast("string")).alias("contig"), C("b").alias("pos"), C("e").alias("stop"), kind.alias("svtype"), (C("e") - C("b")).alias("svlen"), F.when(C("strand") == "R", "ACGT").alias("alt"),
        C("mapq").alias("support"), (C("mapq") + C("line")).alias("depth"), C("line").alias("dr"), (C("mapq") / (C("mapq") + C("line"))).alias("af"), gt.alias("gt1"), F.lit("./.").alias("gt2"), d(C("line")).alias("pos1_std"), (d(C("line")) / 8).alias("pos2_std"),
        F.lit(0.5).alias("svlen_std"), d(C("mapq")).alias("mapq_mean"), F.lit(None).cast("double").alias("mapq_std"), d(C("e") - C("b")).alias("svlen_median"), F.array(C("read").cast("string"), F.lit("x")).alias("reads"),
    )


_VCF = f"""{_IV}, v AS (SELECT *, 'c' || contig AS ctg, CASE strand WHEN 'A' THEN 'DEL' WHEN 'R' THEN 'INS' ELSE 'DUP' END AS t, CASE status WHEN 'O' THEN '0/1' ELSE '1/1' END AS g FROM iv),
  w AS (SELECT *, concat_ws(chr(9), ctg, b, t || '.' || ctg || '.' || b || '.' || (e - b), 'N', CASE WHEN strand = 'R' THEN 'ACGT' ELSE '<' || t || '>' END, '60', 'PASS', concat('SVTYPE=', t, ';SVLEN=', e - b, ';END=', e, ';SUPPORT=', mapq,
    ';AF=', round_even(mapq / (mapq + line), 3), ';STD_POS1=', CAST(line AS DOUBLE), ';STD_POS2=', round_even(line / 8, 3), ';STD_SVLEN=0.5;mapQ_mean=', CAST(mapq AS DOUBLE), ';MEDIAN_SVLEN=', CAST(e - b AS DOUBLE), ';READNAMES=', read, '|x;RNAMES=NULL'),
    'GT1:GT2:DR:DV', concat(g, ':./.:', line, ':', mapq)) AS line_ FROM v)"""


@query(f"WITH {_VCF} SELECT ctg AS contig, b AS pos1, e AS pos2, e - b AS svlen, t AS svtype, g AS gt, md5(line_) AS digest, count(*) AS n FROM w GROUP BY ALL")
def vcf_roundtrip(spark, sf_dir):
    path = f"{folder(spark)}/vcf"
    rows = _calls(spark, sf_dir)
    W.write_vcf(rows.limit(3), path)
    W.write_vcf(rows, path, "overwrite", "gzip")
    # 16 bytes of a digest are shuffled, not its 32 digits
    got = R.read_vcf(spark, path).withColumn("digest", F.unhex(F.md5("line")))
    keys = ["contig", "pos1", "pos2", "svlen", "svtype", "gt"]
    return got.groupBy(*keys, "digest").agg(F.count("*").alias("n")).select(*keys, F.lower(F.hex("digest")).alias("digest"), "n")


@query(f"""WITH {_IV}, h AS (SELECT DISTINCT contig, b, e, status, strand, CASE WHEN status = 'O' THEN NULL ELSE repeat('A', CAST(e - b AS INT)) END AS seq FROM iv WHERE strand IN ('A', 'R')),
  g AS (SELECT contig, b, e, status, CASE WHEN count(DISTINCT strand) = 1 THEN '0/1' ELSE '1/1' END AS gt FROM h GROUP BY 1, 2, 3, 4)
  SELECT 'c' || contig AS contig, b AS pos1, e AS pos2, e - b AS svlen, CASE WHEN status = 'O' THEN 'INV' ELSE 'INS' END AS svtype, gt FROM g""")
def truth_beds(spark, sf_dir):
    """Two haplotypes as BED files, read as one truth set."""
    top = folder(spark)
    iv = intervals(spark, sf_dir)
    name = F.when(C("status") == "O", "inversion").otherwise("insertion")
    seq = F.when(C("status") == "O", "").otherwise(F.expr("repeat('A', cast(e - b as int))"))
    rows = iv.select("strand", F.concat_ws("\t", F.concat(F.lit("c"), C("contig").cast("string")), C("b").cast("string"), C("e").cast("string"), name, seq).alias("value"))
    for side in "AR":
        rows.where(C("strand") == side).select("value").write.text(f"{top}/{side}")
    return R.read_truth(spark, f"{top}/A", f"{top}/R").select("contig", "pos1", "pos2", "svlen", "svtype", "gt")


@query(f"""WITH {_IV} SELECT 'summary' AS part, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(b) AS BIGINT) AS total FROM iv UNION ALL SELECT 'tp', count(*), CAST(sum(b) AS BIGINT) FROM iv WHERE strand = 'A' UNION ALL SELECT 'fp', count(*), CAST(sum(b) AS BIGINT) FROM iv WHERE strand = 'R'""")
def report_files(spark, sf_dir):
    top = folder(spark)
    rows = intervals(spark, sf_dir).withColumn("line", F.concat_ws("\t", C("id").cast("string"), C("b").cast("string")))
    summary = rows.groupBy("strand").agg(F.count("*").alias("n"), F.sum("b").alias("s"))
    W.write_report(summary, {"tp": rows.where("strand = 'A'"), "fp": rows.where("strand = 'R'")}, top, "overwrite")
    out = spark.read.schema("strand string, n long, s long").json(f"{top}/summary").agg(F.lit("summary").alias("part"), F.sum("n").alias("n_lines"), F.sum("s").alias("total"))
    for name in ("tp", "fp"):
        lines = spark.read.text(f"{top}/{name}")
        out = out.union(lines.agg(F.lit(name), F.count("*"), F.sum(F.split_part("value", F.lit("\t"), F.lit(2)).cast("bigint"))))
    return out


@query(f"WITH {_IV} SELECT CAST(contig AS VARCHAR) AS contig, b AS pos1, e AS pos2, e - b AS size, count(*) AS n FROM iv GROUP BY ALL")
def repeat_files(spark, sf_dir):
    path = f"{folder(spark)}/repeats"
    W.write_repeats(intervals(spark, sf_dir).select("contig", C("b").alias("pos1"), C("e").alias("pos2"), (C("e") - C("b")).alias("size")), path)
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(f.alias("f")).select(C("f")[0].alias("contig"), *[C("f")[k + 1].cast("bigint").alias(c) for k, c in enumerate(("pos1", "pos2", "size"))])
    return rows.groupBy("contig", "pos1", "pos2", "size").agg(F.count("*").alias("n"))


@query("SELECT 'seq' AS contig, CAST(string_agg(n_name, '' ORDER BY n_nationkey) AS VARCHAR) AS seq FROM nation")
def first_line(spark, sf_dir):
    path = f"{folder(spark)}/line"
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "")
    read(spark, sf_dir, "nation").agg(names.alias("value")).write.text(path)
    return R.read_sequence(spark, path)


@query("""SELECT md5(concat_ws(chr(9), 's', l_suppkey, l_partkey, l_partkey + 1600, 0, 1600, 1800, CAST(round(l_discount * 600) AS BIGINT), l_orderkey)) AS hash, count(*) AS n FROM lineitem GROUP BY 1""")
def record_hashes(spark, sf_dir):
    rows = _alignments(spark, sf_dir)
    return rows.groupBy(G.record_hash(rows).alias("hash")).agg(F.count("*").alias("n"))


@query(f"""WITH {_IV}, s AS (SELECT contig, count(*) FILTER (strand = 'A') AS l, count(*) FILTER (strand = 'R') AS r, count(DISTINCT CASE WHEN strand IN ('A', 'R') THEN read END) AS u FROM iv GROUP BY 1) SELECT contig, CAST(greatest(l, r, u) AS BIGINT) AS support FROM s""")
def combined_support(spark, sf_dir):
    on = lambda s: F.collect_set(F.when(C("strand") == s, C("read")))
    g = intervals(spark, sf_dir).groupBy("contig").agg(F.count_if(C("strand") == "A").alias("l"), F.count_if(C("strand") == "R").alias("r"), on("A").alias("x"), on("R").alias("y"))
    return g.select("contig", combined(C("l"), C("r"), C("x"), C("y")).cast("bigint").alias("support"))


@query(f"""WITH {_SEQ}, st AS (SELECT doc_id, s, unnest(range(0, CAST(greatest(1, ceil(length(s) / 1000)) AS BIGINT))) * 1000 AS base FROM seqs WHERE length(s) > 0),
  win AS (SELECT doc_id, base, substring(s, base + 1, 2000) AS x FROM st), two AS (SELECT doc_id, base, 0 AS side, x FROM win UNION ALL SELECT doc_id, base, 1, reverse(translate(x, 'ACGT', 'TGCA')) FROM win),
  k AS (SELECT doc_id, base, side, i, substring(x, i + 1, 20) AS k FROM (SELECT *, unnest(range(0, length(x) - 19)) AS i FROM two WHERE length(x) >= 20)),
  n AS (SELECT doc_id, base, k FROM k GROUP BY 1, 2, 3 HAVING count(*) > 1), hit AS (SELECT DISTINCT k.doc_id, k.base + k.i AS pos FROM k JOIN n USING (doc_id, base, k) WHERE side = 0)
  SELECT CAST(doc_id AS VARCHAR) AS contig, count(*) AS n, CAST(sum(pos) AS BIGINT) AS total FROM hit GROUP BY 1""")
def repeat_scan(spark, sf_dir):
    """Positions of every document at which 20 bases or more repeat, on either strand, within a window of 2,000."""
    from ..functions.sequence import repeat_scan as scan

    seqs = read(spark, sf_dir, "documents").select(C("doc_id").cast("string").alias("contig"), bases(C("text")).alias("seq"))
    found = scan(seqs, "contig", "seq", 2000, 1000, 20, 1)
    return found.select("contig", F.explode(F.array("pos1", "pos2")).alias("pos")).distinct().groupBy("contig").agg(F.count("*").alias("n"), F.sum("pos").alias("total"))


@query(f"""WITH {_SEQ}, two AS (SELECT doc_id, 0 AS side, s AS x FROM seqs UNION ALL SELECT doc_id, 1, reverse(translate(s, 'ACGT', 'TGCA')) FROM seqs),
  k AS (SELECT doc_id, side, i, substring(x, i + 1, 30) AS k FROM (SELECT *, unnest(range(0, length(x) - 29)) AS i FROM two WHERE length(x) >= 30)),
  n AS (SELECT doc_id, k FROM k GROUP BY 1, 2 HAVING count(*) > 1), hit AS (SELECT DISTINCT k.doc_id, k.i AS pos FROM k JOIN n USING (doc_id, k) WHERE side = 0)
  SELECT CAST(doc_id AS VARCHAR) AS contig, count(*) AS n, CAST(sum(pos) AS BIGINT) AS total FROM hit GROUP BY 1""")
def contig_repeats(spark, sf_dir):
    """Positions of every document at which 30 bases or more repeat, on either strand, however far apart."""
    from ..operators.repeats import contig_repeats as whole

    seqs = read(spark, sf_dir, "documents").select(C("doc_id").cast("string").alias("contig"), bases(C("text")).alias("seq"))
    found = whole(seqs, 30, 1)
    return found.select("contig", F.explode(F.array("pos1", "pos2")).alias("pos")).distinct().groupBy("contig").agg(F.count("*").alias("n"), F.sum("pos").alias("total"))
