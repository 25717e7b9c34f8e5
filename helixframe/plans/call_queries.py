"""Rules of the callers as queries: clusters and evidence are groups of the given tables.

A group of neighbouring intervals stands for a cluster, or for the evidence around a candidate.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Config
from ..functions import sequence as S
from ..operators import calls as V
from ..operators import cluster as K
from .queries import _IV, _turn_pairs, intervals, query

C = F.col


def _near(df, width):
    return df.withColumn("g", F.floor(C("b") / width).cast("bigint"))


@query(f"""WITH {_IV}, c AS (SELECT contig, CAST(floor(b / 20) AS BIGINT) AS g, count(*) FILTER (strand <> 'N') AS n, count(*) FILTER (status = 'O') AS depth, count(DISTINCT CASE WHEN mapq >= 45 THEN read END) AS sure FROM iv GROUP BY 1, 2)
  SELECT contig, g FROM c WHERE sure <= 2 AND n <= depth AND depth <= 5""")
def cluster_admission(spark, sf_dir):
    sure = F.count_distinct(F.when(C("mapq") >= 45, C("read")))
    c = _near(intervals(spark, sf_dir), 20).groupBy("contig", "g").agg(F.count_if(C("strand") != "N").alias("n"), F.count_if(C("status") == "O").alias("depth"), sure.alias("sure_reads"))
    return K.admitted(c, 2, 5).select("contig", "g")


def _clusters(spark, sf_dir):
    """Clusters of all four types in the columns that the callers read."""
    kind = F.when(C("strand") == "A", "D").when(C("strand") == "R", "I").when(C("status") == "O", "L").otherwise("R")
    rows = _near(intervals(spark, sf_dir), 40).withColumn("sig_type", kind)
    zero = F.lit(0.0)
    c = rows.groupBy(C("contig").cast("string").alias("contig"), "sig_type", "g").agg(
        F.min("id").alias("cluster_id"), F.min("b").alias("start_mode"), F.max("e").alias("stop_mode"), (F.max("e") - F.min("b")).alias("svlen_mode"), F.count_distinct("read").alias("support"),
        (F.count_distinct("read") + F.max("line")).alias("depth"), F.array_sort(F.collect_set(C("read").cast("string"))).alias("reads"), F.avg("mapq").alias("mapq_mean"),
    )
    extra = {"sample": F.lit("s"), "alt": F.lit(None).cast("string"), "mapq_std": zero, "svlen_median": zero, "start_std": zero, "stop_std": zero, "svlen_std": zero}
    return c.withColumns(extra)


_CLUSTERS = f"""{_IV}, k AS (SELECT *, CAST(floor(b / 40) AS BIGINT) AS g, CASE WHEN strand = 'A' THEN 'D' WHEN strand = 'R' THEN 'I' WHEN status = 'O' THEN 'L' ELSE 'R' END AS t FROM iv),
  c AS (SELECT contig, t, g, min(id) AS cid, min(b) AS s, max(e) AS e, max(e) - min(b) AS len, count(DISTINCT read) AS sup, count(DISTINCT read) + max(line) AS depth FROM k GROUP BY 1, 2, 3),
  r AS (SELECT DISTINCT c.contig, c.s, c.e, k.read FROM c JOIN k ON c.contig = k.contig AND c.t = k.t AND c.g = k.g WHERE c.t IN ('L', 'R'))"""
_CALL = ["contig", "pos", "stop", "svtype", "svlen", "support", "depth", "dr"]


@query(f"""WITH {_CLUSTERS}, x AS (SELECT contig, s, e FROM c WHERE t = 'R' AND sup >= 3), d AS (SELECT * FROM c WHERE t = 'D' AND sup * len >= 30 * 0.8 * depth * 0.5 AND NOT EXISTS (SELECT 1 FROM x WHERE x.contig = c.contig AND c.s < x.e AND x.s < c.e)),
  a AS (SELECT cid, read FROM d JOIN k ON d.contig = k.contig AND d.t = k.t AND d.g = k.g UNION SELECT cid, r.read FROM d JOIN r ON d.contig = r.contig AND d.s - 25 < r.e AND r.s < d.e + 25), n AS (SELECT cid, count(*) AS support FROM a GROUP BY 1)
  SELECT CAST(contig AS VARCHAR) AS contig, s AS pos, e AS stop, 'DEL' AS svtype, len AS svlen, support, depth, depth - support AS dr, round(support / depth, 6) AS af FROM d JOIN n ON d.cid = n.cid WHERE support / depth >= 0.001 AND len >= 30""")
def cluster_deletions(spark, sf_dir):
    c = _clusters(spark, sf_dir)
    exclude = c.where("sig_type = 'R' and support >= 3").select("sample", "contig", C("start_mode").alias("pos"), C("stop_mode").alias("stop"))
    return V.deletions_from_clusters(c, Config(), exclude).select(*_CALL, F.round("af", 6).alias("af"))


@query(f"""WITH {_CLUSTERS}, i AS (SELECT * FROM c WHERE t = 'I' AND sup >= 2), a AS (SELECT DISTINCT cid, r.read FROM i JOIN r ON i.contig = r.contig AND i.s - 100 < r.e AND r.s < i.s + 100), n AS (SELECT cid, count(*) AS more FROM a GROUP BY 1),
  f AS (SELECT i.*, sup + coalesce(more, 0) AS support FROM i LEFT JOIN n ON i.cid = n.cid)
  SELECT CAST(contig AS VARCHAR) AS contig, s AS pos, s + 1 AS stop, 'INS' AS svtype, len AS svlen, support, depth, depth - support AS dr, round(support / depth, 6) AS af FROM f WHERE support / depth >= 0.001 AND len >= 30""")
def cluster_insertions(spark, sf_dir):
    return V.insertions(_clusters(spark, sf_dir)).select(*_CALL, F.round("af", 6).alias("af"))


def _evidence(spark, sf_dir, width=100):
    """Groups with their D and I evidence as short arrays, and a region that is wider for two contigs of three."""
    rows = _near(intervals(spark, sf_dir), width)
    one = lambda s: F.array_sort(F.collect_list(F.when(C("strand") == s, F.struct("b", "e", (C("e") - C("b")).alias("len"), C("mapq").alias("sup")))))
    pad = C("contig") % 3 * 500
    g = rows.groupBy("contig", "g").agg(F.min("b").alias("lo"), F.max("e").alias("hi"), one("A").alias("ds"), one("R").alias("is_"), F.sum("line").alias("lines"), F.count("*").alias("n"))
    return g.withColumns({"begin": C("lo") - pad, "end": C("hi") + pad})


_EV = f"""{_IV}, k AS (SELECT *, CAST(floor(b / 100) AS BIGINT) AS g, e - b AS len FROM iv), z AS (SELECT contig, g, min(b) - contig % 3 * 500 AS lo, max(e) + contig % 3 * 500 AS hi, CAST(sum(line) AS BIGINT) AS lines, count(*) AS n,
  count(*) FILTER (strand = 'A') AS n_d, count(*) FILTER (strand = 'R') AS n_i FROM k GROUP BY contig, g),
  w AS (SELECT k.contig, k.g, k.strand, k.b, k.e, k.len, k.mapq AS sup, z.lo, z.hi, CAST(z.hi - z.lo AS DOUBLE) AS size, least(k.len, z.hi - z.lo) / CAST(greatest(k.len, z.hi - z.lo) AS DOUBLE) AS ratio FROM k JOIN z ON k.contig = z.contig AND k.g = z.g)"""


@query(f"""WITH {_EV}, p AS (SELECT d.contig, d.g, count(*) AS n_pairs, min(struct_pack(key := abs(least(d.b, i.b) - d.lo) + abs(greatest(d.e, i.e) - d.hi), b := least(d.b, i.b), e := greatest(d.e, i.e))) AS best
    FROM w d JOIN w i ON d.contig = i.contig AND d.g = i.g AND d.strand = 'A' AND i.strand = 'R' AND abs(i.len - d.len) < 50 GROUP BY 1, 2),
  s AS (SELECT contig, g, bool_or(ratio > 0.1) FILTER (strand <> 'N') AS alike, bool_or(abs(b - lo) > 50 AND abs(b - hi) > 50) FILTER (strand <> 'N') AS away, bool_or(len / size >= 0.8) FILTER (strand <> 'N') AS whole, max(len) FILTER (strand <> 'N') AS top, min(len) FILTER (strand <> 'N') AS lowest,
    bool_or(abs((b - lo) + (e - hi)) < 100) FILTER (strand <> 'N') AS even, bool_or(len >= 50 AND ratio > 0.1) FILTER (strand <> 'N') AS odd FROM w GROUP BY 1, 2),
  j AS (SELECT z.*, s.* EXCLUDE (contig, g), coalesce(n_pairs, 0) AS n_pairs, best FROM z JOIN s ON z.contig = s.contig AND z.g = s.g LEFT JOIN p ON z.contig = p.contig AND z.g = p.g)
  SELECT contig, g, CASE WHEN n_d > 10 OR n_i > 10 THEN false WHEN n_d > 0 AND n_i > 0 THEN CASE WHEN alike THEN false WHEN n_pairs > 20 THEN false WHEN n_pairs >= 1 THEN true ELSE NOT away END
    WHEN n_d + n_i > 1 THEN CASE WHEN whole THEN false WHEN top - lowest > 30 OR lowest > 50 THEN false ELSE even END WHEN n_d + n_i = 1 THEN NOT odd ELSE lines % 2 = 0 END AS ok,
    CASE WHEN n_d > 0 AND n_i > 0 AND n_pairs >= 1 THEN best.b ELSE lo END AS b, CASE WHEN n_d > 0 AND n_i > 0 AND n_pairs >= 1 THEN best.e ELSE hi END AS e FROM j""")
def inversion_rules(spark, sf_dir):
    g = _evidence(spark, sf_dir)
    v = V.inversion_evidence(C("begin"), C("end"), C("ds"), C("is_"), F.size("ds"), F.size("is_"), C("lines") % 2 == 0)
    return g.select("contig", "g", v.alias("v")).select("contig", "g", "v.ok", "v.b", "v.e")


@query(f"""WITH {_EV}, f AS (SELECT contig, g, 1 AS one, CAST(lines * 7 % 300 AS DOUBLE) AS s1, CAST(hi - lo AS DOUBLE) AS s2, g % 4 = 0 AS flag, n AS sup, lines % 100 / 100 AS same, n * 20 AS n_reads, lo, hi, n_i, n_d FROM z),
  x AS (SELECT contig, g, CAST(max(len) FILTER (strand = 'R') AS DOUBLE) AS x_i, CAST(max(len) FILTER (strand = 'A') AS DOUBLE) AS x_d, min(struct_pack(b := b, e := e, len := len, sup := sup)) FILTER (strand = 'R') AS o FROM w GROUP BY 1, 2),
  q AS (SELECT u.contig, u.g, min(struct_pack(d := v.b - u.b, b := u.b, e := v.b)) FILTER (u.strand = 'R' AND v.strand = 'R' AND v.b - u.b > 0.2 * u.size) AS near_i, min(struct_pack(d := v.b - u.b, b := u.b, e := v.b)) FILTER (v.b - u.b > 0.3 * u.size) AS near_id
    FROM w u JOIN w v ON u.contig = v.contig AND u.g = v.g AND u.strand <> 'N' AND v.strand <> 'N' AND u.sup > 3 AND v.sup > 3 GROUP BY 1, 2),
  j AS (SELECT f.*, x_i, x_d, o, near_i, near_id, n_i = 1 AND abs(o.len - s1) < 100 AS lone FROM f JOIN x USING (contig, g) LEFT JOIN q USING (contig, g)),
  c AS (SELECT *, CASE WHEN sup < 2 THEN false WHEN x_i > 1.5 * s2 THEN false WHEN x_d > 0.5 * s2 THEN false ELSE true END AS close,
    CASE WHEN x_i > 1.5 * s2 THEN false WHEN n_i >= 2 THEN near_i IS NOT NULL OR x_i <= s1 WHEN lone THEN true ELSE x_i < 0.2 * s2 OR x_i >= 0.8 * s2 END AS only_i,
    CASE WHEN greatest(x_i, x_d) > s2 THEN false ELSE near_id IS NOT NULL OR greatest(x_i, x_d) <= s1 END AS with_d FROM j),
  v AS (SELECT *, CASE WHEN sup <= 3 THEN false WHEN x_i IS NOT NULL THEN CASE WHEN n_i > 0 AND n_d = 0 THEN only_i WHEN n_i > 0 AND x_d IS NOT NULL THEN with_d WHEN x_d IS NOT NULL THEN x_d <= 0.25 * s2 ELSE x_i <= s2 AND x_i <= s1 END
    WHEN x_d IS NOT NULL AND n_d > 0 THEN x_d <= 0.5 * s2 ELSE sup > 3 END AS far, CASE WHEN flag OR x_i IS NULL OR n_i = 0 THEN NULL WHEN n_d = 0 AND n_i >= 2 AND near_i IS NOT NULL THEN struct_pack(b := near_i.b, e := near_i.e)
    WHEN n_d = 0 AND lone THEN struct_pack(b := least(o.b, lo), e := greatest(o.b, hi)) WHEN n_d > 0 AND x_d IS NOT NULL AND near_id IS NOT NULL THEN struct_pack(b := near_id.b, e := near_id.e) END AS pick FROM c)
  SELECT contig, g, CASE WHEN same > 0.95 OR n_reads > 500 THEN false WHEN flag THEN close ELSE far END AS ok, pick IS NOT NULL AS redefined, coalesce(pick.b, lo) AS b, coalesce(pick.e, hi) AS e FROM v""")
def duplication_rules(spark, sf_dir):
    g = _evidence(spark, sf_dir)
    d = lambda x: x.cast("double")
    v = V.duplication_evidence(d(C("lines") * 7 % 300), d(C("end") - C("begin")), C("g") % 4 == 0, C("n"), C("ds"), C("is_"), C("lines") % 100 / 100, C("n") * 20, C("begin"), C("end"))
    return g.select("contig", "g", v.alias("v")).select("contig", "g", "v.ok", "v.redefined", "v.b", "v.e")


@query(f"""WITH {_IV}, k AS (SELECT *, CAST(floor(b / 400) AS BIGINT) AS g FROM iv), z AS (SELECT contig, g, min(b) AS lo, max(e) AS hi FROM k GROUP BY 1, 2),
  p AS (SELECT z.contig, z.g, abs((l.b - lo) + (r.e - hi)) AS k, abs(l.b - lo) + abs(r.e - hi) AS s, r.e > l.b AS ok FROM z JOIN k l ON l.contig = z.contig AND l.g = z.g AND l.strand = 'A' JOIN k r ON r.contig = z.contig AND r.g = z.g AND r.strand = 'R'),
  t AS (SELECT *, row_number() OVER (PARTITION BY contig, g ORDER BY k, s, ok) AS i FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY contig, g ORDER BY i) AS j FROM t WHERE i <= 3 AND ok)
  SELECT z.contig, z.g, CAST(CASE WHEN f.k IS NULL OR f.k > 5 THEN 1000 ELSE f.s END AS BIGINT) AS offset_sum FROM z LEFT JOIN f ON f.contig = z.contig AND f.g = z.g AND f.j = 1""")
def symmetry_offsets(spark, sf_dir):
    at = lambda s, c: F.array_sort(F.collect_list(F.when(C("strand") == s, C(c))))
    g = _near(intervals(spark, sf_dir), 400).groupBy("contig", "g").agg(F.min("b").alias("lo"), F.max("e").alias("hi"), at("A", "b").alias("ls"), at("R", "e").alias("rs"))
    return g.select("contig", "g", V.symmetry_offset(C("ls"), C("rs"), C("lo"), C("hi")).cast("bigint").alias("offset_sum"))


@query(f"""WITH {_IV}, k AS (SELECT contig, CAST(floor(b / 400) AS BIGINT) AS g, b, e, strand FROM iv), z AS (SELECT contig, g, min(b) AS lo, max(e) AS hi FROM k GROUP BY 1, 2), d AS (SELECT DISTINCT contig, g, b, e FROM k WHERE strand = 'N'),
  n AS (SELECT d.contig, d.g, count(*) AS n, min(abs(b - lo)) AS near_b, min(abs(e - hi)) AS near_e, min(b) AS wb, max(e) AS we FROM d JOIN z USING (contig, g) GROUP BY 1, 2),
  p AS (SELECT x.contig, x.g, min(struct_pack(k := abs((x.b - lo) + (y.e - hi)), b := x.b, e := y.e)) AS best FROM d x JOIN d y ON x.contig = y.contig AND x.g = y.g AND y.e > x.b JOIN z ON z.contig = x.contig AND z.g = x.g GROUP BY 1, 2),
  j AS (SELECT z.contig, z.g, n, best, CASE WHEN n IS NULL OR n > 20 THEN NULL WHEN best.k < 100 THEN 1 WHEN near_b < 100 AND near_e < 100 THEN 2 END AS how, wb, we FROM z LEFT JOIN n USING (contig, g) LEFT JOIN p USING (contig, g))
  SELECT contig, g, CASE how WHEN 1 THEN best.b WHEN 2 THEN wb END AS b, CASE how WHEN 1 THEN best.e WHEN 2 THEN we END AS e FROM j""")
def region_symmetries(spark, sf_dir):
    subs = F.array_sort(F.collect_set(F.when(C("strand") == "N", F.struct("b", "e"))))
    g = _near(intervals(spark, sf_dir), 400).groupBy("contig", "g").agg(F.min("b").alias("lo"), F.max("e").alias("hi"), subs.alias("subs"))
    return g.select("contig", "g", V.region_symmetry(C("subs"), C("lo"), C("hi")).alias("v")).select("contig", "g", "v.b", "v.e")


def _flanks(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select(F.concat_ws("/", "conv_id", "turn").alias("id"), C("text").alias("l"), C("next").alias("r"), F.lit(40).alias("n"))


@query()
def shift_search(spark, sf_dir):
    return S.shift_search(_flanks(spark, sf_dir), "id", "l", "r", "n")


@query()
def shift_by_kmers(spark, sf_dir):
    return S.shift_by_kmers(_flanks(spark, sf_dir), "id", "l", "r", "n")
