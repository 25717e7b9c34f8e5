"""Every operator as a query over the provided tables, each with its SQL.

Stand-ins: an interval is a row of ``lineitem`` (contig = supplier, begin = part, length =
quantity, read = order, strand = return flag); points are ``events``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import aggregate as A
from ..operators import annotate as N
from ..operators import breakpoints as B
from ..operators import cluster as K
from ..operators import dominance as D
from ..operators import intervals as I
from ..operators import signals as G
from ..sources import readers as R
from . import compare as P

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem")
    # order and line are no key of lineitem, so the identifier takes part, supplier and quantity too
    key = (((C("l_orderkey") * 8 + C("l_linenumber")) * 20011 + C("l_partkey")) * 1009 + C("l_suppkey")) * 53 + C("l_quantity").cast("bigint")
    return t.select(
        key.alias("id"), C("l_suppkey").alias("contig"), C("l_partkey").alias("b"), (C("l_partkey") + C("l_quantity").cast("bigint")).alias("e"), C("l_orderkey").alias("read"),
        C("l_returnflag").alias("strand"), C("l_linestatus").alias("status"), F.round(C("l_discount") * 600).cast("bigint").alias("mapq"), C("l_linenumber").cast("bigint").alias("line"),
    )


_IV = """iv AS (SELECT (((l_orderkey * 8 + l_linenumber) * 20011 + l_partkey) * 1009 + l_suppkey) * 53 + CAST(l_quantity AS BIGINT) AS id, l_suppkey AS contig, l_partkey AS b, l_partkey + CAST(l_quantity AS BIGINT) AS e, l_orderkey AS read,
  l_returnflag AS strand, l_linestatus AS status, CAST(round(l_discount * 600) AS BIGINT) AS mapq, CAST(l_linenumber AS BIGINT) AS line FROM lineitem)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "events")
    return t.select("event_id", C("event_type").alias("contig"), F.unix_seconds(C("ts").cast("timestamp")).alias("pos"), C("user_id").alias("read"), "value")


_PT = "pt AS (SELECT event_id, event_type AS contig, CAST(floor(epoch(ts)) AS BIGINT) AS pos, user_id AS read, value FROM events)"


def _as(df: DataFrame, t: str) -> DataFrame:
    return df.select(*[C(c).alias(c if c == "contig" else f"{c}_{t}") for c in df.columns])


@query(f"WITH {_IV} SELECT a.id, count(*) AS n FROM iv a JOIN iv b ON a.contig = b.contig AND a.b < b.e AND b.b < a.e AND a.id <> b.id GROUP BY a.id")
def interval_overlap(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    n = I.overlap_counts(iv, iv.select("contig", C("b").alias("ob"), C("e").alias("oe")), ["contig"], "id", "b", "e", "ob", "oe")
    return n.where("n > 1").select("id", (C("n") - 1).alias("n"))  # without itself


@query(f"WITH {_IV} SELECT a.strand, count(*) AS n, CAST(sum(least(a.e, b.e) - greatest(a.b, b.b)) AS BIGINT) AS shared FROM iv a JOIN iv b ON a.contig = b.contig AND a.strand = 'A' AND b.strand = 'R' AND a.b < b.e AND b.b < a.e GROUP BY 1")
def overlap_pairs(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    pairs = I.overlap_join(_as(iv.where("strand = 'A'"), "l"), _as(iv.where("strand = 'R'"), "r"), ["contig"], "b_l", "e_l", "b_r", "e_r")
    shared = F.least("e_l", "e_r") - F.greatest("b_l", "b_r")
    return pairs.groupBy(C("strand_l").alias("strand")).agg(F.count("*").alias("n"), F.sum(shared).alias("shared"))


@query(f"""WITH {_IV} SELECT c.id, CASE WHEN count(a.id) = 0 THEN 1 ELSE count(a.id) END AS depth FROM iv c LEFT JOIN iv a ON a.contig = c.contig
  AND ((a.b <= c.b - 5 AND c.b - 5 < a.e) OR (a.b <= c.e + 5 AND c.e + 5 < a.e)) GROUP BY c.id""")
def interval_stab_depth(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    return I.stab_depth(iv.withColumn("support", F.lit(1)), iv, ["contig"], "id", "b", "e", "id", "b", "e", 5, "support")


@query(f"WITH {_IV} SELECT a.id, count(*) AS n FROM iv a JOIN iv b ON a.contig = b.contig AND a.strand = 'A' AND b.strand = 'R' AND abs(a.b - b.b) <= 15 GROUP BY a.id")
def band_match(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    pairs = I.band_join(_as(iv.where("strand = 'A'"), "l"), _as(iv.where("strand = 'R'"), "r"), ["contig"], "b_l", "b_r", 15)
    return pairs.groupBy(C("id_l").alias("id")).agg(F.count("*").alias("n"))


@query(f"WITH {_IV} SELECT a.id, a.contig, a.b, a.e FROM iv a WHERE a.strand = 'N' AND NOT EXISTS (SELECT 1 FROM iv b WHERE b.strand = 'R' AND a.contig = b.contig AND a.b < b.e AND b.b < a.e)")
def anti_overlap(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    other = iv.where("strand = 'R'").select("contig", C("b").alias("ob"), C("e").alias("oe"))
    return I.anti_overlap(iv.where("strand = 'N'"), other, ["contig"], "id", "b", "e", "ob", "oe").select("id", "contig", "b", "e")


@query(f"WITH {_IV} SELECT a.id, a.contig, a.b, a.e FROM iv a WHERE a.strand = 'N' AND EXISTS (SELECT 1 FROM iv b WHERE b.strand = 'R' AND a.contig = b.contig AND a.b < b.e AND b.b < a.e)")
def semi_overlap(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    other = iv.where("strand = 'R'").select("contig", C("b").alias("ob"), C("e").alias("oe"))
    return I.semi_overlap(iv.where("strand = 'N'"), other, ["contig"], "id", "b", "e", "ob", "oe").select("id", "contig", "b", "e")


def _sets(spark, sf_dir):
    iv = intervals(spark, sf_dir).select("id", "contig", C("status").alias("svtype"), C("b").alias("pos1"), C("e").alias("pos2"), (C("e") - C("b")).alias("svlen"), "strand")
    return iv.where("strand = 'A'").drop("strand"), iv.where("strand = 'R'").drop("strand")


_MATCH = "a.contig = b.contig AND a.status = b.status AND (abs(a.b - b.b) <= 10 OR abs(a.e - b.e) <= 10) AND least(a.e - a.b, b.e - b.b) >= 0.7 * greatest(a.e - a.b, b.e - b.b)"


@query(f"""WITH {_IV}, x AS (SELECT * FROM iv WHERE strand = 'A'), y AS (SELECT * FROM iv WHERE strand = 'R'),
  s AS (SELECT a.status AS svtype, count(*) AS n_base, count(*) FILTER (EXISTS (SELECT 1 FROM y b WHERE {_MATCH})) AS tp_base FROM x a GROUP BY 1),
  t AS (SELECT a.status AS svtype, count(*) AS n_calls, count(*) FILTER (EXISTS (SELECT 1 FROM x b WHERE {_MATCH})) AS tp_calls FROM y a GROUP BY 1),
  u AS (SELECT coalesce(s.svtype, t.svtype) AS svtype, coalesce(n_base, 0) AS n_base, coalesce(n_calls, 0) AS n_calls, coalesce(tp_base, 0) AS tp_base, coalesce(tp_calls, 0) AS tp_calls FROM s FULL JOIN t ON s.svtype = t.svtype),
  v AS (SELECT *, n_calls - tp_calls AS fp, n_base - tp_base AS fn, CASE WHEN n_calls > 0 THEN tp_calls / n_calls ELSE 0 END AS p, CASE WHEN n_base > 0 THEN tp_base / n_base ELSE 0 END AS r FROM u)
  SELECT svtype, n_base, n_calls, tp_base, tp_calls, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM v""")
def callset_compare(spark, sf_dir):
    base, calls = _sets(spark, sf_dir)
    return P.compare(base, calls, 10).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"WITH {_IV} SELECT a.id FROM iv a WHERE a.strand = 'R' AND NOT EXISTS (SELECT 1 FROM iv b WHERE b.strand = 'A' AND {_MATCH})")
def callset_false_positives(spark, sf_dir):
    base, calls = _sets(spark, sf_dir)
    return P.false_positives(calls.withColumn("line", C("id")), base, 10).select(C("line").alias("id"))


@query(f"""WITH {_IV} SELECT a.id, a.contig, a.b, a.e FROM iv a WHERE NOT EXISTS (SELECT 1 FROM iv b WHERE a.contig = b.contig AND a.strand = b.strand AND a.id <> b.id
  AND (abs(a.b - b.b) < 3 OR abs(a.e - b.e) < 3) AND (b.e - b.b > a.e - a.b OR (b.e - b.b = a.e - a.b AND b.id < a.id)))""")
def dominance_dedup(spark, sf_dir):
    iv = intervals(spark, sf_dir).withColumn("size", C("e") - C("b"))
    return D.keep_dominant(iv, ["contig", "strand"], "id", "b", "e", "size", 3).select("id", "contig", "b", "e")


def _breakpoints(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem")
    return t.select(
        C("l_orderkey").alias("read"), (C("l_suppkey") % 3).cast("string").alias("contig"), (C("l_partkey") * 7 % 1000).alias("gpos"), (C("l_linenumber") * 40 + C("l_quantity").cast("bigint")).cast("bigint").alias("qpos"),
        F.when(C("l_returnflag") == "N", 1).otherwise(4).alias("rl"), F.lit(300).cast("bigint").alias("qlen"), (C("l_extendedprice").cast("bigint") % 300).alias("other"), C("l_linestatus").alias("hash"), (C("l_shipdate") < "1995-06-01").alias("is_reverse"),
    )


_PAIRED = """p AS (SELECT l_orderkey AS read, CAST(l_suppkey % 3 AS VARCHAR) AS contig, l_partkey * 7 % 1000 AS g, l_linenumber * 40 + CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 4 END AS rl,
    CAST(trunc(l_extendedprice) AS BIGINT) % 300 AS o, l_linestatus AS h, l_shipdate < TIMESTAMP '1995-06-01' AS rev FROM lineitem),
  i AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY q, contig, g, rl) AS k, bool_or(rev) OVER (PARTITION BY read) AND bool_or(NOT rev) OVER (PARTITION BY read) AS mixed FROM p),
  j AS (SELECT a.read, a.contig AS contig, b.contig AS c2, a.g AS g1, b.g AS g2, a.q AS q1, b.q AS q2, a.rl AS r1, b.rl AS r2, a.o AS o1, b.o AS o2, a.mixed AND a.h = b.h AS inv,
    abs(a.q + b.q - 300) AS rq, abs(a.q - b.q) AS dq, abs(a.g - b.g) AS dg FROM i a JOIN i b ON a.read = b.read AND ((a.contig = b.contig AND a.k < b.k) OR a.contig < b.contig)),
  k AS (SELECT *, CASE WHEN contig <> c2 THEN CASE WHEN r1 <> r2 THEN CASE WHEN (r1 = 4 AND g1 <= g2) OR g1 >= g2 THEN 'BND' END WHEN rq <= 200 THEN 'BND' END
    WHEN g1 = g2 THEN NULL
    WHEN r1 = r2 THEN CASE WHEN dg > 100 AND rq <= 100 THEN 'INV' WHEN dg > 100 THEN 'sub-INV' END
    WHEN r1 = 1 AND g1 > g2 THEN CASE WHEN dg > 100 THEN CASE WHEN rq <= 100 THEN 'DEL' ELSE 'sub-DEL' END WHEN dq > 100 THEN 'INS' END
    WHEN r1 = 1 THEN CASE WHEN dq <= 100 AND dg > 100 THEN 'DUP' WHEN abs(o1 - 300) <= 50 AND o2 <= 50 THEN 'DUP' WHEN inv THEN 'INV' END
    WHEN g1 > g2 THEN CASE WHEN dq <= 100 AND dg > 100 THEN 'DUP' WHEN abs(o2 - 300) <= 50 AND o1 <= 50 THEN 'DUP' WHEN inv THEN 'INV' END
    ELSE CASE WHEN dg > 100 THEN CASE WHEN rq <= 100 THEN 'DEL' ELSE 'sub-INV' END WHEN dq > 100 THEN 'INS' END END AS ev FROM j)"""


@query(f"""WITH {_PAIRED}
  SELECT contig, CASE WHEN contig <> c2 THEN c2 END AS contig2, replace(ev, 'sub-', '') AS svtype, starts_with(ev, 'sub-') AS is_sub, count(*) AS n, CAST(sum(CASE WHEN contig = c2 THEN least(g1, g2) ELSE g1 END) AS BIGINT) AS sum1,
    CAST(sum(CASE WHEN contig = c2 THEN greatest(g1, g2) ELSE g2 END) AS BIGINT) AS sum2 FROM k WHERE ev IS NOT NULL GROUP BY 1, 2, 3, 4""")
def self_pair_classify(spark, sf_dir):
    ev = B.pair_events(_breakpoints(spark, sf_dir), ["read"])
    return ev.groupBy("contig", "contig2", "svtype", "is_sub").agg(F.count("*").alias("n"), F.sum("pos1").alias("sum1"), F.sum("pos2").alias("sum2"))


@query(f"""WITH {_PT}, g AS (SELECT contig, CAST(floor((pos - 1) / 86400) AS BIGINT) AS day, read FROM pt GROUP BY ALL)
  SELECT a.contig AS contig_l, b.contig AS contig_r, a.day, count(*) AS n_shared FROM g a JOIN g b ON a.day = b.day AND a.read = b.read AND a.contig < b.contig GROUP BY ALL""")
def pair_shared_reads(spark, sf_dir):
    from ..operators.calls import shared_read_pairs

    w = I.windows(points(spark, sf_dir), "pos", 86400).groupBy(C("window_id").alias("day"), "contig").agg(F.collect_set("read").alias("reads"))
    side = lambda t: w.select("day", F.struct("day", "contig").alias(f"id_{t}"), C("reads").alias(f"reads_{t}"))
    got = shared_read_pairs(side("l"), side("r"), ["day"], "id_l", "id_r", "reads_l", "reads_r").where("id_l.contig < id_r.contig")
    return got.select(C("id_l.contig").alias("contig_l"), C("id_r.contig").alias("contig_r"), C("id_l.day").alias("day"), "n_shared")


@query(f"""WITH {_IV}, s AS (SELECT id, contig, b FROM iv WHERE strand = 'A'), n AS (SELECT s.id, c.b AS partner, 'cluster' AS source FROM s JOIN iv c ON c.strand = 'R' AND s.contig = c.contig AND abs(s.b - c.b) <= 3),
  x AS (SELECT s.id, c.e AS partner, 'ends' AS source FROM s JOIN iv c ON c.strand = 'N' AND s.contig = c.contig AND abs(s.b - c.e) <= 3 WHERE s.id NOT IN (SELECT id FROM n)) SELECT * FROM n UNION ALL SELECT * FROM x""")
def fallback_lookup(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    return I.fallback_lookup(iv.where("strand = 'A'"), iv.where("strand = 'R'"), iv.where("strand = 'N'"), ["contig"], "id", "b", "b", "e", 3)


@query(f"""WITH {_IV} SELECT contig, count(*) AS n, count(DISTINCT read) AS support, round(avg(mapq), 6) AS mapq_mean, round(stddev_pop(mapq), 6) AS mapq_std, round(stddev_pop(b), 6) AS start_std, round(stddev_pop(e), 6) AS stop_std,
  round(stddev_pop(abs(e - b)), 6) AS svlen_std, median(abs(e - b)) AS svlen_median, max(abs(e - b)) AS svlen_max, round(avg(abs(e - b)), 6) AS svlen_avg FROM iv GROUP BY contig""")
def cluster_stats(spark, sf_dir):
    s = A.cluster_stats(intervals(spark, sf_dir), ["contig"], "b", "e")
    return s.withColumns({c: F.round(c, 6) for c in ("mapq_mean", "mapq_std", "start_std", "stop_std", "svlen_std", "svlen_avg")})


@query(f"""WITH {_IV}, s AS (SELECT contig, b, count(*) AS c, min(id) AS o, arg_min(e, id) AS w FROM iv GROUP BY 1, 2), sb AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY c DESC, o) AS k FROM s),
  t AS (SELECT contig, e, count(*) AS c, min(id) AS o, arg_min(b, id) AS w FROM iv GROUP BY 1, 2), tb AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY c DESC, o) AS k FROM t),
  l AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY b DESC, id) AS k FROM iv), z AS (SELECT contig, count(*) AS n, max(e - b) AS longest, CAST(trunc(avg(e - b)) AS BIGINT) AS mean FROM iv GROUP BY 1)
  SELECT z.contig, z.n, CASE WHEN n < 3 THEN l.b WHEN sb.c > tb.c THEN sb.b ELSE tb.w END AS start_mode, CASE WHEN n < 3 THEN l.e WHEN sb.c > tb.c THEN sb.w ELSE tb.e END AS stop_mode, CASE WHEN n < 3 THEN longest ELSE mean END AS svlen_mode
  FROM z JOIN sb ON sb.contig = z.contig AND sb.k = 1 JOIN tb ON tb.contig = z.contig AND tb.k = 1 JOIN l ON l.contig = z.contig AND l.k = 1""")
def mode_position(spark, sf_dir):
    return A.mode_position(intervals(spark, sf_dir), ["contig"], "id", "b", "e")


@query(f"""WITH {_IV} SELECT contig, CAST(trunc(avg(b)) AS BIGINT) AS start_mode, CAST(trunc(avg(b)) AS BIGINT) + 1 AS stop_mode, count(*) AS n, count(*) FILTER (strand = 'R') AS n_reverse, count(*) FILTER (status = 'O') AS n_secondary FROM iv GROUP BY 1""")
def side_position(spark, sf_dir):
    iv = intervals(spark, sf_dir).withColumns({"is_reverse": C("strand") == "R", "is_supplementary": C("status") == "O"})
    return A.side_position(iv, ["contig"], "b")


@query(f"""WITH RECURSIVE {_IV}, o AS (SELECT contig, b, id, row_number() OVER (PARTITION BY contig ORDER BY b, id) AS k FROM iv),
  f(contig, k, h, c) AS (SELECT contig, k, b, 1 FROM o WHERE k = 1 UNION ALL SELECT o.contig, o.k, CASE WHEN o.b - f.h < 20 THEN f.h ELSE o.b END, CASE WHEN o.b - f.h < 20 THEN f.c ELSE f.c + 1 END FROM f JOIN o ON o.contig = f.contig AND o.k = f.k + 1)
  SELECT contig, CAST(c AS BIGINT) AS cluster, count(*) AS n, min(h) AS head FROM f GROUP BY 1, 2""")
def leader_cluster_1d(spark, sf_dir):
    c = K.leader_1d(intervals(spark, sf_dir).select("contig", "b", "id"), ["contig"], "b", 20, "id")
    return c.groupBy("contig", "cluster").agg(F.count("*").alias("n"), F.min("b").alias("head"))


_NEAR = """((abs((f.h1 + f.h2) / 2.0 - (o.b + o.e) / 2.0) <> 0 AND least(f.h2, o.e) - greatest(f.h1, o.b) > 0.5 * greatest(f.h2 - f.h1, o.e - o.b)) OR (abs((f.h1 + f.h2) / 2.0 - (o.b + o.e) / 2.0) < 30
  AND abs((f.h2 - f.h1) - (o.e - o.b)) / 2.0 / (((f.h2 - f.h1) + (o.e - o.b)) / 2.0) < 0.3 AND abs(f.h1 - o.b) < least(f.h2 - f.h1, o.e - o.b)))"""


@query(f"""WITH RECURSIVE {_IV}, o AS (SELECT contig, b, e, id, row_number() OVER (PARTITION BY contig ORDER BY b, e, id) AS k FROM iv),
  f(contig, k, h1, h2, c) AS (SELECT contig, k, b, e, 1 FROM o WHERE k = 1 UNION ALL SELECT o.contig, o.k, CASE WHEN {_NEAR} THEN f.h1 ELSE o.b END, CASE WHEN {_NEAR} THEN f.h2 ELSE o.e END, CASE WHEN {_NEAR} THEN f.c ELSE f.c + 1 END
    FROM f JOIN o ON o.contig = f.contig AND o.k = f.k + 1) SELECT contig, CAST(c AS BIGINT) AS cluster, count(*) AS n, min(h1) AS head FROM f GROUP BY 1, 2""")
def leader_cluster_2d(spark, sf_dir):
    c = K.leader_2d(intervals(spark, sf_dir).select("contig", "b", "e", "id"), ["contig"], "b", "e", 30, "id")
    return c.groupBy("contig", "cluster").agg(F.count("*").alias("n"), F.min("b").alias("head"))


@query(f"""WITH {_PT}, l AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY contig ORDER BY pos, event_id) <= 600 THEN 0 ELSE 1 END AS new FROM pt),
  g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY contig ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM l) SELECT contig, island, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM g GROUP BY 1, 2""")
def islands_1d(spark, sf_dir):
    g = K.islands(points(spark, sf_dir), ["contig"], "pos", 600, "event_id")
    return g.groupBy("contig", "island").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))


@query(f"""WITH RECURSIVE {_IV}, sp AS (SELECT contig, strand, b, e, min(id) AS n FROM iv GROUP BY 1, 2, 3, 4), ed AS (SELECT x.n AS p, y.n AS q FROM sp x JOIN sp y ON x.contig = y.contig AND x.strand = y.strand AND x.n <> y.n
    AND (x.b - y.b) * (x.b - y.b) + (x.e - y.e) * (x.e - y.e) <= 16), r(n, c) AS (SELECT n, n FROM sp UNION SELECT ed.q, r.c FROM r JOIN ed ON r.n = ed.p), m AS (SELECT n, min(c) AS component FROM r GROUP BY n)
  SELECT iv.id, m.component FROM iv JOIN sp ON iv.contig = sp.contig AND iv.strand = sp.strand AND iv.b = sp.b AND iv.e = sp.e JOIN m ON m.n = sp.n""")
def components_2d(spark, sf_dir):
    return K.components_2d(intervals(spark, sf_dir).select("id", "contig", "strand", "b", "e"), ["contig", "strand"], "id", "b", "e", 4).select("id", "component")


@query(f"""WITH {_IV}, m AS (SELECT contig, b, e, max(e) OVER (PARTITION BY contig ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM iv),
  g AS (SELECT *, sum(CASE WHEN b <= far THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT contig, min(b) AS b, max(e) AS e, count(*) AS n FROM g GROUP BY contig, k""")
def merge_intervals(spark, sf_dir):
    return I.merge_intervals(intervals(spark, sf_dir), ["contig"], "b", "e")


@query(f"""WITH {_IV}, c AS (SELECT contig, count(*) FILTER (strand = 'A') AS support, count(*) AS depth FROM iv GROUP BY 1), n AS (SELECT *, CASE WHEN depth > 100 THEN CAST(round_even(support * 100.0 / depth, 0) AS BIGINT) ELSE support END AS v,
    least(depth, 100) - CASE WHEN depth > 100 THEN CAST(round_even(support * 100.0 / depth, 0) AS BIGINT) ELSE support END AS r FROM c), p AS (SELECT *, pow(0.9, r) * pow(0.1, v) AS a, pow(0.5, r + v) AS b, pow(0.1, r) * pow(0.9, v) AS c FROM n),
  q AS (SELECT *, ln(0.1) * support + ln(0.9) * (depth - support) AS x, ln(0.5) * support + ln(0.5) * (depth - support) AS y, ln(0.9) * support + ln(0.1) * (depth - support) AS z FROM p)
  SELECT contig, support, depth, round(support / depth, 6) AS af, depth - support AS dr, CASE WHEN a >= b AND a >= c THEN '0/0' WHEN b >= c THEN '0/1' ELSE '1/1' END AS gt1, CASE WHEN x >= y AND x >= z THEN '0/0' WHEN y >= z THEN '0/1' ELSE '1/1' END AS gt2 FROM q""")
def genotype(spark, sf_dir):
    c = intervals(spark, sf_dir).groupBy("contig").agg(F.count_if(C("strand") == "A").alias("support"), F.count("*").alias("depth"))
    s, d = C("support"), C("depth")
    return c.select("contig", "support", "depth", F.round(A.frequency(s, d), 6).alias("af"), (d - s).alias("dr"), A.genotype_product(s, d).alias("gt1"), A.genotype_binomial(s, d).alias("gt2"))


@query(f"""WITH {_IV}, q AS (SELECT contig, quantile_cont(e - b, 0.25) AS q1, quantile_cont(e - b, 0.75) AS q3 FROM iv WHERE mapq > 0 GROUP BY 1)
  SELECT contig, count(*) AS n, CAST(sum(e - b) AS BIGINT) AS total FROM iv JOIN q USING (contig) WHERE mapq > 0 AND e - b BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1""")
def iqr_filter(spark, sf_dir):
    iv = intervals(spark, sf_dir).where("mapq > 0").withColumn("size", C("e") - C("b"))
    return A.iqr_filter(iv, ["contig"], "size").groupBy("contig").agg(F.count("*").alias("n"), F.sum("size").alias("total"))


@query("SELECT event_type AS contig, user_id AS read, count(*) AS n_records FROM events GROUP BY 1, 2")
def read_counts(spark, sf_dir):
    return G.read_counts(points(spark, sf_dir), ["contig"])


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 2)")
def split_reads(spark, sf_dir):
    p = points(spark, sf_dir)
    return G.split_reads(p, [], "read", C("contig") == "purchase").select("event_id")


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def set_union(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(C("o_custkey").alias("k")).union(read(spark, sf_dir, "customer").select("c_custkey")).distinct()


@query("(SELECT c_custkey AS k FROM customer EXCEPT SELECT l_partkey FROM lineitem) UNION ALL (SELECT l_partkey FROM lineitem EXCEPT SELECT c_custkey FROM customer)")
def set_symmetric_difference(spark, sf_dir):
    return D.symmetric_difference(read(spark, sf_dir, "customer").select(C("c_custkey").alias("k")), read(spark, sf_dir, "lineitem").select(C("l_partkey").alias("k")))


@query("SELECT l_partkey AS k FROM lineitem EXCEPT SELECT l_suppkey FROM lineitem")
def set_except(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem")
    return t.select(C("l_partkey").alias("k")).subtract(t.select(C("l_suppkey").alias("k")))


@query(f"""WITH {_IV}, h AS (SELECT DISTINCT contig, b, strand FROM iv WHERE strand IN ('A', 'R')) SELECT contig, b, CASE WHEN count(*) = 1 THEN '0/1' ELSE '1/1' END AS gt FROM h GROUP BY 1, 2""")
def haplotype_genotypes(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    side = lambda s: iv.where(C("strand") == s).select("contig", "b")
    return D.haplotype_genotypes(side("A"), side("R"))


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk(spark, sf_dir):
    return D.top_k(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", C("rank").cast("bigint").alias("rank"))


@query(f"WITH {_PT} SELECT contig, CAST(floor((pos - 1) / 3600.0) AS BIGINT) AS window_id, count(*) AS n FROM pt GROUP BY 1, 2")
def position_windows(spark, sf_dir):
    return I.windows(points(spark, sf_dir), "pos", 3600).groupBy("contig", "window_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_IV}, w AS (SELECT contig, unnest(range(greatest(0, CAST(floor((b - 100) / 50.0) AS BIGINT) + 1), CAST(floor(b / 50.0) AS BIGINT) + 1)) * 50 AS window_start FROM iv) SELECT contig, window_start, count(*) AS n FROM w GROUP BY 1, 2""")
def sliding_windows(spark, sf_dir):
    return I.sliding_windows(intervals(spark, sf_dir), "b", 100, 50).groupBy("contig", "window_start").agg(F.count("*").alias("n"))


@query(f"""WITH {_IV}, m AS (SELECT contig, b, e, e - b AS n, max(e) OVER w AS far FROM iv WINDOW w AS (PARTITION BY contig ORDER BY b, e, e - b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  g AS (SELECT *, sum(CASE WHEN b < far THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY b, e, n ROWS UNBOUNDED PRECEDING) AS k FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY contig, k ORDER BY n DESC, e - b DESC, b, e) AS x FROM g) SELECT contig, b, e, n FROM r WHERE x = 1""")
def greedy_chain(spark, sf_dir):
    iv = intervals(spark, sf_dir).select("contig", "b", "e", (C("e") - C("b")).alias("n"))
    return D.greedy_chain(iv, ["contig"], "b", "e", "n")


def _turn_pairs(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = t.select("conv_id", (C("turn") - 1).alias("turn"), C("text").alias("next"))
    return t.join(nxt, ["conv_id", "turn"])


_KM = lambda c: f"list_distinct(CASE WHEN length({c}) >= 5 THEN list_transform(range(1, length({c}) - 3), lambda i: substring({c}, i, 5)) ELSE [] END)"


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, a.text, b.text AS nxt FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), k AS (SELECT conv_id, turn, {_KM('text')} AS x, {_KM('nxt')} AS y FROM p)
  SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END, 6) AS similarity FROM k""")
def kmer_jaccard(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(S.kmer_jaccard(C("text"), C("next"), 5), 6).alias("similarity"))


_GRAMS = lambda c: f"CASE WHEN length({c}) >= 5 THEN list_transform(range(1, length({c}) - 3), lambda i: substring({c}, i, 5)) ELSE [] END"


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, a.text, b.text AS nxt FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
  x AS (SELECT conv_id, turn, k, count(*) / any_value(t) AS f FROM (SELECT conv_id, turn, unnest({_GRAMS('text')}) AS k, length(text) - 4 AS t FROM p) GROUP BY 1, 2, 3),
  y AS (SELECT conv_id, turn, k, count(*) / any_value(t) AS f FROM (SELECT conv_id, turn, unnest({_GRAMS('nxt')}) AS k, length(nxt) - 4 AS t FROM p) GROUP BY 1, 2, 3),
  z AS (SELECT x.conv_id, x.turn, sum(least(x.f, y.f)) AS s FROM x JOIN y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.k = y.k GROUP BY 1, 2)
  SELECT p.conv_id, p.turn, round(coalesce(z.s, 0), 6) AS similarity FROM p LEFT JOIN z ON p.conv_id = z.conv_id AND p.turn = z.turn""")
def kmer_profile(spark, sf_dir):
    p = _turn_pairs(spark, sf_dir).withColumn("id", F.struct("conv_id", "turn"))
    return S.kmer_profile_similarity(p, "id", "text", "next", 5).select("id.conv_id", "id.turn", F.round("similarity", 6).alias("similarity"))


@query("""SELECT doc_id, md5(reverse(translate(regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ATCGN]', 'N', 'g'), 'ATCGN', 'TAGCN'))) AS digest, length(text) AS n FROM documents""")
def revcomp(spark, sf_dir):
    s = S.clean_bases(S.ascii_upper(C("text")))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(S.revcomp(s)).alias("digest"), F.length("text").cast("bigint").alias("n"))


@query("SELECT doc_id, md5(text || 'X' || reverse(translate(text, 'ATCGN', 'TAGCN'))) AS digest FROM documents")
def with_revcomp(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(S.with_revcomp(C("text"))).alias("digest"))


@query("""SELECT event_id, split_part(regexp_replace(props, '[{}" ]', '', 'g'), ':', 1) AS name, split_part(regexp_replace(props, '[{}" ]', '', 'g'), ':', 2) AS value FROM events""")
def info_parse(spark, sf_dir):
    info = R.parse_info(F.regexp_replace(F.regexp_replace("props", '[{}" ]', ""), ":", "="))
    return read(spark, sf_dir, "events").select("event_id", F.explode(info).alias("name", "value"))


def _alignments(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem")
    n = lambda c, m: F.floor(C(c)).cast("int") % m
    op = lambda o, x: F.struct(F.lit(o).cast("int").alias("op"), x.cast("int").alias("len"))
    cigar = F.array(op(4, n("l_extendedprice", 90)), op(0, n("l_quantity", 50) + 1000), F.struct(F.when(C("l_returnflag") == "A", 2).when(C("l_returnflag") == "R", 1).otherwise(0).alias("op"), (n("l_extendedprice", 70) + 1).alias("len")), op(0, F.lit(500)), op(4, n("l_extendedprice", 130)))
    return t.select(
        F.lit("s").alias("sample"), C("l_suppkey").cast("string").alias("contig"), C("l_partkey").alias("ref_start"), (C("l_partkey") + 1600).alias("ref_end"), F.lit(0).cast("bigint").alias("q_start"), F.lit(1600).cast("bigint").alias("q_end"), F.lit(1800).cast("bigint").alias("q_len"),
        F.round(C("l_discount") * 600).cast("int").alias("mapq"), (C("l_linestatus") == "O").alias("is_reverse"), (C("l_linenumber") > 1).alias("is_supplementary"), C("l_orderkey").cast("string").alias("read"), cigar.alias("cigar"), F.lit(None).cast("string").alias("seq"),
    )


_SIGNALS = """a AS (SELECT l_suppkey AS contig, l_partkey AS r, CAST(floor(l_extendedprice) AS BIGINT) % 90 AS s1, CAST(floor(l_quantity) AS BIGINT) % 50 + 1000 AS m1, l_returnflag AS f, CAST(floor(l_extendedprice) AS BIGINT) % 70 + 1 AS g, CAST(floor(l_extendedprice) AS BIGINT) % 130 AS s2 FROM lineitem WHERE round(l_discount * 600) >= 10),
  s AS (SELECT contig, 'L' AS sig_type, r - s1 AS b, r AS e, s1 AS q FROM a WHERE s1 >= 25 UNION ALL SELECT contig, CASE WHEN f = 'A' THEN 'D' ELSE 'I' END, r + m1, r + m1 + g, s1 + m1 FROM a WHERE f IN ('A', 'R') AND g >= 25
    UNION ALL SELECT contig, 'R', r + m1 + 500 + CASE WHEN f = 'R' THEN 0 ELSE g END, r + m1 + 500 + CASE WHEN f = 'R' THEN 0 ELSE g END + s2, s1 + m1 + 500 + CASE WHEN f = 'A' THEN 0 ELSE g END FROM a WHERE s2 >= 25)"""


@query(f"""WITH {_SIGNALS}
  SELECT CAST(contig AS VARCHAR) AS contig, sig_type, count(*) AS n, CAST(sum(b) AS BIGINT) AS b, CAST(sum(e) AS BIGINT) AS e, CAST(sum(q) AS BIGINT) AS q FROM s GROUP BY 1, 2""")
def cigar_signals(spark, sf_dir):
    s = G.extract(G.usable(_alignments(spark, sf_dir)))
    return s.groupBy("contig", "sig_type").agg(F.count("*").alias("n"), F.sum("start").alias("b"), F.sum("stop").alias("e"), F.sum("qpos").alias("q"))


@query()
def sv_calls(spark, sf_dir):
    from ..config import Config
    from .caller import call

    with K.scratch() as keep:
        found = call(_alignments(spark, sf_dir), Config(min_sv_size=10, max_depth=100_000, max_sure_reads=100_000)).calls
        return keep(K.shared_table(found.select("sample", "contig", "pos", "stop", "svtype", "svlen", "support", "depth", "gt1", "gt2")))


@query()
def alignment_score(spark, sf_dir):
    t = read(spark, sf_dir, "benchmark").select("item_id", "text")
    return t.select("item_id", S.alignment_score("text", S.revcomp(C("text"))).alias("score"), S.semiglobal_score("text", S.flank(C("text"), F.lit(10), F.lit(60))).alias("inner_score"))


@query(f"""WITH {_IV}, g AS (SELECT contig, strand, count(*) AS n, avg(e - b) AS m, var_samp(e - b) AS v FROM iv WHERE strand IN ('A', 'R') GROUP BY 1, 2), p AS (SELECT a.contig, a.n + b.n - 2 AS df, a.m - b.m AS d, ((a.n - 1) * coalesce(a.v, 0) + (b.n - 1) * coalesce(b.v, 0)) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n) AS q
    FROM g a JOIN g b ON a.contig = b.contig AND a.strand = 'A' AND b.strand = 'R' WHERE a.n + b.n > 2), t AS (SELECT contig, d / sqrt(q) AS t, CAST(df AS DOUBLE) AS df, abs(d / sqrt(q)) / 2000 AS h FROM p WHERE q > 0)
  SELECT contig, round(t, 6) AS t, df, round(1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) * h / 3 *
    list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(i * h, 2) / df, -(df + 1) / 2))), 6) AS p FROM t""")
def mean_difference(spark, sf_dir):
    iv = intervals(spark, sf_dir).where("strand in ('A', 'R')").withColumn("size", C("e") - C("b"))
    return A.mean_difference(iv, ["contig"], "size", "strand", ("A", "R")).where("t is not null").select("contig", F.round("t", 6).alias("t"), "df", F.round("p", 6).alias("p"))


_CUT = lambda k: f"""u AS (SELECT *, sum(c) OVER w AS n, sum(s) OVER w AS t, sum(c) OVER (PARTITION BY {k}) AS nn, sum(s) OVER (PARTITION BY {k}) AS tt FROM v WINDOW w AS (PARTITION BY {k} ORDER BY size)),
  g AS (SELECT {k}, size, row_number() OVER (PARTITION BY {k} ORDER BY CAST(t AS DOUBLE) * t / n + CAST(tt - t AS DOUBLE) * (tt - t) / (nn - n) DESC, size) AS r FROM u WHERE nn > n), cut AS (SELECT {k}, size AS cut FROM g WHERE r = 1)"""  # noqa: E731


@query(f"""WITH {_IV}, v AS (SELECT contig, e - b AS size, count(*) AS c, sum(e - b) AS s FROM iv GROUP BY 1, 2), {_CUT('contig')}
  SELECT iv.contig, CASE WHEN cut.cut IS NULL OR e - b <= cut.cut THEN 0 ELSE 1 END AS side, count(*) AS n, min(e - b) AS lo, max(e - b) AS hi FROM iv LEFT JOIN cut ON iv.contig = cut.contig GROUP BY 1, 2""")
def split_in_two(spark, sf_dir):
    iv = intervals(spark, sf_dir).select("contig", (C("e") - C("b")).alias("size"))
    return A.split_in_two(iv, ["contig"], "size").groupBy("contig", "side").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi"))


@query(f"WITH {_IV} SELECT c.id, count(DISTINCT a.read) AS depth FROM iv c JOIN iv a ON a.contig = c.contig AND a.b < c.e AND c.b < a.e GROUP BY c.id")
def depth_by_names(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    return N.depth_by_names(iv, iv, ["contig"], "id", "b", "e", "read", "b", "e")


@query(f"""WITH {_IV}, h AS (SELECT c.id, s.strand AS t, s.e - s.b AS n, s.read FROM iv c JOIN iv s ON s.contig = c.contig AND s.b < c.e AND c.b < s.e WHERE c.strand = 'N' AND s.strand IN ('A', 'R')),
  m AS (SELECT id, max(n) FILTER (t = 'A') AS max_i, max(n) FILTER (t = 'R') AS max_d, count(DISTINCT read) AS reads FROM h GROUP BY id)
  SELECT m.id, m.max_i, m.max_d, m.reads, count(*) FILTER (t = 'A' AND n >= max_i - 10) AS near_i, count(*) FILTER (t = 'R' AND n >= max_d - 10) AS near_d FROM h JOIN m ON m.id = h.id GROUP BY ALL""")
def indel_lengths(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    sig = iv.where("strand <> 'N'").select("contig", F.when(C("strand") == "A", "I").otherwise("D").alias("sig_type"), C("b").alias("start"), C("e").alias("stop"), "read")
    return N.indel_lengths(iv.where("strand = 'N'"), sig, ["contig"], "id", "b", "e", 10)


@query(f"""WITH {_IV}, h AS (SELECT p.id, a.read, a.b < p.b - 2 OR a.e > p.e + 2 AS far FROM iv p JOIN iv a ON a.contig = p.contig AND a.b < p.e AND p.b < a.e AND a.e - a.b > 1.5 * (p.e - p.b)),
  g AS (SELECT id FROM h GROUP BY id HAVING count(DISTINCT read) >= 4 AND count(*) FILTER (far) = 0) SELECT id FROM iv WHERE id NOT IN (SELECT id FROM g)""")
def spanning_guard(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    return N.spanning_guard(iv, iv, ["contig"], "id", "b", "e", "read", "b", "e", slack=2).select("id")


@query(f"""WITH {_IV} SELECT DISTINCT c.id FROM iv c JOIN iv r ON c.contig = r.contig AND c.strand = 'A' AND r.strand = 'R' AND c.b < r.e AND r.b < c.e
  WHERE abs((c.b + c.e) / 2.0 - (r.b + r.e) // 2) <= 3 AND ((c.b >= r.b AND c.e <= r.e) OR (abs(c.b - r.b) + abs(c.e - r.e)) / 2.0 < 3)""")
def palindrome_lookup(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    rep = iv.where("strand = 'R'").select("contig", C("b").alias("pos1"), C("e").alias("pos2"), F.lit(3).alias("size"), F.floor((C("b") + C("e")) / 2).alias("center"))
    return N.in_palindrome(iv.where("strand = 'A'"), rep, "id", "b", "e")


@query(f"""WITH {_IV}, h AS (SELECT c.id, r.b, r.e, row_number() OVER (PARTITION BY c.id ORDER BY r.e - r.b DESC, r.b, r.e) AS k FROM iv c JOIN iv r ON c.contig = r.contig AND c.strand = 'A' AND r.strand = 'R' AND c.b < r.e AND r.b < c.e
  AND abs(r.b - c.b) <= 20 AND abs(r.e - c.e) <= 20) SELECT id, b AS r_begin, e AS r_end FROM h WHERE k = 1""")
def tandem_lookup(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    rep = iv.where("strand = 'R'").select("contig", C("b").alias("pos1"), C("e").alias("pos2"), (C("e") - C("b")).alias("size"))
    return N.tandem_bounds(iv.where("strand = 'A'"), rep, "id", "b", "e", 20)


@query(f"""WITH c AS (SELECT conv_id, turn, text, length(text) AS size FROM conversations), v AS (SELECT conv_id, size, count(*) AS c, sum(size) AS s FROM c GROUP BY 1, 2), {_CUT('conv_id')},
  m AS (SELECT c.*, CASE WHEN cut.cut IS NULL OR c.size <= cut.cut THEN 0 ELSE 1 END AS side FROM c LEFT JOIN cut ON c.conv_id = cut.conv_id),
  q AS (SELECT conv_id, coalesce(stddev_pop(size) / avg(size), 0) AS cv, CASE WHEN abs(avg(size) FILTER (side = 1) - avg(size)) < abs(avg(size) FILTER (side = 0) - avg(size)) THEN 1 ELSE 0 END AS keep FROM m GROUP BY 1),
  r AS (SELECT m.conv_id, m.turn, m.text, q.cv FROM m JOIN q ON m.conv_id = q.conv_id WHERE q.cv <= 0.1 OR m.side = q.keep),
  x AS (SELECT conv_id, turn, k, count(*) / any_value(t) AS f FROM (SELECT conv_id, turn, unnest({_GRAMS('text')}) AS k, length(text) - 4 AS t FROM r) GROUP BY 1, 2, 3),
  y AS (SELECT a.conv_id, sum(least(a.f, b.f)) AS s FROM x a JOIN x b ON a.conv_id = b.conv_id AND a.k = b.k AND a.turn < b.turn GROUP BY 1), n AS (SELECT conv_id, count(*) AS n, any_value(cv) AS cv FROM r GROUP BY 1)
  SELECT n.conv_id, round(coalesce(y.s, 0) / n.n, 6) AS similarity, n.n, round(n.cv, 6) AS cv FROM n LEFT JOIN y ON n.conv_id = y.conv_id""")
def cluster_similarity(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return S.cluster_similarity(t, ["conv_id"], "turn", "text").withColumns({"similarity": F.round("similarity", 6), "cv": F.round("cv", 6)})


@query(f"WITH {_IV} SELECT contig, strand, count(*) AS n FROM iv GROUP BY 1, 2")
def type_totals(spark, sf_dir):
    return N.type_totals(intervals(spark, sf_dir), ["contig"], "strand")


_GATE = """c AS (SELECT contig, strand, count(*) AS n, stddev_pop(b) AS start_std, stddev_pop(e) AS stop_std, avg(abs(e - b)) AS svlen_avg FROM iv GROUP BY 1, 2)"""


@query(f"WITH {_IV}, {_GATE} SELECT contig, strand, n FROM c WHERE svlen_avg > 0 AND (start_std + stop_std) / 2 / svlen_avg / n < 20")
def emission_gate(spark, sf_dir):
    return K.emission_gate(A.cluster_stats(intervals(spark, sf_dir), ["contig", "strand"], "b", "e"), 20.0).select("contig", "strand", "n")


_READS = """r AS (SELECT contig, CASE strand WHEN 'A' THEN 'D' WHEN 'R' THEN 'I' ELSE 'L' END AS sig_type, count(DISTINCT read) AS support, count(DISTINCT CASE WHEN mapq >= 45 THEN read END) AS sure_reads,
  count(*) FILTER (status = 'O') AS depth FROM iv GROUP BY 1, 2)"""


@query(f"WITH {_IV}, {_READS} SELECT contig, sig_type FROM r WHERE sure_reads <= 55 AND support <= 250 AND (sig_type NOT IN ('D', 'I') OR depth <> 0)")
def admission_by_reads(spark, sf_dir):
    kind = F.when(C("strand") == "A", "D").when(C("strand") == "R", "I").otherwise("L")
    c = intervals(spark, sf_dir).groupBy("contig", kind.alias("sig_type")).agg(
        F.count_distinct("read").alias("support"), F.count_distinct(F.when(C("mapq") >= 45, C("read"))).alias("sure_reads"), F.count_if(C("status") == "O").alias("depth")
    )
    return K.admitted_by_reads(c, 55, 250).select("contig", "sig_type")


@query("SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS pos1, CASE WHEN l_partkey = l_suppkey THEN l_suppkey + 1 ELSE greatest(l_partkey, l_suppkey) END AS pos2 FROM lineitem")
def normalised_bounds(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C("l_partkey").alias("pos1"), C("l_suppkey").alias("pos2"))
    return B.normalise(t)


@query("SELECT DISTINCT user_id, event_type FROM events")
def unique_rows(spark, sf_dir):
    return G.unique_rows(read(spark, sf_dir, "events").select("user_id", "event_type"), "user_id", "event_type")


_AMOUNTS = "v AS (SELECT o_custkey, list(CAST(floor(o_totalprice) AS BIGINT) % 2001 - 1000 ORDER BY o_orderkey) AS amounts FROM orders GROUP BY 1)"


def _amounts(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", (F.floor("o_totalprice") % 2001 - 1000).alias("x")).alias("s"))
    return t.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]).alias("amounts"))


@query(f"WITH {_AMOUNTS} SELECT o_custkey, array_to_string(list_reverse_sort(list_distinct(list_filter(amounts, lambda x: x > 0))), ',') AS amounts FROM v")
def descending_above(spark, sf_dir):
    return _amounts(spark, sf_dir).select("o_custkey", F.array_join(S.descending_above(C("amounts"), 0).cast("array<string>"), ",").alias("amounts"))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 2001 - 1000 AS x FROM orders), p AS (SELECT o_custkey, o_orderkey, sum(x) OVER w AS upto, sum(x) OVER w - x AS before FROM x WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)),
  m AS (SELECT o_custkey, upto - min(before) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM p) SELECT o_custkey, CAST(max(s) AS DOUBLE) AS best FROM m GROUP BY 1""")
def max_subarray(spark, sf_dir):
    return _amounts(spark, sf_dir).select("o_custkey", S.max_subarray(C("amounts").cast("array<double>")).alias("best"))


@query("""WITH k AS (SELECT doc_id, unnest(CASE WHEN length(text) >= 17 THEN list_transform(range(1, length(text) - 15, 17), lambda i: substring(text, i, 17)) ELSE [] END) AS k FROM documents),
  c AS (SELECT doc_id, k, count(*) AS n FROM k GROUP BY 1, 2), r AS (SELECT doc_id, max(n) / sum(n) AS ratio FROM c GROUP BY 1) SELECT d.doc_id, round(coalesce(r.ratio, 0), 6) AS ratio FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id""")
def dominant_kmer(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.round(S.dominant_kmer_ratio(F.coalesce("text", F.lit(""))), 6).alias("ratio"))


@query(f"""WITH {_IV}, m AS (SELECT contig, b, e, e - b AS n, lag(b) OVER w AS prev FROM iv WINDOW w AS (PARTITION BY contig ORDER BY b, e, e - b)),
  g AS (SELECT *, sum(CASE WHEN b - prev <= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY b, e, n ROWS UNBOUNDED PRECEDING) AS k FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY contig, k ORDER BY n DESC, e - b DESC, b, e) AS x FROM g) SELECT contig, b, e, n FROM r WHERE x = 1""")
def greedy_chain_by_gap(spark, sf_dir):
    iv = intervals(spark, sf_dir).select("contig", "b", "e", (C("e") - C("b")).alias("n"))
    return D.greedy_chain(iv, ["contig"], "b", "e", "n", 20)


@query(f"""WITH {_IV}, c AS (SELECT contig, min(b) AS cb, min(b) + 500 AS ce, list(DISTINCT read) FILTER (strand = 'A') AS reads FROM iv GROUP BY 1)
  SELECT iv.contig, count(*) AS n, CAST(sum(iv.b) AS BIGINT) AS total FROM c JOIN iv ON c.contig = iv.contig AND list_contains(c.reads, iv.read) AND iv.b < c.ce AND c.cb < iv.e GROUP BY 1""")
def reads_over(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    regions = iv.groupBy("contig").agg(F.min("b").alias("cb"), (F.min("b") + 500).alias("ce"), F.collect_set(F.when(C("strand") == "A", C("read"))).alias("reads")).withColumn("region", C("contig"))
    return N.reads_over(regions, iv, ["contig"], "region", "reads", "cb", "ce", "read", "b", "e").groupBy(C("region").alias("contig")).agg(F.count("*").alias("n"), F.sum("b").alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that no other dominates, with their depth and genotypes."""
    iv = intervals(spark, sf_dir).withColumns({"size": C("e") - C("b"), "support": F.lit(1).cast("bigint")})
    kept = D.keep_dominant(iv, ["contig", "strand"], "id", "b", "e", "size", 3)
    depth = I.stab_depth(kept, iv, ["contig"], "id", "b", "e", "id", "b", "e", 5, "support")
    near = I.overlap_join(_as(kept, "l"), _as(iv, "r"), ["contig"], "b_l", "e_l", "b_r", "e_r").where("strand_l = strand_r").groupBy(C("id_l").alias("id")).agg(F.count_distinct("read_r").alias("n"))
    out = kept.drop("support").join(near, "id").join(depth, "id")
    return out.select("id", "contig", "b", "e", "strand", C("n").alias("support"), "depth", A.genotype_product(C("n"), C("depth")).alias("gt1"), A.genotype_binomial(C("n"), C("depth")).alias("gt2"))


from . import call_queries as _calls, io_queries as _io  # noqa: E402, F401  these register their queries
