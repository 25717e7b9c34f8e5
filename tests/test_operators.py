"""Operators on hand-built rows and by properties."""

import itertools
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.config import Config
from helixframe.functions import sequence as S
from helixframe.operators import aggregate as A
from helixframe.operators import breakpoints as B
from helixframe.operators import calls as V
from helixframe.operators import cluster as K
from helixframe.operators import dominance as D
from helixframe.operators import intervals as I
from helixframe.operators import signals as G
from helixframe.plans import caller, compare
from helixframe.schema import ALIGNMENT
from helixframe.sources import readers, sinks
from helixframe.streaming import windows as W


def test_overlap_join_is_the_naive_join(spark):
    rng = np.random.default_rng(3)
    make = lambda n: [(k, int(rng.integers(0, 2)), int(b := rng.integers(-5000, 9000)), int(b + rng.choice([0, 1, 30, 63, 64, 65, 900, 20_000, 3_000_000]))) for k in range(n)]
    a, b = make(150), make(150)
    got = I.overlap_join(spark.createDataFrame(a, "i long, c int, ab long, ae long"), spark.createDataFrame(b, "j long, c int, bb long, be long"), ["c"], "ab", "ae", "bb", "be").select("i", "j").collect()
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < max(y[3], y[2] + 1) and y[2] < max(x[3], x[2] + 1)}
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_stab_depth_edges_and_fallback(spark):
    c = spark.createDataFrame([(1, "a", 1000, 1200, 7), (2, "b", 1000, 1200, 7)], "id long, contig string, start long, stop long, support long")
    al = spark.createDataFrame([(1, "a", 900, 901), (2, "a", 0, 900), (3, "a", 1300, 1301), (4, "a", 1301, 1400), (5, "a", 0, 5000)], "aid long, contig string, b long, e long")
    got = {r.id: r.depth for r in I.stab_depth(c, al, ["contig"], "id", "start", "stop", "aid", "b", "e", 100, "support").collect()}
    assert got == {1: 3, 2: 7}


def test_sliding_windows(spark):
    got = {r.window_start for r in I.sliding_windows(spark.createDataFrame([(120,)], "p long"), "p", 100, 50).collect()}
    assert got == {50, 100}


def test_mode_position(spark):
    rows = [("a", 5, 9, 1), ("a", 7, 9, 2), ("a", 5, 8, 3), ("b", 1, 4, 1), ("b", 3, 5, 2), ("c", 1, 9, 1), ("c", 2, 9, 2), ("c", 3, 7, 3)]
    got = {r.k: (r.start_mode, r.stop_mode, r.svlen_mode) for r in A.mode_position(spark.createDataFrame(rows, "k string, start long, stop long, o long"), ["k"], "o").collect()}
    assert got == {"a": (5, 9, 3), "b": (3, 5, 3), "c": (1, 9, 6)}


def test_genotypes(spark):
    rows = [(0, 10), (5, 10), (10, 10), (11, 10), (0, 0), (100, 200), (1, 1000), (300, 200)]
    got = spark.createDataFrame(rows, "s long, d long").select(A.genotype_product(F.col("s"), F.col("d")), A.genotype_binomial(F.col("s"), F.col("d"))).collect()
    assert [g[0] for g in got] == ["0/0", "0/1", "1/1", "1/1", "0/0", "0/1", "0/0", "1/1"]
    assert [g[1] for g in got] == ["0/0", "0/1", "1/1", "0/0", "0/0", "0/1", "0/0", "0/0"]


def test_split_in_two(spark):
    got = {r.v: r.side for r in A.split_in_two(spark.createDataFrame([("a", v) for v in (1, 2, 3, 50, 52)] + [("b", 4)], "k string, v long"), ["k"], "v").collect()}
    assert got == {1: 0, 2: 0, 3: 0, 50: 1, 52: 1, 4: 0}


def test_student_p():
    t = np.array([2.228, 0, 12.706, -12.706, 1.96, 60.0, 1e-9])
    assert A.student_p(t, np.array([10, 5, 1, 1, 1e6, 30, 4])) == pytest.approx([0.05, 1, 0.05, 0.05, 0.05, 0, 1], abs=2e-4)
    assert A.student_p(np.array([1.0] * 3), np.array([1.0, 2.0, 4.0])) == pytest.approx([0.5, 1 - 1 / math.sqrt(3), 0.3739009663000589], abs=1e-12)
    assert A._log_gamma(np.array([0.5, 1, 2.5, 30.5, 500.0])) == pytest.approx([math.lgamma(x) for x in (0.5, 1, 2.5, 30.5, 500.0)], rel=1e-13, abs=1e-13)


def test_leader_differs_from_islands(spark):
    df = spark.createDataFrame([("c", p, p) for p in (0, 8, 16, 24, 100)], "k string, p long, i long")
    assert [r.cluster for r in K.leader_1d(df, ["k"], "p", 10, "i").orderBy("p").collect()] == [1, 1, 2, 2, 3]
    assert [r.island for r in K.islands(df, ["k"], "p", 8).orderBy("p").collect()] == [1, 1, 1, 1, 2]


def test_folds_by_region(spark, monkeypatch):
    """Small bins, so that a key has many regions: the same clusters and numbers as in one."""
    rng = np.random.default_rng(7)
    rows = [(f"k{k}", int(b), int(b + rng.integers(0, 30)), i) for k in range(3) for i, b in enumerate(rng.integers(-500, 1500, 150))]
    df = spark.createDataFrame(rows, "k string, b long, e long, i long")
    ops = [
        lambda: K.islands(df, ["k"], "b", 5, "i"), lambda: K.leader_1d(df, ["k"], "b", 9, "i"), lambda: K.leader_2d(df, ["k"], "b", "e", 6, "i"),
        lambda: I.merge_intervals(df, ["k"], "b", "e"), lambda: D.greedy_chain(df, ["k"], "b", "e", "i"), lambda: D.greedy_chain(df, ["k"], "b", "e", "i", 4),
    ]
    one = [sorted(map(tuple, op().collect())) for op in ops]
    monkeypatch.setattr(K, "REGION_BIN", 16)
    cut, region = K.regions(df, ["k"], F.col("b"), F.col("b"), 6)
    assert cut.select("k", region).distinct().count() > 20
    assert [sorted(map(tuple, op().collect())) for op in ops] == one


def plain_leaders(rows, joins):
    """Clusters by one loop over sorted rows."""
    out, head, number = [], None, 0
    for r in rows:
        if head is None or not joins(head, r):
            head, number = r, number + 1
        out.append(number)
    return out


def joins_2d(h, r, distance):
    (a, b), (c, d) = h, r
    la, lb = abs(b - a), abs(d - c)
    apart, mean = abs((a + b) / 2 - (c + d) / 2), (la + lb) / 2
    cv = abs(la - lb) / 2 / mean if mean else 0.0
    return (apart != 0 and min(b, d) - max(a, c) > 0.5 * max(la, lb)) or (apart < distance and cv < 0.3 and abs(a - c) < min(la, lb))


@pytest.mark.parametrize("batch, bins", [(10_000, 1 << 16), (7, 16), (50, 300)])
def test_leaders_like_a_loop(spark, monkeypatch, batch, bins):
    """Dense piles and long clusters, over batches and regions; column names that the operators use themselves."""
    monkeypatch.setattr(K, "REGION_BIN", bins)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rng = np.random.default_rng(batch)
    rows = [("k", int(b), int(b + rng.integers(0, 90)), i) for i, b in enumerate(rng.integers(0, 3000, 500))]
    rows += [("k", 5000 + i // 9, 5600 + i // 7, 1000 + i) for i in range(400)] + [("m", 10, 10, 1), ("m", 10, 10, 2), ("m", 11, 5, 3), ("m", -7, 40, 4)]
    df = spark.createDataFrame(rows, "_bin string, _region long, _new long, _chain long")
    try:
        one = {(r[0], r[3]): r.cluster for r in K.leader_1d(df, ["_bin"], "_region", 20, "_chain").collect()}
        two = {(r[0], r[3]): r.cluster for r in K.leader_2d(df, ["_bin"], "_region", "_new", 30, "_chain").collect()}
        assert K.islands(df, ["_bin"], "_region", 3, "_chain").count() == I.merge_intervals(df, ["_bin"], "_region", "_new").agg({"n": "sum"}).first()[0] == len(rows)
        assert D.greedy_chain(df, ["_bin"], "_region", "_new", "_chain").count() > 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in ("k", "m"):
        first = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[3]))
        assert [one[k, r[3]] for r in first] == plain_leaders([r[1] for r in first], lambda h, r: abs(r - h) < 20)
        second = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2], r[3]))
        assert [two[k, r[3]] for r in second] == plain_leaders([r[1:3] for r in second], lambda h, r: joins_2d(h, r, 30))


def test_components_2d(spark):
    rows = [(1, "c", 0, 0), (2, "c", 300, 400), (3, "c", 301, 900), (4, "c", 5000, 0), (5, "d", 0, 0), (6, "c", 0, 0)]
    got = {r.i: r.component for r in K.components_2d(spark.createDataFrame(rows, "i long, k string, x long, y long"), ["k"], "i", "x", "y", 500).collect()}
    assert got == {1: 1, 2: 1, 6: 1, 3: 3, 4: 4, 5: 5} or got == {1: 1, 2: 1, 6: 1, 3: 1, 4: 4, 5: 5} and math.dist((300, 400), (301, 900)) <= 500


def test_dominance_is_transitive_over_removed_rows(spark):
    rows = [(1, "c", 0, 100, 100), (2, "c", 50, 260, 210), (3, "c", 120, 500, 380), (4, "c", 9000, 9100, 100), (5, "c", 9000, 9100, 100)]
    df = spark.createDataFrame(rows, "id long, k string, s long, e long, n long")
    once = D.keep_dominant(df, ["k"], "id", "s", "e", "n", 100)
    assert sorted(r.id for r in once.collect()) == [3, 4] == sorted(r.id for r in D.keep_dominant(once, ["k"], "id", "s", "e", "n", 100).collect())


def test_haplotypes_and_symmetric_difference(spark):
    a, b = (spark.createDataFrame([(v,) for v in x], "v int") for x in ([1, 2, 2], [2, 3]))
    assert {r.v: r.gt for r in D.haplotype_genotypes(a, b).collect()} == {1: "0/1", 2: "1/1", 3: "0/1"}
    assert {r.v for r in D.symmetric_difference(a, b).collect()} == {1, 3}


def alignment(read, contig, start, cigar, mapq=60, reverse=False, supplementary=False, seq=None):
    ops = [(("MIDNSHP=X").index(c), int(n)) for n, c in __import__("re").findall(r"(\d+)([MIDNSHP=X])", cigar)]
    ref = sum(n for o, n in ops if o in (0, 2, 3, 7, 8))
    q = sum(n for o, n in ops if o in (0, 1, 4, 7, 8))
    lead = ops[0][1] if ops[0][0] == 4 else 0
    aligned = sum(n for o, n in ops if o in (0, 1, 7, 8))
    return ("s", contig, start, start + ref, lead, lead + aligned, q, mapq, reverse, supplementary, read, ops, seq or "A" * q)


def test_cigar(spark):
    rows = [alignment("r1", "c", 1000, "80S500M30D200=10X24I300N26I400M60S"), alignment("r2", "c", 10, "10H1000M10H"), alignment("r3", "c", 5, "1000M25D5M24D5M")]
    got = sorted(tuple(r) for r in G.extract(spark.createDataFrame(rows, ALIGNMENT)).select("read", "sig_type", "start", "stop", "qpos").collect())
    assert got == [("r1", "D", 1500, 1530, 580), ("r1", "I", 2040, 2066, 814), ("r1", "L", 920, 1000, 80), ("r1", "R", 2440, 2500, 1240), ("r3", "D", 1005, 1030, 1000)]
    low = spark.createDataFrame([alignment("a|b", "c", 0, "2000M", 9), alignment("a|b", "c", 0, "2000M", 10)], ALIGNMENT)
    assert [r.read for r in G.usable(low).collect()] == ["a"]


CASES = [  # g1, g2, q1, q2, rl1, rl2, other1, other2, mixed, same record, same contig, event; read length 1000
    (100, 900, 300, 700, 1, 1, 0, 0, False, False, True, "INV"), (100, 900, 300, 300, 1, 1, 0, 0, False, False, True, "sub-INV"), (100, 150, 300, 700, 1, 1, 0, 0, False, False, True, None),
    (900, 100, 300, 700, 1, 4, 0, 0, False, False, True, "DEL"), (900, 100, 300, 300, 1, 4, 0, 0, False, False, True, "sub-DEL"), (150, 100, 300, 500, 1, 4, 0, 0, False, False, True, "INS"),
    (100, 900, 300, 350, 1, 4, 0, 0, False, False, True, "DUP"), (100, 150, 300, 700, 1, 4, 980, 20, False, False, True, "DUP"), (100, 900, 100, 700, 1, 4, 500, 500, True, True, True, "INV"), (100, 900, 100, 700, 1, 4, 500, 500, True, False, True, None),
    (900, 100, 300, 350, 4, 1, 0, 0, False, False, True, "DUP"), (900, 100, 300, 700, 4, 1, 20, 980, False, False, True, "DUP"), (100, 900, 300, 700, 4, 1, 0, 0, False, False, True, "DEL"), (100, 900, 300, 300, 4, 1, 0, 0, False, False, True, "sub-INV"),
    (100, 150, 300, 500, 4, 1, 0, 0, False, False, True, "INS"), (100, 900, 300, 700, 4, 4, 0, 0, False, False, True, "INV"), (100, 100, 300, 700, 4, 1, 0, 0, False, False, True, None),
    (100, 900, 0, 0, 4, 1, 0, 0, False, False, False, "BND"), (100, 900, 0, 0, 1, 4, 0, 0, False, False, False, None), (900, 100, 0, 0, 1, 4, 0, 0, False, False, False, "BND"), (1, 2, 500, 600, 1, 1, 0, 0, False, False, False, "BND"), (1, 2, 100, 200, 1, 1, 0, 0, False, False, False, None),
]


def test_pair_table(spark):
    names = "g1 g2 q1 q2 rl1 rl2 o1 o2 mixed same_record same_contig want".split()
    df = spark.createDataFrame(CASES, "g1 long, g2 long, q1 long, q2 long, rl1 int, rl2 int, o1 long, o2 long, mixed boolean, same_record boolean, same_contig boolean, want string")
    c = {n: F.col(n) for n in names}
    event = B.classify(c["g1"], c["g2"], c["q1"], c["q2"], c["rl1"], c["rl2"], F.lit(1000), c["o1"], c["o2"], c["mixed"], c["same_record"], c["same_contig"])
    assert [r for r in df.select("*", event.alias("got")).collect() if r.want != r.got] == []


def test_cross_contig_pairs_include_the_first(spark):
    pts = [("s", "r", "c1", 10, 0, 4, 1000, 0, "h", False), ("s", "r", "c2", 20, 5, 1, 1000, 0, "h", False)]
    df = spark.createDataFrame(pts, "sample string, read string, contig string, gpos long, qpos long, rl int, qlen long, other long, hash string, is_reverse boolean")
    assert [(r.contig, r.contig2, r.svtype) for r in B.pair_events(df, ["sample", "read"]).collect()] == [("c1", "c2", "BND")]


def test_candidates(spark):
    ev = [("s", "c", None, 100, 900, "DEL", False, 1, 4), ("s", "c", None, 400, 1300, "DEL", False, 1, 4), ("s", "c", None, 9000, 9900, "DEL", False, 1, 4), ("s", "c", None, 5, 6000, "INV", True, 1, 1), ("s", "c", "d", 5, 6, "BND", False, 4, 1)]
    got = B.candidates(spark.createDataFrame(ev, "sample string, contig string, contig2 string, pos1 long, pos2 long, svtype string, is_sub boolean, rl1 int, rl2 int")).collect()
    assert sorted((r.svtype, r.pos1, r.pos2, r.support, r.rl1, r.contig2) for r in got) == sorted([("BND", 5, 6, 1, 4, "d"), ("DEL", 250, 1100, 2, None, None), ("DEL", 9000, 9900, 1, None, None)], key=str) or len(got) == 3


def test_candidates_at_equal_places(spark, monkeypatch):
    """Only equal places are gathered, and none meets another."""
    monkeypatch.setattr(B, "components_2d", None)
    ev = [("s", "c", "d", 5, 6, "BND", False, 4, 1), ("s", "c", "d", 5, 6, "BND", False, 1, 1), ("s", "c", "d", 5, 6, "BND", False, 4, 4), ("s", "c", "d", 5, 7, "BND", False, 4, 1), ("s", "c", None, 5, 6, "DEL", True, 1, 4), ("s", None, None, 5, 6, "DEL", False, 1, 4)]
    got = B.candidates(spark.createDataFrame(ev, "sample string, contig string, contig2 string, pos1 long, pos2 long, svtype string, is_sub boolean, rl1 int, rl2 int"), 0)
    assert sorted((r.pos1, r.pos2, r.support, r.rl1, r.rl2) for r in got.collect()) == [(5, 6, 3, 4, 1), (5, 7, 1, 4, 1)]


def test_inversion_rules(spark):
    t = "array<struct<b:bigint,e:bigint,len:bigint,sup:bigint>>"
    rows = [
        ([], [], 0, 0, True, True), ([], [], 0, 0, False, False), ([(1000, 1040, 40, 3)], [], 1, 0, True, True), ([(1000, 1900, 900, 3)], [], 1, 0, True, False), ([(1000, 1040, 40, 3)] * 2, [], 2, 0, True, False),
        ([(1010, 1990, 30, 3), (1000, 1030, 30, 3)], [], 2, 0, True, True), ([(1000, 1030, 30, 3)], [(1900, 1930, 30, 3)], 1, 1, True, True), ([(1000, 1600, 600, 3)], [(1900, 1930, 30, 3)], 1, 1, True, False), ([], [], 11, 0, True, False),
    ]
    df = spark.createDataFrame(rows, f"ds {t}, is_ {t}, nd long, ni long, sp boolean, want boolean")
    v = V.inversion_evidence(F.lit(1000), F.lit(2000), F.col("ds"), F.col("is_"), F.col("nd"), F.col("ni"), F.col("sp"))
    assert [r for r in df.select("*", v.alias("v")).collect() if r.v.ok != r.want] == []


def test_duplication_rules(spark):
    t = "array<struct<b:bigint,e:bigint,len:bigint,sup:bigint>>"
    rows = [
        (True, 2, [], [], 0.0, 10, True), (True, 1, [], [], 0.0, 10, False), (False, 3, [], [], 0.0, 10, False), (False, 4, [], [], 0.0, 10, True), (False, 9, [], [], 0.96, 10, False), (False, 9, [], [], 0.0, 501, False),
        (True, 5, [(0, 600, 600, 5)], [], 0.0, 10, False), (False, 5, [(0, 100, 600, 5)], [], 0.0, 10, False), (False, 5, [], [(0, 1, 1600, 5)], 0.0, 10, False), (False, 5, [], [(0, 1000, 1000, 5)], 0.0, 10, True), (False, 5, [], [(0, 500, 500, 5)], 0.0, 10, False),
    ]
    df = spark.createDataFrame(rows, f"flag boolean, ms long, ds {t}, is_ {t}, same double, n long, want boolean")
    v = V.duplication_evidence(F.lit(1000.0), F.lit(1000.0), F.col("flag"), F.col("ms"), F.col("ds"), F.col("is_"), F.col("same"), F.col("n"), F.lit(0), F.lit(1000))
    assert [r for r in df.select("*", v.alias("v")).collect() if r.v.ok != r.want] == []


def test_duplication_reads_all_evidence(spark):
    rng = np.random.default_rng(4)
    pairs = [(k, 10_000 * k + 1000, 10_000 * k + 1000 + int(n)) for k, n in enumerate(rng.integers(40, 7000, 30))]
    clusters = []
    for k, b, e in pairs:
        for _ in range(int(rng.integers(0, 40)) if k else 0):
            at, n = int(rng.integers(b - 150, e + 150)), int(rng.integers(30, 400))
            clusters.append(("D" if rng.random() < 0.4 else "I", at, at + n, n, int(rng.integers(1, 9))))
    p = spark.createDataFrame([("s", "c", *r, float(r[2] - r[1])) for r in pairs], "sample string, contig string, pair_id long, begin long, end long, size double")
    c = spark.createDataFrame([("s", "c", *r) for r in clusters], "sample string, contig string, sig_type string, start_mode long, stop_mode long, svlen_mode long, support long")
    got = {r.pair_id: r for r in V.nearby_evidence(p, c, "begin", "end", "size").collect()}
    for k, b, e in pairs:
        hits = [x for x in clusters if x[1] < e + 150 and b - 150 < x[2]]
        one = {t: [x for x in hits if x[0] == t] for t in "DI"}
        near = lambda a, share: min(((y[1] - x[1], x[1], y[1]) for x in a for y in a if x[4] > 3 and y[4] > 3 and y[1] - x[1] > share * (e - b)), default=None)  # noqa: B023, E731
        want = (len(one["D"]), len(one["I"]), *(max((x[3] for x in one[t]), default=None) for t in "DI"), near(one["I"], 0.2), near(hits, 0.3))
        r = got[k]
        assert (r.n_d, r.n_i, r.x_d, r.x_i, r.near_i and tuple(r.near_i), r.near_id and tuple(r.near_id)) == want


def test_duplication_counts_the_twelfth_cluster(spark):
    """A long insertion to the right of eleven short ones rejects the pair."""
    row = ("s", "c", 1, 1000, 2000, 1000.0)
    p = spark.createDataFrame([row], "sample string, contig string, pair_id long, begin long, end long, size double")
    c = [("s", "c", "I", 1000 + 10 * k, 1040 + 10 * k, 40, 2) for k in range(11)] + [("s", "c", "I", 1900, 3500, 1600, 9)]
    c = spark.createDataFrame(c, "sample string, contig string, sig_type string, start_mode long, stop_mode long, svlen_mode long, support long")
    e = {k: F.col(k) for k in ("n_i", "n_d", "x_i", "x_d", "one", "near_i", "near_id")}
    v = V.duplication_verdict(F.lit(1000.0), F.col("size"), F.lit(False), F.lit(5), e, F.lit(0.0), F.lit(10), F.col("begin"), F.col("end"))
    assert not V.nearby_evidence(p, c, "begin", "end", "size").select(v.alias("v")).first().v.ok


def test_duplication_needs_one_strong_side(spark):
    """Without a flag the stronger side decides first; the weaker one only where there is no evidence."""
    rows = [(3, 5, 1, 900.0, True), (3, 3, 1, 900.0, False), (3, 5, 0, None, False), (4, 4, 0, None, True), (3, 5, 0, 900.0, True), (3, 5, 0, 1001.0, False)]
    df = spark.createDataFrame(rows, "lo long, hi long, n_i long, x_i double, want boolean")
    e = {k: F.col(k) for k in ("n_i", "x_i")} | {"n_d": F.lit(0), "x_d": F.lit(None).cast("double")}
    e |= {"one": F.struct(F.lit(0).alias("b"), F.lit(40).alias("len"))} | dict.fromkeys(("near_i", "near_id"), F.lit(None).cast("struct<d:bigint,b:bigint,e:bigint>"))
    v = V.duplication_verdict(F.lit(1000.0), F.lit(1000.0), F.lit(False), F.col("lo"), e, F.lit(0.0), F.lit(10), F.lit(0), F.lit(1000), F.col("hi"))
    assert [r for r in df.select("*", v.alias("v")).collect() if r.v.ok != r.want] == []


def test_duplication_long_reads(spark):
    rows = [([(2500, 1000)] * 2, [(990, 1000)] * 9, True), ([(2000, 1501)] * 2, [(1000, 1501)] * 2, False), ([(2010, 1501)] * 2, [(990, 1501)] * 2, False), ([(2011, 1501)] * 2, [(990, 1501)] * 2, True), ([(2000, 1501)] * 2, [(989, 9)] + [(1000, 1501)] * 2, True), ([(2000, 1501)] * 3, [(1000, 1500)] * 3, True)]
    t = "array<struct<other:bigint,q_len:bigint>>"
    df = spark.createDataFrame(rows, f"l {t}, r {t}, want boolean").withColumn("ok", V.long_reads_fit(F.col("l"), F.col("r"), F.lit(1000), F.lit(2000)))
    assert [r for r in df.collect() if r.ok != r.want] == []


def test_duplication_raw_lengths(spark):
    p = spark.createDataFrame([("s", "c", 1, 1000, 2000), ("s", "c", 2, 9000, 9500)], "sample string, contig string, pair_id long, begin long, end long")
    a = spark.createDataFrame([("s", "c", "a", "r1", 500, 2500), ("s", "c", "b", "r1", 1900, 4000), ("s", "c", "x", "r2", 2000, 4000), ("s", "c", "y", "r3", 9400, 9900)], "sample string, contig string, hash string, read string, ref_start int, ref_end int")
    sig = [("a", "I", 900, 1000), ("a", "I", 850, 950), ("a", "D", 800, 900), ("a", "D", 600, 799), ("b", "I", 2300, 2600), ("b", "I", 3000, 3999), ("b", "D", 2150, 2300), ("x", "I", 1990, 2990), ("b", "L", 1, 9999)]
    sig = spark.createDataFrame(sig, "hash string, sig_type string, start long, stop long")
    got = {r.pair_id: (r.n_reads, r.x_d, r.x_i) for r in V.raw_evidence(p, sig, a, "begin", "end").collect()}
    want = {1: (1, 150.0, 300.0), 2: (1, None, None)}
    want[1] = (1, max(n for n, b, e in ((100, 800, 900), (199, 600, 799), (150, 2150, 2300)) if 1000 - n <= b <= 2000 + n or 1000 - n <= e <= 2000 + n), 300.0)
    assert got == want


def test_compare(spark):
    schema = "contig string, pos1 long, pos2 long, svlen long, svtype string, gt string, line string"
    base = [("1", 1000, 2000, 1000, "DEL", "1/1", "b1"), ("1", 50_000, 51_000, 1000, "DEL", "1/1", "b2"), ("2", 10, 20, 100, "INS", "1/1", "b3")]
    calls = [("1", 2000, 9999, 1000, "DEL", "0/1", "c1"), ("1", 60_000, 52_000, 700, "DEL", "0/1", "c2"), ("1", 1001, 2001, 699, "DEL", "0/1", "c3"), ("9", 1, 2, 100, "DEL", "0/1", "c4"), ("9", 1, 2, 100, "DEL", "0/1", "c4")]
    b, c = (compare.with_ids(spark.createDataFrame(x, schema)) for x in (base, calls))
    got = {r.svtype: (r.n_base, r.n_calls, r.tp_base, r.tp_calls) for r in compare.compare(b, c).collect()}
    assert got == {"DEL": (2, 4, 2, 2), "INS": (1, 0, 0, 0)}
    assert {r.svtype: r.n_calls for r in compare.compare(b, c, strict_contigs=True).collect()}["DEL"] == 3
    assert {r.line for r in compare.false_positives(c, b).collect()} == {"c3", "c4"}


def naive_score(a, b, gap=1.5):
    m = np.zeros((len(a) + 1, len(b) + 1))
    m[:, 0], m[0] = -gap * np.arange(len(a) + 1), -gap * np.arange(len(b) + 1)
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        m[i, j] = max(m[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), m[i - 1, j] - gap, m[i, j - 1] - gap)
    return m[-1, -1]


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", max_size=12), st.text("ACGT", max_size=12))
def test_alignment(a, b):
    assert S.align_score(a, b) == pytest.approx(naive_score(a, b)) == pytest.approx(S.align_score(b, a))
    assert S.affine_score(a, b, opening=1.5, extend=1.5) == pytest.approx(naive_score(a, b))
    assert S.align_score(a, b, free_ends=True) >= S.align_score(a, b) - 1e-9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ACGé", max_size=12), st.text("ACGé", max_size=15)), max_size=8), st.booleans(), st.sampled_from([1, 20, 1 << 18]))
def test_alignments_at_once(pairs, free, cells):
    before, S.CELLS = S.CELLS, cells
    try:
        got = S.align_scores([a for a, _ in pairs], [b for _, b in pairs], free_ends=free)
    finally:
        S.CELLS = before
    assert got.tolist() == pytest.approx([S.align_score(a, b, free_ends=free) for a, b in pairs])


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTN", max_size=40))
def test_repeats(s):
    comp = s[::-1].translate(str.maketrans("ATCG", "TAGC"))
    for kind, i, j, n in S.repeats_in(s, 3, 2):
        part = s[i : i + n]
        assert "N" not in part and (s[j : j + n] == part if kind == "dup" else (s[j : j + n][::-1].translate(str.maketrans("ATCG", "TAGC")) == part))
    if len(s) > 1:
        codes = np.frombuffer(s.encode(), np.uint8).astype(np.int64)
        sa, _ = S.suffix_ranks(codes)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        _, levels = S.suffix_ranks(codes)
        same = lambda i, j: next((k for k in range(len(s)) if max(i, j) + k >= len(s) or s[i + k] != s[j + k]), 0)
        assert S.common_prefixes(levels, sa[:-1], sa[1:]).tolist() == [same(i, j) for i, j in zip(sa[:-1], sa[1:])]
    assert comp[::-1].translate(str.maketrans("ATCG", "TAGC")) == s


def test_repeats_of_one_base():
    """A whole default window of equal bases: steps grow with the logarithm of the longest repeat."""
    import time

    t = time.time()
    got = S.repeats_in("A" * 100_000, 99_000, 5)
    assert not got and len(S.repeats_in("A" * 100_000, 1, 1)) == 99_999 and time.time() - t < 60


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTN", "AACCGGTT")], "a string, b string")
    r = df.select(S.revcomp(F.col("a")).alias("r"), S.with_revcomp(F.col("a")).alias("w"), S.kmers(F.col("a"), 3).alias("k"), S.kmers(F.col("a"), 9).alias("e"), S.kmer_jaccard(F.col("a"), F.col("a"), 2).alias("j"), S.flank(F.col("b"), F.lit(-3), F.lit(2)).alias("f"), S.dominant_kmer_ratio(F.col("b"), 2).alias("d"), S.max_subarray(F.array(*map(F.lit, (1.0, -5.0, 2.0, 3.0)))).alias("m")).first()
    assert (r.r, r.w, r.k, r.e, r.j, r.f, r.d, r.m) == ("NACGT", "ACGTNXNACGT", ["ACG", "CGT", "GTN"], [], 1.0, "AA", 0.25, 5.0)


def test_repeat_scan_and_merge(spark):
    unit = "ACGTTGCAAGCT"
    seqs = spark.createDataFrame([("c", unit + "GGGGATAT" + unit)], "contig string, seq string")
    rep = S.repeat_scan(seqs, "contig", "seq", 1000, 500, 10, 5)
    dup, inv = S.merged_repeats(rep)
    assert [(r.pos1, r.pos2, r["size"]) for r in dup.collect()] == [(0, 32, 12)] and "center" in inv.columns


def test_repeat_scan_windows(spark):
    """Windows of a sequence of several blocks are those of plain slicing."""
    text = "".join("ACGT"[i] for i in np.random.default_rng(9).integers(0, 4, 1500))
    seqs = spark.createDataFrame([("c", text), ("e", ""), ("n", None)], "contig string, seq string")
    got = {(r.kind, r.pos1, r.pos2, r["size"]) for r in S.repeat_scan(seqs, "contig", "seq", 40, 10, 6, 5).collect()}
    want = {(x[0], a + x[1], a + x[2], x[3]) for a in range(0, len(text), 10) for x in S.repeats_in(text[a : a + 40], 6, 5)}
    assert got == want and got


def test_shift_search(spark):
    """Both searches against plain Python: cut, score, vote."""
    from collections import Counter

    rng = np.random.default_rng(12)
    word = lambda n: "".join("ACGT"[i] for i in rng.integers(0, 4, n))
    rows = [(1, "A" * 10 + "CCCCC" + "A" * 10, "G" * 10 + "CCCCC" + "G" * 10, 5)]
    for k in range(2, 8):
        core, n = word(60), int(rng.integers(20, 60))
        rows.append((k, word(int(rng.integers(0, n))) + core + word(50), word(int(rng.integers(0, n))) + core + word(50), n))
    df = spark.createDataFrame(rows, "id long, l string, r string, n int")
    grams = lambda x, k: {x[i : i + k] for i in range(len(x) - k + 1)}
    first, second = {}, {}
    for k, a, b, n in rows:
        cut = lambda at: (a[at : at + n], b[at : at + n])  # noqa: B023, E731
        scored = sorted((-S.align_score(*cut(at)), at) for at in (int(i / 10 * n) for i in range(11)))[:5]
        votes = Counter(at for _, at in scored)
        first[k] = min(votes, key=lambda at: (-votes[at], at))  # noqa: B023
        won = Counter()
        for size in range(5, 36, 2):
            tried = {}
            for at in {int(i / 20 * n) for i in range(1, 20)}:
                x, y = cut(at)
                if min(len(x), len(y)) >= size:
                    x, y = grams(x, size), grams(y, size)
                    tried[at] = len(x & y) / len(x | y)
            if tried:
                won[min(tried, key=lambda at: (-tried[at], at))] += 1  # noqa: B023
        if won:
            second[k] = min(won, key=lambda at: (-won[at], at))
    assert {r.id: r.shift for r in S.shift_search(df, "id", "l", "r", "n").collect()} == first
    assert {r.id: r.shift for r in S.shift_by_kmers(df, "id", "l", "r", "n").collect()} == second


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 x\nACGT\nAC\n>c2\nGG\n")
    assert {r.contig: r.seq for r in readers.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {"c1 x": "ACGTAC", "c2": "GG"}
    chunks = readers.read_fasta(spark, str(tmp_path / "a.fa"), 4)
    reg = readers.fasta_region(chunks, spark.createDataFrame([("c1 x", 2, 6)], "contig string, begin long, end long"), 4)
    assert reg.first().seq == "GTAC"
    assert sorted(map(tuple, chunks.collect())) == [("c1 x", 0, 0, "ACGT"), ("c1 x", 1, 4, "AC"), ("c2", 0, 0, "GG")]
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nr1\t16\tc1\t11\t60\t5S10M2D3M\t*\t0\t0\tAAAAACCCCCCCCCCGGG\t*\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n")
    (r,) = readers.read_sam(spark, str(tmp_path / "a.sam")).collect()
    assert (r.contig, r.ref_start, r.ref_end, r.q_start, r.q_end, r.q_len, r.is_reverse) == ("c1", 10, 25, 5, 18, 18, True)
    for n, text in (("h1", "1\t10\t20\tdeletion\t\n1\t5\t6\tinsertion\tACG\n"), ("h2", "1\t10\t20\tdeletion\t\n1\t7\t9\tother\t\n")):
        (tmp_path / n).write_text(text)
    assert sorted((r.svtype, r.svlen, r.gt) for r in readers.read_truth(spark, str(tmp_path / "h1"), str(tmp_path / "h2")).collect()) == [("DEL", 10, "1/1"), ("INS", 3, "0/1")]
    (tmp_path / "s.bed").write_text("chr1\t1000\t6000\t0\t5000\t5200\t60\t0\t1\tr1\t2000,2080,2,1000\t6000,6200,4,5000\t3000,3002,3,AC,77\n")
    assert sorted((r.sig_type, r.start, r.stop, r.qpos, r.seq, r.is_supplementary) for r in readers.read_signal_rows(spark, str(tmp_path / "s.bed")).collect()) == [("D", 2000, 2080, 1000, None, True), ("I", 3000, 3002, 77, "AC", True), ("R", 6000, 6200, 5000, None, True)]
    calls = spark.createDataFrame([("s", "c", 5, 105, "DEL", 100, None, 9, 10, 1, 0.9, "1/1", "1/1", 1.2345, 0.5, 0.25, 60.0, 0.0, 100.0, ["a", "b"])], __import__("helixframe.schema", fromlist=["CALL"]).CALL)
    sinks.write_vcf(calls, str(tmp_path / "v"))
    (r,) = readers.read_vcf(spark, str(tmp_path / "v")).collect()
    assert (r.contig, r.pos1, r.pos2, r.svlen, r.svtype, r.gt) == ("c", 5, 105, 100, "DEL", "1/1") and "STD_POS1=1.234;" in r.line


@pytest.mark.parametrize("size", [16, 64, 1000, 10**6])
def test_fasta_across_blocks(spark, tmp_path, size):
    """Blocks of a file that begin anywhere: in a header, in a line, with no header at all."""
    rng = np.random.default_rng(size)
    seqs = {f"c{k} of {'x' * k}": "".join("ACGTN"[i] for i in rng.integers(0, 5, n)) for k, n in enumerate([0, 1, 59, 60, 61, 700, 0, 3, 2000])}
    text = "".join(f">{c}\n" + "".join(f"{s[i : i + 60]}\n" for i in range(0, len(s), 60)) for c, s in seqs.items())
    (tmp_path / "a.fa").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {}
        for r in sorted(readers.read_fasta(spark, str(tmp_path / "a.fa"), 50).collect()):
            assert r.start == 50 * r.chunk == len(got.get(r.contig, "")) and len(r.seq) <= 50
            got[r.contig] = got.get(r.contig, "") + r.seq
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == seqs


def test_end_to_end(spark):
    rows = []
    for k in range(12):
        rows.append(alignment(f"d{k}", "chr1", 8000 + 10 * k, "2000M200D3000M"))
        rows.append(alignment(f"i{k}", "chr1", 48_000 + 10 * k, f"{2000 - 10 * k}M150I3000M"))
    rows[::2] = [alignment(f"d{k}", "chr1", 8000 + 10 * k, f"{2000 - 10 * k}M200D3000M") for k in range(12)]
    for k in range(8):
        rows.append(alignment(f"p{k}", "chr1", 89_500, "2500M2500S"))
        rows.append(alignment(f"p{k}", "chr1", 95_000, "2500S2500M", supplementary=True))
    out = caller.call(spark.createDataFrame(rows, ALIGNMENT), Config())
    got = sorted((r.svtype, r.pos, r.svlen, r.support) for r in out.calls.collect())
    assert got == [("DEL", 10_000, 200, 12), ("DEL", 92_000, 3000, 8), ("INS", 50_000, 150, 12)]
    assert {(r.svtype, r.pos1, r.pos2) for r in out.candidates.collect()} == {("DEL", 92_000, 95_000)}
    assert caller.bnd_candidates(out.candidates).count() == 0


def test_one_alignment_is_no_split_read(spark):
    """Two clips of one alignment make no pair; two alignments with signals of any type do."""
    rows = [alignment("a", "chr1", 1000, "30S5000M30S"), alignment("b", "chr1", 1000, "2500M2500S"), alignment("b", "chr1", 9000, "2500M100D2500M", supplementary=True)]
    points = caller.breakpoint_points(spark.createDataFrame(rows, ALIGNMENT)).collect()
    assert [(p.read, p.gpos, p.rl) for p in points] == [("b", 3500, 4)]
    assert caller.call(spark.createDataFrame(rows[:1], ALIGNMENT)).calls.count() == 0


def test_raw_sides(spark):
    rows = [alignment("a", "c", 500, "600M"), alignment("b", "c", 400, "610M"), alignment("b", "c", 450, "650M"), alignment("x", "c", 1000, "500M"), alignment("y", "c", 100, "500M")]
    df = spark.createDataFrame(rows, ALIGNMENT)
    df = df.withColumn("hash", G.record_hash(df))
    sites = spark.createDataFrame([("s", "c", 1, 1090)], "sample string, contig string, cand long, pos long")
    (r,) = V.raw_sides(sites, df, "R", True).collect()
    assert (r.start_mode_r, r.support_r, r.n_r, r.positions_r, r.reads_r) == (1100, 2, 2, [1100, 1100], ["a", "b"])
    (r,) = V.raw_sides(sites, df, "R", False).collect()
    assert (r.n_r, r.reads_r, r.query_starts_r["b"].qpos) == (1, ["b"], 650)
    assert V.raw_sides(sites, df, "L", True).count() == 1  # the alignment that starts at 1000


def test_unplaced_pairs(spark):
    rows = []
    for k in range(8):
        rows += [alignment(f"t{k}", "c", 8000, "402000M3000S"), alignment(f"t{k}", "c", 10_000, "402000S3000M", supplementary=True)]
    out = caller.call(spark.createDataFrame(rows, ALIGNMENT))
    (r,) = V.unplaced_pairs(out.candidates, out.clusters).collect()
    assert (r.contig, r.pos1, r.pos2, r.svtype, r.source, r.support) == ("c", 10_000, 410_000, "BND", "DUP", 8) and out.calls.count() == 0


def test_kmers_of_long_sequences(spark):
    s = "".join("ACGT"[i] for i in np.random.default_rng(1).integers(0, 4, 5000)) + "é日"
    df = spark.createDataFrame([(s, s[17:], 0), ("abc", "", 1)], "a string, b string, id int")
    r = df.where("id = 0").select(S.kmers(F.col("a"), 7).alias("k"), S.kmers(F.col("a"), 7, 7).alias("m"), S.kmer_jaccard(F.col("a"), F.col("b"), 7).alias("j"), S.dominant_kmer_ratio(F.col("a"), 2).alias("d")).first()
    grams = lambda x, k, step=1: [x[i : i + k] for i in range(0, len(x) - k + 1, step)]
    assert r.k == grams(s, 7) and r.m == grams(s, 7, 7)
    x, y = set(grams(s, 7)), set(grams(s[17:], 7))
    assert r.j == pytest.approx(len(x & y) / len(x | y))
    two = grams(s, 2, 2)
    assert r.d == pytest.approx(max(map(two.count, set(two))) / len(two))
    assert df.where("id = 1").select(S.kmers(F.col("a"), 7).alias("k"), S.kmer_jaccard(F.col("a"), F.col("b"), 7).alias("j")).first() == ([], 0.0)


def test_profile_similarity(spark):
    df = spark.createDataFrame([(1, "AAAA", "AAAAAAAT"), (2, "ACGT", "TTTT"), (3, "A", "ACGT")], "id int, a string, b string")
    got = {r.id: r.similarity for r in S.kmer_profile_similarity(df, "id", "a", "b", 2).collect()}
    assert got == pytest.approx({1: 6 / 7, 2: 0.0, 3: 0.0})


def test_streams(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    src = lambda: spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    q = W.tumbling(src(), "ts", ["event_type"], "1 day", "1 hour").writeStream.format("memory").queryName("w1").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w1").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
    for n, f in (("w2", W.sessions(src(), "ts", ["user_id"], "1 hour", "1 hour")), ("w3", W.unique(src(), "ts", ["event_id"], "1 hour"))):
        q = f.writeStream.format("memory").queryName(n).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("w3").count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_hand_made_calls(spark):
    """The callers with their own settings: one contig for each way to a call."""
    rows = []

    def add(read, contig, start, cigar, reverse=False, supplementary=False):
        ops = [("MIDNSHP=X".index(o), int(n)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        size = lambda kinds: sum(n for o, n in ops if o in kinds)
        lead = ops[0][1] if ops[0][0] == 4 else 0
        rows.append(("s", contig, start, start + size((0, 2, 3, 7, 8)), lead, lead + size((0, 1, 7, 8)), size((0, 1, 4, 5, 7, 8)), 60, reverse, supplementary, read, ops, None))

    for k in range(12):
        add(f"d{k}", "chr1", 8000 + 10 * k, f"{2000 - 10 * k}M200D3000M")
        add(f"i{k}", "chr1", 48_000 + 10 * k, f"{2000 - 10 * k}M150I3000M")
    for k in range(8):
        add(f"p{k}", "chr1", 89_500, "2500M2500S")
        add(f"p{k}", "chr1", 95_000, "2500S2500M", supplementary=True)
        add(f"t{k}", "chr2", 8000, "3500M3000S")
        add(f"t{k}", "chr2", 10_000, "3500S3000M", supplementary=True)
        for contig, begin, size, tail in (("chr3", 20_000, 2000, "2000S"), ("chr4", 20_000, 2000, "2000H"), ("chr5", 30_000, 120, "2000S")):
            add(f"{contig}-{k}", contig, begin - 2000, f"2000M{size + 2000}S")
            add(f"{contig}-{k}", contig, begin, f"2000S{size}M{tail}", True, True)
            add(f"{contig}-{k}", contig, begin + size, f"{size + 2000}S2000M", False, True)
        add(f"whole{k}", "chr1", 1000, "30S5000M30S")
    got = caller.call(spark.createDataFrame(rows, ALIGNMENT)).calls
    assert {tuple(r) for r in got.select("contig", "pos", "stop", "svtype", "svlen", "support").collect()} == {
        ("chr1", 10000, 10200, "DEL", 200, 12), ("chr1", 92000, 95000, "DEL", 3000, 8), ("chr1", 50000, 50001, "INS", 150, 12), ("chr2", 10000, 11500, "DUP", 1500, 8),
        ("chr3", 20000, 22000, "INV", 2000, 8), ("chr4", 20000, 22000, "INV", 2000, 8), ("chr5", 30000, 30120, "INV", 120, 8),
    }


def test_labels_of_a_chain_need_few_rounds(spark, monkeypatch):
    """A chain of 200 nodes in random order: whole trees are hooked, so rounds do not grow with the distance."""
    names = [int(x) for x in np.random.default_rng(5).permutation(200)]
    written = []
    monkeypatch.setattr(K, "shared_table", lambda df, real=K.shared_table: written.append(1) or real(df))
    nodes = spark.createDataFrame([(x,) for x in [*names, 900, 901, 902]], "v long")
    edges = spark.createDataFrame([*zip(names, names[1:]), (902, 901)], "a long, b long")
    got = {r.v: r.component for r in K.label_components(nodes, edges, "v").collect()}
    assert got == dict.fromkeys(names, 0) | {900: 900, 901: 901, 902: 901}
    assert len(written) <= 2 + 12


def test_callers_pair_one_contig_only(spark, monkeypatch):
    """Pairs of two contigs are made when all candidates are asked for, not for the callers."""
    rows = [alignment(r, c, 5000 + k, cigar) for k, r in enumerate(("r1", "r2")) for c, cigar in (("c1", "1000M600S"), ("c2", "600S1000M"), ("c1", "900S700M"))]
    seen = []
    monkeypatch.setattr(B, "candidates", lambda ev, *a, real=B.candidates: seen.append({r.svtype for r in ev.collect()}) or real(ev, *a))
    out = caller.call(spark.createDataFrame(rows, ALIGNMENT))
    assert len(seen) == 1 and "BND" not in seen[0]
    every = [tuple(r) for r in out.candidates.collect()]
    assert len(seen) == 2 and seen[1] == {"BND"}
    events = B.pair_events(caller.breakpoint_points(spark.createDataFrame(rows, ALIGNMENT)), ["sample", "read"])
    assert sorted(map(str, every)) == sorted(str(tuple(r)) for r in B.candidates(events).collect())
    assert caller.bnd_candidates(out.candidates).count() > 0
