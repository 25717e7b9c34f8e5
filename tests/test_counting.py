"""Overlaps, depth and dominance by counting against plain loops, with borders of bins, piles and chunks."""

import numpy as np
import pytest

from helixframe.operators import dominance as D
from helixframe.operators import intervals as I


def some(rng, n, spread=200_000):
    sizes = [0, 1, 30, 64, 900, 65_536, 65_537, 500_000, 5_000_000]
    rows = [(k, int(rng.integers(0, 2)), int(b := rng.integers(-70_000, spread)), int(b + rng.choice(sizes))) for k in range(n)]
    return rows + [(n, None, 5, 9), (n + 1, 0, None, 9), (n + 2, 1, 5, None)]


def test_overlap_counts(spark):
    rng = np.random.default_rng(1)
    a, b = some(rng, 250), some(rng, 250)
    b += [(900 + k, 0, 65_536, 65_600) for k in range(300)] + [(2000 + k, 1, 131_071, 131_072) for k in range(50)]
    left, right = spark.createDataFrame(a, "p long, kind int, b long, e long"), spark.createDataFrame(b, "j long, kind int, ob long, oe long")
    got = {r.p: r.n for r in I.overlap_counts(left, right, ["kind"], "p", "b", "e", "ob", "oe").collect()}
    full = lambda x: None not in x
    want = {x[0]: sum(full(x) and full(y) and x[1] == y[1] and x[2] < max(y[3], y[2] + 1) and y[2] < max(x[3], x[2] + 1) for y in b) for x in a}
    assert got == want
    none = {x for x, n in want.items() if not n}
    assert {r.p for r in I.anti_overlap(left, right, ["kind"], "p", "b", "e", "ob", "oe").collect()} == none
    assert {r.p for r in I.semi_overlap(left, right, ["kind"], "p", "b", "e", "ob", "oe").collect()} == set(want) - none
    assert I.overlap_counts(left, right.limit(0), ["kind"], "p", "b", "e", "ob", "oe").where("n <> 0").count() == 0
    assert I.overlap_counts(left.limit(0), right, ["kind"], "p", "b", "e", "ob", "oe").count() == 0


def brute_depth(clusters, alignments, pad):
    out = {}
    for i, c, s, e in clusters:
        ids = {a for a, k, b, z in alignments if None not in (c, s, e, k, b, z) and k == c and any(b <= p < max(z, b + 1) for p in (s - pad, e + pad))}
        out[i] = len(ids) or 7
    return out


@pytest.mark.parametrize("chunk", [1 << 18, 50, 7])
def test_depth(spark, monkeypatch, chunk):
    monkeypatch.setattr(I, "DEPTH_CHUNK", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    rng = np.random.default_rng(2)
    clusters, reads = some(rng, 120), some(rng, 400)
    reads += [(3000 + k, 0, 65_500, 65_700) for k in range(90)] + [(3000 + k, 0, 65_500, 65_700) for k in range(40)]  # repeated rows count once
    clusters += [(500, 0, 65_536, 65_540), (501, 0, 65_535, 200_000), (502, 1, 10, 10)]
    make = lambda rows, names: spark.createDataFrame(rows, names)
    c = make([(*x, 7) for x in clusters], "level long, x int, start long, stop long, y long")
    try:
        for pad in (0, 100):
            got = I.stab_depth(c, make(reads, "bin long, x int, b long, e long"), ["x"], "level", "start", "stop", "bin", "b", "e", pad, "y")
            assert {r.level: r.depth for r in got.collect()} == brute_depth(clusters, reads, pad)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def brute_dominant(rows, near):
    full = [r for r in rows if None not in r]
    better = lambda a, b: (b[4], -b[0]) > (a[4], -a[0])
    lost = {a[0] for a in full for b in full if a[1] == b[1] and (abs(a[2] - b[2]) < near or abs(a[3] - b[3]) < near) and better(a, b)}
    return sorted((r for r in rows if None in r or r[0] not in lost), key=str)


@pytest.mark.parametrize("near", [1, 3, 100])
def test_dominance(spark, near):
    rng = np.random.default_rng(near)
    rows = []
    for k in range(400):
        b = int(rng.choice([rng.integers(0, 3000), rng.integers(65_500, 65_570), rng.integers(-200, 200)]))
        rows.append((k - 200, int(rng.integers(0, 2)), b, b + int(rng.integers(0, 400)), int(rng.integers(0, 12))))
    rows += [(1000 + k, 0, 50_000, 60_000 + 7 * k, 5) for k in range(200)] + [(2000 + k, 1, 40_000 + 7 * k, 65_536, 5) for k in range(200)]  # piles
    rows += [(5000, None, 1, 2, 3), (5001, 0, None, 2, 3), (5002, 0, 1, None, 3), (5003, 0, 1, 2, None)]
    df = spark.createDataFrame(rows, "rank long, best int, top long, pos long, bin long")
    kept = D.keep_dominant(df, ["best"], "rank", "top", "pos", "bin", near)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == brute_dominant(rows, near)
    lost = {r.rank for r in D.dominated(df, ["best"], "rank", "top", "pos", "bin", near).collect()}
    assert lost == {r[0] for r in rows} - {r[0] for r in brute_dominant(rows, near)}
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()


def test_dominance_keeps_maps_and_chains(spark):
    rows = [(1, "a", 0, 10, 10, {"x": 1}), (2, "a", 5, 30, 25, {"x": 2}), (3, "a", 28, 90, 62, None)]
    df = spark.createDataFrame(rows, "id long, c string, b long, e long, n long, m map<string,int>")
    kept = D.keep_dominant(df, ["c"], "id", "b", "e", "n", 10)
    assert sorted((r.id, str(r.m)) for r in kept.collect()) == [(2, "{'x': 2}"), (3, "None")]
