"""Hard negatives, source mixing and word runs against brute force, and their edge cases."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import hard_negatives, queries, source_mixing, word_runs

# ---------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, score int, aid long, x string"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, 2, "y") for i, v, l in rows], VECTORS)


def brute_negatives(rows, anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    best = {}
    for i, v, l in rows:
        if i is None or l is None or v is None or any(e is None or not math.isfinite(e) for e in v):
            continue
        ints = [math.floor(scale * float(np.float32(e))) for e in v]
        best[i] = min(best.get(i, (str(l), ints)), (str(l), ints)) if i in best else (str(l), ints)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for a in sorted(i for i in best if anchor(i)):
        scored = sorted((-dot(best[a][1], v), i, l) for i, (l, v) in best.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == best[a][0]][:positives]:
            fits = [x for x in scored if x[2] != best[a][0] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, anchor="vec_id % 10 = 0"):
    return sorted(tuple(r) for r in hard_negatives.mine(vector_frame(spark, rows), F.expr(anchor)).collect())


def some_vectors(n, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(5, dim))
    rows = []
    for i in range(n):
        v = heads[rng.integers(5)] + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.6])
        rows.append((i, [float(np.float32(e)) for e in v * rng.choice([0.3, 1.0])], int(rng.integers(4))))
    return rows


@pytest.mark.parametrize("piece, cells, chunk", [(4096, 256, 4096), (60, 6, 2), (16, 40, 3)])
def test_negatives(spark, monkeypatch, piece, cells, chunk):
    for name, value in (("PIECE", piece), ("CELLS", cells), ("CHUNK", chunk)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = some_vectors(400)
    rows += [(1000 + i, rows[0][1], 0) for i in range(60)] + [(2000 + i, rows[0][1], 1) for i in range(30)]  # equal vectors, ties
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_an_anchor_goes_to_a_cell_once(spark, monkeypatch):
    """questions and finds grow with the cells, not with the pieces that lie in them."""
    rows = some_vectors(400)
    counts = {}

    def counted(df, label, real=hard_negatives.materialize):
        out = real(df, label)
        counts.setdefault(label, []).append(out.count())
        return out

    for name, value in (("PIECE", 16), ("LEAF", 8), ("CELLS", 2), ("GROUP", 1000), ("materialize", counted)):
        monkeypatch.setattr(hard_negatives, name, value)
    got = mined(spark, rows)
    assert got == brute_negatives(rows, lambda i: i % 10 == 0)
    anchors = counts["mine-anchors"][0]
    assert counts["mine-trees"][0] > 20 and max(counts["mine-asked"]) <= anchors
    assert max(counts["mine-found"]) <= anchors * hard_negatives.POSITIVES * hard_negatives.NEGATIVES


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 0), (0, [1.0, 0.5], 0), (10, None, 0), (20, [1.0, None], 0), (30, [nan, 1.0], 1), (40, [inf, 0.0], 1), (50, [1.0, 0.0], None), (None, [1.0, 0.0], 0),
        (60, [], 0), (70, [0.0, 0.0], 1), (80, [-1.0, 0.25], 0), (90, [0.5], 0), (1, [1.0, 0.5], 0), (2, [0.7, 0.1], 1), (3, [0.7, 0.1], 1), (4, [0.9, 0.4], 0), (5, [0.3, 0.3], 2), (5, [0.2, 0.3], 2),
    ]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 0)]) == []
    far = [(0, [3e38, 1.0], 0), (1, [3e38, 0.0], 0), (2, [2e5, 1.0], 1)]
    assert {r[:4] for r in mined(spark, far)} == {(0, 1, 1, 2)}  # held at the limit


def test_tree_search_is_exact():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(1500, 12))).astype(np.int32)
    labels = [str(k) for k in rng.integers(0, 6, len(x))]
    piece = hard_negatives.Piece(x, labels, [[i] for i in range(len(x))], int((x.astype(np.int64) ** 2).sum(1).max()))
    piece.ready()
    assert len(piece.node) > 15
    for a in range(0, 1500, 37):
        s = x.astype(np.int64) @ x[a].astype(np.int64)
        for lo, hi in ((-(1 << 60), 1 << 60), (0, int(s.max()) // 2), (int(s.max()) // 3, int(s.max()) // 2)):
            for same in (True, False):
                want = sorted((-int(s[i]), i) for i in range(len(x)) if i != a and (labels[i] == labels[a]) == same and lo <= s[i] <= hi)[:7]
                got = piece.search(x[a].astype(float), a, labels[a], same, [(3, lo, hi)], 7)
                assert [(-v, i) for _, vs, ids in got for v, i in zip(vs.tolist(), ids.tolist())] == want


def test_negatives_against_sql(spark, sf):
    got = sorted(tuple(r) for r in queries.op11_hard_negatives(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert got and got == sorted(con.execute(hard_negatives.ORACLE_SQL).fetchall())


# ---------------------------------------------------------------- mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, taken int, h int, weight int"


def doc_frame(spark, rows):
    return spark.createDataFrame([(d, t, None, s, 0, "a", 1, 2, 3) for d, t, s in rows], DOCS)


def filled(sizes, weights, epochs):
    """Water-filling step by step, on exact fractions."""
    from fractions import Fraction

    held, target = set(), {}
    while True:
        left = sum(sizes.values()) - sum(epochs * sizes[s] for s in held)
        share = sum(weights[s] for s in sizes if s not in held)
        target = {s: Fraction(epochs * sizes[s]) if s in held else Fraction(left * weights[s], share) for s in sizes}
        over = {s for s in sizes if s not in held and target[s] > epochs * sizes[s]}
        if not over:
            return target
        held |= over


def brute_mix(rows, seed=source_mixing.SEED):
    sized = [(d, len((t or "").encode().split()), s) for d, t, s in rows]
    names = sorted({s for *_, s in sized if s is not None}, key=str.encode) + ([None] if any(s is None for *_, s in sized) else [])
    sizes = {s: sum(n for _, n, o in sized if o == s) for s in names}
    target = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 3) if names else {}
    out = []
    for s in names:
        goal = math.floor(target[s] + 0.5 if target[s].denominator == 2 else round(target[s]))
        whole = goal // sizes[s] if sizes[s] else 0
        budget = goal - whole * sizes[s]
        groups = {}
        for d, n, o in sized:
            if o == s:
                groups.setdefault((hashlib.md5(f"{seed}:{'' if d is None else d}:{n}".encode()).hexdigest(), d, n), []).append(d)
        for (_, d, n), g in sorted(groups.items(), key=lambda x: (x[0][0], x[0][1] or -1)):
            part = max(0, min(n, budget // len(g)))
            budget = max(0, budget - n * len(g))
            out += [(d, n, sizes[s], float(target[s]), whole * n + part)] * len(g)
    return sorted(out, key=repr)


def mixed(spark, rows):
    return sorted((tuple(r) for r in source_mixing.mix(doc_frame(spark, rows)).collect()), key=repr)


def near(a, b):
    return len(a) == len(b) and all(x[:3] == y[:3] and math.isclose(x[3], y[3], rel_tol=1e-12) and x[4] == y[4] for x, y in zip(a, b))


@pytest.mark.parametrize("digits", [3, 1])
def test_mix(spark, monkeypatch, digits):
    monkeypatch.setattr(source_mixing, "DIGITS", digits)  # with one digit the last bucket holds many rows
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(0, 1) + str(k) for k in range(rng.randint(0, 40))), rng.choice(["a", "a", "a", "b", "é", "z", None])) for i in range(1500)]
    rows += [(5000 + i, "x y z " * 30, "rare") for i in range(3)] + [(6000, None, "void"), (6001, " \t ", "void")]
    got = mixed(spark, rows)
    assert near(got, brute_mix(rows))
    by = {}
    for (_, n, size, target, taken) in got:
        assert taken <= 3 * n
        t = by.setdefault((size, target), [0])
        t[0] += taken
    assert all(abs(t[0] - target) <= 0.5 for (_, target), t in by.items())


def test_mix_edges(spark):
    assert mixed(spark, []) == []
    for rows in (
        [(1, None, None)], [(1, "", "a"), (2, None, "b")], [(1, "a b c", None)], [(1, "a b", "s"), (2, "c", "s"), (3, "d e f", "t")],
        [(None, "a b c", "s"), (None, "a b c", "s"), (None, "d", "t"), (4, "e f " * 40, "u")],
        [(7, "a b c", "s")] * 40 + [(8, "d e", "t"), (9, "f " * 3000, "u"), (10, "A B", "S"), (11, "tail ", "s ")],
    ):
        assert near(mixed(spark, rows), brute_mix(rows)), rows


def test_repetitions(spark):
    rows = [(i, f" a{i}  b{i}\tc{i} d{i}\n", s) for i, s in enumerate("ppppppppqr")]
    docs = doc_frame(spark, rows)
    plan = source_mixing.mix(docs)
    taken = {r.doc_id: r.taken for r in plan.collect()}
    out = source_mixing.repetitions(docs, plan)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert rows[r.doc_id][1].startswith(r.text)
    assert words == {d: n for d, n in taken.items() if n}


# ---------------------------------------------------------------- runs of words


def brute_runs(w, least=6, exponent=4):
    n, out = len(w), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((i, n, q) for (i, n), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40).map(lambda x: x + x[-5:] * 4 + x[:3]), min_size=1, max_size=4), st.sampled_from([(6, 4), (2, 2), (5, 3)]))
def test_runs(docs, rule):
    ends = np.cumsum([len(d) for d in docs])
    assert word_runs.enumerate_runs(np.array([w for d in docs for w in d], np.int64), ends, *rule) == [brute_runs(d, *rule) for d in docs]


def expected(doc_id, text, planted):
    import zlib

    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), digest(kept))


@pytest.mark.parametrize("planted", [True, False])
def test_runs_of_documents(spark, sf, planted):
    real = [(r[0], " ".join((r[1] or "").split()[:300])) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    edge = [
        (1000 + k, t) for k, t in enumerate([None, "", " \n\t ", "one", "a " * 5, "a " * 6, "a b " * 3, "a b a b a b a b", "é　é é é é é é", "x y " * 9, "a " * 4000, "a b c " * 900 + "d", "z" * 30_000, "\0 \0 \0 \0 \0 \0", "A a A a A a A a A"])
    ] + [(None, "q q q q q q q"), (1005, "k k k k k k k l"), (1005, "k k k k k k k l")]
    rows = real + edge
    frame = spark.createDataFrame([(d, t, "r", 1, "c") for d, t in rows], "doc_id long, text string, runs string, start int, collapsed string")
    got = word_runs.detect(frame, planted=planted)
    assert sorted((tuple(r)[:8] for r in got.collect()), key=repr) == sorted((expected(d, t, planted) for d, t in rows), key=repr)
    assert got.where("n_runs > 0").count() > 5


def test_runs_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert word_runs.detect(empty).count() == 0


def test_runs_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(word_runs, "CHUNK_WORDS", 20)
    rows = [(k, "a b " * (k % 9) + "c") for k in range(60)]
    got = word_runs.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r)[:8] for r in got.collect()) == sorted(expected(d, t, False) for d, t in rows)
