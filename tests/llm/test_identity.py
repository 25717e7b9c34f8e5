"""Texts that are made to collide under polynomials modulo a power of two, and very long words."""

import brute
import numpy as np
import pytest

from helixframe.llm import common, parity_join, runlength_dedup, spotsigs

P = (1 << 61) - 1


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") & 1 else a for k in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("base", [common.FIXED_BASE, 3, (1 << 61) - 5])
def test_span_hashes(base, monkeypatch):
    monkeypatch.setattr(common, "_BLOCK", 100)
    monkeypatch.setattr(common, "_SPAN", 60)
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 900).astype(np.uint8)
    start = np.sort(rng.integers(0, 900, 300))
    end = np.minimum(900, start + rng.integers(0, 61, 300))
    want = [sum((int(x) + 1) * pow(base, k, P) for k, x in enumerate(data[a:b])) % P for a, b in zip(start, end)]
    assert common.span_hashes(data, start, end, base).tolist() == want
    long = common.span_hashes(np.concatenate([data[:80], data[:80], data[80:160]]), np.array([0, 80, 160]), np.array([80, 160, 240]), base)
    assert long[0] == long[1] != long[2]


def test_complements_differ():
    for n in (1 << 10, 1 << 14, 1 << 19):
        data = np.frombuffer((thue_morse(n) + thue_morse(n, "b", "a")).encode(), np.uint8)
        for base in (common.FIXED_BASE, common.random_base()):
            a, b = common.span_hashes(data, np.array([0, n]), np.array([n, 2 * n]), base)
            assert a != b


def test_joins_of_complements(spark):
    n = 1 << 10
    x, y = thue_morse(n), thue_morse(n, "b", "a")
    rows = [(1, x), (2, y), (3, x), (4, " ".join([x, y] * 4)), (5, " ".join([y, x] * 4)), (6, "w" * 300_000), (7, "w" * 300_001), (8, "w" * 300_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.jaccard_components(docs_of(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (2, 4), 5: (2, 4), 6: (1, 6), 7: (1, 7), 8: (1, 6)}
    near = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(docs_of(spark, rows)).collect()}
    assert near[1] == near[3] != near[2] and near[6] == near[8] != near[7]


def test_dedup_of_complements(spark):
    """Two documents of the same blocks in other orders; a polynomial modulo 2^64 takes their halves for one another."""
    rng = np.random.default_rng(8)
    one, two = ("".join(map(chr, rng.integers(97, 123, 40))) for _ in range(2))
    n = 1 << 8
    rows = [(1, thue_morse(n, one, two)), (2, thue_morse(n, two, one)), (3, thue_morse(1 << 12)), (4, thue_morse(1 << 12, "b", "a"))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in runlength_dedup.dedup_digests(docs_of(spark, rows)).collect()}
    assert got == brute.dedup(rows)
