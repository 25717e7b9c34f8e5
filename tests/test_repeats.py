"""Repeats of whole contigs against the suffix array of each."""

import numpy as np
import pytest

from helixframe.functions import sequence
from helixframe.functions.sequence import repeats_in
from helixframe.operators import repeats


def contigs(seed):
    rng = np.random.default_rng(seed)
    base = lambda n: "".join("ACGT"[i] for i in rng.integers(0, 4, n))
    unit = base(90)
    turned = unit[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return {
        "far": unit + base(500) + unit + base(80) + turned, "odd": base(20) + "NNRN" + base(30) + "N" + unit + "n" + unit[:40], "same": "A" * 70, "pair": "ACACACACACACACAC",
        "one": "G", "none": "NNNN", "short": base(7), "low": (base(25) * 2).lower(), "end": base(40) + "N", "two": unit,
    }


@pytest.mark.parametrize("min_size, piece", [(1, 1 << 14), (12, 64), (30, 33)])
def test_whole_contigs(spark, monkeypatch, min_size, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    seqs = contigs(min_size)
    rows = [*seqs.items(), ("null", None), ("empty", "")]
    got = repeats.contig_repeats(spark.createDataFrame(rows, "contig string, seq string"), min_size, 5)
    want = {(c, *r) for c, s in seqs.items() for r in repeats_in(s, min_size, 5)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) and len({c for c, *_ in want}) > 1


def test_pieces(spark):
    s = contigs(5)["far"]
    rows = [("far", i, s[i : i + 50]) for i in range(0, len(s), 50)]
    got = repeats.contig_repeats(spark.createDataFrame(rows, "contig string, start long, seq string"), 20, 1)
    assert {tuple(r)[1:] for r in got.collect()} == set(repeats_in(s, 20, 1))
    assert repeats.contig_repeats(spark.createDataFrame([], "contig string, seq string"), 3).count() == 0


@pytest.mark.parametrize("min_size, small", [(1, 0), (12, 60), (30, 0), (30, 1 << 18)])
def test_small_and_large_contigs(spark, monkeypatch, min_size, small):
    """Contigs of any size have the same repeats, by rounds or in one task."""
    monkeypatch.setattr(repeats, "SMALL", small)
    rounds = []
    monkeypatch.setattr(repeats, "_of_large", lambda *a, f=repeats._of_large: rounds.append(1) or f(*a))
    seqs = contigs(min_size)
    want = {(c, *r) for c, s in seqs.items() for r in repeats_in(s, min_size, 5)}
    got = repeats.contig_repeats(spark.createDataFrame([*seqs.items()], "contig string, seq string"), min_size, 5).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert bool(rounds) == (small < 1000)
    cut = [(c, i, s[i : i + 40]) for c, s in seqs.items() for i in range(0, len(s), 40)]
    assert {tuple(r) for r in repeats.contig_repeats(spark.createDataFrame(cut, "contig string, start long, seq string"), min_size, 5).collect()} == want


def test_suffixes_are_sorted_only_where_bases_repeat(monkeypatch):
    """The places that repeat, and the full sort of all suffixes, have the same repeats; the sort is left out where it can be."""
    sorted_ = []
    monkeypatch.setattr(sequence, "suffix_ranks", lambda c, f=sequence.suffix_ranks: sorted_.append(len(c)) or f(c))
    rng = np.random.default_rng(3)
    base = lambda n: "".join("ACGTN"[i] for i in rng.choice(5, n, p=[0.245] * 4 + [0.02]))
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    near = sequence._neighbours
    n_found = 0
    for _ in range(60):
        size = int(rng.choice([1, 2, 5, 15, 20, 32, 33, 45]))
        unit = base(int(rng.integers(1, 60)))
        for s in (base(60) + unit, unit + base(70) + unit + "n" + base(9), turn(unit) + base(5) + unit + unit, base(3) * 9):
            got = repeats_in(s, size, 1)
            assert not sorted_
            monkeypatch.setattr(sequence, "repeated_places", lambda s, k: np.arange(len(s)))
            monkeypatch.setattr(sequence, "_neighbours", lambda c, live: None)
            assert got == repeats_in(s, size, 1) and sorted_
            monkeypatch.undo()
            monkeypatch.setattr(sequence, "suffix_ranks", lambda c, f=sequence.suffix_ranks: sorted_.append(len(c)) or f(c))
            sorted_.clear()
            n_found += len(got)
    assert n_found and sequence._neighbours is near
    long = base(700).replace("N", "A")
    assert max(r[3] for r in repeats_in(long + long, 40, 1)) == 700 and sorted_
