"""What a plan moves: no k-mers, no bins of levels that no interval has, no row twice."""

import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import annotate as N
from helixframe.operators import cluster as K
from helixframe.operators import dominance as D
from helixframe.operators import intervals as I
from helixframe.plans import compare
from helixframe.plans import io_queries as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kmers_are_not_shuffled(spark):
    """F6"""
    df = spark.createDataFrame([(1, "abcabc", "abcxbc"), (2, None, "abc"), (3, "ab", "abcd"), (4, "aaaa", "aaaa")], "i int, x string, y string")
    got = S.kmer_profile_similarity(df, "i", "x", "y", 3)
    assert "Exchange" not in plan(got) and "Generate" not in plan(got)
    assert {r.i: round(r.similarity, 6) for r in got.collect()} == {1: 0.25, 2: 0.0, 3: 0.0, 4: 1.0}


def test_levels_are_measured(spark):
    """only the levels that intervals have are joined; pairs of indel lengths are made once."""
    iv = spark.createDataFrame([(1, "c", 0, 10, 7), (2, "c", 5, 30, 8), (3, "c", 29, 40, 7), (4, "d", 0, 5, 9)], "id long, contig string, b long, e long, read long")
    depth = N.depth_by_names(iv, iv, ["contig"], "id", "b", "e", "read", "b", "e")
    assert "bit_or" in plan(depth) and {r.id: r.depth for r in depth.collect()} == {1: 2, 2: 2, 3: 2, 4: 1}
    assert "bit_or" in plan(N.spanning_guard(iv, iv, ["contig"], "id", "b", "e", "read", "b", "e"))
    sig = iv.select("contig", F.when(F.col("id") == 2, "D").otherwise("I").alias("sig_type"), F.col("b").alias("start"), F.col("e").alias("stop"), "read")
    got = N.indel_lengths(iv, sig, ["contig"], "id", "b", "e", 1)
    assert plan(got).split("Initial Plan")[0].count("Generate explode") == 2
    assert {tuple(r) for r in got.select("id", "max_i", "max_d", "near_i", "near_d", "reads").collect()} == {(1, 10, 25, 1, 1, 2), (2, 11, 25, 2, 1, 2), (3, 11, 25, 1, 1, 2), (4, 5, None, 1, 0, 1)}


def test_only_linked_places_enter_the_rounds(spark, monkeypatch):
    """F12"""
    seen = []
    monkeypatch.setattr(K, "label_components", lambda nodes, edges, node, f=K.label_components: seen.append(nodes.distinct().count()) or f(nodes, edges, node))
    df = spark.createDataFrame([(i, "k", 100 * i, 100 * i) for i in range(1, 9)] + [(20, "k", 802, 800), (21, "k", 802, 800)], "i long, k string, x long, y long")
    got = {r.i: r.component for r in K.components_2d(df, ["k"], "i", "x", "y", 4).collect()}
    assert got == {**{i: i for i in range(1, 9)}, 20: 8, 21: 8} and seen == [2]


def test_dominant_rows_carry_nothing_twice(spark):
    """F15"""
    df = spark.createDataFrame([(1, "k", 0, 9, 9, "a"), (2, "k", 1, 5, 4, "b"), (3, None, 1, 5, 4, "c"), (4, "k", 900, 905, 5, "d")], "id int, k string, s int, t int, n int, x string")
    got = D.keep_dominant(df, ["k"], "id", "s", "t", "n", 3)
    assert got.schema.simpleString() == df.schema.simpleString() and {tuple(r) for r in got.collect()} == {(1, "k", 0, 9, 9, "a"), (3, None, 1, 5, 4, "c"), (4, "k", 900, 905, 5, "d")}
    assert "struct(s, s" in plan(got) and "struct(id, id" not in plan(got)


def test_signals_have_no_folder_for_each_contig(spark, sf, monkeypatch):
    """F7"""
    by = []
    monkeypatch.setattr(Q.W, "write_table", lambda df, path, *a, f=Q.W.write_table: (f(df, path, *a), by.append(os.listdir(path.removeprefix("file://") + "/sample=s"))))
    Q.signal_table(spark, sf).collect()
    assert len(by) == 2 and not [x for names in by for x in names if x.startswith("contig=")]


def test_genotypes_are_counted_at_once(spark):
    """one step of aggregation, not one for each haplotype first."""
    h = spark.createDataFrame([(1,), (2,), (2,)], "v int")
    got = D.haplotype_genotypes(h, spark.createDataFrame([(2,), (3,)], "v int"))
    assert plan(got).count("HashAggregate") == 2 and {tuple(r) for r in got.collect()} == {(1, "0/1"), (2, "1/1"), (3, "0/1")}


def test_questions_leave_a_task_in_small_batches(spark, monkeypatch):
    """a batch of anchors that all ask every cell is not held whole."""
    import numpy as np
    import pyarrow as pa

    from helixframe.llm import hard_negatives as H

    class Asked:
        """The function that Spark would run for each partition."""

        def select(self, *cols):
            return self

        join = select

        def mapInArrow(self, run, schema):
            self.run = run
            raise StopIteration

    class Index:
        class cells:
            n = 50
            reach = staticmethod(lambda q: (np.ones(50), np.zeros(50)))

    class Windows:
        def groupBy(self, *a):
            return self

        agg = groupBy

    monkeypatch.setattr(H, "ROWS", 100)
    asked = Asked()
    try:
        H._asked(Index, asked, Windows(), False, False)
    except StopIteration:
        pass
    ws = pa.list_(pa.struct([("w", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(["a"] * 20), pa.array([np.ones(2, "<i4").tobytes()] * 20), pa.array([[{"w": 0, "lo": 0, "hi": 1}]] * 20, ws)], ["aid", "label", "x", "ws"])
    out = list(asked.run([batch]))
    assert sum(b.num_rows for b in out) == 20 * 49 and max(b.num_rows for b in out) < 150


def test_batches_for_python_are_small(spark):
    """40 texts of a megabyte reach a Python worker a few at a time, where they came in one batch."""
    import pyarrow as pa
    from helixframe.llm.common import materialize, release

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    rows = spark.range(40).repartition(1).selectExpr("repeat('x', 1000000) AS text")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = materialize(rows.mapInArrow(sizes, "n long"), "sizes")
    found = [r.n for r in got.collect()]
    release(got)
    assert max(found) < 8_000_000 and sum(found) >= 40_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_fasta_lines_are_not_sorted(spark, tmp_path):
    """Lines of a FASTA file are streamed block by block: nothing but chunks that a border cuts is grouped."""
    from helixframe.sources.readers import read_fasta

    (tmp_path / "a.fa").write_text("".join(f">c{k}\n" + "ACGTACGTAC\n" * 5 for k in range(40)))
    got = read_fasta(spark, str(tmp_path / "a.fa"), 8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and {(r.contig, len(r.seq)) for r in got.collect()} == {(f"c{k}", n) for k in range(40) for n in (8, 2)}


def test_vcf_is_written_compressed(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "folder", lambda spark: str(tmp_path))
    assert Q.vcf_roundtrip(spark, sf).count() > 0
    parts = [x for x in os.listdir(tmp_path / "vcf") if x.startswith("part-")]
    assert parts and all(x.endswith(".gz") for x in parts)


def test_regions_are_dealt_by_rows(spark, monkeypatch):
    """More rows than the partitions may hold make more partitions, and a region stays in one."""
    monkeypatch.setattr(K, "REGION_ROWS", 50)
    df = spark.createDataFrame([(k % 40, 10 * k, 10 * k + 5) for k in range(2000)], "k int, b long, e long")
    rows, region = K.regions(df, ["k"], F.col("b"), F.col("e"), 1)
    got = rows.withColumn("p", F.spark_partition_id())
    assert rows.rdd.getNumPartitions() == 40 and got.count() == 2000
    assert got.groupBy("k", region).agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0
    assert I.merge_intervals(df, ["k"], "b", "e").agg({"n": "sum"}).first()[0] == 2000
    assert K.leader_1d(df, ["k"], "b", 500, "e").groupBy("k").agg(F.max("cluster").alias("n")).agg(F.min("n"), F.max("n")).first()[:] == (25, 25)


def test_shifts_are_found_within_the_row(spark):
    """one shuffle, by the identifier, of a row for each row; rows of one identifier and rows that cannot be cut are as before."""
    rows = [(1, "é" * 9 + "abcdefgh" * 9, "xyzw" * 3 + "abcdefgh" * 9, 30), (2, None, "abcdefgh", 5), (3, "abcdefg", "abcdefg", None), (4, "abc", "abc", 40), (5, "", "abcdefgh", 4), (6, "abcdefghij", "hijabcdefg", 5), (6, "acacacacac", "gacacacaca", 6)]
    df = spark.createDataFrame(rows, "i long, l string, r string, n int")
    got = S.shift_by_kmers(df, "i", "l", "r", "n")
    assert plan(got).count("Exchange hashpartitioning") == 1
    grams = lambda x, k: {x[j : j + k] for j in range(len(x) - k + 1)}
    won = {}
    for i in {r[0] for r in rows}:
        for k in range(5, 36, 2):
            tried = []
            for _, a, b, n in (r for r in rows if r[0] == i and r[1] is not None):
                for at in [0] if n is None else [int(j / 20 * n) for j in range(1, 20)]:
                    x, y = (grams(t[at : None if n is None else at + n], k) for t in (a, b))
                    if x and y:
                        tried.append((-len(x & y) / len(x | y), None if n is None else at))
            if tried:
                won.setdefault(i, []).append(min(tried)[1])
    assert {r.i: r["shift"] for r in got.collect()} == {i: min(v, key=lambda at: (-v.count(at), at)) for i, v in won.items()}  # noqa: B023


def test_call_sets_meet_once(spark):
    """starts and ends are joined in one step, in bins of one level; nulls, negative places and borders of bins as in plain loops."""
    rng = np.random.default_rng(6)
    some = lambda n: [(k, None if k == 3 else "cd"[int(rng.integers(2))], "DI"[int(rng.integers(2))], None if k == 5 else int(b := rng.integers(-300, 300)), None if k == 7 else int(b + rng.integers(0, 90)) if k != 5 else 4, int(rng.integers(1, 60))) for k in range(n)]
    a, b = some(80), some(80)
    x, y = (spark.createDataFrame(r, "id long, contig string, svtype string, pos1 long, pos2 long, svlen long") for r in (a, b))
    for width in (0, 10, 31, 32, 200):
        near = lambda p, q: None not in (p, q) and abs(p - q) <= width  # noqa: B023, E731
        want = {r[0] for r in a if any(None not in (r[1], s[1]) and r[1:3] == s[1:3] and (near(r[3], s[3]) or near(r[4], s[4])) and min(r[5], s[5]) >= 0.7 * max(r[5], s[5]) for s in b)}
        got = compare.match_ids(x, y, width)
        assert sorted(r.id for r in got.collect()) == sorted(want)
    assert plan(compare.match_ids(x, y, 10)).count("LeftSemi") == 1


def test_callers_leave_nothing_behind(spark, sf, tmp_path, monkeypatch):
    """tables that only lead to others go as they are done with, nested blocks too, and the calls alone are left."""
    from helixframe.plans.queries import sv_calls

    shared = tmp_path / "shared"
    monkeypatch.setattr(K, "shared_path", lambda spark, label: f"file://{shared}/{label}-{uuid.uuid4().hex}")
    with K.scratch() as keep:
        with K.scratch() as inner:
            a, b = inner(K.shared_table(spark.range(3))), K.shared_table(spark.range(4))
        assert a.count() == 3 and len(list(shared.iterdir())) == 1
        c = keep(K.shared_table(spark.range(5)))
    assert c.count() == 5 and len(list(shared.iterdir())) == 1
    K.drop_table(c)
    got = sv_calls(spark, sf)
    assert got.count() >= 0 and len(list(shared.iterdir())) == 1
