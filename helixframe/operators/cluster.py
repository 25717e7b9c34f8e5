"""Clustering of positions: leader folds, gap islands and exact distance components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .intervals import _floor_div, band_join, fresh_names


#: Positions in a bin of :func:`regions`.
REGION_BIN = 1 << 16
#: Rows that a task of :func:`regions` is dealt at most, as long as regions are smaller.
REGION_ROWS = 1 << 19


def regions(df: DataFrame, keys: list[str], lo: Column, hi: Column, reach: int, size: int | None = None) -> tuple[DataFrame, str]:
    """``df`` with a region, and that column's name: rows of a later region of a key begin ``reach`` or more behind all before.

    No chain or cluster that needs nearer neighbours crosses a region, so each is folded by itself and no
    task has to hold a whole key. Cuts are looked for at the borders of bins, from one row for each bin; these are written first, so
    that Spark knows their size, and rows look them up without a shuffle while they are few. Rows with a null key or position are in no region.
    Rows of a region are in one partition, and the sizes of the bins tell how many partitions there have to be, so that
    what a task sorts does not grow with the table.
    """
    region, bin_, first, far, cut, size_ = fresh_names(df.columns, "region", "bin", "first", "far", "cut", "size")
    rows = df.withColumn(bin_, _floor_div(lo.cast("bigint"), F.lit(size or REGION_BIN).cast("bigint")))
    bins = rows.groupBy(*keys, bin_).agg(F.min(lo).alias(first), F.max(hi).alias(far), F.count("*").alias(size_)).where(F.col(bin_).isNotNull())
    w = Window.partitionBy(*keys).orderBy(bin_)
    before = F.max(far).over(w.rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.withColumn(cut, F.when(F.col(first) - before < reach, 0).otherwise(1))
    bins = shared_table(bins.select(*keys, bin_, F.sum(cut).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint").alias(region), size_))
    found = rows.join(bins.drop(size_), [*keys, bin_]).drop(bin_)
    tasks = -(-(bins.agg(F.sum(size_)).first()[0] or 0) // REGION_ROWS)
    some = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(*([tasks] if tasks > some else []), *keys, region), region


def _numbered(rows: DataFrame, keys: list[str], region: str, name: str) -> DataFrame:
    """Numbers that begin at 1 in each region become numbers along the key.

    The rows are written, so that they are made once; there are no more regions than bins, so their sums are a small table.
    """
    most, before = fresh_names(rows.columns, "most", "before")
    done = shared_table(rows)
    w = Window.partitionBy(*keys).orderBy(region).rowsBetween(Window.unboundedPreceding, -1)
    sums = done.groupBy(*keys, region).agg(F.max(name).alias(most))
    sums = shared_table(sums.select(*keys, region, F.coalesce(F.sum(most).over(w), F.lit(0)).cast("bigint").alias(before)))
    return done.join(sums, [*keys, region]).withColumn(name, F.col(name) + F.col(before)).drop(region, before)


def islands(df: DataFrame, keys: list[str], pos: str, eps: int, order: str | None = None) -> DataFrame:
    """1-D density clusters with two members at least enough: adds ``island``, numbered from 1 along each key."""
    rows, region = regions(df, keys, F.col(pos), F.col(pos), eps + 1)
    (new,) = fresh_names(rows.columns, "new")
    w = Window.partitionBy(*keys, region).orderBy(pos, *([order] if order else []))
    rows = rows.withColumn(new, F.when(F.col(pos) - F.lag(pos).over(w) <= eps, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop(new)
    return _numbered(rows, keys, region, "island").select(*df.columns, "island")


def _fold(rows: DataFrame, by: list[str], order: list[str], heads, reads: list[str]) -> DataFrame:
    """Numbers the clusters of every region: ``heads(arrays, head)`` gives, from the columns ``reads`` of sorted rows and the head
    of the open cluster (or none), the places where a cluster opens.

    Rows of a region, which are in one partition, are sorted on the executors and streamed through one task in batches,
    so only the open cluster's head is held, whatever the size of a region.
    """
    cols = rows.columns

    def run(batches):
        key, head, number = None, None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in by:
                c = b.column(k)
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(new)])
            values = [b.column(k).to_numpy(zero_copy_only=False) for k in reads]
            out = np.zeros(n, np.int64)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), n]):
                if s or tuple(b.column(k)[0].as_py() for k in by) != key:
                    head, number = None, 0
                part = [v[s:e] for v in values]
                opened = heads(part, head)
                out[s + np.array(opened, np.int64)] = 1
                out[s] += number
                out[s:e] = np.cumsum(out[s:e])
                number = int(out[e - 1])
                if opened:
                    head = tuple(v[opened[-1]].item() for v in part)
            key = tuple(b.column(k)[n - 1].as_py() for k in by)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*cols, "cluster"])

    schema = T.StructType([*rows.schema.fields, T.StructField("cluster", T.LongType())])
    return rows.sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def leader_1d(df: DataFrame, keys: list[str], pos: str, distance: int, order: str) -> DataFrame:
    """Leader clustering: a row joins while it is less than ``distance`` from the head of the open cluster."""

    def heads(arrays: list[np.ndarray], head: tuple | None) -> list[int]:
        p = arrays[0]
        following = np.searchsorted(p, p + distance).tolist()  # where the next cluster opens, if one opens here
        at, out = 0 if head is None else int(np.searchsorted(p, head[0] + distance)), []
        while at < len(p):
            out.append(at)
            at = max(at + 1, following[at])
        return out

    rows, region = regions(df, keys, F.col(pos), F.col(pos), distance)
    return _numbered(_fold(rows, [*keys, region], [pos, order], heads, [pos]), keys, region, "cluster").select(*df.columns, "cluster")


def _joins(a, b, c, d, distance: int):
    """Whether intervals [c, d) join the cluster of the head [a, b); scalars or arrays."""
    la, lb = abs(b - a), abs(d - c)
    apart = abs((a + b) / 2 - (c + d) / 2)
    shared = np.minimum(b, d) - np.maximum(a, c)
    mean = (la + lb) / 2
    alike = abs(la - lb) / 2 / np.where(mean == 0, 1, mean) < 0.3
    return ((apart != 0) & (shared > 0.5 * np.maximum(la, lb))) | ((apart < distance) & alike & (abs(a - c) < np.minimum(la, lb)))


def leader_2d(df: DataFrame, keys: list[str], start: str, stop: str, distance: int, order: str) -> DataFrame:
    """Leader clustering of intervals by start.

    A row joins when the centre distance is not 0 and the overlap with the head exceeds half
    of the longer one, or the centres are closer than ``distance``, the lengths' variation is
    below 0.3 and the starts are closer than the shorter one. So it overlaps the head.
    """

    def heads(arrays: list[np.ndarray], head: tuple | None) -> list[int]:
        x, y = (v.astype(np.float64) for v in arrays)
        n, at, out = len(x), 0, []
        # whether each row joins its neighbour's cluster decides most heads at once; longer clusters are searched in growing blocks
        follows = _joins(x[:-1], y[:-1], x[1:], y[1:], distance).tolist() if n > 1 else []
        a, b = (float(head[0]), float(head[1])) if head is not None else (0.0, 0.0)
        if head is None:
            out.append(0)
            a, b, at = x[0], y[0], 1
        while at < n:
            if out and out[-1] == at - 1 and not follows[at - 1]:
                found = at
            else:
                found, size = n, 16
                while at < n:
                    no = np.flatnonzero(~_joins(a, b, x[at : at + size], y[at : at + size], distance))
                    if len(no):
                        found = at + int(no[0])
                        break
                    at, size = at + size, min(4096, 2 * size)
            if found >= n:
                break
            out.append(found)
            a, b, at = x[found], y[found], found + 1
        return out

    rows, region = regions(df, keys, F.least(start, stop), F.greatest(start, stop) + F.abs(F.col(stop) - F.col(start)), 1)
    return _numbered(_fold(rows, [*keys, region], [start, stop, order], heads, [start, stop]), keys, region, "cluster").select(*df.columns, "cluster")


def emission_gate(clusters: DataFrame, limit: float, n: str = "n") -> DataFrame:
    """Clusters whose mean relative spread per member is below ``limit``."""
    spread = (F.col("start_std") + F.col("stop_std")) / 2 / F.col("svlen_avg") / F.col(n)
    return clusters.where((F.col("svlen_avg") > 0) & (spread < limit))


def admitted(clusters: DataFrame, max_sure: int = 200, max_depth: int = 120) -> DataFrame:
    """Clusters within the limits of sure reads and depth; a depth below the members is implausible."""
    return clusters.where((F.col("sure_reads") <= max_sure) & (F.col("depth") >= F.col("n")) & (F.col("depth") <= max_depth))


def admitted_by_reads(clusters: DataFrame, max_sure: int = 150, max_reads: int = 75) -> DataFrame:
    """The older admission: few reads of high quality (``sure_reads``), few reads at all (``support``), and for D and I some depth."""
    deep = ~F.col("sig_type").isin("D", "I") | (F.col("depth") != 0)
    return clusters.where((F.col("sure_reads") <= max_sure) & (F.col("support") <= max_reads) & deep)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new name in the folder of ``spark.checkpoint.dir``; a temporary folder only where it is unset and one process does all (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def until_exit(spark: SparkSession, path: str) -> str:
    """Lets what was written to ``path`` go when the application ends."""
    system, p = _file_system(spark, path)
    system.deleteOnExit(p)
    return path


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("tables of the open block", default=None)


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; the table goes with :func:`drop_table`, with the block of :func:`scratch`, or when the application ends.

    The shuffle files of the write go when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cluster")
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._helix_path = path
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are made in the block go when it ends, but for those handed to the function it gives: they go with the block around it."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    token = _MADE.set(made)
    try:
        yield keep
    finally:
        _MADE.reset(token)
        stays = {df._helix_path for df in kept}
        drop_table(*[df for df in made if df._helix_path not in stays])
        if (outer := _MADE.get()) is not None:
            outer.extend(kept)


def drop_table(*tables: DataFrame) -> None:
    """Delete tables made by :func:`shared_table` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_helix_path", None)
        if path:
            system, p = _file_system(df.sparkSession, path)
            system.delete(p, True)


def label_components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """``node, component`` (smallest reachable node) of an edge list ``a, b``, for all nodes.

    Minimum labels spread over the edges and are shortened by pointer jumping until
    nothing changes; what a node learns is told to its label too, so that whole trees are hooked at once and a
    chain needs rounds by the logarithm of its length; each round is written to the shared folder.
    """
    both = shared_table(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    table = shared_table(nodes.select(F.col(node).alias("n"), F.col(node).alias("c")).distinct())
    while True:
        labels = table.select("n", "c")
        near = both.join(labels, both["b"] == labels["n"]).groupBy("a").agg(F.min("c").alias("m"))
        own = F.struct("n", F.least("c", F.coalesce("m", "c")).alias("t"), "c")
        told = F.when(F.col("m") < F.col("c"), F.struct(F.col("c").alias("n"), F.col("m").alias("t"), F.lit(None).cast(labels.schema["c"].dataType).alias("c")))
        hop = labels.join(near, labels["n"] == near["a"], "left").select(F.explode(F.array_compact(F.array(own, told))).alias("x"))
        hop = hop.groupBy("x.n").agg(F.min("x.t").alias("t"), F.max("x.c").alias("c"))
        of = labels.select(F.col("n").alias("t"), F.col("c").alias("tc"))
        nxt = shared_table(hop.join(of, "t", "left").select("n", F.least("t", F.coalesce("tc", "t")).alias("c"), (F.col("c") != F.least("t", F.coalesce("tc", "t"))).alias("moved")))
        drop_table(table)
        table = nxt
        if not nxt.where("moved").limit(1).count():
            drop_table(both)
            return nxt.select(F.col("n").alias(node), F.col("c").alias("component"))


def components_2d(df: DataFrame, keys: list[str], node: str, x: str, y: str, eps: float) -> DataFrame:
    """Exact density components of points for two members: linked within Euclidean ``eps`` (inclusive).

    Equal points are one node before the grid join, so a pile of equal points costs nothing.
    """
    spots = df.groupBy(*keys, x, y).agg(F.min(node).alias("_n"))
    a, b = spots.select(*keys, F.col("_n").alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay")), spots.select(*keys, F.col("_n").alias("b"), F.col(x).alias("bx"), F.col(y).alias("by"))
    near = band_join(a, b, keys, "ax", "bx", int(eps)).where("a < b").where((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 <= eps * eps)
    # few spots have a link in sparse data: only these enter the rounds, and they come back by their place, as all rows do
    links = shared_table(near.select(*keys, "a", "b", "ax", "ay", "bx", "by"))
    ends = [links.select(*keys, F.col(f"{t}x").alias(x), F.col(f"{t}y").alias(y), F.col(t).alias("_l")) for t in "ab"]
    linked = ends[0].union(ends[1]).distinct()
    comp = label_components(linked.select("_l"), links.select("a", "b"), "_l")
    named = linked.join(comp, "_l").select(*keys, x, y, F.col("component").alias("_m"))
    out = df.join(spots, [*keys, x, y]).join(named, [*keys, x, y], "left")
    return out.withColumn("component", F.coalesce("_m", "_n")).drop("_n", "_m")
