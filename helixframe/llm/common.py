"""Shared pieces of the corpus operators: tables, shared scratch tables, exact
connected components, 64-bit mixing, and partition-wide grouping in Arrow."""

from __future__ import annotations

import hashlib
import secrets
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and one process does all (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Fixed value: Spark's switch for deleting an execution's shuffle files when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch that goes to Python: Spark's own 64 MB lie in a task twice on the JVM's side and twice on Python's.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    A lost executor costs nothing then, and both passes of a two-pass operator
    see the same rows in the same order. The shuffle files of the write go when it ends,
    not when the driver happens to collect its garbage. Batches for Python are kept small. The table goes with :func:`release`, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in (_CLEAN, _BATCH)}
    spark.conf.set(_CLEAN, "true")
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._helix_path = path
    return out


def release_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_helix_path", None)
        if path:
            release_path(df.sparkSession, path)


def fresh(taken: list[str], name: str) -> str:
    """``name``, lengthened until it clashes with no column (Spark's names ignore case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; component = its smallest node.

    Large-star / small-star rounds: each round is two combinable minimum
    aggregations and two equi joins, so a hub never has its neighbours collected
    and no label leaves the executors. Self loops and nulls are ignored.
    """
    a, b = F.col("a"), F.col("b")
    cur = materialize(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc"
    )
    seen = None
    while True:
        stat = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(stat) == seen or not stat[0]:
            break
        seen = tuple(stat)
        both = cur.select("u", "v").union(cur.select(F.col("v"), F.col("u"))).toDF("x", "y")
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        big = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            big.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        )
        nxt = materialize(small.distinct(), "cc")
        release(cur)
        cur = nxt
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


M64 = (1 << 64) - 1
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64) of an unsigned array."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & M64)
        x = (x ^ (x >> _S30)) * _B
        x = (x ^ (x >> _S27)) * _C
        return x ^ (x >> _S31)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    n = len(sorted_values)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1])
    return starts, np.diff(np.append(starts, n))


#: The prime 2^61 - 1, and a base for hashes that have to be the same in every run.
_P = (1 << 61) - 1
FIXED_BASE = 0x9E6C63D0876A9A4 | 1
#: Bytes of a text that are hashed at a time, and the longest span that is hashed this way.
_BLOCK, _SPAN = 1 << 18, 1 << 18
_LOW32, _LOW30, _LOW31, _LOW29 = (np.uint64((1 << k) - 1) for k in (32, 30, 31, 29))
_U = {k: np.uint64(k) for k in (1, 29, 30, 31, 32, 61)}


def random_base() -> int:
    """A base that texts cannot know: drawn on the driver for each run, for hashes that do not outlive it."""
    return secrets.randbelow(_P - (1 << 32)) + (1 << 31)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(_P)) + (x >> _U[61])
    return np.where(x >= np.uint64(_P), x - np.uint64(_P), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1 of reduced numbers."""
    a1, a0, b1, b0 = a >> _U[31], a & _LOW31, b >> _U[31], b & _LOW31
    cross = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << _U[1]) + (cross >> _U[30]) + ((cross & _LOW30) << _U[31]) + a0 * b0)


_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(base: int, size: int) -> list[np.ndarray]:
    """Low 32 and high 29 bits of the powers of ``base``, and the powers of its inverse; the longest so far are kept."""
    if base not in _POWERS or len(_POWERS[base][0]) < size:
        made = []
        for x in (base, pow(base, -1, _P)):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, _times(out, np.full(1, pow(x, len(out), _P), np.uint64))])
            made.append(out)
        _POWERS.pop(base, None)
        while len(_POWERS) > 3:  # bases of earlier runs
            del _POWERS[next(iter(_POWERS))]
        _POWERS[base] = [made[0] & _LOW32, made[0] >> _U[32], made[1]]
    return _POWERS[base]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """61-bit hashes of byte spans: a polynomial modulo 2^61 - 1 at ``base``, from prefix sums.

    Two different spans of n bytes or less have the same hash for less than n of all bases, whatever their
    bytes. Spans above 256 KB get a keyed hash of their bytes. ``start`` ascends.
    """
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        first = int(start[at])
        stop = int(np.searchsorted(start, first + _BLOCK))
        s, e = start[at:stop] - first, end[at:stop] - first
        short = e - s <= _SPAN
        part = data[first : first + int(e[short].max(initial=0))]
        low, high, inverse = _powers(base, 1 << max(12, len(part).bit_length()))
        value = part.astype(np.uint64) + _U[1]
        sums = np.zeros((2, len(part) + 1), np.uint64)
        np.cumsum(value * low[: len(part)], out=sums[0, 1:])
        np.cumsum(value * high[: len(part)], out=sums[1, 1:])
        x, y = s[short], e[short]
        d = _reduced(sums[1, y] - sums[1, x])
        d = _reduced((d >> _U[29]) + ((d & _LOW29) << _U[32]) + _reduced(sums[0, y] - sums[0, x]))
        out[at:stop][short] = _times(d, inverse[x])
        for k in np.flatnonzero(~short).tolist():
            body = data[first + int(s[k]) : first + int(e[k])].tobytes()
            out[at + k] = int.from_bytes(hashlib.blake2b(body, digest_size=8, key=base.to_bytes(8, "little")).digest(), "little") >> 3
        at = stop
    return out


def spans_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    framed = np.zeros(len(inside) + 2, bool)
    framed[1:-1] = inside
    edge = np.flatnonzero(framed[1:] != framed[:-1])
    return edge[::2], edge[1::2]


class Packer:
    """Packs fixed-width records into one blob per shuffle bucket.

    A task hands over numpy columns; when ``limit`` records have gathered they are
    dealt by ``key mod buckets`` and leave as a few large binary rows, so the
    shuffle moves bytes and not one JVM row for each record. ``split(cols)`` may set records
    aside; those are dealt by their second column, under negative bucket numbers.
    """

    def __init__(self, buckets: int, limit: int = 1_000_000, distinct: bool = False, split=None):
        self.buckets, self.limit, self.distinct, self.split, self.held, self.n = buckets, limit, distinct, split, [], 0

    def add(self, *cols: np.ndarray):
        self.held.append(cols)
        self.n += len(cols[0])
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self):
        if not self.n:
            return
        cols = [np.concatenate(c) for c in zip(*self.held)]
        self.held, self.n = [], 0
        if self.distinct:
            order = np.lexsort(cols[::-1])
            cols = [c[order] for c in cols]
            keep = np.ones(len(order), bool)
            keep[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            cols = [c[keep] for c in cols]
        aside = []
        if self.split:
            cols, aside = self.split(cols)
        yield from self._deal((cols[0] % np.uint64(self.buckets)).astype(np.int32), cols)
        if aside:
            yield from self._deal(-1 - (mix(aside[1].view(np.uint64)) % np.uint64(self.buckets)).astype(np.int32), aside)

    @staticmethod
    def _deal(b: np.ndarray, cols: list[np.ndarray]):
        order = np.argsort(b, kind="stable")
        starts, lens = runs(b[order])
        cols = [c[order] for c in cols]
        for i in range(0, len(starts), 64):
            s = range(i, min(i + 64, len(starts)))
            yield pa.RecordBatch.from_pydict(
                {"bucket": pa.array([int(b[order[starts[j]]]) for j in s], pa.int32())}
                | {f"c{k}": pa.array([c[starts[j] : starts[j] + lens[j]].tobytes() for j in s], pa.binary()) for k, c in enumerate(cols)}
            )

    @staticmethod
    def schema(n: int) -> str:
        return "bucket int, " + ", ".join(f"c{k} binary" for k in range(n))


def unpack(batches, dtypes: list) -> list[np.ndarray]:
    """All records of a partition of packed rows, as numpy columns."""
    cols: list[list[bytes]] = [[] for _ in dtypes]
    for batch in batches:
        for k in range(len(dtypes)):
            cols[k].extend(batch.column(f"c{k}").to_pylist())
    return [np.frombuffer(b"".join(c), dt) for c, dt in zip(cols, dtypes)]


def key_groups(batches, keys: list[str]):
    """Row groups of equal ``keys`` from batches that are sorted by them, one table at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        if held and tuple(c[0] for c in cols) != last:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for x in cut:
            yield pa.Table.from_batches([*held, b.slice(at, x - at)])
            held, at = [], x
        held.append(b.slice(at))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
