"""Repeats of whole contigs by prefix doubling as Spark jobs.

Every place of a contig and of its reverse complement is a row. Places are ranked by their first bases, then
by ranks twice as far at a time: a place that shares its rank with others looks up the rank behind its known prefix,
and the class splits by it. Places whose rank is theirs alone are settled and leave the rounds. Neighbours in the final order
get their common length from the ranks of the rounds, the longest first. No task holds a contig; a repeat may be
as long and as far apart as the contig allows.

Contigs of at most ``SMALL`` bases need no rounds: each lies in one task, which sorts its suffixes only if bases repeat in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import repeats_of
from .cluster import drop_table, shared_table

#: Bases whose digits fit one number.
WIDEST = 21
#: Bases up to which a contig is searched in one task.
SMALL = 1 << 18
#: Bases of a piece in which places are made.
PIECE = 1 << 14
_DIGIT = np.full(256, 5, np.int64)
_DIGIT[[*b"ACGT"]] = [1, 2, 3, 4]
_OTHER = np.array([0, 4, 3, 2, 1, 5], np.int64)


def _keys(digits: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the first ``k`` digits from every place but the last k - 1, the count of bases in front, and the place of
    the digit that ends them, or -1. Behind that digit (5: no base, 0: the end of the text) all count as 0. ``at``: places of the digits."""
    n = len(digits) - k + 1
    key, real, stop, open_ = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64), np.ones(n, bool)
    for j in range(k):
        d = digits[j : j + n]
        key = key * 8 + np.where(open_, d, 0)
        ends = open_ & ((d == 5) | (d == 0))
        stop[ends] = at[j : j + n][ends]
        open_ &= ~ends
        real += open_
    return key, real, stop


def _places(pieces: DataFrame, k: int) -> DataFrame:
    """``contig, i, key, real, stop`` of all places of the text, its separator and its reverse complement."""

    def run(batches):
        for b in batches:
            for contig, start, own, ahead, length in zip(*(b.column(c).to_pylist() for c in ("contig", "start", "seq", "ahead", "length"))):
                text = _DIGIT[np.frombuffer((own + (ahead or "")).upper().encode("ascii", "replace"), np.uint8)]
                n, end = len(own), start + len(own)
                place = np.arange(start, start + len(text))
                tail = max(0, k - 1 - (len(text) - n))  # places behind the contig's last base: the separator, then nothing that counts
                digits, at = np.concatenate([text, np.full(tail, 5, np.int64)])[: n + k - 1], np.concatenate([place, np.full(tail, length, np.int64)])[: n + k - 1]
                out = [(np.arange(start, end), *_keys(digits, at, k))]
                # reverse complements of the same stretches: place 2 * length - p for the base p; a stretch begins with its last base
                turned, back = _OTHER[text[::-1]], 2 * length - place[::-1]
                if len(turned) >= k:
                    out.append((back[: len(turned) - k + 1], *_keys(turned, back, k)))
                if start == 0:  # the last ones run into the end of the text
                    head = np.concatenate([turned[-(k - 1) :] if k > 1 else turned[:0], np.zeros(k - 1, np.int64)])
                    behind = np.concatenate([back[-(k - 1) :] if k > 1 else back[:0], np.arange(2 * length + 1, 2 * length + k)])
                    if len(head) >= k:
                        out.append((behind[: len(head) - k + 1], *_keys(head, behind, k)))
                    out.append((np.array([length]), *_keys(np.concatenate([[5], np.zeros(k - 1, np.int64)]), np.arange(length, length + k), k)))
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array([contig] * len(cols[0]), pa.string()), *map(pa.array, cols)], ["contig", "i", "key", "real", "stop"])

    return pieces.mapInArrow(run, "contig string, i bigint, key bigint, real bigint, stop bigint")


def _ranked(places: DataFrame) -> DataFrame:
    """``contig, i, rank, n`` of every place: the number of places before its class, and the size of its class."""
    spark = places.sparkSession
    order = ["contig", "key", "stop"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    classes = shared_table(places.groupBy(*order).agg(F.count("*").alias("n")).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sums = classes.groupBy("part").agg(F.sum("n").alias("total"))  # one row for each shuffle partition
    base = shared_table(sums.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base")))
    local = F.sum("n").over(Window.partitionBy("part").orderBy(*order)) - F.col("n")
    ranks = classes.withColumn("local", local).join(base, "part").select(*order, (F.col("base") + F.col("local")).cast("bigint").alias("rank"), "n")
    out = shared_table(places.join(ranks, order).select("contig", "i", "rank", "n"))
    drop_table(classes, base)
    return out


def contig_repeats(seqs: DataFrame, min_size: int = 1, min_dist: int = 5) -> DataFrame:
    """``contig, kind, pos1, pos2, size`` of the repeats of whole contigs, from ``contig, seq`` or pieces ``contig, start, seq``.

    Repeats are those between neighbours in the order of all suffixes of a contig with its reverse complement, of ``min_size`` bases or
    more: 'dup' with both on the forward strand, ``min_dist`` or more apart, 'inv' with one on either, in forward
    positions. N and other letters match nothing. Null sequences count as empty, and an empty one has no repeats;
    pieces of a contig are gapless and hold ``WIDEST`` bases or more each, but for the last.
    """
    whole = seqs.where(F.col("seq").isNotNull() & F.col("contig").isNotNull())
    if "start" in seqs.columns:
        length = whole.groupBy("contig").agg(F.sum(F.length("seq")).alias("_n"))
        few = whole.join(length.where(F.col("_n") <= SMALL), "contig").groupBy("contig")
        small = few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq"))), lambda x: x["seq"]), "").alias("seq"))
        large = whole.join(length.where(F.col("_n") > SMALL).select("contig"), "contig", "left_semi")
    else:
        small, large = whole.where(F.length("seq") <= SMALL), whole.where(F.length("seq") > SMALL)
    small = small.select(F.col("contig").cast("string").alias("contig"), F.lit(0).cast("bigint").alias("at"), "seq")
    found = repeats_of(small.repartition("contig"), min_size, min_dist)
    if not large.isEmpty():
        found = found.union(_of_large(large, min_size, min_dist))
    return shared_table(found)


def _of_large(whole: DataFrame, min_size: int, min_dist: int) -> DataFrame:
    """The repeats of contigs that no task may hold, by prefix doubling."""
    k = max(1, min(WIDEST, min_size))
    if "start" not in whole.columns:
        cut = F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(PIECE))).alias("start")
        whole = whole.select(F.col("contig").cast("string").alias("contig"), cut, "seq").select("contig", "start", F.substring("seq", F.col("start") + 1, F.lit(PIECE)).alias("seq"))
    size = whole.groupBy("contig").agg(F.sum(F.length("seq")).cast("bigint").alias("length"))
    own = whole.select("contig", F.col("start").cast("bigint").alias("start"), "seq").where(F.length("seq") > 0)
    following = own.select("contig", F.col("start").alias("end"), F.substring("seq", 1, k - 1).alias("ahead"))
    pieces = own.withColumn("end", F.col("start") + F.length("seq")).join(following, ["contig", "end"], "left").join(size, "contig")
    places = shared_table(_places(pieces.select("contig", "start", "seq", "ahead", "length"), k))
    first = _ranked(places)

    shares = lambda t: t.where("n > 1")
    rounds, latest, h = [first], shares(first).select("contig", "i", "rank"), k
    while shares(rounds[-1]).limit(1).count():
        active = shares(rounds[-1]).select("contig", "i", "rank", (F.col("i") + h).alias("j"))
        settled = first.where("n = 1").select("contig", F.col("i").alias("j"), F.col("rank").alias("alone"))
        newest = latest.select("contig", F.col("i").alias("j"), F.col("rank").alias("now"))
        seen = active.join(newest, ["contig", "j"], "left").join(settled, ["contig", "j"], "left").withColumn("second", F.coalesce("now", "alone", F.lit(-1)))
        place = F.rank().over(Window.partitionBy("rank").orderBy("second")) - 1
        same = F.count("*").over(Window.partitionBy("rank", "second"))
        made = shared_table(seen.select("contig", "i", (F.col("rank") + place).cast("bigint").alias("rank"), same.alias("n")))
        both = latest.join(made.select("contig", "i", F.col("rank").alias("now")), ["contig", "i"], "left")
        newer = shared_table(both.select("contig", "i", F.coalesce("now", "rank").alias("rank")))
        drop_table(latest)
        rounds, latest, h = [*rounds, made], newer, h * 2

    last = shares(first).select("contig", "i", F.col("rank").alias("class")).join(latest, ["contig", "i"])
    one = last.select("contig", F.col("i").alias("a"), "class", (F.col("rank") + 1).alias("rank"))
    pairs = one.join(last.withColumnRenamed("i", "b"), ["contig", "class", "rank"]).select("contig", "a", "b", F.lit(0).cast("bigint").alias("size"))
    look = lambda t, c, v: t.select("contig", F.col("i").alias(f"at_{c}"), *[F.col(x).alias(f"{x}_{c}") for x in v])
    for level in range(len(rounds) - 1, -1, -1):
        both = pairs.withColumns({"at_a": F.col("a") + F.col("size"), "at_b": F.col("b") + F.col("size")})
        for c in "ab":
            both = both.join(look(shares(rounds[level]), c, ["rank"]), ["contig", f"at_{c}"], "left")
        more = F.when(F.col("rank_a") == F.col("rank_b"), k << level).otherwise(0)
        pairs = shared_table(both.select("contig", "a", "b", (F.col("size") + more).alias("size")))
    both = pairs.withColumns({"at_a": F.col("a") + F.col("size"), "at_b": F.col("b") + F.col("size")})
    for c in "ab":
        both = both.join(look(places, c, ["key", "real"]), ["contig", f"at_{c}"], "left")
    differ = F.col("key_a").bitwiseXOR(F.col("key_b"))
    equal = F.when(differ == 0, k).otherwise(F.floor((3 * k - F.length(F.bin(differ))) / 3))
    rest = F.coalesce(F.when(F.col("key_a").isNotNull() & F.col("key_b").isNotNull(), F.least(equal, "real_a", "real_b")), F.lit(0))
    done = both.withColumn("size", (F.col("size") + rest).cast("bigint")).where(F.col("size") >= max(1, min_size)).join(size, "contig")
    done = done.select("contig", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "size", "length")
    p = 2 * F.col("length") + 1 - F.col("b") - F.col("size")
    dup, inv = (F.col("b") < F.col("length")) & (F.col("b") - F.col("a") >= min_dist), (F.col("a") < F.col("length")) & (F.col("b") > F.col("length"))
    found = done.where(dup).select("contig", F.lit("dup").alias("kind"), F.col("a").alias("pos1"), F.col("b").alias("pos2"), "size")
    found = found.union(done.where(inv).select("contig", F.lit("inv"), F.least("a", p), F.greatest("a", p), "size")).distinct()
    out = shared_table(found)
    drop_table(places, *rounds, latest, pairs)
    return out
