"""Optional annotations and region evidence: repeats at calls, depth by names, raw indel lengths, spanning reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import matched_ids, overlap_join

C = F.col
SITE = ["contig"]


def in_palindrome(calls: DataFrame, inverted: DataFrame, id_col: str, begin: str, end: str) -> DataFrame:
    """Ids of calls explained by an inverted repeat.

    The repeat (pos1, pos2, size, center) overlaps; its centre is within an arm of the call's
    centre, and both ends lie inside, or their mean offset from its bounds is below an arm.
    """
    r = inverted.select(*SITE, C("pos1").alias("_rb"), C("pos2").alias("_re"), C("size").alias("_arm"), C("center").alias("_mid"))
    c = calls.select(*SITE, id_col, C(begin).alias("_cb"), C(end).alias("_ce"))
    near = F.abs((C("_cb") + C("_ce")) / 2 - C("_mid")) <= C("_arm")
    inside = (C("_cb") >= C("_rb")) & (C("_ce") <= C("_re"))
    offset = (F.abs(C("_cb") - C("_rb")) + F.abs(C("_ce") - C("_re"))) / 2 < C("_arm")
    return matched_ids(c, r, SITE, id_col, "_cb", "_ce", "_rb", "_re", near & (inside | offset))


def tandem_bounds(calls: DataFrame, direct: DataFrame, id_col: str, begin: str, end: str, pad: int = 50) -> DataFrame:
    """``id_col, r_begin, r_end``: bounds of the longest direct repeat at both ends of a call."""
    r = direct.select(*SITE, C("pos1").alias("_rb"), C("pos2").alias("_re"), C("size").alias("_n"))
    c = calls.select(*SITE, id_col, C(begin).alias("_cb"), C(end).alias("_ce"))
    hit = overlap_join(c, r, SITE, "_cb", "_ce", "_rb", "_re").where((F.abs(C("_rb") - C("_cb")) <= pad) & (F.abs(C("_re") - C("_ce")) <= pad))
    best = F.max_by(F.struct(C("_rb").alias("b"), C("_re").alias("e")), F.struct("_n", -C("_rb"), -C("_re")))
    return hit.groupBy(id_col).agg(best.alias("_x")).select(id_col, C("_x.b").alias("r_begin"), C("_x.e").alias("r_end"))


def depth_by_names(sites: DataFrame, alignments: DataFrame, keys: list[str], id_col: str, begin: str, end: str, read: str, ab: str, ae: str) -> DataFrame:
    """``id_col, depth``: distinct reads over a site, 0 where there is none."""
    s = sites.select(*keys, id_col, C(begin).alias("_b"), C(end).alias("_e"))
    a = alignments.select(*keys, C(read).alias("_read"), C(ab).alias("_ab"), C(ae).alias("_ae"))
    n = overlap_join(s, a, keys, "_b", "_e", "_ab", "_ae", measure=True).groupBy(id_col).agg(F.count_distinct("_read").alias("depth"))
    return sites.select(id_col).join(n, id_col, "left").select(id_col, F.coalesce("depth", F.lit(0).cast("bigint")).alias("depth"))


def indel_lengths(sites: DataFrame, signals: DataFrame, keys: list[str], id_col: str, begin: str, end: str, near: int = 100) -> DataFrame:
    """``id_col, max_i, max_d, near_i, near_d, reads``: largest raw I and D lengths over a site, how many
    lie within ``near`` of them, and the distinct reads."""
    di = signals.where(C("sig_type").isin("D", "I")).select(*keys, C("sig_type").alias("_t"), C("start").alias("_sb"), C("stop").alias("_se"), "read")
    s = sites.select(*keys, id_col, C(begin).alias("_b"), C(end).alias("_e"))
    hit = overlap_join(s, di, keys, "_b", "_e", "_sb", "_se", measure=True).select(id_col, "_t", (C("_se") - C("_sb")).alias("_n"), "read")
    # the pairs are made once: the largest lengths lie beside the rows of a site, which then are counted where they are
    over = Window.partitionBy(id_col)
    tops = {f"max_{t.lower()}": F.max(F.when(C("_t") == t, C("_n"))).over(over) for t in "ID"}
    close = [F.count_if((C("_t") == t) & (C("_n") >= C(f"max_{t.lower()}") - near)).alias(f"near_{t.lower()}") for t in "ID"]
    got = hit.where(C(id_col).isNotNull()).withColumns(tops).groupBy(id_col).agg(*[F.max(c).alias(c) for c in tops], F.count_distinct("read").alias("reads"), *close)
    return got.select(id_col, *tops, "reads", "near_i", "near_d")


def spanning_guard(pairs: DataFrame, alignments: DataFrame, keys: list[str], id_col: str, begin: str, end: str, read: str, ab: str, ae: str, ratio: float = 1.5, least: int = 4, slack: int = 10) -> DataFrame:
    """Pairs that long spanning reads do not contradict.

    Where at least ``least`` reads are longer than ``ratio`` times the pair, one of them has to
    end more than ``slack`` outside of it.
    """
    p = pairs.select(*keys, id_col, C(begin).alias("_b"), C(end).alias("_e"))
    a = alignments.select(*keys, C(read).alias("_read"), C(ab).alias("_ab"), C(ae).alias("_ae"))
    hit = overlap_join(p, a, keys, "_b", "_e", "_ab", "_ae", measure=True).where(C("_ae") - C("_ab") > ratio * (C("_e") - C("_b")))
    n = hit.groupBy(id_col).agg(F.count_distinct("_read").alias("_n"), F.count_if((C("_ab") < C("_b") - slack) | (C("_ae") > C("_e") + slack)).alias("_out"))
    return pairs.join(n.where((C("_n") >= least) & (C("_out") == 0)).select(id_col), id_col, "left_anti")


def reads_over(regions: DataFrame, alignments: DataFrame, keys: list[str], id_col: str, reads: str, begin: str, end: str, read: str, ab: str, ae: str) -> DataFrame:
    """Alignments of a region's own reads that overlap it: ``id_col`` and the columns of ``alignments`` but ``keys``.

    An equi join on the read, as a region knows its reads; no interval join is needed.
    """
    r = regions.select(*keys, id_col, C(begin).alias("_b"), C(end).alias("_e"), F.explode(F.array_distinct(reads)).alias(read))
    hit = r.join(alignments, [*keys, read]).where((C(ab) < C("_e")) & (C("_b") < C(ae)))
    return hit.drop("_b", "_e", *keys)


def type_totals(df: DataFrame, keys: list[str], kind: str = "sig_type") -> DataFrame:
    """Rows of each type per window or other key."""
    return df.groupBy(*keys, kind).agg(F.count("*").alias("n"))
