"""Schemas of the domain tables, as DDL."""

ALIGNMENT = (
    "sample string, contig string, ref_start bigint, ref_end bigint, q_start bigint, q_end bigint, q_len bigint, mapq int, "
    "is_reverse boolean, is_supplementary boolean, read string, cigar array<struct<op:int,len:int>>, seq string"
)
SIGNAL = "sample string, contig string, sig_type string, start bigint, stop bigint, seq string, qpos bigint, other bigint, read string, hash string, mapq int, is_reverse boolean, is_supplementary boolean, q_len bigint"
CANDIDATE = "sample string, contig string, contig2 string, pos1 bigint, pos2 bigint, svtype string, support bigint, rl1 int, rl2 int, is_sub boolean"
CALL = "sample string, contig string, pos bigint, stop bigint, svtype string, svlen bigint, alt string, support bigint, depth bigint, dr bigint, af double, gt1 string, gt2 string, pos1_std double, pos2_std double, svlen_std double, mapq_mean double, mapq_std double, svlen_median double, reads array<string>"
COMPARE = "contig string, pos1 bigint, pos2 bigint, svlen bigint, svtype string, gt string, line string"
