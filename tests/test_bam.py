"""BAM files written by hand: blocks, records, an index."""

import random
import struct
import zlib

import pytest

from helixframe.sources import bam, readers

OPS = "MIDNSHP=X"
SAM = [
    # flag, contig, position (1-based), mapq, cigar, sequence, name
    (0, "c1", 11, 60, "5S10M2I3M", "ACGTA" + "ACGTACGTAC" + "GG" + "TTT", "r1"),
    (16, "c1", 20_001, 30, "4M1D4M6S", "ACGTNACGTTTTTT", "r2"),
    (2048, "c1", 20_002, 9, "8=2X", "ACGTACGTAC", "r1"),
    (4, "c1", 30_000, 0, "*", "AC", "placed"),
    (0, "c1", 70_000, 60, "3H7M", "ACGTACG", "r3"),
    (0, "c2", 5, 60, "12M", "ACGTACGTACGT", "r4"),
    (4, "*", 0, 0, "*", "AC", "unmapped"),
]


def packed(row, names, long=False):
    import re

    flag, contig, pos, mapq, cigar, seq, name = row
    ops = [int(n) << 4 | OPS.index(o) for n, o in re.findall(rf"(\d+)([{OPS}])", cigar)]
    tags = b"NMi\1\0\0\0" + b"XZZsome text\0"
    if long:
        tags += b"CGBI" + struct.pack("<i", len(ops)) + struct.pack(f"<{len(ops)}I", *ops)
        ops = [len(seq) << 4 | 4, 100 << 4 | 3]
    codes = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", names.index(contig) if contig in names else -1, pos - 1, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0)
    body += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


def block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


@pytest.fixture
def files(tmp_path):
    names, text = ["c1", "c2"], "@HD\tVN:1.6\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", 2)
    for n, size in zip(names, (100_000, 1000)):
        head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    out, index = block(head), {n: {} for n in names}
    stream, size = b"", 40  # blocks of 40 bytes, so that records cross their borders
    at = []
    for k, row in enumerate(SAM):
        at.append(len(stream))
        stream += packed(row, names, long=k == 1)
    starts = {}
    for i in range(0, len(stream), size):
        starts[i] = len(out)
        out += block(stream[i : i + size])
    for row, x in zip(SAM, at):
        if row[1] in index:
            offset = starts[x // size * size] << 16 | x % size
            index[row[1]].setdefault((row[2] - 1) >> 14, offset)
    (tmp_path / "a.bam").write_bytes(out + block(b""))
    bai = b"BAI\1" + struct.pack("<i", 2)
    for n in names:
        lin = [index[n].get(w, 0) for w in range(max(index[n]) + 1)]
        bai += struct.pack("<i", 1) + struct.pack("<IiQQ", 4681, 1, 0, 1) + struct.pack("<i", len(lin)) + struct.pack(f"<{len(lin)}Q", *lin)
    (tmp_path / "a.sam").write_text(text + "".join(f"{n}\t{f}\t{c}\t{p}\t{q}\t{g}\t*\t0\t0\t{s}\t*\n" for f, c, p, q, g, s, n in SAM))
    return tmp_path, bai


def test_bam_like_sam(spark, files):
    path, bai = files
    want = sorted(map(tuple, readers.read_sam(spark, str(path / "a.sam"), "s").collect()), key=str)
    whole = bam.read_bam(spark, str(path / "a.bam"), "s")
    assert whole.rdd.getNumPartitions() == 1 and sorted(map(tuple, whole.collect()), key=str) == want and len(want) == 5
    (path / "a.bam.bai").write_bytes(bai)
    for window in (1_000_000, 20_000, 20_001, 1000):
        parts = bam.read_bam(spark, str(path / "a.bam"), "s", window)
        assert sorted(map(tuple, parts.collect()), key=str) == want
    assert parts.rdd.getNumPartitions() >= 4


def many(seed, n, contigs=("c1", "c2")):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        size = rng.choice([1, 2, 7, 30, 151, 400, 5000])
        a = rng.randint(0, size - 1)
        cigar = f"{a}S{size - a}M" if a else f"{size}M"
        flag, contig, pos = rng.choice([(0, 1), (16, 1), (2048, 1), (4, 0)])[0], rng.choice(contigs), rng.randint(1, 900)
        if rng.random() < 0.1:
            flag, contig, pos, cigar = 4, "*", 0, "*"
        rows.append((flag, contig, pos, rng.randint(0, 60), cigar, "".join(rng.choice("ACGTN") for _ in range(size)) if rng.random() < 0.95 else "", f"read/{k}" + "x" * rng.randint(0, 90)))
    return rows


def written(path, rows, block_size, names=("c1", "c2"), text="@HD\tVN:1.6\n"):
    head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(names))
    for n in names:
        head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000)
    stream = head + b"".join(packed(r, list(names)) for r in rows)
    path.write_bytes(b"".join(block(stream[i : i + block_size]) for i in range(0, len(stream), block_size)) + block(b""))


def read_ranges(path, cuts):
    """All rows of the ranges between ``cuts``, without Spark."""
    reader = bam.BamReader({"path": str(path), "sample": "s"})
    out = []
    for a, b in zip(cuts, cuts[1:]):
        for batch in reader.read(bam.Window(str(path), a, b)):
            out += batch.to_pylist()
    return out


@pytest.mark.parametrize("block_size", [50, 700, 20_000, 60_000])
def test_every_cut_gives_the_same_records(tmp_path, block_size):
    """Without an index each record belongs to exactly one range, wherever a file is cut."""
    path = tmp_path / "a.bam"
    written(path, many(block_size, 60), block_size, text="@CO\t" + "header text " * 40 + "\n")
    size = path.stat().st_size
    whole = read_ranges(path, [0, size])
    assert len(whole) > 20
    step = max(1, size // 400)
    for cut in range(0, size + 1, step):
        assert read_ranges(path, [0, cut, size]) == whole
    for n in (size, 37, 997, 4096):
        assert read_ranges(path, [*range(0, size, max(n, 37)), size]) == whole


def test_records_longer_than_ranges(tmp_path):
    path = tmp_path / "a.bam"
    rng = random.Random(3)
    rows = [(0, "c1", 1, 60, f"{n}M", "".join(rng.choice("ACGT") for _ in range(n)), f"r{n}") for n in (200_000, 5, 300_001, 7)]
    written(path, rows, 60_000)
    size = path.stat().st_size
    whole = read_ranges(path, [0, size])
    assert [len(r["seq"]) for r in whole] == [200_000, 5, 300_001, 7]
    assert read_ranges(path, [*range(0, size, 9_001), size]) == whole


def test_partitions_of_bytes(spark, files):
    path, _ = files
    want = sorted(map(tuple, bam.read_bam(spark, str(path / "a.bam"), "s").collect()), key=str)
    cut = bam.read_bam(spark, str(path / "a.bam"), "s", split=100)
    assert cut.rdd.getNumPartitions() > 4 and sorted(map(tuple, cut.collect()), key=str) == want


def test_magic_bytes_inside_a_block(tmp_path):
    """Bytes like a block's header inside stored data are no block: their checksum fails."""
    fake = block(b"x" * 50)
    stored = zlib.compressobj(0, zlib.DEFLATED, -15)
    data = fake[:-1] + b"?" + fake[:20]
    body = stored.compress(data) + stored.flush()
    real = b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))
    (tmp_path / "b").write_bytes(real + fake)
    with bam.opened(str(tmp_path / "b")) as f:
        size = len(real) + len(fake)
        assert bam.first_block(f, 0, size) == 0 and bam.first_block(f, 1, size) == len(real) and bam.first_block(f, 1, len(real)) is None


def test_not_a_bam(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(block(b"something else"))
    with pytest.raises(Exception, match="not a BAM file"):
        bam.read_bam(spark, str(tmp_path / "x.bam")).collect()
