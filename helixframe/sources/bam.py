"""BAM files as a data source: records decoded from BGZF blocks into Arrow batches.

Files are opened by ``pyarrow.fs``, so a path may be local or the URI of an object store. With an index beside
the file (``.bai``) every partition reads the records that begin in its window of a contig. Without one a file is cut
into ranges of bytes: a partition looks for the first block that starts in its range, whose checksum proves it, then
for the first record there, by the plausibility of a chain of records, and reads the records that begin in its blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import ALIGNMENT

#: Letters of the packed sequence, and record sizes of tag types.
BASES = "=ACMGRSVTWYHKDBN"
TAG_SIZE = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
ON_REFERENCE, ON_READ, ALIGNED = (0, 2, 3, 7, 8), (0, 1, 4, 7, 8), (0, 1, 7, 8)
LINEAR = 14  # the linear index has an entry for each 2^14 bases
MAGIC = b"\x1f\x8b\x08\x04"
#: Bytes of a file without index in a partition, of records in a batch, and plausible records that prove a place.
SPLIT, BATCH_BYTES, CHAIN = 64 << 20, 4 << 20, 5
NAMES = ["sample", "contig", "ref_start", "ref_end", "q_start", "q_end", "q_len", "mapq", "is_reverse", "is_supplementary", "read", "cigar", "seq"]


def opened(path: str):
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def length(path: str) -> int:
    system, name = fs.FileSystem.from_uri(path)
    return system.get_file_info(name).size


def exists(path: str) -> bool:
    system, name = fs.FileSystem.from_uri(path)
    return system.get_file_info(name).type == fs.FileType.File


class Blocks:
    """Sequential reads of the decompressed stream from a virtual offset on."""

    def __init__(self, file, offset: int = 0):
        self.file, self.data, self.at = file, b"", 0
        #: Where the blocks in ``data`` begin: (index in data, offset in the file).
        self.starts: list[tuple[int, int]] = []
        self.next = offset >> 16
        file.seek(self.next)
        if offset & 0xFFFF and self.more():
            self.at = offset & 0xFFFF

    def more(self) -> bool:
        """Appends the next block; false at the end of the file."""
        head = self.file.read(12)
        if len(head) < 12:
            return False
        extra = self.file.read(struct.unpack_from("<H", head, 10)[0])
        size = _block_size(extra)
        if head[:2] != MAGIC[:2] or not size:
            raise ValueError("not a BGZF block")
        body = self.file.read(size - 12 - len(extra))
        gone = self.at
        self.starts = [(max(0, x - gone), y) for k, (x, y) in enumerate(self.starts) if k + 1 == len(self.starts) or self.starts[k + 1][0] > gone]
        self.starts.append((len(self.data) - gone, self.next))
        self.data, self.at = self.data[gone:] + zlib.decompress(body[:-8], -15), 0
        self.next += size
        return True

    def read(self, n: int) -> bytes:
        """``n`` bytes, fewer only at the end."""
        while len(self.data) - self.at < n:
            if not self.more():
                break
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out

    def block_of(self, ahead: int = 0) -> int | None:
        """The file offset of the block that holds the byte ``ahead`` of the next one; none at the end."""
        while self.at + ahead >= len(self.data):
            if not self.more():
                return None
        return next(y for x, y in reversed(self.starts) if x <= self.at + ahead)


def _block_size(extra: bytes) -> int:
    """The size that a block's extra field states, or 0."""
    at = 0
    while at + 4 <= len(extra):
        name, length = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
        if name == b"BC" and length == 2 and at + 6 <= len(extra):
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + length
    return 0


def first_block(file, start: int, stop: int) -> int | None:
    """The first block that begins at ``start`` or behind, but before ``stop``: its header, content and checksum fit."""
    at = start
    while at < stop:
        file.seek(at)
        data = file.read(min(stop - at, 1 << 20) + (1 << 16) + 64)  # a whole block may follow the last place
        last = min(stop - at, 1 << 20)
        x = data.find(MAGIC)
        while 0 <= x < last:
            if x + 12 <= len(data):
                n = struct.unpack_from("<H", data, x + 10)[0]
                size = _block_size(data[x + 12 : x + 12 + n])
                body = data[x + 12 + n : x + size]
                if size > 20 + n and len(body) == size - 12 - n:
                    check, length = struct.unpack("<II", body[-8:])
                    try:
                        text = zlib.decompress(body[:-8], -15)
                        if len(text) == length and zlib.crc32(text) == check:
                            return at + x
                    except zlib.error:
                        pass
            x = data.find(MAGIC, x + 1)
        at += last
    return None


def _plausible(data: bytes, at: int, contigs: list[tuple[str, int]]) -> int | None:
    """The length of a record at ``at``, if all its fields can be one's; none if they cannot; 0 if the data ends before."""
    if at + 36 > len(data):
        return 0
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, ref2, pos2, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= ref < len(contigs) and -1 <= ref2 < len(contigs) and l_name and l_seq >= 0 and size >= 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq):
        return None
    if any(p < -1 or (r >= 0 and p > contigs[r][1]) for r, p in ((ref, pos), (ref2, pos2))):
        return None
    end = at + 36 + l_name
    if end + 4 * n_cigar > len(data):
        return 0
    name = data[at + 36 : end]
    if name[-1] or any(c < 33 or c > 126 for c in name[:-1]):
        return None
    if any(data[k] & 15 > 8 for k in range(end, end + 4 * n_cigar, 4)):
        return None
    return 4 + size


def first_record(blocks: Blocks, contigs: list[tuple[str, int]], stop: int, chain: int = CHAIN) -> bool:
    """Moves the stream to the first record that begins in a block before ``stop``; false if there is none.

    A place counts where ``chain`` plausible records follow each other, or fewer up to the end of the file.
    """
    at = 0
    while (block := blocks.block_of(at)) is not None and block < stop:
        data = blocks.data[blocks.at :]
        room = len(data) - 36
        if room > at:  # places whose contig and position can be right, all at once
            raw = np.frombuffer(data, np.uint8)
            at4 = lambda k: np.ndarray(room - at, "<i4", raw, at + k, (1,))
            refs = at4(4)
            places = np.flatnonzero((refs >= -1) & (refs < len(contigs)) & (at4(0) >= 33) & (at4(24) >= -1) & (at4(24) < len(contigs))) + at
        else:
            places = np.arange(at, at + 1)
        for u in places.tolist():
            if _chained(blocks, u, contigs, chain):
                if (block := blocks.block_of(u)) is None or block >= stop:
                    return False
                blocks.at += u
                return True
        at = max(at + 1, room)
    return False


def _chained(blocks: Blocks, at: int, contigs: list[tuple[str, int]], chain: int) -> bool:
    x = at
    for k in range(chain):
        while (n := _plausible(blocks.data, blocks.at + x, contigs)) == 0:
            if not blocks.more():
                return k > 0 and blocks.at + x == len(blocks.data)
        if n is None:
            return False
        x += n
    while blocks.at + x > len(blocks.data):  # the last one has to be whole
        if not blocks.more():
            return False
    return True


def header(blocks: Blocks) -> list[tuple[str, int]]:
    """Names and lengths of the contigs; leaves the stream at the first record."""
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    found = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        found.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return found


def linear_index(raw: bytes) -> list[list[int]]:
    """Per contig, the smallest virtual offset of the records over each 2^14 bases (0: none)."""
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", raw, 4)[0]):
        (bins,) = struct.unpack_from("<i", raw, at)
        at += 4
        for _ in range(bins):
            at += 8 + 16 * struct.unpack_from("<i", raw, at + 4)[0]
        (n,) = struct.unpack_from("<i", raw, at)
        out.append(list(struct.unpack_from(f"<{n}Q", raw, at + 4)))
        at += 4 + 8 * n
    return out


def long_cigar(tags: bytes) -> list[int] | None:
    """Operations of the CG tag, which holds a CIGAR of more than 65,535 of them."""
    at = 0
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if kind in "ZH":
            at = tags.index(b"\0", at) + 1
        elif kind == "B":
            of, n = chr(tags[at]), struct.unpack_from("<i", tags, at + 1)[0]
            if name == b"CG":
                return list(struct.unpack_from(f"<{n}I", tags, at + 5))
            at += 5 + n * TAG_SIZE[of]
        else:
            at += TAG_SIZE[kind]
    return None


_FIXED = np.dtype([("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("rest", "V12")])
_LETTERS = np.frombuffer("".join(a + b for a in BASES for b in BASES).encode(), np.uint8).reshape(256, 2)
_CIGAR = pa.struct([("op", pa.int32()), ("len", pa.int32())])


def records(raws: list[bytes], contigs: list[tuple[str, int]], sample: str) -> pa.RecordBatch:
    """Records in the alignment schema, without those that are not mapped."""
    fixed = np.frombuffer(b"".join([r[:32] for r in raws]), _FIXED)
    mapped = np.flatnonzero((fixed["ref"] >= 0) & (fixed["flag"] & 4 == 0))
    fixed, raws = fixed[mapped], [raws[k] for k in mapped.tolist()]
    name_end = 32 + fixed["l_name"].astype(np.int64)
    cigar_end = name_end + 4 * fixed["n_cigar"]
    l_seq = fixed["l_seq"].astype(np.int64)
    seq_end = cigar_end + (l_seq + 1) // 2
    ops = [r[a:b] for r, a, b in zip(raws, name_end.tolist(), cigar_end.tolist())]
    for k in np.flatnonzero(fixed["n_cigar"] == 2).tolist():  # a placeholder for a CIGAR that lies in a tag
        a, b = struct.unpack("<II", ops[k])
        if a == l_seq[k] << 4 | 4 and b & 15 == 3:
            long = long_cigar(raws[k][int(seq_end[k] + l_seq[k]) :])
            ops[k] = np.array(long, "<u4").tobytes() if long else ops[k]
    n_ops = np.array([len(x) // 4 for x in ops], np.int64)
    ends = np.cumsum(n_ops)
    code = np.frombuffer(b"".join(ops), "<u4")
    kind, size = (code & 15).astype(np.int32), (code >> 4).astype(np.int32)

    def total(kinds: tuple[int, ...]) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(np.where(np.isin(kind, kinds), size, 0), dtype=np.int64)])
        return upto[ends] - upto[ends - n_ops]

    lead = np.zeros(len(raws), np.int64)
    some = n_ops > 0
    first = (ends - n_ops)[some]
    lead[some] = np.where(kind[first] == 4, size[first], 0)
    pos = fixed["pos"].astype(np.int64)

    packed = np.frombuffer(b"".join([r[a:b] for r, a, b in zip(raws, cigar_end.tolist(), seq_end.tolist())]), np.uint8)
    letters = _LETTERS[packed].reshape(-1)
    odd = l_seq % 2 == 1
    keep = np.ones(len(letters), bool)
    keep[(np.cumsum(l_seq + odd) - 1)[odd]] = False
    offsets = np.concatenate([[0], np.cumsum(l_seq)]).astype(np.int64)
    seq = pa.LargeStringArray.from_buffers(len(raws), pa.py_buffer(offsets), pa.py_buffer(letters[keep].tobytes())).cast(pa.string())
    names = pa.array([c for c, _ in contigs], pa.string())
    columns = [
        pa.array([sample] * len(raws), pa.string()), names.take(pa.array(fixed["ref"].astype(np.int64))), pos, pos + total(ON_REFERENCE), lead, lead + total(ALIGNED), total(ON_READ),
        fixed["mapq"].astype(np.int32), fixed["flag"] & 16 != 0, fixed["flag"] & 2048 != 0, pa.array([r[32:e].decode() for r, e in zip(raws, (name_end - 1).tolist())], pa.string()),
        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(kind), pa.array(size)], fields=list(_CIGAR))), pc.if_else(pa.array(l_seq == 0), "*", seq),
    ]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, NAMES)


class Window(InputPartition):
    """Records of a contig that begin in [start, stop), from a virtual offset on; with ``ref`` -1 those of the file's blocks that begin there."""

    def __init__(self, path: str, start: int, stop: int, ref: int = -1, offset: int = 0):
        self.path, self.start, self.stop, self.ref, self.offset = path, start, stop, ref, offset


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["path"].split(",") if p]
        self.sample, self.window, self.split = options.get("sample", "sample"), int(options.get("window", 1_000_000)), int(options.get("split", SPLIT))

    def partitions(self) -> list[Window]:
        found = []
        for path in self.paths:
            if not exists(path + ".bai"):
                size = length(path)
                found += [Window(path, x, min(x + self.split, size)) for x in range(0, size, self.split)]
                continue
            with opened(path) as f:
                contigs = header(Blocks(f))
            with opened(path + ".bai") as f:
                index = linear_index(f.read())
            for ref, offsets in enumerate(index):
                last = max(contigs[ref][1], len(offsets) << LINEAR)
                for start in range(0, last, self.window):
                    stop = min(start + self.window, last)
                    offset = next((x for x in offsets[start >> LINEAR : (stop - 1 >> LINEAR) + 1] if x), 0)
                    if offset:
                        found.append(Window(path, start, stop, ref, offset))
        return found or [Window("", 0, 0)]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with opened(partition.path) as f:
            held, size = [], 0
            contigs, raws = self._raw(f, partition)
            for raw in raws:
                held.append(raw)
                size += len(raw)
                if size >= BATCH_BYTES:
                    yield records(held, contigs, self.sample)
                    held, size = [], 0
            if held:
                yield records(held, contigs, self.sample)

    def _raw(self, f, window: Window) -> tuple[list[tuple[str, int]], Iterator[bytes]]:
        blocks = Blocks(f)
        contigs = header(blocks)
        return contigs, self._in_contig(Blocks(f, window.offset), window) if window.ref >= 0 else self._in_range(f, blocks, contigs, window)

    @staticmethod
    def _in_contig(blocks: Blocks, window: Window) -> Iterator[bytes]:
        while len(size := blocks.read(4)) == 4:
            raw = blocks.read(struct.unpack("<i", size)[0])
            ref, pos = struct.unpack_from("<ii", raw)
            if ref != window.ref or pos >= window.stop:
                return
            if pos >= window.start:  # else it begins in the window before
                yield raw

    @staticmethod
    def _in_range(f, blocks: Blocks, contigs: list[tuple[str, int]], window: Window) -> Iterator[bytes]:
        """``blocks`` stands behind the header, at the file's first record."""
        head = blocks.block_of()
        if head is None or head >= window.stop:
            return
        if head < window.start:
            start = first_block(f, window.start, window.stop)
            if start is None:
                return
            blocks = Blocks(f, start << 16)
            if not first_record(blocks, contigs, window.stop):
                return
        while (block := blocks.block_of()) is not None and block < window.stop:
            (size,) = struct.unpack("<i", blocks.read(4))
            raw = blocks.read(size)
            if len(raw) < size:
                raise ValueError("the file ends inside a record")
            yield raw


class BamSource(DataSource):
    """``spark.read.format("bam")``; options: path (several by commas), sample, window (bases, with an index), split (bytes, without)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return ALIGNMENT

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, path: str, sample: str = "sample", window: int = 1_000_000, split: int = SPLIT) -> DataFrame:
    """Mapped alignments of BAM files in the alignment schema (0-based, half open)."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("sample", sample).option("window", str(window)).option("split", str(split)).load(path)
