"""N-gram Jaccard join by parity sketches.

A document's set of 5-word shingles toggles bits of a sketch, so the Hamming
distance of two sketches is at most the symmetric difference of the sets. With
Jaccard >= 0.75 that difference is at most a seventh of both sizes together. Per band of set
sizes the (wide, sparse) sketch is cut into more blocks than that, so two linked
sets agree in a block; a block's key is a 64-bit XOR code of its odd positions. A set
emits its fullest blocks, one more than may differ: the order depends on a block's content
only, so the prefixes of two linked sets meet, and blocks of several shingles seldom
agree by chance.

1. Buckets of equal codes become groups: all that share a bucket with its smallest class
   are one group. A code that is frequent in a task already is a group of its own, so its
   members never gather in one task. Equal sets are one class throughout, so copies cost
   nothing.
2. Star: every member of a group is tried against the group's smallest class (Hamming
   bound of dense sketches, then the exact sets). Verified links are contracted.
3. Members of a group that lie in different components even then are compared with each
   other, in tiles of bounded size: those with a partner within the Hamming bound are dealt
   again with their exact sets, which decide. Pairs are never written out, so a large group
   near the threshold costs comparisons, not rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIXED_BASE, Packer, components, key_groups, materialize, mix, parts, random_base, release, runs, span_hashes

WORDS, NUM, DEN = 5, 75, 100
#: Members of one side of a tile of sketches, and of a tile of sets: a group is copied once for each tile of a side.
TILE, SET_TILE = 2048, 128
#: Members of one code among the records of one flush from which the code is a group of its own.
HOT = 64
#: Candidate ids up to which they are broadcast to the texts; beyond it the texts are shuffled.
BROADCAST_ROWS = 200_000
#: Blocks a band has at least, so that small sets have more blocks with content than may differ.
MIN_BLOCKS = 64
_MUL = np.uint64(0xD6E8FEB86659FD93)
_EMPTY_GROUP = np.uint64(0x51ED270B)


def shingle_set(text: str | None, k: int = WORDS, base: int = FIXED_BASE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles (ASCII lower case, ASCII white space).

    A shingle is hashed as a span of the words joined by one space. With a random ``base`` no text can be
    made to have two shingles of one hash.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    gap = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], gap + 1]), np.append(gap, len(data))
    k = min(len(start), k)
    return np.unique(mix(span_hashes(data, start[: len(start) - k + 1], end[k - 1 :], base)))


def class_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs; the first is never 0."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return int(np.uint64(h & ((1 << 64) - 1)).astype(np.int64)) or 1, int(np.uint64(h >> 64).astype(np.int64))


def band(n: int) -> int:
    return n.bit_length() - 1


def sketch_bits(n: int) -> int:
    """Bits of the dense sketch of a set of n: a power of two, at least four times the band's largest size."""
    return max(64, 8 << band(n))


def dense_sketch(s: np.ndarray) -> bytes:
    m = sketch_bits(len(s))
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def block_codes(s: np.ndarray) -> np.ndarray:
    """Bucket keys of a set: its blocks in its own band, and in the next one if a linked set can lie there."""
    n = len(s)
    out = []
    g = band(n)
    for b in (g, g + 1) if NUM * (2 << g) <= DEN * n else (g,):
        top = (2 << b) - 1
        blocks = max(MIN_BLOCKS, (5 * (2 * top // 7 + 1)) // 4 + 1)
        most = (n + min(top, DEN * n // NUM)) // 7
        part = (mix(s, 10 + b) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(part)
        starts, sizes = runs(part[order])
        code = np.bitwise_xor.reduceat(mix(s, 100)[order], starts)
        keys = mix(code + part[order][starts].astype(np.uint64) * _MUL, 200 + b)
        if len(keys) > most:  # enough blocks with content: the fullest of both sets must meet
            out.append(keys[np.lexsort((keys, -sizes))[: most + 1]] if len(keys) > most + 1 else keys)
        else:  # agreement may be in blocks that are empty in both
            empty = np.setdiff1d(np.arange(blocks), part)
            out += [keys, mix(empty.astype(np.uint64) * _MUL, 200 + b)]
    return np.concatenate(out)


def _sets(docs: DataFrame, make, pack) -> DataFrame:
    """``doc_id, n, h1, h2, sketch``: set size, class and dense sketch of every row; with ``pack`` its ``set`` too."""
    names = ["doc_id", "n", "h1", "h2", "sketch"] + ["set"] * bool(pack)

    def run(batches):
        for b in batches:
            n, h1, h2, sk, kept = [], [], [], [], []
            for t in b.column(1).to_pylist():
                s = make(t)
                n.append(len(s))
                x, y = class_hash(s)
                h1.append(x)
                h2.append(y)
                sk.append(dense_sketch(s) if len(s) else b"")
                if pack:
                    kept.append(pack(s))
            longs = [pa.array(c, pa.int64()) for c in (n, h1, h2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *longs, pa.array(sk, pa.binary()), *([pa.array(kept, pa.binary())] if pack else [])], names)

    schema = "doc_id long, n long, h1 long, h2 long, sketch binary" + (", set binary" if pack else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _hot(cols: list[np.ndarray], limit: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Splits sorted distinct (code, class) records: those that stay, with a mark (class 0) for
    every code that is frequent here, and the members of such codes."""
    starts, lens = runs(cols[0])
    many = lens > limit
    if not many.any():
        return cols, []
    inside = np.repeat(many, lens)
    marks = cols[0][starts[many]]
    stay = [np.concatenate([cols[0][~inside], marks]), np.concatenate([cols[1][~inside], np.zeros(len(marks), np.int64)])]
    return stay, [c[inside] for c in cols]


def _group_of(code: np.ndarray) -> np.ndarray:
    return mix(code ^ _EMPTY_GROUP, 7).view(np.int64)


def _groups(rows: DataFrame, make, codes, unpacked) -> DataFrame:
    """``g, h``: distinct members of groups; two classes that share a bucket are in one group, or both in its star.

    ``rows``: texts, or packed sets that ``unpacked`` reads.
    """
    p, hot = parts(rows.sparkSession), HOT

    def deal(batches):
        pack = Packer(4 * p, limit=300_000, distinct=True, split=lambda cols: _hot(cols, hot))
        for b in batches:
            for t in b.column(0).to_pylist():
                s = unpacked(t) if unpacked else make(t)
                if len(s):
                    k = codes(s)
                    yield from pack.add(k, np.full(len(k), class_hash(s)[0], np.int64))
        yield from pack.flush()

    def send(g, h):
        for i in range(0, len(g), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(g[i : i + 100_000]), pa.array(h[i : i + 100_000])], ["g", "h"])

    def meet(batches):
        kept: list[list[bytes]] = [[], []]
        for b in batches:
            for bucket, x, y in zip(*(b.column(k).to_pylist() for k in ("bucket", "c0", "c1"))):
                if bucket < 0:  # members of codes that are groups of their own
                    yield from send(_group_of(np.frombuffer(x, np.uint64)), np.frombuffer(y, np.int64))
                else:
                    kept[0].append(x)
                    kept[1].append(y)
        k, c = np.frombuffer(b"".join(kept[0]), np.uint64), np.frombuffer(b"".join(kept[1]), np.int64)
        kept.clear()
        if not len(k):
            return
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
        keep = np.ones(len(k), bool)
        keep[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        k, c = k[keep], c[keep]
        starts, lens = runs(k)
        marked = np.bincount(np.repeat(np.arange(len(starts)), lens)[c == 0], minlength=len(starts)) > 0
        own = np.repeat(marked, lens)
        yield from send(_group_of(k[own & (c != 0)]), c[own & (c != 0)])
        many = np.repeat(~marked & (lens > 1), lens)
        g, h = np.repeat(c[starts], lens)[many], c[many]
        order = np.lexsort((h, g))
        g, h = g[order], h[order]
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
        yield from send(g[keep], h[keep])

    dealt = rows.mapInArrow(deal, Packer.schema(2))
    return dealt.repartitionById(p, F.pmod("bucket", F.lit(p))).mapInArrow(meet, "g long, h long").distinct()


def _fold(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, the longer ones folded by XOR to ``size`` bytes."""
    out = np.empty((len(sketches), size // 8), np.uint64)
    for i, x in enumerate(sketches):
        a = np.frombuffer(x, np.uint64)
        out[i] = np.bitwise_xor.reduce(a.reshape(-1, size // 8), axis=0)
    return out


def may_link(na, nb, distance) -> np.ndarray:
    """Sizes and a lower bound of the symmetric difference leave Jaccard >= NUM / DEN possible."""
    na, nb = np.asarray(na, np.int64), np.asarray(nb, np.int64)
    union2 = na + nb + distance  # twice the smallest union
    return (DEN * (na + nb - distance) >= NUM * union2) & (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb))


def near_pairs(n: np.ndarray, sketches: list[bytes], allowed) -> list[tuple[int, np.ndarray]]:
    """``(x, others)`` that pass the Hamming bound; ``allowed(x, others)`` is a mask.

    Linked sets differ by less than a third in size, so their sketches are of one length or
    one is twice the other, which is then folded once.
    """
    size = np.array([len(s) for s in sketches])
    found = []
    for length in np.unique(size):
        for other_length in (length, 2 * length):
            same = other_length == length
            rows, cols = np.flatnonzero(size == length), np.flatnonzero(size == other_length)
            if not len(rows) or not len(cols):
                continue
            f = _fold([sketches[i] for i in cols], int(length))
            mine = f if same else _fold([sketches[i] for i in rows], int(length))
            for k, x in enumerate(rows):
                ok = np.flatnonzero(allowed(x, cols) & ((cols > x) if same else True))
                if len(ok):
                    d = np.bitwise_count(f[ok] ^ mine[k]).sum(1).astype(np.int64)
                    ok = ok[may_link(n[cols[ok]], n[x], d)]
                    if len(ok):
                        found.append((int(x), cols[ok]))
    return found


def near_tops(n: np.ndarray, sketches: list[bytes], top: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """``(x, others)`` that pass the Hamming bound for every x of ``top`` with all that are not: linear in a star's length."""
    size = np.array([len(s) for s in sketches])
    found = []
    for x in np.flatnonzero(top):
        for length in (size[x] // 2, size[x], 2 * size[x]):
            others = np.flatnonzero((size == length) & ~top & (DEN * np.minimum(n, n[x]) >= NUM * np.maximum(n, n[x])))
            if len(others):
                short = int(min(length, size[x]))
                d = np.bitwise_count(_fold([sketches[i] for i in others], short) ^ _fold([sketches[x]], short)).sum(1).astype(np.int64)
                others = others[may_link(n[others], n[x], d)]
                if len(others):
                    found.append((int(x), others))
    return found


def _tile_of(x: str, count) -> F.Column:
    return F.pmod(F.xxhash64(x), count).cast("int")


def _star(members: DataFrame, p: int) -> DataFrame:
    """Pairs of a group's first class and another member that pass the Hamming bound."""
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    rest = members.where("h <> top").select("g", _tile_of("rep", tiles).alias("i"), F.lit(1).alias("kind"), "rep", "n", "sketch")
    tops = members.where("h = top").select("g", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("i"), F.lit(0).alias("kind"), "rep", "n", "sketch")

    def run(batches):
        for t in key_groups(batches, ["g", "i"]):
            kind, rep, n = (t.column(c).to_numpy() for c in ("kind", "rep", "n"))
            top = kind == 0
            found = near_tops(n, t.column("sketch").to_pylist(), top)
            if found:
                x, y = np.concatenate([np.full(len(o), i) for i, o in found]), np.concatenate([o for _, o in found])
                a, b = np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])
                cols = [c[a != b] for c in (a, b, np.full(len(x), t.column("g")[0].as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "g"])

    dealt = rest.union(tops).repartition(p, "g", "i").sortWithinPartitions("g", "i")
    return dealt.mapInArrow(run, "a long, b long, g long").groupBy("a", "b").agg(F.min("g").alias("g"))


_TILED = "g long, lo int, hi int, i int, rep long, label long, n long, sketch binary"


def _in_tiles(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list]:
    """Members and labels of a tile, and its pairs across components that pass the Hamming bound."""
    rep, label, n, i = (t.column(c).to_numpy() for c in ("rep", "label", "n", "i"))
    own = t.column("lo")[0] == t.column("hi")[0]
    if label.min() == label.max():
        return rep, label, []
    cross = lambda x, o: (label[o] != label[x]) & (own | (i[o] != i[x]))
    return rep, label, near_pairs(n, t.column("sketch").to_pylist(), cross)


def _crossing(members: DataFrame, comp: DataFrame, p: int) -> DataFrame:
    """Members of tiles of bounded size with a partner of another component within the Hamming bound."""
    named = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
    named = named.select("g", "m", "rep", "label", "n", "sketch")
    still = named.groupBy("g").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("g")
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    dealt = named.join(still, "g", "left_semi").withColumn("i", _tile_of("rep", tiles)).withColumn("j", F.explode(F.sequence(F.lit(0), tiles - 1)))
    dealt = dealt.select("g", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "rep", "label", "n", "sketch")

    def run(batches):
        for t in key_groups(batches, ["g", "lo", "hi"]):
            _, _, found = _in_tiles(t)
            if found:
                wanted = np.unique(np.concatenate([[x for x, _ in found], *(o for _, o in found)]))
                yield from t.take(pa.array(wanted)).to_batches()

    return dealt.repartition(p, "g", "lo", "hi").sortWithinPartitions("g", "lo", "hi").mapInArrow(run, _TILED)


def _linked(tiled: DataFrame, sets: DataFrame, p: int) -> DataFrame:
    """``a, b``: labels that are linked by the exact sets of two members of a tile (a spanning forest of each tile)."""

    def run(batches):
        for t in key_groups(batches, ["g", "lo", "hi"]):
            rep, label, found = _in_tiles(t)
            raw = t.column("set").to_pylist()
            root = {int(x): int(x) for x in np.unique(label)}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            links = []
            for x, others in found:
                for y in others.tolist():
                    u, v = find(int(label[x])), find(int(label[y]))
                    if u != v and reaches(np.frombuffer(raw[x], np.uint64), np.frombuffer(raw[y], np.uint64)):
                        root[max(u, v)] = min(u, v)
                        links.append((u, v))
            if links:
                u, v = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["a", "b"])

    dealt = tiled.join(sets, "rep").select("g", "lo", "hi", "i", "rep", "label", "n", "sketch", "set")
    return dealt.repartition(p, "g", "lo", "hi").sortWithinPartitions("g", "lo", "hi").mapInArrow(run, "a long, b long").distinct()


def _sets_of(reps: DataFrame, rows: DataFrame, make, unpacked, had: DataFrame | None = None) -> DataFrame:
    """``rep, set`` of the documents ``rep`` that ``had`` has not, from ``rows`` of doc_id and text or packed set."""
    wanted = reps.distinct()
    wanted = materialize(wanted if had is None else wanted.join(had.select("rep"), "rep", "left_anti"), "parity-wanted")

    def run(batches):
        for t in batches:
            sets = [(unpacked(x) if unpacked else make(x)).tobytes() for x in t.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(sets, pa.binary())], ["rep", "set"])

    small = wanted.count() <= BROADCAST_ROWS
    found = rows.withColumnRenamed("doc_id", "rep").join(F.broadcast(wanted) if small else wanted, "rep")
    out = materialize(found.select("rep", rows.columns[1]).mapInArrow(run, "rep long, set binary"), "parity-sets")
    release(wanted)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, p: int) -> DataFrame:
    """``a, b`` of the pairs whose exact sets reach the threshold.

    Pairs of a group are dealt to tiles, so a set travels once for each tile and not for each pair.
    """
    ends = lambda t: t.withColumn("x", F.explode(F.array("a", "b")))
    size = ends(pairs).select("g", "x").distinct().groupBy("g").agg(F.ceil(F.count("*") / SET_TILE).cast("int").alias("tiles"))
    tiled = pairs.join(size, "g").withColumn("i", _tile_of("a", F.col("tiles"))).withColumn("j", _tile_of("b", F.col("tiles")))
    carried = ends(tiled).select("g", "i", "j", "x").distinct().join(sets.withColumnRenamed("rep", "x"), "x")
    rows = carried.select("g", "i", "j", F.lit(0).alias("kind"), F.col("x").alias("a"), F.lit(None).cast("long").alias("b"), "set")
    rows = rows.union(tiled.select("g", "i", "j", F.lit(1), "a", "b", F.lit(None).cast("binary")))

    def run(batches):
        for t in key_groups(batches, ["g", "i", "j"]):
            kind = t.column("kind").to_numpy()
            own, asked = t.filter(pa.array(kind == 0)), t.filter(pa.array(kind == 1))
            held: dict[int, list[np.ndarray]] = {}
            for x, s in zip(own.column("a").to_pylist(), own.column("set").to_pylist()):
                held.setdefault(x, []).append(np.frombuffer(s, np.uint64))
            ok = [any(reaches(u, v) for u in held[a] for v in held[b]) for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist())]
            yield from asked.filter(pa.array(ok, pa.bool_())).select(["a", "b"]).to_batches()

    dealt = rows.repartition(p, "g", "i", "j").sortWithinPartitions("g", "i", "j", "kind")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def reaches(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard of two sorted distinct sets is at least NUM / DEN."""
    if not len(a) or not len(b) or DEN * min(len(a), len(b)) < NUM * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def jaccard_components(docs: DataFrame, make=None, codes=block_codes, packing=None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per input row; documents link at Jaccard >= 0.75.

    component_id is the smallest doc_id reachable by links. Null, empty and blank texts
    have an empty set and link with nothing; fewer than five words are one shingle;
    repeated rows are copies of each other. Rows that share a doc_id are one document, which
    links wherever one of its texts does. A row without doc_id gets a null component and
    links with nothing. Columns other than ``doc_id`` and ``text`` are not read.
    ``make(text)`` builds another set (sorted distinct uint64) than word shingles, which are hashed at a base of this run's own; ``codes(set)``
    gives other bucket keys, of which two linked sets must share one. ``packing`` (set to bytes, bytes to
    set) keeps the sets in a table, for sets that are small beside their texts; without it texts are read again.
    """
    p = parts(docs.sparkSession)
    pack, unpacked = packing or (None, None)
    make = make or partial(shingle_set, base=random_base())
    sets = materialize(_sets(docs, make, pack), "parity-rows")
    texts = (sets if packing else docs).where(F.col("doc_id").isNotNull())
    texts = texts.select("doc_id", "set") if packing else texts.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    live = sets.where("n > 0 and doc_id is not null")
    classes = materialize(live.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "parity-classes")
    rows = live.select("doc_id", "h1", "h2").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("doc_id", "rep")
    several = rows.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    shared = rows.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))

    groups = materialize(_groups(texts.select(texts.columns[1]), make, codes, unpacked), "parity-groups")
    size = groups.groupBy("g").agg(F.count("*").alias("m"), F.min("h").alias("top"))
    known = classes.select(F.col("h1").alias("h"), "rep", "n", "sketch")
    members = materialize(groups.join(size, "g").join(known, "h").select("g", "m", "top", "h", "rep", "n", "sketch"), "parity-members")
    release(groups)

    pairs = materialize(_star(members, p), "parity-pairs")
    exact = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")), texts, make, unpacked)
    links = materialize(_verified(pairs, exact, p).union(shared), "parity-links")
    first = materialize(components(links), "parity-first")

    crossing = materialize(_crossing(members, first, p), "parity-crossing")
    release(members, pairs)
    further = _sets_of(crossing.select("rep"), texts, make, unpacked, exact)
    more = materialize(_linked(crossing, exact.union(further), p), "parity-links")
    release(exact, further, crossing)
    second = materialize(components(more), "parity-second")

    label = classes.select("h1", "h2", "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
    label = label.drop("component").join(second.withColumnRenamed("node", "label"), "label", "left")
    label = label.select("h1", "h2", F.coalesce("component", "label").alias("component_id"))
    found = sets.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(label, ["h1", "h2"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    out = materialize(found.select("doc_id", "n_shingles", own.alias("component_id")), "parity-result")
    release(sets, classes, links, more, first, second)
    return out
