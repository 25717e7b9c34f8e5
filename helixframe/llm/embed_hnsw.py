"""Embedding near-dedup with hierarchical navigable small-world graphs.

Vectors of a label are dealt to shards of bounded size; each shard gets one graph.
Every block of queries is searched in every shard of its label. Per shard and block
an audit of some queries against brute force widens the beam until recall passes.
Hits are verified by cosine in double precision, counted, and the links of a shard
and block reduced to a spanning forest before they leave the task; the forests'
union gives the components. Equal vectors enter a graph once, with their number.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, parts, release

THRESHOLD = 0.93
SHARD = 2000
#: Query blocks that meet a graph in one task.
CHUNK = 8
DEGREE, BUILD_BEAM, BEAM = 12, 40, 24
AUDIT, RECALL = 24, 0.98


class Graph:
    """A small-world graph over unit vectors (float32, by inner product)."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM):
        self.x, self.m, n = x, degree, len(x)
        u = (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(float) / 2**53
        self.level = np.minimum((-np.log(1 - u * 0.999999999) / np.log(degree)).astype(int), 8)
        self.links: list[list[list[int]]] = [[[] for _ in range(lv + 1)] for lv in self.level]
        self.entry = 0
        for i in range(1, n):
            self._insert(i, beam)

    def _near(self, q: np.ndarray, starts: list[tuple[float, int]], beam: int, layer: int, floor: float = 2.0) -> list[tuple[float, int]]:
        """Beam search in a layer: (similarity, node) best first; nodes at ``floor`` or above never stop it or fall out."""
        x, links = self.x, self.links
        seen = {i for _, i in starts}
        todo = [(-s, i) for s, i in starts]
        heapq.heapify(todo)
        best = list(starts)
        heapq.heapify(best)
        sure: list[tuple[float, int]] = []
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= beam and -s < best[0][0] and -s < floor:
                break
            new = [j for j in links[i][layer] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for t, j in zip((x[new] @ q).tolist(), new):
                if len(best) < beam or t > best[0][0] or t >= floor:
                    heapq.heappush(todo, (-t, j))
                    heapq.heappush(best, (t, j))
                    if len(best) > beam:
                        low = heapq.heappop(best)
                        if low[0] >= floor:
                            sure.append(low)
        return sorted(best + sure, reverse=True)

    def _choose(self, found: list[tuple[float, int]], m: int) -> list[int]:
        """Diverse neighbours first, then the nearest of the rest."""
        nodes = [j for _, j in found]
        if len(nodes) <= m:
            return nodes
        v = self.x[nodes]
        sim = v @ v.T
        kept: list[int] = []
        for k, (s, _) in enumerate(found):
            if len(kept) < m and (not kept or sim[k, kept].max() < s):
                kept.append(k)
        taken = set(kept)
        kept += [k for k in range(len(nodes)) if k not in taken][: m - len(kept)]
        return [nodes[k] for k in kept]

    def _descend(self, q: np.ndarray, layer: int) -> list[tuple[float, int]]:
        at = [(float(self.x[self.entry] @ q), self.entry)]
        for lv in range(self.level[self.entry], layer, -1):
            at = self._near(q, at, 1, lv)[:1]
        return at

    def _insert(self, i: int, beam: int) -> None:
        q, top = self.x[i], self.level[i]
        at = self._descend(q, min(top, self.level[self.entry]))
        for lv in range(min(top, self.level[self.entry]), -1, -1):
            at = self._near(q, at, beam, lv)
            most = self.m * 2 if lv == 0 else self.m
            for j in self._choose(at[:beam], self.m):
                self.links[i][lv].append(j)
                back = self.links[j][lv]
                back.append(i)
                if len(back) > most:
                    s = self.x[back] @ self.x[j]
                    order = np.argsort(-s)
                    self.links[j][lv] = self._choose([(float(s[k]), back[k]) for k in order], most)
        if top > self.level[self.entry]:
            self.entry = i

    def search(self, q: np.ndarray, beam: int, floor: float) -> list[int]:
        """Nodes with similarity of about ``floor`` or more."""
        return [j for s, j in self._near(q, self._descend(q, 0), beam, 0, floor) if s >= floor]


def _audited(x: np.ndarray, q: np.ndarray, least: float, reps: np.ndarray, own: np.ndarray) -> list[tuple[int, set[int]]]:
    """Up to ``AUDIT`` queries that have a partner other than themselves in the shard, with all of these partners.

    Queries are tried in a fixed random order until enough are found, so fewer mean that there are no more.
    """
    found: list[tuple[int, set[int]]] = []
    order = np.random.default_rng(len(q)).permutation(len(q))
    for at in range(0, len(q), 256):
        tried = order[at : at + 256]
        hit = x @ q[tried].T >= least - 1e-9
        hit &= reps[:, None] != own[tried][None, :]
        found += [(int(tried[k]), set(np.flatnonzero(hit[:, k]).tolist())) for k in np.flatnonzero(hit.any(axis=0))]
        if len(found) >= AUDIT:
            break
    return found[:AUDIT]


def _search_block(graph: Graph, x: np.ndarray, q: np.ndarray, least: float, reps: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Verified neighbours (cosine in double) of every query, with the beam that passed the audit.

    The audit takes queries with partners in the shard, and where no query has one, nothing is
    to be found. At a beam as wide as the shard the search is exhaustive along the graph, and
    then brute force takes over.
    """
    q32, floor = q.astype(np.float32), least - 1e-5
    truth = _audited(x, q, least, reps, own)
    if not truth:
        return [np.empty(0, np.int64)] * len(q)
    beam = BEAM
    while beam < len(x):
        hit = sum(len(t & set(graph.search(q32[i], beam, floor))) for i, t in truth)
        if hit >= RECALL * sum(len(t) for _, t in truth):
            break
        beam *= 2
    out = []
    for i in range(len(q)):
        c = np.array(graph.search(q32[i], beam, floor), np.int64) if beam < len(x) else np.arange(len(x))
        out.append(c[x[c] @ q[i] >= least])
    return out


def _unit(batches):
    """``label, vid, h, x``: usable vectors as unit doubles, h identifies equal ones."""
    for b in batches:
        rows = []
        for i, label, v in zip(*(b.column(k).to_pylist() for k in range(3))):
            if v is None or label is None or i is None or not v or any(e is None for e in v):
                continue
            a = np.asarray(v, float)
            if not np.isfinite(a).all() or not (norm := np.sqrt((a * a).sum())):
                continue
            if not np.isfinite(norm) or norm < 1e-150:
                a = a / np.abs(a).max()
                norm = np.sqrt((a * a).sum())
            x = (a / norm).tobytes()
            rows.append((label, i, np.uint64(xxhash.xxh3_64_intdigest(np.asarray(v, float).tobytes())).astype(np.int64), x))
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["label", "vid", "h", "x"])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indexes of links that form a spanning forest."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
            kept.append(k)
    return kept


def near_duplicates(vectors: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding, label``.

    Rows link when their labels are equal and not null and their cosine is at least
    ``least``; vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, and vectors of different lengths do not link. Repeated rows of
    one vec_id count as one vector (the smallest row's) and are returned as often.
    """
    p = parts(vectors.sparkSession)
    src = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    unit = src.mapInArrow(lambda bs: _unit(pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2)], ["a", "b", "c"]) for b in bs), "label string, vid long, h long, x binary")
    single = unit.groupBy("vid").agg(F.min(F.struct("label", "h", "x")).alias("r")).select("r.*", "vid").withColumn("label", F.concat_ws(":", "label", F.octet_length("x")))
    classes = materialize(single.groupBy("label", "h", "x").agg(F.min("vid").alias("rep"), F.count("*").alias("copies")), "hnsw-classes")
    members = single.join(classes.select("label", "h", "x", "rep", "copies"), ["label", "h", "x"]).select("vid", "rep", "copies")

    size = classes.groupBy("label").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    dealt = classes.join(size, "label").withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))

    def pack(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).to_pandas().sort_values(["label", "shard", "rep"])
        for (label, shard, shards), g in t.groupby(["label", "shard", "shards"], sort=False):
            yield pa.RecordBatch.from_pydict(
                {"label": [label], "shard": pa.array([shard], pa.int32()), "shards": pa.array([shards], pa.int32()), "reps": [g["rep"].to_numpy(np.int64).tobytes()], "copies": [g["copies"].to_numpy(np.int64).tobytes()], "xs": [b"".join(g["x"])]}
            )

    blocks = dealt.select("label", "shard", "shards", "rep", "copies", "x").repartition(p, "label", "shard").mapInArrow(pack, "label string, shard int, shards int, reps binary, copies binary, xs binary")
    blocks = materialize(blocks, "hnsw-shards")

    def build(batches):
        for b in batches:
            for r in b.to_pylist():
                n = len(r["reps"]) // 8
                g = Graph(np.frombuffer(r["xs"]).reshape(n, -1).astype(np.float32))
                flat = [np.array([len(l) for i in range(n) for l in g.links[i]], np.int32), np.array([j for i in range(n) for l in g.links[i] for j in l], np.int32)]
                yield pa.RecordBatch.from_pydict(
                    {"label": [r["label"]], "shard": pa.array([r["shard"]], pa.int32()), "shards": pa.array([r["shards"]], pa.int32()), "entry": pa.array([g.entry], pa.int32()), "level": [g.level.astype(np.int32).tobytes()], "sizes": [flat[0].tobytes()], "links": [flat[1].tobytes()], "reps": [r["reps"]], "copies": [r["copies"]], "xs": [r["xs"]]}
                )

    graphs = materialize(
        blocks.repartition(4 * p, "label", "shard").mapInArrow(build, "label string, shard int, shards int, entry int, level binary, sizes binary, links binary, reps binary, copies binary, xs binary"), "hnsw-graphs"
    )

    def load(r) -> tuple[Graph, np.ndarray]:
        x = np.frombuffer(r["xs"]).reshape(len(r["reps"]) // 8, -1)
        g = Graph.__new__(Graph)
        g.x, g.m, g.level, g.entry = x.astype(np.float32), DEGREE, np.frombuffer(r["level"], np.int32), r["entry"]
        flat, sizes = np.frombuffer(r["links"], np.int32).tolist(), np.frombuffer(r["sizes"], np.int32).tolist()
        g.links, at, k = [], 0, 0
        for lv in g.level.tolist():
            own = []
            for _ in range(lv + 1):
                own.append(flat[at : at + sizes[k]])
                at += sizes[k]
                k += 1
            g.links.append(own)
        return g, x

    def search(batches):
        g = x = r = None
        for b in batches:
            for row in b.to_pylist():
                if row["kind"] == 0:
                    r = row
                    g, x = load(r)
                    reps, copies = np.frombuffer(r["reps"], np.int64), np.frombuffer(r["copies"], np.int64)
                    continue
                q = np.frombuffer(row["xs"]).reshape(len(row["reps"]) // 8, -1)
                own, own_copies = np.frombuffer(row["reps"], np.int64), np.frombuffer(row["copies"], np.int64)
                found = _search_block(g, x, q, least, reps, own)
                a = np.concatenate([np.full(len(c), i) for i, c in enumerate(found)] or [np.empty(0, np.int64)]).astype(np.int64)
                c = np.concatenate(found or [np.empty(0, np.int64)]).astype(np.int64)
                if row["q_shard"] == r["shard"]:  # each pair once, from whichever side it was found
                    pair = np.unique(np.stack([np.minimum(a, c), np.maximum(a, c)], 1)[a != c], axis=0)
                    a, c = pair[:, 0], pair[:, 1]
                # a link counts for both of its ends, however it was found
                n_own, n_reps = np.bincount(a, copies[c], len(own)).astype(np.int64), np.bincount(c, own_copies[a], len(reps)).astype(np.int64)
                every, code = np.unique(np.concatenate([own, reps]), return_inverse=True)
                kept = _forest(len(every), code[a], code[len(own) + c])
                for ids, n in ((own, n_own), (reps, n_reps)):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(ids[n > 0]), pa.array(n[n > 0])], ["a", "b", "n"])
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(own[a[kept]]), pa.array(reps[c[kept]]), pa.array(np.zeros(len(kept), np.int64))], ["a", "b", "n"])

    # Two shards meet once: the blocks of the lower one query the graph of the higher one. A graph travels once for CHUNK blocks.
    key = ["label", "shard", "chunk"]
    chunks = F.sequence(F.lit(0), F.floor(F.col("shard") / CHUNK).cast("int"))
    own = [c for c in graphs.columns if c not in ("label", "shard", "shards")]
    held = graphs.select("label", "shard", F.explode(chunks).alias("chunk"), F.lit(0).alias("kind"), F.lit(-1).alias("q_shard"), *own)
    asked = blocks.select("label", F.explode(F.sequence("shard", F.col("shards") - 1)).alias("shard"), F.floor(F.col("shard") / CHUNK).cast("int").alias("chunk"), F.lit(1).alias("kind"), F.col("shard").alias("q_shard"), "reps", "copies", "xs")
    work = held.unionByName(asked, allowMissingColumns=True).repartition(4 * p, *key).sortWithinPartitions(*key, "kind", "q_shard")
    hits = materialize(work.mapInArrow(search, "a long, b long, n long"), "hnsw-hits")
    release(blocks, graphs)
    near = hits.where("a = b").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    comp = components(hits.where("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    final = members.join(near, "rep", "left").join(comp, "rep", "left").select(
        F.col("vid"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = src.select("vec_id").join(final, F.col("vec_id") == F.col("vid"), "left")
    out = out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept")
    )
    out = materialize(out, "hnsw-result")
    release(classes, hits)
    return out
