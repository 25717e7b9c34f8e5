"""Hard-negative mining with vantage-point trees over norm-augmented vectors.

A vector x gets one more coordinate, sqrt(M^2 - |x|^2) for the largest norm M, and an anchor q gets 0 there:
|q - x|^2 = |q|^2 + M^2 - 2 qx. So a window of scores is an annulus of distances around the anchor,
and the highest score is the nearest vector.

A top tree, fitted on a bounded sample, sends every vector to one of at most 256 cells; a cell's vectors lie in
pieces of bounded size, kept apart by label where a label is large, and each piece is a tree of its own. An anchor first
asks the cell nearest to it, then only cells where something better than its k-th find can be. Inside
a piece it goes to the nearest part of its annuli first and stops when no open part can hold a better one.
Scores are exact integers, and bounds give way by more than rounding can err, so nothing is missed.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_groups, materialize, parts, release

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SCALE = 256
#: Vectors in a piece, in a leaf, cells at most, vectors that the top tree is fitted on at most.
PIECE, LEAF, CELLS, SAMPLE = 4096, 128, 256, 16_384
#: Questions that a task holds before they leave it.
ROWS = 8192
#: Questions that meet a piece in one task, pieces that a question meets in one task.
CHUNK, GROUP = 4096, 8
#: Larger components count as this, so that scores of up to 512 components fit a long.
LIMIT = 1 << 27
_FAR = 1 << 62


class Tree:
    """A vantage-point tree over augmented integer vectors.

    ``node``: rows of (vantage row, near child, far child), or (-1, first row, end) for a leaf; ``radius``: the distances to the
    vantage point of the near child's rows (least, most), then of the far child's. ``order`` sorts the rows such that leaves are contiguous.
    """

    def __init__(self, x: np.ndarray, most: int, leaf: int):
        x = x.astype(np.float64)
        n2 = (x * x).sum(1)
        lift = np.sqrt(np.maximum(most - n2, 0))
        self.node: list[tuple[int, int, int]] = []
        self.radius: list[tuple[float, float, float, float]] = []
        order: list[np.ndarray] = []
        placed = 0
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.node)
            if parent >= 0:
                kept = list(self.node[parent])
                kept[side] = at
                self.node[parent] = tuple(kept)
            split = None
            if len(rows) > leaf:
                middle = x[rows].mean(0)
                far = rows[np.argmax(((x[rows] - middle) ** 2).sum(1) + (lift[rows] - lift[rows].mean()) ** 2)]
                d = np.sqrt(np.maximum(n2[rows] + n2[far] - 2 * (x[rows] @ x[far]) + (lift[rows] - lift[far]) ** 2, 0))
                near = d <= np.median(d)
                if not near.all():
                    split = rows[near], rows[~near], (d[near].min(), d[near].max(), d[~near].min(), d[~near].max()), far
            if split is None:
                self.node.append((-1, placed, placed + len(rows)))
                self.radius.append((0.0, 0.0, 0.0, 0.0))
                order.append(rows)
                placed += len(rows)
            else:
                self.node.append((int(split[3]), -1, -1))
                self.radius.append(tuple(map(float, split[2])))
                todo += [(split[1], at, 2), (split[0], at, 1)]
        self.order = np.concatenate(order) if order else np.empty(0, np.int64)

    def vantages(self) -> list[int]:
        return [v for v, _, _ in self.node if v >= 0]


def _distances(q: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Distances of an anchor to augmented vectors."""
    return np.sqrt(np.maximum((q * q).sum() + most - 2 * (v @ q), 0))


class Piece:
    """The vectors of a piece in the order of its tree's leaves, with labels and the first ids of equal vectors."""

    def __init__(self, x: np.ndarray, labels: list[str], ids: list[list[int]], most: int):
        tree = Tree(x, most, LEAF)
        o = tree.order.tolist()
        self.most, self.node, self.radius = most, tree.node, tree.radius
        self.vantage = x[tree.vantages()].astype(np.float64) if tree.vantages() else np.empty((0, x.shape[1]))
        self.x = x[tree.order]
        self.names = sorted(set(labels))
        code = {name: k for k, name in enumerate(self.names)}
        self.label = np.array([code[labels[k]] for k in o], np.int64)
        self.size = np.array([len(ids[k]) for k in o], np.int64)
        self.ids = np.array([i for k in o for i in ids[k]], np.int64)

    def ready(self) -> None:
        self.x = self.x.astype(np.float64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.code = {name: k for k, name in enumerate(self.names)}

    def search(self, q: np.ndarray, own: int, label: str, same: bool, windows: list[tuple[int, int, int]], k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """``(window, scores, ids)``: the first ``k`` by score, then id, in every window ``(window, lowest, highest)``."""
        mine = self.code.get(label, -1)
        if (mine < 0) if same else (self.names == [label]):
            return []
        q2 = float((q * q).sum())
        seen = _distances(q, self.vantage, self.most)
        give = 1e-6 * np.sqrt(q2 + self.most + 1)
        top = q2 + self.most
        number = np.cumsum([v >= 0 for v, _, _ in self.node]) - 1
        exact = float(np.abs(q).max(initial=0)) * np.sqrt(q2 + 1) < 2**52 and self.most < 2**52
        held = [[np.empty(0, np.int64), np.empty(0, np.int64)] for _ in windows]
        floor = [lo for _, lo, _ in windows]  # what a row has to reach: the window's lower end, later the k-th score
        need = k + same  # of equal vectors one can be the anchor itself
        heap = [(-np.inf, 0, 0.0, np.inf)]
        while heap:
            high, at, near, far = heapq.heappop(heap)
            high, low = -high, (top - (far + give) ** 2) / 2 - 1
            if not any(high >= floor[w] and low <= windows[w][2] for w in range(len(windows))):
                continue
            v, a, b = self.node[at]
            if v >= 0:
                d, r = float(seen[number[at]]), self.radius[at]
                for child, least, most in ((a, r[0], r[1]), (b, r[2], r[3])):
                    lo, hi = max(near, d - most - give, least - d - give, 0.0), min(far, d + most + give)
                    heapq.heappush(heap, (-((top - max(0.0, lo - give) ** 2) / 2 + 1), child, lo, hi))
                continue
            s = (self.x[a:b] @ q).astype(np.int64) if exact else self.x[a:b].astype(np.int64) @ q.astype(np.int64)
            fits = (self.label[a:b] == mine) == same
            for w, (_, _, hi) in enumerate(windows):
                hit = np.flatnonzero(fits & (s >= floor[w]) & (s <= hi))
                if len(hit):
                    scores, rows = np.concatenate([held[w][0], s[hit]]), np.concatenate([held[w][1], hit + a])
                    if len(scores) >= need:
                        floor[w] = max(floor[w], int(np.partition(scores, len(scores) - need)[len(scores) - need]))
                        keep = scores >= floor[w]
                        scores, rows = scores[keep], rows[keep]
                    held[w] = [scores, rows]
        out = []
        for (w, _, _), (scores, rows) in zip(windows, held):
            if len(rows):
                n = self.size[rows]
                ids = self.ids[np.concatenate([np.arange(self.at[r], self.at[r + 1]) for r in rows.tolist()])]
                scores = np.repeat(scores, n)
                if same:
                    scores, ids = scores[ids != own], ids[ids != own]
                best = np.lexsort([ids, -scores])[:k]
                out.append((w, scores[best], ids[best]))
        return out


class Cells:
    """The top tree: which cell a vector belongs to, and the scores that an anchor can reach in every cell."""

    def __init__(self, x: np.ndarray, most: int, cells: int):
        tree = Tree(x, most, max(1, -(-len(x) // max(1, cells))))
        self.most, self.node, self.radius = most, tree.node, tree.radius
        v = tree.vantages()
        self.vantage = x[v].astype(np.float64) if v else np.empty((0, x.shape[1]))
        self.lift = np.sqrt(np.maximum(most - (self.vantage**2).sum(1), 0))
        self.number = np.cumsum([n[0] >= 0 for n in self.node]) - 1
        self.cell = np.cumsum([n[0] < 0 for n in self.node]) - 1
        self.n = int(sum(n[0] < 0 for n in self.node))

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of every vector."""
        x = x.astype(np.float64)
        n2 = (x * x).sum(1)
        lift = np.sqrt(np.maximum(self.most - n2, 0))
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            v, a, b = self.node[at]
            if v < 0:
                out[rows] = self.cell[at]
                continue
            k = self.number[at]
            d = np.sqrt(np.maximum(n2[rows] + (self.vantage[k] ** 2).sum() - 2 * (x[rows] @ self.vantage[k]) + (lift[rows] - self.lift[k]) ** 2, 0))
            near = d <= self.radius[at][1]
            todo += [(a, rows[near]), (b, rows[~near])]
        return out

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest and lowest possible score in every cell."""
        top = (q * q).sum() + self.most
        give = 1e-6 * np.sqrt(top + 1)
        seen = _distances(q, self.vantage, self.most)
        high, low = np.zeros(self.n), np.zeros(self.n)
        todo = [(0, 0.0, 2 * np.sqrt(top) + give)]
        while todo:
            at, near, far = todo.pop()
            v, a, b = self.node[at]
            if v < 0:
                high[self.cell[at]], low[self.cell[at]] = (top - max(0.0, near - give) ** 2) / 2 + 1, (top - (far + give) ** 2) / 2 - 1
                continue
            d, r = float(seen[self.number[at]]), self.radius[at][1]
            todo += [(a, max(near, d - r - give), min(far, d + r + give)), (b, max(near, r - d - give), far)]
        return high, low


def _integers(width: int, scale: int):
    """``vid, label, x, n2`` of usable rows: components times ``scale``, rounded down, as int32, filled up with zeros."""

    def run(batches):
        for b in batches:
            rows = []
            for i, label, v in zip(*(b.column(k).to_pylist() for k in range(3))):
                if i is None or label is None or v is None or any(e is None for e in v):
                    continue
                a = np.zeros(width)
                a[: len(v)] = v
                if not np.isfinite(a).all():
                    continue
                with np.errstate(over="ignore"):
                    a = np.clip(np.floor(scale * a), -LIMIT, LIMIT).astype(np.int64)
                rows.append((i, label, a.astype("<i4").tobytes(), int((a * a).sum())))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary(), pa.int64()))], ["vid", "label", "x", "n2"])

    return run


def _matrix(xs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(xs), "<i4").reshape(len(xs), -1)


class Index:
    """Pieces of all vectors in the shared folder: ``trees`` (cell, part, piece), ``sizes`` (cell, parts), ``labels`` (cell, label), and the top tree; a part is about :data:`GROUP` pieces."""

    def __init__(self, classes: DataFrame):
        spark = classes.sparkSession
        n, most = classes.agg(F.count("*"), F.coalesce(F.max("n2"), F.lit(0))).first()
        share = F.pmod(F.xxhash64("label", "x"), F.lit(1 << 20)) < F.lit(int(SAMPLE / max(n, 1) * (1 << 20)) + 1)
        sample = [bytes(r[0]) for r in classes.where(share).select("x").limit(2 * SAMPLE).collect()]
        cells = self.cells = Cells(_matrix(sorted(sample)) if sample else np.zeros((1, 1), np.int32), int(most), min(CELLS, -(-n // PIECE)))

        def route(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(cells.of(_matrix(b.column("x").to_pylist()))), *b.columns], ["cell", *b.schema.names])

        routed = materialize(classes.drop("n2").mapInArrow(route, "cell int, label string, x binary, ids array<long>"), "mine-routed")
        # large labels of a cell have slots of their own; the others share slots by a hash of the label
        many = routed.groupBy("cell", "label").agg(F.count("*").alias("n"))
        large = F.col("n") >= PIECE // 2
        shared = many.where(~large).groupBy("cell").agg(F.ceil(F.sum("n") / (PIECE // 2)).alias("slots"))  # at most CELLS rows
        many = many.join(F.broadcast(shared), "cell", "left")
        salt = F.pmod(F.xxhash64("x"), F.ceil(F.col("n") / PIECE))
        slot = F.when(large, F.xxhash64("label", salt)).otherwise(F.pmod(F.xxhash64("label"), F.col("slots")))
        dealt = routed.join(many, ["cell", "label"]).select("cell", slot.alias("slot"), "label", "x", "ids")

        def build(batches):
            for t in key_groups(batches, ["cell", "slot"]):
                names = t["label"].to_pylist()
                piece = Piece(_matrix(t["x"].to_pylist()), names, t["ids"].to_pylist(), int(most))
                yield pa.RecordBatch.from_pydict(
                    {"cell": pa.array([t["cell"][0].as_py()], pa.int32()), "slot": pa.array([t["slot"][0].as_py()], pa.int64()), "names": [piece.names], "piece": [pickle.dumps(piece)]}
                )

        key = ["cell", "slot"]
        trees = dealt.repartition(4 * parts(spark), *key).sortWithinPartitions(*key).mapInArrow(build, "cell int, slot long, names array<string>, piece binary")
        made = materialize(trees, "mine-trees")
        self.sizes = made.groupBy("cell").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))  # at most CELLS rows
        self.trees = made.join(F.broadcast(self.sizes), "cell").select("cell", F.pmod(F.xxhash64("slot"), F.col("parts")).cast("int").alias("part"), "piece")
        self.labels = made.select("cell", F.explode("names").alias("label")).distinct()
        self.made = made
        release(routed)


def _asked(index: Index, anchors: DataFrame, windows: DataFrame, same: bool, first: bool) -> DataFrame:
    """``cell, aid, label, x, ws``: the cells where an anchor can find something; ``first``: the best cell only, else all others."""
    cells = index.cells

    def made(rows: list[tuple], ws: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 5
        types = (pa.int32(), pa.int64(), pa.string(), pa.binary(), ws)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["cell", "aid", "label", "x", "ws"])

    def run(batches):
        for b in batches:
            rows = []
            for aid, label, x, ws in zip(*(b.column(k).to_pylist() for k in range(4))):
                high, low = cells.reach(np.frombuffer(x, "<i4").astype(np.float64))
                home = int(np.argmax(high))
                for c in [home] if first else [c for c in range(cells.n) if c != home]:
                    fit = [w for w in ws if high[c] >= w["lo"] and low[c] <= w["hi"]]
                    if fit:
                        rows.append((c, aid, label, x, fit))
                if len(rows) >= ROWS:  # an anchor can ask every cell, so a batch of anchors is no bound
                    yield made(rows, b.column(3).type)
                    rows = []
            yield made(rows, b.column(3).type)

    each = windows.groupBy("aid").agg(F.collect_list(F.struct("w", "lo", "hi")).alias("ws"))  # POSITIVES windows at most
    wide = anchors.join(each, "aid").select("aid", "label", "x", "ws").mapInArrow(run, "cell int, aid long, label string, x binary, ws array<struct<w:long,lo:long,hi:long>>")
    return wide.join(index.labels, ["cell", "label"], "left_semi") if same else wide


def _found(index: Index, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """``aid, w, vid, score``: the first ``k`` of every window in each part of the cells that are asked.

    A task holds ``CHUNK`` questions, and the pieces of a part stream through it, so an anchor goes to a part once however
    many pieces that has, and what it has found in one piece is the bound for the next.
    """
    asked = materialize(asked, "mine-asked")
    n = asked.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = F.broadcast(index.sizes.join(n, "cell"))  # at most CELLS rows
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    key = ["cell", "part", "chunk"]
    held = index.trees.join(dealt, "cell").select("cell", "part", upto("chunks").alias("chunk"), F.lit(1).alias("kind"), "piece")
    put = asked.join(dealt, "cell").select("cell", upto("parts").alias("part"), F.pmod(F.xxhash64("aid"), F.col("chunks")).cast("int").alias("chunk"), F.lit(0).alias("kind"), "aid", "label", "x", "ws")
    work = put.unionByName(held, allowMissingColumns=True).repartition(4 * parts(asked.sparkSession), *key).sortWithinPartitions(*key, "kind")

    def result(questions: list[dict]):
        out = [(np.full(len(ids), q["aid"]), np.full(len(ids), w), ids, scores) for q in questions for w, (scores, ids) in q["got"].items()]
        for lo in range(0, len(out), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out[lo : lo + ROWS])], ["aid", "w", "vid", "score"])

    def ask(piece: Piece, q: dict) -> None:
        for w, scores, ids in piece.search(q["x"], q["aid"], q["label"], same, [tuple(e) for e in q["ws"].values()], k):
            if w in q["got"]:
                scores, ids = (np.concatenate(c) for c in zip(q["got"][w], (scores, ids)))
                best = np.lexsort([ids, -scores])[:k]
                scores, ids = scores[best], ids[best]
            q["got"][w] = scores, ids
            if len(scores) == k:
                q["ws"][w][1] = max(q["ws"][w][1], int(scores[-1]))

    def run(batches):
        now, questions = None, []
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                for r in b.slice(lo, 256).to_pylist():
                    if (at := tuple(r[c] for c in key)) != now:
                        yield from result(questions)
                        now, questions = at, []
                    if r["kind"] == 0:
                        ws = {e["w"]: [e["w"], e["lo"], e["hi"]] for e in r["ws"]}
                        questions.append({"x": np.frombuffer(r["x"], "<i4").astype(np.float64), "aid": r["aid"], "label": r["label"], "ws": ws, "got": {}})
                        continue
                    piece = pickle.loads(r["piece"])
                    piece.ready()
                    for q in questions:
                        ask(piece, q)
        yield from result(questions)

    found = materialize(work.mapInArrow(run, "aid long, w long, vid long, score long"), "mine-found")
    release(asked)
    return found


def _first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("aid", "w").orderBy(F.desc("score"), "vid")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(index: Index, anchors: DataFrame, windows: DataFrame, same: bool, k: int) -> DataFrame:
    """``aid, w, vid, score, rank``: the first ``k`` of every window over all pieces."""
    got = _found(index, _asked(index, anchors, windows, same, True), same, k)
    if index.cells.n == 1:
        return _first(got, k)
    kth = _first(got, k).groupBy("aid", "w").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
    left = windows.join(kth.select("aid", "w", "kth"), ["aid", "w"], "left").select("aid", "w", F.greatest("lo", F.coalesce("kth", "lo")).alias("lo"), "hi")
    rest = _found(index, _asked(index, anchors, left, same, False), same, k)
    return _first(got.union(rest), k)


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from rows of ``vec_id, label, embedding``.

    A score is the integer inner product of components times ``scale``, rounded down; higher ones come first, ties by the smaller id. Positives
    are an anchor's first ``positives`` other rows of its label; negatives of a positive its first ``negatives`` rows of another label with
    a score of ``low`` to ``high`` per cent of the positive's. ``anchor`` says which rows are anchors.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part. Rows of one
    vec_id count as one (the smallest by label and vector). Vectors of different lengths are filled up with zeros, an empty one scores 0. Components beyond
    2^27 after scaling count as 2^27. No rows, and anchors without a positive or a negative in the window, give no rows.
    Of equal vectors with one label only the smallest ids can be among the first, so only these are kept.
    """
    src = vectors.where(F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vid"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor")
    )
    width = src.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    whole = src.select("vid", "label", "v").mapInArrow(_integers(max(1, width), scale), "vid long, label string, x binary, n2 long")
    rows = materialize(whole.groupBy("vid").agg(F.min(F.struct("label", "x", "n2")).alias("r")).select("vid", "r.*"), "mine-rows")
    keep = max(negatives, positives + 1)
    same = Window.partitionBy("label", "x").orderBy("vid")
    lowest = rows.withColumn("k", F.row_number().over(same)).where(F.col("k") <= keep)
    classes = materialize(lowest.groupBy("label", "x").agg(F.first("n2").alias("n2"), F.sort_array(F.collect_list("vid")).alias("ids")), "mine-classes")
    index = Index(classes.select("label", "x", "ids", "n2"))
    release(classes)

    chosen = src.where("is_anchor").select(F.col("vid").alias("aid")).distinct()
    anchors = materialize(rows.join(chosen, rows["vid"] == chosen["aid"]).select("aid", "label", "x"), "mine-anchors")
    release(rows)
    every = anchors.select("aid", F.lit(0).cast("long").alias("w"), F.lit(-_FAR).alias("lo"), F.lit(_FAR).alias("hi"))
    best = materialize(_search(index, anchors, every, True, positives).select("aid", F.col("vid").alias("positive_id"), F.col("score").alias("ps")), "mine-positives")
    floor = lambda x: F.expr(f"({x} - pmod({x}, 100L)) div 100L")
    windows = best.select("aid", F.col("ps").alias("w"), (-floor(f"(-{low}L * ps)")).alias("lo"), floor(f"({high}L * ps)").alias("hi")).where("lo <= hi").distinct()
    hard = _search(index, anchors, windows, False, negatives)
    out = best.join(hard, (best["aid"] == hard["aid"]) & (best["ps"] == hard["w"])).select(
        best["aid"].alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vid").alias("negative_id"), F.col("ps").alias("positive_score"), F.col("score").alias("negative_score")
    )
    out = materialize(out, "mine-result")
    release(index.made, anchors, best)
    return out


#: The same rows from all scores of the anchors, for the query's settings.
ORACLE_SQL = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
