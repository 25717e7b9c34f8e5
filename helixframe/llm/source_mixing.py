"""Mixing sources to target weights by capped water-filling.

Every source weighs 5, 2 or 1 in turn and shares all words; a source stops at a
maximum of epochs, and its excess is shared anew by weight among the others until no
source is above its cap. What a source's target holds in whole epochs every document
gives as whole repetitions; the rest is one more repetition of documents in the order
of a seeded hash, the last of which gives a part.

Documents are reduced to (source, doc_id, size) once. Sources are ranked by a range sort
with prefix counts, water-filling adds up two integers per round, and the order of the
hash is only made where it matters: buckets of the hash are added up first, and rows are
sorted only inside the one bucket of a source where its target ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, parts, release

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 12
#: Hexadecimal digits of the hash that one level of buckets takes, and how many levels there are.
DIGITS, LEVELS = 3, 2


def hashed(doc_id: Column, size: Column, seed: int) -> Column:
    """The place of a document in its source's order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string")))


def ranked(df: DataFrame, col: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``name``: the place of the row by ``col`` (nulls last), from 0; and the scratch table that it reads.

    Ranges are counted and numbered from the counts before them, so no task sees all rows.
    """
    order = F.col(col).asc_nulls_last()
    dealt = materialize(df.repartitionByRange(parts(df.sparkSession), order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()), "mix-ranks")
    size = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per shuffle partition
    base = size.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return dealt.withColumn(name, local).join(F.broadcast(base), "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base"), dealt


def water_filling(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size`` get ``weight`` and ``target`` (double).

    Each round clamps the sources whose share is above ``epochs`` times their size and shares
    what they leave among the rest; two sums and a count a round reach the driver. Weights are those
    of the sources in order of code points, repeating, null last. Shares are exact quotients of integers.
    """
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    places, dealt = ranked(sources, "source", "_rank")
    table = materialize(places.select("source", "source_size", cycle.cast("long").alias("weight")), "mix-sources")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    cap, w = F.col("source_size") * epochs, F.col("weight")
    held, n, left, share = F.lit(False), -1, total, None
    while True:
        free = table.agg(F.coalesce(F.sum(F.when(held, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~held, w)), F.lit(0)), F.count_if(held)).first()
        if free[2] == n:
            break
        n, left, share = free[2], total - free[0], free[1]
        wide = lambda x: x.cast("decimal(38,0)")
        held = wide(w) * left > wide(cap) * share if share else F.lit(True)
    release(dealt)
    even = (w * F.lit(left).cast("long")).cast("double") / F.lit(float(share or 1))
    return table.withColumn("target", F.when(held, cap.cast("double")).otherwise(even))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``doc_id, text, source``.

    ``taken``: words that the mix takes of the document, repeats counted. A source's taken words are its
    target, rounded, where no two rows of it have one doc_id and size; such rows tie, and share what is
    left for them evenly, rounded down. A null or empty text has size 0 and gives nothing; a null source is a source of its own, the
    last; a source without words has target 0. A null doc_id is treated like any other id. No rows give no rows.
    The order depends on doc_id, size and seed only, so reruns agree.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    plan = water_filling(sources, weights, epochs).withColumn("whole", whole).withColumn("budget", goal - F.col("whole") * F.col("source_size"))
    plan = materialize(plan.drop("weight"), "mix-plan")

    # the buckets where the budgets end: of the first digits, then, within that bucket, of the next
    coded = rows.where("size > 0").withColumn("h", hashed(F.col("doc_id"), F.col("size"), seed))
    at, of = F.substring("h", 1, DIGITS).alias("at"), plan.select(F.col("source").alias("cut_source"), F.col("budget").alias("open"))
    sums = coded.groupBy("source", at).agg(F.sum("size").alias("words")).join(of, F.col("source").eqNullSafe(F.col("cut_source"))).drop("source")
    for level in range(1, LEVELS + 1):
        before = F.sum("words").over(Window.partitionBy("cut_source").orderBy("at")) - F.col("words")
        ended = sums.withColumn("before", before).where((F.col("before") <= F.col("open")) & (F.col("open") < F.col("before") + F.col("words")))
        cuts = materialize(ended.select("cut_source", (F.col("open") - F.col("before")).alias("open"), F.col("at").alias("cut")), "mix-cuts")
        inside = coded.join(cuts, coded["source"].eqNullSafe(cuts["cut_source"]) & (F.substring("h", 1, level * DIGITS) == cuts["cut"]))
        if level < LEVELS:
            at, used = F.substring("h", 1, (level + 1) * DIGITS).alias("at"), cuts
            sums = inside.groupBy("cut_source", "open", at).agg(F.sum("size").alias("words"))

    # rows of the last bucket by their order; rows that tie share
    last = inside.groupBy("source", "h", "doc_id", "size", "open").agg(F.count("*").alias("n"))
    words = F.col("n") * F.col("size")
    before = F.sum(words).over(Window.partitionBy("source").orderBy("h", "doc_id")) - words
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.floor((F.col("open") - before) / F.col("n")))).cast("long")
    last = last.select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("size").alias("z"), part.alias("part"))

    known = plan.join(cuts.select("cut_source", "cut"), plan["source"].eqNullSafe(cuts["cut_source"]), "left").drop("cut_source").withColumnRenamed("source", "of")
    placed = rows.join(known, rows["source"].eqNullSafe(known["of"])).withColumn("h", F.substring(hashed(F.col("doc_id"), F.col("size"), seed), 1, LEVELS * DIGITS))
    open_ = F.col("h") == F.col("cut")
    settled = F.when(F.col("budget") == 0, 0).when(F.col("cut").isNull() | (F.col("h") < F.col("cut")), F.col("size")).otherwise(0)
    cols = lambda extra: ["doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken")]
    done = placed.where(~F.coalesce(open_, F.lit(False)) | (F.col("size") == 0)).select(*cols(settled))
    cut = placed.where(open_ & (F.col("size") > 0))
    cut = cut.join(last, cut["source"].eqNullSafe(last["s"]) & cut["doc_id"].eqNullSafe(last["d"]) & (cut["size"] == last["z"])).select(*cols(F.col("part")))
    out = materialize(done.union(cut), "mix-result")
    release(rows, plan, used, cuts)
    return out


def repetitions(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed corpus: columns of ``docs``, one row per repetition, texts of a part cut after their last taken word.

    ``mixed`` comes from :func:`mix`; ids must be unique and not null. Rows of which nothing is taken are left out.
    """
    taken, size, text = fresh(docs.columns, "taken"), fresh(docs.columns, "size"), F.col("text").cast("string")
    of = mixed.select(F.col("doc_id").alias("mixed_doc_id"), F.col("taken").alias(taken), F.col("size").alias(size)).where(F.col(taken) > 0)
    rows = docs.join(of, docs["doc_id"].cast("long") == of["mixed_doc_id"])
    rounds = F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))
    at = fresh([*docs.columns, taken, size], "at")
    rows = rows.withColumn(at, F.explode(rounds))
    words = F.least(F.col(size), F.col(taken) - (F.col(at) - 1) * F.col(size)).cast("int")
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    head = F.array_join(F.slice(pieces, 1, words), "")
    return rows.withColumn("text", F.when(words < F.col(size), head).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])


def sql(weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> str:
    """The same rows by one sorted pass over all documents of a source and a closed form of the filling."""
    cycle = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(weights))
    return rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(weights)} {cycle} END AS w FROM d GROUP BY source
), f AS (
  SELECT *, sum(source_size) OVER () - {epochs} * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM s WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST)
), level AS (
  SELECT arg_min(free, source_size::DOUBLE / w) AS free, arg_min(share, source_size::DOUBLE / w) AS share FROM f WHERE w * free <= {epochs}::HUGEINT * source_size * share
), t AS (
  SELECT source, source_size, CASE WHEN level.free IS NOT NULL AND w * level.free <= {epochs}::HUGEINT * source_size * level.share
    THEN CAST(CAST(w * level.free AS BIGINT) AS DOUBLE) / CAST(level.share AS DOUBLE) ELSE CAST({epochs} * source_size AS DOUBLE) END AS target FROM s, level
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS whole FROM t
), g AS (
  SELECT source, doc_id, size, count(*) AS n, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)) AS h FROM d GROUP BY source, doc_id, size
), placed AS (
  SELECT g.*, p.source_size, p.target, p.whole, CAST(floor(p.target + 0.5) AS BIGINT) - p.whole * p.source_size AS budget,
    sum(n * size) OVER (PARTITION BY g.source ORDER BY h, doc_id) - n * size AS before
  FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, r.source_size, r.target,
  CAST(r.whole * r.size + greatest(0, least(r.size, floor((r.budget - r.before) / r.n))) AS BIGINT) AS taken
FROM d JOIN placed r ON d.source IS NOT DISTINCT FROM r.source AND d.doc_id IS NOT DISTINCT FROM r.doc_id AND d.size = r.size
"""
