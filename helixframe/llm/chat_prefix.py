"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are
context, and only that reply lies under the loss mask. A conversation that ends
with another role gets one more example without a target, so that no turn is lost.

Template of a turn: ``<|role|>`` newline, text, ``</s>`` newline. In roles and
texts ``&``, ``<``, ``[`` and ``|`` are written as entities, so no control string
(``</s>``, ``<|``, ``[INST]`` ...) can come out of a text, and unescaping is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = "<|", "|>\n", "</s>\n"
#: What is escaped, and how; "&" comes first and is undone last.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("|", "&vert;"))


def escape(c: Column) -> Column:
    for plain, entity in ENTITIES:
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def unescape(c: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def format_examples(turns: DataFrame) -> DataFrame:
    """``conv_id, example, is_last, text, loss_start, loss_end`` from ``conv_id, turn, role, text``.

    ``text[loss_start:loss_end]`` (code points) is the trainable reply; both are -1
    without one. Turns are ordered by turn, then role, then text (ties and repeated
    rows are kept); null roles and texts count as empty; rows with a null conv_id form
    one conversation. A conversation is one row of the inner aggregation, as its
    examples hold it whole anyway.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    convs = turns.select(F.col("conv_id").cast("long"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    heads = F.transform("ts", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(ROLE_END)))
    bodies = F.transform("ts", lambda t: escape(t["text"]))
    convs = convs.select("conv_id", F.transform("ts", lambda t: t["role"] == "assistant").alias("target"), heads.alias("heads"), bodies.alias("bodies"))
    convs = convs.select("conv_id", "target", "heads", "bodies", F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(CLOSE))).alias("segs"), F.size("heads").alias("n"))
    wanted = F.filter(F.sequence(F.lit(1), F.col("n")), lambda k: F.element_at("target", k) | (k == F.col("n")))
    ex = convs.select("*", F.posexplode(wanted).alias("example", "k"))
    before = F.array_join(F.slice("segs", F.lit(1), F.col("k") - 1), "")
    start = F.length(before) + F.length(F.element_at("heads", F.col("k")))
    hit = F.element_at("target", F.col("k"))
    return ex.select(
        "conv_id",
        F.col("example").cast("long"),
        (F.col("k") == F.col("n")).alias("is_last"),
        F.concat(before, F.element_at("segs", F.col("k"))).alias("text"),
        F.when(hit, start).otherwise(-1).cast("long").alias("loss_start"),
        F.when(hit, start + F.length(F.element_at("bodies", F.col("k")))).otherwise(-1).cast("long").alias("loss_end"),
    )


def parse_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text): the inverse of the template."""
    segs = F.split(text, F.lit(r"</s>\n"), F.lit(-1))
    segs = F.slice(segs, F.lit(1), F.size(segs) - 1)
    cut = lambda s: F.instr(s, ROLE_END)
    return F.transform(
        segs,
        lambda s: F.struct(
            unescape(F.substring(s, F.lit(len(OPEN) + 1), cut(s) - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(s, cut(s) + len(ROLE_END), F.length(s))).alias("text"),
        ),
    )


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Reads the examples back: digests of turns and of the text under the loss mask."""
    span = F.col("loss_end") - F.col("loss_start")
    loss = F.when(F.col("loss_start") >= 0, unescape(F.substring("text", F.col("loss_start") + 1, span)))
    turns = F.when(F.col("is_last"), parse_turns(F.col("text")))
    rows = examples.select("conv_id", "example", loss.alias("loss"), turns.alias("turns"), F.length("text").cast("long").alias("n"))
    got = rows.groupBy("conv_id").agg(
        F.flatten(F.collect_list("turns")).alias("turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("n").alias("formatted_chars"),
    )
    listing = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listing, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
