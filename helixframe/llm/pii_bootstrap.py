r"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base entities (e-mail, IPv4, payment card, phone) are found by their grammar and are
the seeds. The words to the left of a seed are a lexical pattern; patterns and
identifier-shaped tokens form a bipartite graph. Each round scores a pattern by the
share of its distinct instances that are already believed, and an instance by its
patterns (noisy or); confident patterns then mark the identifiers that the grammars
do not know. Base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

KINDS = ("email", "ip", "card", "phone")
#: The grammars. Each is written so that a failed start is not tried again
#: inside the same run of characters, which keeps long runs linear, with the same matches.
GRAMMAR = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TOKEN = r"(?<!\S)(?=\S*[0-9@])\S+"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Length of the blocks of a scan; no cap, only where a fold is cut.
BLOCK = 256
ROUNDS = 3
MIN_SEEDS = 3
MIN_PATTERN = 0.8
MIN_INSTANCE = 0.8


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, op, zero: Column, kind: str) -> Column:
    """Exclusive running ``op`` (associative) over an array, linear but for a block's own length.

    Blocks are folded first, then the block results, then every block from its own start, so
    no fold ever appends to a long array.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def running(xs: Column, start: Column) -> Column:
        first = F.struct(start.alias("p"), none.alias("o"))
        return F.aggregate(xs, first, lambda acc, x: F.struct(op(acc["p"], x).alias("p"), F.concat(acc["o"], F.array(acc["p"])).alias("o")), lambda acc: acc["o"])

    def whole(blocks: Column) -> Column:
        starts = running(F.transform(blocks, lambda b: F.aggregate(b, zero, op)), zero)
        return F.flatten(F.zip_with(blocks, starts, running))

    def cut(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, F.lit(BLOCK)), lambda i: F.slice(xs, i + 1, F.lit(BLOCK)))
        return F.when(F.size(xs) > BLOCK, _let(blocks, whole)).otherwise(running(xs, zero))

    return _let(values, cut)


def located(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` as array<struct<b,e,v,g>>: begin, end, text, and the gap before."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("g"), h.alias("h"))), lambda p: p["h"].isNotNull())

    def placed(ps: Column) -> Column:
        before = scan(F.transform(ps, lambda p: F.length(p["g"]) + F.length(p["h"])), lambda x, y: x + y, F.lit(0), "int")

        def place(p, at):
            b = at + F.length(p["g"])
            return F.struct(b.alias("b"), (b + F.length(p["h"])).alias("e"), p["h"].alias("v"), p["g"].alias("g"))

        return F.zip_with(ps, before, place)

    return _let(pairs, placed)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    d = _digits(v)
    n = F.length(d)
    digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    twice = lambda i: 2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, twice(i)).otherwise(digit(i)))
    return total % 10 == 0


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
_NONE = "cast(array() as array<struct<b:int,k:int,e:int>>)"


def _base(text: Column, digits: Column, k: int) -> Column:
    kind = KINDS[k]
    may = digits if kind == "card" else text.contains(NEEDS[kind]) if kind == "email" else digits & text.contains(NEEDS[kind])
    spans = F.filter(located(text, GRAMMAR[kind]), lambda s: _VALID[kind](s["v"]))
    return F.when(may, F.transform(spans, lambda s: F.struct(s["b"].alias("b"), F.lit(k).alias("k"), s["e"].alias("e")))).otherwise(F.expr(_NONE))


def _name(v: Column) -> Column:
    """A string as a graph node: itself, or the digest of a long one."""
    return F.when(F.length(v) > 64, F.concat(F.lit("#"), F.sha2(v, 256))).otherwise(v)


def _candidates(text: Column) -> Column:
    """Identifier-shaped tokens with edge punctuation cut off, and the two words before each."""

    def clean(s):
        lead = F.length(F.regexp_extract(s["v"], r"^[\"'(\[{<]*", 0))
        v = F.regexp_replace(F.substring(s["v"], lead + 1, F.length(s["v"])), r"(?<![\"')\]}>.,;:!?])[\"')\]}>.,;:!?]++$", "")
        last = F.reverse(F.regexp_extract(F.reverse(s["g"]), r"^\s*+\S++(?:\s++\S++)?", 0))
        ctx = F.trim(F.regexp_replace(F.lower(last), r"\s+", " "))
        b = s["b"] + lead
        return F.struct(b.alias("b"), (b + F.length(v)).alias("e"), _name(v).alias("v"), _name(ctx).alias("ctx"))

    return F.filter(F.transform(located(text, TOKEN), clean), lambda c: (c["e"] - c["b"] >= 4) & (c["ctx"] != ""))


def scan_base(docs: DataFrame) -> DataFrame:
    """``doc_id, key, base, cands``; null texts count as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digits = text.rlike("[0-9]")
    none = F.expr("cast(array() as array<struct<b:int,e:int,v:string,ctx:string>>)")
    cands = F.when(digits | text.contains("@"), _candidates(text)).otherwise(none)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), _base_spans().alias("base"), cands.alias("cands"))


def _key() -> Column:
    return F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))


def _base_spans() -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digits = text.rlike("[0-9]")
    return F.array_sort(F.concat(*[_base(text, digits, k) for k in range(len(KINDS))]))


_EVENT = "struct<b:int,t:int,e:int,k:int>"


def _judged() -> Column:
    """The candidates with ``seed`` (kind of the first base span that starts inside) and ``hit`` (a base span overlaps).

    One sorted sweep over base spans and candidates: the largest end of the base spans before,
    and the next base span behind.
    """
    event = lambda s, t, k: F.struct(s["b"].alias("b"), F.lit(t).alias("t"), s["e"].alias("e"), k.alias("k"))
    both = F.array_sort(F.concat(F.transform("cands", lambda c: event(c, 0, F.lit(-1))), F.transform("base", lambda s: event(s, 1, s["k"]))))
    nothing = F.lit(None).cast(_EVENT)

    def judge(events: Column) -> Column:
        most = scan(F.transform(events, lambda v: F.when(v["t"] == 1, v["e"]).otherwise(0)), lambda x, y: F.greatest(x, y), F.lit(0), "int")
        bases = F.transform(F.reverse(events), lambda v: F.when(v["t"] == 1, v))
        after = F.reverse(scan(bases, lambda x, y: F.coalesce(y, x), nothing, _EVENT))
        near = F.zip_with(F.zip_with(events, most, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), after, lambda x, n: F.struct(x["v"].alias("v"), x["m"].alias("m"), n.alias("n")))
        near = F.filter(near, lambda x: x["v"]["t"] == 0)

        def verdict(c, x):
            inside = F.coalesce(x["n"]["b"] < c["e"], F.lit(False))
            return F.struct(c["b"].alias("b"), c["e"].alias("e"), c["v"].alias("v"), c["ctx"].alias("ctx"), F.when(inside, x["n"]["k"]).alias("seed"), (inside | (x["m"] > c["b"])).alias("hit"))

        return F.zip_with("cands", near, verdict)

    return _let(both, judge)


def discover(base: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_pattern: float = MIN_PATTERN, min_instance: float = MIN_INSTANCE) -> DataFrame:
    """``key, more``: spans found by context, not overlapping a base span of their document.

    All aggregations are combinable (a frequent word as a pattern is one partial row a
    task), and the scored patterns that are joined back are only those with enough seeds.
    """
    rows = base.where(F.size("cands") > 0).select("key", F.explode(_judged()).alias("c")).select("key", "c.*")
    rows = materialize(rows, "pii-rows")
    graph = materialize(rows.groupBy("ctx", "v").agg(F.max("seed").alias("seed"), F.max("hit").alias("hit")), "pii-graph")
    believed = graph.where("seed is not null").select("v", F.col("seed").alias("k"), F.lit(1.0).alias("conf")).groupBy("v", "k").agg(F.max("conf").alias("conf"))
    patterns, old = None, []
    for i in range(rounds):
        seen = graph.groupBy("ctx").agg(F.count("*").alias("n"))
        votes = graph.select("ctx", "v").join(believed, "v").groupBy("ctx", "k").agg(F.sum("conf").alias("f"), F.count("*").alias("m")).where(F.col("m") >= min_seeds)
        patterns = votes.join(seen, "ctx").select("ctx", "k", (F.col("f") / F.col("n")).alias("score")).where("score >= 0.5")
        patterns = materialize(patterns, "pii-patterns")
        old.append(patterns)
        if i + 1 < rounds:
            seeds = graph.where("seed is not null").select("v", F.col("seed").alias("k"), F.lit(1.0).alias("conf"))
            fresh = graph.where("not hit").join(patterns, "ctx").groupBy("v", "k").agg((1 - F.exp(F.sum(F.log(1.0001 - F.col("score"))))).alias("conf")).where(F.col("conf") >= min_instance)
            believed = seeds.union(fresh).groupBy("v", "k").agg(F.max("conf").alias("conf"))
    best = patterns.where(F.col("score") >= min_pattern).groupBy("ctx").agg(F.min_by("k", F.struct(-F.col("score"), F.col("k"))).alias("k"))
    found = rows.where("not hit").join(best, "ctx").groupBy("key").agg(F.collect_set(F.struct("b", "k", "e")).alias("more"))
    found = materialize(found, "pii-found")
    release(rows, graph, *old)
    return found


def _text_of(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["k"] + 1), s["b"].cast("string"), s["e"].cast("string"))), ",")


def _all_spans(base: Column, more: Column) -> Column:
    """Base and discovered spans by start, then kind."""
    return F.array_sort(F.concat(base, F.coalesce(more, F.expr(_NONE))))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered``, one row per input row.

    Null and empty texts have no spans; repeated rows have the same result each; rows without
    doc_id are scanned too. Columns other than ``doc_id`` and ``text`` are not read.
    """
    base = materialize(scan_base(docs), "pii-base")
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    spans = base.join(discover(base), "key", "left").withColumn("spans", _all_spans(F.col("base"), F.col("more")))
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_discovered"),
    )


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with every span as its kind in brackets; a span that begins inside an earlier one only prolongs the cut.

    Spans are taken in blocks, each with its own piece of the text, so no substring walks a long text for each span.
    """
    mark = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def replaced(ss: Column) -> Column:
        done = scan(F.transform(ss, lambda s: s["e"]), lambda x, y: F.greatest(x, y), F.lit(0), "int")
        parts = F.zip_with(ss, done, lambda s, p: F.struct(p.alias("p"), s["b"].alias("b"), s["k"].alias("k"), s["e"].alias("e")))

        def blocks(xs: Column) -> Column:
            def block(i):
                own = F.slice(xs, i + 1, F.lit(BLOCK))
                start = F.get(xs, i)["p"]
                end = F.coalesce(F.get(xs, i + BLOCK)["p"], F.aggregate(own, F.lit(0), lambda m, x: F.greatest(m, x["e"], x["p"])))
                piece = F.substring(text, start + 1, end - start)
                cut = lambda t: F.array_join(
                    F.transform(own, lambda x: F.when(x["b"] >= x["p"], F.concat(F.substring(t, x["p"] - start + 1, x["b"] - x["p"]), F.element_at(mark, x["k"] + 1))).otherwise("")), ""
                )
                return F.struct(_let(piece, cut).alias("out"), end.alias("end"))

            made = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, F.lit(BLOCK)), block)
            return _let(made, lambda m: F.concat(F.array_join(F.transform(m, lambda x: x["out"]), ""), F.substring(text, F.element_at(m, -1)["end"] + 1, F.length(text))))

        return _let(parts, blocks)

    return _let(spans, replaced)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, ``n_chars`` set anew; all rows stay.

    Null texts stay null; other columns, whatever their names, are kept as they are.
    """
    cols = docs.columns
    kept = [f"c{i}" for i in range(len(cols))]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(cols, kept)], text.alias("own_text"), _key().alias("key"), _base_spans().alias("base"))
    rows = rows.join(discover(scan_base(docs)), "key", "left").withColumn("spans", _all_spans(F.col("base"), F.col("more")))
    at = kept[cols.index("text")]
    some = F.size("spans") > 0
    rows = rows.withColumn("new_text", F.when(some, _replaced(F.col("own_text"), F.col("spans"))).otherwise(F.col(at)))
    new = {"text": F.col("new_text"), "n_chars": F.when(some, F.length("new_text").cast("long"))}
    return rows.select(*[F.coalesce(new[c], F.col(k)).alias(c) if c == "n_chars" else new.get(c, F.col(k)).alias(c) for c, k in zip(cols, kept)])
