"""The corpus operators against brute force, on whole small tables and on edge cases."""

import pathlib
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from helixframe.llm import bpe_codec, chat_prefix, concat_packing, embed_hnsw, license_digest, parity_join, pii_bootstrap, quality_gam, runlength_dedup, spotsigs
from helixframe.llm.common import components
from helixframe.llm.queries import PATTERN, RANKS, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, label string, x int, tail int"
LONG = "the long and winding road of many words that go on and on until the end of all texts is near, number "
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, LONG * 3 + "first"), (7, LONG * 3 + "second"), (8, LONG * 3 + "first"),
    (9, "a" * 30_000), (10, "ab " * 4000), (11, "Mail x.y@z.example.org, ip 10.0.0.255 and 1.2.3.999, card 4111 1111 1111 1111, +1 (415) 555-2671."),
    (12, "1 " * 9000), (13, "Released under the MIT License."), (14, "ÄÖÜ ß é 日本語 テスト " * 30), (15, "\u0000\u0001�\U0001f600 x  y\r\n z"),
]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, None, "s", 0, "k", 1, "l", 2, 3) for d, t in docs], DOCS)


@pytest.fixture(scope="module")
def real(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 99), (100, 98), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {98: 98, 99: 98, 100: 98}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup(spark, real):
    for docs in (real[:120], EDGE, []):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in runlength_dedup.dedup_digests(frame(spark, docs)).collect()}
        assert got == brute.dedup(docs)


def test_dedup_every_period(spark):
    rng = np.random.default_rng(11)
    docs = []
    for period in range(60, 111):
        for around in (0, 40, 300):
            junk = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
            docs.append((len(docs), junk(around) + (junk(period) * 6)[: 100 + 2 * period] + junk(around)))
    docs.append((len(docs), ("".join(map(chr, rng.integers(97, 123, 68))) + "\n") * 3))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in runlength_dedup.dedup_digests(frame(spark, docs)).collect()}
    assert got == brute.dedup(docs)


@pytest.mark.parametrize("combine, split, classes", [(0, 10**6, 10**6), (0, 1, 10**6), (0, 3, 2), (10**6, 10**6, 1)])
def test_dedup_splits_full_keys(spark, real, monkeypatch, combine, split, classes):
    """Copies combined in the tasks, and keys split there or where they meet."""
    for name, value in (("COMBINE", combine), ("SPLIT", split), ("INDEX_CLASSES", classes), ("HELD_BYTES", 1 << 10)):
        monkeypatch.setattr(runlength_dedup, name, value)
    rng = np.random.default_rng(2)
    line = "this very line of boilerplate stands in each and every one of them. "
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    docs = real[:60] + [(10**6 + k, noise(int(rng.integers(40, 200))) + line * int(rng.integers(1, 4)) + noise(int(rng.integers(0, 150)))) for k in range(30)]
    docs += [(10**7 + k, docs[k % 7][1]) for k in range(20)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys cross the borders of batches
    try:
        got = {r.doc_id: tuple(r)[1:] for r in runlength_dedup.dedup_digests(frame(spark, docs)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute.dedup(docs)


def test_dedup_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, LONG * 2, 7, "a"), (2, LONG * 2, 8, None), (3, None, 9, "c")], "doc_id long, text string, _doc int, spans string")
    got = sorted(map(tuple, runlength_dedup.dedup_texts(docs).collect()))
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 7, "a"), (2, 8, None), (3, 9, "c")] and got[1][1] == "" and got[2][1] is None


def test_dedup_repeats_and_nulls(spark):
    got = runlength_dedup.dedup_texts(frame(spark, [(1, "x" * 50), (2, LONG * 2), (2, LONG * 2), (None, LONG * 2), (3, "é" * 200 + LONG * 2)])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == [(False, 1, 50), (False, 2, 101), (False, 2, 101), (False, 3, 1), (True, 0, 202)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=3).map(lambda b: (b * 120)[:260]), max_size=5))
def test_run_length_index(texts):
    texts = [t for t in texts if len(t) >= 100]
    if texts:
        seen, want = set(), []
        for t in texts:
            late = []
            for i in range(len(t) - 99):
                (late.append(i) if t[i : i + 100] in seen else seen.add(t[i : i + 100]))
            want.append(late)
        assert [x.tolist() for x in runlength_dedup.repeated_windows(texts)] == want


def test_jaccard(spark, real):
    for docs in (real, EDGE, []):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.jaccard_components(frame(spark, docs)).collect()}
        assert got == brute.jaccard_components(docs)


@pytest.mark.parametrize("hot", [3, 64])
def test_jaccard_near_copies_in_one_bucket(spark, monkeypatch, hot):
    """Tiles of a few members; with hot = 3 frequent codes become groups of their own."""
    monkeypatch.setattr(parity_join, "TILE", 4)
    monkeypatch.setattr(parity_join, "SET_TILE", 3)
    monkeypatch.setattr(parity_join, "HOT", hot)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for k in range(60):
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 7)):
            w[j] = f"v{rng.integers(0, 40)}"
        docs.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.jaccard_components(frame(spark, docs)).collect()}
    assert got == brute.jaccard_components(docs)


def test_jaccard_repeated_rows_and_null_ids(spark):
    got = parity_join.jaccard_components(frame(spark, [(5, LONG), (5, LONG), (4, LONG), (None, LONG), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (4, 4), (5, 4), (5, 4)]


def test_jaccard_shared_passage_and_texts_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "HOT", 5)
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 10**6, n))
    passage = words(60)
    docs = [(k, f"{words(30)} {passage} {words(30 if k % 3 else 2)}") for k in range(40)]
    docs += [(k, passage + " " + words(5 + k % 7)) for k in range(40, 60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.jaccard_components(frame(spark, docs)).collect()}
    assert got == brute.jaccard_components(docs)
    x, y = words(50), words(50)
    got = parity_join.jaccard_components(frame(spark, [(7, x), (7, y), (3, x + " more"), (5, y), (9, y + " even more")])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(d, 3) for d in (3, 5, 7, 9)}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6))
def test_linked_sets_share_a_code(n, drop, add, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    b = np.union1d(a[min(drop, len(a) - 1) :], rng.integers(0, 2**63, add, dtype=np.uint64))
    both = len(np.intersect1d(a, b))
    if 100 * both >= 75 * (len(a) + len(b) - both):
        assert len(np.intersect1d(parity_join.block_codes(a), parity_join.block_codes(b)))
        size = min(parity_join.sketch_bits(len(a)), parity_join.sketch_bits(len(b))) // 8
        x, y = (parity_join._fold([parity_join.dense_sketch(s)], size)[0] for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(a) + len(b) - 2 * both


def test_bpe(spark, real):
    enc = brute.encoding()
    for docs in (real, EDGE, []):
        got = {r.doc_id: tuple(r)[1:] for r in bpe_codec.roundtrip_digests(frame(spark, docs), RANKS, PATTERN).collect()}
        want = {}
        for d, t in docs:
            ids = enc.encode_ordinary(t or "")
            want[d] = (len(ids), brute.sha(" ".join(map(str, ids)).encode()), brute.sha((t or "").encode()))
        assert got == want
    ids = bpe_codec.encode_documents(frame(spark, EDGE), RANKS, PATTERN)
    assert {r.doc_id: bytes(r.data) for r in bpe_codec.decode_documents(ids, RANKS, PATTERN).collect()} == {d: (t or "").encode() for d, t in EDGE}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab c'st \n\t\r\x0b\x1c\x85\xa0 é日1.-"), max_size=30))
def test_bpe_like_the_library(text):
    c = bpe_codec.codec(RANKS, PATTERN)
    assert np.frombuffer(c.encode(text), "<u4").tolist() == _ENC.encode_ordinary(text)


_ENC = brute.encoding()


def test_perfect_hash():
    items = {str(i).encode(): i for i in range(3000)}
    h = bpe_codec.PerfectHash(items)
    assert all(h.get(k) == v for k, v in items.items()) and h.get(b"x") == -1 and None not in h.keys
    assert bpe_codec.PerfectHash({}).get(b"") == -1


def test_packing(spark, real):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    added = concat_packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (real, EDGE, []):
        got = [r.asDict() for r in concat_packing.pack(frame(spark, docs), RANKS, PATTERN, added).collect()]
        if docs:
            brute.check_packing(got, docs)
        else:
            assert got == []
    special = ["<|endoftext|> x", "end <|endoftext|> of text", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "  <|endoftext|>\n\n <|endoftext|", "<|endo <|endoftext|>ftext|>"]
    some = {d: t or "" for d, t in [*EDGE, *enumerate(special, 90)]}
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in concat_packing.tokenize(frame(spark, list(some.items())), RANKS, PATTERN, added).collect()}
    assert ids == {d: lib.encode(t, add_special_tokens=False).ids + [0] for d, t in some.items()}


def test_pii(spark, real):
    for docs in (real, EDGE, []):
        got = {r.doc_id: r for r in pii_bootstrap.find(frame(spark, docs)).collect()}
        assert len(got) == len(docs)
        for d, t in docs:
            n, spans = brute.pii(t)
            r = got[d]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == n and r.base_sha256 == brute.sha(",".join(spans).encode())
            assert set(spans) <= set(r.spans.split(",") + [""])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="a1 .@-+()4", max_size=40), min_size=1, max_size=8))
def test_pii_grammar(spark, texts):
    docs = list(enumerate(texts))
    from pyspark.sql import functions as F

    out = pii_bootstrap.scan_base(frame(spark, docs)).select("doc_id", pii_bootstrap._text_of(F.col("base")).alias("s")).collect()
    assert {r.doc_id: r.s for r in out} == {d: ",".join(brute.pii(t)[1]) for d, t in docs}


def test_pii_bootstraps_and_redacts(spark):
    docs = [(i, f"Please write to user{i}@mail.example.com for help today") for i in range(6)]
    docs += [(50, "Please write to user99@intranet for help today"), (51, "nothing here 12345 at all"), (52, None)]
    rows = {r.doc_id: r for r in pii_bootstrap.find(frame(spark, docs)).collect()}
    assert rows[50].spans == "email:16:31" and rows[50].n_email == 0 and rows[50].n_discovered == 1
    assert rows[51].spans == "" and rows[52].spans == ""
    out = {r.doc_id: r for r in pii_bootstrap.redact(frame(spark, docs)).collect()}
    assert out[50].text == "Please write to [EMAIL] for help today" and out[50].n_chars == len(out[50].text)
    assert out[0].text == "Please write to [EMAIL] for help today" and out[51].text == docs[7][1] and out[52].text is None


def test_pii_long_texts(spark):
    """Linear in the hits of a text; long tokens and contexts take part; no overflow of the pattern matcher."""
    import time

    docs = [
        (1, "12345 " * 100_000), (2, "a@b" + ".c" * 50_000), (3, "x " + "w" * 30_000 + " 4111 1111 1111 1111, " + "1.2.3.4 " * 3000), (4, "+1 " * 20_000 + "!" * 30_000 + "1"),
    ] + [(10 + i, f"token {'k' * 300}{i}@mail.example.org today") for i in range(4)] + [(20, f"token {'q' * 300}7 today")]
    t = time.time()
    got = {r.doc_id: r for r in pii_bootstrap.find(frame(spark, docs)).collect()}
    for d, text in docs:
        n, spans = brute.pii(text)
        assert [got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone] == n and got[d].base_sha256 == brute.sha(",".join(spans).encode())
    assert got[20].spans == "email:6:307"  # four of the five tokens behind "token" are e-mail addresses
    out = {r.doc_id: r.text for r in pii_bootstrap.redact(frame(spark, docs)).collect()}
    assert out[1] == docs[0][1] and out[2] == "[EMAIL]" and out[3].count("[IP]") == 3000 and out[3].startswith("x www") and "[CARD]" in out[3]
    assert time.time() - t < 120


def _brute_redaction(text, spans):
    out, at = [], 0
    for kind, b, e in spans:
        if b >= at:
            out += [text[at:b], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_pii_redaction_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pii_bootstrap, "BLOCK", 3)
    rng = np.random.default_rng(3)
    bits = ["a.b@c.de", "1.2.3.4", "4111 1111 1111 1111", "+1 (415) 555-2671", "word", "x", ",", "+49 30 1.2.3.4", "é日"]
    docs = [(k, " ".join(bits[j] for j in rng.integers(0, len(bits), int(rng.integers(0, 40))))) for k in range(60)]
    found = {r.doc_id: r.spans for r in pii_bootstrap.find(frame(spark, docs)).collect()}
    out = {r.doc_id: r.text for r in pii_bootstrap.redact(frame(spark, docs)).collect()}
    for d, t in docs:
        spans = [(k, int(b), int(e)) for k, b, e in (s.split(":") for s in found[d].split(",") if s)]
        assert set(brute.pii(t)[1]) <= set(found[d].split(",") + [""]) and out[d] == _brute_redaction(t, spans)


def _brute_discovery(docs, rounds=3, min_seeds=3, min_pattern=0.8, min_instance=0.8):
    """The pattern-instance graph in plain Python."""
    kinds, rows = pii_bootstrap.KINDS, []
    for d, t in docs:
        base = [(k, int(b), int(e)) for k, b, e in (s.split(":") for s in brute.pii(t)[1])]
        for m in re.finditer(r"(?<!\S)(?=\S*[0-9@])\S+", t):
            lead = len(re.match(r"[\"'(\[{<]*", m[0])[0])
            v = re.sub(r"[\"')\]}>.,;:!?]+$", "", m[0][lead:])
            b = m.start() + lead
            before = t[: m.start()]
            last = max((x.end() for x in re.finditer(r"(?<!\S)(?=\S*[0-9@])\S+", before)), default=0)
            ctx = " ".join(before[last:].lower().split()[-2:])
            if len(v) >= 4 and ctx:
                own = next((kinds.index(k) for k, x, y in base if b <= x < b + len(v)), None)
                rows.append((d, b, b + len(v), v, ctx, own, any(x < b + len(v) and y > b for _, x, y in base)))
    graph = {}
    for _, _, _, v, ctx, own, hit in rows:
        o, h = graph.get((ctx, v), (None, False))
        graph[ctx, v] = (max((x for x in (o, own) if x is not None), default=None), h or hit)
    seeds = {(v, o): 1.0 for (_, v), (o, _) in graph.items() if o is not None}
    believed = dict(seeds)
    for i in range(rounds):
        patterns = {}
        for ctx in {c for c, _ in graph}:
            own = [v for c, v in graph if c == ctx]
            for k in range(len(kinds)):
                conf = [believed[v, k] for v in own if (v, k) in believed]
                if len(conf) >= min_seeds and sum(conf) / len(own) >= 0.5:
                    patterns[ctx, k] = sum(conf) / len(own)
        fresh = {}
        for (ctx, v), (_, hit) in graph.items():
            for k in range(len(kinds)):
                if not hit and (ctx, k) in patterns:
                    fresh[v, k] = fresh.get((v, k), 1.0) * (1.0001 - patterns[ctx, k])
        believed = dict(seeds)
        for key, miss in fresh.items():
            if 1 - miss >= min_instance:
                believed[key] = max(believed.get(key, 0), 1 - miss)
    best = {}
    for (ctx, k), s in sorted(patterns.items(), key=lambda x: (-x[1], x[0][1])):
        if s >= min_pattern:
            best.setdefault(ctx, k)
    return {(d, kinds[best[ctx]], b, e) for d, b, e, _, ctx, _, hit in rows if not hit and ctx in best}


def test_pii_discovery_like_brute_force(spark):
    rng = np.random.default_rng(6)
    docs = []
    for k in range(120):
        who = f"user{rng.integers(0, 40)}"
        s = ["please write to", "mail me at", "server address is", "call us on"][rng.integers(0, 4)]
        good = {"please write to": f"{who}@mail.example.com", "mail me at": f"({who}@x.org),", "server address is": f"10.0.{rng.integers(0, 9)}.{rng.integers(0, 300)}", "call us on": f"+49 30 {rng.integers(10**6, 10**7)}"}[s]
        odd = f"{who}@intranet" if rng.random() < 0.2 else f"id{rng.integers(0, 99)}-x4" if rng.random() < 0.1 else good
        docs.append((k, f"Hello, {s} {odd} or later. {s} {good} then"))
    got = {r.doc_id: r for r in pii_bootstrap.find(frame(spark, docs)).collect()}
    more = {(d, *(int(x) if x.isdigit() else x for x in s.split(":"))) for d, t in docs for s in set(got[d].spans.split(",")) - set(brute.pii(t)[1]) if s}
    assert more == _brute_discovery(docs) and more


def test_pii_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "mail a@b.de now", "n", 5, 1), (None, None, "m", 6, None)], "doc_id long, text string, new string, _new int, n_chars long")
    got = sorted(map(tuple, pii_bootstrap.redact(docs).collect()), key=str)
    assert got == [(1, "mail [EMAIL] now", "n", 5, 16), (None, None, "m", 6, None)]


def test_chat(spark):
    rows = [(1, 1, "assistant", "</s>[INST] <|x|> & &amp;"), (1, 0, "user", None), (2, 0, None, "only"), (2, 0, None, "only"), (3, 0, "assistant", ""), (3, 1, "user|>\n", "tail"), (None, 0, "user", "u")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = chat_prefix.format_examples(turns)
    assert all(chat_prefix.CLOSE not in chat for r in ex.collect() for chat in [r.text.replace("</s>\n", "")])
    got = {r.conv_id: r for r in chat_prefix.conversation_digests(ex).collect()}
    assert set(got) == {1, 2, 3, None}
    for c in got:
        own = sorted((t, r or "", x or "") for i, t, r, x in rows if i == c)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(loss), brute.sha(loss.encode()))
        assert got[c].turns_sha256 == brute.sha("".join(f"{r}\n{x}\n" for _, r, x in own).encode())
    assert chat_prefix.conversation_digests(chat_prefix.format_examples(turns.limit(0))).count() == 0


def test_license_full_texts(spark):
    at = pathlib.Path("/usr/share/common-licenses")
    names = {
        "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2-only", "GFDL-1.3": "GFDL-1.3-only", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only",
        "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
    }
    texts = [((at / f).read_text(), name) for f, name in names.items() if (at / f).exists()]
    if not texts:
        pytest.skip("no licence texts here")
    docs, want = [], []
    for t, name in texts:
        for form in (t, "  " + t.replace("\n", "\r\n") + "\n", t.split("END OF TERMS AND CONDITIONS")[0], re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", t), t + "more"):
            docs.append((len(docs), form))
            want.append(None if form.endswith("more") else name)
    got = {r.doc_id: r.license for r in license_digest.scan(frame(spark, docs)).collect()}
    assert [got[k] for k in range(len(docs))] == want


def test_license(spark):
    mit = license_digest._MIT
    docs = [(1, "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + mit), (2, mit.upper().replace(",", " ,")), (3, mit + " more"), (4, None), (5, ""), (6, "x\nReleased under the MIT Licence!\ny\nLicensed under CC BY-NC 4.0")]
    got = {r.doc_id: (r.license, r.notices) for r in license_digest.scan(frame(spark, docs)).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, ""), 5: (None, ""), 6: (None, "CC-BY-NC-4.0,MIT")}
    assert license_digest.scan(frame(spark, [])).count() == 0


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_gam.train(docs, labels)
    got = {r.doc_id: r for r in quality_gam.score_documents(docs, model).collect()}
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(got) == docs.count() and sum(a == b for a, b in held) >= 0.9 * len(held)
    edge = quality_gam.score_documents(frame(spark, EDGE), model).collect()
    assert len(edge) == len(EDGE) and all(0 <= r.score <= 1 for r in edge)
    assert quality_gam.score_documents(frame(spark, EDGE[:1]), quality_gam.train(docs.limit(0), labels)).first().score > 0.99


def test_quality_keeps_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "1 as score", "'x' as predicted", "2 as held_out")
    model = quality_gam.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = quality_gam.keep_good(docs, model)
    good = {r.doc_id for r in quality_gam.score_documents(docs, model).collect() if r.predicted == 1}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good and kept.first().score == 1


def test_gam_learns_an_interaction():
    x = np.random.default_rng(0).random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality_gam.score(quality_gam.fit(x, y), x) > 0.5) == y).mean() > 0.9


def test_spotsigs(spark, real):
    for docs in (real, EDGE, [(1, "alone in here")], []):
        got = {r.doc_id: r for r in spotsigs.compare_with_edits(frame(spark, docs)).collect()}
        texts = {d: t or "" for d, t in docs}
        ids = sorted(texts, reverse=True)
        assert len(got) == len(docs)
        linked = brute.spot_components(docs)
        for a, b in zip(ids, ids[1:] + ids[:1]):
            k = len(texts[a]) // 3
            r, edited = got[a], texts[a][: len(texts[a]) - k] + texts[b][:k]
            assert (r.n_chars, r.edited_sha256) == (len(texts[a]), brute.sha(edited.encode()))
            x, y, z = (brute.spots(t) for t in (texts[a], edited, texts[b]))
            assert len(r.fingerprint) == 8 * len(x) and len(r.edited_fingerprint) == 8 * len(y)
            for found, other in ((r.near_edited, y), (r.near_next, z)):
                assert found == pytest.approx(len(x & other) / len(x | other))
            assert r.component_id == linked[a]
    assert spotsigs.likeness(np.arange(40, dtype=np.uint32), np.array([1], np.uint32)) == 1 / 40


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB. \n\u03a3\u0130\x85", max_size=30), st.text(alphabet="cD the \n\u03a3", max_size=30))
def test_edited_words(text, more):
    cut = len(text) // 3
    keep = len(text) - cut
    got = spotsigs.edited_tokens(text, spotsigs.tokens(text), keep, more, spotsigs.tokens(more), cut)
    assert got.tolist() == spotsigs.tokens(text[:keep] + more[:cut]).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB.,-é日 \n\t\x1c\x1f\x85\xa0\u2003\u3000\u0130", max_size=25))
def test_words_are_those_of_split(text):
    words = [w.strip(spotsigs._EDGE) for w in text.lower().split()]
    got = spotsigs.tokens(text)
    assert [bool(x & 3) for x in got.tolist()] == [bool(w) for w in words]
    one = {w: spotsigs.tokens(w).tolist() for w in set(words) if w}
    assert [x for x, w in zip(got.tolist(), words) if w] == [one[w][0] for w in words if w] and len({x[0] for x in one.values()}) == len(one)
    plain = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    assert len(parity_join.shingle_set(text, 1)) == len(set(plain))


def test_spotsigs_repeated_and_null_ids(spark):
    docs = [(3, LONG), (3, LONG), (None, LONG * 2), (None, None), (1, "x y"), (3, "other words of the text here")]
    out = spotsigs.compare_with_edits(frame(spark, docs)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in out) == sorted((d or 0, len(t or "")) for d, t in docs)
    assert all((r.component_id is None) == (r.doc_id is None) for r in out)
    # the row behind the last one with doc_id 1 is one without
    follow = {r.n_chars: r for r in out if r.doc_id == 1}[3]
    assert follow.edited_sha256 in {brute.sha(("x " + t[:1]).encode()) for t in (LONG * 2, "")}


def test_spotsigs_near_duplicates(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["the", "of", "and", "a", "in", "to", *(f"w{i}" for i in range(60))]
    docs = []
    for k in range(30):
        words = [vocabulary[i] for i in rng.integers(0, len(vocabulary), int(rng.integers(2, 160)))]
        for c in range(int(rng.integers(1, 5))):
            edited = list(words)
            for i in rng.integers(0, len(words), int(rng.integers(0, max(1, len(words) // 12)))):
                edited[i] = f"x{rng.integers(0, 30)}"
            docs.append((100 * k + c, " ".join(edited)))
    got = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(frame(spark, docs)).collect()}
    want = brute.spot_components(docs)
    assert got == want and len(set(want.values())) < len(docs)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6))
def test_linked_signature_sets_share_an_entry(n, drop, add, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    b = np.union1d(a[min(drop, len(a) - 1) :], rng.integers(0, 2**63, add, dtype=np.uint64))
    both = len(np.intersect1d(a, b))
    if 4 * both >= 3 * (len(a) + len(b) - both):
        assert abs(spotsigs.partition(len(a)) - spotsigs.partition(len(b))) <= 1
        assert len(np.intersect1d(spotsigs.index_keys(a), spotsigs.index_keys(b)))


def test_embeddings(spark, sf):
    nan = float("nan")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    rows = [tuple(r) for r in rows]
    v = rows[0][1]
    rows += [(9001, v, rows[0][2]), (9002, v, None), (9003, [0.0] * len(v), rows[0][2]), (9004, [nan] * len(v), rows[0][2]), (9005, None, 1), (9006, [], 1), (9007, v[:3], rows[0][2]), (9001, v, rows[0][2])]
    got = {r.vec_id: r for r in embed_hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [(i, np.array(e, float), l) for i, e, l in {r[0]: r for r in rows}.values() if e and l is not None and np.isfinite(e).all() and np.any(e)]
    links = {i: 0 for i, _, _ in rows}
    for i, x, l in good:
        for j, y, m in good:
            if i != j and l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[i] += 1
    found = sum(got[i].n_links for i in links)
    assert all(got[i].n_links <= n for i, n in links.items()) and found >= 0.98 * sum(links.values())
    assert got[9001].component_id == rows[0][0] and not got[9001].kept and got[9002].kept


def test_embedding_audit_needs_true_partners():
    class Narrow:
        """Finds a query itself at any beam, and others from a beam of 100 on."""

        def search(self, q, beam, floor):
            hits = np.flatnonzero(x @ q >= floor)
            return [j for j in hits if beam >= 100 or x[j] @ q > 0.9999]

    x = np.eye(400)
    x[101] = 0.95 * x[100] + np.sqrt(1 - 0.95**2) * x[101]
    ids = np.arange(400)
    own = embed_hnsw._search_block(Narrow(), x, x, 0.93, ids, ids)
    assert {100, 101} == set(own[100].tolist()) == set(own[101].tolist())
    other = embed_hnsw._search_block(Narrow(), x, np.concatenate([np.roll(np.eye(400), 1, 1)[:100] * -1, x[101:102]]), 0.93, ids, ids[:101] + 1000)
    assert set(other[100].tolist()) == {100, 101} and not any(len(c) for c in other[:100])


def test_embeddings_over_small_shards(spark, monkeypatch):
    monkeypatch.setattr(embed_hnsw, "SHARD", 60)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(450, 24))
    near = base[:150] + 0.2 * rng.normal(size=(150, 24))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, near]))]
    got = {r.vec_id: r for r in embed_hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.93).sum(axis=1) - 1
    found = sum(got[i].n_links for i in range(len(x)))
    print("links", links.sum(), "found", found)
    assert all(got[i].n_links <= n for i, n in enumerate(links)) and found >= 0.98 * links.sum() > 200


def test_registered_queries_run(spark, sf):
    from __spark_entry__ import queries as every

    assert set(queries()) < set(every()) and "pipeline" in every()


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, sf)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and sum(q == (d in ids) for d, q in labels.items()) > 0.95 * len(labels)
    one = stages["n-gram Jaccard join"](spark, docs, sf).collect()
    want = brute.jaccard_components([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in one) == sorted(d for d, (_, c) in want.items() if d == c)
    assert corpus_pipeline.run(spark, sf).count() > 100


def test_embeddings_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, n_links string, rep int"
    assert embed_hnsw.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 5), (2, [2.0, 0.0], 5), (3, [1.0, 0.0], 6), (4, [1.0, 0.0], None), (5, None, 5), (6, [], 5), (7, [0.0, 0.0], 5), (8, [inf, 0.0], 5), (9, [nan, 1.0], 5), (10, [None, 1.0], 5), (11, [1.0, 0.0, 0.0], 5), (2, [2.0, 0.0], 5)]
    got = embed_hnsw.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], schema)).collect()
    assert len(got) == len(rows)
    for r in got:
        linked = r.vec_id in (1, 2)
        assert (r.n_links, r.component_id, r.kept) == (int(linked), 1 if linked else r.vec_id, r.vec_id != 2)


def test_chat_long_texts_and_other_columns(spark):
    long = "[INST] </s> <|x|> & " * 20_000
    rows = [(1, 0, "user", long, "a", 1), (1, 1, "assistant", long + "!", "b", 2), (2, 0, "assistant", "short", None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, n long")
    got = {r.conv_id: r for r in chat_prefix.conversation_digests(chat_prefix.format_examples(turns)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (2, len(long) + 1, brute.sha((long + "!").encode())) and got[2].loss_chars == 5
    empty = spark.createDataFrame([], turns.schema)
    assert chat_prefix.conversation_digests(chat_prefix.format_examples(empty)).count() == 0


def test_packing_and_licenses_of_repeated_rows(spark):
    docs = [(4, "one text of a few words"), (4, "one text of a few words"), (None, "no id"), (5, license_digest._MIT), (5, license_digest._MIT)]
    pieces = concat_packing.pack(frame(spark, docs), RANKS, PATTERN).collect()
    n = {t: len(brute.encoding().encode_ordinary(t)) + 1 for _, t in docs}
    assert sum(p.length for p in pieces) == sum(n[t] for _, t in docs)
    assert sorted(p.offset for p in pieces if p.sequence_id == 0)[0] == 0
    got = license_digest.scan(frame(spark, docs)).collect()
    assert len(got) == len(docs) and sorted(str(r.license) for r in got) == ["MIT", "MIT", "None", "None", "None"]


def test_pipeline_edges(spark, sf):
    """Nulls, repeated rows, long texts and columns of clashing names through every stage; an empty table too."""
    import corpus_pipeline

    good = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id").limit(6).collect()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, spans string, _doc int, score double, predicted string, new string, component_id int, h1 int"
    row = lambda d, t: (d, t, "en", None, len(t or ""), "k", "s", 1, 0.5, "p", "n", 2, 3)
    docs = [row(k, t) for k, t in enumerate(good)] + [row(k + 100, t) for k, t in enumerate(good[:3])] + [row(0, good[0]), row(None, good[1]), row(200, None), row(201, ""), row(202, " ".join(good) * 20), row(203, good[2] + " write to some.one@example.org")]
    for rows in (docs, []):
        df = spark.createDataFrame(rows, schema)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, sf)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == df.columns, name
                if name != "quality classifier":  # texts change, the other columns do not
                    assert all(tuple(r)[5:] == row(0, "")[5:] for r in out.collect()), name
        if not rows:
            assert out.count() == 0
    df = spark.createDataFrame(docs, schema)
    one = corpus_pipeline.keep_one_of_near(spark, df, sf).collect()
    want = brute.jaccard_components([(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None])
    assert sorted(r.doc_id for r in one if r.doc_id is not None) == sorted(d for d, (_, c) in want.items() if d == c) and sum(r.doc_id is None for r in one) == 1
    cut = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, df.where("doc_id < 200 and doc_id > 0"), sf).collect()}
    ids = [d for d in sorted(cut)]
    kept = brute.dedup([(r.doc_id, r.text) for r in df.where("doc_id < 200 and doc_id > 0").collect()])
    assert [len(cut[d].encode()) for d in ids] == [kept[d][0] - kept[d][1] for d in ids]
    red = {r.doc_id: r.text for r in corpus_pipeline.redact_pii(spark, df, sf).collect()}
    assert red[203].endswith("write to [EMAIL]") and red[200] is None
    pieces = corpus_pipeline.pack(spark, df, sf)
    assert pieces.agg({"length": "sum"}).first()[0] == sum(len(brute.encoding().encode_ordinary(r.text or "")) + 1 for r in df.collect())


def test_edited_words_are_looked_up_once(monkeypatch):
    """The words at both cuts take one pass, and the edited text's words are those of the whole text."""
    from helixframe.llm import spotsigs as S

    texts = ["", " ", "one", "a b c d e f g", " the end of it ", "é x y the zz", "word,word \x1c the\n of and", "x" * 50 + " of the " + "y" * 9]
    for a in texts:
        for b in texts:
            cut = len(a) // 3
            keep, calls = len(a) - cut, []
            v, w = S.tokens(a), S.tokens(b)
            want = S.tokens(a[:keep] + b[:cut]).tolist()
            with monkeypatch.context() as m:
                m.setattr(S, "tokens", lambda t, real=S.tokens: calls.append(t) or real(t))
                assert S.edited_tokens(a, v, keep, b, w, cut).tolist() == want
            assert len(calls) == 1
