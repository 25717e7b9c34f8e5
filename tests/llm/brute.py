"""Brute-force versions of the corpus operators, over lists of (doc_id, text)."""

import bisect
import hashlib
import re
import zlib

import public_tokenizers
import tiktoken
from helixframe.llm.bpe_codec import load_ranks

sha = lambda b: hashlib.sha256(b).hexdigest()


def encoding():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    spans, counts = [], []
    for k, (kind, pattern, ok) in enumerate(rules):
        got = [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if ok(m[0])]
        counts.append(len(got))
        spans += got
    return counts, [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard_components(docs):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {d: (len(sets[d]), find(d)) for d in sets}


def dedup(docs, n=100):
    seen, out = set(), {}
    for d, t in sorted(docs):
        data = (t or "").encode()
        cut = bytearray(len(data))
        for i in range(len(data) - n + 1):
            w = data[i : i + n]
            if w in seen:
                cut[i : i + n] = b"\1" * n
            else:
                seen.add(w)
        kept = bytes(b for b, c in zip(data, cut) if not c)
        spans = sum(1 for i, c in enumerate(cut) if c and not (i and cut[i - 1]))
        out[d] = (len(data), len(data) - len(kept), spans, sha(kept))
    return out


def check_packing(pieces, docs, window=1024):
    """Asserts that pieces (dicts) hold each document's ids once, gapless, in windows."""
    enc = encoding()
    ids = {d: enc.encode_ordinary(t or "") + [0] for d, t in docs}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == ids.keys()
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            part = ids[d][at : at + p["length"]]
            assert (p["start"], p["doc_tokens"]) == (at, len(ids[d])) and len(part) == p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += p["length"]
        assert at == len(ids[d])
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or (s == max(by_seq) and at < window)


def spots(text):
    """The signature set of a text as tuples of words."""
    from helixframe.llm.spotsigs import _EDGE, ANCHORS

    words = [w.strip(_EDGE) for w in text.lower().split()]
    content = [i for i, w in enumerate(words) if w and w not in ANCHORS]

    def chains(starts):
        out = set()
        for i in starts:
            k = bisect.bisect_right(content, i)
            after = content[k : k + 3]
            if len(after) == 3:
                out.add((words[i], *(words[j] for j in after)))
        return out

    return chains([i for i, w in enumerate(words) if w in ANCHORS]) or chains(content) or {text}


def spot_components(docs):
    sets = {d: spots(t) for d, t in docs if t and t.strip()}
    root = {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids := sorted(sets)):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 4 * len(x & y) >= 3 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in root}
