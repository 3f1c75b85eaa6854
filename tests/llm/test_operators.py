"""The operators against brute force, libraries, round trips and held-out labels, on small fixtures."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from tidewater.llm import _grouping, _spark, bpe, fingerprint, html_text, maxent, minhash, packing, quality, suffix, token_counts, toxicity
from tidewater.llm._text import column_bytes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, set_key string, label int"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def corpus():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows, many scripts."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdehinrst") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(120), text(60)
    out = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, base), (7, base), (8, base + " tail"), (9, base.replace(" ", "\n", 3)), (None, base), (6, base)]
    for k in range(10, 30):
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((k, " ".join(w)))
    out += [(k, text(30) + " " + passage + " " + text(30)) for k in range(30, 40)]
    out += [(40, text(4000)), (41, "é漢字 naïve ÀÉ!! x\x1cy z 12345 don't" * 9), (42, "a" * 3000), (43, "same line\n" * 40), (44, "x"), (45, "ab" * 700)]
    return [(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(docs, nothing, corpus):
    sets = [(r[0], shingles(r[1])) for r in corpus]
    known = [(i, s) for i, s in sets if i is not None and s]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if 100 * len(a & b) >= 75 * len(a | b) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = Counter((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets)
    assert Counter(map(tuple, minhash.near_duplicates(docs).collect())) == want
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({i for i in root if find(i) == i})


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """One group of near copies far larger than a block."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, root = [shingles(t) for t in texts], list(range(90))
    for i in range(90):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == dict(enumerate(root))


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in _spark.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100, 102: 100}


def test_components_say_when_they_have_not_settled(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="settle"):
        _spark.components(edges, most_rounds=2)


def test_repeated_ids_keep_their_texts(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(40))
    rows = [(2, text("b"), "z"), (5, text("a"), "z"), (5, text("b"), "y"), (5, text("c"), "y"), (5, text("c"), "x"), (7, None, "n"), (7, None, "m"), (None, text("a"), "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter([(2, text("b"), "z"), (5, text("a"), "z"), (5, text("c"), "x"), (7, None, "m"), (None, text("a"), "q")])
    for n in (1, 5):
        out = minhash.drop_near_duplicates(df.repartition(n))
        assert out.columns == df.columns and Counter(tuple(r) for r in out.collect()) == want


def test_queries_match_their_sql(spark):
    import duckdb

    from tidewater.llm import queries

    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, SF), db.sql(sql)
        assert Counter(tuple(r) for r in got.select(*want.columns).collect()) == Counter(want.fetchall()), name


def test_bpe(docs, nothing, corpus):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in corpus:
        ids, raw = own.encode_ordinary(r[1] or ""), (r[1] or "").encode()
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, path, P.PATTERN).collect())) == want
    assert bpe.round_trip(nothing, path, P.PATTERN).count() == 0


def test_section_tokens(docs, nothing, corpus):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in corpus:
        text = r[1] or ""
        parts = text.splitlines(keepends=True) if "\n" in text and "\x1c" not in text else [text]
        of_byte = [k for k, p in enumerate(parts) for _ in p.encode()]
        ids, at, count = own.encode_ordinary(text), 0, Counter()
        for i in ids:
            n = len(own.decode_single_token_bytes(i))
            held = Counter(of_byte[at : at + n])
            count[min(held, key=lambda k: (-held[k], k))] += 1
            at += n
        start = 0
        for k, p in enumerate(parts):
            want[r[0], k, start, len(p), count[k], len(ids)] += 1
            start += len(p)
    assert Counter(map(tuple, token_counts.section_tokens(docs, path, P.PATTERN).collect())) == want
    assert token_counts.section_tokens(nothing, path, P.PATTERN).count() == 0


def test_packing_starts_no_workers_for_its_strategies(spark, docs, corpus, monkeypatch):
    """A list given to createDataFrame is dealt out through Python: a second set of workers on every executor."""
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **k: pytest.fail("rows of a list go through Python workers"))
    assert packing.pack(docs, P.path("word_bpe_49k.json")).select("doc_id").distinct().count() == len({r[0] for r in corpus})
    assert packing._table(spark, [], ["bin"]).count() == 0


def test_packing_learns_new_chunks_in_parts(corpus, monkeypatch):
    texts = [t or "" for _, t, *_ in corpus]
    flat, offsets = column_bytes(pa.array(texts, pa.large_string()))
    whole = packing.WordCache(P.path("word_bpe_49k.json")).encode(flat, offsets)
    most, ids_of = [], packing.WordCache._ids_of
    monkeypatch.setattr(packing, "_LEARNT", 7)
    monkeypatch.setattr(packing.WordCache, "_ids_of", lambda self, new: most.append(len(new)) or ids_of(self, new))
    parts = packing.WordCache(P.path("word_bpe_49k.json")).encode(flat, offsets)
    assert max(most) == 7 and len(most) > 10 and all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_packing(docs, nothing, corpus):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    rows = packing.pack(docs, path).collect()
    want = Counter((r[0], tuple(own.encode(r[1] or "", add_special_tokens=False).ids) + (2,)) for r in corpus)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    full = {(i, len(t)): (np.array(t, "<u4"), n) for (i, t), n in want.items()}
    assert set(pieces) == set(full)
    for key, own_pieces in pieces.items():
        ids, times = full[key]
        assert sum(p["length"] for p in own_pieces) % len(ids) == 0 and len(own_pieces) >= times
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in own_pieces)
    for own_pieces in sequences.values():
        at = 0
        for p in sorted(own_pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    assert sum(sum(p["length"] for p in s) < 4096 for s in sequences.values()) <= 1
    assert packing.pack(nothing, path).count() == 0


def test_nnls():
    rng = np.random.default_rng(1)
    a, b = rng.random((12, 30)), rng.random(12) * 9
    x = packing.nnls(a, b)
    gradient = a.T @ (b - a @ x)
    assert (x >= 0).all() and gradient.max() < 1e-6 and abs(gradient[x > 0]).max() < 1e-6


def test_strategies_place_most_remainders():
    rng = np.random.default_rng(1)
    for mu, most in ((6.6, 0.85), (8.0, 0.85), (4.5, 0.0)):
        n = np.minimum(40950, rng.lognormal(mu, 0.8, 5000)).astype(int) % 4096
        h = np.bincount(-(-n[n > 0] // 64) - 1, minlength=64)
        got, left = packing.repeats(h), h.copy()
        for plan, count in got:
            assert sum(plan) == 64 and len(plan) <= packing.DEPTH and count > 0
            for b in plan:
                left[b - 1] -= count
        placed = sum(len(plan) * count for plan, count in got)
        assert (left >= 0).all() and left @ np.arange(1, 65) >= placed / 2  # what is left fills the gaps
        assert (h - left) @ np.arange(1, 65) >= most * (h @ np.arange(1, 65))
    assert packing.repeats(np.zeros(64, int)) == []


def test_suffix_arrays():
    rng = random.Random(2)
    for _ in range(200):
        texts = [[rng.randint(1, rng.choice([1, 2, 3, 9, 300])) for _ in range(rng.randint(0, 70))] + [0] for _ in range(rng.randint(1, 9))]
        bounds = np.cumsum([0, *map(len, texts)])
        got = _grouping.suffix_arrays(np.array(sum(texts, []), np.uint16), bounds)
        for s, a, b in zip(texts, bounds, bounds[1:], strict=False):
            assert (got[a:b] - a).tolist() == sorted(range(len(s)), key=lambda i, s=s: s[i:])
    assert len(_grouping.suffix_arrays(np.zeros(0, np.uint16), np.zeros(1, np.int64))) == 0


def test_repeated_windows():
    rng = random.Random(3)
    parts = ["".join(rng.choices("ab", k=rng.randint(1, 15))).encode() for _ in range(9)]
    for _ in range(50):
        regions = [b"".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(rng.randint(1, 12))]
        text = sorted(rng.randint(0, 3) for _ in regions)
        offsets, flat = np.cumsum([0, *map(len, regions)]), np.frombuffer(b"".join(regions), np.uint8)
        order = np.array(rng.sample(range(10**6), len(flat)))
        window, _, earliest = suffix.repeated_windows(flat, offsets, np.array(text), order, 10)
        groups = defaultdict(list)
        for r, t in enumerate(text):
            for k in range(offsets[r], offsets[r + 1] - 9):
                groups[t, flat[k : k + 10].tobytes()].append(k)
        assert sorted(window.tolist()) == sorted(k for g in groups.values() for k in g)
        assert {k for k, e in zip(window.tolist(), earliest, strict=True) if e} == {min(g, key=lambda k: order[k]) for g in groups.values()}


@pytest.mark.parametrize("block", [32, 2])
def test_suffix_dedup(docs, nothing, corpus, monkeypatch, block):
    monkeypatch.setattr(suffix, "BLOCK", block)
    monkeypatch.setattr(suffix, "HOT", 128 * block - 252)  # 4 with small blocks: copies by broadcast and by key
    seen, want = set(), {}
    for i, t in sorted({(r[0], r[1] or "") for r in corpus}, key=lambda x: (x[0] is not None, x[0] or 0)):
        raw = t.encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(w)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[i, len(raw)] = (sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    got = suffix.removal_report(docs).collect()
    assert len(got) == len(corpus)
    assert all((r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"], r["n_bytes"]] for r in got)
    if block == 32:
        assert suffix.removal_report(nothing).count() == 0
        assert suffix.drop_repeats(docs).columns == docs.columns


def test_quality_counts(docs, corpus, spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    want = Counter()
    for r in corpus:
        t = r[1] or ""
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:]))
        marked = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked), failed] += 1
    got = quality.judge(docs, labels).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(r["kept"] is (not r["base_failed"]) for r in got)  # too few labels certify nothing


def test_quality_bounds():
    for k, n in ((0, 20), (3, 50)):
        p = quality.binomial_upper(k, n, 0.01)
        assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(0.01, rel=1e-6)
    good, bad = np.zeros(64, int), np.zeros(64, int)
    good[2], bad[40] = 2000, 30
    assert quality.certified_cutoff(good, bad, 0.001) == 40
    assert quality.certified_cutoff(good // 100, bad, 0.001) == 64  # too few good documents
    bad[:], bad[2] = 0, 30
    assert quality.certified_cutoff(good, bad, 0.001) == 64


def test_toxicity(spark, docs, nothing):
    rng = random.Random(4)
    words = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    rows, marks = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(60)]
        if bad := i % 4 == 0:
            for t in rng.sample(["grimblot", "snorvex", "plagwit"], 2):
                w[rng.randrange(60)] = t if rng.random() < 0.7 else t[:3] + "q" + t[4:]
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(df, model, ["doc_id"]).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scored[i] >= 0.5) == (i % 4 == 0) for i in held) / len(held) > 0.95
    got = toxicity.score(docs, model, ["doc_id", "label"]).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(nothing, model, ["doc_id"]).count() == 0


def test_automaton():
    entries = ["idiot", "moron", "worthless"]
    trie = toxicity.Trie(entries)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, last = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    rng = random.Random(6)
    for _ in range(3000):
        w = list(rng.choice(entries))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "oi", "s"])
            w = w or ["a"]
        w = "".join(w)
        want = min((distance(w, e) for e in entries if distance(w, e) <= toxicity.edits(e)), default=None)
        got = trie.near(w)
        assert (got and got[1]) == want, w


def test_maxent(docs, nothing, corpus):
    tokens = [(r[0], [*WORD.findall(lower(r[1] or "")), "\0end"]) for r in corpus]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in tokens)
    got = maxent.model_scores(docs).collect()
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert maxent.model_scores(nothing).count() == 0


def test_maxent_is_a_probability_and_helps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = maxent.train(_spark.id_text(docs))
    rng = np.random.default_rng(1)
    ids = rng.integers(0, maxent.HASHED, (50, 3)) + np.array([0, maxent.HASHED, 2 * maxent.HASHED]) % maxent.FEATURES
    ids[:, 2] = 2 * maxent.HASHED
    p = np.exp(maxent.log_classes(ids, model["weights"], model["bias"]))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    k = rng.integers(0, maxent.CLASSES, 50)
    own = maxent.leaf_rows(rng.integers(0, 2**63, 50, dtype=np.uint64), np.zeros(50, int), k)
    assert np.allclose(np.exp(maxent.log_leaves(own, k, model["leaf_weights"], model["leaf_bias"])).sum(axis=1), 1, atol=1e-4)
    counted = model["vocabulary"].toPandas()
    at = model["class_of"][counted["bucket"]] * maxent.LEAVES + maxent.leaves(counted["word"].to_numpy(np.int64).view(np.uint64))
    share = np.bincount(at, weights=counted["c"] + 1.0, minlength=maxent.CLASSES * maxent.LEAVES) + 1  # all words of a leaf and one unknown
    assert np.allclose(share, (model["n"] + model["v"] + 1).ravel())
    held = maxent.score(_spark.id_text(docs), model).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    flat = maxent.score(_spark.id_text(docs), model | {"leaf_weights": np.zeros_like(model["leaf_weights"])}).where("held_out").agg(F.sum("score")).first()
    assert held[0] > flat[0] > held[1]


def plain_tokens(text):
    """(hash, bucket) of each token, an end last."""
    h, b, _ = maxent.tokens(*column_bytes(pa.array([text], pa.large_string())))
    return list(zip(h.tolist(), b.tolist(), strict=True))


def plain_history(seq, i, class_of):
    """Rows of the class weights and buckets of the leaf features, word by word."""
    start, one64 = int(maxent.START_HASH), lambda x: int(maxent.mix(np.array([x], np.uint64))[0])
    h = [seq[i - d][0] if i >= d else start for d in (1, 2)]
    k = [int(class_of[seq[i - d][1]]) if i >= d else maxent.CLASSES for d in (1, 2)]
    ids = [h[0] % maxent.HASHED, h[1] % maxent.HASHED + maxent.HASHED, k[0] * (maxent.CLASSES + 1) + k[1] + 2 * maxent.HASHED]
    hashed = [(one64(x) >> 20) % maxent.LEAF_HASHED + d * maxent.LEAF_HASHED for d, x in enumerate(h)]
    return ids, hashed, (one64(seq[i][0]) >> 40) % maxent.LEAVES


def plain_softmax(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_maxent_score_equals_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", 40)  # most words come by the join
    rows = [(r[0], r[1]) for r in corpus if r[0] not in (40, 43, 45)]
    model = maxent.train(_spark.id_text(spark.createDataFrame(rows, "doc_id long, text string")))
    counts = {r["word"] & (2**64 - 1): r["c"] for r in model["vocabulary"].collect()}
    want = Counter()
    for doc, text in rows:
        seq, total = plain_tokens(text), 0.0
        for i, (h, b) in enumerate(seq):
            k = int(model["class_of"][b])
            ids, hashed, leaf = plain_history(seq, i, model["class_of"])
            p = plain_softmax([float(model["bias"][c]) + sum(float(model["weights"][f, c]) for f in ids) for c in range(maxent.CLASSES)])
            q = plain_softmax([float(model["leaf_bias"][k, x]) + sum(float(model["leaf_weights"][f * maxent.CLASSES + k, x]) for f in hashed) for x in range(maxent.LEAVES)])
            total += math.log10(p[k] * q[leaf] * (counts.get(h, 0) + 1) / (model["n"][k, leaf] + model["v"][k, leaf] + 1))
        want[doc, round(total, 2)] += 1
    got = Counter((r["doc_id"], round(r["score"], 2)) for r in maxent.score(_spark.id_text(spark.createDataFrame(rows, "doc_id long, text string")), model).collect())
    near = lambda c: sorted((-1 if i is None else i, x) for (i, x), n in c.items() for _ in range(n))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 0.02 for a, b in zip(near(got), near(want), strict=True))


def test_maxent_gradient_equals_brute_force():
    rng = np.random.default_rng(3)
    model = {
        "class_of": rng.integers(0, maxent.CLASSES, maxent.SUFFIXES + 1), "weights": rng.normal(
            0, 0.3, (maxent.FEATURES, maxent.CLASSES)
        ).astype(np.float32), "bias": rng.normal(0, 1, maxent.CLASSES).astype(np.float32),
        "leaf_weights": rng.normal(
            0, 0.3, (2 * maxent.LEAF_HASHED * maxent.CLASSES, maxent.LEAVES)
        ).astype(np.float32), "leaf_bias": rng.normal(0, 1, (maxent.CLASSES, maxent.LEAVES)).astype(np.float32),
    }
    texts = ["one two three two one", "", "two two", "a b c d e f g a b c"]
    want: dict = defaultdict(lambda: np.zeros(2 * maxent.CLASSES))
    for t in texts:
        seq = plain_tokens(t)
        for i, (_, b) in enumerate(seq):
            k = int(model["class_of"][b])
            ids, hashed, leaf = plain_history(seq, i, model["class_of"])
            p = plain_softmax((model["bias"] + model["weights"][ids].sum(axis=0)).tolist())
            own = [f * maxent.CLASSES + k for f in hashed]
            q = plain_softmax((model["leaf_bias"][k] + model["leaf_weights"][own].sum(axis=0)).tolist())
            for f in ids:
                want[0, f][k] += 1
                want[0, f][maxent.CLASSES :] += p
            for f in own:
                want[1, f][leaf] += 1
                want[1, f][maxent.LEAVES :] += q
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    got = {(r[0], r[1]): r[2:] for b in maxent._gradient(model)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert set(got) == set(want) and all(np.allclose(got[f], want[f], atol=1e-3) for f in want)


def random_model(scale):
    rng = np.random.default_rng(5)
    draw = lambda *shape: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "class_of": rng.integers(0, maxent.CLASSES, maxent.SUFFIXES + 1), "weights": draw(maxent.FEATURES, maxent.CLASSES),
        "leaf_weights": draw(2 * maxent.LEAF_HASHED * maxent.CLASSES, maxent.LEAVES), "bias": rng.normal(0, 1, maxent.CLASSES).astype(np.float32),
        "leaf_bias": rng.normal(0, 1, (maxent.CLASSES, maxent.LEAVES)).astype(np.float32),
    }


def gradient_rows(model, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    return {(r[0], r[1]): np.array(r[2:]) for b in maxent._gradient(model)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}


def test_maxent_counts_what_is_observed_once():
    """Observed counts don't depend on the weights: they are left out for a model that has them, and what is expected stays the same."""
    model, texts = random_model(0.3), ["one two three two one", "", "two two", "a b c d e f g a b c"]
    both, later = gradient_rows(model, texts), gradient_rows(model | {"seen": []}, texts)
    assert set(both) == set(later)
    assert all(len(later[f]) == maxent.CLASSES and np.allclose(later[f], both[f][maxent.CLASSES :], atol=1e-5) for f in both)


def test_maxent_first_update_needs_no_softmax_of_tokens(monkeypatch):
    """While all weights are zero, the expected counts are those of the bias; weights as good as zero go the long way to the same."""
    texts = ["one two three two one", "", "two two", "a b c d e f g a b c"]
    model = random_model(0)
    near = gradient_rows(model | {"weights": model["weights"] + np.float32(1e-9), "leaf_weights": model["leaf_weights"] + np.float32(1e-9)}, texts)
    monkeypatch.setattr(maxent, "_expect", None)
    got = gradient_rows(model, texts)
    assert set(got) == set(near) and all(np.allclose(got[f], near[f], atol=1e-4) for f in near)


def test_maxent_blocks_and_pieces_join_seamlessly(monkeypatch):
    texts = ["one two three two one", "", "two two", "a b c d e f g a b c", " ", "caf\u00e9 x" * 9]
    want, seq = gradient_rows(random_model(0.3), texts), maxent.tokens(*column_bytes(pa.array(texts, pa.large_string())))
    monkeypatch.setattr(maxent, "BLOCK", 3)
    monkeypatch.setattr(maxent, "SLICE_BYTES", 8)
    got = gradient_rows(random_model(0.3), texts)
    assert set(got) == set(want) and all(np.allclose(got[f], want[f], atol=1e-5) for f in want)
    assert all(np.array_equal(a, b) for a, b in zip(seq, maxent.tokens(*column_bytes(pa.array(texts, pa.large_string()))), strict=True))


def test_maxent_updates_see_every_document(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"a{k} b{k} c") for k in range(60)], "doc_id long, text string")
    passes, gradient = [spark.sparkContext.accumulator(0) for _ in range(maxent.UPDATES)], maxent._gradient
    left = iter(passes)

    def counted(model):
        seen, run = next(left), gradient(model)
        return lambda batches: run(b for b in batches if seen.add(len(b)) is None)

    monkeypatch.setattr(maxent, "_gradient", counted)
    maxent.train(docs)
    assert [p.value for p in passes] == [docs.where(maxent.in_training()).count()] * maxent.UPDATES


def test_maxent_contexts_stay_apart():
    column = lambda text: pa.array([text], pa.large_string())
    bucket = lambda w: int(maxent.tokens(*column_bytes(column(w)))[1][0])
    of = {}
    for k in range(20000):
        of.setdefault(bucket(f"w{k:05d}"), f"w{k:05d}")
    a, b = next((w, of[k + 128]) for k, w in sorted(of.items()) if k % 256 < 128 and k + 128 in of)
    out = pa.Table.from_batches(maxent._count(iter([pa.RecordBatch.from_arrays([column(f"{a} same {b} same")], names=["text"])])))
    cells = out.filter(pa.compute.is_null(out["word"])).to_pandas()
    assert cells.loc[cells["bucket"] // maxent.CONTEXTS == bucket("same"), "c"].tolist() == [1, 1]


def test_fingerprints(docs, nothing, corpus):
    rows = sorted({(r[0], r[1] or "") for r in corpus}, key=lambda x: -(x[0] if x[0] is not None else -1))
    edited = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited[i, len(t)] = hashlib.sha256((t[: len(t) - len(t) // 2] + following[: len(t) // 2]).encode()).hexdigest()
    got = fingerprint.compare_edited(docs).collect()
    assert len(got) == len(corpus)
    assert all(r["edited_sha256"] == edited[r["doc_id"], r["n_chars"]] for r in got)
    of = defaultdict(set)
    for r in got:
        of[r["doc_id"]].add(r["fingerprint"])
    assert of[6] == of[7] == of[None] and len(of[6]) == 1 and of[1] == of[2] == of[3]
    assert fingerprint.compare_edited(nothing).count() == 0


def test_sampling_meets_generalised_jaccard(spark):
    a, b = {f"w{k}": 1 + k % 5 for k in range(60)}, {f"w{k}": 1 + k % 3 for k in range(20, 80)}
    text = lambda x: " ".join(w for w, n in x.items() for _ in range(n))
    df = spark.createDataFrame([(1, text(a)), (2, text(b))], "id long, text string").repartition("id")
    rows = {r["id"]: r["text"] for r in fingerprint.fingerprints(df, ["id"], ["text"], 2000).collect()}
    same = sum(rows[1][8 * k : 8 * k + 8] == rows[2][8 * k : 8 * k + 8] for k in range(2000)) / 2000
    words = a.keys() | b.keys()
    want = sum(min(a.get(w, 0), b.get(w, 0)) for w in words) / sum(max(a.get(w, 0), b.get(w, 0)) for w in words)
    assert len(rows[1]) == 16000 and abs(same - want) < 0.04


def test_exponential_draws(spark):
    """Every pattern of bits against the logarithm, and the mean and the variance of a gamma draw."""
    n = 1 << fingerprint.BITS
    bits = spark.range(n * n)
    got = bits.select("id", fingerprint._exponential(F.col("id"), 0).alias("e")).toPandas()
    low, x = (got["id"] % n).to_numpy(), (got["id"] // n).to_numpy() + 0.5
    zeros = np.array([fingerprint.BITS if v == 0 else (v & -v).bit_length() - 1 for v in low.tolist()])
    assert np.abs(got["e"] - (zeros * np.log(2) - np.log(1 - x / (2 * n)))).max() < 1e-4
    assert abs(got["e"].mean() - 1) < 0.01 and abs(got["e"].var() - 1) < 0.02
    c = np.exp(np.linspace(np.log(5e-4), np.log(30), 5000))
    y = (c**0.25 - fingerprint._MIDDLE) / (c**0.25 + fingerprint._MIDDLE)
    logs = spark.createDataFrame([(float(v),) for v in y], "y double").select(fingerprint._four_logs(F.col("y")).alias("x")).toPandas()["x"]
    assert np.abs(np.sort(logs) - np.log(c)).max() < 1e-4


def test_fingerprint_likenesses(docs, corpus):
    """Likenesses of whole documents against the exact similarities: no bias, and the stated error."""
    def similarity(a, b):
        x, y = (Counter(w for w in re.split("[ \t-\r]+", t.lower()) if w) for t in (a, b))
        top = sum(max(x[w], y[w]) for w in x.keys() | y.keys())
        return sum(min(x[w], y[w]) for w in x.keys() | y.keys()) / top if top else 1.0

    rows = sorted({(r[0], r[1] or "") for r in corpus if r[0] is not None}, key=lambda x: -x[0])
    rows += [(None, next(r[1] for r in corpus if r[0] is None))]
    want = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        want[i] = (similarity(t, edited), similarity(t, following))
    errors = []
    for r in fingerprint.compare_edited(docs).collect():
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 8 * fingerprint.SAMPLES
        for got, exact in zip((r["near_edited"], r["near_next"]), want[r["doc_id"]], strict=True):
            errors.append(got - exact)
            assert exact not in (0, 1) or got == exact
    errors = np.array(errors)
    assert np.sqrt((errors**2).mean()) < 0.5 / np.sqrt(fingerprint.SAMPLES) * 1.3 and abs(errors.mean()) < 0.03 and np.abs(errors).max() < 0.25


def test_html(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a>x</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<main><h1>Head &amp; line</h1><p>First\n  <b>bold</b> text &copy now.<p>Second<script>var a='</p>';</script> part<br>more<div class=\"related-posts\"><p>Read this</p></div>"
        "<section id=comments><p>Nice article!</p></section><form><p>Mail</p></form><p>Last &#x41;&#66;</p></main><aside>Side</aside><footer>&copy; us</footer>"
    )
    assert html_text.main_text(page) == "Head & line\n\nFirst bold text © now.\n\nSecond part more\n\nLast AB"
    good = "The house of the man is in the town and it was the one that he had for all of the years that they were there with us. " * 3
    assert html_text.main_text(f"<div><a>one</a> <a>two</a></div><div>{good}</div><div>Short one.</div><div>{good}</div><div><a>end</a></div>") == f"{good.strip()}\n\nShort one.\n\n{good.strip()}"
    rows = [(1, "u", page, 0), (1, "u", None, 0), (None, None, "", 0), (2, "v", "<p", 0), (3, "w", "<" * 20000 + "<a b='" * 2000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract(df).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


def labelled_pages():
    """(html, the blocks of its article): the pages' own markup is the label."""
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{SF.replace('0.001', '0.01')}/pages.parquet")["html"].to_pylist()
    return [(p, [b.text for b in html_text.blocks(f"<article>{m[1]}</article>")]) for p in pages if (m := re.search("<article>(.*?)</article>", p, re.S))]


def quality_of(pages):
    """(precision, recall) in characters of whole blocks."""
    right = found = wanted = 0
    for page, want in pages:
        got, left = [x for x in html_text.main_text(page).split("\n\n") if x], Counter(want)
        found, wanted = found + sum(map(len, got)), wanted + sum(map(len, want))
        for x in got:
            if left[x]:
                left[x] -= 1
                right += len(x)
    return right / found, right / wanted


def test_html_labelled_pages(monkeypatch):
    pages = labelled_pages()
    precision, recall = quality_of(pages)
    assert len(pages) > 200 and precision > 0.999 and recall > 0.999
    kinds = Counter()
    for page, _ in pages:
        for block, first, _ in zip(*html_text.judged(page), strict=True):
            if not block.bad:  # outside of navigation, forms and the like
                kinds["structure" if first == "veto" else "measure" if first in html_text.DECIDED else "neighbours"] += 1
    assert kinds["measure"] + kinds["neighbours"] > 0.8 * sum(kinds.values()) and kinds["neighbours"] > 100
    # without what the markup says: no names, no article, no navigation, only blocks
    monkeypatch.setattr(html_text, "BAD_WORDS", frozenset())
    monkeypatch.setattr(html_text, "HEAD_WORDS", frozenset())
    precision, recall = quality_of(pages)
    assert precision > 0.99 and recall > 0.999
    plain = [(re.sub("(</?)(article|nav|footer)\\b", r"\1div", page), want) for page, want in pages]
    precision, recall = quality_of(plain)
    assert precision > 0.99 and recall > 0.85


def test_html_links_and_nesting():
    good = ("The house of the man is in the town and it was the one that he had for all of the years that they were there with us. " * 3).strip()
    card = "<a href=x><div><h3>The best of the week for all of you and us</h3><p>All that you are to see of it and more of the same for you</p></div></a>"
    assert [round(b.links, 2) for b in html_text.blocks(card)] == [1.0, 1.0]
    assert html_text.main_text(f"<div><p>{good}</p><p>{good}</p></div><div>{card * 3}</div>") == f"{good}\n\n{good}"
    assert [b.links for b in html_text.blocks(f"<div><p>x <a>never closed</p></div><p>{good}</p>")][1] == 0  # a link ends with its element
    assert html_text.main_text(f"<article><p>© {good}</p></article>") == f"© {good}"
    deep = "<div>" * 20000 + "</p>" * 20000 + good + "</span></b></div></div>" * 10000
    began = time.perf_counter()
    assert html_text.main_text(deep) == good
    assert time.perf_counter() - began < 5
    twice = f"<div><p>{good}</p><p>Short.</p><p>{good}</p></div>"
    assert html_text.main_text(twice * 2) == "\n\n".join([good, "Short.", good] * 2)  # repeats and ties keep their order


def test_html_measures_blocks_everywhere():
    good = ("The house of the man is in the town and it was the one that he had for all of the years that they were there with us. " * 3).strip()
    junk = ("Premium hosting bundle deluxe tariffs voucher bargain checkout delivery brands outlet sneakers " * 3).strip()
    two = f"{good}\n\n{good}"
    for tag in ("article", "main"):
        assert html_text.main_text(f"<{tag}><p>{good}</p><div>{junk}</div><div>Order now</div><div>{junk}</div><p>{good}</p></{tag}>") == two
        assert html_text.main_text(f"<{tag} class='no-sidebar'><p>{good}</p><p>{good}</p><div class=comments><p>{good}</p></div></{tag}>") == two
    assert html_text.main_text(f"<div class='widget'><article><p>{good}</p></article></div><div class=footer-share>{junk}</div>") == good
    assert html_text.main_text(f"<div class='no-sidebar'><p>{good}</p><p>{good}</p><div>{junk}</div></div>") == two
    assert html_text.main_text(f"<div class='page'><p>{good}</p></div><div class='comments'><p>{good} No.</p><p>{good} Yes.</p></div>") == good
    assert html_text.main_text(f"<article><p>{junk}</p><p>{junk}</p></article>") == f"{junk}\n\n{junk}"  # no stop words of ours: structure decides


def plain_counts(text):
    """The quality rules' counts of a text, word by word."""
    words = WORD.findall(text)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines),
        "n_repeat_words": len({k + j for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for j in range(3)}),
        "n_upper": sum("A" <= c <= "Z" for c in text), "n_bare_words": sum(not re.search("[A-Za-z\x80-\U0010ffff]", w) for w in words),
    }


def plain_quality(rows, labels):
    """Whether each row (doc_id, text, lang) is kept: base rule and certified cutoffs, with sums in place of histograms."""
    counts = [plain_counts(t or "") for _, t, _ in rows]
    failed = [c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"] for c in counts]

    def bin_of(c, rule):
        over, under, top = quality.RULES[rule]
        return min(quality.STEPS - 1, int(math.floor(c[over] / c[under] * (quality.STEPS / top)))) if c[under] else 0

    known = [(lang, labels[i], c) for (i, _, lang), c, f in zip(rows, counts, failed, strict=True) if i in labels and lang is not None and not f]
    strata = {lang for lang, _, _ in known}
    level, cuts = quality.LEVEL / max(1, len(strata) * len(quality.RULES)), {}
    for lang in strata:
        for rule in quality.RULES:
            good, bad = ([bin_of(c, rule) for x, y, c in known if x == lang and y == v] for v in (1, 0))
            best, value = quality.STEPS, 0
            for at in range(quality.STEPS - 1, 0, -1):
                lost, n = sum(b >= at for b in good), len(good)
                tail = sum(math.comb(n, i) * quality.RISK**i * (1 - quality.RISK) ** (n - i) for i in range(lost + 1))
                if not n or tail > level:  # more probable than the level if the share were RISK: not certified
                    break
                gain = sum(b >= at for b in bad) - quality.GOOD_WEIGHT * lost
                if gain > value:
                    best, value = at, gain
            cuts[lang, rule] = best
    return [not f and all(bin_of(c, r) < cuts.get((lang, r), quality.STEPS) for r in quality.RULES) for (_, _, lang), c, f in zip(rows, counts, failed, strict=True)], cuts


def test_quality_certified_cutoffs(spark):
    """Enough good documents certify a cutoff in one stratum, too few in the other."""
    rng, rows, labels = random.Random(9), [], {}
    text = lambda share: " ".join("w%d%s" % (rng.randrange(10**6), "#" * 3 if rng.random() < share else "") for _ in range(60))
    for k in range(900):
        lang = "aa" if k < 800 else "bb"
        bad = k % 10 == 0
        rows.append((k, text(0.8 if bad else 0.05), lang))
        if k % 3:
            labels[k] = int(not bad)
    rows += [(None, text(0.9), "aa"), (5000, text(0.9), None), (5001, None, "aa"), (5002, "", "bb"), rows[0]]
    kept, cuts = plain_quality(rows, labels)
    assert cuts["aa", "symbols"] < quality.STEPS == cuts["bb", "symbols"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(k, v) for k, v in labels.items()], "doc_id long, quality int")
    got = quality.judge(df.repartition(3), marks).collect()
    assert Counter((r["doc_id"], r["n_words"], r["kept"]) for r in got) == Counter((i, len(WORD.findall(t or "")), k) for (i, t, _), k in zip(rows, kept, strict=True))
    assert not any(k for (i, _, lang), k in zip(rows, kept, strict=True) if lang == "aa" and i is not None and i < 800 and i % 10 == 0)
    stayed = quality.keep_good(df, marks).collect()
    assert Counter(tuple(r) for r in stayed) == Counter(r for r, k in zip(rows, kept, strict=True) if k)


def plain_near(rows):
    """Ids (unique) that stay: the least of each component."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def plain_cut(rows):
    """Texts without the bytes that a 100-byte string covers which also starts earlier."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        out[i] = bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The smallest tables with toxic documents and their labels, enough to learn from."""
    folder, rng = str(tmp_path_factory.mktemp("tables")), random.Random(21)
    words = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(500)]
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    more, marks = [], []
    for k in range(120):
        w = [rng.choice(words) for _ in range(80)]
        if bad := k % 3 == 0:
            for t in rng.sample(["idiot", "moron", "worthless", "pathetic"], 2):
                w[rng.randrange(80)] = t
        more.append((10_000 + k, " ".join(w), "en", "more", len(" ".join(w))))
        marks.append((10_000 + k, 1, int(bad)))
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    labels.unionByName(spark.createDataFrame(marks, labels.schema)).write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_sends_small_batches(spark, nothing):
    """A batch of texts is held several times over by an executor; rows that are set apart by the stage's session alone."""
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('a word ', 400)").alias("text"))  # 17 MB

    def sizes():
        def measure(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([len(b)])], names=["size", "n"])

        got = rows.mapInArrow(measure, "size long, n long").collect()
        assert sum(r["n"] for r in got) == 6000
        return max(r["size"] for r in got)

    try:
        for step, stage in corpus_pipeline.STAGES:
            spark.conf.unset(name)
            assert sizes() > 2 * corpus_pipeline.BATCH_BYTES, step
            stage(spark, nothing, SF)
            assert sizes() <= corpus_pipeline.BATCH_BYTES + 100_000, step
        spark.conf.set(name, "1m")
        stage(spark, nothing, SF)
        assert sizes() <= (1 << 20) + 100_000  # a lower setting stays
    finally:
        spark.conf.unset(name)


def test_pipeline_equals_brute_force(spark, small):
    import corpus_pipeline
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_dedup", "suffix_dedup", "packing"]
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    columns, rows = docs.columns, {r["doc_id"]: r.asDict() for r in docs.collect()}
    assert len(rows) == docs.count()
    step = dict(corpus_pipeline.STAGES)
    held = lambda df: {r["doc_id"]: r.asDict() for r in df.collect()}

    kept, _ = plain_quality([(i, r["text"], r["lang"]) for i, r in rows.items()], {r["doc_id"]: r["quality"] for r in labels.collect()})
    want = {i: r for (i, r), k in zip(rows.items(), kept, strict=True) if k}
    docs = _spark.written(step["quality_rules"](spark, docs, small))
    assert docs.columns == columns and held(docs) == want and len(want) < len(rows)

    model = toxicity.train(docs, labels)
    matcher, w = toxicity.Matcher(model), model["weights"]
    for i, r in list(want.items()):
        chunks = (r["text"] or "").lower().split()
        hits = [(*got, c, chunks[max(0, k - toxicity.WIDE) : k], chunks[k + 1 : k + 1 + toxicity.WIDE]) for k, c in enumerate(chunks) if (got := matcher.look(c))]
        x = toxicity.features(hits, matcher, model["context"]) if hits else [0.0] * len(toxicity.FEATURES)
        if w[0] + sum(a * b for a, b in zip(w[1:], x, strict=True)) >= 0:
            del want[i]
    before, docs = docs.count(), _spark.written(step["toxicity"](spark, docs, small))
    assert docs.columns == columns and held(docs) == want and len(want) < before

    stay = plain_near([(i, r["text"]) for i, r in want.items()])
    want = {i: r for i, r in want.items() if i in stay}
    before, docs = docs.count(), _spark.written(step["near_dedup"](spark, docs, small))
    assert docs.columns == columns and held(docs) == want and len(want) < before

    texts = plain_cut([(i, r["text"]) for i, r in want.items()])
    want = {i: r | {"text": texts[i], "n_chars": len(texts[i])} for i, r in want.items()}
    docs = _spark.written(step["suffix_dedup"](spark, docs, small))
    assert docs.columns == columns and held(docs) == want

    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    own.encode_special_tokens = True
    ids = {i: np.array([*own.encode(r["text"], add_special_tokens=False).ids, 2], "<u4") for i, r in want.items()}
    for rows in (step["packing"](spark, docs, small).collect(), corpus_pipeline.run(spark, small).collect()):
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            pieces[r["doc_id"]].append(r)
            sequences[r["sequence_id"]].append(r)
        assert set(pieces) == set(want)
        for i, parts in pieces.items():
            at = 0
            for r in sorted(parts, key=lambda r: r["start"]):
                assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids[i]), zlib.crc32(ids[i][at : at + r["length"]].tobytes()))
                at += r["length"]
            assert at == len(ids[i])
        for parts in sequences.values():
            ends = [0]
            for r in sorted(parts, key=lambda r: r["offset"]):
                assert r["offset"] == ends[-1]
                ends.append(r["offset"] + r["length"])
            assert ends[-1] <= 4096
        assert sum(sum(r["length"] for r in parts) < 4096 for parts in sequences.values()) <= 1


def test_word_cache_equals_the_library():
    """Marks after capitals, symbols around letters, every kind of white space, and the cache's own separator word."""
    own = packing.WordCache(P.path("word_bpe_49k.json"))
    parts = [*"abIHJTis'\".,!-12 \t\n\x0b\x0c\r\x1c\x1f\x85\xa0İıſßéÉΣς中ำẞ😀²Ⅷǅ", "̱", "̌", "̈", "<|endoftext|>", own.mark, "</w>", "'s", "'ll"]
    draw = random.Random(5)
    texts = ["", " ", *("".join(draw.choices(parts, k=draw.randrange(25))) for _ in range(3000))]
    for _ in range(2):  # unknown, then known
        ids, first = own.encode(*column_bytes(pa.array(texts)))
        for text, a, b in zip(texts, first[:-1], first[1:], strict=True):
            assert ids[a:b].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


CLASHING = (
    "id mark row spans stratum n_words n_lines kept base_failed score _text _id _mark _spans _null text_key set_key sig node x rest _at _word _bits n_symbols cut_symbols _stratum _quality "
    "text_ doc component_id n_shingles pivot toxic low1 window fp region run"
).split()


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(k, int(k % 3 > 0), int(k % 4 == 0)) for k in range(1, 46)], "doc_id long, quality int, toxic int")


def stages(marks):
    return {
        "quality": lambda d: quality.keep_good(d, marks),
        "toxicity": lambda d: toxicity.drop_toxic(d, marks),
        "near": minhash.drop_near_duplicates,
        "suffix": suffix.drop_repeats,
    }


@pytest.mark.parametrize("name", ["quality", "toxicity", "near", "suffix"])
def test_stages_keep_any_columns(spark, docs, corpus, marks, name):
    """Columns that have the names of the operators' own pass through; empty tables, nulls and repeated rows go in."""
    stage = stages(marks)[name]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    wide = plain.select("*", *(F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING))
    out = stage(wide)
    assert out.columns == wide.columns and [f.dataType for f in out.schema] == [f.dataType for f in wide.schema]
    rows = out.collect()
    want = Counter(tuple(r) for r in stage(plain).collect())
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows) == want and want
    assert all(r[c] == f"{c} {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASHING)
    assert all(r["n_chars"] == len(r["text"] or "") for r in rows)
    assert stage(wide.limit(0)).count() == 0


def test_suffix_dedup_of_long_copies(spark):
    """Copies of several segments, shifted, with edits, and one that repeats inside itself."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdehinrst") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(900)
    edited = base[:1500] + "###" + base[1500:3000] + "@" + base[3100:]
    rows = [(1, base), (2, "shifted " + base), (3, edited), (4, text(50) + base[700:2500] + text(50) + base[700:2500]), (5, "ab" * 1500), (6, "xab" * 900 + base[:120]), (7, base)]
    want = plain_cut(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["text"] for r in suffix.drop_repeats(df).collect()} == want


def test_cuts_inside_characters(spark):
    """Two texts share 100 bytes that begin and end inside characters; these go as a whole."""
    shared = "".join(chr(0x4E00 + 37 * k) for k in range(34))  # 102 bytes
    a, b = "䷿" + shared + "䷾", "䶿" + shared + "䶾"  # each neighbour shares its first or last byte with its like
    df = spark.createDataFrame([(1, "left " + a + " right", 9), (2, "other " + b + " side", 9)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r for r in suffix.drop_repeats(df).collect()}
    raw, other = ("other " + b + " side").encode(), ("left " + a + " right").encode()
    gone = [False] * len(raw)
    for k in range(len(raw) - 99):
        if raw[k : k + 100] in other:
            gone[k : k + 100] = [True] * 100
    want = bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
    assert got[1]["text"] == "left " + a + " right" and got[2]["text"] == want and got[2]["n_chars"] == len(want) < 20


@pytest.fixture(scope="module")
def abuse(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    rows = []
    for i in range(900):
        w = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            for t in rng.sample(["idiot", "moron", "worthless", "pathetic"], rng.randint(1, 3)):
                w[rng.randrange(60)] = t
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")


def test_toxicity_masks_misspellings_and_quotations(abuse):
    model = toxicity.train(*abuse)
    score = lambda m, *t: toxicity._scores(pa.array(t, pa.string()), toxicity.Matcher(m), m)
    bad = ["you are such an id1ot and a mor0n", "worthles disgustng pathetc", "such a worthles book", "what an idiiot", "m.o.r.o.n", "looks like an idioooot", "you are an idiot"]
    good = [
        "", "a plain text", "the teacher told the class that \"idiot\" is rude", "he wrote \"you are an idiot\" in his letter",
        "the word idiot comes from greek", "an ideal editor", "path"
    ]
    assert (score(model, *bad) >= 0.5).all() and (score(model, *good) < 0.5).all()
    off = model | {"trust": {(e, k): 0.0 for e in model["words"] for k in (toxicity.MASKED, toxicity.ONE, toxicity.TWO)}}
    assert (score(off, *bad[:-1]) < 0.5).all() and score(off, bad[-1]) >= 0.5  # misspellings act by their own weight
    quoted = "she said \"{}\" and left"
    assert score(model, quoted.format("idiot"))[0] < 0.5 <= score(model, quoted.format("idiot").replace('"', ""))[0]
    assert (np.diff(score(model, "idiot", "idiot moron", "idiot moron worthless")) > 0).all()


def test_toxicity_does_not_depend_on_the_order_of_rows(abuse):
    df, labels = abuse
    one, two = (toxicity.train(d, x) for d, x in ((df, labels), (df.orderBy(F.desc("doc_id")).repartition(5), labels.orderBy(F.rand(3)))))
    assert {k: v for k, v in one.items() if k != "weights"} == {k: v for k, v in two.items() if k != "weights"} and np.allclose(one["weights"], two["weights"])


def test_toxicity_finds_what_a_search_of_each_chunk_finds(abuse):
    model = toxicity.train(*abuse)
    matcher = toxicity.Matcher(model)
    texts = ["", None, "idiot", "x " * 50 + "idiot", "moron\nidiot\tid1ot   pathetc", *[r["text"] for r in abuse[0].limit(60).collect()]]
    want = {}
    for k, t in enumerate(texts):
        chunks = (t or "").lower().split()
        own = [(*got, c, chunks[max(0, i - toxicity.WIDE) : i], chunks[i + 1 : i + 1 + toxicity.WIDE]) for i, c in enumerate(chunks) if (got := matcher.look(c))]
        if own:
            want[k] = own
    assert dict(matcher.hits(pa.array(texts, pa.string()))) == want and len(want) > 10


def test_toxicity_held_out(spark):
    """Recall and precision on held-out labels, whole and without each part."""
    base = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    held = docs.join(labels, "doc_id").where(~toxicity.in_training()).select("text", "toxic").toPandas()
    is_bad = held["toxic"].to_numpy() == 1
    hit = toxicity._scores(pa.array(held["text"], pa.string()), toxicity.Matcher(model), model) >= 0.5
    assert hit[is_bad].mean() >= 0.6 and (~hit[~is_bad]).mean() >= 0.98
    none = model | {"words": {}, "stems": {}}
    assert not (toxicity._scores(pa.array(held["text"], pa.string()), toxicity.Matcher(none), none) >= 0.5).any()
