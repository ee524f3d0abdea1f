"""Brute force, round trips and odd inputs for the numbered operators."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark.llm import chat_format, context_mixing, embedding_dedup, language_id, ngram_jaccard, packing, sentencepiece_lattice, substring_dedup, topk, toxicity
from hazardspark.llm import common as c

DOCS = "doc_id long, text string, lang string, component string"


def texts(seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(60)]
    out = [None, "", " \n", "one", "One two three", "ONE two\tthree"]
    base = [rnd.choice(words) for _ in range(80)]
    for k in range(25):
        own = list(base)
        for _ in range(k // 2):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        out.append(" ".join(own))
    out += [" ".join(rnd.choice(words) for _ in range(40)) + "\n" + " ".join(base[5:30]) for _ in range(8)]
    return [*out, out[10], out[10], "long " * 3000 + "end"]


def docs(spark, seed=1):
    rows = [(i * 3, t, "en", "x") for i, t in enumerate(texts(seed))]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame([*rows, (None, "no id", None, None)], DOCS).repartition(3), {i: t for i, t, _, _ in rows}


def words(t):
    return (t or "").encode().split()


def sets(t, n):
    w = [x.lower() for x in words(t)]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("n,percent,tile", [(4, 85, 512), (5, 80, 3)])
def test_ngram_jaccard(spark, n, percent, tile, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "TILE", tile)
    df, by_id = docs(spark)
    s = {i: sets(t, n) for i, t in by_id.items()}
    parent = {i: i for i in s}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard(df, n, percent).collect()}
    assert got == {i: (len(s[i]), root(i)) for i in s}


def test_very_frequent_grams_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "HOT", 2)
    rnd = random.Random(5)
    pool, batches, alone = [f"p{i}" for i in range(60)], [], []
    for f in range(6):
        own = [f"f{f}{x}" for x in "abc"]
        short = own + rnd.sample(pool, 16)
        batches.append([own + rnd.sample(pool, 37) for _ in range(5)] + [[*short, f"u{f}"]])
        alone.append([*short, f"v{f}"])
    texts = [" ".join(x) for batch in [*batches, alone] for x in batch]
    df = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 7), "doc_id long, text string")
    s = [sets(t, 1) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(s)), 2) if 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    root = c.forest(len(s), np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert len(pairs) >= 6
    assert {r.doc_id: r.component_id for r in ngram_jaccard.ngram_jaccard(df, 1, 85).collect()} == dict(enumerate(root.tolist()))


def test_signatures_lose_no_link_and_part_unlike_sets():
    rnd = np.random.default_rng(6)
    core = rnd.integers(0, 1 << 63, 300).astype(np.uint64)
    near = [np.unique(np.concatenate([core[k:], rnd.integers(0, 1 << 63, 2 * k).astype(np.uint64)])) for k in range(40)]
    g = [*near, *(np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64)) for n in (250, 300, 330, 1, 64, 65))]
    size, signs = np.array(list(map(len, g))), ngram_jaccard.signatures(np.concatenate(g), np.cumsum([0, *map(len, g)]))
    assert [8 * len(x) for x in signs[-6:]] == [256, 512, 512, 64, 64, 128]
    g, size, signs = g[:-3], size[:-3], signs[:-3]
    everyone = np.arange(len(g))
    x, y = ngram_jaccard.alike(signs, size, 85, everyone, everyone)
    kept, linked = set(zip(x.tolist(), y.tolist(), strict=True)), 0
    for i, j in itertools.permutations(range(len(g)), 2):
        o = len(np.intersect1d(g[i], g[j]))
        if 100 * o >= 85 * (size[i] + size[j] - o):
            linked += 1
            assert (i, j) in kept
    assert linked > 100 and not any(max(p) >= 40 for p in kept)


def test_texts_of_unlike_candidates_are_not_copied(spark, monkeypatch):
    placed, blocks = [], c.row_blocks
    monkeypatch.setattr(c, "row_blocks", lambda rows, by, bin, id, *a, **k: placed.append((id, rows.count())) or blocks(rows, by, bin, id, *a, **k))
    rnd = random.Random(7)
    own = [[] for _ in range(60)]
    for k in range(2520):  # each word is in two texts, each two texts share one or two words
        for i in rnd.sample(range(60), 2):
            own[i].append(f"w{k}")
    texts = [" ".join(x) for x in own]
    texts += [texts[7] + " end", "alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.ngram_jaccard(df, 1, 85).collect()}
    assert got == {i: 7 if i == 60 else i for i in range(62)}
    assert dict(placed)["doc_id"] == 2


def test_heads_meet_where_ranges_may_link():
    rnd = np.random.default_rng(4)
    key, least = rnd.integers(0, 5, 40).astype(np.uint64), rnd.integers(1, 400, 40)
    most = least + rnd.integers(0, 30, 40)
    a, b = ngram_jaccard.head_pairs(key, np.arange(40), least.astype(np.uint32), most.astype(np.uint32), 85)
    root = c.forest(40, a, b)
    for x, y in itertools.combinations(range(40), 2):
        if key[x] == key[y] and 85 * least[x] <= 100 * most[y] and 85 * least[y] <= 100 * most[x]:
            assert root[x] == root[y]


def test_candidates_lose_no_link():
    rnd = np.random.default_rng(3)
    g = [np.unique(np.concatenate([np.arange(40), rnd.integers(0, 400, rnd.integers(0, 12))])).astype(np.uint64) for _ in range(30)]
    prefix, _ = ngram_jaccard.bounds(80)
    rows = [(k, i, len(x), p) for i, x in enumerate(g) for p, k in enumerate(c.mix(x.copy()).tolist())]
    order = [sorted((k, i, n) for k, i, n, _ in rows if i == j) for j in range(30)]
    flat = [(k, i, n, p) for own in order for p, (k, i, n) in enumerate(own[: prefix(own[0][2])])]
    a, b = ngram_jaccard.candidate_pairs(np.array([x[0] for x in flat], np.uint64), np.array([x[1] for x in flat]), np.array([x[2] for x in flat]), np.array([x[3] for x in flat]), 80)
    root = c.forest(30, a, b)
    for x, y in itertools.combinations(range(30), 2):
        o = len(np.intersect1d(g[x], g[y]))
        if 100 * o >= 80 * (len(g[x]) + len(g[y]) - o):
            assert root[x] == root[y]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 4), (20, 20)]
    got = dict(c.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}


def test_substring_dedup(spark):
    df, by_id = docs(spark)
    first = {}
    for i in sorted(by_id):
        w = words(by_id[i])
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = {r.doc_id: r for r in substring_dedup.digest(substring_dedup.substring_dedup(df)).collect()}
    assert got[None].n_removed == 0
    for i, t in by_id.items():
        w = words(t)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


def test_top_k_and_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 7)
    rnd = np.random.default_rng(0)
    v = rnd.normal(size=(120, 12))
    v[60:90] = v[0] + rnd.normal(size=(30, 12)) * 0.06
    v[90:95] = v[1]
    rows = [(i, [float(x) for x in r], int(i % 2 if i < 60 else 0)) for i, r in enumerate(v)]
    odd = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 12, 0), (1003, [float("nan")] * 12, 0), (1004, [None] * 12, 1), (1005, rows[0][1], None), (1006, [1.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    whole = np.floor(64 * v).astype(int)
    ids = [*range(120), 1002, 1005]
    whole = np.vstack([whole, np.zeros((1, 12), int), whole[0]])
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect()
    for q in range(0, 120, 20):
        s = sorted((-(whole[q] @ x), i) for x, i in zip(whole, ids, strict=True) if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(i, -x) for x, i in s]
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    u, label = v / np.linalg.norm(v, axis=1)[:, None], np.array([r[2] for r in rows])
    near = ((u @ u.T) >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(120, dtype=bool)
    root = c.forest(120, *np.nonzero(near))
    assert [found[i].n_links for i in range(120)] == near.sum(1).tolist()
    assert [found[i].component_id for i in range(120)] == root.tolist()
    assert all(found[i].n_links == 0 and found[i].kept for i in range(1000, 1007))


def test_language(spark):
    rows = [(i, ("the cat sat on the mat and " if i % 2 else "der hund lief durch den wald und ") * 5, "en" if i % 2 else "de") for i in range(40)]
    df = spark.createDataFrame([*rows, (100, None, "en"), (101, "123 !", None), (102, "", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df, language_id.fit(df)).collect()}
    assert all(got[i].lang_pred == g and got[i].score > 0.5 for i, _, g in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102))


def test_toxicity(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join([rnd.choice("abcdefgh") * 3 for _ in range(20)] + ["vile"] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(240)]
    df = spark.createDataFrame([*rows, (999, None, 0), (1000, "", None)], "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df, language_id.fit(df.withColumn("lang", F.lit("en"))))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows]) > 0.97
    assert 0 <= got[999].score <= 1 and len(got) == 242


def test_toxicity_learns_from_all_labels(spark):
    """Each of 1200 telling words is in ten texts, so a sample of a few thousand labels knows few of them; odds alone, no epoch."""
    rnd = random.Random(5)
    rows = [(i, " ".join([rnd.choice("abcdefgh") * 3 for _ in range(6)] + [f"m{i % 1200}" if i % 2 else f"n{i % 1200}"]), i % 2) for i in range(12000)]
    df = spark.createDataFrame([*rows, (None, "m1 m3", 0)], "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.fit(df, df.union(df.where("doc_id = 7")), language_id.fit(df.withColumn("lang", F.lit("en"))), epochs=0)
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert np.mean([got[i] == y for i, _, y in rows]) > 0.95


def test_context_mixing(spark):
    df, by_id = docs(spark)
    got = {r.doc_id: r for r in context_mixing.score(df, F.col("doc_id") % 2 == 0).collect()}
    tokens = {i: [x.lower() for x in words(t)] + [None] for i, t in by_id.items()}
    count = Counter(x for i, w in tokens.items() if i % 2 == 0 for x in w)
    n, v = sum(count.values()), len(count)
    for i, w in tokens.items():
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and got[i].score < 0


def segments(t):
    """(bytes, kind) of a text's segments, by a plain loop."""
    parts, at = [], 0
    for m in re.finditer(rb"[^\x20\x09-\x0d]+", t):
        if m.start() == 0 or at:
            pass
        else:
            parts += [b"", t[: m.start()]]
        if at:
            parts.append(t[at : m.start()])
        parts.append(m.group())
        at = m.end()
    if not parts:
        parts = [b""]
        at = 0
    if t[at:]:
        parts += [t[at:], b""]
    parts.append(b"")
    out, opens = [], True
    for k, x in enumerate(parts):
        if k % 2 == 0:
            ended = x[-1:] in (b".", b"!", b"?") and x != b""
            capital = x[:1].isupper() and not x[1:2].isupper() and x[:1].isascii()
            first = (x[:1].lower() + x[1:] if capital else x, 4 * opens + 8 * capital)
        else:
            first, opens = (x, 1 + 4 * ended), ended
        x, kind = first
        cut = [x[a : a + 32] for a in range(0, len(x) + 1, 32)]
        out += [(cut[0], kind)] + [(y, 2 + (kind & 1)) for y in cut[1:]]
    return out


def symbols(x, kind):
    """(symbol, three before, depth, prefix) of a segment."""
    out = [(257, [258 + (kind & 7), 266, 266], -1, b"")] if kind & 8 else []
    for d in range(len(x) + (len(x) < 32)):
        start = 258 + (kind & 3 if kind & 8 or d and not kind & 1 else kind & 7)
        before = [*x[max(0, d - 3) : d]][::-1] + [start] * (d < 3) + [266] * 3
        out.append((x[d] if d < len(x) else 256, before[:3], d, x[:d]))
    return out


def test_context_mixing_equals_a_slow_loop(spark):
    m = context_mixing
    df, by_id = docs(spark)
    df = spark.createDataFrame([*[(r.doc_id, r.text) for r in df.collect()], (1001, "A.B c! Dé  ?\nXY Zz. " + "q" * 70 + " " * 40 + "R"), (1000, "Dé dé\t" + "Q" * 32 + ". W")], "doc_id long, text string").repartition(3)
    by_id |= {r.doc_id: r.text for r in df.where("doc_id >= 1000").collect()}
    docs_ = df.withColumn("train", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)))
    fitted = m.fit(docs_, m.in_pieces(docs_))
    t, weights = fitted.held.value.trees, fitted.weights
    n = {k: Counter() for k in (1, 2, 3, "deep")}
    cuts = {i: [(x, *y, z) for x, z in segments((v or "").encode()) for y in symbols(x, z)] for i, v in by_id.items()}
    slot = lambda k, before, node: int(m.slots(np.array([before[0] if k == 1 else before[0] * 267 + before[1] if k == 2 else (before[0] * 267 + before[1]) * 267 + before[2]]), np.array([node]))[0])
    way = lambda before, s: zip(t.node[t.first[before * 258 + s] : t.first[before * 258 + s + 1]].tolist(), t.bit[t.first[before * 258 + s] : t.first[before * 258 + s + 1]].tolist(), strict=True)
    follow = {}
    for i, own in cuts.items():
        if i % 2 == 0:
            for x, s, before, d, prefix, kind in own:
                follow.setdefault((prefix, kind & 3), Counter())[s] += d >= 3
                for node, bit in way(before[0], s):
                    n[1][before[0], node, bit] += 1
                    n[2][slot(2, before, node), bit] += 1
                    n[3][slot(3, before, node), bit] += 1
                    n["deep"][prefix, kind & 3, node, bit] += d >= 3
    odds = lambda c, *k: float(np.clip(round(math.log((c[*k, 1] + 0.4) / (c[*k, 0] + 0.4)) * 16), -127, 127)) / 16
    got = {r.doc_id: r.score for r in m.score(df, F.col("doc_id") % 2 == 0).collect()}
    for i, own in cuts.items():
        cost, k, w = 0.0, 0, weights.astype(float).copy()
        for x, s, before, d, prefix, kind in own:
            seen = follow.get((prefix, kind & 3), Counter()) if d >= 3 else Counter()
            many = sum(seen.values())
            level = next(g for g, most in enumerate((1, 2, 4, 16, 1e9)) if many < most) + 4 * (many > 0 and len(seen) == 1)
            gate = (13 if d >= 3 else 12 + min(d, 1)) if kind & 1 else level if d >= 3 else 9 + max(d, 0)
            for node, bit in way(before[0], s):
                if k % m.STRETCH == 0:
                    w = weights.astype(float).copy()
                v = np.array([odds(n[1], before[0], node), odds(n[2], slot(2, before, node)), odds(n[3], slot(3, before, node)), odds(n["deep"], prefix, kind & 3, node) if many else 0.0])
                p = 1 / (1 + math.exp(-np.clip(v @ w[gate], -m.LIMIT, m.LIMIT)))
                cost += math.log10(p if bit else 1 - p)
                w[gate] += m.RATE * (bit - p) * v
                k += 1
        assert got[i] == pytest.approx(cost, rel=2e-3), i
    assert m.share(100) == 1 and m.share(10**9) * 10**9 > 10**7


def test_first_weights_cost_least_over_all_training_texts(spark):
    m = context_mixing
    df, _ = docs(spark)
    df = df.union(spark.range(1000, 3600).selectExpr("id", "concat('Text w', id % 50, ' of W', id % 7, '. Number ', id)", "'en'", "'x'"))
    docs_ = df.select("doc_id", "text", F.lit(True).alias("train"))
    pieces = m.in_pieces(docs_)
    fitted = m.fit(docs_, pieces)
    model = fitted.held.value
    known = m.Answers(*m.added([m.counts_read(r.data) for r in fitted.counts.where("word = 0").collect()]), model.trees)
    bits = []
    for r in m.type_counts(pieces, fitted.shards).where("word = 0").collect():
        n, t = m.types_read(r.data)
        key = np.unique(t.keys(t.symbols())[0])
        odds, gate, many = model.features(t, m.Deep(key, *known.of(key, 1), model.trees))
        bits.append((odds / m.UNIT, gate, np.repeat(n, many)))
    x, gate, n = (np.concatenate(y) for y in zip(*bits, strict=True))

    def cost(w):
        z = np.clip((x * w[gate >> 1]).sum(axis=1), -m.LIMIT, m.LIMIT)
        return (n * np.log1p(np.exp(np.where(gate & 1, -z, z)))).sum()

    least = cost(fitted.weights)
    for g, k, step in itertools.product(range(m.GATES), range(4), (-0.1, 0.1)):
        w = fitted.weights.copy()
        w[g, k] += step
        assert cost(w) > least * (1 - 1e-4), (g, k, step)


def test_segments_of_one_scan_task_are_folded_once():
    """16 MB of a compressed file hold some 27 MB of text: one chunk, whose equal segments share their fold."""
    assert len(list(c.pieces(["x" * (1 << 20)] * 27, sentencepiece_lattice.CHUNK))) == 1


def test_sums_by_key_are_exact():
    r = random.Random(3)
    for top in (1, 2**23, 2**52, 2**64):
        for most in (1, 5000, 2**45):
            rows = [(r.choice([0, top - 1, r.randrange(top)]), r.choice([0, 1, r.randrange(most)])) for _ in range(500)]
            want = Counter()
            for k, n in rows:
                want[k] += n
            key, n = context_mixing.summed(np.array([k for k, _ in rows], np.uint64), np.array([n for _, n in rows]))
            assert list(zip(key.tolist(), n.tolist(), strict=True)) == sorted(want.items())
            assert context_mixing.distinct(np.array([k for k, _ in rows], np.uint64)).tolist() == sorted(want)
    assert [len(x) for x in context_mixing.added([])] == [0, 0]


def test_places_of_bits_are_not_held_for_a_whole_chunk():
    """Some documents at a time are laid out for mixing in few bytes a bit."""
    m = context_mixing
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["of", "the", "a", "Fire", "flooded", "w%d" % rnd.randrange(99)]) for _ in range(500)).encode() for _ in range(250)]
    none = np.zeros(len(texts), bool)
    piece = m.Piece.of(texts, np.arange(len(texts)), none, ~none)
    t = m.trees(np.zeros((m.BEFORE, m.SYMBOLS), np.int64))
    model = m.Model(t, np.zeros(m.BEFORE * 512, np.int8), *(np.zeros(1 << m.SLOTS, np.int8) for _ in range(2)))
    deep = m.Deep(piece.keys()[0], np.zeros(len(piece.keys()[0]), np.uint8), np.empty(0, np.int8), t)
    tracemalloc.start()
    try:
        bits = [len(gate) for (odds, gate, at), text in model.lanes(piece, deep, np.arange(len(texts)))]
        assert tracemalloc.get_traced_memory()[1] < 10 * sum(bits)
    finally:
        tracemalloc.stop()


def test_segments_are_those_of_a_plain_loop():
    texts = [b"", b" ", b"a", b" a", b"a ", b"  Ab. C\n", "É Xy!".encode(), b"x" * 32, b"y" * 65 + b" " * 33, b"A" * 32 + b"?"]
    got = context_mixing.Segments(texts)
    types = [(bytes(got.buf[b : b + n]), int(k)) for b, n, k in zip(got.begin, got.size, got.kind, strict=True)]
    assert types == [x for t in texts for x in segments(t)]
    assert np.bincount(got.doc, minlength=len(texts)).tolist() == [len(segments(t)) for t in texts]


def test_very_large_components(spark):
    rows = [(0, [1.0, 2.0]), (20, [3.0, -1.0]), (3, [1e15, 1.0]), (4, [-1e300, 1e-300]), (40, [1e200, 0.0]), (40, [0.0, 5.0]), (7, [1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(Fraction(x) * 64) for x in v]) for i, v in rows]
    clamp = lambda s: max(min(s, 2**63 - 1), -(2**63))
    asked = {0: whole[0][1], 20: whole[1][1], 40: whole[5][1]}
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=20).collect()
    for q, v in asked.items():
        want = sorted((-clamp(sum(a * b for a, b in zip(v, x, strict=True))), i) for i, x in whole if i != q)
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    near = spark.createDataFrame([(1, [1e200, 1e199], 0), (2, [1e-200, 1e-201], 0), (3, [-1e200, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(near).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_planted_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 50)
    rnd = np.random.default_rng(8)
    v = rnd.normal(size=(300, 24))
    v[150:] = v[:150] + rnd.normal(size=(150, 24)) * rnd.uniform(0.02, 0.3, size=(150, 1))
    label = rnd.integers(0, 2, 300)
    label[150:] = label[:150]
    df = spark.createDataFrame([(i, v[i].tolist(), int(label[i]), 1, 2) for i in range(300)], "vec_id long, embedding array<double>, label int, block int, rep int")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = ((u @ u.T) >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(300, dtype=bool)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert near.sum() > 100 and [got[i] for i in range(300)] == near.sum(1).tolist()


def test_a_full_sketch_loses_no_link_and_adds_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "MOST_BITS", 6)
    monkeypatch.setattr(ngram_jaccard, "HOT", 20)
    df, by_id = docs(spark)
    want = {r.doc_id: r.component_id for r in ngram_jaccard.ngram_jaccard(df, 4, 85).collect()}
    monkeypatch.undo()
    assert want == {r.doc_id: r.component_id for r in ngram_jaccard.ngram_jaccard(df, 4, 85).collect()}


def test_columns_of_any_name(spark):
    names = ["node", "block", "salt", "rep", "n", "h", "comp", "bin", "x", "y", "starts", "__id", "__starts", "rank", "piece", "words"]
    df, by_id = docs(spark)
    wide = df.select("doc_id", "text", "lang", *(F.lit(k).alias(k) for k in names))
    same = lambda f: sorted(map(str, f(df).collect())) == sorted(map(str, f(wide).collect()))
    assert same(ngram_jaccard.ngram_jaccard) and same(substring_dedup.substring_dedup) and same(lambda d: packing.pack_documents(d).groupBy("doc_id").agg(F.sum("length")))
    assert same(lambda d: context_mixing.score(d, F.col("doc_id") % 2 == 0).select("doc_id", "n_tokens", F.round("base_score", 6)))
    left = substring_dedup.without_repeats(wide)
    assert left.columns == wide.columns and left.count() == substring_dedup.without_repeats(df).count()


def test_packing(spark):
    df, by_id = docs(spark)
    got = packing.pack_documents(df, size=64).collect()
    ids = {i: [*packing.encoder(packing.default_tokenizer())(t or ""), 0] for i, t in by_id.items()}
    for i, own in ids.items():
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in mine] == list(itertools.accumulate([0, *(r.length for r in mine[:-1])])) and sum(r.length for r in mine) == len(own)
    for _, rows in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        rows = list(rows)
        assert [r.offset for r in rows] == list(itertools.accumulate([0, *(r.length for r in rows[:-1])])) and sum(r.length for r in rows) <= 64


def test_tokenizer_is_the_librarys():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(packing.default_tokenizer()), packing.encoder(packing.default_tokenizer())
    for t in ["", " a  b\n", "don't <|endoftext|> stop", "日本 é😀", "x" * 500]:
        assert slow.encode(t, add_special_tokens=False).ids == fast(t).tolist()


def test_chat(spark):
    rows = [(1, 0, "user", "a\\b<s>\\\\</s>[INST][/INST]<\\s>\n\\"), (1, 1, None, ""), (1, 2, "assistant", None), (1, 3, "assistant", "x\\"), (1, 4, "[/INST]", "z$1"), (2, 0, "user", None)]
    found = chat_format.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat_format.read_back(found).collect()}
    for k in (1, 2):
        own = [r for r in rows if r[0] == k]
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256("".join(r[3] or "" for r in own if r[2] == "assistant").encode()).hexdigest()


def test_sentencepiece_round_trip(spark):
    odd = [None, "", " ", "a  b ", "\n\tx▁y ▁", "日本語 😀é", "x" * 700, " " * 40]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert [r.text for r in sentencepiece_lattice.decode(sentencepiece_lattice.encode(df)).orderBy("doc_id").collect()] == [t or "" for t in odd]


def test_sentencepiece_best_path(spark):
    table = sentencepiece_lattice.pieces(sentencepiece_lattice.default_model())
    plain = {table.text[i].replace("▁", " "): (i, w) for i, w in table.score.items()}
    texts = ["The cat, (sat) on 1234 mats...", "a\u2581b  c\nNew!?", "x" * 300 + "queairetretion" * 40, "été 😀 日本", "."]

    def best(t):
        t = " " + t
        at = [(0.0, 0, 0, [])]
        for e in range(1, len(t) + 1):
            found = []
            for n in range(1, min(e, table.longest) + 1):
                if t[e - n : e] in plain:
                    i, w = plain[t[e - n : e]]
                    found.append((at[e - n][0] + w, n, i, at[e - n][3] + [i]))
            if not any(x[1] == 1 for x in found):
                own = [int(table.byte[b]) for b in t[e - 1].encode()]
                found.append((at[e - 1][0] + table.missing, 1, -1, at[e - 1][3] + own))
            at.append(max(found, key=lambda x: x[:2]))
        return at[-1][3]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in sentencepiece_lattice.encode(df).collect()}
    assert got == {k: best(t) for k, t in enumerate(texts)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert ngram_jaccard.ngram_jaccard(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert context_mixing.score(none, F.lit(True)).count() == 0
    assert language_id.identify(none, language_id.fit(none)).count() == 0
    assert sentencepiece_lattice.encode(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert topk.top_k(vectors, F.lit(True)).count() == 0 and embedding_dedup.near_duplicates(vectors).count() == 0


def test_newtons_sums_are_those_of_a_plain_loop():
    m = context_mixing
    rnd = np.random.default_rng(5)
    x, gate, times = rnd.integers(-127, 128, (300, 4)).astype(np.int8), np.sort(rnd.integers(0, 2 * m.GATES, 300)).astype(np.uint8), rnd.integers(1, 10**6, 300)
    weights = rnd.normal(0, 1, (m.GATES, 4))
    got = m.slopes(x.view(np.uint32).ravel(), gate, times, weights)
    for i in range(300):
        y, bit = x[i] / m.UNIT, int(gate[i]) & 1
        p = 1 / (1 + math.exp(-np.clip(y @ weights[gate[i] >> 1], -m.LIMIT, m.LIMIT)))
        want = [-math.log(p if bit else 1 - p), *((bit - p) * y), *(p * (1 - p) * y[j] * y[k] for j in range(4) for k in range(j, 4))]
        assert np.allclose(got[:, i], times[i] * np.array(want), rtol=1e-9, atol=1e-9)


def test_bits_mixed_side_by_side_cost_what_they_cost_one_by_one():
    m = context_mixing
    rnd = np.random.default_rng(6)
    size = np.array([1, 700, 64, 3, 65, 200])
    at = np.append(0, np.cumsum(size))
    x, gate = rnd.integers(-127, 128, (at[-1] + m._STEPS, 4)).astype(np.int8), rnd.integers(0, m.GATES, at[-1] + m._STEPS).astype(np.uint8)
    weights = rnd.normal(0, 0.3, (m.GATES, 4))
    got = m.mixed(x.view(np.int32).ravel(), gate, at, weights)
    for lane, (lo, hi) in enumerate(itertools.pairwise(at)):
        cost, w = 0.0, weights.copy()
        for y, g in zip(x[lo:hi] / m.UNIT, gate[lo:hi], strict=True):
            p = 1 / (1 + math.exp(-np.clip(y @ w[g], -m.LIMIT, m.LIMIT)))
            cost -= math.log(p)
            w[g] += m.RATE * (1 - p) * y
        assert got[lane] == pytest.approx(cost, rel=1e-4)


def test_hashes_are_numbered_though_their_first_bits_agree():
    """Hashes are sorted with their places as last bits: where only the last bits differ, too."""
    m = context_mixing
    r = random.Random(7)
    for h in ([], [9], [3, 1, 3, 2, 1], [r.randrange(40) for _ in range(999)], [r.randrange(9) << 60 | r.randrange(9) for _ in range(999)], [r.randrange(2**64) for _ in range(999)] * 2):
        own, first, back = m.numbered(np.array(h, np.uint64))
        assert own.tolist() == sorted(set(h)) and [h[i] for i in first] == own.tolist() and own[back].tolist() == h
        order = m.places(np.array(h, np.uint64))
        assert sorted(order.tolist()) == list(range(len(h))) and [h[i] for i in order] == sorted(h)


def test_keys_are_found_among_many_of_one_context():
    m = context_mixing
    r = random.Random(8)
    t = m.trees(np.zeros((m.BEFORE, m.SYMBOLS), np.int64))
    for contexts, symbols in ((0, 1), (1, 1), (1, 258), (3000, 3), (50, 200)):
        key = sorted({r.randrange(2**34) << 18 | r.randrange(m.BEFORE) << 9 | s for _ in range(contexts) for s in r.sample(range(258), symbols)} | {c_ << 18 | s for c_ in range(min(contexts, 1)) for s in range(symbols)})
        level = np.array([r.randrange(9) for _ in key], np.uint8)
        deep = m.Deep(np.array(key, np.uint64), level, np.empty(0, np.int8), t)
        asked = np.array([r.randrange(len(key)) for _ in range(500 * bool(key))], np.int64)
        got, _, begin = deep.of(np.array(key, np.uint64)[asked])
        assert got.tolist() == level[asked].tolist() and begin.tolist() == deep.begin[asked].tolist()


def test_laying_out_bits_holds_no_place_of_each():
    """Whole segments are copied: while a chunk is laid out, no number of eight bytes is there for each of its bits, nor for those of a part."""
    m = context_mixing
    bits = np.arange(1 << 20, dtype=np.int32)
    at = np.arange(0, len(bits) + 1, 64)
    of, which = m.strings(bits, at), np.random.default_rng(9).integers(0, len(at) - 1, 20000)
    tracemalloc.start()
    try:
        got = m.taken(of, which, np.int32)
        assert tracemalloc.get_traced_memory()[1] < got.nbytes / 2
    finally:
        tracemalloc.stop()
    assert np.array_equal(got.reshape(-1, 64), bits.reshape(-1, 64)[which])
    assert len(m.taken(of, which[:0], np.int32)) == 0
