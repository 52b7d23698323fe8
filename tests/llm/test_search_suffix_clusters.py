"""Lexical search, suffix dedup and centroid clustering against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import centroids, lexical, suffixdedup

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, score string, query string, first int"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOC).repartition(parts)


# ---- lexical search


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def ranked(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    filled = [b for _, b in bags if b]
    n, total = len(filled), sum(sum(b.values()) for b in filled)
    df = Counter(t for b in filled for t in b)
    out = []
    for item, text in items:
        scores = []
        for doc, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n // max(1, total)
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in terms(text)
                if t in bag
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if missing else doc, -s) for rank, (s, missing, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["Émile", "naïve", "İx", "a_b", "x.y"]
    odds = 1 / np.arange(1, len(words) + 1)
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 40), p=odds / odds.sum()))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "?!"), (None, rows[0][1]), (0, rows[0][1]), (5, "w1 w59 w58"), (n + 3, "w3 " * 30_000)]
    return rows + [(1000 + i, rows[7][1]) for i in range(30)]  # ties


ITEMS = [(1, "w1 w59 W59 émile Émile"), (1, "w0 w0 w7"), (2, None), (3, ""), (4, "nowhere"), (None, "w58 naïve İx b"), (6, "w3 " * 500), (7, "x y a")]


@pytest.mark.parametrize("k", [1, 10])
def test_search(spark, monkeypatch, k):
    rows = corpus(np.random.default_rng(3), 300)
    items = spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id long, text string, rank int")
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 6)  # several blocks of items
    got = lexical.rank_documents(frame(spark, rows), items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(rows, ITEMS, k)


def test_buckets_are_pruned_without_loss(spark):
    """Small buckets: the bounds must pass over most of them and lose nothing."""
    rng = np.random.default_rng(8)
    rows = corpus(rng, 400)
    bags = [Counter(terms(t)) for _, t in rows]
    vocabulary = sorted({t for b in bags for t in b})
    number = {t: i for i, t in enumerate(vocabulary)}
    impact = [{number[t]: 1000 * c // (1 + c) for t, c in b.items()} for b in bags]
    order = sorted((i for i, b in enumerate(bags) if b), key=lambda i: -math.sqrt(sum(v * v for v in impact[i].values())))
    weights = [np.sort(rng.integers(1, 9000, 3))[::-1] for _ in range(20)]
    own = [rng.choice(len(vocabulary), 3, replace=False) for _ in range(20)]
    rest = [np.sqrt(np.append(np.cumsum((w.astype(float) ** 2)[::-1])[::-1], 0)) for w in weights]
    items = lexical._Weighted(np.arange(20), own, weights, rest, len(vocabulary))
    best, dense, passed = lexical._Best(np.zeros(20, np.int64), 5), np.zeros(len(vocabulary), np.int64), []
    add = best.add
    best.add = lambda item, ids, scores: (passed.append(len(ids)), add(item, ids, scores))
    for start in range(0, len(order), 16):
        part = order[start : start + 16]
        flat = [(t, v) for i in part for t, v in sorted(impact[i].items())]
        lexical._search_bucket(
            items, best, dense,
            np.array([math.sqrt(sum(v * v for v in impact[i].values())) for i in part]),
            np.array(part), np.array([len(impact[i]) for i in part]),
            np.array([t for t, _ in flat], np.uint32), np.array([v for _, v in flat], np.uint32),
        )
    for item in range(20):
        want = sorted((-sum(int(w) * impact[i].get(int(t), 0) for t, w in zip(own[item], weights[item])), i) for i in order)
        want = [(i, -s) for s, i in want[:5] if s < 0]
        assert list(zip(*(x.tolist() for x in best.found[item]))) == want
    assert sum(passed) < 0.5 * 20 * len(order)


def test_search_empty(spark):
    docs, items = frame(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank_documents(docs.limit(0), items).isEmpty()
    assert lexical.rank_documents(docs, items.limit(0)).isEmpty()
    assert lexical.rank_documents(frame(spark, [(1, None), (2, "..")]), items).isEmpty()


# ---- suffix dedup


def removed(rows, length):
    """By id and text hash as the operator orders them; ``rows`` has no two texts under one id."""
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        body = (text or "").encode()
        gone = np.zeros(len(body), bool)
        for at in range(len(body) - length + 1):
            piece = body[at : at + length]
            if piece in seen:
                gone[at : at + length] = True
            seen.add(piece)
        spans = "".join("x" if g else " " for g in gone).split()
        out[doc] = (doc, len(body), int(gone.sum()), len(spans), bytes(b for b, g in zip(body, gone) if not g))
    return sorted((out[doc] for doc, _ in rows), key=str)


def passages(rng):
    letters = "abcdéfgh ij\nkl"
    text = lambda n: "".join(rng.choice(list(letters), n))
    shared = [text(n) for n in (20, 29, 30, 31, 45, 90, 400)]
    rows = [(i, "".join(x for p in rng.permutation(7)[:4] for x in (text(rng.integers(0, 50)), shared[p]))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 29), (103, "a" * 200), (104, "a" * 31), (105, "ab" * 90), (106, "abc" * 50 + "é" * 40)]
    rows += [(110 + i, rows[3][1]) for i in range(20)] + [rows[5], rows[5]] + [(None, rows[6][1] + "tail")]
    long = text(3000)
    return [*rows, (200, long), (150, text(40) + long[500:2500] + text(40)), (201, long[:1000] + long[:1000])]


@pytest.mark.parametrize(("gram", "chunk"), [(12, 1 << 18), (30, 1 << 18), (7, 256)])
def test_suffixes(spark, gram, chunk):
    rows = passages(np.random.default_rng(gram))
    got = suffixdedup.remove_repeats(frame(spark, rows), length=30, gram=gram, chunk=chunk)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes"]
    found = sorted(((*r[:4], bytes(r.kept_bytes)) for r in got.collect()), key=str)
    assert found == removed(rows, 30)


def test_one_passage_in_every_document(spark):
    """A bucket of all documents runs through many ranges and is settled nonetheless."""
    passage = "this very passage of more than sixty bytes is part of every document of this table. "
    rows = [(i, hashlib.md5(b"%d" % i).hexdigest() + passage + hashlib.md5(b"x%d" % i).hexdigest()) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = suffixdedup.remove_repeats(frame(spark, rows, 8), length=60, gram=24).groupBy("n_removed", "n_spans").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = Counter((r[2], r[3]) for r in removed(rows, 60))
    assert {(r.n_removed, r.n_spans): r["count"] for r in got} == want


def test_suffixes_of_texts_that_share_an_id(spark):
    """They follow each other; an exact repeat of a row gets the same result."""
    a, b = "x1y2z3uvwabc" * 2 + "first text of an id", "x1y2z3uvwabc" * 2 + "other text of an id"
    got = suffixdedup.remove_repeats(frame(spark, [(1, a), (1, b), (1, b)]), length=20, gram=8).collect()
    kept = Counter(bytes(r.kept_bytes) for r in got)
    assert sorted(kept.values()) in ([1, 2], [3]) and len(got) == 3
    assert sum(r.n_removed for r in got if r.n_spans) > 0


def test_suffixes_empty(spark):
    assert suffixdedup.remove_repeats(frame(spark, [(1, "a")]).limit(0)).isEmpty()
    with pytest.raises(ValueError):
        suffixdedup.remove_repeats(frame(spark, [(1, "a")]), length=10, gram=11)


# ---- centroid clustering


def clustered(rows, k, rounds, width):
    kept = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]
    mark = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    centers = [list(v) for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min((apart(v, c), n) for n, c in enumerate(centers)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for n in range(len(centers)):
            own = [v for (_, v), (_, at) in zip(kept, found) if at == n]
            if own:
                centers[n] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    inertia = Counter()
    for d, n in found:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for (i, _), (d, n) in zip(kept, found)), key=str)


@pytest.mark.parametrize(("k", "width"), [(40, 8), (7, 3), (1, 2)])
def test_clusters(spark, k, width):
    rng = np.random.default_rng(k)
    rows = [(i, [float(x) for x in rng.normal(size=width).round(2)]) for i in range(250)]
    rows += [(300 + i, [0.0] * width) for i in range(60)]  # many ties
    rows += [rows[3], rows[3], (None, [0.25] * width), (5, [1.0] * width), (500, None), (501, [0.5] * (width + 1))]
    rows += [(502, [float("nan")] * width), (503, [float("inf")] * width), (504, [None] * width), (505, [1e5] * width)]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(5)
    got = centroids.cluster(vectors, k=k, rounds=3, width=width)
    assert sorted(map(tuple, got.collect()), key=str) == clustered(rows, k, 3, width)


def test_equally_near_centroids_go_by_number(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [int(x) / 256 for x in rng.integers(0, 4, 3)]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = centroids.cluster(vectors, k=40, rounds=2, width=3)
    assert sorted(map(tuple, got.collect()), key=str) == clustered(rows, 40, 2, 3)


def test_components_beyond_32_bits(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1e7 + float(x) for x in rng.normal(size=2).round(2)]) for i in range(40)]
    rows += [(100 + i, [-4e6, float(i)]) for i in range(5)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = centroids.cluster(vectors, k=20, rounds=1, width=2)
    assert sorted(map(tuple, got.collect()), key=str) == clustered(rows, 20, 1, 2)


def test_fewer_vectors_than_centroids_and_none(spark):
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<double>")
    got = centroids.cluster(vectors, k=9, width=2).collect()
    assert len(got) == 3 and {r.inertia for r in got} == {0}
    assert centroids.cluster(vectors.limit(0), width=2).isEmpty()
    with pytest.raises(ValueError):
        centroids.cluster(vectors, k=10**9)


def test_tree_finds_the_nearest_and_visits_few(spark):
    rng = np.random.default_rng(1)
    middle = rng.integers(-5000, 5000, (20, 6))
    centers = np.concatenate([middle + rng.integers(-40, 40, (20, 6)) for _ in range(30)])
    centers[100] = centers[20]  # a tie
    vectors = np.concatenate([centers[:300] + rng.integers(-2, 3, (300, 6)), centers[20:21]])
    tree = centroids.build_tree(centers)
    number, apart = centroids.nearest(tree, vectors)
    every = ((vectors[:, None] - centers[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (apart == every.min(1)).all() and number[-1] == 20
    compared, plain = [], centroids.squared
    centroids.squared = lambda v, c: (compared.append(len(v) * len(c)), plain(v, c))[1]
    try:
        centroids.nearest(tree, vectors)
    finally:
        centroids.squared = plain
    assert sum(compared) < 0.4 * len(vectors) * len(centers)


def test_distances_beyond_double(spark):
    far = np.array([[1 << 27, -(1 << 27)], [3, 5]])
    assert centroids.squared(far, far).tolist() == [[0, ((1 << 27) - 3) ** 2 + ((1 << 27) + 5) ** 2]] * 1 + [
        [((1 << 27) - 3) ** 2 + ((1 << 27) + 5) ** 2, 0]
    ]
    with pytest.raises(OverflowError):
        centroids.squared(np.array([[1 << 31, 1 << 31]]), far)
