"""Each operator against brute force on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from tidemill.llm import exactdedup, kneserney, langid, linededup, mixing, neardup, packing, quality, queries, topk, urlfilter
from tidemill.llm.graph import components
from tidemill.session import shared_root

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        *(T.StructField(c, T.StringType()) for c in ("kept", "key", "size", "row", "class", "part", "label", "version")),
    ]
)
LONG = " ".join(f"Word{i % 977} longer{i}" for i in range(9000))
BASE = " ".join(f"token{i}" for i in range(120))


def rows_of(texts):
    return [
        (i, t, ["en", "de", None][i % 3], ["a", "b", None, "Z"][i % 4], None if i % 5 == 0 else 1, *["x"] * 8)
        for i, t in enumerate(texts)
    ]


TEXTS = [
    None,
    "",
    "   \n\t ",
    "The quick brown fox jumps over the lazy dog",
    "the QUICK brown fox jumps over the lazy dog",
    "The quick brown fox jumps over the lazy dog",
    "short",
    "two words",
    "Two Words",
    LONG,
    LONG + " end",
    BASE,
    BASE + " and one more",
    BASE.replace("token60", "other"),
    "A shared line of text\nunique line number one\nA shared line of text",
    "  a SHARED line of text\t\nunique line number two",
    "123 456 !!! ???",
    "Übergrößenträger straße schön äöü",
    "line\x0bwith\x0cseparators and\rreturns",
    "\ud7ff 日本語 テキスト",
    "don't  stop   believing ",
]


@pytest.fixture(scope="module")
def rows():
    found = rows_of(TEXTS)
    found.append(found[3])  # a repeated row
    found.append((None, "only a null id", "en", "a", 3, *["x"] * 8))
    found.append((3, "another text under the same id", "en", "a", 3, *["x"] * 8))
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


# ---- exact dedup


def test_exact_duplicates(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(
        ((r[0], top[r[1] or ""], len(groups[r[1] or ""]), r[0] == top[r[1] or ""]) for r in rows), key=str
    )
    found = exactdedup.exact_duplicates(docs, capacity=2)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect()), key=str)
    assert got == want


def test_exact_empty(none):
    assert exactdedup.exact_duplicates(none).isEmpty()


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("text %d", F.col("id")).alias("text"))
    entries = exactdedup.entries_of(many.union(many.limit(1).crossJoin(spark.range(500)).select("doc_id", "text")))
    directory, depth = exactdedup.directory_of(entries, 100)
    held = (
        entries.select("key").distinct().withColumn("slot", exactdedup._prefix(F.col("key"), depth))
        .join(directory, "slot").groupBy("bucket").count()
    )
    assert held.agg(F.max("count")).first()[0] <= 100
    assert held.agg(F.sum("count")).first()[0] == 3000
    assert directory.filter(f"local_depth < {depth}").count() > 0


def test_equal_keys_are_told_apart_by_bytes(spark, monkeypatch):
    """With one key and digest for all, only the comparison of bytes is left."""
    monkeypatch.setattr(exactdedup.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    monkeypatch.setattr(exactdedup.F, "sha2", lambda *c: F.lit("ab"))
    few = spark.createDataFrame([(1, "aaa"), (2, "bbb"), (3, "aaa"), (4, "ccc"), (5, "bbb")], "doc_id long, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in exactdedup.exact_duplicates(few).collect())
    assert got == [(1, 3, 2), (2, 5, 2), (3, 3, 2), (4, 4, 1), (5, 5, 2)]


# ---- mixing


def filled(sizes, share):
    """Targets by resharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_sources(docs, rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    found = mixing.mix_sources(docs, range_rows=2).collect()
    assert len(found) == len(rows)
    target, taken = filled(sizes, 1.5), Counter()
    for r in found:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 0.5
    again = mixing.mix_sources(docs.repartition(5), range_rows=1000).collect()
    key = lambda r: (str(r.doc_id), r.tie, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, found))


def test_mix_given_weights_and_empty(spark, docs, none):
    given = spark.createDataFrame([("a", 1), ("b", 3)], "source string, weight long")
    assert {r.source for r in mixing.mix_sources(docs, given).select("source").collect()} == {"a", "b"}
    assert mixing.mix_sources(none).isEmpty()


# ---- URL rules


URLS = [
    None, "", "no scheme.net/", "http://net/", "http://NET", "https://a.b.Example.NET/en/x?q=1", "http://example.net/en",
    "http://example.com/de/1#f", "http://notexample.com/de/", "ftp://x.org/fr/", "http://org/fr/x", "http://x.org/de/",
    "http://u:p@y.net:80/a", "http:///path", "http://a..net/z", "x://y://net/", "http://net?x=/", "http://" + "l." * 300 + "net/q",
]
RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
    ("block", "org", ""), ("allow", "y.net:80", "/a"), ("block", "net", "/"), ("allow", "net", "/"), (None, "com", "/"), ("block", None, "/"),
]


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for action, h, p in rules:
        if action and h is not None and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h + p), len(h), action, h + p))
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string, host string")
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, rules).collect()}
    assert got == {i: judged(u, RULES) for i, u in enumerate(URLS * 2)}
    assert urlfilter.judge_urls(pages.limit(0), rules).isEmpty()
    free = urlfilter.judge_urls(pages, rules.limit(0), default="block").select("verdict").distinct().collect()
    assert [r.verdict for r in free] == ["block"]


# ---- line dedup


def test_lines(docs, rows):
    least = {}
    rank = lambda i: (i is None, i or 0)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    for r in rows:
        for line in (r[1] or "").split("\n"):
            least[key(line)] = min(least.get(key(line), rank(r[0])), rank(r[0]))
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or least[key(x)] == rank(r[0])]
        want.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = linededup.apply_bitmaps(docs, linededup.repeated_lines(docs)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_one_line_in_every_document(spark):
    """A line that all documents share runs through several ranges."""
    many = spark.range(5000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("own first "), "id", F.lit("\nthe very same line\nown last line "), "id").alias("text"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = linededup.apply_bitmaps(many, linededup.repeated_lines(many)).groupBy("n_dropped").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r["n_dropped"]: r["count"] for r in got} == {0: 1, 1: 4999}


def test_lines_empty(none):
    assert linededup.apply_bitmaps(none, linededup.repeated_lines(none)).isEmpty()


# ---- language ID


def test_language(spark, none):
    en = "the house and the garden with that other thing which they wanted "
    de = "das haus und der garten mit dem anderen ding welches sie wollten "
    learn = spark.createDataFrame([(en * 5, "en"), (de * 5, "de"), ("zzz", None), (None, "de")], "text string, label string")
    model = langid.learn(learn)
    texts = [en, de, None, "", "12 !?", "é", en * 4 + de * 4, en * 3000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 4, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert got[5].lang_pred in ("en", "de")
    assert set(got[6].languages) == {"en", "de"} and 0.4 < got[6].score < 0.6
    assert set(got[0].languages) == {"en"} and got[0].score == 1.0 and got[2].score == 0.0
    unlearnt = langid.learn(none.select("text", "label"))
    assert {r.lang_pred for r in langid.identify(docs, unlearnt).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).isEmpty()


# ---- near duplicates


def shingles(text, k):
    own = words(text)
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if len(own) >= k else ({tuple(own)} if own else set())


def groups_of(rows, k, percent):
    sets = [shingles(r[1], k) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for x, r in zip(label, rows):
        if r[0] is not None:
            least[x] = min(least.get(x, r[0]), r[0])
    return [(r[0], len(s), least.get(x)) for x, r, s in zip(label, rows, sets)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, k, percent):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, k, percent).collect()]
    assert sorted(got, key=str) == sorted(groups_of(rows, k, percent), key=str)


def test_large_groups_of_near_copies(spark):
    """Groups far above the limit of a node, stars whose copies only resemble the hub among them."""
    rng = np.random.default_rng(5)
    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(200)]
        texts.append(" ".join(base))
        for c in range(150):
            own = list(base)
            for at in rng.choice(200, [1, 2, 4][g], replace=False):
                own[at] = f"c{g}x{c}y{at}"
            texts.append(" ".join(own))
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = neardup.near_duplicates(docs, 3, 85, limit=16).collect()
    want = {i: c for i, _, c in groups_of(rows, 3, 85)}
    assert all(want[r.doc_id] == r.component_id for r in found)


def edited(base, places, mark):
    own = list(base)
    for at in places:
        own[at] = f"{mark}y{at}"
    return own


def test_star_of_variants_that_resemble_only_their_hub(spark):
    """The hub resembles the pivots of every large node and must meet all variants nonetheless."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(200)]
    texts = [base, *(edited(base, rng.choice(200, 4, replace=False), f"c{c}") for c in range(900))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = neardup.near_duplicates(docs, 3, 85, limit=256)
    assert found.filter("component_id <> 0").count() == 0


def test_families_that_one_pair_joins(spark):
    """All classes resemble pivots, of two families that only the pair at 4 and 13 edits links."""
    base = [f"w{i}" for i in range(400)]
    order = np.random.default_rng(3).permutation(np.arange(2, 398, 4))
    chain = [edited(base, order[:k], "z") for k in (0, 4, 13, 17)]
    texts = chain + [edited(chain[3 * (c % 2)], [order[20 + c % 70]], f"c{c}") for c in range(100)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = {i: c for i, _, c in groups_of(rows, 3, 85)}
    assert set(want.values()) == {0}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert neardup.near_duplicates(docs, 3, 85, limit=16).filter("component_id <> 0").count() == 0


def test_near_empty(none):
    assert neardup.near_duplicates(none).isEmpty()


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (100, 101)]
    edges = spark.createDataFrame(path, "a long, b long").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    found = components(edges).groupBy("label").count().collect()
    assert sorted(r["count"] for r in found) == [41, 50]


# ---- packing


def test_packing(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    found = packing.pack_documents(docs, path).collect()
    want = Counter((r[0], tuple([*model.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in rows)
    by_row = defaultdict(list)
    for r in found:
        by_row[r.row].append(r)
    got = Counter()
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r.piece)
        ids = []
        for i, r in enumerate(pieces):
            assert (r.piece, r.start, r.length) == (i, len(ids), len(r.ids) // 4) and (i == 0 or r.length == 1024)
            ids += np.frombuffer(r.ids, "<u4").tolist()
        got[pieces[0].doc_id, tuple(ids)] += 1
    assert got == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024


def test_special_strings_and_white_space_encode_as_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "<|endoftext |> a", " lead", "trail ", "a  b", "a\u00a0b c", "x\n\ny z", "it's we'll 12 3", "\x1c a b\x1d", "", "a\0b c", "tab\t x"]
    texts += ["a\nb", "\na b", "a\n", "a \nb", "a\n b", "a.\nB, c!\nd", "a..\n\n\nb", "it's,\nwe'll; it's. 'tis, '! a' b", "é.\nÉ ß: 3. 4,", "a\n, b\n. c", "\n", "a\r\nb c\n\td", "x\u2028y z.\n\u00a0a"]
    got = packing.encoder(path).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [model.encode(x, add_special_tokens=False).ids for x in texts]


def test_sum_of_squares_is_close_to_the_bound():
    lengths = np.sort(np.random.default_rng(1).integers(1, 1024, 20000))[::-1]
    bins, offsets = packing.sum_of_squares(lengths, 1024)
    held = np.bincount(bins, lengths)
    assert held.max() <= 1024
    assert len(held) <= 1.01 * math.ceil(lengths.sum() / 1024)
    small, _ = packing.sum_of_squares(np.array([6, 5, 5, 4, 4, 3, 3]), 10)
    assert len(set(small.tolist())) == 3


def test_packing_empty(none):
    assert packing.pack_documents(none, public_tokenizers.path("byte_bpe_50k.json")).isEmpty()


# ---- top-k


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[5][1]) for i in range(40)]  # ties
    vectors += [(2000, None), (2001, [1.0] * 7 + [None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, [1.0, 2.0]), (2050, [2.0, 1.0]), (None, vectors[5][1]), (2100, [])]
    vectors.append(vectors[7])
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, rank string").repartition(4)
    found = topk.top_k(df, df.filter("vec_id % 50 = 0"), query_rows=3, candidate_rows=64, bins=16).collect()
    clean = [(i, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in clean:
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for j, v in clean if j != i and len(v) == len(q))[:5]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, found)) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).isEmpty()


# ---- language model


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney by the book, over plain dictionaries."""
    raw = Counter()
    for text in texts:
        own = ["<s>"] * (order - 1) + words(text) + ["</s>"]
        raw.update(tuple(own[i - order + 1 : i + 1]) for i in range(order - 1, len(own)))
    counts = {order: raw}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, contexts = {}, {}
    for k, own in counts.items():
        n = [sum(c == i for c in own.values()) for i in (1, 2, 3, 4)]
        if min(n) == 0:
            discounts[k] = [0, 0.5, 1.0, 1.5]
        else:
            y = n[0] / (n[0] + 2 * n[1])
            discounts[k] = [0, *(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0), i) for i in (1, 2, 3))]
        contexts[k] = defaultdict(list)
        for g, c in own.items():
            contexts[k][g[:-1]].append(c)
    vocabulary = len(counts[1])

    def probability(gram):
        k = len(gram)
        lower = probability(gram[1:]) if k > 1 else 1 / (vocabulary + 1)
        own = contexts[k].get(gram[:-1])
        if not own:
            return lower
        d = discounts[k]
        left = sum(d[min(c, 3)] for c in own) / sum(own)
        count = counts[k].get(gram, 0)
        return (count - d[min(count, 3)]) / sum(own) + left * lower

    def score(text):
        own = ["<s>"] * (order - 1) + words(text) + ["</s>"]
        return sum(math.log10(probability(tuple(own[i - order + 1 : i + 1]))) for i in range(order - 1, len(own)))

    return score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(spark, docs, rows, order):
    training = [r for r in rows if (r[0] or 0) % 3 != 1]
    train = spark.createDataFrame(training, SCHEMA).repartition(3)
    model = kneserney.train(train, order=order, chunk_chars=5000, held_rows=2000)
    score = brute_model([r[1] for r in training], order)
    counts = Counter(w for r in training for w in [*words(r[1]), "</s>"])
    total = sum(counts.values())
    want = []
    for r in rows:
        own = [*words(r[1]), "</s>"]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own)
        want.append((r[0], len(own), sum(counts[w] > 0 for w in own), base, score(r[1])))
    got = kneserney.score_texts(docs.select("doc_id", "text"), model, chunk_chars=3000).collect()
    order_of = lambda r: (str(r[0]), r[1], r[3])
    for a, b in zip(sorted(map(tuple, got), key=order_of), sorted(want, key=order_of), strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9) and math.isclose(a[4], b[4], rel_tol=1e-9)
    assert model.train_tokens == total and model.vocabulary == len(counts)


def test_shards_of_the_model_grow_with_the_tokens(docs):
    """The query counts trigrams; more shards change no score."""
    assert queries.LM_ORDER == 3
    texts = docs.select("doc_id", "text").filter("doc_id is not null")
    few, many = kneserney.train(texts), kneserney.train(texts, shard_tokens=1500)
    assert few.shards == 8 and many.shards >= many.train_tokens / 1500 > 8
    found = [
        sorted(((r.doc_id, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in kneserney.score_texts(texts, m).collect()), key=str)
        for m in (few, many)
    ]
    assert found[0] == found[1]


def test_language_model_is_small_and_leaves_no_blobs(spark, tmp_path):
    """Numbers instead of hashes of words; contexts of few and of many followers; steps are deleted once they are read."""
    rng = np.random.default_rng(5)
    texts = [f"of the w{i % 40} " + " ".join(f"w{i}" for i in np.minimum(rng.geometric(0.02, 60), 400)) for i in range(300)]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    left = lambda: {p.name for p in Path(urlparse(shared_root(spark)).path).glob("tidemill/ngrams-*")}
    before = left()
    model = kneserney.train(train, order=3, folder=str(tmp_path / "model"))
    assert left() == before
    grams = {tuple(x[i : i + 3]) for t in texts for x in [["<s>", "<s>", *words(t), "</s>"]] for i in range(len(x) - 2)}
    held = sum(p.stat().st_size - 128 for p in (tmp_path / "model").glob("3-*.npy"))
    assert held < 24 * len(grams)
    score = brute_model(texts, 3)
    asked = [*texts[:40], "of the w39 w1", "of the unknown", "", "unknown words of the"]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string")
    for r in kneserney.score_texts(docs, model).collect():
        assert math.isclose(r.score, score(asked[r.doc_id]), rel_tol=1e-9)


def test_scoring_looks_each_word_up_once(spark, monkeypatch):
    """Not once for every trigram that holds it; words are split at ASCII white space only, wherever it stands."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 30, 2000)) for _ in range(10)]
    model = kneserney.train(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    looked = []
    plain = kneserney._Table.find
    monkeypatch.setattr(kneserney._Table, "find", lambda table, hashes: looked.append(len(hashes)) or plain(table, hashes))
    kneserney.Scorer(model).score(pa.array(texts))
    trigrams = {t for x in texts for t in zip(*(words(x)[i:] for i in range(3)))}
    assert len(trigrams) > 10_000 and sum(looked) <= 32
    assert kneserney.Tokens.of(pa.array(["", " \t", " A\x0bb\r\n", "é\x1fÄ x\xa0y\x85z\x1c a"])).sizes.tolist() == [0, 0, 2, 3]


def test_a_scorer_holds_no_files_and_one_map_of_a_table(spark, tmp_path, monkeypatch):
    """Models of many shards: workers may have some thousands of files open and 65530 maps."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 300, 400)) for _ in range(40)]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    folder = str(tmp_path / "model")
    model = kneserney.train(train, order=3, folder=folder, shard_tokens=200)
    assert model.shards > 60
    opened = lambda: sum(str(p.readlink()).startswith(folder) for p in Path("/proc/self/fd").iterdir() if p.is_symlink())
    scorer = kneserney.Scorer(model)
    found = scorer.score(pa.array(texts))["score"].tolist()
    with open("/proc/self/maps") as maps:
        mapped = sum(folder in line for line in maps)
    assert opened() == 0 and model.shards < mapped <= 5 * model.shards + 2 * model.words.shards
    monkeypatch.setattr(kneserney, "MOST_MAPS", 7)
    few = kneserney.Scorer(model)
    assert few.score(pa.array(texts))["score"].tolist() == found and len(few.tables) == 7


def test_language_model_without_texts(docs, none):
    model = kneserney.train(none, order=2)
    assert model.train_tokens == 0
    assert {r.score for r in kneserney.score_texts(docs, model).collect()} == {0.0}
    assert kneserney.score_texts(none, model).isEmpty()


def test_model_needs_a_mounted_folder():
    with pytest.raises(ValueError):
        kneserney.local_folder("hdfs://cluster/models")


# ---- quality


def test_quality(spark, none):
    good = [(i, f"This is sentence {i} of a plain text, and it reads well.", f"h{i % 7}", "p") for i in range(200)]
    bad = [(1000 + i, f"BUY!! {i} ### $$$ NOW!! *** &&& %%%", f"h{i % 7}" if i % 2 else "spam", "q") for i in range(200)]
    extra = [(5000, None, None, None), (5001, "", "h1", None), (5002, "ok " * 20000, "once", "p")]
    docs = spark.createDataFrame(good + bad + extra, "doc_id long, text string, host string, path string")
    label = F.when(F.col("doc_id") < 1000, 1).when(F.col("doc_id") < 5000, 0)
    featured = quality.featurize(docs)
    model = quality.fit(featured.filter("doc_id % 2 = 0").withColumn("label", label))
    found = {r.doc_id: r for r in quality.judge(featured, model).collect()}
    assert len(found) == 403
    assert all(found[i].kept for i in range(200)) and not any(found[1000 + i].kept for i in range(200))
    # A site with much evidence goes far below the rest; one with a single document hardly moves.
    spam = next(r for r in found.values() if r.host == "spam")
    assert spam.site_score < 0.2
    assert abs(found[5002].site_score - 0.5) < abs(found[5002].doc_score - 0.5)
    assert 0 <= found[5000].score <= 1
    empty = quality.featurize(none.withColumns({"host": F.lit("h"), "path": F.lit("p")}))
    flat = quality.fit(empty.withColumn("label", F.lit(None).cast("int")))
    assert {round(r.doc_score, 6) for r in quality.judge(featured, flat).collect()} == {0.5}
    assert quality.judge(empty, model).isEmpty()


# ---- pipeline


def test_pipeline_stages(spark, docs, rows, tmp_path):
    expected = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    first = corpus_pipeline.identify_languages(spark, docs, None)
    assert first.columns == corpus_pipeline.COLUMNS
    assert sorted(map(str, (tuple(r) for r in first.collect()))) == sorted(str(r[:5]) for r in expected)
    second = corpus_pipeline.drop_copies(spark, first, None)
    stay = {}
    for r in expected:
        stay[r[1]] = max(stay.get(r[1], -1), -1 if r[0] is None else r[0])
    assert sorted(r.text for r in second.collect()) == sorted(stay)
    assert {r.text: -1 if r.doc_id is None else r.doc_id for r in second.collect()} == stay
    third = corpus_pipeline.drop_near_copies(spark, second, None)
    left = [(None if i < 0 else i, t) for t, i in stay.items()]
    want = [t for (i, t), (_, _, c) in zip(left, groups_of(left, 5, 80)) if i == c]
    assert sorted(r.text for r in third.collect()) == sorted(want)
    fourth = corpus_pipeline.mix(spark, third, None)
    taken = {(r.doc_id, r.tie): (r.taken, r["size"]) for r in mixing.mix_sources(third).collect()}
    assert fourth.count() == sum(-(-t // s) for t, s in taken.values() if t)
    assert fourth.columns == corpus_pipeline.COLUMNS
    last = corpus_pipeline.pack(spark, fourth, None)
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    ids = Counter()
    for r in fourth.collect():
        one = np.array([*model.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        head = len(one) % 1024 or 1024
        for piece in [one[:head], *(one[i : i + 1024] for i in range(head, len(one), 1024))]:
            if len(piece):
                ids[r.doc_id, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in last.collect()) == ids


def test_pipeline_runs_on_an_empty_table(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
    assert docs.isEmpty()


def test_digests_are_of_utf8(docs, rows):
    want = Counter(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)
    assert Counter(bytes(r.digest).hex() for r in exactdedup.exact_duplicates(docs).collect()) == want
