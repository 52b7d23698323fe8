"""The operators of this package as queries over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import centroids, exactdedup, kneserney, langid, lexical, linededup, mixing, neardup, packing, quality, suffixdedup, topk, urlfilter
from tidemill.llm.common import remainder
from tidemill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


#: Longest n-grams of the language model.
LM_ORDER = 3

#: The rules that the URL query judges by.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
f AS (SELECT *, 2 * source_size AS most, CAST(2 * source_size AS DOUBLE) / weight AS fill FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM f),
t AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE),
    coalesce((SELECT arg_min(level, fill) FROM l WHERE level <= fill) * weight, CAST(most AS DOUBLE))) AS target FROM l),
p AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget,
    CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
o AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.epochs, p.budget - p.epochs * p.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM o"""


@_query("op1_lm_score")
def op1_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of every document, learnt from six folds of seven."""
    docs = table(spark, folder, "documents").select("doc_id", "text", (remainder(7) == 2).alias("held_out"))
    model = kneserney.train(docs.filter(~F.col("held_out")), order=LM_ORDER)
    return kneserney.score_texts(docs, model).withColumn("train_tokens", F.lit(model.train_tokens).cast("bigint"))


@_query("op2_minhash_dedup")
def op2_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose sets of 3-word shingles are 85% alike."""
    found = neardup.near_duplicates(table(spark, folder, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@_query("op3_mix_sources", _MIX_SQL)
def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of 150% of all words takes of each document."""
    mixed = mixing.mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


_TOP_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""


@_query("op4_top_k", _TOP_SQL)
def op4_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five best matches of every fiftieth vector."""
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


_EXACT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM d"""


@_query("op5_exact_dedup", _EXACT_SQL)
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The row that stays of each group of equal texts."""
    found = exactdedup.exact_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


_LINE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS position FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id"""


@_query("op6_line_dedup", _LINE_SQL)
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that each document keeps, as a digest of the text that is left."""
    docs = table(spark, folder, "documents")
    kept = linededup.apply_bitmaps(docs, linededup.repeated_lines(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@_query("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learnt from two folds of three."""
    docs = table(spark, folder, "documents")
    fold = docs.select("doc_id", "text", "lang", (remainder(3) == 1).alias("held_out"))
    model = langid.learn(fold.filter(~F.col("held_out")).select("text", F.col("lang").alias("label")))
    judged = langid.identify(fold.select("doc_id", "text", "held_out"), model)
    return judged.select("doc_id", "held_out", "lang_pred", "score", F.map_keys("languages").alias("languages"))


@_query("op8_pack_documents")
def op8_pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 ids."""
    pieces = packing.tokenize_pieces(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    # The digest is taken first, so that ids stay where they were written.
    digested = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return digested.join(packing.place_pieces(pieces), ["row", "piece"]).drop("row")


@_query("op9_quality")
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learnt from the labels of four folds of five.

    The documents' hosts are their sources, the paths the languages of a source.
    """
    docs = table(spark, folder, "documents").withColumn("path", F.concat_ws("/", "source", "lang"))
    featured = quality.featurize(docs, host="source")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("labelled_id"), F.col("quality").alias("label"))
    known = featured.join(labels, F.col("doc_id") == F.col("labelled_id"))
    model = quality.fit(known.filter(remainder(5) != 1))
    return quality.judge(featured, model).withColumn("held_out", remainder(5) == 1)


_URL_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(action, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(action, 'allow') AS verdict
FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) = 1"""


@_query("op10_url_filter", _URL_SQL)
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rule and verdict of every page."""
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS rules(action, host, path)")
    return urlfilter.judge_urls(table(spark, folder, "pages"), rules)


def _cluster_sql(rounds: int) -> str:
    steps = [
        """e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, q) - 1 AS cluster, q AS c FROM e QUALIFY cluster < 40)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, q, cluster, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(q, c)]) AS BIGINT) AS distance
  FROM e CROSS JOIN c{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.cluster, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
    FROM (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
      FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{i}) GROUP BY cluster, i)
    GROUP BY cluster) m USING (cluster))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


@_query("op13_cluster_centroids", _cluster_sql(5))
def op13_cluster_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """The cluster of every vector after five rounds from 40 first centroids."""
    return centroids.cluster(table(spark, folder, "embeddings"))


_SUFFIX_SQL = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, unnest(range(0, CAST(length(x) // 2 - 99 AS BIGINT), 256)) AS c0, x FROM d),
y AS (SELECT r, c0, substr(x, 2 * c0 + 1, 710) AS x FROM c),
p AS (SELECT r, c0, x, unnest(range(least(256, CAST(length(x) // 2 - 99 AS BIGINT)))) AS k FROM y),
s AS (SELECT r, c0 + k AS p0, row_number() OVER (PARTITION BY md5(substr(x, 2 * k + 1, 200)) ORDER BY r, c0 + k) > 1 AS again FROM p),
g AS (SELECT r, p0, p0 > 100 + coalesce(lag(p0) OVER (PARTITION BY r ORDER BY p0), -101) AS opens FROM s WHERE again),
i AS (SELECT r, p0, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY r ORDER BY p0) AS span FROM g),
m AS (SELECT r, span, min(p0) AS a, max(p0) + 100 AS b FROM i GROUP BY r, span),
k AS (
  SELECT r, span, b, coalesce(lead(a) OVER (PARTITION BY r ORDER BY span), 1000000000) AS next_a,
    min(a) OVER (PARTITION BY r) AS first_a, b - a AS gone FROM m),
t AS (
  SELECT r, count(*) AS n_spans, CAST(sum(gone) AS BIGINT) AS n_removed, min(first_a) AS first_a,
    list((b, next_a) ORDER BY span) AS gaps FROM k GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN gaps IS NULL THEN x ELSE
    substr(x, 1, 2 * first_a) || array_to_string([substr(x, 2 * g[1] + 1, 2 * (g[2] - g[1])) FOR g IN gaps], '') END)) AS kept_sha256
FROM d LEFT JOIN t USING (r)"""


@_query("op12_suffix_dedup", _SUFFIX_SQL)
def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What each document loses of strings of 100 bytes that start earlier, and a digest of what is left."""
    kept = suffixdedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


_LEXICAL_SQL = r"""
WITH w AS (
  SELECT 1 AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 2, item_id, row_number() OVER (), text FROM benchmark),
t AS (
  SELECT kind, id, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM w WHERE text IS NOT NULL),
c AS (SELECT kind, id, r, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM c WHERE kind = 1 GROUP BY r),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS occurrences FROM n),
f AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight
  FROM c, a WHERE kind = 1 GROUP BY term, docs),
d AS (
  SELECT c.id AS doc_id, c.r, term, weight, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // occurrences)) AS impact
  FROM c JOIN n USING (r) JOIN f USING (term), a WHERE kind = 1),
s AS (
  SELECT i.r AS item, i.id AS item_id, d.r, doc_id, CAST(sum(i.tf * weight * impact) AS BIGINT) AS score
  FROM c i JOIN d USING (term) WHERE i.kind = 2 GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""


@_query("op11_lexical_search", _LEXICAL_SQL)
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
