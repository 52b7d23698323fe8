"""URL rules by digests of host suffixes and path prefixes.

A URL is expanded into the host suffixes and path prefixes that a rule could
have, each pair is digested, and the first four bytes of the digest meet the
rules in an equi-join. Only equal full digests count as a match. Suffixes are
taken for the label counts, prefixes for the lengths that occur among the
rules, so the expansion is exact for any rule and as small as the rules allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import lower_ascii


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # A host has no slash, so the two parts cannot run into each other.
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules (action, host, path) with digests; of repeated ones, block wins."""
    host, path = lower_ascii(F.col("host")), F.coalesce(F.col("path"), F.lit(""))
    return (
        rules.filter(F.col("host").isNotNull() & F.col("action").isin("allow", "block"))
        .select(host.alias("rule_host"), path.alias("rule_path"), "action")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("action").alias("action"))
        .withColumn("full", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("short", F.substring("full", 1, 4))
        .withColumn("labels", F.size(F.split("rule_host", "[.]", -1)))
        .withColumn("depth", F.length("rule_path"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The longest fitting rule wins, between equal lengths the one with the longer
    host. Without a rule the verdict is ``default``. A null URL or one without
    ``://`` has an empty host and path. Pages that share host and path are
    judged once, so one busy host is no larger a task than any other. An empty
    table gives an empty result; other columns are ignored.
    """
    located = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ready = prepared_rules(rules)
    # Two short lists: at most as long as the longest rule has labels and letters.
    shapes = ready.agg(F.collect_set("labels"), F.collect_set("depth")).first()
    counts, lengths = (F.array(*(F.lit(k) for k in sorted(x))).cast("array<int>") for x in shapes)
    expanded = (
        located.select("host", "path")
        .distinct()
        .withColumn("n_labels", F.size(F.split("host", "[.]", -1)))
        .withColumn("labels", F.explode(F.filter(counts, lambda k: k <= F.col("n_labels"))))
        .withColumn("depth", F.explode(F.filter(lengths, lambda k: k <= F.length("path"))))
        .withColumn("suffix", F.expr("substring_index(host, '.', -labels)"))
        .withColumn("prefix", F.expr("left(path, depth)"))
        .withColumn("mine", _digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", F.substring("mine", 1, 4))
    )
    fitting = expanded.select("host", "path", "mine", "short").join(
        ready.select("short", "full", "rule_host", "rule_path", "action"), "short"
    )
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    chosen = (
        fitting.filter(F.col("mine") == F.col("full"))
        .groupBy(F.col("host").alias("hit_host"), F.col("path").alias("hit_path"))
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "action"), rank).alias("won"))
    )
    hit = (F.col("host") == F.col("hit_host")) & (F.col("path") == F.col("hit_path"))
    return located.join(chosen, hit, "left").select(
        "page_id",
        "host",
        "path",
        F.col("won.rule").alias("rule"),
        F.coalesce("won.action", F.lit(default)).alias("verdict"),
    )
