"""Calm groups, crowded groups and both together give the same order statistics."""

import random
import statistics

import pytest

from tidemill.config import WindowSpec
from tidemill.operators import ranks
from tidemill.operators.aggregate import aggregate_users

SHARES = {"p10": 0.1, "p50": 0.5, "p99": 0.99}


@pytest.mark.parametrize("calm_rows", [0, 50, 10**6])
def test_quantiles_do_not_depend_on_the_path(spark, calm_rows):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, round(rng.gauss(0, 50), 1)])) for k, n in (("a", 20), ("b", 300), (None, 120), ("void", 0)) for _ in range(n)]
    df = spark.createDataFrame([*rows, ("void", None)], "k string, v double").repartition(4)
    found = {r.k: r for r in ranks.quantiles(df, ["k"], "v", SHARES, calm_rows=calm_rows).collect()}
    assert set(found) == {"a", "b", None}
    for key, row in found.items():
        own = sorted(v for k, v in rows if k == key and v is not None)
        assert row.n == len(own)
        for name, share in SHARES.items():
            at = (len(own) - 1) * share
            low = own[int(at)] + (own[min(int(at) + 1, len(own) - 1)] - own[int(at)]) * (at - int(at))
            assert abs(row[name] - low) < 1e-9
    whole = ranks.quantiles(df, [], "v", {"m": 0.5}, calm_rows=calm_rows).first()
    assert abs(whole.m - statistics.median(v for _, v in rows if v is not None)) < 1e-9


@pytest.mark.parametrize("spec", [None, WindowSpec("fixed", "1 hour"), WindowSpec("session", gap="20 minutes")])
def test_crowded_users_are_aggregated_alike(spark, spec):
    rng = random.Random(7)
    rows = [
        (rng.choice(["hot"] * 5 + ["a", None]), rng.randrange(40_000), rng.choice([None, 1.0, 2.5, 9.0]), rng.choice("xyz"))
        for _ in range(400)
    ]
    df = spark.createDataFrame(rows, "user_id string, s long, amount double, channel string").selectExpr(
        "*", "timestamp_seconds(s) AS event_time", "cast(s AS string) AS timestamp"
    )
    plain = lambda frame: sorted(str([x if not isinstance(x, float) else round(x, 9) for x in r]) for r in frame.collect())
    calm = plain(aggregate_users(df, spec))
    assert calm == plain(aggregate_users(df, spec, calm_rows=1)) == plain(aggregate_users(df, spec, calm_rows=15))
    if spec is not None and spec.kind == "session":
        times = {}
        for user, s, *_ in rows:
            times.setdefault(user or "unknown", []).append(s)
        count = sum(1 + sum(b - a >= 1200 for a, b in zip(sorted(t), sorted(t)[1:])) for t in times.values())
        assert len(calm) == count
