"""Quantiles by closing in on ranks, against the aggregate and numpy; splits in buckets, on odd rows."""

import math

import numpy as np

from rastrel.operators import catalog, ranks, sampling

SHARES = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.99, "e": 1.0}


def by_key(frame):
    show = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(show(x) for x in r) for r in frame.collect()), key=repr)


def test_both_ways_agree(spark):
    rng = np.random.default_rng(3)
    rows = [("smooth", float(x)) for x in rng.normal(size=5000)] + [("clumped", float(x)) for x in rng.random(300)]
    rows += [("clumped", 1e300), ("clumped", -1e300), ("inf", math.inf), ("inf", -math.inf), ("inf", 1.0), ("inf", 2.0)]
    rows += [("nan", math.nan), ("nan", 1.0), ("nan", 3.0), ("one", 7.0), ("none", None), (None, 4.0), (None, 5.0), (None, None)]
    rows += [("ties", 2.0)] * 500 + [("ties", 3.0)] * 501
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    plain, chosen = (ranks.quantiles(frame, "v", SHARES, "k", most=most) for most in (10**9, 0))
    assert plain.columns == chosen.columns
    assert by_key(plain) == by_key(chosen)
    smooth = next(r for r in chosen.collect() if r.k == "smooth")
    values = [v for k, v in rows if k == "smooth"]
    assert np.allclose([smooth[c] for c in SHARES], np.quantile(values, list(SHARES.values())))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert ranks.quantiles(empty, "v", SHARES, "k").count() == 0
    assert ranks.quantiles(empty, "v", SHARES, "k", most=-1).count() == 0


def test_stratified_keeps_null_class(spark):
    rows = spark.createDataFrame([(i, None if i < 40 else "x") for i in range(100)], "id long, kind string")
    out = sampling.stratified(rows, 1, "id", "kind", 0.1, 3).collect()
    assert len(out) == 300
    taken = {(kind, k): sum(r.split == "train" and r.kind == kind and r.repeat == k for r in out) for kind in (None, "x") for k in range(3)}
    assert taken == {(kind, k): n for kind, n in ((None, 4), ("x", 6)) for k in range(3)}


def test_more_buckets_same_ranks(spark, monkeypatch):
    rows = spark.range(500)
    few = {r.id: r["rank"] for r in sampling.shuffled_rank(rows, "s", "id").collect()}
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 1)
    many = {r.id: r["rank"] for r in sampling.shuffled_rank(rows, "s", "id").collect()}
    assert few == many and sorted(few.values()) == list(range(500))


def test_region_without_a_fit_keeps_all(spark):
    rows = [("a", "2024-01-02", 1.0), ("a", "2024-01-03", 9.0), ("b", "2023-01-01", 1.0), (None, "2024-01-02", 1.0), (None, "2020-01-01", 1.0)]
    frame = spark.createDataFrame(rows, "region string, d string, cloud_pct double").selectExpr("region", "to_date(d) AS acq_date", "cloud_pct")
    kept = catalog.chosen(frame, "2024-01-01", "2024-02-01", 5.0).collect()
    assert sorted((r.region or "-", r.fits) for r in kept) == [("-", True), ("a", True), ("b", False)]
