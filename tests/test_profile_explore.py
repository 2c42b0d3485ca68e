import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import explore, ordering, profile, quantiles


def test_profile_of_an_awkward_table(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "b", True, None), (2, float("nan"), "a", True, None), (2, 3.0, "b", None, None), (2, 3.0, "b", None, None)],
        "i int, f double, s string, b boolean, n string",
    )
    got = {r.column: r for r in profile.profile_columns(df).collect()}
    assert got["i"].details == "min=1.00, max=2.00, mean=1.75" and got["i"].unique == 2
    assert got["f"].details == "min=1.00, max=3.00, mean=2.33" and got["f"].nulls == 1
    assert got["s"].details == "top: b, freq: 3" and got["b"].details == "top: true, freq: 2"
    assert got["n"].details == "top: , freq: 0" and (got["n"].unique, got["n"].nulls) == (0, 4)
    near = {r.column: r for r in profile.profile_columns(df, approximate=True).collect()}
    assert {c: r.unique for c, r in near.items()} == {c: r.unique for c, r in got.items()}
    assert [(r.column, r.missing, r.percent) for r in profile.profile_missing(df).collect()] == [
        ("n", 4, 100.0), ("b", 2, 50.0), ("f", 1, 25.0)]
    table = profile.profile_table(df).first()
    assert (table.rows, table.columns, table.duplicates) == (4, 5, 1)
    assert table.data_bytes == 4 * (4 + 8 + 1) + 4 and table.data_size == "56.0 bytes"


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "i int, s string, t timestamp")
    assert profile.profile_table(df).first().duplicates == 0
    assert profile.profile_missing(df).count() == 0
    assert {r.column: r.unique for r in profile.profile_columns(df).collect()} == {"i": 0, "s": 0, "t": 0}
    assert profile.profile_correlations(df).count() == 0
    assert profile.describe(df).first()["count"] == 0


def test_correlations_skip_rows_per_pair_and_perfect_pairs(spark):
    rnd = random.Random(1)
    data = [(float(i), float(2 * i), rnd.random() if i % 3 else None, i % 2 == 0) for i in range(50)]
    df = spark.createDataFrame(data, "a double, b double, c double, flag boolean")
    xs = [(a, c) for a, _, c, _ in data if c is not None]
    ma, mc = (sum(v) / len(xs) for v in zip(*xs))
    r = sum((a - ma) * (c - mc) for a, c in xs) / math.sqrt(
        sum((a - ma) ** 2 for a, _ in xs) * sum((c - mc) ** 2 for _, c in xs))
    got = [(x.a, x.b, x.correlation) for x in profile.profile_correlations(df).collect()]
    assert ("a", "b") not in [g[:2] for g in got]
    assert {g[:2] for g in got} == {("a", "c"), ("b", "c")}
    assert got[0][2] == pytest.approx(abs(r), abs=5e-4)
    matrix = explore.correlation_matrix(df).collect()
    assert len(matrix) == 9


def test_correlations_of_every_pair(spark):
    df = spark.range(20).select(*[(F.rand(i) * i).alias(f"c{i}") for i in range(1, 5)])
    assert profile.correlation_pairs(df).count() == 6


def test_box_stats_by_group_and_overall(spark):
    data = [("a", float(i)) for i in range(10)] + [("a", 100.0), ("b", 1.0), ("b", 2.0)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r.g: r for r in explore.box_stats(df, "x", "g").collect()}
    assert (got["a"].q1, got["a"].median, got["a"].q3, got["a"].outliers) == (2.5, 5.0, 7.5, 1)
    assert (got["a"].whisker_low, got["a"].whisker_high) == (0.0, 9.0)
    assert got["b"].median == 1.5
    assert explore.box_stats(df, "x").first().median == 4.0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (None,), (float("nan"),)], "x double")
    got = sorted((r.bin, r.bin_start, r.bin_end, r.n) for r in explore.histogram(df, "x", 10).collect())
    assert got == [(0, 0.0, 1.0, 1), (1, 1.0, 2.0, 1), (9, 9.0, 10.0, 1)]
    assert explore.histogram(df.where("x = 1"), "x").first().n == 1
    assert explore.histogram(df.limit(0), "x").count() == 0


def test_conditional_summary(spark):
    df = spark.createDataFrame([(i % 2, float(i), "ab"[i % 2]) for i in range(9)], "k int, x double, s string")
    got = explore.conditional_summary(df, "x", {"k": 0, "absent": 1}).first()
    assert (got["mean"], got["median"], got["min"], got["max"], got["count"]) == (4.0, 4.0, 0.0, 8.0, 5)
    assert explore.conditional_summary(df, "x", {"k": 7}).count() == 0
    assert explore.conditional_summary(df, "x", {"x": 1.0}).count() == 0
    assert [tuple(r) for r in explore.conditional_summary(df, "s", {"k": 1}).collect()] == [("b", 4)]
    assert [tuple(r) for r in explore.conditional_summary(df, "s").collect()] == [("a", 5), ("b", 4)]


def test_sample_rows_is_exact_and_independent_of_partitioning(spark):
    df = spark.range(20000).withColumn("x", F.col("id") * 2)
    a = {r.id for r in ordering.sample_rows(df.repartition(3), 500, key="id").collect()}
    b = {r.id for r in ordering.sample_rows(df.repartition(11), 500, key="id").collect()}
    assert a == b and len(a) == 500
    assert len({r.id for r in ordering.sample_rows(df, 500, key="id", seed=1).collect()} & a) < 100
    assert ordering.sample_rows(df.withColumn("id", F.lit(1)), 700).count() == 700
    assert ordering.sample_rows(df.limit(10), 500).count() == 10


def test_sample_rows_draws_equal_rows_one_by_one(spark, monkeypatch):
    """Four rows with thousands of copies and 4,000 single ones, with a map and a name with a dot."""
    monkeypatch.setattr(ordering, "COPIES_AT_ONCE", 700, raising=False)
    n = F.when(F.col("id") < 36000, F.col("id") % 4).otherwise(F.col("id"))
    df = spark.range(40000).select(n.alias("a.b"), F.create_map(F.lit("k"), n % 2).alias("m"))
    found = []
    for parts in (3, 11):
        picked = ordering.sample_rows(df.repartition(parts), 1000)
        assert picked.schema == df.schema
        found.append(sorted((r[0], r[1]["k"]) for r in picked.collect()))
    assert found[0] == found[1] and len(found[0]) == 1000
    times = [sum(r[0] == i for r in found[0]) for i in range(4)]
    assert all(160 < t < 300 for t in times)  # 225 of each are expected
    single = [r[0] for r in found[0] if r[0] >= 4]
    assert 60 < len(single) < 140 and len(set(single)) == len(single) and min(single) >= 36000
    assert all(k == a % 2 for a, k in found[0])
    assert ordering.sample_rows(df, 39999).count() == 39999  # no threshold
    assert ordering.sample_rows(df, 39999).select("`a.b`").exceptAll(df.select("`a.b`")).count() == 0


def test_sample_rows_of_different_rows_follow_their_hash(spark):
    df = spark.range(20000).select("id", (F.col("id") % 7).alias("x"))
    hashed = [r[0] for r in df.orderBy(F.xxhash64(F.lit(42), "id", "x")).limit(500).collect()]
    assert sorted(r.id for r in ordering.sample_rows(df, 500).collect()) == sorted(hashed)


def test_sample_rows_of_different_rows_with_one_hash(spark, monkeypatch):
    """Rows that share a hash share its places: still exactly n rows of the table."""
    hash64 = F.xxhash64
    # the rows have three hashes; their copies keep draws of their own
    monkeypatch.setattr(F, "xxhash64", lambda seed, *c: hash64(seed, *c) if len(c) > 1 else hash64(seed, c[0] % 3))
    df = spark.range(3000).select((F.col("id") % 1000).alias("id"))
    picked = [[r.id for r in ordering.sample_rows(df.repartition(p), 700).collect()] for p in (2, 5)]
    assert sorted(picked[0]) == sorted(picked[1]) and len(picked[0]) == 700
    assert max(picked[0].count(i) for i in picked[0]) <= 3


@pytest.mark.parametrize("rows_per_bucket", [10**6, 7])
def test_fill_gaps_across_buckets(spark, rows_per_bucket):
    rnd = random.Random(5)
    labels = [None] * 25 + [rnd.choice([None, None, None, "a", "b"]) for _ in range(200)] + [None] * 30
    keys = rnd.sample(range(10000), len(labels))
    keys.sort()
    df = spark.createDataFrame(list(zip(keys, labels)), "k bigint, y string").repartition(6)
    want, last = [], next(v for v in labels if v is not None)
    for v in labels:
        last = v if v is not None else last
        want.append(last)
    got = ordering.fill_gaps(df, "y", "k", rows_per_bucket=rows_per_bucket).orderBy("k").collect()
    assert [r.y for r in got] == want and [r.k for r in got] == keys


def test_fill_gaps_without_any_value_and_by_time(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k int, y double")
    assert [r.y for r in ordering.fill_gaps(df, "y", "k").collect()] == [0.0, 0.0]
    timed = spark.range(30).select(
        F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("t"),
        F.when(F.col("id") % 5 == 2, F.col("id")).alias("y"),
    )
    got = [r.y for r in ordering.fill_gaps(timed, "y", "t", rows_per_bucket=4).orderBy("t").collect()]
    assert got == [2, 2, 2, 2, 2, 2, 2] + [v for v in (7, 12, 17, 22) for _ in range(5)] + [27, 27, 27]
    with pytest.raises(ValueError):
        ordering.fill_gaps(spark.createDataFrame([("a", 1)], "t string, y int"), "y", "t")


def test_removed_rows_and_compare(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, s string")
    after = before.where("id <> 2").drop("s")
    assert [tuple(r) for r in explore.removed_rows(before, after, "id").collect()] == [(2, "b")]
    got = explore.compare(before, after).first()
    assert (got.rows_before, got.rows_after, got.rows_delta, got.columns_delta) == (3, 2, -1, -1)


def test_explore_bundle(spark):
    df = spark.range(100).select("id", (F.rand(1) * 5).alias("x"), (F.col("id") % 3).cast("string").alias("g"))
    parts = explore.explore(df, by="g", key="id")
    assert parts["scatter"].columns == ["id", "x", "g"]
    assert all(p.count() > 0 for p in parts.values())


def test_group_summary_counts_text_and_averages_numbers(spark):
    df = spark.createDataFrame([(0, 1.0, "a"), (0, 2.0, None), (1, 5.555, "b")], "cluster int, x double, s string")
    got = {r.cluster: (r.x_count, r.x_mean, r.s_count) for r in explore.group_summary(df, "cluster").collect()}
    assert got == {0: (2, 1.5, 1), 1: (1, 5.56, 1)} or got[1][1] in (5.55, 5.56)


def test_most_frequent_with_long_text(spark):
    long = lambda c: c * 100
    data = (
        [(long("a"), long("x"), "s", None)] * 3
        + [(long("b"), long("y"), "s", None)] * 3
        + [("z", long("w"), long("q"), None)] * 2
    )
    df = spark.createDataFrame(data, "two string, several string, mixed string, none string")
    got = profile.most_frequent(df, df.columns)
    assert (got["two"].distinct, got["two"].value, got["two"].n) == (3, long("a"), 3)
    assert (got["several"].value, got["mixed"].value, got["mixed"].n) == (long("x"), "s", 6)
    assert (got["none"].distinct, got["none"].value, got["none"].n) == (0, None, 0)
    unique = spark.createDataFrame([(long("c"),), ("d",), (long("b"),)], "t string")
    assert profile.most_frequent(unique, ["t"])["t"].value == long("b")
    short = spark.createDataFrame([(long("c"),), ("a",), (long("b"),)], "t string")
    assert profile.most_frequent(short, ["t"])["t"].value == "a"


def test_most_frequent_joins_when_very_many_long_values_tie(spark, monkeypatch):
    monkeypatch.setattr(profile, "MAX_BROADCAST_KEYS", 1)
    df = spark.createDataFrame([("v" * 90,)] * 2 + [("u" * 90,)] * 2 + [("t" * 90,)], "t string")
    assert profile.most_frequent(df, ["t"])["t"].value == "u" * 90


def test_long_and_short_rows_count_as_duplicates_alike(spark):
    df = spark.createDataFrame([("k" * 500, None), ("k" * 500, None), ("k" * 499, None), (None, "a"), (None, "a")], "a string, b string")
    assert profile.duplicate_rows(df).first().duplicates == 2


def test_quantiles_of_many_columns(spark, monkeypatch):
    from tabloom.operators import quantiles

    monkeypatch.setattr(quantiles, "COLUMNS_PER_PASS", 2)
    df = spark.range(101).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(1, 6)])
    assert quantiles.exact_medians(df, df.columns) == {f"c{i}": 50.0 * i for i in range(1, 6)}


@pytest.mark.parametrize("limit", [6, 20])
def test_fewer_values_at_the_limit(spark, limit):
    for n in range(limit - 2, limit + 3):
        for seed in range(3):
            df = spark.range(400).select((F.pmod("id", F.lit(n)) * (7.3 + seed)).alias("x"))
            assert profile.fewer_values(df, "x", limit) == (n < limit)


def test_scatter_and_removed_rows_are_whole(spark):
    df = spark.range(6000).select("id", *[(F.col("id") % k).alias(f"c{k}") for k in range(2, 8)])
    got = explore.scatter_data(df)
    assert got.count() == 6000 and len(got.columns) == 7
    before = spark.createDataFrame([(1,), (None,), (2,)], "k long")
    assert [r.k for r in explore.removed_rows(before, before.filter("k is null or k = 1"), "k").collect()] == [2]


def test_quantiles_need_few_scans_whatever_the_spread(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 20_000
    columns = {
        "logarithmic": np.exp(rng.uniform(-700, 700, n)) * rng.choice([-1, 1], n),
        "constant": np.full(n, 3.5),
        "heavy": rng.pareto(0.05, n),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n)),
        "infinite": np.where(np.arange(n) % 3 == 0, np.inf, rng.normal(size=n)),
    }
    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(4).cache()
    df.count()
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    for small, bins, most in ((quantiles.SMALL, quantiles.BINS, 8), (5, 16, 20)):
        monkeypatch.setattr(quantiles, "SMALL", small)
        monkeypatch.setattr(quantiles, "BINS", bins)
        group = f"quantiles-{small}"
        spark.sparkContext.setJobGroup(group, group)
        got = quantiles.exact_quantiles(df, list(columns), probs)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert jobs <= most  # adaptive plans run one job per shuffle and broadcast
        for name, values in columns.items():
            ordered = np.sort(values)
            for p, found in zip(probs, got[name]):
                lo, hi, share = quantiles._ranks(n, p)
                a, b = ordered[lo], ordered[hi]
                assert found == (a if a == b or share == 0 else a + (b - a) * share)


def test_correlations_with_gaps_constants_and_infinities(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(1e6, 1, 500)
    frame = pd.DataFrame({"a": a, "b": 3 - 2 * a, "c": np.full(500, 3.3), "d": np.where(np.arange(500) % 3 == 0, np.nan, rng.normal(size=500))})
    frame["e"] = np.where(np.arange(500) == 7, np.inf, frame["d"] + a)
    pairs = profile.correlation_pairs(spark.createDataFrame(frame), diagonal=True)
    assert "Generate" not in pairs._jdf.queryExecution().toString()
    want = frame.corr()
    for row in pairs.collect():
        expected = want.loc[row.a, row.b]
        assert (row.r is None) if np.isnan(expected) else row.r == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("by", [None, "g"])
def test_all_histograms_and_boxes_at_once_equal_single_ones(spark, by):
    df = spark.createDataFrame(
        [(i, float(i % 17) if i % 5 else None, float("nan") if i % 7 == 0 else i * 0.5 if i != 90 else 1e6, None, "a" if i % 3 else None) for i in range(100)],
        "id long, `x.y` double, z double, none double, g string",
    )
    names = ["id", "x.y", "z", "none"]
    bins, box = explore.histograms(df, by=by), explore.boxes(df, by=by)
    shown = [by] if by else []
    assert bins.columns == ["column", "bin", "bin_start", "bin_end", *shown, "n"]
    plain = lambda d: sorted(map(str, d.collect()))
    for c in names:
        assert plain(bins.where(F.col("column") == c).drop("column")) == plain(explore.histogram(df, c, by=by))
        assert plain(box.where(F.col("column") == c).drop("column")) == plain(explore.box_stats(df, c, by=by))
    view = explore.explore(df, by=by)
    assert plain(view["box:z"]) == plain(explore.box_stats(df, "z", by=by)) and view["histogram:none"].isEmpty()
    empty = df.limit(0)
    assert explore.histograms(empty, by=by).count() == 0 and explore.boxes(empty, by=by).count() == 0
    with pytest.raises(ValueError, match="no numeric column"):
        explore.histograms(df.select("g"))
