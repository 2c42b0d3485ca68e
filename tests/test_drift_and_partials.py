"""Drift scores and mergeable profiles against plain Python, on odd tables and on streams."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.operators import drift, partials


def brute_scores(before, after, edges):
    """psi and ks of two lists of numbers, None for missing."""
    place = lambda x: -1 if x is None or x != x else sum(e < x for e in edges)
    a, b = Counter(map(place, before)), Counter(map(place, after))
    psi, ks = 0.0, 0.0
    for i in range(-1, len(edges) + 1):
        if a[i] or b[i]:
            p, q = max(a[i] / len(before), 1e-4), max(b[i] / len(after), 1e-4)
            psi += (p - q) * math.log(p / q)
    there = [[x for x in xs if place(x) >= 0] for xs in (before, after)]
    for e in edges:
        ks = max(ks, abs(sum(x <= e for x in there[0]) / len(there[0]) - sum(x <= e for x in there[1]) / len(there[1])))
    return psi, ks


def exact_ks(a, b):
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in {*a, *b})


@pytest.mark.parametrize("approximate", [False, True])
def test_scores_like_plain_python(spark, approximate):
    rng = random.Random(1)
    before = [rng.gauss(0, 1) for _ in range(700)] + [None] * 20 + [float("nan")] * 5
    after = [rng.gauss(0.4, 1.5) for _ in range(500)] + [None] * 90 + [math.inf, -math.inf]
    a = spark.createDataFrame([(x, "u") for x in before], "x double, s string")
    b = spark.createDataFrame([(x, "v") for x in after], "x double, s string")
    bins = drift.DriftBins.from_json(drift.fit_bins(a, bins=16, approximate=approximate).to_json())
    got = {r["column"]: r for r in drift.drift(b, bins).collect()}
    psi, ks = brute_scores(before, after, bins.edges["x"])
    assert got["x"]["psi"] == pytest.approx(psi) and got["x"]["ks"] == pytest.approx(ks) and got["x"]["level"] == "major"
    true = exact_ks([x for x in before if x is not None and x == x], [x for x in after if x is not None])
    assert ks <= true + 1e-12 and true - ks <= 1 / 16 + 0.01
    assert got["s"]["unlisted_after"] == 1 and got["s"]["ks"] is None
    same = {r["column"]: r for r in drift.drift(a, bins).collect()}
    assert same["x"]["psi"] == 0 and same["x"]["level"] == "stable" and same["s"]["missing_after"] == 0


def test_odd_columns(spark):
    ddl = "n int, flag boolean, s string, none double, day date"
    a = spark.createDataFrame([(1, True, "a", None, None), (1, False, None, None, None), (1, None, "b", None, None)], ddl)
    bins = drift.fit_bins(a, bins=5, max_values=1)
    assert bins.edges == {"n": [1.0], "none": []} and bins.values["s"] == ["a"] and bins.values["day"] == []
    got = {r["column"]: r for r in drift.drift(a, bins).collect()}
    assert all(r["psi"] == 0 for r in got.values()) and got["s"]["unlisted_before"] == pytest.approx(1 / 3)
    empty = {r["column"]: r for r in drift.drift(a.limit(0), bins).collect()}
    assert set(empty) == set(got) and empty["n"]["psi"] is None and empty["n"]["level"] is None and empty["n"]["n_after"] == 0
    assert drift.fit_bins(a.limit(0)).counts == []


def test_one_scan_for_all_columns(spark, tmp_path):
    spark.range(500).select("id", (F.col("id") % 7).cast("string").alias("s"), F.rand(1).alias("r")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    counts = drift.bin_counts(df, drift.fit_bins(df))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan


def test_drift_of_a_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, rng.gauss(k / 100, 1), rng.choice("abc")) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, x double, s string")
    bins = drift.fit_bins(df.where("k < 200"), ["x", "s"], bins=8)
    for part in range(3):
        df.where(f"k >= 200 and k % 3 = {part}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = drift.bin_counts(stream, bins).writeStream.format("memory").queryName("drift_counts").outputMode("complete")
    query = query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = drift.score(spark, bins, spark.table("drift_counts")).orderBy("column").collect()
    assert got == drift.drift(df.where("k >= 200"), bins).orderBy("column").collect()
    by = drift.score(spark, bins, drift.bin_counts(df, bins, (F.col("k") >= 200).alias("late")), ["late"]).where("late").drop("late")
    assert by.orderBy("column").collect() == got


def sketch_free(rows):
    return {r["column"]: tuple(round(x, 9) if isinstance(x, float) else x for k, x in r.asDict().items() if k not in ("q25", "median", "q75", "distinct")) for r in rows}


def test_parts_give_the_profile_of_the_whole(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1e9 + rng.random(), float("nan"), rng.gauss(5, 2)]), rng.choice([None, "x", "yy", f"z{k}"]), k % 2 == 0) for k in range(5000)]
    df = spark.createDataFrame(rows, "k long, x double, s string, b boolean")
    path = str(tmp_path / "states")
    for i, part in enumerate(["k < 10", "k >= 10 and k < 3000", "k >= 3000", "k < 0"]):
        partials.add_batch(df.where(part), path, f"batch {i}")
    partials.add_batch(df.where("k >= 3000"), path, "batch 2")  # again: replaces itself
    got = partials.read_profile(partials.merge_profiles(spark.read.parquet(path))).collect()
    want = partials.read_profile(partials.partial_profile(df)).collect()
    mine, whole = sketch_free(got), sketch_free(want)
    assert mine.keys() == whole.keys()
    for c in mine:
        assert mine[c] == pytest.approx(whole[c], nan_ok=True) if c in "kx" else mine[c] == whole[c]
    numbers = sorted(k for k, *_ in rows)
    k = next(r for r in got if r["column"] == "k")
    assert abs(k["median"] - numbers[2500]) <= 0.02 * 5000 and abs(k["distinct"] - 5000) <= 0.05 * 5000
    x = next(r for r in got if r["column"] == "x")
    assert x["nulls"] == sum(v is None or v != v for _, v, *_ in rows)


def test_profiles_of_empty_and_differing_tables(spark):
    a = spark.createDataFrame([(1, "x", None)], "n int, s string, gone double")
    b = spark.createDataFrame([(2, 5), (4, None)], "n int, s int")
    empty = partials.read_profile(partials.merge_profiles(partials.partial_profile(a.limit(0)))).collect()
    assert {r["column"]: (r["rows"], r["mean"], r["distinct"]) for r in empty} == {"n": (0, None, 0), "s": (0, None, 0), "gone": (0, None, 0)}
    both = {r["column"]: r for r in partials.compare_profiles(partials.partial_profile(a), partials.partial_profile(b)).collect()}
    assert both["s"]["type_before"] == "text" and both["s"]["type_after"] == "number" and both["s"]["null_share_change"] == 0.5
    assert both["gone"]["rows_after"] is None and both["n"]["mean_shift"] is None
