"""The same table through pandas one-liners, which define the conventions being matched."""

import io
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.functions.text import WHITESPACE, snake_case
from tabloom.operators import clean, explore, profile
from tabloom.sources.delimited import read_csv


@pytest.fixture(scope="module")
def frame():
    rnd = random.Random(11)
    n = 400
    pick = lambda values: [rnd.choice(values) for _ in range(n)]
    df = pd.DataFrame(
        {
            "key": range(n),
            "hot": [7 if i < n // 3 else rnd.randrange(100) for i in range(n)],
            "x": [None if rnd.random() < 0.2 else rnd.gauss(10, 4) for _ in range(n)],
            "y": [rnd.choice([None, 1.5, 2.5, -3.0, 100.0]) for _ in range(n)],
            "word": pick(["b", "a", None, "c", "a ", "N/A"]),
            "long": pick(["q" * 80, "p" * 80, None, "r"]),
        }
    )
    return df


@pytest.fixture(scope="module")
def spark_frame(spark, frame):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in frame.itertuples(index=False)]
    schema = "key bigint, hot bigint, x double, y double, word string, long string"
    return spark.createDataFrame(rows, schema).repartition(4).cache()


def test_impute(frame, spark_frame):
    want = frame.copy()
    for c in want:
        fill = want[c].median() if pd.api.types.is_numeric_dtype(want[c]) else want[c].mode().iloc[0]
        want[c] = want[c].fillna(fill)
    got = clean.impute_missing(spark_frame)[0].toPandas().sort_values("key").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_deduplicate_keeps_the_first(frame, spark_frame):
    want = frame.drop_duplicates(subset=["hot", "word"])
    got = clean.deduplicate(spark_frame, ["hot", "word"], "key")[0].toPandas().sort_values("key")
    assert got.key.tolist() == want.key.tolist()
    want = frame[["hot", "long"]].drop_duplicates()
    assert clean.deduplicate(spark_frame.select("hot", "long"))[0].count() == len(want)


def test_outliers(frame, spark_frame):
    want = frame
    for c in ["key", "hot", "x", "y"]:
        if want[c].nunique() > 5:
            z = ((want[c] - want[c].mean()) / want[c].std()).abs()
            want = want[~(z > 1.5)]
    got = clean.remove_outliers(spark_frame, z_threshold=1.5)[0].toPandas().sort_values("key")
    assert got.key.tolist() == want.key.tolist() and 0 < len(want) < len(frame)


def test_describe_and_correlations(frame, spark_frame):
    want = frame.describe()
    for r in profile.describe(spark_frame).collect():
        got = [r["count"], r["mean"], r["std"], r["min"], r.p25, r.p50, r.p75, r["max"]]
        assert got == pytest.approx(want[r["column"]].tolist())
    corr = frame.select_dtypes("number").corr()
    for r in explore.correlation_matrix(spark_frame).collect():
        assert r.r == pytest.approx(corr.loc[r.a, r.b])


def test_profile_columns(frame, spark_frame):
    for r in profile.profile_columns(spark_frame).collect():
        assert (r.unique, r.nulls) == (frame[r.column].nunique(), frame[r.column].isna().sum())
    assert profile.duplicate_rows(spark_frame, ["hot", "long"]).first()[0] == frame.duplicated(["hot", "long"]).sum()


def test_histogram_and_groups(frame, spark_frame):
    counts, edges = np.histogram(frame.x.dropna(), bins=13)
    got = {r.bin: r.n for r in explore.histogram(spark_frame, "x", 13).collect()}
    assert [got.get(i, 0) for i in range(13)] == counts.tolist()
    want = frame.groupby("hot").x.agg(["count", "mean"])
    for r in explore.group_summary(spark_frame, "hot", ["x"]).collect():
        assert r.x_count == want.loc[r.hot, "count"]
        assert r.x_mean == pytest.approx(want.loc[r.hot, "mean"], abs=0.006) or r.x_count == 0


CSVS = [
    "a,b\n1,x\n2,y\n",
    "a,b\n1.5,\n,NA\n",
    "a,b,c\n1,2\n3,4,5\n",
    'a,b\n"x, y","l1\nl2"\n"q ""z""",\n',
    "a,a,b,a\n1,2,3,4\n",
    "f,g\nTrue,true\nFalse,nan\n",
    "i,j\n1,1e3\n-2,+4\n3,.5\n",
    "t,u\n2024-01-01,null\n2024-01-02,None\n",
    "a,,b\n1,2,3\n",
    "n,m\n007,0x1F\n8,9\n",
    "a\nn/a\n\n1\n",
    " s ,t\n pad ,1\nx, 2\n",
]


@pytest.mark.parametrize("text", CSVS)
def test_csv_reading(spark, tmp_path, text):
    (tmp_path / "t.csv").write_text(text)
    want = pd.read_csv(io.StringIO(text), engine="python")
    df = read_csv(spark, str(tmp_path / "t.csv"))
    got = df.toPandas()
    assert list(got.columns) == list(want.columns)
    for c in want:
        a = [None if pd.isna(v) else v for v in got[c]]
        b = [None if pd.isna(v) else v for v in want[c]]
        assert a == b, c
    kinds = {"int64": "bigint", "float64": "double", "object": "string", "bool": "boolean"}
    for (c, t), w in zip(df.dtypes, want.dtypes):
        # a boolean column with gaps stays boolean here
        assert t == kinds[str(w)] or t == "boolean", c


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=list(WHITESPACE + "aZ_9.-é")))
def test_names_and_whitespace(name):
    words = snake_case(name)
    assert words == words.strip("_") and "__" not in words
    assert all(ch in "abcdefghijklmnopqrstuvwxyz0123456789_" for ch in words)
    assert name.strip() == name.strip(WHITESPACE)
    assert snake_case(words) == words
