"""Ranks and quantiles: both paths against numpy, with ties and hot values."""

import numpy as np
import pandas as pd
import pytest

from cohortry.operators.order_stats import describe, quantiles, rank_values, summarize


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 4_000
    values = np.round(rng.lognormal(3, 2, n), 1)
    values[: n // 3] = 7.0  # one value holds a third of the rows
    groups = np.where(rng.random(n) < 0.8, "big", "small")
    pdf = pd.DataFrame({"g": groups, "v": values})
    pdf.loc[n] = ["one", 5.0]
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("small_rows", [0, 10**6])
def test_quantiles(frame, small_rows):
    pdf, df = frame
    probs = {"low": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.913, "top": 1.0}
    got = {r["g"]: r for r in quantiles(df, "v", ["g"], probs, small_rows).collect()}
    for g, part in pdf.groupby("g"):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(part["v"], p), rel=1e-12)


@pytest.mark.parametrize("small_rows", [0, 10**6])
def test_ranks(frame, small_rows):
    pdf, df = frame
    rows = rank_values(df, "v", ["g"], small_rows=small_rows).collect()
    want = pdf.assign(r=pdf.groupby("g")["v"].rank()).groupby(["g", "v"])["r"].agg(["first", "size"])
    assert len(rows) == len(want)
    for r in rows:
        rank, ties = want.loc[(r["g"], r["v"])]
        assert (r["avg_rank"], r["ties"]) == (rank, ties)


@pytest.mark.parametrize("small_rows", [0, 10**6])
def test_ranks_split_by_group(frame, small_rows):
    from pyspark.sql import functions as F

    pdf, df = frame
    rows = rank_values(df.withColumn("k", F.lit("x")), "v", ["k"], ["g"], small_rows)
    sums = {r["g"]: r["s"] for r in rows.groupBy("g").agg(F.sum(F.col("n") * F.col("avg_rank")).alias("s")).collect()}
    want = pdf.assign(r=pdf["v"].rank()).groupby("g")["r"].sum()
    assert sums == pytest.approx(want.to_dict())


def test_describe_and_summarize(frame):
    pdf, df = frame
    row = describe(df, ["v"]).first()
    want = pdf["v"].describe()
    assert [row[c] for c in ("count", "mean", "std", "min", "q1", "median", "q3", "max")] == pytest.approx(want.tolist())
    assert summarize(df, ["v"]).first()["median"] == pytest.approx(pdf["v"].median())
