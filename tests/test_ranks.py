"""The distributed ranks against the plain definitions, with ties, hot values and many keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import ranks as R


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]), "v": np.round(rng.lognormal(size=n), 2), "id": np.arange(n)})
    pdf.loc[rng.random(n) < 0.35, "v"] = 1.0
    return pdf, spark.createDataFrame(pdf)


def test_mid_ranks(spark, frame):
    pdf, df = frame
    out = R.cumulate(R.histogram(df, "v", ["k"]), "v", by=["k"]).select("k", "v", R.mid_rank().alias("r")).toPandas()
    want = pdf.assign(r=pdf.groupby("k")["v"].rank()).drop_duplicates(["k", "v"])
    both = out.merge(want, on=["k", "v"])
    assert len(both) == len(want) == len(out)
    assert np.allclose(both["r_x"], both["r_y"])


def test_quantiles(spark, frame):
    pdf, df = frame
    out = R.quantiles(df, "v", {"q1": 0.25, "m": 0.5, "p99": 0.99, "lo": 0.0, "hi": 1.0}, ["k"]).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        want = np.quantile(part["v"], [0.25, 0.5, 0.99, 0, 1])
        assert np.allclose(out.loc[k, ["q1", "m", "p99", "lo", "hi"]].astype(float), want)


def test_missing_and_non_finite_values_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (3.0,)], "v double")
    assert R.quantiles(df, "v", {"m": 0.5}).first()["m"] == 2.0
    assert R.quantiles(df.filter("v > 99 and v < 100"), "v", {"m": 0.5}).first()["m"] is None


def test_row_place_and_gap(spark, frame):
    pdf, df = frame
    out = R.row_place(df, [F.col("v"), F.col("id")], ["k"]).toPandas()
    want = pdf.sort_values(["v", "id"]).groupby("k").cumcount() + 1
    assert (out.set_index("id")["place"].sort_index() == want.sort_index()).all()
    got = R.smallest_gap(df, "v").first()
    distinct = np.sort(pdf["v"].unique())
    assert got["n_distinct"] == len(distinct)
    assert got["min_gap"] == pytest.approx(np.diff(distinct).min())


def test_running_extreme(spark, frame):
    pdf, df = frame
    hist = R.cumulate(R.histogram(df, "v"), "v").withColumn("s", F.pmod(F.hash("v"), F.lit(1000)).cast("double"))
    got = R.running_extreme(hist, "v", "s", "m").toPandas().sort_values("v")
    assert (got["m"] == got["s"].cummax()).all()
    low = R.running_extreme(hist, "v", "s", "m", smallest_above=True).toPandas().sort_values("v")
    assert (low["m"] == low["s"][::-1].cummin()[::-1]).all()
