from types import SimpleNamespace

import numpy as np

from sievetree.operators import dependence as dep
from sievetree.streaming import update


def hot(spark):
    """Half of the rows are alike."""
    return spark.range(20_000).selectExpr("if(id % 2 = 0, -1D, cast(id as double)) as a", "if(id % 2 = 0, -1D, cast(id % 11 as double)) as b", "0 as side")


def test_drift_samples_take_hot_rows_in_proportion(spark):
    rows = update.Updater._sample(SimpleNamespace(columns=["a", "b"]), hot(spark).select("a", "b"), 2000)
    assert len(rows) == 2000 and 0.4 < (rows[:, 0] == -1).mean() < 0.6


def test_slices_take_hot_rows_in_proportion(spark, monkeypatch):
    df = hot(spark)
    got = dep.rdc_by_slice(df, ["a", "b"], "side", 2000).first().rdc
    rows = np.array([(r.a, r.b) for r in df.collect()])
    assert abs(got - dep.rdc(rows)[0, 1]) < 0.05
