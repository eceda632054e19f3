import numpy as np
import pytest

from sievetree.plans import tree


@pytest.mark.parametrize("total", [3000, 20_000])
def test_the_learner_sees_rows_of_the_whole_table(spark, monkeypatch, total):
    seen = []
    learn = tree.learn
    monkeypatch.setattr(tree, "learn", lambda rows, *a: seen.append(rows) or learn(rows, *a))
    df = spark.range(total).selectExpr("cast(id as double) as a", "cast(id % 7 as double) as b")
    tree.Model.fit(df, ["a", "b"], np.zeros((0, 2, 2)), tree.Params(sample=2000))
    at = seen[0][:, 0]
    assert len(at) == len(np.unique(at)) == 2000
    assert (np.histogram(at, 10, (0, total))[0] > 120).all()
