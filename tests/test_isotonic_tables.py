"""Fits of more blocks than the driver takes: predictions from tables are those from breakpoints."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kalibra.operators import estimators, isotonic
from kalibra.plans import bridge, queries

SF = "/root/testdata/sf0.001"


def _same(a, b, *keys):
    a, b = (v.toPandas().sort_values(list(keys)).reset_index(drop=True) for v in (a, b))
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == float:
            np.testing.assert_allclose(a[c], b[c], rtol=1e-9, atol=1e-12)
        else:
            assert list(a[c]) == list(b[c])


def test_a_model_is_a_table_over_the_bound(spark, monkeypatch):
    rows = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(6)] + [("b", 1.0, 5.0), ("b", 2.0, 1.0)], "k string, x double, y double")
    ask = spark.createDataFrame([("a", -1.0), ("a", 2.5), ("a", None), ("a", 99.0), ("b", 1.5), ("c", 1.0)], "q string, x double")
    held = isotonic.model(isotonic.fit(rows, ["k"], "x", "y"), ["k"])
    assert isinstance(held, dict)
    monkeypatch.setattr(isotonic, "MOST_BLOCKS", 6)
    table = isotonic.model(isotonic.fit(rows, ["k"], "x", "y"), ["k"])
    assert not isinstance(table, dict) and table.count() == 7
    _same(isotonic.predict(ask, held, ["q"], "x", "f", 0.0, 20.0), isotonic.predict(ask, table, ["q"], "x", "f", 0.0, 20.0), "q", "x")
    with pytest.raises(ValueError, match="blocks"):
        isotonic.knots(isotonic.fit(rows, ["k"], "x", "y"), ["k"])


def test_estimators_on_tables_of_blocks(spark, monkeypatch):
    def found():
        m = queries.models(spark, SF)
        rows = queries.outcomes(spark, SF, m)
        parts = [rows.select("policy", "row_id", "reward", "reward_oof", "w_cal", "q"), estimators.mean_weight(rows).select("policy", "row_id", "m"), estimators.weighted_outcome(rows).select("policy", "row_id", "g"), estimators.honest_ips(rows)[0].select("policy", "row_id", "phi")]
        return m, parts, estimators.cross_fitted(rows.where("row_id % 9 = 0"), F.col("w"), "m", 0.0, least_rows=10**6).select("policy", "row_id", "m")

    held, parts, flat = found()
    monkeypatch.setattr(isotonic, "MOST_BLOCKS", 3)
    table, others, flat_too = found()
    assert isinstance(held[0], dict) and not isinstance(table[0], dict)
    for a, b in zip([*parts, flat], [*others, flat_too], strict=True):
        _same(a, b, "policy", "row_id")
    assert bridge.POLICIES == ["policy_a", "policy_b"] and flat.select("policy", "m").distinct().count() > 2
