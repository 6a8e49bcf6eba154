"""Strongest features of a row, without lambdas over arrays."""

import math

from lodestar import constants as C
from lodestar.operators import explain


def test_strongest_features_are_sorted_without_lambdas(spark):
    rows = [
        (1, 1, 1, 0.1, -0.5, 0.3, 0.3, -0.3, 0.0, -0.0),
        (1, 2, 2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        (2, None, 1, None, 2.0, float("nan"), -3.0, float("-inf"), None, 1e-300),
    ]
    names = [f"c_{n}" for n in C.RANKING_FEATURES]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rank int, " + ", ".join(f"{n} double" for n in names))
    made = df.select("rank", explain.top_features(5).alias("top"), explain.top_features(7).getField("feature").alias("all"))
    records = explain.developer_attribution(df, "v1")
    for plan in (x._jdf.queryExecution().optimizedPlan().toString() for x in (made, records)):
        assert "lambda" not in plan

    def order(value, i):
        # Unknown values first, as the least; then no numbers, which are never the largest size.
        size = None if value is None else -abs(value)
        return (size is not None, size is not None and math.isnan(size), 0 if size is None or math.isnan(size) else size, i)

    for row, got, record in zip(rows, made.collect(), records.collect()):
        values = row[3:]
        expected = [C.RANKING_FEATURES[i] for i in sorted(range(7), key=lambda i: order(values[i], i))]
        assert [t.feature for t in got.top] == expected[:5] and got["all"] == expected
        assert [t.feature for t in record.top_features] == expected[:5]
        assert str([t.value for t in record.top_features]) == str([values[C.RANKING_FEATURES.index(n)] for n in expected[:5]])
        contributions = sorted(record.feature_contributions.items())
        assert str(contributions) == str(sorted(zip(C.RANKING_FEATURES, values))) and record.model_version == "v1"
