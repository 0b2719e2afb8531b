"""Medians by selection against sorting."""

import random
from statistics import median

import pytest

from sparkloom.operators import stats


def test_medians_by_sorting(spark):
    rng = random.Random(3)
    groups = {"even": [rng.random() for _ in range(2000)], "odd": [rng.gauss(0, 5) for _ in range(1999)], "one": [7.5], "two": [1.0, 4.0], "equal": [0.25] * 50, "ties": [0.0] * 30 + [1.0] * 30, "far": [0.0, 1e-9, 2e-9, 1e9], "narrow": [1 + i * 1e-12 for i in range(501)]}
    rows = [(g, v) for g, some in groups.items() for v in some]
    rng.shuffle(rows)
    got = {r["g"]: r["median"] for r in stats.medians(spark.createDataFrame(rows, "g string, value double"), ["g"]).collect()}
    assert got == pytest.approx({g: median(some) for g, some in groups.items()}, rel=0, abs=1e-15)
    assert stats.medians(spark.createDataFrame([], "g string, value double"), ["g"]).count() == 0


def test_statistics_with_a_null_category(spark):
    rows = [(1, "f1", 0.5), (1, "f1", 1.0), (None, "f1", 0.0), (2, "f1", None)]
    got = {r["scope"]: r for r in stats.aggregate_metrics(spark.createDataFrame(rows, "category int, metric string, value double")).collect()}
    assert set(got) == {"overall", "1", None} and got["overall"]["median"] == 0.5 and got["overall"]["n"] == 3
    assert got["1"]["median"] == 0.75 and got[None]["std"] == 0.0
