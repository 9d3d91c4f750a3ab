import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tallyworks.functions import quantiles
from tallyworks.functions.quantiles import exact_quantiles

PROBS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.95, "f": 1.0}


def check(spark, groups):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", PROBS).collect()}
    assert set(got) == {g for g, vs in groups.items() if vs}
    for g, vs in groups.items():
        for name, p in PROBS.items():
            if vs:
                assert got[g][name] == pytest.approx(np.quantile(vs, p), abs=1e-9), (g, p)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.dictionaries(
        st.sampled_from("xyz"), st.lists(st.one_of(st.integers(-5, 5), st.floats(-1e6, 1e6)), min_size=1, max_size=60), min_size=1
    )
)
def test_matches_numpy(spark, groups):
    check(spark, groups)


def test_coarse_sketch_stays_exact(spark, monkeypatch):
    """With a sketch of error one in 50 on thousands of rows, brackets do cut off most of them."""
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 50)
    rng = np.random.default_rng(1)
    check(spark, {"x": list(rng.normal(size=5000)), "y": list(rng.integers(0, 20, 3000)), "z": [1.0] * 2000 + [2.0]})


def test_without_groups_and_with_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (4.0,)], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5, "q": 0.25}).first().asDict() == {"m": 2.0, "q": 1.5}


def test_brackets_are_narrowed_until_few_values_are_left(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 20)
    monkeypatch.setattr(quantiles, "SORTED", 40)
    monkeypatch.setattr(quantiles, "PARTS", 4)
    seen = []
    narrowed = quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda inside, by: seen.append(1) or narrowed(inside, by))
    rng = np.random.default_rng(2)
    check(spark, {"x": list(rng.lognormal(0, 4, 3000)), "y": list(rng.integers(0, 7, 500)), "z": [3.0]})
    assert len(seen) >= 2
