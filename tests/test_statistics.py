import math
import statistics as st

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as h
from pyspark.sql import functions as F

from suitescope.operators import statistics as S


def ranked(spark, a, b):
    rows = [(float(x), False) for x in a] + [(float(x), True) for x in b]
    df = spark.createDataFrame(rows or [(None, False)], "v double, post boolean")
    return S.rank_tests(df, F.col("post"), ["v"]).first()


def halves(x):
    x, n = sorted(x), len(x)
    return st.median(x[n - n // 2 :]) - st.median(x[: n // 2]) if n > 1 else 0.0


@pytest.mark.parametrize(("a", "b", "delta"), [([3, 4, 5], [1, 2], 1.0), ([1, 2], [3, 4, 5], -1.0), ([1, 2, 3], [1, 2, 3], 0.0), ([1, 1, 2], [2, 3, 3], -8 / 9)])
def test_cliffs_delta(spark, a, b, delta):
    assert ranked(spark, a, b).cliffs_delta == pytest.approx(delta)


def test_u(spark):
    r = ranked(spark, range(1, 6), range(6, 11))
    assert (r.u, r.z) == (0, pytest.approx(-12.5 / math.sqrt(25 * 11 / 12)))
    assert r.p < 0.01
    assert ranked(spark, [1, 1, 2], [2, 3, 3]).u == 0.5
    tied = ranked(spark, [2, 2], [2, 2, 2])
    assert tied.z == 0
    assert tied.p == pytest.approx(1, abs=1e-6)
    one_side = ranked(spark, [1, 2], [])
    assert (one_side.p, one_side.cliffs_delta, one_side.u) == (1, 0, 0)


def test_bands(spark):
    row = spark.range(1).select(*(S.magnitude(F.lit(x)).alias(str(k)) for k, x in enumerate((0.1, -0.2, 0.4, -0.9)))).first()
    assert list(row) == ["negligible", "small", "medium", "large"]
    row = spark.range(1).select(*(S.agreement_band(F.lit(x)).alias(str(k)) for k, x in enumerate((0.65, 0.9, 0.1, -0.1)))).first()
    assert list(row) == ["substantial", "almost perfect", "slight", "poor"]


def test_kappa(spark):
    a = ["y"] * 5 + ["n"] * 5
    b = ["y"] * 4 + ["n"] + ["n"] * 4 + ["y"]
    frame = lambda x, y: spark.createDataFrame(list(zip(x, y, strict=True)), "a string, b string")
    assert S.agreement(frame(a, b), "a", "b").first().kappa == pytest.approx(0.6)
    assert S.agreement(frame(a, a), "a", "b").first().kappa == 1
    assert S.agreement(frame(["y"] * 3, ["y"] * 3), "a", "b").first().kappa == 1
    assert S.agreement(frame(["y", "y", "n", "n"], ["y", "n", "y", "n"]), "a", "b").first().kappa == pytest.approx(0)
    assert S.agreement(frame([], []), "a", "b").count() == 0


def test_regression(spark):
    fit = lambda pts: S.regression(spark.createDataFrame([(float(x), float(y)) for x, y in pts], "x double, y double"), "x", ["y"]).first()
    r = fit([(9, 1), (9, 2), (9, 3), (10, 3), (10, 4), (10, 5)])
    assert (r.slope, r.intercept, r.n) == (pytest.approx(2), pytest.approx(-16), 6)
    assert r.r2 == pytest.approx(0.6)
    assert fit([(1, 2), (2, 4)]).r2 == pytest.approx(1)
    flat = fit([(3, 1), (3, 5)])
    assert (flat.slope, flat.intercept, flat.r2, flat.n_x) == (0, 3, 0, 1)
    constant = fit([(1, 7), (2, 7), (3, 7)])
    assert (constant.slope, constant.r2) == (pytest.approx(0), 1)
    assert fit([(1, 7)]).intercept == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(h.lists(h.integers(0, 6), min_size=1, max_size=12), h.lists(h.integers(0, 6), min_size=1, max_size=12))
def test_ranks_agree_with_pairs(spark, a, b):
    r = ranked(spark, a, b)
    more, less = sum(x > y for x in a for y in b), sum(x < y for x in a for y in b)
    ties = len(a) * len(b) - more - less
    assert r.cliffs_delta == pytest.approx((more - less) / (len(a) * len(b)))
    assert r.u == pytest.approx(min(more, less) + ties / 2)
    assert (r.median_pre, r.median_post) == (st.median(a), st.median(b))


def test_descriptives_agree_with_lists(spark):
    groups = {1: [5], 2: [1, 1, 2, 2, 3], 3: [3, 3, 4, 4, 5], 4: [9, 1], 5: [1, 2, 3, 4, 5, 6, 7]}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "major int, m int")
    for r in S.descriptives(df, ["major"], ["m"]).collect():
        v = groups[r.major]
        assert (r.n, r.median) == (len(v), st.median(v))
        assert r.mean == pytest.approx(st.mean(v))
        assert r.sd == pytest.approx(st.stdev(v) if len(v) > 1 else 0)
        assert r.iqr == pytest.approx(halves(v))


def test_slices_keep_the_order_of_values(spark):
    values = [0.0, -1.5, 7.0, 1e300, float("-inf"), float("inf"), float("nan"), 3.0, 1e-300, 2.0]
    for some in (values, values[:4], [5.0], [1.0, 2.0, 3.0], [0.0, float("inf")], [1.0, float("nan")]):
        df = spark.createDataFrame([(x,) for x in some], "value double")
        edge = df.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        got = [r[0] for r in df.crossJoin(edge).orderBy("value").select(S.slice_of(F.col("value"), F.col("lo"), F.col("hi"))).collect()]
        assert got == sorted(got)


def test_many_distinct_values_and_null_keys(spark):
    import random

    draw = random.Random(5)
    rows = [(None if k % 3 == 0 else k % 3, draw.lognormvariate(0, 2), k % 2 == 0) for k in range(900)]
    df = spark.createDataFrame(rows, "g int, m double, post boolean")
    for r in S.descriptives(df, ["g"], ["m"]).collect():
        v = [m for g, m, _ in rows if g == r.g]
        assert (r.n, r.median, r.iqr) == (len(v), pytest.approx(st.median(v)), pytest.approx(halves(v)))
        assert (r.mean, r.sd) == (pytest.approx(st.mean(v)), pytest.approx(st.stdev(v)))
    for r in S.rank_tests(df, F.col("post"), ["m"], ["g"]).collect():
        a, b = ([m for g, m, p in rows if g == r.g and p == side] for side in (False, True))
        more = sum(x > y for x in a for y in b)
        assert r.u == pytest.approx(min(more, len(a) * len(b) - more))
