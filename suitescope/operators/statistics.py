"""Descriptive and rank statistics over any number of metrics and groups in one job.

Metrics are unpivoted to (metric, value) first.  Order statistics and ranks work on the histogram
of distinct values of a metric, made with partial aggregation before any shuffle.  Its running sums are
made slice by slice: a slice is a range of a group's values, found from the value and the group's
bounds alone, so no task sorts a whole group, however many distinct values that has.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normal import phi
from ..schemas import GROUP_FLOOR


def unpivot(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, value): one row for each row and metric, values as doubles."""
    stack = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    return df.select(*keys, F.expr(f"stack({len(metrics)}, {stack}) as (metric, value)"))


#: Slices: each doubling of the distance from a group's least value is cut so often, over so many doublings.
PER_DOUBLING, DOUBLINGS = 64, 20


def _beside(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """``left`` with the other columns of ``right``; null keys meet too."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on))
    return left.join(named, same).drop(*(f"_r_{c}" for c in on))


def slice_of(value: Column, lo: Column, hi: Column) -> Column:
    """Which range a value falls in: never less for a greater value; finer near the least one, as counts and prices pile up there."""
    x = F.try_divide(value - lo, hi - lo)
    last = PER_DOUBLING * DOUBLINGS + 2
    return F.when(x.isNull() | F.isnan(x), last).otherwise(F.floor(PER_DOUBLING * F.log2(1 + 2.0**DOUBLINGS * x)).cast("int"))


def running(h: DataFrame, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """``h`` with, for each of ``sums``, upto_<name>: over its group's values up to and with its own, and all_<name>: over all."""
    edge = h.groupBy(*by).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    cut = _beside(h, edge, by).withColumn("_slice", slice_of(F.col("value"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    parts = cut.groupBy(*by, "_slice").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    group = Window.partitionBy(*by)  # over slices, whose number has a bound
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_slice", *(F.sum(n).over(group).alias(f"all_{n}") for n in sums), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums))
    own = Window.partitionBy(*by, "_slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    within = cut.select("*", *(F.sum(c).over(own).alias(f"_own_{n}") for n, c in sums.items()))
    out = _beside(within, parts, [*by, "_slice"]).withColumns({f"upto_{n}": F.col(f"_own_{n}") + F.col(f"_before_{n}") for n in sums})
    return out.drop("_slice", *(f"_own_{n}" for n in sums), *(f"_before_{n}" for n in sums))


def descriptives(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, n, mean, median, sd, iqr) of each group.

    sd is the sample's, 0 for one value.  The quartiles are the medians of the lower and the upper
    half, the middle value of an odd number in neither; 0 for one value.  Null values are left out.
    """
    by = [*keys, "metric"]
    counts = unpivot(df, keys, metrics).where("value is not null").groupBy(*by, "value").agg(F.count("*").alias("c"))
    counts = running(counts, by, {"c": F.col("c"), "v": F.col("c") * F.col("value")})
    counts = counts.withColumns({"n": F.col("all_c"), "upto": F.col("upto_c"), "mean": F.col("all_v") / F.col("all_c")})
    half = F.floor(F.col("n") / 2)

    def middle(size: Column, skip: Column) -> tuple[Column, Column]:
        """The one or two middle places of ``size`` values after ``skip`` others."""
        return skip + F.floor((size + 1) / 2), skip + F.floor(size / 2) + 1

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") >= place, F.col("value")))

    def median(size: Column, skip: Column) -> Column:
        low, high = middle(size, skip)
        return (at(low) + at(high)) / 2

    out = counts.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("mean").alias("mean"), median(F.col("n"), F.lit(0)).alias("median"),
        F.sum(F.col("c") * F.pow(F.col("value") - F.col("mean"), F.lit(2.0))).alias("_ss"),
        median(half, F.lit(0)).alias("_q1"), median(half, F.col("n") - half).alias("_q3"),
    )
    one = F.col("n") < 2
    return out.select(*by, "n", "mean", "median", F.when(one, 0.0).otherwise(F.sqrt(F.try_divide(F.col("_ss"), F.col("n") - 1))).alias("sd"), F.when(one, 0.0).otherwise(F.col("_q3") - F.col("_q1")).alias("iqr"))


def regression(df: DataFrame, x: str, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, metric, slope, intercept, r2, n, n_x): least squares of each metric on ``x``.

    Where x does not vary: slope 0, intercept the mean, r2 0.  Where only the metric is constant: r2 1.
    With fewer than two points the intercept is 0.  n_x counts distinct x.
    """
    long = unpivot(df.withColumn("_x", F.col(x).cast("double")), [*keys, "_x"], metrics).where("_x is not null and value is not null")
    fit = long.groupBy(*keys, "metric").agg(
        F.regr_slope("value", "_x").alias("a"), F.regr_intercept("value", "_x").alias("b"), F.regr_r2("value", "_x").alias("r"),
        F.count("*").alias("n"), F.var_pop("_x").alias("vx"), F.var_pop("value").alias("vy"), F.avg("value").alias("m"), F.countDistinct("_x").alias("n_x"),
    )
    flat = (F.col("n") < 2) | (F.col("vx") == 0)
    return fit.select(
        *keys, "metric", F.when(flat, 0.0).otherwise(F.col("a")).alias("slope"),
        F.when(F.col("n") < 2, 0.0).when(flat, F.col("m")).otherwise(F.col("b")).alias("intercept"),
        F.when(flat, 0.0).when(F.col("vy") == 0, 1.0).otherwise(F.col("r")).alias("r2"), "n", "n_x",
    )


def rank_tests(df: DataFrame, second: Column, metrics: Sequence[str], keys: Sequence[str] = (), floor: int = 0) -> DataFrame:
    """Mann-Whitney U and Cliff's delta of the rows where ``second`` is false against those where it is true.

    (keys, metric, n_pre, n_post, median_pre, median_post, u, z, p, cliffs_delta, magnitude, refused).
    U is the smaller one, z is corrected for ties and not for continuity, p is two-sided.  Delta comes
    from the same rank sums, so no pair of values is ever formed.  An empty side gives u 0, z 0, p 1,
    delta 0.  ``refused`` marks sides smaller than ``floor``.
    """
    by = [*keys, "metric"]
    long = unpivot(df.withColumn("_post", second), [*keys, "_post"], metrics).where("value is not null and _post is not null")
    h = long.groupBy(*by, "value").agg(F.count_if(~F.col("_post")).cast("double").alias("a"), F.count_if("_post").cast("double").alias("b"))
    t = F.col("a") + F.col("b")
    h = running(h, by, {"t": t, "a": F.col("a"), "b": F.col("b")})
    h = h.withColumn("t", t).withColumnsRenamed({"upto_t": "upto", "upto_a": "ua", "upto_b": "ub", "all_a": "na", "all_b": "nb"})

    def median(c: str, n: str) -> Column:
        at = lambda place: F.min(F.when((F.col(c) >= place) & (F.col(n) > 0), F.col("value")))
        return (at(F.floor((F.col(n) + 1) / 2)) + at(F.floor(F.col(n) / 2) + 1)) / 2

    s = h.groupBy(*by).agg(
        F.max("na").alias("n1"), F.max("nb").alias("n2"), median("ua", "na").alias("median_pre"), median("ub", "nb").alias("median_post"),
        F.sum(F.col("a") * (F.col("upto") - F.col("t") + (F.col("t") + 1) / 2)).alias("r1"),
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"),
    )
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    empty = (n1 == 0) | (n2 == 0)
    s = s.withColumn("u1", F.col("r1") - n1 * (n1 + 1) / 2).withColumn("u", F.when(empty, 0.0).otherwise(F.least(F.col("u1"), n1 * n2 - F.col("u1"))))
    spread = F.sqrt(F.greatest(n1 * n2 / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0))), F.lit(0.0)))
    s = s.withColumn("sigma", F.when(empty, 0.0).otherwise(spread))
    s = s.withColumn("z", F.when(F.col("sigma") > 0, F.try_divide(F.col("u") - n1 * n2 / 2, F.col("sigma"))).otherwise(0.0))
    s = s.withColumn("p", F.when(empty, 1.0).otherwise(F.greatest(F.least(2 * (1 - phi(F.abs("z"))), F.lit(1.0)), F.lit(0.0))))
    s = s.withColumn("cliffs_delta", F.when(empty, 0.0).otherwise(F.try_divide(2 * F.col("u1"), n1 * n2) - 1))
    refused = (n1 < floor) | (n2 < floor)
    return s.select(*by, n1.cast("long").alias("n_pre"), n2.cast("long").alias("n_post"), "median_pre", "median_post", "u", "z", "p", "cliffs_delta", magnitude(F.col("cliffs_delta")).alias("magnitude"), refused.alias("refused"))


def comparison(df: DataFrame, second: Column, metrics: Sequence[str]) -> DataFrame:
    """``rank_tests`` with the report's floor of rows on each side."""
    return rank_tests(df, second, metrics, floor=GROUP_FLOOR)


def magnitude(delta: Column) -> Column:
    """How large an effect is; fixed values: bands of Cliff's delta."""
    size = F.abs(delta)
    return F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")


def agreement(pairs: DataFrame, first: str, second: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa of two raters' labels of the same items: (keys, n, observed, expected, kappa, band).

    ``pairs`` holds one row for each item; a null label is a label of its own.  1 where chance alone
    agrees fully.  Groups without items have no row: the caller sees that nothing was compared.
    """
    cells = pairs.select(*keys, F.coalesce(F.col(first).cast("string"), F.lit("\0")).alias("a"), F.coalesce(F.col(second).cast("string"), F.lit("\0")).alias("b"))
    cells = cells.groupBy(*keys, "a", "b").agg(F.count("*").cast("double").alias("c"))
    # Each cell speaks for its row and its column: the margins of both raters meet by label.
    same, none = F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0.0), F.lit(0.0)
    sides = F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("c").alias("x"), none.alias("y"), same.alias("same")), F.struct(F.col("b").alias("label"), none.alias("x"), F.col("c").alias("y"), none.alias("same"))))
    margins = cells.select(*keys, sides.alias("s")).groupBy(*keys, F.col("s.label").alias("label")).agg(*(F.sum(f"s.{c}").alias(c) for c in ("x", "y", "same")))
    both = margins.groupBy(*keys).agg(F.sum("x").alias("n"), F.sum(F.col("x") * F.col("y")).alias("chance"), F.sum("same").alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    out = both.where("n > 0").select(*keys, F.col("n").cast("long").alias("n"), po.alias("observed"), pe.alias("expected"))
    out = out.withColumn("kappa", F.when(F.col("expected") >= 1, 1.0).otherwise(F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected"))))
    return out.withColumn("band", agreement_band(F.col("kappa")))


def agreement_band(kappa: Column) -> Column:
    """The usual words for kappa."""
    return F.when(kappa < 0, "poor").when(kappa <= 0.2, "slight").when(kappa <= 0.4, "fair").when(kappa <= 0.6, "moderate").when(kappa <= 0.8, "substantial").otherwise("almost perfect")


def distribution(df: DataFrame, key: str, column: str, values: Sequence[str]) -> DataFrame:
    """(key, n, one column a value): what percentage of each group's rows has each value; others count in n only."""
    shares = [(F.try_divide(F.count_if(F.col(column) == v) * 100.0, F.count("*"))).alias(v) for v in values]
    return df.groupBy(key).agg(F.count("*").alias("n"), *shares)


def crosstab(df: DataFrame, key: str, column: str, values: Sequence[str]) -> DataFrame:
    """(key, one count a value, total)."""
    return df.groupBy(key).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values), F.count("*").alias("total"))
