"""The report: blocks of figures as small DataFrames, their texts, and their export to CSV."""

from __future__ import annotations

import csv
import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import samples, statistics
from ..schemas import CUTOFF, METRICS, TEST_TYPES

VERSION = "0.1.0"


def cutoff_default() -> str:
    return os.environ.get("ANALYSER_AI_CUTOFF") or CUTOFF


def tool_version() -> str:
    """What git calls this revision, else the package's version."""
    here = os.path.dirname(os.path.abspath(__file__))
    try:
        done = subprocess.run(["git", "-C", here, "describe", "--tags", "--always", "--dirty"], capture_output=True, text=True, timeout=20, check=False)
    except OSError:
        return VERSION
    return done.stdout.strip() if done.returncode == 0 and done.stdout.strip() else VERSION


def chosen_metrics(metric: str | None) -> list[str]:
    if metric is None:
        return list(METRICS)
    if metric not in METRICS:
        raise ValueError(f"Unknown metric '{metric}'. Known: {', '.join(METRICS)}")
    return [metric]


def _text(places: int, *columns: str) -> list[Column]:
    return [F.format_string(f"%.{places}f", F.col(c)).alias(c) for c in columns]


def _ranked(metrics: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, metrics)), F.col("metric"))


def state_sample(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    return samples.boundary_sample(observations, snapshots).select("major", "test_type", *METRICS)


def flow_sample(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    return samples.authored_sample(observations, snapshots).select("introduced_author_date", "ai_window", "test_type", *METRICS)


def descriptives(state: DataFrame, metrics: list[str]) -> DataFrame:
    d = statistics.descriptives(state, ["major"], metrics).orderBy(_ranked(metrics), "major")
    return d.select("metric", F.col("major").alias("framework_version"), "n", *_text(2, "mean", "median", "sd", "iqr"))


def regression(state: DataFrame, metrics: list[str]) -> DataFrame:
    fit = statistics.regression(state, "major", metrics).where("n_x > 1").orderBy(_ranked(metrics))
    return fit.select("metric", *_text(6, "slope", "intercept", "r2"), "n")


def types_by_version(state: DataFrame) -> DataFrame:
    by = statistics.distribution(state, "major", "test_type", TEST_TYPES).orderBy("major")
    return by.select(F.col("major").alias("framework_version"), "n", *_text(1, *TEST_TYPES))


def tests_of(flow: DataFrame, metrics: list[str], cutoff: str) -> DataFrame:
    """The rank tests of each metric, with ``refused`` where a side is too small."""
    second = samples.window_of(F.col("introduced_author_date"), cutoff) == "post"
    return statistics.comparison(flow, second, metrics).orderBy(_ranked(metrics))


def comparison(tests: DataFrame) -> DataFrame:
    return tests.select("metric", "n_pre", "n_post", *_text(2, "median_pre", "median_post"), *_text(1, "u"), *_text(3, "z"), *_text(4, "p"), *_text(3, "cliffs_delta"), "magnitude")


def types_by_window(flow: DataFrame, window: Column) -> DataFrame:
    windowed = flow.withColumn("ai_window", window).where("ai_window is not null")
    by = statistics.distribution(windowed, "ai_window", "test_type", TEST_TYPES).orderBy(F.desc("ai_window"))
    return by.select("ai_window", "n", *_text(1, *TEST_TYPES))


def report(spark: SparkSession, observations: DataFrame, snapshots: DataFrame, metric: str | None = None, cutoff: str | None = None, rebucket: bool = False) -> dict[str, DataFrame]:
    """Block name to rows, formatted as they are printed; blocks without data are left out.

    The comparison buckets by ``cutoff``; the table of types by window reads the stored window, unless
    ``rebucket``.  Blocks have a row for each metric and major at most: they are made at once, and the
    two samples are kept in the cache only while that goes on.
    """
    metrics, cutoff = chosen_metrics(metric), cutoff or cutoff_default()
    held = lambda df: spark.createDataFrame(df.collect(), df.schema)
    out = {"provenance": spark.createDataFrame([(tool_version(), cutoff[:10])], "tool_version string, ai_cutoff string")}
    state, flow = state_sample(observations, snapshots).cache(), flow_sample(observations, snapshots).cache()
    try:
        blocks = {"descriptives": held(descriptives(state, metrics)), "regression": held(regression(state, metrics)), "types_by_version": held(types_by_version(state))}
        tests = held(tests_of(flow, metrics, cutoff))
        if tests.where("not refused").isEmpty():
            blocks["comparison_refused"] = tests.select("metric", "n_pre", "n_post")
        else:
            blocks["ai_comparison"] = comparison(tests)
        blocks["types_by_window"] = held(types_by_window(flow, samples.window_of(F.col("introduced_author_date"), cutoff) if rebucket else F.col("ai_window")))
    finally:
        state.unpersist()
        flow.unpersist()
    return out | {name: df for name, df in blocks.items() if not df.isEmpty()}


def export(blocks: dict[str, DataFrame], base: str) -> list[str]:
    """Write ``<stem>_<block>.csv`` for each block; gives the paths.  A path that can't be written is skipped."""
    stem, out = re.sub(r"\.csv$", "", base, flags=re.I), []
    for name, df in blocks.items():
        if name == "comparison_refused":
            continue
        path = f"{stem}_{name}.csv"
        try:
            with open(path, "w", newline="") as f:
                w = csv.writer(f, lineterminator="\n")
                w.writerow(df.columns)
                w.writerows(tuple(r) for r in df.collect())  # a block has a row for each metric and major
        except OSError as e:
            print(f"Could not open {path} for writing: {e}. Block '{name}' not exported.")
            continue
        out.append(path)
    return out
