"""Test files as a DataFrame: routed natively, read by one Python pass, and folded natively."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators import extraction
from ..schemas import TEST

FOUND = T.ArrayType(T.StructType([f for f in TEST if f.name != "path"]))


def read(files: DataFrame) -> DataFrame:
    """``files`` (path, content, ...) with front_end, status, problem and tests.

    status: parsed, failed (not valid), unroutable (no front end, or no class that qualifies), missing
    (no content).  Files that no front end takes pass without their content, so sources are read once.
    """
    routed = files.withColumn("front_end", extraction.front_end(F.col("content"))).withColumn("_some", F.col("content").isNotNull())
    routed = routed.withColumn("content", F.when(F.col("front_end").isNotNull(), F.col("content")))
    keep = [f for f in routed.schema if f.name != "content"]
    schema = T.StructType([*keep, T.StructField("parsed", T.BooleanType()), T.StructField("problem", T.StringType()), T.StructField("tests", FOUND)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .facts import read_file

        for f in frames:
            found = [read_file(c, e) if isinstance(e, str) else (None, None) for c, e in zip(f["content"], f["front_end"], strict=True)]
            f = f.drop(columns="content")
            f["parsed"] = [t is not None for t, _ in found]
            f["problem"] = [p for _, p in found]
            f["tests"] = [t for t, _ in found]
            yield f[schema.names]

    status = F.when(F.col("problem").isNotNull(), "failed").when(F.col("parsed"), "parsed").when(F.col("_some"), "unroutable").otherwise("missing")
    names = [*(f.name for f in keep if f.name != "_some"), "status", "problem", "tests"]
    return routed.mapInPandas(run, schema).withColumn("status", status).select(*names)


def observations(read_files: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each test: the keys, the path, and the stored measures."""
    t = read_files.where("status = 'parsed'").select(*keys, F.col("path").alias("file_path"), F.explode("tests").alias("t")).select(*keys, "file_path", "t.*")
    kind = extraction.test_type(F.col("has_http"), F.col("traits"), F.col("has_factory"), F.col("has_db_assert"), F.col("base_class"))
    t = t.withColumn("_kind", kind).withColumns(extraction.folds(F.col("mocks")))
    return t.select(
        *keys, "file_path", "identifier", "front_end", F.col("_kind.type").alias("test_type"), F.col("_kind.rule").alias("test_type_rule"),
        "assertion_count", "mock_breadth", "max_mock_chain_depth", "mock_kinds", "mocks", "size_statements", "size_loc",
        F.when(F.col("start_line") > 0, F.col("start_line")).alias("start_line"), F.when(F.col("end_line") > 0, F.col("end_line")).alias("end_line"),
        F.array_contains("traits", extraction.REFRESH).alias("uses_refresh_database"), "setup_signals",
    )


def failures(read_files: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each file that isn't valid: the keys, its path, and the message, cut to its limit."""
    return read_files.where("status = 'failed'").select(*keys, F.col("path").alias("file_path"), extraction.limited(F.col("problem")).alias("message"))


def summary(read_files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, files, tests, unroutable, failures)."""
    count = lambda s: F.count_if(F.col("status") == s)
    return read_files.where("status <> 'missing'").groupBy(*keys).agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("tests").cast("long")), F.lit(0)).alias("tests"), count("unroutable").alias("unroutable"), count("failed").alias("failures"))


def identified(found: DataFrame) -> DataFrame:
    """Observations with ``id``: by snapshot, file, name, line, and a number among those that agree in all of these."""
    seen = F.row_number().over(Window.partitionBy("snapshot_id", "file_path", "identifier", "start_line").orderBy("end_line"))
    return found.withColumn("_n", seen).withColumn("id", F.xxhash64("snapshot_id", "file_path", "identifier", "start_line", "_n")).drop("_n")
