"""From manifest texts to framework majors, and the commit that stands for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import last_per

# The packages whose constraint names the framework's major, and how numbers are read.
PREFERRED, FALLBACK = "laravel/framework", "illuminate/support"
NUMBERS = r"(?i)\bv?(\d+)(?:\.[\dx*]+)*"


def major_of(constraint: Column) -> Column:
    """The least major that a version constraint names; null for none."""
    found = F.regexp_extract_all(constraint, F.lit(NUMBERS), F.lit(1))
    return F.array_min(F.transform(found, lambda x: x.try_cast("int")))


def constraint_of(manifest: Column) -> Column:
    """The framework's constraint in a JSON manifest.

    A preferred key of another type than text hides the fallback, as does an empty text; a ``require``
    that isn't an object, or a text that isn't JSON, gives null.
    """
    parsed = F.try_parse_json(manifest)
    named = [F.try_variant_get(parsed, f"$.require['{key}']", "variant") for key in (PREFERRED, FALLBACK)]
    chosen = F.coalesce(F.when(~F.is_variant_null(named[0]), named[0]), named[1])
    return F.when(F.schema_of_variant(chosen) == "STRING", chosen.cast("string"))


def representatives(touches: DataFrame) -> DataFrame:
    """(repo, major, sha, author_ts): the last commit of each major in log order, from (repo, seq, sha, author_ts, manifest).

    Commits whose manifest is missing or names no major are left out.
    """
    dated = touches.withColumn("major", major_of(constraint_of(F.col("manifest")))).where("major is not null")
    return last_per(dated, ["repo", "major"], F.struct("sha", "author_ts"), "seq")


def resolution(touches: DataFrame) -> DataFrame:
    """(repo, resolved, skipped): how many commits name a major and how many name none, from (repo, manifest)."""
    major = major_of(constraint_of(F.col("manifest")))
    return touches.groupBy("repo").agg(F.count_if(major.isNotNull()).alias("resolved"), F.count_if(major.isNull()).alias("skipped"))
