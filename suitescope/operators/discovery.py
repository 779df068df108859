"""Which files of a repository are its tests, by the directories its runner's configuration names."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Configuration files by rank, and the suite where none names a directory.
CONFIGS = ("phpunit.xml", "phpunit.xml.dist")
DEFAULT_DIR, DEFAULT_SUFFIX = "tests", "Test.php"


def normalise(directory: Column) -> Column:
    """Forward slashes, without leading dots and slashes or trailing slashes."""
    return F.rtrim(F.ltrim(F.replace(directory, F.lit("\\"), F.lit("/")), F.lit("./")), F.lit("/"))


def suite_dirs(text: str | None) -> list[dict[str, str]]:
    """(dir, suffix) of every directory of a test suite in a configuration; none if it is malformed."""
    if not text:
        return []
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return []
    out = []
    for suites in [root] * (root.tag == "testsuites") + root.findall(".//testsuites"):
        for node in suites.findall("./testsuite/directory"):
            where = (node.text or "").strip().replace("\\", "/").lstrip("./").rstrip("/")
            if where:
                out.append({"dir": where, "suffix": (node.get("suffix") or "").strip() or DEFAULT_SUFFIX})
    return out


SUITES = T.ArrayType(T.StructType([T.StructField("dir", T.StringType()), T.StructField("suffix", T.StringType())]))


@F.pandas_udf(SUITES)
def _parsed(texts: pd.Series) -> pd.Series:
    return texts.map(suite_dirs)


def suites(files: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, dir, suffix) from ``files`` (repo, path, content): the first configuration that names any, else the default."""
    configs = files.where(F.col("path").isin(*CONFIGS)).select("repo", "path", _parsed("content").alias("dirs")).where(F.size("dirs") > 0)
    chosen = configs.groupBy("repo").agg(F.min_by("dirs", F.when(F.col("path") == CONFIGS[0], 0).otherwise(1)).alias("dirs"))
    default = F.array(F.struct(F.lit(DEFAULT_DIR).alias("dir"), F.lit(DEFAULT_SUFFIX).alias("suffix")))
    return repos.select("repo").distinct().join(chosen, "repo", "left").select("repo", F.explode(F.coalesce("dirs", default)).alias("s")).select("repo", "s.dir", "s.suffix")


def discover(files: DataFrame, suites_: DataFrame) -> DataFrame:
    """Rows of ``files`` (repo, path, ...) in some suite, each once."""
    s = suites_.select(F.col("repo").alias("_repo"), "dir", "suffix")
    inside = (F.col("repo") == F.col("_repo")) & F.expr("startswith(path, concat(dir, '/'))") & F.expr("endswith(path, suffix)")
    return files.join(s, inside, "left_semi")


def corpus_names(lists: DataFrame, text: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, position, name) of corpus lists: one name a line, trimmed; blank lines and those that begin with # left out."""
    lines = lists.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("position", "name"))
    return lines.withColumn("name", F.regexp_replace("name", r"^[\x00\x09-\x0D\x20]+|[\x00\x09-\x0D\x20]+$", "")).where("name <> '' and not startswith(name, '#')")
