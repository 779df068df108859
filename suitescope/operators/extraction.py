"""Native parts of extraction: routing files to a front end, classifying tests, folding their facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MOCK_KINDS, TEST_TYPES

# The shapes of source text by which a file finds its front end.
CLOSURE_STYLE = r"(?m)^\s*(it|test)\s*\("
ANY_CLASS = r"(?m)^\s*class\s+"
CLASS_STYLE = r"(?m)class\s+\w+\s+extends\s+\w*TestCase"
MESSAGE_LIMIT = 250

# The classifier's traits and rule tags.
DB_TRAITS = ("RefreshDatabase", "DatabaseTransactions", "DatabaseMigrations")
REFRESH = "RefreshDatabase"
RULES = ("R1_http_call", "R2_db_interaction", "R3_app_testcase_no_io", "R4_phpunit_testcase_no_io", "R5_unclassified")


def front_end(source: Column) -> Column:
    """'pest', 'phpunit', or null if no front end takes the file; closure style is asked first."""
    return F.when(source.rlike(CLOSURE_STYLE) & ~source.rlike(ANY_CLASS), "pest").when(source.rlike(CLASS_STYLE), "phpunit")


def test_type(has_http: Column, traits: Column, has_factory: Column, has_db_assert: Column, base_class: Column) -> Column:
    """struct(type, rule): the first rule that holds."""
    uses_db = F.coalesce(F.arrays_overlap(traits, F.array(*map(F.lit, DB_TRAITS))), F.lit(False)) | has_factory | has_db_assert

    def verdict(kind: str, rule: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(rule).alias("rule"))

    return (
        F.when(has_http, verdict("feature", RULES[0])).when(uses_db, verdict("integration", RULES[1]))
        .when(base_class != "TestCase", verdict("unit", RULES[2])).when(base_class == "TestCase", verdict("unit", RULES[3]))
        .otherwise(verdict("unknown", RULES[4]))
    )


def folds(mocks: Column) -> dict[str, Column]:
    """Breadth, greatest depth, and kinds in the order in which they first occur."""
    return {
        "mock_breadth": F.size(mocks),
        "max_mock_chain_depth": F.coalesce(F.array_max(F.transform(mocks, lambda m: m["chain_depth"])), F.lit(0)),
        "mock_kinds": F.array_distinct(F.transform(mocks, lambda m: m["kind"])),
    }


def limited(message: Column) -> Column:
    return F.when(F.length(message) > MESSAGE_LIMIT, F.concat(F.rtrim(F.substring(message, 1, MESSAGE_LIMIT)), F.lit("..."))).otherwise(message)


def primary_framework(observations: DataFrame, key: str = "repository_id", column: str = "front_end") -> DataFrame:
    """(key, primary_test_framework): the only front end present, or 'mixed'."""
    found = observations.groupBy(key).agg(F.count_distinct(column).alias("n"), F.min(column).alias("one"))
    return found.select(key, F.when(F.col("n") >= 2, "mixed").otherwise(F.col("one")).alias("primary_test_framework"))


def valid_words(observations: DataFrame) -> DataFrame:
    """Rows whose enumerations hold known words."""
    kinds = F.forall("mock_kinds", lambda k: k.isin(*MOCK_KINDS))
    return observations.where(F.col("test_type").isin(*TEST_TYPES) & F.coalesce(kinds, F.lit(True)))
