"""Explicit schemas of the stored tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B, TS, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType(), T.DateType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MOCK = _struct(kind=S, target=S, chain_depth=I)

REPOSITORIES = _struct(id=L, full_name=S, owner=S, name=S, url=S, license=S, primary_test_framework=S, github_created_at=D, clone_path=S, head_sha=S, cloned_at=TS)
SNAPSHOTS = _struct(id=L, repository_id=L, commit_sha=S, framework_version=I, kind=S, commit_date=TS)
OBSERVATIONS = _struct(
    id=L, snapshot_id=L, repository_id=L, file_path=S, identifier=S, front_end=S, test_type=S, test_type_rule=S,
    assertion_count=I, mock_breadth=I, max_mock_chain_depth=I, mock_kinds=T.ArrayType(S), size_statements=I, size_loc=I,
    start_line=I, end_line=I, uses_refresh_database=B, setup_signals=T.MapType(S, I),
    introduced_commit_sha=S, introduced_author_date=TS, ai_window=S,
)
PARSE_FAILURES = _struct(repository_id=L, snapshot_id=L, file_path=S, commit_sha=S, message=S)

TABLES = {"repositories": REPOSITORIES, "snapshots": SNAPSHOTS, "test_observations": OBSERVATIONS, "parse_failures": PARSE_FAILURES}

#: What the parser gives for one test.
TEST = _struct(
    path=S, identifier=S, front_end=S, base_class=S, traits=T.ArrayType(S), assertion_count=I, mocks=T.ArrayType(MOCK),
    size_statements=I, size_loc=I, start_line=I, end_line=I, setup_signals=T.MapType(S, I),
    has_http=B, has_factory=B, has_db_assert=B,
)

# The words of the enumerations and the five metrics.
FRONT_ENDS = ("phpunit", "pest")
MOCK_KINDS = ("container", "mockery", "phpunit_native", "facade_fake")
TEST_TYPES = ("unit", "feature", "integration", "unknown")
METRICS = ("assertion_count", "mock_breadth", "max_mock_chain_depth", "size_statements", "size_loc")
CUTOFF = "2022-11-30"
GROUP_FLOOR = 5
