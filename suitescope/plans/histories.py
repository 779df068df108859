"""Queries over a small git history, made here commit by commit with fixed dates: sources, attribution, commands.

The clone lies in the folder that driver and executors share (spark.checkpoint.dir), or in a temporary
one where all run on this machine; it goes when the driver ends.
"""

from __future__ import annotations

import atexit
import os
import shutil
import subprocess
import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution, versioning
from ..sources import git
from ..sources.store import Store
from . import commands
from .catalogue import query

PLOT = """<?php
class PlotTest extends TestCase
{
    public function test_waters(): void
    {
        $this->assertSame(3, 1 + 2);
    }
%s}
"""
WEEDS = """
    public function test_weeds(): void
    {
        $plot = $this->createMock(Plot::class);
        $this->assertNotNull($plot);
    }
"""
RAIN = """<?php
it('rains', function () {
    expect(now())->not->toBeNull();
});
"""
#: (date, what changes): a manifest that names no major for a while, a test that comes later, a file touched once.
COMMITS = (
    ("2021-04-03", {"composer.json": '{"require":{"laravel/framework":"^8.0"}}', "tests/PlotTest.php": PLOT % "", "notes/plan.md": "beds"}),
    ("2022-02-10", {"composer.json": "{}"}),
    ("2022-09-20", {"composer.json": '{"require":{"laravel/framework":"^9.2"}}', "tests/PlotTest.php": PLOT % WEEDS}),
    ("2023-05-05", {"composer.json": '{"require":{"laravel/framework":"^10.0"}}', "tests/RainTest.php": RAIN, "tests/TornTest.php": "<?php class TornTest extends TestCase { function test_x() { $a = ; "}),
)
_made: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A new folder that all executors can read."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None or not (top.startswith(("file:", "/"))):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a mounted folder that the driver and all executors share")
        top = tempfile.gettempdir()
    path = f"{'/' + top.removeprefix('file:').strip('/')}/suitescope-history-{uuid.uuid4().hex}"
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def clone(spark: SparkSession) -> str:
    """The history's clone, made once an application."""
    app = spark.sparkContext.applicationId
    if app in _made:
        return _made[app]
    root = f"{folder(spark)}/garden"
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_NOSYSTEM": "1"}
    stream = []
    for date, files in COMMITS:
        who = f"A Gardener <a@example.org> {int(datetime.fromisoformat(date).replace(hour=12, tzinfo=UTC).timestamp())} +0000"
        stream.append(f"commit refs/heads/main\nauthor {who}\ncommitter {who}\ndata 4\nwork\n")
        stream += [f"M 100644 inline {path}\ndata {len(text.encode())}\n{text}\n" for path, text in files.items()]
    subprocess.run(["git", "-c", "init.defaultBranch=main", "init", "-q", root], env=env, check=True, capture_output=True)
    subprocess.run(["git", "-C", root, "fast-import", "--quiet"], input="".join(stream).encode(), env=env, check=True, capture_output=True)
    subprocess.run(["git", "-C", root, "checkout", "-q", "-f", "main"], env=env, check=True, capture_output=True)
    _made[app] = root
    return root


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


@query("SELECT * FROM (VALUES (0, '2021-04-03', 40, 8), (1, '2022-02-10', 40, NULL), (2, '2022-09-20', 40, 9), (3, '2023-05-05', 40, 10)) AS v(seq, author_day, sha_length, major)")
def manifest_history(spark: SparkSession, d: str) -> DataFrame:
    """Every commit that touched the manifest, oldest first, with the major it names."""
    log = git.read_log(spark, [("o/garden", clone(spark))])
    return log.select("seq", _day("author_ts").alias("author_day"), F.length("sha").alias("sha_length"), versioning.major_of(versioning.constraint_of(F.col("manifest"))).alias("major"))


_sizes = lambda files: ", ".join(f"('{p}', {len(x)})" for p, x in files)
_last = {p: x for _, files in COMMITS for p, x in files.items()}


@query(f"SELECT * FROM (VALUES {_sizes((p, x) for p, x in _last.items() if p.endswith('.php'))}) AS v(path, size)")
def tree_at_head(spark: SparkSession, d: str) -> DataFrame:
    """Files of the clone's head commit by suffix, from git's objects."""
    root = clone(spark)
    return git.read_trees(spark, [("o/garden", root, git.head(root))], (".php",)).select("path", F.length("content").alias("size"))


@query(f"SELECT * FROM (VALUES {_sizes(COMMITS[0][1].items())}) AS v(path, size)")
def tree_at_first_commit(spark: SparkSession, d: str) -> DataFrame:
    """All files as they were at a commit that isn't checked out."""
    root = clone(spark)
    first = git.git(root, "rev-list", "--max-parents=0", "HEAD").decode().strip()
    return git.read_trees(spark, [("o/garden", root, first)]).select("path", F.length("content").alias("size"))


@query(f"SELECT * FROM (VALUES {_sizes(_last.items())}) AS v(path, size)")
def working_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of the working tree, without hidden ones."""
    return git.working_tree(spark, "o/garden", clone(spark)).select("path", F.length("content").alias("size"))


@query("SELECT * FROM (VALUES (1, '2021-04-03', 40, 'pre'), (2, '2022-09-20', 40, 'pre'), (3, '2023-05-05', 40, 'post')) AS v(id, day, sha_length, ai_window)")
def introducing_commits(spark: SparkSession, d: str) -> DataFrame:
    """Traced lines, a file touched once, and ranges that no line has: these three have no row."""
    root = clone(spark)
    sha = git.head(root)
    ranges = [(1, "tests/PlotTest.php", 4, 7), (2, "tests/PlotTest.php", 9, 13), (3, "tests/RainTest.php", 2, 4), (4, "tests/PlotTest.php", 0, 3), (5, "tests/PlotTest.php", 7, 4), (6, "tests/RainTest.php", None, 2)]
    rows = spark.createDataFrame([(i, root, sha, *r) for i, *r in ranges], "id long, clone_path string, commit_sha string, file_path string, start_line int, end_line int")
    found = attribution.attribute(rows, "2022-11-30")
    return found.select(F.col("id").cast("int").alias("id"), _day("introduced_author_date").alias("day"), F.length("introduced_commit_sha").alias("sha_length"), "ai_window")


@query("""SELECT * FROM (VALUES
  (8, 'version_boundary', 'test_waters', 1, 0, NULL, NULL), (9, 'version_boundary', 'test_waters', 1, 0, NULL, NULL), (9, 'version_boundary', 'test_weeds', 1, 1, NULL, NULL),
  (10, 'version_boundary', 'test_waters', 1, 0, NULL, NULL), (10, 'version_boundary', 'test_weeds', 1, 1, NULL, NULL), (10, 'version_boundary', 'rains', 1, 0, NULL, NULL),
  (NULL, 'head', 'test_waters', 1, 0, '2021-04-03', 'pre'), (NULL, 'head', 'test_weeds', 1, 1, '2022-09-20', 'pre'), (NULL, 'head', 'rains', 1, 0, '2023-05-05', 'post')
) AS v(major, kind, identifier, assertions, mocks, day, ai_window)""")
def commands_on_a_history(spark: SparkSession, d: str) -> DataFrame:
    """What acquire, snapshot, extract (twice, then of the head) and blame leave in the store."""
    root = clone(spark)
    store = Store(spark, f"{folder(spark)}/store")
    commands.acquire(store, "o/garden", root)
    commands.snapshot(store, "o/garden")
    for head in (False, False, True):
        commands.extract(store, "o/garden", head)
    commands.blame(store, "o/garden", "2022-11-30")
    snaps = store.read("snapshots").select(F.col("id").alias("snapshot_id"), F.col("framework_version").alias("major"), "kind")
    rows = store.read("test_observations").join(snaps, "snapshot_id")
    return rows.select("major", "kind", "identifier", F.col("assertion_count").alias("assertions"), F.col("mock_breadth").alias("mocks"), _day("introduced_author_date").alias("day"), "ai_window")
