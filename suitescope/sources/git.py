"""Git histories and trees as tables, read from local clones without touching their working trees.

``gittree``: (repo, sha, path, content) of all files at given commits, one partition a commit, one
git process for all blobs of it.  ``gitlog``: (repo, seq, sha, author_ts, manifest) of the commits that
touched one file, oldest first, with the file's text at each (null where it is absent).

Clones are paths that the executors can read.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TREE_SCHEMA = "repo string, sha string, path string, content string"
LOG_SCHEMA = "repo string, seq int, sha string, author_ts timestamp, manifest string"


def git(root: str, *args: str, stdin: bytes | None = None) -> bytes | None:
    """Output of a git command in a clone; null if it fails."""
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", root, *args], input=stdin, capture_output=True, check=False)
    return done.stdout if done.returncode == 0 else None


def head(root: str) -> str | None:
    out = git(root, "rev-parse", "HEAD")
    return out.decode().strip() if out else None


def blobs(root: str, names: list[str]) -> Iterator[bytes | None]:
    """Contents of objects such as ``sha:path``, in order; null where there is none.  One process."""
    if not names:
        return
    with subprocess.Popen(["git", "-c", "safe.directory=*", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
        for name in names:
            if "\n" in name:
                yield git(root, "show", name)
                continue
            p.stdin.write(name.encode() + b"\n")
            p.stdin.flush()
            top = p.stdout.readline().rsplit(b" ", 2)
            if len(top) == 3 and top[1] == b"blob":
                yield p.stdout.read(int(top[2]))
                p.stdout.read(1)
            elif len(top) == 3 and top[2].strip().isdigit():  # a tree or a commit
                p.stdout.read(int(top[2]) + 1)
                yield None
            else:
                yield None
        p.stdin.close()


def tree_paths(root: str, sha: str) -> list[str]:
    out = git(root, "ls-tree", "-r", "-z", "--name-only", sha)
    if out is None:
        raise ValueError(f"no tree {sha} in {root}")
    return sorted(p.decode("utf-8", "surrogateescape") for p in out.split(b"\0") if p)


def text(raw: bytes | None) -> str | None:
    return None if raw is None else raw.decode("utf-8", "replace")


class _Part(InputPartition):
    def __init__(self, item: tuple):
        self.item = item


class _Reader(DataSourceReader):
    def __init__(self, items: list[tuple], read):
        self.items, self._read = items, read

    def partitions(self) -> list[InputPartition]:
        return [_Part(i) for i in self.items] or [_Part(())]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return self._read(*partition.item) if partition.item else iter(())


class GitTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gittree"

    def schema(self) -> str:
        return TREE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        ends = tuple(json.loads(self.options.get("suffixes", "[]")))

        def rows(repo: str, root: str, sha: str, suites: list[list[str]] | None = None) -> Iterator[tuple]:
            paths = [p for p in tree_paths(root, sha) if not ends or p.endswith(ends)]
            if suites is not None:
                paths = [p for p in paths if any(p.startswith(f"{d}/") and p.endswith(e) for d, e in suites)]
            for path, raw in zip(paths, blobs(root, [f"{sha}:{p}" for p in paths]), strict=True):
                yield repo, sha, path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), text(raw)

        return _Reader([tuple(x) for x in json.loads(self.options["commits"])], rows)


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        file = self.options.get("file", "composer.json")

        def rows(repo: str, root: str) -> Iterator[tuple]:
            from datetime import datetime

            # Newest first and turned round here: git's own --reverse loses commits once a file was renamed.
            out = git(root, "log", "--follow", "--format=%H %aI", "--", file)
            lines = [x.split(" ", 1) for x in (out or b"").decode().split("\n") if x.strip()][::-1]
            for seq, ((sha, date), raw) in enumerate(zip(lines, blobs(root, [f"{sha}:{file}" for sha, _ in lines]), strict=True)):
                yield repo, seq, sha, datetime.fromisoformat(date.strip()), text(raw)

        return _Reader([tuple(x) for x in json.loads(self.options["repos"])], rows)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitTree)
    spark.dataSource.register(GitLog)


def read_trees(spark: SparkSession, commits: list[tuple[str, str, str]], suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Files of (repo, clone, sha) triples; with ``suffixes`` only those that end so."""
    register(spark)
    return spark.read.format("gittree").option("commits", json.dumps(commits)).option("suffixes", json.dumps(list(suffixes))).load()


def read_suites(spark: SparkSession, commits: list[tuple[str, str, str, list[tuple[str, str]]]]) -> DataFrame:
    """Files of (repo, clone, sha, suites), where a suite is (directory, suffix): no other file's content is fetched."""
    register(spark)
    return spark.read.format("gittree").option("commits", json.dumps(commits)).load()


def read_log(spark: SparkSession, repos: list[tuple[str, str]], file: str = "composer.json") -> DataFrame:
    """Touches of ``file`` in (repo, clone) pairs."""
    register(spark)
    return spark.read.format("gitlog").option("repos", json.dumps(repos)).option("file", file).load()


def working_tree(spark: SparkSession, repo: str, root: str) -> DataFrame:
    """(repo, path, content) of the files in a folder, without hidden ones."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = root.rstrip("/") + "/"
    path = F.replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), F.lit("\\"), F.lit("/"))
    rows = files.select(F.lit(repo).alias("repo"), F.substring(path, F.lit(len(top) + 1), F.length(path)).alias("path"), F.decode("content", "UTF-8").alias("content"))
    return rows.where(~F.col("path").rlike(r"(^|/)\."))
