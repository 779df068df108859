"""Which commit introduced each test, from its lines at a snapshot's commit.

Tests of one file go together: how often the file was touched is asked once, and a file touched once
needs no tracing.  Otherwise the line range is traced back, and failing that its first line is blamed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.git import git
from .samples import window_of

LINE = re.compile(r"([0-9a-f]{40}) (\S+)")
Found = tuple[str, datetime] | None


def first_commit(output: bytes | None) -> Found:
    for line in (output or b"").decode("utf-8", "replace").split("\n"):
        if m := LINE.fullmatch(line.strip()):
            return m[1], datetime.fromisoformat(m[2])
    return None


def blamed(root: str, sha: str, path: str, line: int) -> Found:
    out = git(root, "blame", "-M", "-C", "-L", f"{line},{line}", "--porcelain", sha, "--", path)
    lines = (out or b"").decode("utf-8", "replace").split("\n")
    commit = lines[0].split(" ")[0]
    epoch = next((x.split(" ", 1)[1] for x in lines if x.startswith("author-time ")), None)
    if not re.fullmatch(r"[0-9a-f]{40}", commit) or epoch is None:
        return None
    return commit, datetime.fromtimestamp(int(epoch), UTC)


def introductions(root: str, sha: str, path: str, ranges: list[tuple[int | None, int | None]]) -> list[Found]:
    """For each line range of one file its introducing commit and author date, null where none is found."""
    valid = [bool(s and e and 1 <= s <= e) for s, e in ranges]
    if not any(valid):
        return [None] * len(ranges)
    touched = git(root, "log", "--follow", "--format=%H %aI", sha, "--", path)
    if len((touched or b"").split(b"\n")) <= 2:  # one line and what follows its end, or nothing
        sole = first_commit(touched)
        return [sole if v else None for v in valid]
    out: list[Found] = []
    for (s, e), v in zip(ranges, valid, strict=True):
        found = None
        if v:
            found = first_commit(git(root, "log", "--reverse", "-s", "--format=%H %aI", f"-L{int(s)},{int(e)}:{path}", sha)) or blamed(root, sha, path, int(s))
        out.append(found)
    return out


def valid_range(start: Column, end: Column) -> Column:
    """Whether a line range can be traced: it begins at line 1 or later and doesn't end before it begins."""
    return F.coalesce((start >= 1) & (end >= start), F.lit(False))


FACTS = "id long, introduced_commit_sha string, introduced_author_date timestamp"


def attribute(observations: DataFrame, cutoff: str) -> DataFrame:
    """(id, introduced_commit_sha, introduced_author_date, ai_window) of tests that could be attributed.

    ``observations``: (id, clone_path, commit_sha, file_path, start_line, end_line).  The cutoff is
    half-open: at it begins 'post'.  Tests without a valid line range are left out before files are dealt to tasks.
    """
    rows = observations.where(valid_range(F.col("start_line"), F.col("end_line"))).select("id", "clone_path", "commit_sha", "file_path", "start_line", "end_line")
    rows = rows.repartition("clone_path", "commit_sha", "file_path").sortWithinPartitions("clone_path", "commit_sha", "file_path", "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for (root, sha, path), own in f.groupby(["clone_path", "commit_sha", "file_path"], sort=False):
                ranges = [(None if pd.isna(s) else int(s), None if pd.isna(e) else int(e)) for s, e in zip(own["start_line"], own["end_line"], strict=True)]
                found = [(i, x) for i, x in zip(own["id"], introductions(root, sha, path, ranges), strict=True) if x]
                if found:
                    yield pd.DataFrame({"id": [i for i, _ in found], "introduced_commit_sha": [x[0] for _, x in found], "introduced_author_date": [pd.Timestamp(x[1]).tz_convert("UTC") for _, x in found]})

    return rows.mapInPandas(run, FACTS).withColumn("ai_window", window_of(F.col("introduced_author_date"), cutoff))


def introduced_first(commits: DataFrame, keys: list[str], seq: str, sha: str, date: str, cutoff: str) -> DataFrame:
    """(keys, sha, date, ai_window) of each key's first commit in a log that is a table already."""
    first = commits.groupBy(*keys).agg(F.min_by(F.struct(sha, date), F.col(seq)).alias("_f")).select(*keys, "_f.*")
    return first.withColumn("ai_window", window_of(F.col(date), cutoff))
