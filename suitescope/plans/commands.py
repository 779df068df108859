"""The commands: acquire, snapshot, extract, blame, verify, report, batch.

Each takes a Store and gives a summary; CommandFailed says why one could not be done.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract import frames
from ..operators import attribution, discovery, extraction, quality, samples, versioning
from ..session import session
from ..sources import git
from ..sources.store import Store
from . import report as reports

STAGES = ("acquire", "snapshot", "extract", "blame", "verify")


class CommandFailed(Exception):
    """A command's precondition or result is missing."""


def key_of(*columns: str):
    return F.xxhash64(*columns)


def acquire(store: Store, full_name: str, clone: str, metadata: dict | None = None) -> DataFrame:
    """Register a local clone.  ``metadata``: license and github_created_at where known; absence is no failure."""
    if full_name.count("/") != 1 or not all(full_name.split("/")):
        raise CommandFailed(f"'{full_name}' is not of the form owner/name.")
    sha = git.head(clone) if os.path.isdir(clone) else None
    if sha is None:
        raise CommandFailed(f"No clone at {clone}.")
    owner, name = full_name.split("/")
    meta = metadata or {}
    row = store.spark.createDataFrame([(full_name, owner, name, f"https://github.com/{full_name}.git", os.path.abspath(clone), sha, meta.get("license"), meta.get("github_created_at"))], "full_name string, owner string, name string, url string, clone_path string, head_sha string, license string, github_created_at string")
    row = row.select(key_of("full_name").alias("id"), "*", F.current_timestamp().alias("cloned_at")).withColumn("github_created_at", F.to_date("github_created_at"))
    store.upsert("repositories", row, ["full_name"])
    return store.read("repositories").where(F.col("full_name") == full_name)


def _repository(store: Store, full_name: str):
    row = store.read("repositories").where(F.col("full_name") == full_name).first()
    if row is None:
        raise CommandFailed("Repository not acquired yet.")
    if not os.path.isdir(row.clone_path):
        raise CommandFailed(f"Clone path missing on disk: {row.clone_path}")
    return row


def snapshot(store: Store, full_name: str) -> DataFrame:
    """The last commit of each major that touched the manifest; majors gone from history are kept."""
    repo = _repository(store, full_name)
    touches = git.read_log(store.spark, [(full_name, repo.clone_path)]).cache()
    skipped = versioning.resolution(touches).agg(F.sum("skipped")).first()[0]
    if skipped:
        print(f"{full_name}: {skipped} manifest commit(s) name no major and were skipped.", file=sys.stderr)
    found = versioning.representatives(touches).select(
        F.xxhash64(F.lit(repo.id), "major").alias("id"), F.lit(repo.id).alias("repository_id"), F.col("sha").alias("commit_sha"),
        F.col("major").alias("framework_version"), F.lit("version_boundary").alias("kind"), F.col("author_ts").alias("commit_date"),
    ).cache()
    if found.isEmpty():
        raise CommandFailed("No manifest commit resolves to a major.")
    store.upsert("snapshots", found, ["repository_id", "framework_version"])
    touches.unpersist()
    return found.select("framework_version", F.substring("commit_sha", 1, 12).alias("commit"), "commit_date").orderBy("framework_version")


def extract(store: Store, full_name: str, head: bool = False) -> DataFrame:
    """Read the tests of every version boundary, or of the clone's head, replacing what was read of them before."""
    repo = _repository(store, full_name)
    mine = F.col("repository_id") == repo.id
    if head:
        row = store.spark.createDataFrame([(repo.id, repo.head_sha)], "repository_id long, commit_sha string").select(F.xxhash64("repository_id", F.lit("head")).alias("id"), "*", F.lit("head").alias("kind"))
        store.upsert("snapshots", row, ["id"])
    which = F.col("kind") == ("head" if head else "version_boundary")
    snaps = store.read("snapshots").where(mine & which).orderBy("framework_version").collect()  # one a major
    if not snaps:
        raise CommandFailed("No snapshots: run snapshot first.")
    # Configurations first: the suites say which files' contents to read.
    trees = [(full_name, repo.clone_path, s.commit_sha) for s in snaps]
    shas = store.spark.createDataFrame([(s.commit_sha,) for s in snaps], "repo string")
    suites = discovery.suites(git.read_trees(store.spark, trees, discovery.CONFIGS).withColumn("repo", F.col("sha")), shas).cache()
    own: dict[str, list[tuple[str, str]]] = {}
    for r in suites.distinct().collect():  # a few for each snapshot of one repository
        own.setdefault(r.repo, []).append((r.dir, r.suffix))
    files = git.read_suites(store.spark, [(*tree, own.get(tree[2], [])) for tree in trees]).withColumn("repo", F.col("sha"))
    inside = discovery.discover(files, suites).select(F.col("sha").alias("commit_sha"), "path", "content")
    ids = store.spark.createDataFrame([(s.id, s.commit_sha) for s in snaps], "snapshot_id long, commit_sha string")
    read = frames.read(inside.join(ids, "commit_sha").withColumn("repository_id", F.lit(repo.id))).cache()
    keys = ["repository_id", "snapshot_id"]
    found = frames.identified(frames.observations(read, keys))
    names = [s.id for s in snaps]
    store.replace("test_observations", found, "snapshot_id", names)
    store.replace("parse_failures", frames.failures(read, [*keys, "commit_sha"]), "snapshot_id", names)
    primary = extraction.primary_framework(store.read("test_observations").where(mine)).select(F.col("repository_id").alias("id"), "primary_test_framework")
    store.rebuild("repositories", F.col("id") == repo.id, primary, "id", ["primary_test_framework"])
    out = store.spark.createDataFrame(frames.summary(read, ["snapshot_id"]).collect() or [], "snapshot_id long, files long, tests long, unroutable long, failures long")
    read.unpersist()
    suites.unpersist()
    return out


def blame(store: Store, full_name: str, cutoff: str | None = None) -> DataFrame:
    """Attribute the newest extracted snapshot's tests; all of the repository's attributions are made anew."""
    repo = _repository(store, full_name)
    mine = F.col("repository_id") == repo.id
    obs, snaps = store.read("test_observations").where(mine), store.read("snapshots").where(mine)
    newest = samples.newest_extracted(snaps, obs).first()
    if newest is None:
        raise CommandFailed("No extracted snapshot: run extract first.")
    scope = obs.where(F.col("snapshot_id") == newest.id).withColumn("clone_path", F.lit(repo.clone_path)).withColumn("commit_sha", F.lit(newest.commit_sha))
    facts = attribution.attribute(scope, cutoff or reports.cutoff_default()).cache()
    slices = [r.id for r in snaps.select("id").collect()]  # a few for one repository
    store.rebuild("test_observations", mine, facts, "id", ["introduced_commit_sha", "introduced_author_date", "ai_window"], slices)
    facts.unpersist()
    done = store.read("test_observations").where(F.col("snapshot_id") == newest.id)
    return done.agg(F.count("*").alias("tests"), F.count("ai_window").alias("attributed"), F.count_if(F.col("ai_window") == "pre").alias("pre"), F.count_if(F.col("ai_window") == "post").alias("post"), F.count_if(F.col("ai_window").isNull()).alias("unattributable"))


def verify(store: Store, full_name: str | None = None) -> DataFrame:
    """The gate's rows; CommandFailed with them if any check fails hard or nothing is there to check."""
    repos = store.read("repositories")
    if (repos if full_name is None else repos.where(F.col("full_name") == full_name)).isEmpty():
        raise CommandFailed("No repository to verify.")
    rows = quality.verify(repos, store.read("snapshots"), store.read("test_observations"), store.read("parse_failures"), full_name).cache()
    if not quality.passes(rows):
        raise CommandFailed("; ".join(f"{r.repository}: {r.check}: {r.detail}" for r in rows.where("status = 'FAIL'").collect()))
    return rows


def report(store: Store, metric: str | None = None, cutoff: str | None = None, export: str | None = None) -> dict[str, DataFrame]:
    try:
        blocks = reports.report(store.spark, store.read("test_observations"), store.read("snapshots"), metric, cutoff)
    except ValueError as e:
        raise CommandFailed(str(e)) from e
    if export:
        reports.export(blocks, export)
    return blocks


def corpus(store: Store, path: str) -> list[str]:
    """Names in a corpus list: one a line, blank lines and those that begin with # left out, order kept."""
    whole = store.spark.read.text(path, wholetext=True)
    return [r.name for r in discovery.corpus_names(whole, "value").orderBy("position").collect()]


def batch(store: Store, names: list[str], clone_of: Callable[[str], str]) -> list[dict[str, str]]:
    """All stages for each repository; its first failure skips its rest, and the others go on."""
    if not names:
        raise CommandFailed("The corpus holds no repositories.")
    stages = {"acquire": lambda n: acquire(store, n, clone_of(n)), "snapshot": lambda n: snapshot(store, n), "extract": lambda n: extract(store, n), "blame": lambda n: blame(store, n), "verify": lambda n: verify(store, n)}
    out = []
    for name in names:
        row, broken = {"repository": name}, False
        for stage in STAGES:
            if broken:
                row[stage] = "–"
                continue
            try:
                stages[stage](name)
                row[stage] = "✓"
            except Exception as e:  # noqa: BLE001  one repository's trouble must not end the batch
                print(f"{name}: {stage}: {e}", file=sys.stderr)
                row[stage], broken = "✗", True
        out.append(row)
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="suitescope", description="Mine test suites from local clones.")
    p.add_argument("--store", default="suitescope-data", help="folder of the stored tables")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("acquire", "snapshot", "extract", "blame"):
        c = sub.add_parser(name)
        c.add_argument("full_name")
        if name == "acquire":
            c.add_argument("--path", required=True, help="the local clone")
        if name == "extract":
            c.add_argument("--head", action="store_true")
        if name == "blame":
            c.add_argument("--cutoff")
    c = sub.add_parser("verify")
    c.add_argument("full_name", nargs="?")
    c = sub.add_parser("report")
    for o in ("--metric", "--cutoff", "--export"):
        c.add_argument(o)
    c = sub.add_parser("batch")
    c.add_argument("file")
    c.add_argument("--clones", required=True, help="folder with clones named owner__name")
    a = p.parse_args(argv)
    store = Store(session(), a.store)
    try:
        if a.command == "batch":
            rows = batch(store, corpus(store, a.file), lambda n: f"{a.clones}/{n.replace('/', '__')}")
            for r in rows:
                print("\t".join(r.values()))
            return int(any("✗" in r.values() for r in rows))
        calls = {
            "acquire": lambda: acquire(store, a.full_name, a.path), "snapshot": lambda: snapshot(store, a.full_name), "extract": lambda: extract(store, a.full_name, a.head),
            "blame": lambda: blame(store, a.full_name, a.cutoff), "verify": lambda: verify(store, a.full_name), "report": lambda: report(store, a.metric, a.cutoff, a.export),
        }
        out = calls[a.command]()
        for name, df in (out if isinstance(out, dict) else {a.command: out}).items():
            print(name)
            df.show(1000, truncate=False)
        return 0
    except CommandFailed as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
