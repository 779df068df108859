"""The data-quality gate: one row for each repository and check, with status ok, warn or FAIL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .samples import newest_extracted


def orphan_counts(repositories: DataFrame, snapshots: DataFrame, observations: DataFrame, failures: DataFrame) -> DataFrame:
    """(check, n): rows that point at nothing, and observations whose snapshot is another repository's."""

    def lost(name: str, child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
        gone = child.select(F.col(key).alias("id")).join(parent.select("id"), "id", "left_anti")
        return gone.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")

    s = snapshots.select(F.col("id").alias("sid"), F.col("repository_id").alias("srepo"))
    crossed = observations.join(s, (F.col("snapshot_id") == F.col("sid")) & (F.col("srepo") != F.col("repository_id")))
    parts = [
        lost("observation_snapshot", observations, "snapshot_id", snapshots),
        lost("observation_repository", observations, "repository_id", repositories),
        lost("snapshot_repository", snapshots, "repository_id", repositories),
        lost("failure_snapshot", failures, "snapshot_id", snapshots),
        crossed.agg(F.count("*").alias("n")).select(F.lit("crossed_repository").alias("check"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dates_out_of_order(snapshots: DataFrame, keys: list[str], order: str, date: str) -> DataFrame:
    """(keys, n_dated, broken): whether a dated row has an earlier date than the one before it."""
    w = Window.partitionBy(*keys).orderBy(order, date)
    dated = snapshots.where(F.col(date).isNotNull()).withColumn("_before", F.lag(date).over(w))
    return dated.groupBy(*keys).agg(F.count("*").alias("n_dated"), F.coalesce(F.bool_or(F.col("_before") > F.col(date)), F.lit(False)).alias("broken"))


def verify(repositories: DataFrame, snapshots: DataFrame, observations: DataFrame, failures: DataFrame, full_name: str | None = None) -> DataFrame:
    """(repository, seq, check, status, detail), in order of repository and seq; orphans are counted over all repositories."""
    orphans = orphan_counts(repositories, snapshots, observations, failures).agg(F.sum("n").alias("n"))
    rows = orphans.select(F.lit("—").alias("repository"), F.lit(0).alias("seq"), F.lit("orphan rows").alias("check"), F.when(F.col("n") == 0, "ok").otherwise("FAIL").alias("status"), F.when(F.col("n") == 0, "none").otherwise(F.concat(F.col("n").cast("string"), F.lit(" orphan row(s)"))).alias("detail"))
    repos = repositories.select(F.col("id").alias("repository_id"), F.col("full_name").alias("repository"))
    if full_name is not None:
        repos = repos.where(F.col("repository") == full_name)
    bounds = snapshots.where("kind = 'version_boundary'")
    counts = observations.groupBy("snapshot_id").agg(F.count("*").alias("n_obs"))
    b = bounds.join(counts, bounds["id"] == counts["snapshot_id"], "left")
    majors = b.groupBy("repository_id").agg(
        F.count("*").alias("n_snaps"), (F.countDistinct("framework_version") + F.max(F.col("framework_version").isNull().cast("int"))).alias("n_majors"),
        F.array_sort(F.collect_list("framework_version")).alias("majors"),
        F.array_sort(F.collect_list(F.when(F.col("n_obs").isNull(), F.col("framework_version")))).alias("bare"),
    )
    dates = dates_out_of_order(bounds, ["repository_id"], "framework_version", "commit_date")
    total = observations.groupBy("repository_id").agg(F.count("*").alias("total"))
    failed = failures.groupBy("repository_id").agg(F.count("*").alias("failed"))
    newest = newest_extracted(snapshots, observations).select(F.col("id").alias("snapshot_id"))
    scope = observations.join(newest, "snapshot_id").groupBy("repository_id").agg(F.count("*").alias("scope"), F.count("ai_window").alias("attributed"))
    r = repos
    for part in (majors, dates, total, failed, scope):
        r = r.join(part, "repository_id", "left")
    r = r.fillna(0, ["n_snaps", "n_majors", "total", "failed", "scope", "attributed", "n_dated"]).withColumn("broken", F.coalesce("broken", F.lit(False)))
    share = lambda a, b: F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0))
    listed = lambda c, sep: F.array_join(F.transform(c, lambda x: x.cast("string")), sep)
    ascending = (F.col("n_snaps") > 0) & (F.col("n_snaps") == F.col("n_majors"))
    unattributed = F.col("scope") - F.col("attributed")
    parsed = F.col("failed") + F.col("total")

    def check(seq: int, name: str, status, detail) -> object:
        return F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("check"), status.alias("status"), detail.alias("detail"))

    hard = lambda ok: F.when(ok, "ok").otherwise("FAIL")
    checks = F.array(
        check(1, "majors strictly ascending", hard(ascending), F.when(F.col("n_snaps") == 0, "no version-boundary snapshots").otherwise(listed("majors", " → "))),
        check(2, "no duplicate (repository, major)", hard(F.col("n_snaps") == F.col("n_majors")), F.when(F.col("n_snaps") == F.col("n_majors"), "none").otherwise(F.format_string("%d duplicate(s)", F.col("n_snaps") - F.col("n_majors")))),
        check(3, "observations present", hard(F.col("total") > 0), F.format_string("%d rows", F.col("total"))),
        F.when(F.size("bare") > 0, check(4, "empty snapshots", F.lit("warn"), F.format_string("majors %s have 0 observations", listed("bare", ", ")))),
        F.when((F.col("n_dated") > 1) & F.col("broken"), check(5, "snapshot dates monotonic", F.lit("warn"), F.lit("representative dates are not in major order"))),
        F.when(F.col("attributed") == 0, check(6, "instrument B coverage", F.lit("warn"), F.lit("blame has not run — ai_window is empty"))).otherwise(
            check(6, "instrument B coverage", F.lit("ok"), F.format_string("%.1f%% unattributed (%d of %d, newest snapshot)", share(unattributed, F.col("scope")), unattributed, F.col("scope")))),
        check(7, "parse-failure rate", F.lit("ok"), F.format_string("%.2f%% (%d failures / %d parsed+failed)", share(F.col("failed"), parsed), F.col("failed"), parsed)),
    )
    per = r.select("repository", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("c")).select("repository", "c.*")
    return rows.unionByName(per).orderBy("repository", "seq")


def passes(rows: DataFrame) -> bool:
    return rows.where("status = 'FAIL'").isEmpty()
