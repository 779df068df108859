"""The report, the gate's passing case, the store and the stream."""

import pytest
from pyspark.sql import functions as F

from suitescope.operators import quality, samples
from suitescope.plans import catalogue, commands, report
from suitescope.sources.store import Store, filled
from suitescope.streaming.commits import follow


def test_report_blocks_and_export(spark, tmp_path):
    blocks = catalogue._report(spark)
    assert list(blocks) == ["provenance", "descriptives", "regression", "types_by_version", "ai_comparison", "types_by_window"]
    assert blocks["provenance"].first().ai_cutoff == "2022-11-30"
    assert [r.ai_window for r in blocks["types_by_window"].collect()] == ["pre", "post"]
    paths = report.export(blocks, str(tmp_path / "out.CSV"))
    assert sorted(p.rsplit("/", 1)[1] for p in paths) == sorted(f"out_{b}.csv" for b in blocks)
    for p in paths:
        lines = open(p).read().splitlines()
        assert len({line.count(",") for line in lines}) == 1 and len(lines) > 1
    assert report.export({"x": blocks["provenance"]}, str(tmp_path / "none" / "out")) == []


def test_refused_comparison_keeps_descriptives(spark):
    blocks = catalogue._report(spark, "2031-01-01")
    assert "ai_comparison" not in blocks and "descriptives" in blocks
    r = blocks["comparison_refused"].first()
    assert (r.n_pre, r.n_post) == (10, 0)


def test_empty_report_and_metrics(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert list(commands.report(store)) == ["provenance"]
    with pytest.raises(commands.CommandFailed):
        commands.report(store, metric="nonsense")
    with pytest.raises(commands.CommandFailed):
        commands.verify(store)


def test_cutoff_is_half_open(spark):
    df = spark.createDataFrame([("2022-11-29T23:59:59",), ("2022-11-30T00:00:00",), (None,)], "d string").withColumn("d", F.to_timestamp("d"))
    assert [r[0] for r in df.select(samples.window_of(F.col("d"), "2022-11-30")).collect()] == ["pre", "post", None]


def test_gate_passes(spark):
    repos, snaps, obs, fails = catalogue._seed(spark)
    rows = quality.verify(repos.where("id = 1"), snaps.where("repository_id = 1"), obs.where("id in (1, 2)"), fails.where("repository_id = 0"))
    assert {r.status for r in rows.collect()} == {"ok"} and quality.passes(rows)
    assert not quality.passes(catalogue.verify_gate(spark, ""))


def test_authored_sample_takes_the_lowest_major(spark):
    obs = spark.createDataFrame([(1, 1, 1, "f", "t", "pest", "2021-01-01"), (2, 2, 1, "f", "t", "pest", "2021-01-01"), (3, 3, 1, "f", "t", "pest", "2021-01-01"), (4, 3, 1, "f", "u", "pest", None)], "id long, snapshot_id long, repository_id long, file_path string, identifier string, front_end string, introduced_author_date string")
    snaps = spark.createDataFrame([(1, 10), (2, 9), (3, None)], "id long, framework_version int")
    assert [r.id for r in samples.authored_sample(obs, snaps).collect()] == [2]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame(list(r), "id long, snapshot_id long, repository_id long, identifier string")
    assert store.read("test_observations").count() == 0
    store.replace("test_observations", rows((1, 1, 1, "a"), (2, 1, 1, "b"), (3, 2, 1, "c")), "snapshot_id", [1, 2])
    store.replace("test_observations", rows((9, 1, 1, "z")).where("false"), "snapshot_id", [1])
    assert [r.id for r in store.read("test_observations").collect()] == [3]
    store.upsert("test_observations", rows((3, 2, 1, "d"), (4, 2, 1, "e")), ["id"])
    assert {(r.id, r.identifier) for r in store.read("test_observations").collect()} == {(3, "d"), (4, "e")}
    facts = spark.createDataFrame([(4, "pre")], "id long, ai_window string")
    store.rebuild("test_observations", F.col("repository_id") == 1, facts, "id", ["ai_window"])
    assert {(r.id, r.ai_window) for r in store.read("test_observations").collect()} == {(3, None), (4, "pre")}
    assert filled(rows((1, 1, 1, "a")), "test_observations").schema == store.read("test_observations").schema


def test_stream_replaces_snapshots(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "s")), str(tmp_path / "in")
    source = "<?php\nit('x', function () { expect(1)->toBe(1); });\n"
    files = spark.createDataFrame([(1, 7, "c", "tests/A.php", source), (1, 7, "c", "tests/B.php", "<?php\nit('x', function () { $x = ;")], "repository_id long, snapshot_id long, commit_sha string, path string, content string")
    for _ in range(2):
        files.write.mode("append").parquet(folder)
        follow(spark, folder, store, str(tmp_path / "state")).awaitTermination()
        assert (store.read("test_observations").count(), store.read("parse_failures").count()) == (1, 1)


def test_stream_over_several_batches(spark, tmp_path):
    """A snapshot's files may come one after another; each replaces only its own rows, and ids stay apart."""
    store, folder = Store(spark, str(tmp_path / "s")), str(tmp_path / "in")
    one = "<?php\nit('x', function () { expect(1)->toBe(1); }); it('x', function () { expect(2)->toBe(2); });\n"
    for path, source in (("tests/A.php", one), ("tests/B.php", one), ("tests/A.php", "<?php\nit('y', function () {});\n")):
        spark.createDataFrame([(1, 7, "c", path, source)], "repository_id long, snapshot_id long, commit_sha string, path string, content string").write.mode("append").parquet(folder)
        follow(spark, folder, store, str(tmp_path / "state")).awaitTermination()
    rows = store.read("test_observations").collect()
    assert sorted((r.file_path, r.identifier) for r in rows) == [("tests/A.php", "y"), ("tests/B.php", "x"), ("tests/B.php", "x")]
    assert len({r.id for r in rows}) == 3


def test_store_survives_a_crash(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame(list(r), "id long, identifier string")
    store.append("test_observations", rows((1, "a")))
    whole = Store._point

    def crash(*_):
        raise RuntimeError("the driver ends here")

    monkeypatch.setattr(Store, "_point", crash)
    with pytest.raises(RuntimeError):
        store.append("test_observations", rows((2, "b")))
    assert [r.id for r in store.read("test_observations").collect()] == [1]
    monkeypatch.setattr(Store, "_point", whole)
    store.append("test_observations", rows((3, "c")))
    assert sorted(r.id for r in store.read("test_observations").collect()) == [1, 3]
    assert len([p for p in (tmp_path / "s" / "test_observations").iterdir() if p.name.startswith("v-")]) == 1  # the lost version is gone


def test_writes_touch_only_their_slices(spark, tmp_path):
    store, at = Store(spark, str(tmp_path / "s")), tmp_path / "s" / "test_observations"
    rows = lambda *r: spark.createDataFrame(list(r), "id long, snapshot_id long, repository_id long, identifier string")
    files = lambda n: {str(p): p.stat().st_mtime_ns for p in at.rglob("*.parquet") if f"slice={n}" in str(p)}
    store.append("test_observations", rows((1, 1, 1, "a"), (2, 2, 1, "b"), (3, None, 1, "n")))
    before = files(2) | files("none")
    assert len(before) == 2
    store.replace("test_observations", rows((4, 1, 1, "c")), "snapshot_id", [1])
    store.append("test_observations", rows((5, 1, 1, "d")))
    store.rebuild("test_observations", F.col("repository_id") == 1, spark.createDataFrame([(4, "post")], "id long, ai_window string"), "id", ["ai_window"], [1])
    assert files(2) | files("none") == before
    assert sorted((r.id, r.snapshot_id, r.ai_window) for r in store.read("test_observations").collect()) == sorted([(4, 1, "post"), (5, 1, None), (2, 2, None), (3, None, None)], key=lambda r: r[0])
    assert {r.id for r in store.read("test_observations", [1]).collect()} == {4, 5}
    store.replace("test_observations", rows((9, 1, 1, "z")).where("false"), "snapshot_id", [1])
    assert not files(1) and store.read("test_observations").count() == 2
