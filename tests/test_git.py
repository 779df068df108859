"""Histories made with git and fixed dates; the commands end to end."""

import json
import os
import subprocess

import pytest

from suitescope.operators import discovery
from suitescope.plans import commands as C
from suitescope.sources import git
from suitescope.sources.store import Store


def commit(root, date, files):
    os.makedirs(root, exist_ok=True)
    env = os.environ | {"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date, "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_NOSYSTEM": "1"}
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.c", "-c", "init.defaultBranch=main", "-C", root, *a], env=env, check=True, capture_output=True)
    if not os.path.isdir(f"{root}/.git"):
        run("init")
    for path, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}") or root, exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(text)
    run("add", "-A")
    run("commit", "-m", "x", "--allow-empty")


def manifest(constraint, key="laravel/framework"):
    return json.dumps({"require": {key: constraint}})


def cls(name, *methods):
    body = "\n".join(f"    public function {m}(): void\n    {{\n        $this->assertTrue(true); // {m}\n    }}\n" for m in methods)
    return f"<?php\n\nclass {name} extends TestCase\n{{\n{body}}}\n"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_snapshots_and_extraction(store, tmp_path):
    root = str(tmp_path / "repo")
    commit(root, "2022-01-10T10:00:00+02:00", {"composer.json": manifest("^9.0"), "tests/AlphaTest.php": cls("AlphaTest", "test_a")})
    commit(root, "2022-09-01T00:00:00+00:00", {"tests/BetaTest.php": cls("BetaTest", "test_b")})
    commit(root, "2023-02-20T00:00:00+00:00", {"composer.json": manifest("^10.0"), "tests/Broken.php": "x", "tests/BadTest.php": "<?php class BadTest extends TestCase { function test_x() { $x = ;"})
    commit(root, "2023-06-15T00:00:00+00:00", {"tests/GammaTest.php": cls("GammaTest", "test_c")})
    head = git.head(root)
    C.acquire(store, "o/r", root)
    rows = C.snapshot(store, "o/r").collect()
    assert [r.framework_version for r in rows] == [9, 10]
    assert str(rows[0].commit_date) == "2022-01-10 08:00:00"
    for _ in range(2):  # again changes nothing
        out = C.extract(store, "o/r").collect()
        assert store.read("test_observations").count() == 3
        assert store.read("parse_failures").count() == 1
        assert sum(r.tests for r in out) == 3
    assert store.read("repositories").first().primary_test_framework == "phpunit"
    assert git.head(root) == head
    other = str(tmp_path / "other")
    commit(other, "2022-01-10T00:00:00+00:00", {"composer.json": manifest("^1", "monolog/monolog")})
    C.acquire(store, "o/other", other)
    with pytest.raises(C.CommandFailed):
        C.snapshot(store, "o/other")
    with pytest.raises(C.CommandFailed):
        C.acquire(store, "no-slash", root)


def test_suites_name_their_own_suffix(store, tmp_path):
    config = '<phpunit><testsuites><testsuite><directory suffix=".inc">specs</directory></testsuite></testsuites></phpunit>'
    commit(tmp_path / "clone", "2024-01-01T10:00:00+00:00", {"composer.json": manifest("^10.0"), "phpunit.xml": config, "specs/A.inc": cls("A", "test_a"), "specs/B.php": cls("B", "test_b")})
    C.acquire(store, "o/r", str(tmp_path / "clone"))
    C.snapshot(store, "o/r")
    C.extract(store, "o/r")
    assert {r.file_path for r in store.read("test_observations").collect()} == {"specs/A.inc"}


def test_attribution(store, tmp_path):
    root = str(tmp_path / "repo")
    closure = "<?php\nit('old', function () {\n    expect(1)->toBe(1);\n});\n"
    commit(root, "2021-05-01T00:00:00+00:00", {"composer.json": manifest("^9.0"), "tests/OneTest.php": cls("OneTest", "test_legacy")})
    commit(root, "2023-03-01T00:00:00+00:00", {"tests/OneTest.php": cls("OneTest", "test_legacy", "test_modern"), "tests/TwoTest.php": closure})
    C.acquire(store, "o/r", root)
    C.snapshot(store, "o/r")
    C.extract(store, "o/r")
    C.extract(store, "o/r", head=True)
    done = C.blame(store, "o/r", "2022-11-30").first()
    assert (done.tests, done.attributed, done.pre, done.post) == (3, 3, 1, 2)
    windows = {r.identifier: r.ai_window for r in store.read("test_observations").where("ai_window is not null").collect()}
    assert windows == {"test_legacy": "pre", "test_modern": "post", "old": "post"}
    assert store.read("test_observations").where("ai_window is null").count() == 1  # the boundary snapshot's
    assert C.blame(store, "o/r", "2031-01-01").first().pre == 3
    assert all(r.status != "FAIL" for r in C.verify(store).collect())


def test_batch_goes_on(store, tmp_path):
    for n, m in (("a", "^9"), ("b", "^10")):
        commit(str(tmp_path / f"o__{n}"), "2023-03-01T00:00:00+00:00", {"composer.json": manifest(m), "tests/ATest.php": cls("ATest", "test_a")})
    listed = tmp_path / "list.txt"
    listed.write_text("# corpus\no/a\n\no/missing\n o/b \n")
    names = C.corpus(store, str(listed))
    assert names == ["o/a", "o/missing", "o/b"]
    rows = C.batch(store, names, lambda n: str(tmp_path / n.replace("/", "__")))
    assert ["".join(list(r.values())[1:]) for r in rows] == ["✓✓✓✓✓", "✗––––", "✓✓✓✓✓"]
    with pytest.raises(C.CommandFailed):
        C.batch(store, [], str)


def test_renamed_manifest_keeps_its_log(spark, tmp_path):
    root = str(tmp_path / "repo")
    commit(root, "2021-01-01T00:00:00+00:00", {"old.json": manifest("^8.0")})
    os.rename(f"{root}/old.json", f"{root}/composer.json")
    commit(root, "2021-02-01T00:00:00+00:00", {})
    commit(root, "2021-03-01T00:00:00+00:00", {"composer.json": manifest("^9.0")})
    rows = git.read_log(spark, [("r", root)]).orderBy("seq").collect()
    assert [r.manifest is None for r in rows] == [True, False, False]


def test_trees(spark, tmp_path):
    root = str(tmp_path / "repo")
    commit(root, "2021-01-01T00:00:00+00:00", {"b/é x.php": "1", "a.php": "2", "c.txt": "3"})
    rows = git.read_trees(spark, [("r", root, git.head(root))], (".php",)).collect()
    assert {(r.path, r.content) for r in rows} == {("a.php", "2"), ("b/é x.php", "1")}
    files = git.working_tree(spark, "r", root)
    assert {r.path for r in files.collect()} == {"b/é x.php", "a.php", "c.txt"}


def test_discovery(spark):
    def found(files):
        df = spark.createDataFrame([("r", p, c) for p, c in files.items()], "repo string, path string, content string")
        return sorted(r.path for r in discovery.discover(df, discovery.suites(df, df)).collect())

    xml = lambda d: f"<phpunit><testsuites><testsuite>{d}</testsuite></testsuites></phpunit>"
    names = ["tests/Unit/AlphaTest.php", "tests/Feature/Deep/BetaTest.php", "tests/Unit/Helper.php", "tests/Browser/GammaTest.php", "tests/Unit/SomeTestCase.php"]
    assert found({n: "" for n in names} | {"phpunit.xml": xml("<directory>tests/Unit</directory><directory>./tests/Feature</directory>")}) == [names[1], names[0]]
    assert found({"specs/a.spec.php": "", "tests/ATest.php": "", "phpunit.xml": xml('<directory suffix=".spec.php">specs</directory>'), "phpunit.xml.dist": xml("<directory>tests</directory>")}) == ["specs/a.spec.php"]
    assert found({"tests/Pest.php": "", "tests/Feature/LoginTest.php": "", "src/NotATest.php": ""}) == ["tests/Feature/LoginTest.php"]
    assert found({"tests/Unit/ATest.php": "", "phpunit.xml.dist": xml("<directory>tests/unit</directory>")}) == []
