import pytest

from suitescope.extract import frames as T
from suitescope.extract.facts import read_file
from suitescope.extract.lexer import SyntaxProblem
from suitescope.extract.parser import parse

CLASS_FEATURE = """<?php
namespace Tests\\Library;
class ShelfTest extends TestCase
{
    use RefreshDatabase;

    public function test_shelves_are_listed(): void
    {
        Shelf::factory()->count(3)->create();
        $reply = $this->getJson('/shelves');
        $reply->assertOk();
        $this->assertCount(3, $reply->json());
    }
}
"""
CLOSURE_FEATURE = """<?php
uses(RefreshDatabase::class);
it('lists shelves', function () {
    Shelf::factory()->count(3)->create();
    $reply = $this->getJson('/shelves');
    $reply->assertOk();
    $this->assertCount(3, $reply->json());
});
"""
CLASS_UNIT = """<?php
class ClockTest extends TestCase {
    #[Test]
    public function ticks(): void {
        $this->partialMock(Clock::class)
            ->shouldReceive('now')
            ->andReturn(7);
        $this->assertSame(7, app(Clock::class)->now());
    }
    /** @test */
    public function noted() { if (true) { $a = 1; } else { $b = "{$this->assertX()}"; } }
    private function helper() { $this->get('/'); }
}
"""


def only(source, front_end):
    found, problem = read_file(source, front_end)
    assert problem is None
    return found


def test_twins_agree():
    a, b = only(CLASS_FEATURE, "phpunit")[0], only(CLOSURE_FEATURE, "pest")[0]
    for k in ("assertion_count", "mocks", "size_statements", "setup_signals", "has_http", "has_factory", "has_db_assert", "traits"):
        assert a[k] == b[k]
    assert (a["assertion_count"], a["size_statements"], a["setup_signals"]) == (2, 4, {"create": 1, "factory": 1})
    assert (a["start_line"], a["end_line"], b["start_line"], b["end_line"]) == (7, 13, 3, 8)
    assert list(a["setup_signals"]) == ["create", "factory"]


def test_marks_mocks_and_statements():
    ticks, noted = only(CLASS_UNIT, "phpunit")
    assert (ticks["identifier"], ticks["start_line"], ticks["end_line"]) == ("ticks", 3, 9)
    assert ticks["mocks"] == [{"kind": "container", "target": "Clock", "chain_depth": 3}]
    assert (ticks["assertion_count"], ticks["size_statements"]) == (1, 2)
    assert (noted["assertion_count"], noted["size_statements"]) == (1, 4)


@pytest.mark.parametrize(("body", "kinds"), [
    ("Http::fake(); Queue::fake([A::class]); Other::fake();", ["facade_fake", "facade_fake"]),
    ("$m = Mockery::mock(A::class); Mockery::close();", ["mockery"]),
    ("$this->createMock(A::class); $this->getMockBuilder(B::class)->getMock(); $that->mock(C::class);", ["phpunit_native", "phpunit_native"]),
])
def test_mock_kinds(body, kinds):
    assert [m["kind"] for m in only(f"<?php it('x', function () {{ {body} }});", "pest")[0]["mocks"]] == kinds


def test_closure_details():
    found = only("<?php describe('a', function () { test(fn () => expect(1)->toBe(1)); it('b', function () { /* only a comment */ })->skip(); }); it('todo');", "pest")
    assert [(f["identifier"], f["assertion_count"], f["size_statements"]) for f in found] == [("(anonymous)", 0, 0), ("b", 0, 1)]


def test_receiver_must_be_this():
    found = only("<?php it('x', function () { $this->actingAs($u)->get('/'); $this?->get('/'); });", "pest")[0]
    assert not found["has_http"]


@pytest.mark.parametrize("source", [
    "<?php class A extends TestCase { function test_a() { $x = ; ", "<?php function (", "<?php $a = 'open", "<?php if (1) { ", "<?php foo(]", "<?php class { }", "<?php $a = <<<X\nabc", "<?php 1 = 2;",
])
def test_broken(source):
    with pytest.raises(SyntaxProblem):
        parse(source)


@pytest.mark.parametrize("source", [
    "plain text", "<?php\n", "<?= $a ?> html <?php foreach ($a as $k => [$b, 'c' => $d]): ?>x<?php endforeach ?>", "<?php $x = match(true) { $a, $b => 1, default => throw new E(), };",
    "<?php enum S: string implements I { use T; case A = 'a'; const B = self::A; public static function f(): static { return static::A; } }",
    "<?php abstract class A { public function __construct(private readonly ?int $a = 1, protected A|B|null $b = null, int ...$c) {} abstract function f(A&B $x): (A&B)|null; }",
    "<?php $f = static fn(int $x): int => $x ** 2 ** $y; $g = strlen(...); $o?->a?->b()::C; $h = $this->{$n}(named: 1, ...$rest); new class(1) extends B { };",
    "<?php $t = <<<\"EOT\"\n  {$a->b()['c']} $x[0] $y->z ${v}\n  EOT; $n = <<<'N'\n $raw\nN;", "<?php switch ($a) { case 1: case 2; break; default: echo 1, 2; } do { $i++; } while ($i < 3); for (;;) { break 2; }",
    "<?php namespace A; use B\\{C, D as E}; use function F\\g; const X = 1; declare(strict_types=1); goto end; end: return;", "<?php try { f(); } catch (A | B $e) { } finally { } static $s = 1; global $g; unset($a, $b);",
    "<?php function &g() { yield; $x = yield $k => $v; yield from h(); } $a = $b ?: $c ?? $d; [$a, [, $b]] = $c; $a = &$b; list('x' => $y) = $z; $a = (int) $b . -$c; !$x = 1; clone $a; print $b; @$c[1]{0} ?? 1;".replace("{0}", ""),
])
def test_valid(source):
    parse(source)


def test_frames(spark):
    files = spark.createDataFrame([("a", CLASS_FEATURE), ("b", CLOSURE_FEATURE), ("c", CLASS_UNIT), ("d", "<?php class XTest extends TestCase { function test_a() { $x = ; "), ("e", "no php"), ("f", None), ("g", "<?php\nit('x', function () { $this->assertDatabaseHas('t'); });")], "path string, content string")
    read = T.read(files).cache()
    assert {r.path: r.status for r in read.collect()} == {"a": "parsed", "b": "parsed", "c": "parsed", "d": "failed", "e": "unroutable", "f": "missing", "g": "parsed"}
    found = {(r.file_path, r.identifier): r for r in T.observations(read, []).collect()}
    kinds = {k: (r.test_type, r.test_type_rule) for k, r in found.items()}
    assert kinds["a", "test_shelves_are_listed"] == ("feature", "R1_http_call")
    assert kinds["b", "lists shelves"] == ("feature", "R1_http_call")
    assert kinds["c", "ticks"] == ("unit", "R4_phpunit_testcase_no_io")
    assert kinds["g", "x"] == ("integration", "R2_db_interaction")
    ticks = found["c", "ticks"]
    assert (ticks.mock_breadth, ticks.max_mock_chain_depth, ticks.mock_kinds, ticks.uses_refresh_database, ticks.setup_signals) == (1, 3, ["container"], False, {})
    assert found["a", "test_shelves_are_listed"].uses_refresh_database
    failed = T.failures(read, []).collect()
    assert [r.file_path for r in failed] == ["d"] and failed[0].message
    total = T.summary(read.withColumn("k", read.path.isNotNull()), ["k"]).first()
    assert (total.files, total.tests, total.unroutable, total.failures) == (6, 5, 1, 1)
