"""Queries over the retail, event and text tables, each showing operators, with their SQL.

Observations are line items, snapshots orders, majors years of order, repositories customers;
windows split events by time.  Inline rows stand in where the tables have nothing alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import erf_sql
from ..operators import discovery, extraction, quality, samples, statistics, versioning
from . import report as reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CUTOFF, SHIP_CUTOFF = "2024-01-16", "1998-06-01"
METRICS = ("l_quantity", "l_extendedprice", "l_tax")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def lines_with_major(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("major"), "o_orderstatus")
    return t(spark, d, "lineitem").join(orders, "l_orderkey")


_LONG = " UNION ALL ".join(f"SELECT CAST(year(o_orderdate) AS INT) AS major, '{m}' AS metric, {m} AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey" for m in METRICS)


@query(f"""
WITH long AS ({_LONG}), r AS (
  SELECT *, row_number() OVER (PARTITION BY major, metric ORDER BY value) AS rn, count(*) OVER (PARTITION BY major, metric) AS n FROM long)
SELECT major, metric, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
  round(coalesce(stddev_samp(value), 0), 6) AS sd,
  round(coalesce(median(value) FILTER (rn > n - n // 2) - median(value) FILTER (rn <= n // 2), 0), 6) AS iqr
FROM r GROUP BY major, metric""")
def descriptives_by_major(spark, d):
    return rounded(statistics.descriptives(lines_with_major(spark, d), ["major"], METRICS))


@query(f"""
WITH long AS ({_LONG})
SELECT metric, round(CASE WHEN var_pop(major) = 0 THEN 0 ELSE regr_slope(value, major) END, 3) + 0.0::DOUBLE AS slope,
  round(CASE WHEN var_pop(major) = 0 THEN avg(value) ELSE regr_intercept(value, major) END, 3) + 0.0::DOUBLE AS intercept,
  round(CASE WHEN var_pop(major) = 0 THEN 0 WHEN var_pop(value) = 0 THEN 1 ELSE regr_r2(value, major) END, 3) + 0.0::DOUBLE AS r2,
  count(*) AS n, count(DISTINCT major) AS n_x
FROM long GROUP BY metric HAVING count(DISTINCT major) > 1""")
def trend_by_major(spark, d):
    return rounded(statistics.regression(lines_with_major(spark, d), "major", METRICS).where("n_x > 1"), 3)


_RANKS = f"""
WITH e AS (SELECT event_type, value, CAST(ts >= TIMESTAMP '{CUTOFF}' AS INT) AS post FROM events WHERE value IS NOT NULL),
h AS (SELECT event_type, value, CAST(sum(1 - post) AS DOUBLE) AS a, CAST(sum(post) AS DOUBLE) AS b FROM e GROUP BY 1, 2),
c AS (SELECT *, a + b AS t, sum(a + b) OVER (PARTITION BY event_type ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto FROM h),
s AS (SELECT event_type, sum(a) AS n1, sum(b) AS n2, sum(a * (upto - t + (t + 1) / 2)) AS r1, sum(t * t * t - t) AS ties FROM c GROUP BY 1),
m AS (SELECT event_type, median(value) FILTER (post = 0) AS median_pre, median(value) FILTER (post = 1) AS median_post FROM e GROUP BY 1),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1 FROM s),
v AS (SELECT *, least(u1, n1 * n2 - u1) AS u, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sigma FROM u),
z AS (SELECT *, CASE WHEN sigma > 0 THEN (u - n1 * n2 / 2) / sigma ELSE 0 END AS z, 2 * u1 / (n1 * n2) - 1 AS delta FROM v)
SELECT event_type, 'value' AS metric, CAST(n1 AS BIGINT) AS n_pre, CAST(n2 AS BIGINT) AS n_post, round(median_pre, 6) AS median_pre, round(median_post, 6) AS median_post,
  round(u, 6) AS u, round(z, 6) AS z, round(greatest(least(2 * (1 - 0.5 * (1 + {erf_sql('abs(z) / sqrt(2.0::DOUBLE)')})), 1), 0), 6) AS p,
  round(delta, 6) AS cliffs_delta, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude,
  n1 < 5 OR n2 < 5 AS refused
FROM z JOIN m USING (event_type)"""


@query(_RANKS)
def mannwhitney_cliffs(spark, d):
    e = t(spark, d, "events")
    return rounded(statistics.rank_tests(e, F.col("ts") >= F.lit(CUTOFF).cast("timestamp"), ["value"], ["event_type"], floor=5))


@query("""
WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (quality = toxic) AS DOUBLE) AS same FROM labels),
a AS (SELECT quality AS l, CAST(count(*) AS DOUBLE) AS x FROM labels GROUP BY 1), b AS (SELECT toxic AS l, CAST(count(*) AS DOUBLE) AS y FROM labels GROUP BY 1),
e AS (SELECT sum(x * y) AS chance FROM a JOIN b USING (l)),
k AS (SELECT n, same / n AS po, coalesce(chance, 0) / (n * n) AS pe FROM n, e)
SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS observed, round(pe, 6) AS expected, round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa,
  CASE WHEN (po - pe) / (1 - pe) < 0 THEN 'poor' WHEN (po - pe) / (1 - pe) <= 0.2 THEN 'slight' ELSE 'fair' END AS band
FROM k""")
def kappa_labels(spark, d):
    return rounded(statistics.agreement(t(spark, d, "labels"), "quality", "toxic"))


_FLAGS = ("A", "R", "X")


@query("""
SELECT CAST(year(o_orderdate) AS INT) AS major, count(*) AS n,
""" + ", ".join(f"round(count(*) FILTER (l_returnflag = '{f}') * 100.0::DOUBLE / count(*), 6) AS \"{f}\"" for f in _FLAGS) + """
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def type_dist_by_version(spark, d):
    return rounded(statistics.distribution(lines_with_major(spark, d), "major", "l_returnflag", _FLAGS))


_TYPES = ("view", "click", "purchase", "signup")


@query(f"""
SELECT CASE WHEN ts < TIMESTAMP '{CUTOFF}' THEN 'pre' ELSE 'post' END AS ai_window, count(*) AS n,
""" + ", ".join(f"round(count(*) FILTER (event_type = '{f}') * 100.0::DOUBLE / count(*), 6) AS \"{f}\"" for f in _TYPES) + """
FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def type_dist_by_window(spark, d):
    e = t(spark, d, "events").withColumn("ai_window", samples.window_of(F.col("ts"), CUTOFF)).where("ai_window is not null")
    return rounded(statistics.distribution(e, "ai_window", "event_type", _TYPES)).orderBy(F.desc("ai_window"))


@query("""
SELECT user_id % 10 AS user_group, """ + ", ".join(f"count(*) FILTER (event_type = '{f}') AS \"{f}\"" for f in _TYPES) + """, count(*) AS total
FROM events GROUP BY 1""")
def crosstab_total(spark, d):
    return statistics.crosstab(t(spark, d, "events").withColumn("user_group", F.col("user_id") % 10), "user_group", "event_type", _TYPES)


@query("""
SELECT user_id, event_type, event_id, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts ASC NULLS LAST, event_id) AS rn FROM events) WHERE rn = 1""")
def first_per_authored_key(spark, d):
    return samples.first_per(t(spark, d, "events"), ["user_id", "event_type"], F.col("ts").asc_nulls_last(), F.col("event_id").asc()).select("user_id", "event_type", "event_id", "ts", "value")


@query("""
SELECT repository_id, id, kind, framework_version FROM (
  SELECT o_custkey AS repository_id, o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'head' ELSE 'version_boundary' END AS kind, CAST(year(o_orderdate) AS INT) AS framework_version,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, year(o_orderdate) DESC NULLS LAST, o_orderkey) AS rn
  FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) WHERE rn = 1""")
def newest_snapshot_per_repo(spark, d):
    s = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repository_id"), F.when(F.col("o_orderstatus") == "O", "head").otherwise("version_boundary").alias("kind"), F.year("o_orderdate").alias("framework_version"))
    return samples.newest_extracted(s, t(spark, d, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"))).select("repository_id", "id", "kind", "framework_version")


@query("""
SELECT o_custkey AS repo, CAST(year(o_orderdate) AS INT) AS major, max_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS sha
FROM orders GROUP BY 1, 2""")
def representative_per_major(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.year("o_orderdate").alias("major"), F.struct("o_orderdate", "o_orderkey").alias("seq"), "o_orderkey")
    return samples.last_per(o, ["repo", "major"], F.struct(F.col("o_orderkey").alias("sha")), "seq")


@query("""
SELECT 'observation_snapshot' AS "check", count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'observation_repository', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = l_suppkey)
UNION ALL SELECT 'snapshot_repository', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'failure_snapshot', count(*) FROM events WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = event_id * 3)
UNION ALL SELECT 'crossed_repository', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_custkey <> l_suppkey""")
def orphan_checks(spark, d):
    obs = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_suppkey").alias("repository_id"))
    snaps = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repository_id"))
    fails = t(spark, d, "events").select((F.col("event_id") * 3).alias("snapshot_id"))
    return quality.orphan_counts(t(spark, d, "customer").select(F.col("c_custkey").alias("id")), snaps, obs, fails)


@query("""
WITH w AS (SELECT o_custkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderdate) AS before FROM orders WHERE o_orderdate IS NOT NULL)
SELECT o_custkey, count(*) AS n_dated, coalesce(bool_or(before > o_orderdate), false) AS broken FROM w GROUP BY 1""")
def date_monotonic(spark, d):
    return quality.dates_out_of_order(t(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderdate")


@query("SELECT o_custkey, count(*) AS n_empty FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1")
def empty_snapshots(spark, d):
    items = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, d, "orders").join(items, "o_orderkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("n_empty"))


@query("SELECT o_custkey, count(*) - count(DISTINCT year(o_orderdate)) AS duplicates, count(*) = count(DISTINCT year(o_orderdate)) AS ascending FROM orders GROUP BY 1")
def dup_majors(spark, d):
    n, k = F.count("*"), F.count_distinct(F.year("o_orderdate"))
    return t(spark, d, "orders").groupBy("o_custkey").agg((n - k).alias("duplicates"), (n == k).alias("ascending"))


@query("""
SELECT source, count(*) AS total, count(quality) AS attributed, round(CASE WHEN count(*) > 0 THEN (count(*) - count(quality)) * 100.0::DOUBLE / count(*) ELSE 0 END, 6) AS unattributed_percent,
  count(*) FILTER (toxic = 1) AS failures, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (toxic = 1) * 100.0::DOUBLE / (count(*) FILTER (toxic = 1) + count(*)) ELSE 0 END, 6) AS failure_percent
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def coverage_and_failure_rate(spark, d):
    j = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels"), "doc_id", "left")
    g = j.groupBy("source").agg(F.count("*").alias("total"), F.count("quality").alias("attributed"), F.count_if(F.col("toxic") == 1).alias("failures"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0)), 6)
    return g.select("source", "total", "attributed", share(F.col("total") - F.col("attributed"), F.col("total")).alias("unattributed_percent"), "failures", share(F.col("failures"), F.col("failures") + F.col("total")).alias("failure_percent"))


# Version constraints and the majors they name.
CONSTRAINTS = (
    ("^11.0", 11), ("^13.17", 13), ("~5.8", 5), ("~5.8.0", 5), ("5.8.*", 5), ("4.2.*", 4), (">=9 <11", 9), ("<11 >=9", 9), ("^10|^11", 10),
    ("^8.0 || ^9.0", 8), ("v10.0.1", 10), ("10.x-dev", 10), ("dev-master", None), ("*", None), ("", None), (None, None),
)
_sql = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
_values = lambda rows: ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)


@query(f"SELECT * FROM (VALUES {_values((i, c, m) for i, (c, m) in enumerate(CONSTRAINTS))}) AS v(id, version_constraint, major)")
def resolve_constraint(spark, d):
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CONSTRAINTS)], "id int, version_constraint string")
    return rows.withColumn("major", versioning.major_of(F.col("version_constraint")))


# Manifests and the majors they name.
MANIFESTS = (
    ('{"require":{"laravel/framework":"^12.0","illuminate/support":"^11.0"}}', 12), ('{"require":{"illuminate/support":"~5.4"}}', 5),
    ('{"require":{"monolog/monolog":"^3"}}', None), ("{}", None), ('{"require":[]}', None), ('{"require":{"laravel/framework":9,"illuminate/support":"^8"}}', None), ("no json", None), (None, None),
)


@query(f"SELECT * FROM (VALUES {_values((i, m) for i, (_, m) in enumerate(MANIFESTS))}) AS v(id, major)")
def resolve_manifest(spark, d):
    rows = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(MANIFESTS)], "id int, manifest string")
    return rows.select("id", versioning.major_of(versioning.constraint_of(F.col("manifest"))).alias("major"))


@query("SELECT page_id, url FROM pages WHERE (url LIKE 'http://%' AND url LIKE '%#top') OR (url LIKE 'https://%' AND url LIKE '%ref=x')")
def suite_path_filter(spark, d):
    files = t(spark, d, "pages").select(F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd").alias("repo"), F.regexp_replace("url", r"^(https?):/", "$1:").alias("path"), "page_id", "url")
    suites = spark.createDataFrame([(r, d, s) for r in ("even", "odd") for d, s in (("http:", "#top"), ("http:", "#top"), ("https:", "ref=x"))], "repo string, dir string, suffix string")
    return discovery.discover(files, suites).select("page_id", "url")


XML = (
    ("a", "phpunit.xml", '<phpunit><testsuites><testsuite name="u"><directory>./tests/Unit</directory><directory suffix=".spec.php">specs\\x/</directory></testsuite></testsuites></phpunit>'),
    ("a", "phpunit.xml.dist", "<phpunit><testsuites><testsuite><directory>other</directory></testsuite></testsuites></phpunit>"),
    ("b", "phpunit.xml", "<phpunit><broken"), ("b", "phpunit.xml.dist", "<phpunit><testsuites><testsuite><directory>../t</directory></testsuite></testsuites></phpunit>"),
    ("c", "readme", "text"),
)


@query("SELECT * FROM (VALUES ('a', 'tests/Unit', 'Test.php'), ('a', 'specs/x', '.spec.php'), ('b', 't', 'Test.php'), ('c', 'tests', 'Test.php')) AS v(repo, dir, suffix)")
def suite_directories(spark, d):
    files = spark.createDataFrame(list(XML), "repo string, path string, content string")
    return discovery.suites(files, files)


@query(r"""
SELECT item_id, CASE WHEN regexp_matches(s, '(?m)^\s*(it|test)\s*\(') AND NOT regexp_matches(s, '(?m)^\s*class\s+') THEN 'pest'
  WHEN regexp_matches(s, 'class\s+\w+\s+extends\s+\w*TestCase') THEN 'phpunit' END AS front_end
FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'it(''' || text || ''')' WHEN 1 THEN 'class A extends BaseTestCase {' || text WHEN 2 THEN '  class B' || chr(10) || 'test (1)' || text ELSE text END AS s FROM benchmark)""")
def route_by_content(spark, d):
    text = F.col("text")
    source = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("it('"), text, F.lit("')"))).when(F.col("item_id") % 4 == 1, F.concat(F.lit("class A extends BaseTestCase {"), text)).when(F.col("item_id") % 4 == 2, F.concat(F.lit("  class B\ntest (1)"), text)).otherwise(text)
    return t(spark, d, "benchmark").select("item_id", extraction.front_end(source).alias("front_end"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS k_total, CAST(max(CAST(props ->> '$.k' AS INT)) AS INT) AS k_max FROM events GROUP BY 1")
def json_signals(spark, d):
    k = F.from_json("props", "map<string,int>")["k"]
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k.cast("long")).alias("k_total"), F.max(k).alias("k_max"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\b(?:the|and)\w*')) AS BIGINT) AS calls FROM documents")
def call_name_counts(spark, d):
    return t(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\b(?:the|and)\w*")).cast("long").alias("calls"))


@query("""SELECT user_id, CASE WHEN count(DISTINCT event_type) >= 2 THEN 'mixed' ELSE min(event_type) END AS primary_test_framework
FROM events GROUP BY 1""")
def primary_framework(spark, d):
    return extraction.primary_framework(t(spark, d, "events"), "user_id", "event_type")


@query("""SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1""")
def upsert_latest(spark, d):
    """Two batches written by key, the later one winning."""
    from ..sources.store import merged

    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    half = F.col("o_orderkey") % 2 == 0
    latest = lambda df: samples.last_per(df, ["o_custkey"], F.struct("o_orderkey", "o_orderdate"), "k")
    keyed = o.withColumn("k", F.struct("o_orderdate", "o_orderkey"))
    both = merged(latest(keyed.where(half)), latest(keyed.where(~half)), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"))
    return both.select("o_custkey", "o_orderkey")


@query(f"""
SELECT l_returnflag AS test_type, CASE WHEN l_shipdate < TIMESTAMP '{SHIP_CUTOFF}' THEN 'pre' ELSE 'post' END AS ai_window, count(*) AS n, round(sum(l_quantity), 6) AS quantity
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2""")
def window_counters(spark, d):
    l = t(spark, d, "lineitem").where("l_shipdate is not null").withColumn("ai_window", samples.window_of(F.col("l_shipdate"), SHIP_CUTOFF))  # noqa: E741
    return l.groupBy(F.col("l_returnflag").alias("test_type"), "ai_window").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@query("""
SELECT o_orderkey, len(m) AS mock_breadth, coalesce(list_max(list_transform(m, lambda x: x[2])), 0) AS max_mock_chain_depth,
  list_aggregate(list_transform(m, lambda x: x[1]), 'string_agg', ',') AS kinds
FROM (SELECT o_orderkey, list([l_linenumber, CAST(l_quantity AS INT)] ORDER BY l_linenumber, l_quantity, l_partkey) AS m
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)""")
def mock_folds(spark, d):
    j = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    g = j.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey"))).alias("m"))
    m = F.transform("m", lambda x: F.struct(x["l_linenumber"].cast("string").alias("kind"), x["l_quantity"].cast("int").alias("chain_depth")))
    f = extraction.folds(m)
    return g.select("o_orderkey", f["mock_breadth"].cast("long").alias("mock_breadth"), f["max_mock_chain_depth"].alias("max_mock_chain_depth"), F.array_join(F.transform(m, lambda x: x["kind"]), ",").alias("kinds"))


@query("""SELECT c_custkey, c_mktsegment, count(o_orderkey) AS snapshots, count(DISTINCT year(o_orderdate)) AS majors
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""")
def snapshots_per_repository(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return t(spark, d, "customer").join(o, "c_custkey", "left").groupBy("c_custkey", "c_mktsegment").agg(F.count("o_orderkey").alias("snapshots"), F.count_distinct(F.year("o_orderdate")).alias("majors"))


@query("SELECT 'a' AS side, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'b', o_orderstatus, count(*) FROM orders GROUP BY 2")
def union_samples(spark, d):
    a = t(spark, d, "lineitem").select(F.lit("a").alias("side"), F.col("l_returnflag").alias("v"))
    b = t(spark, d, "orders").select(F.lit("b").alias("side"), F.col("o_orderstatus").alias("v"))
    return a.unionByName(b).groupBy("side", "v").agg(F.count("*").alias("n"))


# Test files of both styles with their measures, worked out by hand.
SOURCES = (
    ("a/LoanTest.php", """<?php
namespace Tests\\Library;

final class LoanTest extends TestCase
{
    use DatabaseTransactions;

    #[Test]
    public function lends_books(): void
    {
        $books = Book::factory()->count(2)->make();
        foreach ($books as $b) {
            $reply = $this->putJson("/loans/{$b->id}", ['days' => 14]);
            $reply->assertCreated();
        }
        $this->assertSame(2, count($books));
    }
}
"""),
    ("b/gauge.php", """<?php
test('reads a gauge', function () {
    $gauge = Mockery::mock(Gauge::class);
    $gauge->shouldReceive('read')->twice()->andReturn(3.5);
    expect((new Station($gauge))->mean())->toBe(3.5);
});
"""),
    ("c/DispatchTest.php", """<?php
class DispatchTest extends KernelTestCase {
    public function testSkipsHolidays(): void {
        Bus::fake([Ship::class]);
        $clock = $this->createMock(Clock::class);
        if ($clock->isHoliday()) { return; }
        $this->assertNull(null);
    }
    /** @test */
    public function stock_is_stored(): void { $this->assertDatabaseHas('stock', ['n' => 1]); }
    public function helper(): void { $this->get('/'); }
}
"""),
    ("d/SumTest.php", """<?php
class SumTest extends TestCase {
    function test_adds() { $this->assertEquals(3, 1 + 2); }
}
"""),
    ("e/TornTest.php", "<?php\nclass TornTest extends TestCase { public function test_it( { }"),
    ("f/notes.txt", "no program"),
)


def _read_sources(spark: SparkSession) -> DataFrame:
    from ..extract import frames

    return frames.read(spark.createDataFrame(list(SOURCES), "path string, content string"))


@query("""SELECT * FROM (VALUES
  ('a/LoanTest.php', 'lends_books', 'phpunit', 'feature', 'R1_http_call', 2, 0, 0, '', 5, 10, 8, 17, false, 'factory=1,make=1'),
  ('b/gauge.php', 'reads a gauge', 'pest', 'unit', 'R3_app_testcase_no_io', 1, 1, 1, 'mockery', 3, 5, 2, 6, false, ''),
  ('c/DispatchTest.php', 'testSkipsHolidays', 'phpunit', 'unit', 'R3_app_testcase_no_io', 1, 2, 1, 'phpunit_native,facade_fake', 5, 6, 3, 8, false, ''),
  ('c/DispatchTest.php', 'stock_is_stored', 'phpunit', 'integration', 'R2_db_interaction', 1, 0, 0, '', 1, 1, 10, 10, false, ''),
  ('d/SumTest.php', 'test_adds', 'phpunit', 'unit', 'R4_phpunit_testcase_no_io', 1, 0, 0, '', 1, 1, 3, 3, false, '')
) AS v(file_path, identifier, front_end, test_type, test_type_rule, assertion_count, mock_breadth, max_mock_chain_depth, mock_kinds, size_statements, size_loc, start_line, end_line, uses_refresh_database, setup_signals)""")
def extract_fixture_tests(spark, d):
    from ..extract import frames

    o = frames.observations(_read_sources(spark), [])
    signals = F.array_join(F.array_sort(F.transform(F.map_entries("setup_signals"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    return o.select("file_path", "identifier", "front_end", "test_type", "test_type_rule", "assertion_count", "mock_breadth", "max_mock_chain_depth", F.array_join("mock_kinds", ",").alias("mock_kinds"), "size_statements", "size_loc", "start_line", "end_line", "uses_refresh_database", signals.alias("setup_signals"))


@query("SELECT * FROM (VALUES ('a/LoanTest.php', 'parsed', 1), ('b/gauge.php', 'parsed', 1), ('c/DispatchTest.php', 'parsed', 2), ('d/SumTest.php', 'parsed', 1), ('e/TornTest.php', 'failed', 0), ('f/notes.txt', 'unroutable', 0)) AS v(path, status, n_tests)")
def extract_status(spark, d):
    return _read_sources(spark).select("path", "status", F.coalesce(F.size("tests"), F.lit(0)).alias("n_tests"))


@query("SELECT 7 AS snapshot_id, 6 AS files, 5 AS tests, 1 AS unroutable, 1 AS failures")
def extract_summary(spark, d):
    from ..extract import frames

    total = frames.summary(_read_sources(spark).withColumn("snapshot_id", F.length("path") * 0 + 7), ["snapshot_id"])
    return total.select(*(F.col(c).cast("int").alias(c) for c in total.columns))


@query("""SELECT doc_id, CASE WHEN length(text) > 250 THEN rtrim(substr(text, 1, 250), ' ') || '...' ELSE text END AS message FROM documents""")
def failure_messages(spark, d):
    """The dead letters' limit, on whole texts as messages."""
    return t(spark, d, "documents").select("doc_id", extraction.limited(F.col("text")).alias("message"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'R1_http_call' WHEN l_linenumber = 1 OR l_quantity > 45 OR l_tax > 0.05 THEN 'R2_db_interaction'
  WHEN l_linestatus = 'F' THEN 'R4_phpunit_testcase_no_io' WHEN l_discount > 0.05 THEN 'R3_app_testcase_no_io' ELSE 'R5_unclassified' END AS test_type_rule
FROM lineitem""")
def classify_by_rules(spark, d):
    """All five rules of the classifier, their inputs from the lines of orders."""
    c = F.col
    traits = F.when(c("l_linenumber") == 1, F.array(F.lit("DatabaseMigrations"), F.lit("Other"))).otherwise(F.array(F.lit("Other")))
    base = F.when(c("l_linestatus") == "F", "TestCase").when(c("l_discount") > 0.05, "KernelTestCase")
    kind = extraction.test_type(c("l_returnflag") == "R", traits, c("l_quantity") > 45, c("l_tax") > 0.05, base)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", kind["rule"].alias("test_type_rule"))


# A recorded log of a manifest: majors change, one commit names none, one lacks the file.
LOG = (("r", 0, "s0", '{"require":{"laravel/framework":"^9.0"}}'), ("r", 1, "s1", "{}"), ("r", 2, "s2", '{"require":{"laravel/framework":"^9.5"}}'), ("r", 3, "s3", None), ("r", 4, "s4", '{"require":{"laravel/framework":"^10.0"}}'), ("q", 0, "t0", None))


@query("SELECT * FROM (VALUES ('r', 9, 's2'), ('r', 10, 's4')) AS v(repo, major, sha)")
def majors_of_a_log(spark, d):
    """From the touches of a manifest to each major's commit; commits that name none are left out."""
    touches = spark.createDataFrame(list(LOG), "repo string, seq int, sha string, manifest string").withColumn("author_ts", F.lit(None).cast("timestamp"))
    return versioning.representatives(touches).select("repo", "major", "sha")


@query("SELECT * FROM (VALUES ('r', 3, 2), ('q', 0, 1)) AS v(repo, resolved, skipped)")
def unresolved_commits(spark, d):
    touches = spark.createDataFrame(list(LOG), "repo string, seq int, sha string, manifest string")
    return versioning.resolution(touches).select("repo", F.col("resolved").cast("int").alias("resolved"), F.col("skipped").cast("int").alias("skipped"))


@query(f"""
SELECT user_id, event_type, first(event_id ORDER BY ts, event_id) AS sha, min(ts) AS author_ts, CASE WHEN min(ts) < TIMESTAMP '2024-01-03' THEN 'pre' ELSE 'post' END AS ai_window
FROM events GROUP BY 1, 2""")
def blame_window(spark, d):
    from ..operators import attribution

    e = t(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("seq"), F.col("event_id").alias("sha"), F.col("ts").alias("author_ts"))
    return attribution.introduced_first(e, ["user_id", "event_type"], "seq", "sha", "author_ts", "2024-01-03")


# A small store: two majors, one test each, and rows that break each check.
def _seed(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    repos = spark.createDataFrame([(1, "o/good"), (2, "o/bad")], "id long, full_name string")
    snaps = spark.createDataFrame([(1, 1, 9, "version_boundary", "2022-01-01"), (2, 1, 10, "version_boundary", "2023-01-01"), (3, 2, 9, "version_boundary", "2023-01-01"), (4, 2, 9, "version_boundary", "2022-06-01"), (5, 2, 11, "version_boundary", "2021-01-01")], "id long, repository_id long, framework_version int, kind string, commit_date string").withColumn("commit_date", F.to_timestamp("commit_date"))
    obs = spark.createDataFrame([(1, 1, 1, None), (2, 2, 1, "post"), (3, 2, 1, None), (4, 3, 2, None), (5, 1, 2, None), (6, 77, 1, None)], "id long, snapshot_id long, repository_id long, ai_window string")
    fails = spark.createDataFrame([(1, 1), (2, 88)], "repository_id long, snapshot_id long")
    return repos, snaps, obs, fails


@query("""SELECT * FROM (VALUES
  ('—', 0, 'orphan rows', 'FAIL', '3 orphan row(s)'),
  ('o/bad', 1, 'majors strictly ascending', 'FAIL', '9 → 9 → 11'), ('o/bad', 2, 'no duplicate (repository, major)', 'FAIL', '1 duplicate(s)'), ('o/bad', 3, 'observations present', 'ok', '2 rows'),
  ('o/bad', 4, 'empty snapshots', 'warn', 'majors 9, 11 have 0 observations'), ('o/bad', 5, 'snapshot dates monotonic', 'warn', 'representative dates are not in major order'),
  ('o/bad', 6, 'instrument B coverage', 'warn', 'blame has not run — ai_window is empty'), ('o/bad', 7, 'parse-failure rate', 'ok', '33.33% (1 failures / 3 parsed+failed)'),
  ('o/good', 1, 'majors strictly ascending', 'ok', '9 → 10'), ('o/good', 2, 'no duplicate (repository, major)', 'ok', 'none'), ('o/good', 3, 'observations present', 'ok', '4 rows'),
  ('o/good', 6, 'instrument B coverage', 'ok', '50.0% unattributed (1 of 2, newest snapshot)'), ('o/good', 7, 'parse-failure rate', 'ok', '20.00% (1 failures / 5 parsed+failed)')
) AS v(repository, seq, "check", status, detail)""")
def verify_gate(spark, d):
    return quality.verify(*_seed(spark))


@query("""
WITH o AS (SELECT o_custkey AS repository_id, CAST(year(o_orderdate) AS INT) AS major, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P')
SELECT major, count(*) AS n, round(avg(o_totalprice), 3) AS mean, bool_and(o_totalprice IS NOT NULL) AS complete FROM o WHERE repository_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""")
def filtered_projection(spark, d):
    """Equality and null filters, aliasing, and a semi join, all pushed to the scans."""
    keys = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("repository_id"))
    o = t(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("repository_id"), F.year("o_orderdate").alias("major"), "o_totalprice")
    return o.join(keys, "repository_id", "left_semi").groupBy("major").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 3).alias("mean"), F.bool_and(F.col("o_totalprice").isNotNull()).alias("complete"))


# The report's example, five tests before and five after the cutoff.
REPORT_SEED = ((9, (1, 1, 2, 2, 3), ("unit", "unit", "unit", "feature", "feature"), "2021-03-01", "pre"), (10, (3, 3, 4, 4, 5), ("feature",) * 5, "2023-03-01", "post"))


def _report_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    from ..sources.store import filled

    rows, k = [], 0
    for s, (_, values, kinds, date, window) in enumerate(REPORT_SEED):
        for v, kind in zip(values, kinds, strict=True):
            k += 1
            rows.append((k, s + 1, 1, f"t{k}", "tests/ATest.php", "phpunit", kind, v, 0, 0, 0, 0, date, window))
    obs = spark.createDataFrame(rows, "id long, snapshot_id long, repository_id long, identifier string, file_path string, front_end string, test_type string, assertion_count int, mock_breadth int, max_mock_chain_depth int, size_statements int, size_loc int, introduced_author_date string, ai_window string")
    snaps = spark.createDataFrame([(s + 1, 1, major, "version_boundary") for s, (major, *_) in enumerate(REPORT_SEED)], "id long, repository_id long, framework_version int, kind string")
    return filled(obs, "test_observations"), filled(snaps, "snapshots")


def _report(spark: SparkSession, cutoff: str | None = None) -> dict[str, DataFrame]:
    return reports.report(spark, *_report_tables(spark), None, cutoff or "2022-11-30")


@query("""SELECT * FROM (VALUES ('assertion_count', 9, 5, '1.80', '2.00', '0.84', '1.50'), ('assertion_count', 10, 5, '3.80', '4.00', '0.84', '1.50')) AS v(metric, framework_version, n, mean, median, sd, iqr)""")
def report_descriptives(spark, d):
    return reports.descriptives(reports.state_sample(*_report_tables(spark)), ["assertion_count"]).withColumn("n", F.col("n").cast("int"))


@query("""SELECT * FROM (VALUES ('assertion_count', '2.000000', '-16.200000', '0.641026', 10), ('size_loc', '0.000000', '0.000000', '1.000000', 10)) AS v(metric, slope, intercept, r2, n)""")
def report_regression(spark, d):
    return reports.regression(reports.state_sample(*_report_tables(spark)), ["assertion_count", "size_loc"]).withColumn("n", F.col("n").cast("int"))


@query("""SELECT * FROM (VALUES ('assertion_count', 5, 5, '2.00', '4.00', '1.0', '-0.920', 'large')) AS v(metric, n_pre, n_post, median_pre, median_post, u, cliffs_delta, magnitude)""")
def report_comparison(spark, d):
    c = reports.comparison(reports.tests_of(reports.flow_sample(*_report_tables(spark)), ["assertion_count"], "2022-11-30"))
    return c.select("metric", F.col("n_pre").cast("int").alias("n_pre"), F.col("n_post").cast("int").alias("n_post"), "median_pre", "median_post", "u", "cliffs_delta", "magnitude")


@query("""SELECT * FROM (VALUES ('9', 5, '60.0', '40.0', '0.0', '0.0'), ('10', 5, '0.0', '100.0', '0.0', '0.0'), ('pre', 5, '60.0', '40.0', '0.0', '0.0'), ('post', 5, '0.0', '100.0', '0.0', '0.0')) AS v(k, n, "unit", feature, integration, "unknown")""")
def report_types(spark, d):
    tables = _report_tables(spark)
    one = lambda df, key: df.select(F.col(key).cast("string").alias("k"), F.col("n").cast("int").alias("n"), "unit", "feature", "integration", "unknown")
    by_version, by_window = reports.types_by_version(reports.state_sample(*tables)), reports.types_by_window(reports.flow_sample(*tables), F.col("ai_window"))
    return one(by_version, "framework_version").unionByName(one(by_window, "ai_window"))


@query("SELECT '2022-11-30' AS ai_cutoff, true AS has_version")
def report_provenance(spark, d):
    """The revision of the tool differs from build to build: only that there is one."""
    return spark.range(1).select(F.lit(reports.CUTOFF).alias("ai_cutoff"), (F.length(F.lit(reports.tool_version())) > 0).alias("has_version"))


@query("SELECT 10 AS n_pre, 0 AS n_post, 5 AS refused_metrics")
def report_refused(spark, d):
    """A cutoff after all tests leaves one side empty: every metric is refused."""
    tests = reports.tests_of(reports.flow_sample(*_report_tables(spark)), list(reports.METRICS), "2031-01-01").where("refused")
    return tests.groupBy(F.col("n_pre").cast("int").alias("n_pre"), F.col("n_post").cast("int").alias("n_post")).agg(F.count("*").cast("int").alias("refused_metrics"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber - 1 >= 1 AND CAST(l_quantity AS INT) >= l_linenumber - 1""")
def line_ranges(spark, d):
    """Which line ranges can be traced: from the line's number less one to its quantity."""
    from ..operators import attribution

    valid = attribution.valid_range(F.col("l_linenumber") - 1, F.col("l_quantity").cast("int"))
    return t(spark, d, "lineitem").where(valid).select("l_orderkey", "l_linenumber", "l_partkey")


@query(r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), u AS (SELECT doc_id, unnest(x) AS raw, generate_subscripts(x, 1) - 1 AS position FROM l),
n AS (SELECT doc_id, CAST(position AS INT) AS position, regexp_replace(raw, '^[\x00\x09-\x0D\x20]+|[\x00\x09-\x0D\x20]+$', '', 'g') AS name FROM u)
SELECT doc_id, position, name FROM n WHERE name <> '' AND NOT starts_with(name, '#')""")
def corpus_lines(spark, d):
    """Every text read as a corpus list."""
    return discovery.corpus_names(t(spark, d, "documents"), "text", ("doc_id",))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN said ELSE o_orderpriority END AS o_orderpriority
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS said FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def rebuild_layer(spark, d):
    """One column reset for all finished orders, then filled from what their lines say."""
    from ..sources.store import rebuilt

    facts = t(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("o_orderpriority"))
    return rebuilt(t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), F.col("o_orderstatus") == "F", facts, "o_orderkey", ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


@query("""SELECT * FROM (VALUES ('—', 0, 'FAIL'), ('o/good', 1, 'ok'), ('o/good', 2, 'ok'), ('o/good', 3, 'ok'), ('o/good', 6, 'ok'), ('o/good', 7, 'ok')) AS v(repository, seq, status)""")
def verify_one(spark, d):
    """The gate for one repository; orphans are still counted over all."""
    return quality.verify(*_seed(spark), "o/good").select("repository", "seq", "status")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 1")
def newest_event(spark, d):
    """The first row of an order: each task keeps its own first, no sort of the whole."""
    return t(spark, d, "events").orderBy(F.col("ts").desc_nulls_last(), F.col("event_id").desc()).limit(1).select("event_id", "user_id", "event_type")


from . import histories  # noqa: E402, F401  its queries register themselves
