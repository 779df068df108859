"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in SQL functions only.

1. Targets.  Sources by code point, null last, take the weights in turn; a share of all words is
   dealt by weight, no source above ``cap`` times its own words, the excess going to the others.
   Sorted by how soon they fill, this is one running sum over the sources, no iteration.
2. Blocks.  A document's block is the first hex digits of the md5 of its id, so a source, however
   large, falls into 16 ** digits blocks.  A source's blocks stand in the order of another md5: its
   permutation.  A target of f whole passes and a rest takes every block f times, then the first blocks
   of the permutation until the rest is met: these draws are the source's block quota.
3. Tree.  A node holds a quota of draws for each source, the root the whole ones.  Half of its draws go
   left, taken from the sources by a multivariate hypergeometric draw: every draw of the node has a
   hashed uniform, and the half with the smallest ones goes left.  Leaves are the output shards, of
   equal numbers of draws.  A leaf's draws of a source are a stretch of the source's permuted order, so
   shards are disjoint.  ``shards`` lists the leaves that hold a document's block; ``copies`` and
   ``taken`` are counted from it.
4. Within the block where a source's rest ends, documents in key order take part, to the nearest one.
   Rows with one key and size, as repeated rows are, take part together.

``sizes`` makes shards and blocks grow with the words mixed: at least 16 shards and 4,096 blocks a source,
twice as many shards for each doubling beyond SHARD_WORDS a shard, and blocks of at most BLOCK_WORDS.
No step gathers a source in one task: only tables of blocks, of draws and of sources go through windows,
and of documents those of one block a source.  Texts go through no window.

``mixed_rows`` shuffles locally: a shard's rows are dealt by hash over parts, and ``place`` is a row's
hashed place in its shard; each part is sorted by it, so that reading a shard's parts one after another,
or merged by ``place``, gives a random order.

Null and empty texts have size 0 and are taken with their block.  A null source is a source of its own.  A
null id has its text's digest as key.  Repeated rows are separate rows.  Ties in the permutation or among
uniforms go by block or number.  An empty table gives an empty mix.  Very long texts only count more words.
The same input gives the same mix on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD_PATTERN, checkpointed, table

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
#: Least levels of the tree (16 shards) and least hex digits of a key that name a block (4,096 a source).
LEVELS, BLOCK_DIGITS = 4, 3
#: Words from which on shards and blocks multiply.
SHARD_WORDS, BLOCK_WORDS = 200_000_000, 2_000_000
#: Up to so many blocks, about 150 bytes each, are sent to all executors; more meet the documents by a shuffle.
BROADCAST_BLOCKS = 200_000
SOURCE = ["_s", "_n"]  # the source, and whether it is null


def _md5(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``sources`` (_s, _n, source_size) with ``target``; a row for each source."""
    listed = Window.orderBy("_n", "_s")
    filling = Window.orderBy("_fill", "_n", "_s").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(listed) - 1, F.lit(len(weights))).cast("int") + 1)
    s = sources.withColumn("_w", weight).withColumn("_cap", cap * F.col("source_size"))
    s = s.withColumn("_fill", F.col("_cap").cast("double") / F.col("_w"))
    s = s.withColumn("_total", share * F.sum("source_size").over(everything)).withColumn("_all_w", F.sum("_w").over(everything))
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(filling), F.lit(0))) / (F.col("_all_w") - F.coalesce(F.sum("_w").over(filling), F.lit(0)))
    s = s.withColumn("_full", F.col("_fill") <= level)
    rest = F.col("_total") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(everything)
    open_w = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(everything)
    s = s.withColumn("target", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(rest * F.col("_w") / F.nullif(open_w, F.lit(0))))
    return s.select(*SOURCE, "source_size", "target")


def sizes(words: int) -> tuple[int, int]:
    """(levels of the tree, hex digits of a block) for a corpus of so many words."""
    levels, digits = LEVELS, BLOCK_DIGITS
    while words > SHARD_WORDS << levels:
        levels += 1
    while words > BLOCK_WORDS * 16**digits:
        digits += 1
    return levels, digits


def _uniform(*parts: Column) -> Column:
    """48 bits of an md5, as its hex digits: they order as the number does."""
    return F.substring(_md5(*parts), 1, 12)


def split_quotas(quotas: DataFrame, levels: int, seed: str) -> DataFrame:
    """(_s, _n, _ends): for each source the running ends of its draws over the shards, from (_s, _n, _quota).

    A level writes out the draws of each node, a row each, and ranks them by their uniforms; the half with
    the smallest goes left, and how many of them are a source's is its quota there.
    """
    nodes = quotas.select(F.lit(0).alias("_node"), *SOURCE, "_quota")
    source = F.concat(F.col("_n").cast("int").cast("string"), F.col("_s"))
    for level in range(levels):
        draws = nodes.where("_quota > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_quota")))
        draws = draws.withColumn("_u", _uniform(F.lit(seed), F.lit(str(level)), F.col("_node").cast("string"), source, F.col("_i").cast("string")))
        order = Window.partitionBy("_node").orderBy("_u", "_n", "_s", "_i")
        left = F.row_number().over(order) <= F.floor(F.count("*").over(Window.partitionBy("_node")) / 2)
        gone = draws.withColumn("_left", left).groupBy("_node", *SOURCE).agg(F.count("*").alias("_all"), F.sum(F.col("_left").cast("long")).alias("_gone"))
        sides = gone.withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
        quota = F.when(F.col("_side") == 0, F.col("_gone")).otherwise(F.col("_all") - F.col("_gone"))
        nodes = sides.select((2 * F.col("_node") + F.col("_side")).alias("_node"), *SOURCE, quota.alias("_quota"))
    shards = F.sequence(F.lit(0), F.lit(2**levels - 1))
    ends = F.transform(shards, lambda k: F.aggregate(F.filter("_l", lambda x: x["_node"] <= k), F.lit(0).cast("long"), lambda a, x: a + x["_quota"]))
    return nodes.groupBy(*SOURCE).agg(F.collect_list(F.struct("_node", "_quota")).alias("_l")).select(*SOURCE, ends.alias("_ends"))


def mix(df: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, levels: int | None = None, digits: int | None = None, seed: str = "mix", id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``df`` with size, source_size, target, copies, taken, and shards: the tree's leaf for each copy.

    ``levels`` and ``digits`` are those of ``sizes`` if not given.  Columns of ``df`` that have one of
    these names, or begin with _, are replaced.
    """
    text, source = F.col(text_column).cast("string"), F.col(source_column).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0))
    name = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    docs = df.drop(*(c for c in df.columns if c.startswith("_") and c not in (id_column, text_column, source_column)))
    docs = docs.withColumns({"_s": F.coalesce(source, F.lit("")), "_n": source.isNull(), "_key": _md5(F.lit(seed), name)})

    # Words by the least blocks, written: finer ones, if sizes asks for them, need another look.
    least = digits or BLOCK_DIGITS
    counted = lambda d: docs.withColumn("_block", F.substring("_key", 1, d)).groupBy(*SOURCE, "_block").agg(F.sum(size).alias("_words"))
    blocks = checkpointed(counted(least), "blocks")
    if levels is None or digits is None:
        own = sizes(int(blocks.agg(F.sum("_words")).first()[0] or 0))
        levels, digits = levels or own[0], digits or own[1]
        if digits != least:
            blocks = checkpointed(counted(digits), "blocks")
    docs = docs.withColumn("_block", F.substring("_key", 1, digits))
    sources = targets(blocks.groupBy(*SOURCE).agg(F.sum("_words").alias("source_size")), weights, share, cap)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0)
    sources = sources.withColumn("_passes", passes).withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size"))

    permuted = Window.partitionBy(*SOURCE).orderBy(_md5(F.lit("perm"), F.col("_s"), F.col("_block")), "_block")
    blocks = blocks.join(sources, SOURCE).withColumns({"_end": F.sum("_words").over(permuted), "_rank": F.row_number().over(permuted) - 1, "_blocks": F.count("*").over(Window.partitionBy(*SOURCE))})
    blocks = blocks.withColumn("_more", (F.col("_end") - F.col("_words") < F.col("_rest")).cast("long"))
    quotas = blocks.groupBy(*SOURCE).agg(F.sum(F.col("_passes") + F.col("_more")).cast("long").alias("_quota"))
    blocks = blocks.join(split_quotas(quotas, levels, seed), SOURCE, "left")
    leaf = lambda p: F.size(F.filter("_ends", lambda e: e <= p * F.col("_blocks") + F.col("_rank")))
    turns = F.when(F.col("_passes") + F.col("_more") > 0, F.sequence(F.lit(0).cast("long"), F.col("_passes") + F.col("_more") - 1)).otherwise(F.array().cast("array<long>"))
    cut = (F.col("_more") == 1) & (F.col("_end") > F.col("_rest"))
    blocks = checkpointed(blocks.select(*SOURCE, "_block", "source_size", "target", "_passes", "_rest", (F.col("_end") - F.col("_words")).alias("_begin"), F.transform(turns, leaf).alias("_leaves"), cut.alias("_cut")), "drawn")

    # The one block of a source where its rest ends: documents whose middle is within it take part.
    within = Window.partitionBy(*SOURCE).orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = blocks.count() <= BROADCAST_BLOCKS
    sent = F.broadcast if few else (lambda d: d)
    one = sent(blocks.where("_cut").select(*SOURCE, "_block", "_rest", "_begin"))
    tied = docs.join(one, [*SOURCE, "_block"]).select(*SOURCE, "_block", "_rest", "_begin", "_key", size.alias("size")).groupBy(*SOURCE, "_block", "_rest", "_begin", "_key", "size").agg(F.count("*").alias("_rows"))
    tied = tied.withColumn("_held", F.col("_rows") * F.col("size"))
    tied = tied.withColumn("_upto", F.sum("_held").over(within)).where("2 * (_begin + _upto) - _held <= 2 * _rest")
    ends = checkpointed(tied.groupBy(*SOURCE, "_block").agg(F.max(F.struct("_key", "size")).alias("_to")), "ends")

    held = sent(blocks.drop("_rest", "_begin").join(sent(ends), [*SOURCE, "_block"], "left"))
    out = docs.withColumn("size", size).drop("source_size", "target", "copies", "taken", "shards").join(held, [*SOURCE, "_block"])
    drawn = ~F.col("_cut") | F.coalesce(F.struct("_key", "size") <= F.col("_to"), F.lit(False))
    out = out.withColumn("shards", F.when(drawn, F.col("_leaves")).otherwise(F.slice("_leaves", F.lit(1), F.col("_passes").cast("int"))))
    out = out.withColumn("copies", F.size("shards").cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop(*SOURCE, "_key", "_block", "_passes", "_leaves", "_cut", "_to")


def mixed_rows(mixed: DataFrame, seed: str = "mix", id_column: str = "doc_id") -> DataFrame:
    """One row for each copy, with ``copy``, ``shard`` and ``place``, dealt by shard and sorted by ``place`` there."""
    rows = mixed.select(*(c for c in mixed.columns if c not in ("copy", "shard", "place")), F.posexplode("shards").alias("copy", "shard"))
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed), "shard", id_column, "copy"))
    return rows.repartition("shard", F.pmod("place", F.lit(4096))).sortWithinPartitions("shard", "place")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("shards", lambda s: s.cast("string")), ",").alias("shards"))


def _tree_sql(levels: int = LEVELS) -> str:
    """The tree's levels, the running ends of each source's draws over the shards last."""
    out = ["n0 AS (SELECT 0 AS node, s, n, CAST(sum(passes + CAST(more AS BIGINT)) AS BIGINT) AS quota FROM q GROUP BY s, n)"]
    for k in range(levels):
        out.append(f"""u{k} AS (SELECT node, s, n, row_number() OVER (PARTITION BY node ORDER BY substr(md5(concat_ws(':', 'mix', '{k}', CAST(node AS VARCHAR), concat(CAST(CAST(n AS INT) AS VARCHAR), s), CAST(i AS VARCHAR))), 1, 12), n, s, i)
        <= count(*) OVER (PARTITION BY node) // 2 AS goes FROM (SELECT node, s, n, unnest(range(1, quota + 1)) AS i FROM n{k}))""")
        out.append(f"g{k} AS (SELECT node, s, n, count(*) AS every, count(*) FILTER (goes) AS gone FROM u{k} GROUP BY ALL)")
        out.append(f"n{k + 1} AS (SELECT 2 * node AS node, s, n, gone AS quota FROM g{k} UNION ALL SELECT 2 * node + 1, s, n, every - gone FROM g{k})")
    out.append(f"ends AS (SELECT s, n, list(upto ORDER BY shard) AS ends FROM (SELECT a.s, a.n, shard, coalesce(sum(quota) FILTER (node <= shard), 0) AS upto FROM n{levels} a, range({2**levels}) r(shard) GROUP BY ALL) GROUP BY s, n)")
    return ",\n".join(out)


#: The same for corpora of up to SHARD_WORDS << LEVELS words, for which sizes gives the least shards and blocks.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS n, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', 'mix', coalesce(CAST(doc_id AS VARCHAR), concat('null ', md5(coalesce(text, '')))))) AS k
  FROM documents),
b AS (SELECT s, n, substr(k, 1, 3) AS block, sum(size) AS words FROM d GROUP BY ALL),
w AS (SELECT s, n, CAST(sum(words) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY n, s) - 1) % 3 + 1] AS w FROM b GROUP BY s, n),
f AS (SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / w AS fill, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM w),
g AS (SELECT *, fill <= (total - coalesce(sum(cap) OVER p, 0)) / (all_w - coalesce(sum(w) OVER p, 0)) AS is_full
      FROM f WINDOW p AS (ORDER BY fill, n, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT s, n, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
        ELSE CAST(total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS DOUBLE) * w / nullif(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (), 0) END AS target FROM g),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 2) AS BIGINT) ELSE 0 END AS passes FROM t),
q AS (SELECT *, upto_block - words < rest AS more FROM (
        SELECT b.*, source_size, target, passes, target - passes * source_size AS rest,
          sum(words) OVER perm AS upto_block, row_number() OVER perm - 1 AS place, count(*) OVER (PARTITION BY b.s, b.n) AS blocks
        FROM b JOIN r ON b.s = r.s AND b.n = r.n WINDOW perm AS (PARTITION BY b.s, b.n ORDER BY md5(concat_ws(':', 'perm', b.s, block)), block))),
TREE,
x AS (SELECT d.*, q.source_size, q.target, q.passes, q.rest, q.upto_block, q.words, q.more, q.place, q.blocks,
        sum(d.size) OVER same AS mine, sum(d.size) OVER (PARTITION BY d.s, d.n, q.block ORDER BY d.k, d.size) AS upto
      FROM d JOIN q ON d.s = q.s AND d.n = q.n AND substr(d.k, 1, 3) = q.block WINDOW same AS (PARTITION BY d.s, d.n, q.block, d.k, d.size)),
c AS (SELECT *, passes + CASE WHEN NOT more THEN 0 WHEN upto_block <= rest THEN 1
    WHEN 2 * (upto_block - words + upto) - mine <= 2 * rest THEN 1 ELSE 0 END AS copies FROM x)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
  coalesce(array_to_string(list_transform(range(copies), lambda p: len(list_filter(ends, lambda e: e <= p * blocks + place))), ','), '') AS shards
FROM c LEFT JOIN ends ON c.s = ends.s AND c.n = ends.n
""".replace("TREE", _tree_sql())
