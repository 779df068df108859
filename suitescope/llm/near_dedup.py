"""Near-duplicates by HyperMinHash: compressed registers, banding, corrected estimate, exact check.

A document's set holds the 64-bit hashes of its distinct shingles of five lower-cased words (the
whole sequence if it has fewer words).  The first eight bits of a hash choose one of 256 buckets;
of a bucket's least hash the register keeps the count of leading zeros and ten mantissa bits, 16
bits in all.  Empty buckets of short documents take the register of the filled bucket that a fixed
random order puts first, so that equal sets agree and similar ones agree about as often as they
are similar.  Bands of six registers give the candidates.

At similarity s a pair shares none of the 42 bands with probability (1 - s**6)**42: 2e-9 at 0.85.

* Documents with equal sets form a class, which is one node; copies cost nothing.
* In a band's bucket everyone is compared with its least node, the pivot.  Links found give
  components.  Buckets that still hold several components are compared further, without pairs that
  are linked already: up to SMALL members by pairs, larger ones in blocks that meet two by two and give
  as many links as join what they join.  So no link between different texts changes a component unseen
  and groups never become pairs.
* A comparison first estimates similarity from the registers, corrected for chance collisions;
  pairs six standard deviations below the threshold stop there.  Only for the others are texts sent,
  their sets made anew from whole texts and counted exactly.
* A pivot with many candidates is dealt out to groups of 256, each with its own copy of the pivot.
  A bucket's pivot is an aggregate, made where the rows are before they meet.

SMALL, GROUP, BLOCK and BROADCAST_IDS choose between ways to the same rows, by size.

Words are hashed to 64 bits by no polynomial, and sets are counted on hashes of five words; two different
shingles of one pair of documents agree with a probability of about their number squared times 2**-64.
Null text or text without words: an empty set, linked with nothing.  Every row is judged by its own text,
so rows that share an id may be in different components; repeated rows are in one.  A null id is never a
component's name: such a row gets its class's least id, and is not kept; null if all ids of its component
are null.  Ids may be of any type with an order.  Ties don't matter: a component's name is the least id.
Very long texts are hashed some words at a time.  An empty table gives an empty one.  Columns other than
the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Words, checkpointed, chunks, documents, forget, grams, map_arrow, mix, small_batches, table, utf8
from .components import components

SHINGLE = 5
BUCKETS, MANTISSA = 256, 10
BAND, BANDS = 6, 42
BLOCK, GROUP, SMALL = 128, 256, 32
#: Width of the slices of an incidence matrix.
COLUMNS = 16_384
#: For each bucket, the order in which it asks the others for a register.
_ASK = np.random.Generator(np.random.PCG64(104729)).random((BUCKETS, BUCKETS))
#: Expected share of registers that agree by chance, for 256 buckets and 10 mantissa bits.
CHANCE = 0.169919487 * 2.0**-MANTISSA


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each text's distinct shingle hashes in ascending order, one text after another."""
    words = Words(*utf8(texts), lower=True)
    h, bounds = grams(words.hash, n), words.bounds
    pieces = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= n:
            own = np.sort(h[a : b - n + 1])
            pieces.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            pieces.append(grams(words.hash[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            pieces.append(words.hash[:0])
    size = np.array([len(p) for p in pieces], np.int64)
    return (np.concatenate(pieces) if pieces else words.hash[:0]), np.concatenate([[0], np.cumsum(size)])


def registers(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of 256 16-bit registers for each text; all ones where a set is empty."""
    n = len(bounds) - 1
    text = np.repeat(np.arange(n), np.diff(bounds))
    cell = text * BUCKETS + (h >> np.uint64(56)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = cell[1:] != cell[:-1]
    v = (h[first] >> np.uint64(3)) & np.uint64((1 << 53) - 1)
    exponent = np.frexp(v.astype(np.float64))[1].astype(np.int64)  # exact: 53 bits
    shift = exponent - 1 - MANTISSA
    tail = np.where(shift >= 0, v >> np.maximum(shift, 0).astype(np.uint64), v << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out = np.full(n * BUCKETS, 0xFFFF, np.uint16)
    out[cell[first]] = ((53 - exponent) << MANTISSA) | tail.astype(np.int64)
    out = out.reshape(n, BUCKETS)
    filled = np.zeros(n * BUCKETS, bool)
    filled[cell[first]] = True
    filled = filled.reshape(n, BUCKETS)
    for i in np.flatnonzero(~filled.all(axis=1) & filled.any(axis=1)):
        have, lack = np.flatnonzero(filled[i]), np.flatnonzero(~filled[i])
        out[i, lack] = out[i, have[_ASK[lack][:, have].argmin(axis=1)]]
    return out


def band_hashes(reg: np.ndarray) -> np.ndarray:
    """BANDS hashes a row, the band's number worked in."""
    used = reg[:, : BAND * BANDS].astype(np.uint64).reshape(-1, BANDS, BAND)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), used.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(BAND):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + used[:, :, k])
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from agreeing registers, less those that agree by chance."""
    return ((a == b).mean(axis=-1) - CHANCE) / (1 - CHANCE)


def hopeful(est: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may reach the threshold: sizes allow it, estimate at most six deviations below."""
    s = percent / 100
    filled = BUCKETS * (1 - np.exp(-np.minimum(n_a, n_b) / BUCKETS))
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (est >= s - 6 * np.sqrt(s * (1 - s) / np.maximum(filled, 1)))


def signatures(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, t1, t2, n_shingles, set_a, set_b, reg) of (doc_id, t1, t2, text): two independent sums name the set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, bounds = shingle_sets(batch.column(3), n)
        size = np.diff(bounds)
        some = np.flatnonzero(size)
        names = np.zeros((2, len(size)), np.uint64)
        if len(some):
            with np.errstate(over="ignore"):
                names[0, some] = np.add.reduceat(mix(h), bounds[some])
                names[1, some] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds[some])
        reg = [r.tobytes() for r in registers(h, bounds)]
        own = [*batch.columns[:3], pa.array(size, pa.int64()), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)), pa.array(reg, pa.binary())]
        return pa.RecordBatch.from_arrays(own, names=["doc_id", "t1", "t2", "n_shingles", "set_a", "set_b", "reg"])

    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t1 long, t2 long, n_shingles long, set_a long, set_b long, reg binary")


def _banded(reps: DataFrame) -> DataFrame:
    """(key, node): one row for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reg = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS)
            keys = band_hashes(reg).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "node"])

    return reps.select("node", "reg").mapInArrow(run, "key long, node long")


def _dealt(pairs: DataFrame, bodies: DataFrame, column: str) -> DataFrame:
    """(a, part, role, node, n_shingles, ``column``): each a (role 0) before up to GROUP of its bs, in one partition."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("_parts"))
    asked = pairs.join(many, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    asked = asked.unionByName(many.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(0).alias("role")))
    rows = asked.join(bodies, "node").select("a", "part", "role", "node", "n_shingles", column)
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "role")


def _hopeful_pairs(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that may be similar enough by their registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_reg, own_n = None, 0
        for batch in batches:
            a, role, node, size = (batch.column(i).to_numpy() for i in (0, 2, 3, 4))
            reg = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint16).reshape(-1, BUCKETS)
            cuts = np.flatnonzero(role == 0)
            hope = np.zeros(len(a), bool)
            spans = [*([(0, cuts[0] if len(cuts) else len(a), own_reg, own_n)] if own_reg is not None else []), *((c + 1, e, reg[c], size[c]) for c, e in zip(cuts, [*cuts[1:], len(a)], strict=False))]
            for s, e, r, k in spans:
                if e > s:
                    hope[s:e] = hopeful(estimate(reg[s:e], r), size[s:e], np.full(e - s, k), percent)
            if len(cuts):
                own_reg, own_n = reg[cuts[-1]].copy(), size[cuts[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(a[hope]), pa.array(node[hope])], names=["a", "b"])

    return _dealt(pairs, reps.select("node", "n_shingles", "reg"), "reg").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, bodies: DataFrame, percent: int, n: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough, from ``bodies`` (node, n_shingles, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, None
        for batch in (c for b in batches for c in chunks(b)):
            a, role, node = (batch.column(i).to_numpy() for i in (0, 2, 3))
            h, bounds = shingle_sets(batch.column(5), n)
            found = []
            for i, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                mine = h[s:e]
                if role[i] == 0:
                    pivot, own = a[i], mine
                    continue
                assert pivot == a[i]
                common = len(np.intersect1d(own, mine, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(mine) - common):
                    found.append((a[i], node[i]))
            yield _pairs(found)

    return _dealt(pairs, bodies, "text").mapInArrow(run, "a long, b long")


def _mixed(crowd: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, node, pivot, comp, size) of the rows of buckets that hold several components, pivots apart: they were compared."""
    rows = crowd.join(comps, "node", "left").select("key", "node", "pivot", F.coalesce("component", "node").alias("comp"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("key", "size")
    return rows.where("node <> pivot").join(mixed, "key").select("key", "node", "pivot", "comp", "size")


def _across(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Hopeful pairs (a, b) in one small bucket but not in one component."""
    rows = rows.join(reps.select("node", "n_shingles", "reg"), "node").select("key", "node", "comp", "n_shingles", "reg")
    rows = rows.repartition("key").sortWithinPartitions("key", "node")

    def pairs_of(held: list[tuple]) -> list[tuple[int, int]]:
        """held: (node, comp, n, reg) of one bucket."""
        reg = np.frombuffer(b"".join(x[3] for x in held), np.uint16).reshape(-1, BUCKETS)
        node, comp, size = (np.array([x[k] for x in held], np.int64) for k in range(3))
        out = []
        for k in range(len(held) - 1):
            ok = (comp[k + 1 :] != comp[k]) & hopeful(estimate(reg[k + 1 :], reg[k]), size[k + 1 :], np.full(len(held) - k - 1, size[k]), percent)
            out += [(int(node[k]), int(r)) for r in node[k + 1 :][ok]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at:
                    out += pairs_of(held)
                    held, at = [], key
                held.append(tuple(row))
            yield _pairs(out)
        yield _pairs(pairs_of(held))

    return rows.mapInArrow(run, "a long, b long").distinct()


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def _common_counts(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of a few sets, by products of slices of their incidence matrix."""
    n = len(bounds) - 1
    _, column = np.unique(h, return_inverse=True)
    row = np.repeat(np.arange(n), np.diff(bounds))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        part = np.zeros((n, COLUMNS), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        out += part @ part.T
    return out


def spanning(x: np.ndarray, y: np.ndarray, n: int) -> list[int]:
    """Places of links x to y, numbers below n, that join all that the links join, and no more than that takes."""
    parent, out = list(range(n)), []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        i, j = top(i), top(j)
        if i != j:
            parent[j] = i
            out.append(k)
    return out


def _within_groups(rows: DataFrame, bodies: DataFrame, reps: DataFrame, percent: int, n: int) -> DataFrame:
    """Links (a, b) that join components within large buckets.

    ``rows``: all members of such buckets but their pivots, which name the buckets' groups.  Large
    buckets that overlap are one group, so that a pair is looked at once, not once a band.  A
    group is cut to blocks by a hash, and every two blocks meet in one task, which gives only a spanning
    part of the links it finds: fewer than it has members.
    """
    together = components(rows.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    members = rows.select("node", "comp").distinct().join(together.withColumnRenamed("component", "grp"), "node")
    blocks = members.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    members = members.join(blocks, "grp").withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    members = members.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    members = members.select("grp", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"), "_block", "node", "comp")
    met = members.join(bodies.join(reps.select("node", "reg"), "node"), "node").select("grp", "i", "j", "_block", "node", "comp", "n_shingles", "reg", "text")

    def meet(t: pa.Table) -> pa.Table:
        block, node, comp, size = (t[c].to_numpy() for c in ("_block", "node", "comp", "n_shingles"))
        reg = np.frombuffer(b"".join(t["reg"].to_pylist()), np.uint16).reshape(-1, BUCKETS)
        maybe = np.zeros((len(node), len(node)), bool)
        for k in range(len(node) - 1):
            rest = slice(k + 1, None)
            maybe[k, rest] = (comp[rest] != comp[k]) & hopeful(estimate(reg[rest], reg[k]), size[rest], np.full(len(node) - k - 1, size[k]), percent)
        if t["i"][0].as_py() != t["j"][0].as_py():
            maybe &= block[:, None] != block[None]
        at = np.flatnonzero(maybe.any(axis=0) | maybe.any(axis=1))
        if not len(at):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        common = _common_counts(*shingle_sets(t["text"].combine_chunks().take(pa.array(at)), n))
        union = size[at][:, None] + size[at][None] - common
        x, y = np.nonzero(maybe[np.ix_(at, at)] & (100 * common >= percent * union))
        _, held = np.unique(comp[at], return_inverse=True)  # what is in one component is joined already
        some = spanning(held[x], held[y], len(at))
        return pa.table({"a": pa.array(node[at[x[some]]], pa.int64()), "b": pa.array(node[at[y[some]]], pa.int64())})

    return met.groupBy("grp", "i", "j").applyInArrow(meet, "a long, b long")


#: Up to so many representatives, 40 bytes each and their id, are sent to all executors to fetch their texts.
BROADCAST_IDS = 1_000_000


def _bodies(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_shingles, text) of the representatives of ``nodes``, each the text of one row with its id and digests."""
    wanted = checkpointed(reps.join(nodes, "node", "left_semi").select("node", "n_shingles", "label", "t1", "t2"), "wanted")
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    on = (docs["t1"] == ids["t1"]) & (docs["t2"] == ids["t2"]) & docs["doc_id"].eqNullSafe(ids["label"])
    return docs.join(ids, on).select("node", "n_shingles", "text").dropDuplicates(["node"])


def near_duplicates(df: DataFrame, percent: int = 85, n: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``df``; links: similarity of ``percent`` or more."""
    small_batches(df.sparkSession)
    docs = documents(df, id_column, text_column).select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    sig = checkpointed(signatures(docs, n), "sig")
    name = ["n_shingles", "set_a", "set_b"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("f")
    classes = sig.where("n_shingles > 0").groupBy(*name).agg(first, F.first("reg").alias("reg"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), *name, F.col("f.doc_id").alias("label"), "f.t1", "f.t2", "reg")
    reps = checkpointed(classes, "reps")

    banded = _banded(reps)
    pivots = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("_most")).where("pivot <> _most").select("key", "pivot")
    crowd = checkpointed(banded.join(pivots, "key").select("key", "node", "pivot"), "crowd")
    star = crowd.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    bodies = checkpointed(_bodies(docs, reps, crowd.select("node").distinct()), "bodies")
    pairs = checkpointed(_hopeful_pairs(star, reps, percent), "pairs")
    links = checkpointed(_linked(pairs, bodies, percent, n), "links")
    comps = checkpointed(components(links), "comps")
    mixed = checkpointed(_mixed(crowd, comps), "mixed")
    small = checkpointed(_across(mixed.where(f"size <= {SMALL}"), reps, percent), "across")
    large = _within_groups(mixed.where(f"size > {SMALL}"), bodies, reps, percent, n)
    more = checkpointed(_linked(small, bodies, percent, n).unionByName(large), "links")
    if not more.isEmpty():
        joined = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
        comps = checkpointed(components(joined.unionByName(more)), "comps")
    for done in (crowd, bodies, pairs, links, mixed, small, more):
        forget(done)
    comps = comps.unionByName(comps.select(F.col("component").alias("node"), "component").distinct())  # with the least nodes themselves
    least = comps.join(reps.select("node", "label"), "node").groupBy("component").agg(F.min("label").alias("least"))
    of_class = reps.join(comps, "node", "left").join(least, "component", "left").select(*name, F.coalesce("least", "label").alias("component_id"))
    out = sig.select("doc_id", *name).join(of_class, name, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
