"""Benchmark decontamination: a BM25 index of test items, searched with every passage of every text.

The index holds the items, cut to units of at most 48 words, with BM25 weights divided by the unit's
score against itself, so that a unit's score is the share of its weight that a passage holds.  Each
text is cut to passages of 64 words, one every 32, and each passage is a query for all units scored
at or above a threshold:

* Of each unit the most common terms are set aside, up to ASIDE of its weight; a unit is out of reach
  of a passage that doesn't make up the rest of the threshold from its other terms.  This is the
  pivot test of WAND for all passages at once; it leaves few and never drops one with a result.
* The others go through block-max WAND over the postings (blocks of 16 with their own maxima).
* A unit found is verified in the words around the passage: enough of the question's and of the
  answer's word sequences must stand there.  Of an item the last sentence is the answer, or the last
  third if it is one sentence.

Words are runs of ASCII letters, digits and bytes beyond ASCII, lower-cased (ASCII and Latin-1), so
case and added punctuation don't hide a copy.  Items of fewer than MIN_WORDS words are too short for
weights and overlaps: a text holds one where all its words stand consecutively (score and overlaps 1).
Null texts and null items hold no words.  Repeated rows are judged alike, a repeated item id unites its
rows, a null one counts but is not listed.  Of equally good items the figures are the same.  An empty
table gives an empty one, an empty benchmark finds nothing.  Very long texts are searched whole.  Item
ids may be of any type with an order; other columns are not read.

Items are searched in shards of SHARD_BYTES, each an index that is broadcast.  A benchmark of several is
searched shard by shard: what is found goes to a written table, by the text's digest, before the next
index is made, so one is held at a time.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ._common import Words, checkpointed, documents, grams, inside, map_arrow, small_batches, table, text_chunks, utf8

UNIT, PASSAGE, STRIDE, MIN_WORDS = 48, 64, 32, 5
THRESHOLD, OVERLAP, ASIDE = 0.45, 0.5, 0.3
K1, B = 1.2, 0.75
POSTINGS = 16
#: Text of test items in one broadcast index.
SHARD_BYTES = 16_000_000
_INNER = np.zeros(256, bool)
_INNER[48:58] = _INNER[65:91] = _INNER[97:123] = _INNER[128:] = True


def plain_words(texts: pa.Array) -> Words:
    data, off = utf8(texts)
    data = data.copy()
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    data[latin] += 0x20
    return Words(data, off, lower=True, inner=_INNER)


def split_item(text: str) -> tuple[str, str]:
    """(question, answer) of an item."""
    cut = [m.end() for m in re.finditer(r"[.!?]\s+", text.rstrip())]
    for at in reversed(cut):
        if len(text[:at].split()) >= MIN_WORDS and len(text[at:].split()) >= 3:
            return text[:at], text[at:]
    words = text.split()
    at = max(1, len(words) * 2 // 3)
    return " ".join(words[:at]), " ".join(words[at:])


@dataclass
class Postings:
    units: list[int]
    weights: list[float]
    top: float
    ends: list[int]
    tops: list[float]


@dataclass
class Index:
    terms: np.ndarray  # sorted hashes of all terms
    rare: np.ndarray  # sorted hashes of terms that are not set aside in all their units
    begin: np.ndarray  # where each of those has its stretch of rare_unit and rare_weight
    rare_unit: np.ndarray
    rare_weight: np.ndarray
    aside: np.ndarray  # by unit, the weight of terms set aside
    postings: list[Postings]
    unit_item: list[int]
    parts: list[tuple[np.ndarray, int, np.ndarray, int]]  # by item: question grams and n, answer grams and n
    lengths: list[int]  # by item, in words
    items: list
    short: dict[int, dict[bytes, list[int]]]  # by number of words, the words of short items, to their places


def _grams_of(h: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    n = max(1, min(n, len(h)))
    return np.unique(grams(h, n)), n


def _spelling(words: Words, a: int, b: int) -> bytes:
    """The words from a to b as bytes, lower-cased, one space between."""
    return b" ".join(bytes(words.data[s:e]).lower() for s, e in zip(words.start[a:b], words.end[a:b], strict=True))


def short_items(index: Index, words: Words) -> Iterator[tuple[int, int]]:
    """(text, item's place) of every short item that stands in a text, word by word; hashes only look for places."""
    for n, held in index.short.items():
        wanted = np.array([h for h, _ in index_hashes(n, held)], np.uint64)
        start, text = inside(words.bounds, n, 0)
        for at in np.flatnonzero(np.isin(grams(words.hash, n)[start], wanted)):
            for item in held.get(_spelling(words, start[at], start[at] + n), ()):
                yield int(text[at]), item


def index_hashes(n: int, held: dict[bytes, list[int]]) -> list[tuple[np.uint64, bytes]]:
    """The hash of each spelling of n words."""
    words = plain_words(pa.array([k.decode() for k in held]))
    return list(zip(grams(words.hash, n)[words.bounds[:-1]], held, strict=True))


def build(rows: list[tuple], threshold: float = THRESHOLD) -> Index | None:
    """Index of (item_id, text) rows."""
    items, units, unit_item, parts, lengths = [], [], [], [], []
    short: dict[int, dict[bytes, list[int]]] = {}
    for item, text in rows:
        words = plain_words(pa.array([text or ""]))
        whole = words.hash
        if len(whole) < MIN_WORDS:
            if len(whole):
                short.setdefault(len(whole), {}).setdefault(_spelling(words, 0, len(whole)), []).append(len(items))
                items.append(item), lengths.append(len(whole)), parts.append(None)
            continue
        sides = [plain_words(pa.array([s])).hash for s in split_item(text)]
        if not len(sides[1]):
            sides[1] = whole[-1:]
        parts.append((*_grams_of(sides[0], 3), *_grams_of(sides[1], 2)))
        pieces = -(-len(whole) // UNIT)
        for piece in np.array_split(whole, pieces):
            units.append(piece)
            unit_item.append(len(items))
        items.append(item)
        lengths.append(len(whole))
    if not items:
        return None
    if not units:  # short items only
        none = np.zeros(0, np.int64)
        return Index(np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none, np.zeros(0), np.zeros(0), [], [], parts, lengths, items, short)
    counted = [np.unique(u, return_counts=True) for u in units]
    terms, df = np.unique(np.concatenate([t for t, _ in counted]), return_counts=True)
    idf = np.log(1 + (len(units) - df + 0.5) / (df + 0.5))
    mean = np.mean([len(u) for u in units])
    entries: list[list[tuple[int, float]]] = [[] for _ in terms]
    at, share = [], []
    for u, (t, tf) in enumerate(counted):
        k = np.searchsorted(terms, t)
        w = idf[k] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(units[u]) / mean))
        w /= w.sum()
        at.append(k), share.append(w)
        for i, x in zip(k, w, strict=True):
            entries[i].append((u, float(x)))
    aside, left = np.zeros(len(units)), []
    for u, (k, w) in enumerate(zip(at, share, strict=True)):
        order = np.argsort(-df[k], kind="stable")
        away = np.cumsum(w[order]) <= min(ASIDE, threshold)
        aside[u] = w[order][away].sum()
        left += [(int(t), u, float(x)) for t, x in zip(k[order][~away], w[order][~away], strict=True)]
    left.sort()
    rare, begin = np.unique(np.array([t for t, _, _ in left], np.int64), return_index=True)
    essential = (terms[rare], np.append(begin, len(left)), np.array([u for _, u, _ in left], np.int64), np.array([w for *_, w in left]), aside)
    postings = []
    for e in entries:
        u, w = [x for x, _ in e], [x for _, x in e]
        blocks = range(0, len(u), POSTINGS)
        postings.append(Postings(u, w, max(w), [u[min(b + POSTINGS, len(u)) - 1] for b in blocks], [max(w[b : b + POSTINGS]) for b in blocks]))
    return Index(terms, *essential, postings, unit_item, parts, lengths, items, short)


def block_max_wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """(unit, score) of every unit whose weight of ``terms`` (positions in the index) reaches the threshold."""
    lists = [[0, index.postings[t]] for t in terms]
    out = []
    here = lambda x: x[1].units[x[0]]

    def seek(x: list, unit: int) -> None:
        """Move to the first posting at or past ``unit``, skipping whole blocks."""
        p, at = x[1], x[0]
        b = at // POSTINGS
        while b < len(p.ends) and p.ends[b] < unit:
            b += 1
        at = max(at, b * POSTINGS)
        while at < len(p.units) and p.units[at] < unit:
            at += 1
        x[0] = at

    while True:
        lists = sorted((x for x in lists if x[0] < len(x[1].units)), key=here)
        total, pivot = 0.0, None
        for k, x in enumerate(lists):
            total += x[1].top
            if total >= threshold - 1e-12:
                pivot = k
                break
        if pivot is None:
            return out
        unit = here(lists[pivot])
        while pivot + 1 < len(lists) and here(lists[pivot + 1]) == unit:
            pivot += 1
        bound, skip = 0.0, None
        for x in lists[: pivot + 1]:
            b = x[0] // POSTINGS
            while b < len(x[1].ends) and x[1].ends[b] < unit:
                b += 1
            if b < len(x[1].ends):
                bound += x[1].tops[b]
                skip = x[1].ends[b] if skip is None else min(skip, x[1].ends[b])
        if bound < threshold - 1e-12:
            # No unit up to the nearest block end, or to the next list's place, can reach the threshold.
            nearest = unit if skip is None else skip
            if pivot + 1 < len(lists):
                nearest = min(nearest, here(lists[pivot + 1]) - 1)
            for x in lists[: pivot + 1]:
                seek(x, max(nearest, unit) + 1)
        elif here(lists[0]) == unit:
            score = sum(x[1].weights[x[0]] for x in lists[: pivot + 1])
            if score >= threshold - 1e-12:
                out.append((unit, score))
            for x in lists[: pivot + 1]:
                x[0] += 1
        else:
            for x in lists[:pivot]:
                seek(x, unit)


def hopeful_passages(index: Index, words: Words, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, last word + 1) of passages that may hold enough of some unit's terms not set aside."""
    n = np.diff(words.bounds)
    count = np.where(n > 0, np.maximum(1, -(-(n - PASSAGE) // STRIDE) + 1), 0)
    base = np.cumsum(count) - count
    sieve = np.zeros(1 << 20, bool)
    sieve[(index.rare & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    place = np.flatnonzero(sieve[(words.hash & np.uint64((1 << 20) - 1)).astype(np.int64)])
    term = np.minimum(np.searchsorted(index.rare, words.hash[place]), len(index.rare) - 1)
    real = index.rare[term] == words.hash[place]
    place, term = place[real], term[real]
    many = index.begin[term + 1] - index.begin[term]
    at = np.repeat(index.begin[term] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    place, unit, weight = np.repeat(place, many), index.rare_unit[at], index.rare_weight[at]
    text = np.searchsorted(words.bounds, place, "right") - 1
    turn = (place - words.bounds[text]) // STRIDE  # a word is in the passage that starts in its stride, and in the one before
    last = np.minimum(turn, count[text] - 1)
    first = np.maximum(turn - 1, 0)
    two = first < last
    passage = np.concatenate([base[text] + last, (base[text] + first)[two]])
    key = passage * len(index.aside) + np.concatenate([unit, unit[two]])
    key, inverse = np.unique(key, return_inverse=True)
    total = np.bincount(inverse, np.concatenate([weight, weight[two]]), len(key))
    ok = np.unique(key[total + index.aside[key % len(index.aside)] >= threshold - 1e-9] // len(index.aside))
    text = np.searchsorted(base + count, ok, "right")
    start = words.bounds[text] + (ok - base[text]) * STRIDE
    return text, start, np.minimum(start + PASSAGE, words.bounds[text + 1])


def matches(index: Index, texts: pa.Array, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[dict[int, tuple[float, float, float]]]:
    """For each text the items verified in it: {item's place: (score, question's overlap, answer's overlap)}."""
    words = plain_words(texts)
    out: list[dict[int, tuple[float, float, float]]] = [{} for _ in range(len(texts))]
    for text, item in short_items(index, words):
        out[text][item] = (1.0, 1.0, 1.0)
    if not index.postings:
        return out
    for text, a, b in zip(*hopeful_passages(index, words, threshold), strict=True):
        own = np.unique(words.hash[a:b])
        at = np.minimum(np.searchsorted(index.terms, own), len(index.terms) - 1)
        for unit, score in block_max_wand(index, at[index.terms[at] == own].tolist(), threshold):
            item = index.unit_item[unit]
            reach = index.lengths[item] + PASSAGE
            near = words.hash[max(words.bounds[text], a - reach) : min(words.bounds[text + 1], b + reach)]
            question, n, answer, m = index.parts[item]
            found = [float(np.isin(g, grams(near, k)).mean()) for g, k in ((question, n), (answer, m))]
            if min(found) >= overlap and (item not in out[text] or out[text][item] < (score, *found)):
                out[text][item] = (score, *found)
    return out


def shards(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text") -> Iterator[Index]:
    """Indexes of all items, each over at most about SHARD_BYTES of text, made one at a time."""
    b = benchmark.select(F.col(item_column).alias("item"), F.col(text_column).cast("string").alias("text")).where("text is not null")
    size = int(b.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = max(1, -(-size // SHARD_BYTES))
    for k in range(n):
        rows = sorted(map(tuple, b.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()), key=repr)
        if index := build(rows):
            yield index


FIGURES = ["score", "question_overlap", "answer_overlap"]


def _found_in(texts: DataFrame, index: Index, item: str, threshold: float, overlap: float) -> tuple[DataFrame, Broadcast]:
    """``texts`` (key, text) as (key, found): array of (item, figures) of the items of one index."""
    held = texts.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item", _arrow_type(item)), *((f, pa.float64()) for f in FIGURES)]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        best: list[dict] = []
        for own in matches(held.value, batch.column(1), threshold, overlap):
            best.append({})
            for place, figures in own.items():
                name = held.value.items[place]
                best[-1][name] = max(best[-1].get(name, figures), figures)
        rows = [[{"item": name, **dict(zip(FIGURES, figures, strict=True))} for name, figures in f.items()] for f in best]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["key", "found"])

    key = texts.schema["key"].dataType.simpleString()
    return map_arrow(texts, run, f"key {key}, found array<struct<item:{item},{','.join(f + ':double' for f in FIGURES)}>>"), held


def _arrow_type(item: str) -> pa.DataType:
    return to_arrow_type(StructType.fromDDL(f"x {item}")[0].dataType)


def search(df: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, contaminated, items, score, question_overlap, answer_overlap) of each row of ``df``.

    ``items``: ids of the verified items, ascending; the figures are those of the best one, else null.
    """
    docs, item = documents(df, id_column, text_column), benchmark.schema["item_id"].dataType.simpleString()
    none = F.array().cast(f"array<struct<item:{item},{','.join(f + ':double' for f in FIGURES)}>>")
    indexes = shards(benchmark)
    first, second = next(indexes, None), next(indexes, None)
    if first is None:
        found = docs.withColumn("found", none)
    elif second is None:
        found = _found_in(docs.select(F.col("doc_id").alias("key"), "text"), first, item, threshold, overlap)[0].withColumnRenamed("key", "doc_id")
    else:
        digest = F.sha2(F.coalesce("text", F.lit("")), 256)
        parts = []
        for index in itertools.chain([first, second], indexes):
            first = second = None
            part, held = _found_in(docs.select(digest.alias("key"), "text"), index, item, threshold, overlap)
            parts.append(checkpointed(part.where("size(found) > 0").dropDuplicates(["key"]), "found"))
            held.destroy()
        every = functools.reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.flatten(F.collect_list("found")).alias("found"))
        found = docs.withColumn("key", digest).join(every, "key", "left").withColumn("found", F.coalesce("found", none))
    # One item may lie in several shards, as its rows may.
    best = F.array_max(F.transform("found", lambda x: F.struct(*(x[f] for f in FIGURES))))
    items = F.array_sort(F.array_distinct(F.filter(F.transform("found", lambda x: x["item"]), lambda x: x.isNotNull())))
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), items.alias("items"), *(best[f].alias(f) for f in FIGURES))


def drop_contaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``df`` whose text holds no test item."""
    for index in shards(benchmark):
        df = _without(df, index)
    return df


def _without(df: DataFrame, index: Index) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("boolean")
    def clean(texts):
        return texts.__class__([not found for part in text_chunks(texts) for found in matches(held.value, part)], dtype=bool)

    small_batches(df.sparkSession)
    return df.where(clean("text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that holds test items: its id, the items' ids as text, and the best one's figures."""
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).where("contaminated")
    return found.select("doc_id", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), "score", "question_overlap", "answer_overlap")
