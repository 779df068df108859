"""Licence scans by ordered signature rules, in SQL functions only.

A text is lower-cased (A to Z) and seen as words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  Texts without
any keyword stop after their words are counted.  In the others the rules whose keyword stands in the
text are tried; each match is a stretch of words.  A match is suppressed if another, found by another
stretch, contains it, or if the same stretch is matched with a higher priority (then by label).
The contract's base phrases count every place and keep their labels whatever suppresses them.

Positions come from marking: a rule's matches get a mark before their first and after their last word,
which keeps the number of words, and the marked words' indexes are the stretches; this is linear in
the text.  Everything stays in one row, so no shuffle and no key is involved.  Null or empty text:
0 words, no label, score 0.  The score is the best surviving rule's priority as a share of 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .license_rules import BASE, rules

#: The contract's words on raw text, ASCII letters and digits and all beyond ASCII, written as
#: the class that Java's matcher decides fastest; and what separates them on lower-cased text.
WORD = r"[\p{Alnum}[^\x00-\x7F]]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Every match of every rule holds one of these, in one word.  Looking for them takes a pass over bytes each.
STEMS = ("licen", "gpl", "mpl", "bsd", "cc0", "creative", "wtfpl", "domain", "unencumbered", "permission", "redistribution", "neither", "reserved", "proprietary", "dual", "clause", "evil")
CC_BY = r"(?i)cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by"


def gate(text: Column) -> Column:
    """Whether some rule may match; lower-casing beyond ASCII only lets more texts pass."""
    low = F.lower(text)
    found = F.contains(low, F.lit("cc")) & text.rlike(CC_BY)
    for stem in STEMS:
        found = found | F.contains(low, F.lit(stem))
    return found


def detections(words: Column) -> Column:
    """array<struct<start, end, priority, label, base>> of normalised words: all matches of all rules."""
    table_rows = [(k, label, p, pattern, False) for k, label, p, pattern in rules()] + [(k, label, 0, pattern, True) for k, label, pattern in BASE]
    listed = "array(" + ",".join(f"named_struct('k', {_literal(k)}, 'label', {_literal(label)}, 'p', {p}, 're', {_literal(f' ({pattern})(?= )')}, 'base', {str(b).lower()})" for k, label, p, pattern, b in table_rows) + ")"
    marks = "split(regexp_replace(w, r.re, ' \\u0001$1\\u0002'), ' ')"
    places = "filter(transform(m, (x, i) -> if({test}, i - 1, null)), x -> x is not null)"
    spans = f"""
      transform({marks.join(['array(', ')'])}, m -> zip_with(
        {places.format(test="startswith(x, '\\u0001')")}, {places.format(test="endswith(x, '\\u0002')")},
        (s, e) -> named_struct('start', cast(s as bigint), 'end', cast(e as bigint), 'p', r.p, 'label', r.label, 'base', r.base)))[0]"""
    # One pass keeps the keywords that stand in the text, so that most rules cost one look-up.
    keywords = "array(" + ",".join(sorted({_literal(k) for k, *_ in table_rows})) + ")"
    inner = f"flatten(transform(filter({listed}, r -> array_contains(ks, r.k) and w rlike r.re), r -> {spans}))"
    return F.expr(f"transform(array(_words), w -> transform(array(filter({keywords}, k -> contains(w, k))), ks -> {inner})[0])[0]")


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, places, labels, score) with places: array<struct<start, end, p, label, base>> that survive, base ones included."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    d = df.select(F.col(id_column).alias("doc_id"), text.alias("_text"))
    normal = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("_text", UPPER, LOWER), SEPARATORS, " ")), F.lit(" "))
    d = d.select("doc_id", F.regexp_count("_text", F.lit(WORD)).cast("long").alias("n_words"), F.when(gate(F.col("_text")), normal).alias("_words"))
    d = d.withColumn("_all", F.when(F.col("_words").isNotNull(), detections(F.col("_words"))).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,p:int,label:string,base:boolean>>)")))
    # In order of start, longest first, best first, a match is inside another iff one before it reaches as far.
    ordered = "array_sort(filter(_all, x -> not x.base), (x, y) -> case when x.start <> y.start then sign(x.start - y.start) when x.end <> y.end then sign(y.end - x.end) when x.p <> y.p then sign(y.p - x.p) when x.label < y.label then -1 when x.label > y.label then 1 else 0 end)"
    kept = f"""
      aggregate({ordered.replace('sign(', 'signum(').replace('case', 'cast(case').replace(' else 0 end', ' else 0 end as int)')},
        named_struct('reach', -1L, 'best', 0, 'labels', cast(array() as array<string>)),
        (a, x) -> if(x.end <= a.reach, a, named_struct('reach', x.end, 'best', greatest(a.best, x.p),
          'labels', if(array_contains(a.labels, x.label), a.labels, concat(a.labels, array(x.label))))))"""
    d = d.withColumn("_kept", F.expr(kept)).withColumn("base", F.expr("filter(_all, x -> x.base)"))
    best = F.greatest(F.col("_kept.best"), F.when(F.size("base") > 0, F.lit(50)).otherwise(0))
    return d.select("doc_id", "n_words", "base", F.expr("array_sort(array_union(array_distinct(transform(base, x -> x.label)), _kept.labels))").alias("labels"), (best / 100.0).cast("double").alias("score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda x: x["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )
