"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from suitescope.llm import decontaminate, licenses, media, mixing, near_dedup, pii, quality, suffix_array_dedup, suffix_tree_dedup, tokens

LONG = " ".join(f"w{i % 977} x{i % 31}." for i in range(30_000))
COPY = " ".join(f"shared{i}" for i in range(60))
NAMES = ("size", "target", "taken", "copies", "shards", "bucket", "dk", "id", "key", "rep", "pivot", "node", "component", "reg", "score", "n_words", "kept", "media", "shard", "part", "start")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (None, COPY, "en", "a", 1), (3, LONG, "en", "b", 1), (4, COPY, "en", "b", 1), (4, COPY, "en", "b", 1),
    (5, " ".join(f"é{i}" for i in range(60)) + " " + COPY, "de", None, 1), (6, " \n\t \n", "en", "", 1), (7, "one", "en", "a", 1), (8, "\U0001f600 a@b.co\x00 zero", "en", "a", 1), (None, None, None, None, None),
]


def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def benchmark(spark):
    return spark.createDataFrame([(1, COPY), (2, None), (None, "too short"), (3, "")], "item_id long, text string")


OPERATORS = {
    "mixing": lambda s, d: mixing.mix(d),
    "mixed_rows": lambda s, d: mixing.mixed_rows(mixing.mix(d)),
    "quality": lambda s, d: quality.score(d.select("doc_id", "text"), quality.learn(d.select("doc_id", "text"), d.select("doc_id", F.lit(1).alias("quality")))),
    "media": lambda s, d: media.read_png(media.store_png(d)),
    "suffix_tree": lambda s, d: suffix_tree_dedup.cut_repeated_words(d),
    "near": lambda s, d: near_dedup.near_duplicates(d),
    "suffix_array": lambda s, d: suffix_array_dedup.cut_repeated_bytes(d),
    "licenses": lambda s, d: licenses.scan(d),
    "pii": lambda s, d: pii.scan(d),
    "redact": lambda s, d: pii.redact(d),
    "tokens": lambda s, d: tokens.count_tokens(d, path()),
    "decontaminate": lambda s, d: decontaminate.search(d, benchmark(s)),
}


def clashing(df):
    return df.select("*", *(F.lit("x").alias(n) for n in NAMES))


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_survive(spark, name):
    docs = clashing(spark.createDataFrame(ROWS, SCHEMA))
    out = OPERATORS[name](spark, docs).cache()
    if name != "mixed_rows":
        assert out.count() == len(ROWS)
        assert sorted(map(repr, (r.doc_id for r in out.collect()))) == sorted(repr(r[0]) for r in ROWS)
    else:
        assert out.count() > 0


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_near_results(spark):
    r = rows_of(near_dedup.near_duplicates(spark.createDataFrame(ROWS, SCHEMA)))
    assert [(x.component_id, x.kept) for x in r[4]] == [(4, True)] * 2
    assert sorted((x.n_shingles, x.component_id, x.kept) for x in r[None] if x.n_shingles) == [(56, 4, False)]
    assert [(x.n_shingles, x.component_id, x.kept) for k in (1, 2, 6) for x in r[k]] == [(0, k, True) for k in (1, 2, 6)]
    assert [(x.n_shingles, x.kept) for x in r[7]] == [(1, True)]


def test_repeat_results(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    words = rows_of(suffix_tree_dedup.cut_repeated_words(docs))
    assert [(x.n_words, x.n_removed, x.kept_text) for x in words[4]] == [(60, 60, "")] * 2
    assert words[5][0].n_removed == 60 and words[5][0].kept_text.startswith("é0 é1 ")
    assert [(r.begin, r.size) for r in words[5][0].repeats] == [(60, 60)]
    got = rows_of(suffix_array_dedup.cut_repeated_bytes(docs))
    assert [x.n_removed for x in got[4]] == [0, 0]  # no smaller id holds it
    assert [x.n_removed for x in got[5]] == [len(COPY)]
    assert sorted(x.n_removed for x in got[None]) == [0, len(COPY)]  # a null id is greater than all


def test_mixing_results(spark):
    r = rows_of(mixing.mix(spark.createDataFrame(ROWS, SCHEMA)))
    assert r[2][0].size == 0 and r[2][0].taken == 0
    assert all(0 <= x.copies <= 2 and len(x.shards) == x.copies for v in r.values() for x in v)
    none = mixing.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert [(x.size, x.source_size, x.target, x.taken) for x in none] == [(0, 0, 0.0, 0)] * 2


def test_other_results(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    m = rows_of(media.read_png(media.store_png(docs)))
    assert m[1][0].media_sha256 == m[2][0].media_sha256 and m[1][0].payload_bytes == 192
    t = rows_of(tokens.count_tokens(docs, path()))
    assert (t[2][0].n_bytes, t[2][0].n_tokens, t[2][0].over_limit) == (0, 0, False)
    lic = rows_of(licenses.scan(docs))
    assert (lic[2][0].n_words, lic[2][0].labels, lic[2][0].score) == (0, [], 0.0)
    p = rows_of(pii.scan(docs))
    assert [(s.kind, s.begin, s.end) for s in p[8][0].spans] == [("email", 2, 8)] and p[2][0].spans == []
    c = rows_of(decontaminate.search(docs, benchmark(spark)))
    assert c[4][0]["items"] == [1] and c[5][0].contaminated and not c[3][0].contaminated and not c[2][0].contaminated
    assert decontaminate.search(docs, benchmark(spark).where("false")).where("contaminated").count() == 0
    q = rows_of(quality.score(docs.select("doc_id", "text"), None))
    assert q[1][0].score == 0.5 == q[2][0].score


def test_stages(spark, tmp_path):
    at = str(tmp_path / "sf")
    benchmark(spark).write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 0), (7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs = spark.createDataFrame(ROWS, SCHEMA)
    docs.write.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns, name
        assert stage(spark, docs.where("false"), at).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), at).count() == 0
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, at).collect()} >= {1, 2, 3, 4, 6, 7, 8}
    assert {4, 5} & {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, at).collect()} == set()
    clean = {r.doc_id: r for r in corpus_pipeline.pii_stage(spark, docs, at).collect()}
    assert clean[8].text == "\U0001f600 [EMAIL]\x00 zero" and clean[8].n_chars == len(clean[8].text) and clean[2].text is None
    assert corpus_pipeline.run(spark, at).count() > 0


def test_run_keeps_one_row_of_each_group(spark, tmp_path):
    """run() against brute force over rows with null and repeated ids."""
    r = random.Random(5)
    base = [[f"{c}{i}" for i in range(60)] for c in "abcdef"]
    variant = lambda b, k: " ".join([*b[:k], f"changed{k}", *b[k + 1 :]])
    rows = [
        (None, variant(base[0], 99)), (None, variant(base[0], 99)), (None, variant(base[0], 20)),  # only null ids
        (4, variant(base[1], 99)), (4, variant(base[1], 99)), (None, variant(base[1], 30)),  # one id repeated
        (5, variant(base[2], 99)), (5, variant(base[3], 30)), (3, variant(base[3], 99)),  # one id, two texts
        (8, COPY), (9, " ".join(base[4][:30]) + " mail a@b.co " + " ".join(base[4][30:])),
    ]
    rows += [(r.choice([None, 11, 12, 13]), variant(base[5], r.choice([10, 25, 40, 99]))) for _ in range(12)]
    at = str(tmp_path / "sf")
    spark.createDataFrame([(1, COPY)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(-1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")

    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
                group = [group[b] if g == group[a] else g for g in group]
    wanted = []  # for each group, the rows of which one stays
    for g in set(group):
        mine = [rows[k] for k in range(len(rows)) if group[k] == g and rows[k][1] != COPY]
        least = min((i for i, _ in mine if i is not None), default=None)
        if mine:
            wanted.append({(i, t.replace("a@b.co", "[EMAIL]")) for i, t in mine if i == least})
    # One source alone is drawn one and a half times, so each row has a copy numbered 0.
    got = Counter((x.doc_id, x.text) for x in corpus_pipeline.run(spark, at).where("copy = 0").collect())
    assert sum(got.values()) == len(wanted) and all(sum(got[x] for x in w) == 1 for w in wanted)
