"""Nothing is cut short: lines, spans, items and pre-tokens of any length and kind."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from suitescope.llm import decontaminate, pii, quality, tokens


def test_every_line_of_a_sampled_document_is_fitted(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda x, bounds, label: seen.update(lines=np.diff(bounds).tolist(), label=label.tolist()))
    docs = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(1000))), (2, "one"), (2, "two\nlines"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (77, 1), (78, 1), (79, 0), (None, 1)], "doc_id long, quality int")
    quality.learn(docs, labels, sample=3)  # labels without a document take no place
    assert sorted(seen["lines"]) in ([1, 1, 1000], [1, 2, 1000]) and sorted(seen["label"]) == [0, 1, 1]


@pytest.mark.parametrize("n", [40, 256, 257, 5000])
def test_long_secrets(n):
    key = "".join("0f3Ab45c9dE1f0037745ab12cd34ef56"[i * 7 % 32] for i in range(n))
    for text in (f'api_key = "{key}" ok', f"password={key}"):
        (_, spans), = pii.find_spans([text], pii.train())
        at = text.index(key)
        assert ("secret", at, at + n) in spans


def test_many_spans_take_linear_time():
    model, took = pii.train(), []
    for n in (2000, 8000):
        text = "call (212) 555-0134 now " * n
        begin = time.perf_counter()
        (_, spans), = pii.find_spans([text], model)
        took.append(time.perf_counter() - begin)
        assert len(spans) == n
    assert took[1] < 10 * took[0]


def test_covered():
    c = pii.Covered([("a", 5, 9), ("b", 7, 12), ("c", 20, 22)])
    assert [c.add(*x) for x in ((0, 5), (4, 6), (12, 20), (11, 13), (22, 23), (15, 16))] == [True, False, True, False, True, False]


def test_short_items(spark):
    items = spark.createDataFrame([(1, "The quick, brown fox"), (2, "yes indeed"), (3, ""), (None, "grue"), (4, "the quick")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so THE quick brown fox ran"), (2, "the brown quick fox"), (3, "a grue"), (4, None), (5, "yes. Indeed!")], "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r["items"]) for r in decontaminate.search(docs, items).collect()}
    assert got == {1: (True, [1, 4]), 2: (False, []), 3: (True, []), 4: (False, []), 5: (True, [2])}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {2, 4}


def test_text_item_ids_and_shards(spark, monkeypatch):
    """Several shards give what one gives, whatever the type of the ids."""
    words = [" ".join(f"{c}{i}" for i in range(12)) + f". And {c}a {c}b {c}c {c}d." for c in "pqrstuv"]
    items = spark.createDataFrame([(f"id{k}", w) for k, w in enumerate(words)] + [("id0", "short one")], "item_id string, text string")
    docs = spark.createDataFrame([("x", words[0]), ("y", "and " + words[2] + " then " + words[5]), ("z", "nothing here"), (None, words[1]), ("x", "short one"), ("w", None)], "doc_id string, text string")
    want = sorted(map(repr, decontaminate.search(docs, items).collect()))
    assert [r for r in want if "['id2', 'id5']" in r] and sum("contaminated=True" in r for r in want) == 4
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 100)
    assert len(list(decontaminate.shards(items))) > 2
    cut = decontaminate.search(docs, items)
    assert sorted(repr((r.doc_id, r.contaminated, r["items"])) for r in cut.collect()) == sorted(repr((r.doc_id, r.contaminated, r["items"])) for r in decontaminate_whole(spark, docs, items, monkeypatch))
    assert decontaminate.drop_contaminated(docs, items).count() == 2


def decontaminate_whole(spark, docs, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 16_000_000)
    out = decontaminate.search(docs, items).collect()
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 100)
    return out


def test_shortcut_in_all_scripts():
    """Whole tokens and merges for texts beyond PLAIN; the library is asked for no whole text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    counter = tokens.Counter(path, tokens.whole_tokens(path))
    texts = ["Привет, мир! 123", "漢字かな交じり文 and words", "👍🏽 ok‍　x", "Ελληνικά κείμενα", "naïve \U0001f600  <|endoftext|> ж", "a b\u0085 c", "٣٤٥ १२३", "é ­"]
    want = [len(counter.tok.encode(t, add_special_tokens=False).ids) for t in texts]
    library = counter.tok

    class Split:
        pre_tokenizer, model = library.pre_tokenizer, library.model

    counter.tok = Split()  # no encode here
    assert counter.count(texts) == want


def test_chunked_stages(spark):
    """The filters' texts are cut by bytes, and every row gets its own answer."""
    docs = spark.createDataFrame([(i, ("x" * 300_000 if i % 7 else "mail a@b.co ") + str(i)) for i in range(40)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(docs).select("doc_id", F.substring("text", 1, 12).alias("text")).collect()}
    assert out == {i: ("x" * 12 if i % 7 else "mail [EMAIL]") for i in range(40)}
    assert pa.types.is_string(pa.string())
