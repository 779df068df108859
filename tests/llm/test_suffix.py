"""Suffix trees, the difference cover and exact words against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from suitescope.llm import _common, near_dedup, suffix_array_dedup, suffix_tree_dedup


def thue_morse(n):
    """Two words of n letters, each the other's complement: equal under any polynomial modulo 2**64 from 1,024 letters on."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_regular_words_stay_apart(spark, n):
    a, b = thue_morse(n)
    rest = [f"w{i}" for i in range(34)]
    docs = spark.createDataFrame([(1, " ".join([*rest[:17], a, *rest[17:]])), (2, " ".join([*rest[:17], b, *rest[17:]]))], "doc_id long, text string")
    assert [r.n_removed for r in suffix_tree_dedup.cut_repeated_words(docs).collect()] == [0, 0]
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 2}


def test_exact_ids_when_hashes_collide(monkeypatch):
    texts = ["ab abc ab", "a\0 a a\0\0 longerthaneight longerthaneighT longerthaneight", ""]
    for same_hash in (False, True):
        w = _common.Words(*_common.utf8(pa.array(texts)))
        if same_hash:
            w.hash[:] = 7
        got = _common.exact_ids(w, np.arange(len(w.start)))
        words = " ".join(texts).split(" ")[: len(got)]
        assert all((got[i] == got[j]) == (words[i] == words[j]) for i in range(len(got)) for j in range(i))


def test_removal_rests_on_words_not_hashes(spark, monkeypatch):
    """With window hashes that all agree the same words go."""
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(60))), (2, " ".join(f"b{i}" for i in range(60))), (3, " ".join(f"a{i}" for i in range(10, 50)))], "doc_id long, text string")
    want = {1: 40, 2: 0, 3: 40}
    assert {r.doc_id: r.n_removed for r in suffix_tree_dedup.cut_repeated_words(docs).collect()} == want
    monkeypatch.setattr(_common, "mix", lambda x: np.zeros_like(x))
    monkeypatch.setattr(suffix_tree_dedup, "grams", lambda h, n: np.zeros(max(len(h) - n + 1, 0), np.uint64))
    assert {r.doc_id: r.n_removed for r in suffix_tree_dedup.cut_repeated_words(docs).collect()} == want


def test_nodes_of_the_tree():
    rng = random.Random(3)
    for _ in range(200):
        lcp = np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 12))], np.int64)
        want = set()
        for a in range(len(lcp)):
            for z in range(a + 1, len(lcp) + 1):
                d = int(lcp[a:z].min())
                if d >= 1 and (a == 0 or lcp[a - 1] < d) and (z == len(lcp) or lcp[z] < d):
                    want.add((d, a, z + 1))
        got = [tuple(x) for x in suffix_tree_dedup.nodes(lcp, 1).tolist()]
        assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("limit", [2, 5, 50])
def test_subtrees(monkeypatch, limit):
    monkeypatch.setattr(suffix_tree_dedup, "SUBTREE", limit)
    rng = random.Random(limit)
    for _ in range(150):
        n, w = rng.randint(1, 60), rng.randint(1, 7)
        ids = np.array([rng.randint(0, rng.choice([1, 2, 2**20])) for _ in range(n)], np.int64)
        places = range(max(n - w + 1, 0))
        start = np.array(sorted(rng.sample(places, rng.randint(0, len(places)))), np.int64)
        windows = [tuple(ids[s : s + w]) for s in start]
        got = suffix_tree_dedup.first_of_kind(ids, start, w).tolist()
        assert got == [windows.index(x) if windows.count(x) > 1 else -1 for x in windows]
        seq = suffix_tree_dedup.Sequence(ids, w)
        order, lcp = suffix_tree_dedup.subtree(seq, start)
        leaves = [windows[k] for k in order]
        assert leaves == sorted(windows)
        assert lcp.tolist() == [next((k for k in range(w) if a[k] != b[k]), w) for a, b in zip(leaves, leaves[1:], strict=False)]
        groups = list(suffix_tree_dedup.prefix_groups(seq, start, limit))
        assert sorted(np.concatenate([g for g, _ in groups]).tolist() if groups else []) == list(range(len(start)))
        assert all(len(g) <= limit or len({windows[k] for k in g}) == 1 for g, _ in groups)


def test_cover():
    rng = random.Random(2)
    for c in range(7):
        for d in range(7):
            step = int(suffix_array_dedup.MEET[c, d])
            assert (c + step) % 7 in (1, 2, 4) and (d + step) % 7 in (1, 2, 4)
    for _ in range(150):
        text = bytes(rng.choice(rng.choice([b"ab", b"a", b"abc\0\xff"])) for _ in range(rng.randint(0, 80)))
        raw = np.frombuffer(text, np.uint8)
        cover = suffix_array_dedup.Cover(raw, suffix_array_dedup.first_bytes(raw))
        held = [i for i in range(len(text)) if i % 7 in (1, 2, 4)]
        assert sorted(held, key=lambda i: cover.at(np.array([i]))[0]) == sorted(held, key=lambda i: text[i:])
        assert suffix_array_dedup.suffix_order(raw, rng.choice([1, 3, 8, 100])).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_least_ids(monkeypatch):
    rng = random.Random(4)
    for _ in range(150):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(10, 90)))
        n = rng.randint(1, 9)
        start = np.array(sorted(rng.sample(range(len(text) - n + 1), rng.randint(1, len(text) - n + 1))), np.int64)
        ids = np.array([rng.randint(0, 9) for _ in start], np.int64)
        monkeypatch.setattr(suffix_array_dedup, "BLOCK", rng.choice([2, 10, 200]))
        got = suffix_array_dedup.least_ids(np.frombuffer(text, np.uint8), start, ids, n).tolist()
        assert got == [min(j for s, j in zip(start, ids, strict=True) if text[s : s + n] == text[t : t + n]) for t in start]


def test_text_ids(spark):
    """Ids that are text: ordered as text, passed through."""
    copy = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([("b", copy), ("a10", copy), ("a9", copy + " more"), (None, copy), ("z", "alone")], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in suffix_tree_dedup.cut_repeated_words(docs).collect()} == {"b": 60, "a10": 60, "a9": 60, None: 60, "z": 0}
    assert {r.doc_id: r.n_removed for r in suffix_array_dedup.cut_repeated_bytes(docs).collect()} == {"b": len(copy), "a10": 0, "a9": len(copy), None: len(copy), "z": 0}
    near = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert near == {"b": ("a10", False), "a10": ("a10", True), "a9": ("a10", False), None: ("a10", False), "z": ("z", True)}
