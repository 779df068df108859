"""The operators against plain versions on small corpora, round trips, and held-out accuracy."""

import collections
import hashlib
import itertools
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as h

from suitescope.llm import _common, boosting, components, decontaminate, license_rules, licenses, media, mixing, near_dedup, pii, quality, queries, suffix_array_dedup, suffix_tree_dedup, tokens

DATA = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' order by 1").fetchall()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def corpus(seed, n=60):
    """Small texts with copies, edits and shared passages, cut from few words so that chance repeats occur."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdé" for b in "xyzÄ中"]
    passages = [[rng.choice(words) for _ in range(rng.randint(30, 90))] for _ in range(6)]
    out = []
    for _ in range(n):
        parts = list(itertools.chain.from_iterable(rng.choice([rng.choice(passages), [rng.choice(words) for _ in range(rng.randint(0, 60))], ["same"] * rng.randint(0, 80)]) for _ in range(rng.randint(0, 4))))
        for _ in range(rng.choice([0, 0, 1, 3])):
            if parts:
                parts[rng.randrange(len(parts))] = rng.choice(words)
        out.append(rng.choice([" ", "  ", "\n"]).join(parts))
    return list(enumerate(out))


# Hashing words and windows.
@settings(max_examples=60, deadline=None)
@given(h.lists(h.text(alphabet="aA é\t\n\x1fz", max_size=20), max_size=8))
def test_words(texts):
    data, off = _common.utf8(pa.array(texts, pa.string()))
    w = _common.Words(data, off, lower=True)
    got = [[bytes(data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    assert got == [WORD.findall(t) for t in texts]
    flat = [x.translate(UPPER) for t in got for x in t]
    assert all((w.hash[i] == w.hash[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_grams_and_minima():
    x = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64)
    for n in (1, 2, 5, 8, 35):
        g = _common.grams(x, n)
        seen = {}
        assert len(g) == 201 - n
        for i in range(len(g)):
            assert seen.setdefault(tuple(x[i : i + n]), g[i]) == g[i]
        assert len(set(seen.values())) == len(seen)
        assert _common.sliding_min(x, n).tolist() == [min(x[i : i + n]) for i in range(len(g))]


# 1. Mixing.
def test_mix_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op1_source_mix"]).fetchall()
    got = queries.QUERIES["op1_source_mix"](spark, DATA).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_targets_and_shards(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(900)]
    m = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    size = collections.Counter()
    for r in m:
        size[r.source] += r.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, total = set(), 1.5 * sum(size.values())
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(2 * size[s] for s in full)
        target = {s: 2.0 * size[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    taken, drawn = collections.Counter(), collections.Counter()
    for r in m:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        taken[r.source] += r.taken
        drawn.update(r.shards)
        assert all(0 <= s < 16 for s in r.shards)
    for s in order:
        assert abs(taken[s] - target[s]) <= 60
    assert len(drawn) == 16 and max(drawn.values()) < 2 * min(drawn.values())


# 2. Quality.
def test_quality_on_held_out_documents(spark):
    import os

    big = DATA.replace("0.001", "0.01")
    scored = by_id(queries.QUERIES["op2_quality_crf"](spark, big))
    labels = dict(duckdb.sql(f"select doc_id, quality from '{big}/labels.parquet'").fetchall())
    held = [(scored[i].predicted, y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(scored[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in scored)
    assert len(held) > 80 and os.path.isdir(big)
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.values())


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    n = [1, 3, 4, 2]
    bounds = np.concatenate([[0], np.cumsum(n)])
    unary, stay = rng.normal(size=bounds[-1]), rng.normal(size=(2, 2))
    good, log_z, pairs = quality.forward_backward(unary, stay, bounds)
    together = np.zeros((2, 2))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        weights = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weights[y] = np.exp(sum(unary[a + i] * v for i, v in enumerate(y)) + sum(stay[p, q] for p, q in itertools.pairwise(y)))
        z = sum(weights.values())
        assert log_z[k] == pytest.approx(np.log(z))
        for i in range(b - a):
            assert good[a + i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / z)
        for y, w in weights.items():
            for p, q in itertools.pairwise(y):
                together[p, q] += w / z
    assert pairs == pytest.approx(together)


# 3. Media.
@settings(max_examples=60, deadline=None)
@given(h.binary(max_size=3000))
def test_png_round_trip(raw):
    payload = media.pad(raw)
    assert len(payload) % 192 == 0 and payload and payload.startswith(raw)
    assert media.decode_png(media.encode_png(payload)).tobytes() == payload


def test_png_filters_and_checks():
    rng = np.random.default_rng(2)
    want = rng.integers(0, 256, (12, 5, 3)).astype(np.uint8)
    flat = want.reshape(12, 15).astype(int)
    lines = np.zeros((12, 16), np.uint8)
    for y in range(12):
        kind = y % 5
        lines[y, 0] = kind
        for x in range(15):
            a, b, c = (flat[y, x - 3] if x >= 3 else 0), (flat[y - 1, x] if y else 0), (flat[y - 1, x - 3] if y and x >= 3 else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[y, x + 1] = (flat[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256
    assert (media.unfilter(lines, 3).reshape(want.shape) == want).all()
    good = media.encode_png(media.pad(b"x" * 500))
    for at in (3, 20, 60, len(good) - 2):
        broken = bytearray(good)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(broken))
    assert struct.unpack(">I", good[16:20])[0] == 64


def test_media_query(spark, rows):
    got = by_id(queries.QUERIES["op3_media_columns"](spark, DATA))
    for i, t in rows:
        p = media.pad((t or "").encode())
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


# 4 and 6. Exact repeats.
def plain_words(rows, n):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = collections.Counter(tuple(w[j : j + n]) for _, w in words for j in range(len(w) - n + 1))
    out = {}
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if seen[tuple(w[j : j + n])] > 1:
                gone[j : j + n] = [True] * n
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def plain_bytes(rows, n):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - n + 1):
            first[b[j : j + n]] = min(first.get(b[j : j + n], i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if first[b[j : j + n]] < i:
                gone[j : j + n] = b"\1" * n
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("hot", [1000, 2])
def test_repeats(spark, monkeypatch, seed, hot):
    monkeypatch.setattr("suitescope.llm.repeats.HOT", hot)
    monkeypatch.setattr("suitescope.llm.repeats.LEAST_BUCKETS", 6)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for n in (35, 12):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in suffix_tree_dedup.cut_repeated_words(df, n).collect()}
        assert got == plain_words(docs, n)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in suffix_array_dedup.cut_repeated_bytes(df).collect()}
    assert got == plain_bytes(docs, 50)


def test_repeat_queries(spark, rows):
    words, raw = plain_words(rows, 35), plain_bytes(rows, 50)
    for r in queries.QUERIES["op4_substring_dedup"](spark, DATA).collect():
        n, gone, kept = words[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    for r in queries.QUERIES["op6_suffix_array_dedup"](spark, DATA).collect():
        n, gone, spans, kept = raw[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())


@settings(max_examples=80, deadline=None)
@given(h.text(alphabet="ab", max_size=60))
def test_suffix_order(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    order = suffix_array_dedup.suffix_order(raw, 64)
    suffixes = [text[i:] for i in order]
    assert suffixes == sorted(suffixes) and sorted(order) == list(range(len(text)))


# 5. Near-duplicates.
def plain_components(rows, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(UPPER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_query(spark, rows):
    got = by_id(queries.QUERIES["op5_near_duplicates"](spark, DATA))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == plain_components(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("small", [32, 2])
def test_near_duplicates_in_families(spark, monkeypatch, small):
    """Families around the threshold, so that buckets stay mixed; both ways on from there."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(9)
    docs = []
    for _ in range(4):
        base = [f"v{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(40):
            own = base[:]
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(5000)}"
            docs.append(" ".join(own))
    docs += ["A b C d", "a B c D", "a b c", "x", "x y"]
    rows = list(enumerate(docs))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows, 85)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(4)
    for size, share in ((40, 0.85), (400, 0.5), (5000, 0.9)):
        errors = []
        for _ in range(30):
            common = rng.integers(0, 2**64, int(size * share), dtype=np.uint64)
            rest = rng.integers(0, 2**64, (2, (size - len(common)) // 2 + 1), dtype=np.uint64)
            sets = [np.unique(np.concatenate([common, r])) for r in rest]
            true = len(common) / (len(common) + rest.size)
            reg = near_dedup.registers(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
            errors.append(float(near_dedup.estimate(reg[0], reg[1])) - true)
        assert abs(np.mean(errors)) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (200, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


# 7. Licences.
def test_license_query(spark, rows):
    got = by_id(queries.QUERIES["op7_license_scan"](spark, DATA))
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
        starts, labels = [], set()
        for _, label, phrase in license_rules.BASE:
            p = phrase.split()
            own = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            starts += own
            labels |= {label} if own else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


@pytest.mark.parametrize(("text", "labels"), [
    ("under the GNU General Public License, version 2.0 or later.", ["gpl", "gpl-2.0-or-later"]), ("Licensed under CC BY-NC 4.0.", ["cc-by", "cc-by-nc-4.0"]),
    ("Apache License, Version 2.0; MIT License", ["apache", "apache-2.0", "mit"]), ("3-Clause BSD License and the MPL 2.0", ["bsd-3-clause", "mpl-2.0"]), ("Lesser General Public Licence v2.1", ["lgpl-2.1"]), ("no such thing", []), ("apache\x00license", ["apache"]),
])
def test_license_labels(spark, text, labels):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels


def test_every_rule_needs_a_stem():
    """What a pattern must hold, its optional parts taken out, has a stem or is cc by."""
    for _, _, _, pattern in license_rules.rules():
        must = pattern
        while (cut := re.sub(r"\(\?:[^()]*\)(?:\?|\{0,\d+\})", "", must)) != must:
            must = cut
        must = must.replace("licen[sc]e", "license")
        assert any(stem in must for stem in licenses.STEMS) or must.startswith("cc by"), pattern


@pytest.mark.parametrize("spelling", ["license", "licence"])
def test_every_match_holds_its_keyword(spelling):
    """In both spellings, and for each of a rule's alternatives, its optional parts taken out."""
    for keyword, _, _, pattern in license_rules.rules():
        must = pattern
        while (cut := re.sub(r"\(\?:[^()]*\)(?:\?|\{0,\d+\})", "", must)) != must:
            must = cut
        must = [must.replace("licen[sc]e", spelling)]
        while any("(?:" in x for x in must):
            must = [x.replace(m[0], part, 1) for x in must for m in [re.search(r"\(\?:([^()]*)\)", x)] for part in m[1].split("|")]
        assert all(keyword in x for x in must), pattern


def test_license_labels_in_both_spellings(spark):
    """Each name alone, with no other word that would open its gate."""
    names = {"universal permissive": "upl-1.0", "open database": "odbl", "mit": "mit", "expat": "mit", "isc": "isc", "php": "php", "ruby": "ruby", "vim": "vim", "json": "json", "elastic": "elastic"}
    texts = [(k, f"{name} {s}") for k, (name, s) in enumerate((n, s) for n in names for s in ("License", "Licence"))]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {t: got[k] for k, t in texts} == {t: [names[t.rsplit(" ", 1)[0]]] for _, t in texts}


def test_license_rules_match_a_plain_scan(spark):
    """Suppression against a quadratic version over all rules."""
    rng = random.Random(3)
    bits = ["gnu general public license", "version 2", "or later", "mit license", "the", "apache license version 2 0", "cc by sa 3 0", "bsd 3 clause license", "public domain", "in the", "gpl"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(40)]
    rules = license_rules.rules()
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        found = []
        for k, label, p, pattern in rules:
            if k in t:
                for m in re.finditer(f" ({pattern})(?= )", f" {t} "):
                    s = m.start() and f" {t} "[: m.start()].count(" ")
                    found.append((s, s + m[1].count(" "), p, label))
        kept = [d for d in found if not any(o != d and o[0] <= d[0] and o[1] >= d[1] and (o[:2] != d[:2] or (-o[2], o[3]) < (-d[2], d[3])) for o in found)]
        base = {label for _, label, phrase in license_rules.BASE if f" {phrase} " in f" {t} "}
        assert got[i].labels == sorted(base | {d[3] for d in kept}), t


# 8. Personal data.
def plain_pii(t):
    email = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    ip = [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    card = [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(re.sub(r"[^0-9]", "", m[0])) <= 19 and pii.luhn(re.sub(r"[^0-9]", "", m[0]))]
    phone = [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return email + ip + card + phone


@settings(max_examples=300, deadline=None)
@given(h.text(alphabet="a@.-+1 0(5é", max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_pii(text)


def test_pii_query(spark, rows):
    got = by_id(queries.QUERIES["op8_pii_spans"](spark, DATA))
    for i, t in rows:
        base = plain_pii(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [getattr(got[i], f"n_{k}") for k in pii.BASE_KINDS] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]
        assert set(pii.joined(base).split(",")) - {""} <= set(got[i].spans.split(","))


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" * 50_000, "a.b" * 60_000 + "@", "A" * 200_000, "1 " * 100_000, "-" * 100_000):
        assert isinstance(pii.find_spans([text], pii.train()), list)


def test_added_spans():
    texts = ['x api_key = "0f3ab45c9de1f0037745ab12cd34ef5601234567" y', "commit 0f3ab45c9de1f0037745ab12cd34ef5601234567 done", "please call (212) 555-0134 now", "my ssn is 123-45-6789.", "plain words only and 2020-10-11"]
    kinds = [[s[0] for s in every] for _, every in pii.find_spans(texts, pii.train())]
    assert kinds == [["secret"], [], ["phone_local"], ["ssn"], []]
    assert pii.redact_text("ab cd ef", [("x", 3, 5), ("y", 4, 7)]) == "ab [X]f"


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    t = boosting.fit(x[:400], y[:400])
    assert (((t.raw(x[400:]) > 0) == y[400:]).mean()) > 0.9
    a, _ = boosting.platt(t.raw(x[400:]), y[400:])
    assert a > 0


# 9. Tokens.
@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.Counter(path, tokens.whole_tokens(path))


def test_plain_characters_split_alike(counter):
    """Letters, digits and spaces mean the same to both libraries for every character of PLAIN."""
    chars = [chr(c) for c in range(0x10FFFF + 1) if not 0xD800 <= c < 0xE000 and tokens.PLAIN.fullmatch(chr(c))]
    texts = [f"a{c}1{c} {c}{c}b.{c}" for c in chars]
    theirs = [[p for p, _ in counter.tok.pre_tokenizer.pre_tokenize_str(t)] for t in texts]
    back = tokens.byte_alphabet()
    assert [[bytes(back[c] for c in p).decode() for p in row] for row in theirs] == [counter.find(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(h.text(max_size=60) | h.text(alphabet="ab 'st\n\t1.é<|endoftext|>", max_size=80))
def test_counts_equal_the_library(counter, text):
    assert counter.count([text]) == [len(counter.tok.encode(text, add_special_tokens=False).ids)]


def test_token_query(spark, rows, counter):
    got = by_id(queries.QUERIES["op9_token_counts"](spark, DATA))
    for i, t in rows:
        n = len(counter.tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)


# 10. Decontamination.
def test_decontamination_query(spark, rows):
    items = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall()
    norm = lambda s: re.findall(r"[0-9a-z\x80-\U0010ffff]+", s.lower())
    grams = lambda s: {tuple(w[j : j + 5]) for w in [norm(s)] for j in range(len(w) - 4)}
    want = {i: sorted(k for k, s in items if len(grams(s) & grams(t)) >= 0.5 * len(grams(s))) for i, t in rows}
    got = {r.doc_id: r["items"] for r in queries.QUERIES["op10_decontamination"](spark, DATA).collect()}
    assert got == {i: ",".join(map(str, k)) for i, k in want.items() if k}


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(1)
    words = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for i in range(80)]
    index = decontaminate.build(items)
    where = {t: k for k, t in enumerate(index.terms.tolist())}
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 64)))
        w = decontaminate.plain_words(pa.array([text]))
        terms = sorted({where[x] for x in w.hash.tolist() if x in where})
        score = collections.Counter()
        for k in terms:
            for u, x in zip(index.postings[k].units, index.postings[k].weights, strict=True):
                score[u] += x
        for threshold in (0.05, 0.3, 0.45, 0.8):
            want = sorted(u for u, x in score.items() if x >= threshold - 1e-12)
            assert sorted(u for u, _ in decontaminate.block_max_wand(index, terms, threshold)) == want
            if threshold == 0.45 and want:
                assert len(decontaminate.hopeful_passages(index, w, threshold)[0])
