"""Exact repeats of a fixed length over a whole corpus, without sending every position anywhere.

Both substring operators ask, for every window of L consecutive tokens, where else it stands.  The
steps, in which a bucket is a group of whole documents and tokens are words or bytes:

1. Documents are dealt to buckets of a few MB by a hash.  In each bucket every window is reduced to an
   anchor, the least hash of its K-token grams.  Equal windows have equal anchors wherever they stand,
   and neighbouring windows mostly share theirs: about 2 / (L - K + 2) anchors a token.
2. Each bucket sends its distinct anchors, 4 bytes each, to parts by hash.  A part answers each bucket
   with those that another bucket has too, and says which of them are hot: held by many documents.
3. Only windows with such an anchor go on to be grouped (``local`` and ``resolve`` of the operator):
   their groups fit in memory, since hot anchors' windows are dealt out one by one.
4. What is found repeated goes back to the buckets, which cut their documents.

An anchor that agrees by chance only sends windows on in vain; results rest on the windows themselves.
A bucket sends an anchor or a window once however many of its documents hold it, so a group of copies
never meets in one task.  The documents' exchange is the same in steps 1, 3 and 4 and is written once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BYTE, Words, documents, grams, input_bytes, inside, mix, numbered, runs, sliding_min, small_batches, utf8

#: Tokens hashed at a time.
SLICE = 500_000
#: Documents from which on an anchor counts as hot.
HOT = 1_000
LEAST_BUCKETS = 48
#: Text whose anchors meet in one part; windows need parts of their own size.
ANCHOR_PART_BYTES = 48_000_000
#: Bytes below which a packet is not compressed.
LEAST_PACKED = 256


@dataclass
class Bucket:
    """Documents of one bucket in an order that depends on them only."""

    doc_id: pa.Array
    ids: np.ndarray
    data: np.ndarray
    off: np.ndarray
    tokens: np.ndarray  # words: their hashes; bytes: the bytes
    bounds: np.ndarray
    words: Words | None


def open_bucket(rows: pa.Table, by_words: bool) -> Bucket:
    rows = rows.combine_chunks()
    rows = rows.take(np.lexsort((rows["dk"].to_numpy(), rows["id"].to_numpy())))
    text = rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string())
    data, off = utf8(text)
    words = Words(data, off) if by_words else None
    tokens, bounds = (words.hash, words.bounds) if by_words else (data, off)
    doc_id = rows["doc_id"].combine_chunks() if rows.num_rows else pa.array([], rows.schema.field("doc_id").type)
    return Bucket(doc_id, rows["id"].to_numpy(), data, off, tokens, bounds, words)


@dataclass
class Runs:
    """Stretches of windows with one anchor: text, first window, number of windows, anchor."""

    text: np.ndarray
    start: np.ndarray
    n: np.ndarray
    anchor: np.ndarray


def _values(tokens: np.ndarray) -> np.ndarray:
    return BYTE[tokens] if tokens.dtype == np.uint8 else tokens


def slices(bounds: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of texts with about SLICE tokens each."""
    out, a = [], 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SLICE, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def anchored(b: Bucket, length: int, k: int) -> Runs:
    parts = []
    for first, last in slices(b.bounds):
        at = b.bounds[first]
        least = sliding_min(grams(_values(b.tokens[at : b.bounds[last]]), k), length - k + 1)
        start, text = inside(b.bounds[first : last + 1] - at, length, 0)
        anchor = least[start]
        s, e = runs(text, anchor)
        parts.append((text[s] + first, start[s] + at, e - s, mix(anchor[s])))
    if not parts:
        return Runs(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    return Runs(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def window_hashes(b: Bucket, length: int, start: np.ndarray) -> np.ndarray:
    """Hashes of the windows that begin at the ascending positions ``start``."""
    out = np.zeros(len(start), np.uint64)
    for first, last in slices(b.bounds):
        lo, hi = np.searchsorted(start, (b.bounds[first], b.bounds[last]))
        if hi > lo:
            at = start[lo]
            end = min(int(start[hi - 1]) + length, len(b.tokens))
            out[lo:hi] = grams(_values(b.tokens[at:end]), length)[start[lo:hi] - at]
    return out


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... n of them, for each."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def keys_of(anchor: np.ndarray, parts: int) -> np.ndarray:
    """Part and 32 bits of each anchor in one number."""
    return ((anchor >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32) | (anchor & np.uint64(0xFFFFFFFF))


def by_part(part: np.ndarray, *columns: np.ndarray):
    """(part, columns of its rows) for each part, rows in their order."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    s, e = runs(part)
    for a, z in zip(s, e, strict=True):
        yield int(part[a]), [c[order[a:z]] for c in columns]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as one value, compressed unless that would cost more than it saves."""
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    head = len(arrays[0]).to_bytes(4, "little")
    if len(raw) < LEAST_PACKED:
        return head + b"\0\0\0\0" + raw
    return head + len(raw).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(value: bytes, *kinds: str) -> list[np.ndarray]:
    n, size = int.from_bytes(value[:4], "little"), int.from_bytes(value[4:8], "little")
    raw = pa.Codec("zstd").decompress(value[8:], size, asbytes=True) if size else value[8:]
    out, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(raw[at : at + width], kind))
        at += width
    return out


def _table(rows: list[tuple], *kinds: pa.DataType) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "bucket", "body"][: len(kinds)])


PACKET = "part int, bucket int, body binary"
_KINDS = (pa.int32(), pa.int32(), pa.binary())


def cut_repeats(
    df: DataFrame,
    length: int,
    k: int,
    by_words: bool,
    local: Callable[[Bucket, Runs, np.ndarray, np.ndarray, int], list[tuple[int, bytes]]],
    resolve: Callable[[list[tuple[int, bytes]]], list[tuple[int, bytes]]],
    finish: Callable[[Bucket, Runs, list[bytes]], pa.Table],
    schema: str,
    bucket_bytes: int,
    part_bytes: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``finish``'s rows for all documents.

    ``local``(bucket, runs, shared, hot, parts): packets (part, body) of windows that other buckets
    may hold; shared and hot say for each run whether its anchor is.  ``resolve``(packets of a part, as
    (bucket, body)): answers (bucket, body).  ``finish``(bucket, runs, answers): its documents' rows.
    """
    docs, _ = numbered(documents(df, id_column, text_column).withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "id")
    size = input_bytes(docs)
    small_batches(df.sparkSession)
    buckets = max(LEAST_BUCKETS, -(-size // bucket_bytes))
    parts = max(LEAST_BUCKETS // 2, -(-size // ANCHOR_PART_BYTES))
    window_parts = max(LEAST_BUCKETS // 2, -(-size // part_bytes))
    docs = docs.withColumn("dk", F.xxhash64("doc_id", "text")).withColumn("id", F.coalesce("id", F.lit(2**63 - 1)))
    docs = docs.withColumn("bucket", F.pmod("dk", F.lit(buckets)).cast("int")).select("bucket", "dk", "id", "doc_id", "text")

    def send(rows: pa.Table) -> pa.Table:
        found = anchored(open_bucket(rows, by_words), length, k)
        order = np.lexsort((found.text, found.anchor))
        anchor, text = found.anchor[order], found.text[order]
        key = keys_of(anchor, parts)
        s, _ = runs(key)
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
        many = np.minimum(np.add.reduceat(new, s, dtype=np.int64), 255).astype(np.uint8) if len(s) else np.zeros(0, np.uint8)
        key, bucket = key[s], rows["bucket"][0].as_py()
        packets = by_part((key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32), many)
        return _table([(p, bucket, pack(*c)) for p, c in packets], *_KINDS)

    def answer(rows: pa.Table) -> pa.Table:
        bodies = [unpack(x, "u4", "u1") for x in rows["body"].to_pylist()]
        n = np.array([len(x[0]) for x in bodies])
        key, many = (np.concatenate([x[i] for x in bodies]) for i in (0, 1))
        source = np.repeat(np.arange(len(bodies)), n)
        order = np.argsort(key, kind="stable")
        s, e = runs(key[order])
        total = np.add.reduceat(many[order], s, dtype=np.int64) if len(s) else np.zeros(0, np.int64)
        shared = np.repeat(e - s > 1, e - s)
        hot = np.repeat(total >= HOT, e - s)[shared].astype(np.uint8)
        order = order[shared]
        part, names = rows["part"][0].as_py(), rows["bucket"].to_pylist()
        return _table([(part, names[b], pack(*c)) for b, c in by_part(source[order], key[order], hot)], *_KINDS)

    def _heard(found: Runs, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        known, heat = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for part, body in zip(replies["part"].to_pylist(), replies["body"].to_pylist(), strict=True):
            low, hot = unpack(body, "u4", "u1")
            known.append(np.uint64(part) << np.uint64(32) | low.astype(np.uint64)), heat.append(hot)
        known, heat = np.concatenate(known), np.concatenate(heat)
        order = np.argsort(known)
        known, heat = known[order], heat[order]
        if not len(known):
            return np.zeros(len(found.n), bool), np.zeros(len(found.n), bool)
        key = keys_of(found.anchor, parts)
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        shared = known[at] == key
        return shared, shared & (heat[at] > 0)

    def ask(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows or not replies.num_rows:
            return _table([], *_KINDS)
        b = open_bucket(rows, by_words)
        found = anchored(b, length, k)
        return _table([(p, rows["bucket"][0].as_py(), body) for p, body in local(b, found, *_heard(found, replies), window_parts)], *_KINDS)

    def settle(rows: pa.Table) -> pa.Table:
        packets = list(zip(rows["bucket"].to_pylist(), rows["body"].to_pylist(), strict=True))
        return _table([(rows["part"][0].as_py(), b, body) for b, body in resolve(packets)], *_KINDS)

    def cut(rows: pa.Table, replies: pa.Table) -> pa.Table:
        b = open_bucket(rows, by_words)
        return finish(b, anchored(b, length, k), replies["body"].to_pylist())

    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.groupBy("bucket").applyInArrow(send, PACKET)
    answers = sent.groupBy("part").applyInArrow(answer, PACKET)
    asked = docs.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(ask, PACKET)
    settled = asked.groupBy("part").applyInArrow(settle, PACKET)
    return docs.groupBy("bucket").cogroup(settled.groupBy("bucket")).applyInArrow(cut, f"doc_id {kind}, {schema}")
