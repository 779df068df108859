"""Substring dedup over words by prefix-partitioned suffix trees.

Suffixes start at every word.  Those that may share 35 words with another (see ``repeats``) go, with
their words, to parts: by the anchor they hold, or by their own 35 words where that anchor is hot.  In a
part, as in each bucket of documents before, ``prefix_groups`` splits the suffixes by prefixes of
variable length: a prefix is lengthened only where its group exceeds SUBTREE suffixes.  A group is one
subtree, cut at the depth that decides: its leaves are sorted word by word, neighbours' common prefixes
(LCP) are counted in words, and stretches of them are the internal nodes.  The leaves of a node of depth
35 or more are the places of a repeat; neighbouring places join into maximal ones when a document is cut.

Words are compared as they are: in a part or bucket every word gets a number that just the same bytes
get (``exact_ids``).  Hashes of windows only leave out suffixes that cannot repeat.

Every word covered by a window whose word sequence also starts anywhere else, in the same document too,
is removed; windows are judged on the input.  Null text has no words.  Repeated rows, with or without an
id, are other places: their windows go.  Texts shorter than a window stay whole.  Very long texts take
memory in proportion to their length in one task.  Ties do not arise: all places of a repeat go.  An
empty table gives an empty one.  Columns other than the id and the text are not read.  Ids of any type
pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from ._common import Words, exact_ids, grams, inside, mix, table
from .repeats import Bucket, Runs, by_part, pack, runs, spread, unpack

WINDOW, ANCHOR = 35, 8
BUCKET_BYTES = 4_000_000
PART_BYTES = 16_000_000
#: Suffixes that one subtree is made of; more only where all words of their windows are the same.
SUBTREE = 50_000


class Sequence:
    """Word numbers, several packed in one number, so that a few comparisons order a window."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.ids, self.depth = ids, depth
        bits = max(int(ids.max(initial=0)).bit_length(), 1)
        self.width = max(min(63 // bits, depth), 1)
        self.packed = np.zeros(len(ids), np.int64)
        for k in range(self.width):
            self.packed = self.packed << bits
            self.packed[: max(len(ids) - k, 0)] |= ids[k:]
        #: Where in a window its packed numbers begin; the last may overlap the one before.
        self.steps = [*range(0, depth - self.width, self.width), depth - self.width]

    def common(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """Words that the windows from a and from b share, which agree before ``step`` and not in the numbers there."""
        out, live = np.full(len(a), step, np.int64), np.arange(len(a))
        for k in range(self.width - 1):
            live = live[self.ids[a[live] + step + k] == self.ids[b[live] + step + k]]
            out[live] += 1
        return out


def prefix_groups(seq: Sequence, start: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, int]]:
    """(places in ``start``, steps their windows share) of groups with at most ``limit`` suffixes, in order.

    A prefix is a number of steps of packed words.  Small neighbouring groups stay together.
    """
    todo = [(np.arange(len(start)), 0)]
    while todo:
        own, shared = todo.pop()
        if len(own) <= limit or shared == len(seq.steps):
            if len(own):
                yield own, shared
            continue
        key = seq.packed[start[own] + seq.steps[shared]]
        order = np.argsort(key, kind="stable")
        s, e = runs(key[order])
        parts, a = [], 0
        while a < len(s):
            b = max(a + 1, int(np.searchsorted(e, s[a] + limit, "right")))
            parts.append((own[order[s[a] : e[b - 1]]], shared + (b == a + 1)))
            a = b
        todo += reversed(parts)


def nodes(lcp: np.ndarray, least: int) -> np.ndarray:
    """Rows (depth, first leaf, last leaf + 1): internal nodes of depth ``least`` or more, from neighbours' common prefixes."""
    out = [np.zeros((0, 3), np.int64)]
    for depth in np.unique(lcp[lcp >= least]).tolist():
        s, e = runs(lcp >= depth)
        deep = lcp[s] >= depth
        s, e = s[deep], e[deep]
        own = np.minimum.reduceat(np.append(lcp, 0), np.column_stack([s, e]).ravel())[::2] == depth
        out.append(np.column_stack([np.full(int(own.sum()), depth), s[own], e[own] + 1]))
    return np.concatenate(out)


def subtree(seq: Sequence, start: np.ndarray, shared: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(leaves, as places in ``start``, in order; common prefixes of neighbours) of suffixes that share some steps.

    Step by step; only leaves that agree so far, and don't all agree in a step, are sorted by it.
    """
    order, lcp = np.arange(len(start)), np.full(max(len(start) - 1, 0), seq.depth, np.int64)
    branch = np.zeros(len(start), np.int64)  # leaves with one number agree so far
    for step in seq.steps[shared:]:
        key = seq.packed[start[order] + step]
        parted = np.flatnonzero((key[1:] != key[:-1]) & (branch[1:] == branch[:-1]))
        if not len(parted):
            continue
        mixed = np.zeros(int(branch[-1]) + 1, bool)
        mixed[branch[parted]] = True
        some = np.flatnonzero(mixed[branch])
        sort = some[np.lexsort((key[some], branch[some]))]
        order[some], key[some] = order[sort], key[sort]
        parted = np.flatnonzero((key[1:] != key[:-1]) & (branch[1:] == branch[:-1]))
        lcp[parted] = seq.common(start[order[parted]], start[order[parted + 1]], step)
        branch[1:] = np.cumsum((branch[1:] != branch[:-1]) | (key[1:] != key[:-1]))
    return order, lcp


def first_of_kind(ids: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """For each suffix the least place in ``start`` whose window has the same words, -1 if it is the only one."""
    out, seq = np.full(len(start), -1, np.int64), Sequence(ids, window)
    for own, shared in prefix_groups(seq, start, SUBTREE):
        leaves, lcp = subtree(seq, start[own], shared)
        _, a, z = nodes(lcp, window).T  # cut at the window's length: no node lies within another
        if len(a):
            held = own[leaves[spread(a, z - a)]]
            out[held] = np.repeat(np.minimum.reduceat(held, np.cumsum(z - a) - (z - a)), z - a)
    return out


def joined(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the words ``at``, each followed by a space; where each ends)."""
    size = (words.end - words.start)[at]
    source = spread(words.start[at], size)
    out = np.full(len(source) + len(size), 32, np.uint8)
    out[np.arange(len(source)) + np.repeat(np.arange(len(size)), size)] = words.data[source]
    return out, np.cumsum(size + 1)


def cut_repeated_words(df: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, repeats, kept_text) of each row of ``df``.

    ``repeats``: maximal removed stretches as (first word, number of words).
    """
    anchor = min(ANCHOR, window)

    def own_windows(b: Bucket) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of all windows; their hashes; the first window here with the same words, -1 if there is no other)."""
        start, _ = inside(b.bounds, window, 0)
        path = grams(b.tokens, window)[start]
        order = np.argsort(path, kind="stable")
        s, e = runs(path[order])
        maybe = np.sort(order[np.repeat(e - s > 1, e - s)])
        first = np.full(len(start), -1, np.int64)
        if len(maybe):
            covered = np.flatnonzero(cover(start[maybe], np.full(len(maybe), window), len(b.tokens)))
            ids = np.zeros(len(b.tokens), np.int64)
            ids[covered] = exact_ids(b.words, covered)
            found = first_of_kind(ids, start[maybe], window)
            first[maybe] = np.where(found >= 0, maybe[found], -1)
        return start, path, first

    def local(b: Bucket, found: Runs, shared: np.ndarray, hot: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
        start, path, first = own_windows(b)
        # One leaf for this bucket is enough: the others are known to repeat.
        some = np.repeat(shared, found.n) & ((first < 0) | (first == np.arange(len(first))))
        run, warm = np.repeat(np.arange(len(found.n)), found.n), np.repeat(hot, found.n)
        at = np.flatnonzero(some & ~warm)
        s, e = runs(run[at], start[at] - np.arange(len(at)))
        single = np.flatnonzero(some & warm)
        begin = np.concatenate([start[at[s]], start[single]])
        count = np.concatenate([e - s, np.ones(len(single), np.int64)])
        label = np.concatenate([mix(found.anchor[run[at[s]]]), path[single]])
        out = []
        for p, (x, n) in by_part((label % np.uint64(parts)).astype(np.int64), begin, count):
            head = pack(x.astype(np.uint32), n.astype(np.uint32))
            out.append((p, len(head).to_bytes(8, "little") + head + pack(joined(b.words, spread(x, n + window - 1))[0])))
        return out

    def resolve(packets: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
        begin, count, raw = [], [], []
        for _, body in packets:
            cut = 8 + int.from_bytes(body[:8], "little")
            x, n = unpack(body[8:cut], "u4", "u4")
            begin.append(x.astype(np.int64)), count.append(n.astype(np.int64)), raw.append(unpack(body[cut:], "u1")[0])
        source = np.repeat(np.arange(len(packets)), [int(n.sum()) for n in count])
        begin, count, data = map(np.concatenate, (begin, count, raw))
        words = Words(data, np.array([0, len(data)]))
        size = count + window - 1
        start = spread(np.cumsum(size) - size, count)
        again = first_of_kind(exact_ids(words, np.arange(len(words.start))), start, window) >= 0
        return [(packets[k][0], pack(own.astype(np.uint32))) for k, (own,) in by_part(source[again], spread(begin, count)[again])]

    def finish(b: Bucket, _: Runs, answers: list[bytes]) -> pa.Table:
        start, _path, first = own_windows(b)
        at = np.concatenate([start[first >= 0], *(unpack(x, "u4")[0].astype(np.int64) for x in answers)])
        gone = cover(at, np.full(len(at), window), len(b.tokens))
        n, removed = np.diff(b.bounds), np.add.reduceat(np.append(gone, False), b.bounds[:-1], dtype=np.int64) if len(b.bounds) > 1 else []
        removed = np.where(n > 0, removed, 0)
        kept = ~gone
        out, ends = joined(b.words, np.flatnonzero(kept))
        ends = np.concatenate([[0], ends])
        upto = np.concatenate([[0], np.cumsum(kept)])[b.bounds]
        raw = out.tobytes()
        texts = [raw[ends[x] : max(ends[y] - 1, ends[x])].decode() for x, y in zip(upto[:-1], upto[1:], strict=True)]
        return pa.table({"doc_id": b.doc_id, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "repeats": stretches(gone, b.bounds), "kept_text": pa.array(texts, pa.string())})

    return repeats.cut_repeats(df, window, anchor, True, local, resolve, finish, "n_words long, n_removed long, repeats array<struct<begin:bigint,size:bigint>>, kept_text string", BUCKET_BYTES, PART_BYTES, id_column, text_column)


def cover(start: np.ndarray, size: np.ndarray, total: int) -> np.ndarray:
    """Which of ``total`` places lie in one of the stretches."""
    edge = np.bincount(start, minlength=total + 1) - np.bincount(start + size, minlength=total + 1)
    return np.cumsum(edge)[:total] > 0


def stretches(gone: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """For each text its maximal removed stretches, as (begin, size) within it."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    s, e = runs(gone, text) if len(gone) else (np.zeros(0, np.int64),) * 2
    s, e = (s[gone[s]], e[gone[s]]) if len(gone) else (s, e)
    of = text[s] if len(gone) else s
    offsets = np.searchsorted(of, np.arange(len(bounds)))
    inner = pa.StructArray.from_arrays([pa.array(s - bounds[of], pa.int64()), pa.array(e - s, pa.int64())], ["begin", "size"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeated_words(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
