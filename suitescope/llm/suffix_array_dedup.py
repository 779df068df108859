"""Substring dedup over bytes by blockwise suffix arrays with a difference cover.

Of the corpus only stretches of bytes with an anchor that other documents hold are sorted (see
``repeats``), dealt to parts by that anchor, or one string at a time by itself where the anchor is hot;
those that several documents of one bucket hold are sorted there.  Equal stretches are sorted once,
stretches without any window hash in common with another not at all.

``cover_ranks`` first ranks the suffixes at positions that are 1, 2 or 4 modulo 7, a difference cover,
by doubling.  Then all suffixes are sorted one block at a time: a block holds those whose first seven
bytes lie in a range.  Any two suffixes meet at covered positions within six bytes, so in a block the
suffixes of each residue are ordered by seven bytes and a rank, and the seven orders are merged by the
ranks at which two residues meet.  Ties of any length are thus settled by ranks, and beside the text and
the ranks of three positions in seven only one block's numbers are held.  Suffixes that share 50 bytes,
compared as bytes, are neighbours in the array; the least document id among them keeps the string.
Hashes only leave out stretches that cannot repeat; no byte is removed on their account.

Every byte covered by a 50-byte string that also starts in a document with a smaller id is removed;
strings are judged on the input.  Null text is empty, texts shorter than 50 bytes stay whole.  Rows that
share an id are one document here: a string is never removed on account of its own id.  A null id is
greater than all others; text ids are ordered as text.  Very long texts take memory in proportion to
their length in one task.  Tied documents, with equal strings and one id, all keep them.  An empty table
gives an empty one.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from ._common import BYTE, eights, grams, mix, table
from .repeats import Bucket, Runs, by_part, pack, runs, spread, unpack, window_hashes
from .suffix_tree_dedup import stretches

LENGTH, ANCHOR = 50, 20
BUCKET_BYTES = 2_000_000
PART_BYTES = 6_000_000
#: Suffixes sorted at a time; more only where they share their first bytes.
BLOCK = 200_000
#: A difference cover: for any two residues there is a step that takes both into it.
CYCLE, COVER = 7, (1, 2, 4)
MEET = np.array([[next(d for d in range(CYCLE) if (a + d) % CYCLE in COVER and (b + d) % CYCLE in COVER) for b in range(CYCLE)] for a in range(CYCLE)])
_SLOT = np.array([COVER.index(r) if r in COVER else -1 for r in range(CYCLE)])


def first_bytes(text: np.ndarray) -> np.ndarray:
    """The first CYCLE bytes from each position on as one number; what is past the end is less than any byte."""
    n = len(text)
    t = np.concatenate([text.astype(np.int64) + 1, np.zeros(CYCLE, np.int64)])
    out = np.zeros(n, np.int64)
    for k in range(CYCLE):
        out = out << 9 | t[k : k + n]
    return out


class Cover:
    """Ranks of the suffixes at covered positions, made once for a text; 0 past its end."""

    def __init__(self, text: np.ndarray, first: np.ndarray):
        n, size = len(text), len(COVER)
        at = np.flatnonzero(_SLOT[np.arange(n) % CYCLE] >= 0)
        slot = self._slots(at)
        self.rank = np.zeros(self._slots(np.array([n + 2 * CYCLE]))[0] // size * size + 2 * size, np.int32)
        own, width = first[at], CYCLE
        while len(at):
            names, place = np.unique(own, return_inverse=True)
            self.rank[slot] = place + 1
            if len(names) == len(at):
                break
            later = np.minimum(slot + width // CYCLE * size, len(self.rank) - 1)  # the last is past the end
            own = self.rank[slot] * np.int64(n + 2) + self.rank[later]
            width *= 2

    @staticmethod
    def _slots(at: np.ndarray) -> np.ndarray:
        return at // CYCLE * len(COVER) + _SLOT[at % CYCLE]

    def at(self, position: np.ndarray) -> np.ndarray:
        return self.rank[self._slots(position)]


def blocks(key: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Places in ``key`` of one range of keys after another, at most ``limit`` at a time unless keys are the same."""
    if not len(key):
        return
    some = np.sort(key[:: max(1, len(key) // 4096)])
    cuts = np.unique(some[np.linspace(0, len(some) - 1, -(-len(key) // limit) + 1).astype(np.int64)[1:-1]])
    of = np.searchsorted(cuts, key, "right")
    order = np.argsort(of, kind="stable")
    s, e = runs(of[order])
    for a, z in zip(s, e, strict=True):
        own = order[a:z]
        low, high = key[own].min(), key[own].max()
        if len(own) <= limit or low == high:
            yield own
        else:  # an uneven range: cut in two at its middle, so that it ends
            half = key[own] <= low + (high - low) // 2
            for part in (own[half], own[~half]):
                yield from (part[x] for x in blocks(key[part], limit))


def sort_block(cover: Cover, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places in ``at`` in the order of the suffixes there; ``key``: their first bytes."""
    _, head = np.unique(key, return_inverse=True)
    top = np.int64(int(cover.rank.max(initial=0)) + 1)
    residue = at % CYCLE
    held, keys = [], []
    for r in range(CYCLE):  # a residue's suffixes in order, and their ranks at the steps that take it into the cover
        own = np.flatnonzero(residue == r)
        own = own[np.argsort(head[own] * top + cover.at(at[own] + MEET[r, r]), kind="stable")]
        held.append(own)
        keys.append({d: head[own] * top + cover.at(at[own] + d) for d in set(MEET[r].tolist())})
    out = np.empty(len(at), np.int64)
    for r, own in enumerate(held):
        place = np.arange(len(own))
        for q in range(CYCLE):
            if q != r:
                place += np.searchsorted(keys[q][MEET[r, q]], keys[r][MEET[r, q]])
        out[place] = own
    return out


def sorted_blocks(text: np.ndarray, at: np.ndarray, limit: int, together: int = CYCLE) -> Iterator[np.ndarray]:
    """Places in ``at`` in the order of the suffixes of ``text`` from there, block by block.

    Suffixes that share ``together`` bytes are in one block.
    """
    first = first_bytes(text)
    cover = Cover(text, first)
    key = first[at]
    for own in blocks(key >> (9 * max(CYCLE - together, 0)), limit):
        yield own[sort_block(cover, at[own], key[own])]


def suffix_order(text: np.ndarray, limit: int = BLOCK) -> np.ndarray:
    """Positions of ``text`` in the order of what follows."""
    at = np.arange(len(text))
    return np.concatenate([at[:0], *sorted_blocks(text, at, limit)])


def share_prefix(eight: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from a and from b are the same, for each pair of positions; ``eight``: ``eights`` of the text."""
    same = np.ones(len(a), bool)
    for k in range(0, length, 8):
        live = np.flatnonzero(same)
        left = min(8, length - k)
        same[live] = ((eight[a[live] + k] ^ eight[b[live] + k]) << np.uint64(64 - 8 * left)) == 0
    return same


def least_ids(text: np.ndarray, start: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each window (position in ``text``, document id) the least id among equal windows."""
    out, eight = np.empty(len(start), np.int64), eights(text)
    for order in sorted_blocks(text, start, BLOCK, length):  # equal windows are in one block
        at = start[order]
        linked = share_prefix(eight, at[:-1], at[1:], length)
        group = np.concatenate([[0], np.cumsum(~linked)])
        cuts, _ = runs(group)
        out[order] = np.minimum.reduceat(ids[order], cuts)[group]
    return out


def least_by_name(pieces: list[bytes], holder: np.ndarray, length: int) -> np.ndarray:
    """The least id of every window of distinct stretches, one stretch after another.

    A stretch none of whose windows has a hash that another's window has is left out of the array.
    """
    size = np.array([len(p) for p in pieces], np.int64)
    base, windows = np.cumsum(size) - size, size - length + 1
    text = np.frombuffer(b"".join(pieces), np.uint8)
    name = np.repeat(np.arange(len(pieces)), windows)
    at = spread(base, windows)
    least = holder[name]
    h = grams(BYTE[text], length)[at]
    order = np.argsort(h, kind="stable")
    s, e = runs(h[order])
    again = np.zeros(len(pieces), bool)
    again[name[order[np.repeat(e - s > 1, e - s)]]] = True
    some = np.flatnonzero(again)
    if len(some):
        part = np.frombuffer(b"".join(pieces[k] for k in some), np.uint8)
        starts = spread(np.cumsum(size[some]) - size[some], windows[some])
        least[again[name]] = least_ids(part, starts, np.repeat(holder[some], windows[some]), length)
    return least


def held_by_less(pieces: list[bytes], ids: np.ndarray, length: int) -> np.ndarray:
    """For every window of the stretches, one after another, whether a smaller id than its stretch's holds it."""
    names: dict[bytes, int] = {}
    name = np.array([names.setdefault(p, len(names)) for p in pieces], np.int64)
    holder = np.full(len(names), 2**63 - 1, np.int64)
    np.minimum.at(holder, name, ids)
    least = least_by_name(list(names), holder, length)
    windows = np.array([len(p) for p in names], np.int64) - length + 1
    begin, count = np.cumsum(windows) - windows, windows[name]
    return least[spread(begin[name], count)] < np.repeat(ids, count)


def cut_repeated_bytes(df: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept binary) of each row of ``df``.

    ``removed``: maximal removed stretches as (first byte, number of bytes).
    """
    anchor = min(ANCHOR, length)

    def known(b: Bucket, found: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(runs that may share a window with another document here, their windows, which of those a smaller id here holds)."""
        order = np.lexsort((found.text, found.anchor))
        s, e = runs(found.anchor[order])
        several = np.zeros(len(order), bool)
        several[order] = np.repeat(found.text[order[s]] != found.text[order[e - 1]], e - s) if len(s) else False
        several = np.flatnonzero(several)
        run = np.repeat(np.arange(len(several)), found.n[several])
        at = spread(found.start[several], found.n[several])
        h, owner = window_hashes(b, length, at), b.ids[found.text[several]][run]
        order = np.lexsort((owner, h))
        s, e = runs(h[order])
        maybe = np.zeros(len(several), bool)
        if len(s):
            maybe[run[order[np.repeat(owner[order[s]] != owner[order[e - 1]], e - s)]]] = True
        several = several[maybe]
        if not len(several):
            return several, at[:0], np.zeros(0, bool)
        raw = b.data.tobytes()
        pieces = [raw[x:z] for x, z in zip(found.start[several].tolist(), (found.start[several] + found.n[several] + length - 1).tolist(), strict=True)]
        return several, spread(found.start[several], found.n[several]), held_by_less(pieces, b.ids[found.text[several]], length)

    def local(b: Bucket, found: Runs, shared: np.ndarray, hot: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
        several, _, gone = known(b, found)
        n = found.n[several]
        # A run whose windows a smaller id here holds has its answer; the smaller one asks.
        asks = shared.copy()
        if len(n):
            asks[several] &= np.add.reduceat(~gone, np.cumsum(n) - n) > 0
        cold, warm = np.flatnonzero(asks & ~hot), np.flatnonzero(asks & hot)
        at = spread(found.start[warm], found.n[warm])
        text = np.concatenate([found.text[cold], np.repeat(found.text[warm], found.n[warm])])
        start = np.concatenate([found.start[cold], at])
        count = np.concatenate([found.n[cold], np.ones(len(at), np.int64)])
        label = np.concatenate([mix(found.anchor[cold]), window_hashes(b, length, at)])
        out = []
        for p, (own, s, c) in by_part((label % np.uint64(parts)).astype(np.int64), b.ids[text], start, count):
            size = c + length - 1
            head = pack(own, s.astype(np.uint32), c.astype(np.uint32))
            out.append((p, len(head).to_bytes(8, "little") + head + pack(b.data[spread(s, size)])))
        return out

    def resolve(packets: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
        ids, start, count, source, pieces = [], [], [], [], []
        for k, (_, body) in enumerate(packets):
            cut = 8 + int.from_bytes(body[:8], "little")
            own, s, c = unpack(body[8:cut], "i8", "u4", "u4")
            raw = unpack(body[cut:], "u1")[0].tobytes()
            ends = np.cumsum(c.astype(np.int64) + length - 1)
            pieces += [raw[z - m : z] for z, m in zip(ends.tolist(), (c.astype(np.int64) + length - 1).tolist(), strict=True)]
            ids.append(own), start.append(s.astype(np.int64)), count.append(c.astype(np.int64)), source.append(np.full(len(s), k))
        ids, start, count, source = map(np.concatenate, (ids, start, count, source))
        lost = held_by_less(pieces, ids, length)
        where, of = spread(start, count)[lost], np.repeat(source, count)[lost]
        out = []
        for k, (w,) in by_part(of, where):
            w = np.sort(w)
            s, e = runs(w - np.arange(len(w)))
            out.append((packets[k][0], pack(w[s].astype(np.uint32), (e - s).astype(np.uint32))))
        return out

    def finish(b: Bucket, found: Runs, answers: list[bytes]) -> pa.Table:
        edge = np.zeros(len(b.data) + 1, np.int32)
        _, at, gone = known(b, found)
        np.add.at(edge, at[gone], 1)
        np.add.at(edge, at[gone] + length, -1)
        for body in answers:
            s, n = (x.astype(np.int64) for x in unpack(body, "u4", "u4"))
            np.add.at(edge, s, 1)
            np.add.at(edge, s + n + length - 1, -1)
        lost = np.cumsum(edge)[:-1] > 0
        n = np.diff(b.off)
        upto = np.concatenate([[0], np.cumsum(~lost)])[b.off]
        raw = b.data[~lost].tobytes()
        kept = [raw[x:y] for x, y in zip(upto[:-1], upto[1:], strict=True)]
        return pa.table({"doc_id": b.doc_id, "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(n - np.diff(upto), pa.int64()), "removed": stretches(lost, b.off), "kept": pa.array(kept, pa.binary())})

    return repeats.cut_repeats(df, length, anchor, False, local, resolve, finish, "n_bytes long, n_removed long, removed array<struct<begin:bigint,size:bigint>>, kept binary", BUCKET_BYTES, PART_BYTES, id_column, text_column)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeated_bytes(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
