"""Token counts by the whole-token shortcut.

Byte-level BPE splits a text into pre-tokens and merges within each.  Most pre-tokens of real
text are vocabulary entries, but being an entry is not enough: the merges must also arrive at
that entry when the string stands alone.  ``whole_tokens`` proves this once, on the driver, by
encoding every vocabulary string with the library; the set has at most as many members as the
vocabulary, so its broadcast is bounded.  A counter then adds one for each pre-token in the set
and hands only the rest, each distinct string once a batch, to the library's merges.

The split into pre-tokens is done here, with the pattern of the tokenizer's ByteLevel step, its
letter, digit and space classes spelled out for the characters of PLAIN.  Classes depend on the
Unicode version, so texts with other characters are split by the library's own ByteLevel step; their
pre-tokens then take the same way, whole tokens at once and merges for the rest.  Null text counts as
empty: 0 bytes, 0 tokens.  Repeated rows are counted each.  Very long texts are counted whole, one text
at a time.  An empty table gives an empty one.  Ids pass through as they are, nulls included; other
columns are not read.  Ties between merges are the library's.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._common import documents, map_arrow, table

#: The split pattern of byte-level BPE, as the tokenizer file names it.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes the tests prove equal in both libraries.
PLAIN = regex.compile(r"[\x00-ɏ‐-‧€]*")
#: Distinct rest strings remembered in a worker; beyond it the memory starts anew.
REMEMBERED = 400_000


def _spelled(kind: str) -> str:
    """The characters of PLAIN in a class, as ranges."""
    ranges: list[list[int]] = []
    for c in range(0x3000):
        if PLAIN.fullmatch(chr(c)) and regex.fullmatch(kind, chr(c)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)


def _plain_split() -> re.Pattern:
    """PRE_TOKEN for texts of PLAIN, for the standard library's matcher, which is the faster one."""
    letter, digit, space = map(_spelled, (r"\p{L}", r"\p{N}", r"\s"))
    pattern = PRE_TOKEN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{digit}]")
    for name, chars in ((r"\p{L}", letter), (r"\p{N}", digit), (r"\s", space)):
        pattern = pattern.replace(name, f"[{chars}]")
    return re.compile(pattern.replace(r"\S", f"[^{space}]"))


@functools.lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE, by their rule, to bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + n)] = b
    return out


@functools.lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that, standing alone, encode as exactly one token."""
    tok, back = _library(path), byte_alphabet()
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    texts = []
    for piece in tok.get_vocab():
        if piece in special:
            continue
        try:
            texts.append(bytes(back[c] for c in piece).decode())
        except (KeyError, UnicodeDecodeError):  # a part of a character can't stand alone
            continue
    return frozenset(t for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class Counter:
    """Counts tokens of texts; one lives in each Python worker."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tok, self.whole = _library(path), whole
        self.special = regex.compile("|".join(regex.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()) or r"(?!)")
        self.find = _plain_split().findall
        self.stand_ins = str.maketrans({b: c for c, b in byte_alphabet().items()})
        self.extra: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if PLAIN.fullmatch(text):
            return self.find(text)
        found = self.tok.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in found]

    def count(self, texts: list[str]) -> list[int]:
        counts, rests, fresh = [0] * len(texts), [], set()
        for i, text in enumerate(texts):
            pieces = self.special.split(text)
            counts[i], rest = len(pieces) - 1, []
            for piece in pieces:
                found = self.split(piece)
                counts[i] += len(found)
                rest += [p for p in found if p not in self.whole]
            rests.append(rest)
            fresh.update(rest)
        if len(self.extra) > REMEMBERED:
            self.extra.clear()
        merge = self.tok.model.tokenize
        for p in fresh.difference(self.extra):
            self.extra[p] = len(merge(p.encode().decode("latin-1").translate(self.stand_ins))) - 1
        return [n + sum(map(self.extra.__getitem__, rest)) for n, rest in zip(counts, rests, strict=True)]


_counters: dict[str, Counter] = {}


def count_tokens(df: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``df``; over_limit: more than ``limit``."""
    docs = documents(df, id_column, text_column)
    whole = df.sparkSession.sparkContext.broadcast(whole_tokens(path))
    schema = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        if path not in _counters:
            _counters[path] = Counter(path, whole.value)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n = _counters[path].count(texts)
        values = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])]
        return pa.RecordBatch.from_arrays([batch.column(0), *values], names=["doc_id", *schema.names])

    return map_arrow(docs, count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
