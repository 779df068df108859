"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad.  A line's features are counted on its bytes (shares of
letters, capitals, digits, symbols and spaces, word lengths, repeated words, repeated lines),
beside those of the lines before and after it; the chain adds how labels follow one another.
Forward-backward gives each line's probability of being good, and a text's score is their
mean, weighted by the lines' lengths.

Lines end at line feeds; a null or empty text is one empty line and is scored like any other.
The field is fitted on the driver to a bounded sample of labelled rows (SAMPLE documents, a
parameter), each line taking its document's label, all lines of a document in their order; only the
lines' features come to the driver.  Of labelled ids that have a document those with the least hash are
the sample (ties by id); an id with several rows gives one of them, by a hash of the text.  The same
tables give the same field.  Labels, language, source and id are never inputs of a score.  Repeated rows
score alike.  Without any labelled row the score is 0.5 for all; a score of 0.5 is good.  An empty table
gives an empty one.  Very long texts are scored whole.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Words, documents, map_arrow, small_batches, table, text_chunks, utf8

#: Labelled documents that the field is fitted on.
SAMPLE = 2_000
_KIND = np.zeros(256, np.int64)  # 0: other control, 1: lower, 2: upper, 3: digit, 4: space, 5: plain stops, 6: symbol, 7: beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 7
_KIND[[9, 11, 12, 13, 32]] = 4
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 6
_KIND[[ord(c) for c in ".,;:'?-"]] = 5
N_OWN = 18


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, bounds): of each line, its length in bytes, and each text's range of lines."""
    breaks = np.flatnonzero(data == 10)
    text_of = np.searchsorted(off, breaks, "right") - 1
    n = np.bincount(text_of, minlength=len(off) - 1) + 1 if len(off) > 1 else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    lines = int(bounds[-1])
    start = np.empty(lines, np.int64)
    start[bounds[:-1]] = off[:-1]
    first = np.zeros(lines, bool)
    first[bounds[:-1]] = True
    start[~first] = breaks + 1
    end = np.empty(lines, np.int64)
    last = np.zeros(lines, bool)
    last[bounds[1:] - 1] = True
    end[last], end[~last] = off[1:], breaks
    size = end - start
    line_of = np.repeat(np.arange(lines), size)
    kept = data[data != 10]
    counts = np.bincount(line_of * 8 + _KIND[kept], minlength=8 * lines).reshape(-1, 8)
    words = Words(data, off)
    of = np.searchsorted(start, words.start, "right") - 1  # an empty text's line starts where the next begins, and has no words
    total = np.bincount(of, minlength=lines)
    length = words.end - words.start
    closing = _KIND[data[words.end - 1]] if len(length) else np.zeros(0, np.int64)
    capital = _KIND[data[words.start]] == 2 if len(length) else np.zeros(0, bool)
    order = np.lexsort((words.hash, of))
    again = np.zeros(len(order), bool)
    if len(order) > 1:
        again[1:] = (np.diff(of[order]) == 0) & (words.hash[order][1:] == words.hash[order][:-1])
    repeat = np.bincount(of[order][again], minlength=lines)
    with np.errstate(over="ignore"):
        begin = np.searchsorted(of, np.arange(lines))
        turn = np.arange(1, len(of) + 1, dtype=np.uint64) - np.repeat(begin, total).astype(np.uint64)
        mark = np.bincount(of, ((words.hash ^ (turn * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(24)).astype(np.float64), minlength=lines)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((mark, doc))
    same = np.zeros(lines, bool)
    if lines > 1:
        equal = (np.diff(doc[order]) == 0) & (np.diff(mark[order]) == 0) & (total[order][1:] > 0)
        same[order[1:][equal]] = same[order[:-1][equal]] = True
    share = counts / np.maximum(size, 1)[:, None]
    per = 1 / np.maximum(total, 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    own = np.stack([
        *share[:, 1:].T,
        counts[:, 2] / letters,
        np.log1p(size) / 5, np.log1p(total) / 4,
        np.bincount(of, length, minlength=lines) * per / 8,
        np.bincount(of, length > 20, minlength=lines) * per,
        np.bincount(of, closing == 6, minlength=lines) * per,
        np.bincount(of, (length == 1) & (closing == 6), minlength=lines) * per,
        np.bincount(of, capital, minlength=lines) * per,
        repeat * per, same, (total == 0),
    ], axis=1).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][~first[1:]] = own[:-1][~first[1:]]
    after[:-1][~last[:-1]] = own[1:][~last[:-1]]
    edge = np.stack([first, last], axis=1).astype(np.float32)
    return np.hstack([own, before, after, edge]), np.maximum(size, 1), bounds


@dataclass
class Field:
    """Weights of a line's being good, and the gain of two neighbours' sharing a label."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    stay: np.ndarray  # log potentials [from, to]

    def unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias


def _lse(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1)
    return top + np.log(np.exp(x - top[..., None]).sum(axis=-1))


def forward_backward(unary: np.ndarray, stay: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of each line, log Z of each text, expected counts of label pairs summed over all).

    Texts advance together, one line a step; those with fewer lines drop out.
    """
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    sizes = n[order]
    potential = np.stack([np.zeros_like(unary), unary], axis=1).astype(np.float64)
    alpha, beta = potential.copy(), np.zeros_like(potential)
    starts, ends = bounds[:-1][order], bounds[1:][order] - 1
    # How many texts have a line at each step.
    steps = np.searchsorted(-sizes, -np.arange(1, int(n.max(initial=0)) + 1), "right").tolist()
    for t in range(1, len(steps)):
        at = starts[: steps[t]] + t
        alpha[at] += _lse(alpha[at - 1][:, None, :] + stay.T[None])
    for t in range(len(steps) - 1, 0, -1):
        at = starts[: steps[t]] + t
        beta[at - 1] = _lse((potential[at] + beta[at])[:, None, :] + stay[None])
    log_z = np.empty(len(n))
    log_z[order] = _lse(alpha[ends]) if len(n) else 0
    z = np.repeat(log_z, n)
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - z, 0))
    later = np.ones(len(unary), bool)
    later[bounds[:-1]] = False
    at, pairs = np.flatnonzero(later), np.zeros((2, 2))
    if len(at):
        joint = alpha[at - 1][:, :, None] + stay[None] + (potential[at] + beta[at])[:, None, :] - z[at][:, None, None]
        pairs = np.exp(joint).sum(axis=0)
    return good, log_z, pairs


def fit(x: np.ndarray, bounds: np.ndarray, label: np.ndarray, steps: int = 150, ridge: float = 2e-3) -> Field:
    """Maximum of the conditional likelihood, each text weighted alike and both labels alike, by Adam."""
    n = np.diff(bounds)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = ((x - mean) / scale).astype(np.float64)
    y = np.repeat(label, n).astype(np.float64)
    share = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1)) / n
    per_line = np.repeat(share, n)
    theta = np.zeros(z.shape[1] + 1 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    later = n - 1  # pairs of neighbouring lines
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = later[label == k].sum()
    scale_pairs = 1 / max(later.sum(), 1)
    for step in range(1, steps + 1):
        stay = theta[-4:].reshape(2, 2)
        good, _, pairs = forward_backward(z @ theta[:-5] + theta[-5], stay, bounds)
        miss = (y - good) * per_line
        grad = np.concatenate([z.T @ miss, [miss.sum()], ((seen - pairs) * scale_pairs).ravel()])
        grad[:-5] -= ridge * theta[:-5]
        grad[-4:] -= 0.2 * theta[-4:]  # one label a document says little about how lines differ within one
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(mean, scale, theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """Field fitted to at most ``sample`` labelled documents, picked by a hash of their id."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = known.join(docs.select("doc_id"), "doc_id", "left_semi")  # labels without a document don't use up the sample
    chosen = held.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, _, bounds = line_features(*utf8(batch.column(1)))
        out = [x[a:b].astype(np.float32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(out, pa.binary())], names=["doc_id", "label", "lines"])

    joined = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "quality")
    one = joined.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.max("quality").alias("label")).select("doc_id", "t.text", "label")
    rows = sorted(map(tuple, map_arrow(one, lines, "doc_id string, label int, lines binary").collect()))
    if not rows:
        return None
    parts = [np.frombuffer(r[2], np.float32).reshape(-1, 3 * N_OWN + 2) for r in rows]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return fit(np.vstack(parts), bounds, np.array([r[1] for r in rows]))


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, score, predicted, n_lines) of each row of ``docs`` (doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, n_lines = doc_scores(batch.column(1), field)
        values = [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array(n_lines, pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), *values], names=["doc_id", "score", "predicted", "n_lines"])

    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, n_lines long")


def doc_scores(texts: pa.Array, field: Field | None) -> tuple[np.ndarray, np.ndarray]:
    x, weight, bounds = line_features(*utf8(texts))
    if field is None:
        return np.full(len(bounds) - 1, 0.5), np.diff(bounds)
    good, _, _ = forward_backward(field.unary(x), field.stay, bounds)
    total = np.add.reduceat(good * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1]) if len(good) else np.zeros(0)
    return np.clip(total, 0, 1), np.diff(bounds)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_good(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``df`` (any columns beside doc_id and text) that the fitted field predicts to be good."""
    field = learn(documents(df), labels.where(~held_out()))

    @F.pandas_udf("double")
    def good(texts):
        p = [doc_scores(part, field)[0] for part in text_chunks(texts)]
        return texts.__class__(np.concatenate(p) if p else np.zeros(0))

    small_batches(df.sparkSession)
    return df.where(good("text") >= 0.5)


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    scored = score(docs, learn(docs, labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_lines")
