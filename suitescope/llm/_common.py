"""What the text operators share: table reading, byte-exact word splitting and rolling hashes.

Everything here works on whole texts.  A null text is an empty text.  Words are the
maximal runs of bytes outside ``0x20, 0x09-0x0D``; those bytes are all ASCII, so the split
is the same on UTF-8 bytes as on code points.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python.  Texts differ in length by four orders of
#: magnitude, so batches are small and ``chunks`` cuts them again by bytes.
BATCH_ROWS = 256
BATCH_BYTES = 4_000_000
#: Bytes of text that one vectorised step works on.
CHUNK_BYTES = 2_000_000
#: Bytes of words that are hashed at a time.
HASHED_BYTES = 500_000
#: White space that separates words in every contract here.
SPACE = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Python worker holds; read when a plan is built."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``f`` over each batch cut to about CHUNK_BYTES of its column ``text``."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield f(part)

    return df.mapInArrow(run, schema)


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text; a longer text stands alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(size) - size
    start = 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(before + size, before[start] + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def text_chunks(texts) -> Iterator[pa.Array]:
    """The texts of a pandas Series, null as empty, about CHUNK_BYTES at a time; a longer one stands alone."""
    column = pa.array([t if isinstance(t, str) else "" for t in texts], pa.string())
    for part in chunks(pa.RecordBatch.from_arrays([column], names=["text"])):
        yield part.column(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and the n+1 offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _random_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, 256, dtype=np.uint64)


#: A random 64-bit value for each byte, the odd base of the rolling polynomial over values, and odd steps.
BYTE = _random_table(7919)
BASE = np.uint64(0xD1342543DE82EF95)
STEP, PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros beyond the end, as one number; also at the end itself."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", buffer=padded.data, strides=(1,))


def stretches_of(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of items with about ``limit`` of size each; a larger item stands alone."""
    end = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(end, end[a] - sizes[a] + limit, "right")))
        yield a, b
        a = b


def word_blocks(eight: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks of eight bytes of all words, the last of a word filled with zeros; each one's place in its word; where words begin)."""
    n = (size + 7) >> 3
    begin = np.cumsum(n) - n
    turn = np.arange(int(n.sum())) - np.repeat(begin, n)
    left = np.repeat(size, n) - 8 * turn
    value = eight[np.repeat(start, n) + 8 * turn]
    cut = np.flatnonzero(left < 8)
    value[cut] &= np.uint64(2**64 - 1) >> (8 * (8 - left[cut])).astype(np.uint64)
    return value, turn, begin


class Words:
    """The words of a batch of texts: byte spans, 64-bit hashes, and each text's range."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, inner: np.ndarray | None = None):
        """``inner``: which of the 256 bytes words are made of, instead of all but white space."""
        self.data, self.off = data, off
        word = ~_IS_SPACE[data] if inner is None else inner[data]
        first = np.zeros(len(data) + 1, bool)
        first[off] = True
        before = np.zeros(len(data), bool)
        after = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        after[:-1] = word[1:]
        self.start = np.flatnonzero(word & (~before | first[:-1]))
        self.end = np.flatnonzero(word & (~after | first[1:])) + 1
        #: Words of text i are bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.start, off)
        self.hash = np.zeros(len(self.start), np.uint64)
        size = self.end - self.start
        eight = eights(_LOWER[data] if lower else data)
        # Each block is mixed with its place and their sum is mixed again: no polynomial, whose values
        # agree for regular words however random its base.  Some words at a time, to bound memory.
        for a, b in stretches_of(size, HASHED_BYTES):
            value, turn, begin = word_blocks(eight, self.start[a:b], size[a:b])
            with np.errstate(over="ignore"):
                value = mix(mix(value + STEP) + PLACE * (turn + 1).astype(np.uint64))
                self.hash[a:b] = mix(np.add.reduceat(value, begin) + STEP * size[a:b].astype(np.uint64))


def exact_ids(words: Words, at: np.ndarray) -> np.ndarray:
    """A number from 0 on for each of the words ``at``, the same just where the words' bytes are.

    Hashes only bring equal words together; every word is compared with the first of its hash.
    """
    start, size, key = words.start[at], (words.end - words.start)[at], words.hash[at]
    order = np.argsort(key, kind="stable")
    s, e = runs(key[order])
    out = np.empty(len(at), np.int64)
    out[order] = np.repeat(np.arange(len(s)), e - s)
    like = np.empty(len(at), np.int64)
    like[order] = np.repeat(order[s], e - s)
    same, eight = bool((size == size[like]).all()), eights(words.data)
    for a, b in stretches_of(size, HASHED_BYTES):
        if not same:
            break
        mine, _, _ = word_blocks(eight, start[a:b], size[a:b])
        theirs, _, _ = word_blocks(eight, start[like[a:b]], size[a:b])
        same = bool((mine == theirs).all())
    if same:
        return out
    names: dict[bytes, int] = {}  # different words with one hash
    raw = words.data.tobytes()
    return np.array([names.setdefault(raw[x : x + n], len(names)) for x, n in zip(start.tolist(), size.tolist(), strict=True)], np.int64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for each i; the last n-1 (and those that cross texts) mean nothing."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, done, power, width, at = None, 0, h, 1, BASE
    with np.errstate(over="ignore"):
        while n:
            if n & 1:
                if out is None:
                    out, done = power, width
                else:
                    m = len(h) - done - width + 1
                    out, done = out[:m] * at + power[done : done + m], done + width
            n >>= 1
            if n:
                m = len(power) - width
                power, width, at = power[:m] * at + power[width:], 2 * width, at * at
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i."""
    if len(x) < w:
        return x[:0]
    width = 1
    while 2 * width <= w:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    rest = w - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def inside(bounds: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all n-long windows that stay within one text, and the text of each.

    ``bounds`` are the texts' offsets in a sequence of ``total`` items.
    """
    count = np.maximum(np.diff(bounds) - n + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[:-1], count)
    return start, text


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches over which all keys stay the same."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(n - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    start = np.concatenate([[0], np.flatnonzero(change) + 1])
    return start, np.concatenate([start[1:], [n]])


def by_text(batch: pa.RecordBatch, schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Just the id and the text, whatever else the table holds."""
    return df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def integral(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def numbered(df: DataFrame, id_column: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """(``df`` with ``name``, a long that orders rows as the ids do, null where the id is; and (id, ``name``) of all ids).

    Integral ids are their own numbers (then the second is None).  Others, such as text, are sorted by
    ranges and numbered in that order, in a written table.
    """
    if integral(df, id_column):
        return df.withColumn(name, F.col(id_column).cast("long")), None
    ids = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id")).distinct()
    ids = checkpointed(ids.repartitionByRange("_id").sortWithinPartitions("_id").withColumn(name, F.monotonically_increasing_id()), "ids")
    return df.join(ids, df[id_column] == ids["_id"], "left").drop("_id"), ids


_written: list[tuple[SparkSession, str]] = []


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share; one is chosen here only where none is set and all run on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = given.get() if given.isDefined() else None
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        top = "/tmp/suitescope-checkpoints"
    return top.rstrip("/")


def checkpointed(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it again: the lineage ends there.

    Files go when ``forget`` is called or the driver ends.
    """
    spark = df.sparkSession
    path = f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(remove_written)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame) -> None:
    """Delete the table that ``checkpointed`` gave as ``df``; nothing may read it any more."""
    entry = (df.sparkSession, df._written_at)
    _written.remove(entry)
    _remove(*entry)


def remove_written() -> None:
    """Delete all tables that ``checkpointed`` wrote in this session's life."""
    while _written:
        try:
            _remove(*_written.pop())
        except Exception:  # noqa: BLE001  the session has ended already; the folder is scratch space
            continue


def input_bytes(df: DataFrame, text_column: str = "text") -> int:
    """Bytes of all texts: one scan of one column, used to size partitions."""
    return int(df.agg(F.sum(F.octet_length(text_column))).first()[0] or 0)
