"""What the operators of this subpackage share: reading, materialising, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing id where ids are joined; it sorts before all others.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch, so that neither an executor nor its Python workers hold more of long texts at a time.
BATCH_BYTES = "2m"


def bound_batches(spark: SparkSession) -> None:
    """Sets the size of Arrow batches for the session, where it is left at Spark's default."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(name) == default:
        spark.conf.set(name, BATCH_BYTES)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that no other column can clash; a null text is empty."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


#: A column that numbers rows where ids don't tell them apart.
ROW = "_lodestone_row"


def ids_name_rows(docs: DataFrame) -> bool:
    """Whether every row has an id, and one of its own."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return ids.where("n > 1 OR doc_id IS NULL").limit(1).count() == 0


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of its own for each row, by their order. It is written, so that each use of it finds the same numbers."""
    return materialise(docs.withColumn(ROW, F.monotonically_increasing_id()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session must name: a local one would lose rows on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: it cuts lineage, survives lost executors, and the rows are computed once."""
    bound_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for mapInArrow, but what is free at its end goes back to the system: a worker waits for its next task with it otherwise, beside others."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries haven't it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return done


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def matched(rows: DataFrame, of: DataFrame, on: list[str], heavy: Column) -> DataFrame:
    """rows joined with the one row of `of` that has their values of `on`; rows without one go.

    heavy marks those rows of `of` that more than a thousandth of all rows ask for, so that there are fewer than a
    thousand: they are broadcast, and no key that many rows share goes through the exchange.
    """
    hot = F.broadcast(of.where(heavy))
    rest = rows.join(hot.select(*on), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(of.where(~heavy), on))


# --- vectorised hashing of byte ranges -------------------------------------------------

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """BASE**i and BASE**-i modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", BASE), ("down", _UNBASE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


POWERS = Powers()


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range data[start:end]: equal ranges have equal hashes wherever they stand."""
    POWERS.grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS.up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * POWERS.down[start] + (end - start).astype(np.uint64))


def word_bounds(data: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't spaces; is_space is a table of 256 flags."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(is_space[data], out=inside[1:-1])
    return np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BLOCK = 1 << 20


def word_hashes(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word (a run of other than ASCII white space, A-Z in lower case) of all texts, one after the other, its last two bytes as a number, and the number of words of each text. Work is done in blocks of about BLOCK bytes, however long a text is."""
    hashes: list[np.ndarray] = []
    endings: list[np.ndarray] = []
    counts = np.zeros(len(docs), np.int64)
    block: list[bytes] = []
    first, held = 0, 0

    def add(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        hashes.append(range_hashes(data, start, end))
        endings.append(data[end - 1].astype(np.int64) | (data[np.maximum(end - 2, start)].astype(np.int64) << 8))

    def flush(last: int) -> None:
        nonlocal block, first, held
        if block:
            data = np.frombuffer(b" ".join(block), np.uint8)
            start, end = word_bounds(data, SPACE)
            ends = np.cumsum([len(b) + 1 for b in block])
            counts[first:last] += np.diff(np.searchsorted(start, ends), prepend=0)
            add(data, start, end)
        block, first, held = [], last, 0

    for i, doc in enumerate(docs):
        raw = doc.encode("utf-8", "replace").lower()
        if len(raw) <= BLOCK:
            block.append(raw)
            held += len(raw)
            if held >= BLOCK:
                flush(i + 1)
            continue
        flush(i)
        for part in _cut_at_spaces(raw):
            data = np.frombuffer(part, np.uint8)
            start, end = word_bounds(data, SPACE)
            counts[i] += len(start)
            add(data, start, end)
        first = i + 1
    flush(len(docs))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    return np.concatenate(hashes), np.concatenate(endings), counts


def _cut_at_spaces(raw: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        while end < len(raw) and not SPACE[raw[end]]:
            end += 1
        parts.append(raw[at:end])
        at = end
    return parts


def shingle_sets(docs: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of `width` words, or of all its words if it has fewer, or none."""
    words, _, counts = word_hashes(docs)
    ends = np.cumsum(counts)
    n = len(words)
    shingles = np.zeros(n, np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    for k in range(min(width, n)):
        shingles[: n - k] = shingles[: n - k] * factor + words[k:] if k else words
    shingles = mix(shingles)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= width:
            out.append(np.unique(shingles[end - count : end - width + 1]))
        elif count:
            own = np.uint64(count)
            with np.errstate(over="ignore"):
                for w in words[end - count : end]:
                    own = own * factor + w
            out.append(mix(np.array([own ^ np.uint64(0x5851F42D4C957F2D)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about `most` bytes of that column at most, a longer row by itself."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", least: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, put together until they hold `least` bytes of that column; what is larger comes in slices of about as much, a longer row by itself."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for b in slices(whole, column, least):
            held.append(b)
            size += pc.sum(pc.binary_length(b.column(column))).as_py() or 0
            if size >= least:
                yield pa.concat_batches(held)
                held, size = [], 0
    if size or any(b.num_rows for b in held):
        yield pa.concat_batches(held)


def distinct_words(docs: pa.Array, separator: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What stands between separators in all texts: the distinct words, each place's number among them, and the number of places of each text."""
    cut = pc.split_pattern(docs, separator)
    words = cut.flatten().dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)


def spread(flat: np.ndarray, start: np.ndarray, lengths: np.ndarray, codes: np.ndarray, counts: np.ndarray, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """What a text of words becomes if word w is the lengths[w] numbers of flat from start[w] on: all texts' numbers, and how many each text has. Words are placed a block at a time."""
    ends = np.cumsum(lengths[codes])
    out = np.empty(ends[-1] if len(ends) else 0, flat.dtype)
    for i in range(0, len(codes), block):
        own = codes[i : i + block]
        each, upto = lengths[own], ends[i : i + block]
        lo, hi = upto[0] - each[0], upto[-1]
        out[lo:hi] = flat[np.repeat(start[own] - (upto - each), each) + np.arange(lo, hi)]
    upto = np.concatenate([np.zeros(1, np.int64), ends])[np.cumsum(counts)]
    return out, np.diff(upto, prepend=0)
