"""Language identification with bit-sliced Bloom filters over character n-grams.

All languages' Bloom filters lie side by side: slot s of one table holds a bitmask of the languages whose filter has
bit s set, so that the AND of an n-gram's slots is the mask of all languages that (seem to) contain it. A text's
n-grams are counted for each language by the bits of these masks; the share of n-grams that a filter admits by
chance, known from how full it is, is taken off; the language with the most left wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialise, mix, slices, texts, tidy

UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double"


@dataclass(frozen=True)
class Config:
    """sample_docs bounds the labelled rows of each language that the filters are fitted on; min_share: an n-gram belongs to a language if its rate there is this share of its highest rate in any, and if it occurs there min_count times, or that times total / min_of where the language's n-grams are fewer than min_of in total."""

    n: int = 3
    sample_docs: int = 1500
    min_count: int = 5
    min_of: int = 10_000
    min_share: float = 0.5
    max_ngrams: int = 50_000
    slots_log2: int = 20
    hashes: int = 3


@dataclass(frozen=True)
class Filters:
    """tables: a bitmask of 64 languages for each slot, as many as it takes; by_chance: for each language the rate at which its filter admits an n-gram it doesn't hold."""

    languages: list[str]
    tables: list[np.ndarray]
    by_chance: np.ndarray
    config: Config


def _letters(texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, 0 for what is no letter, each run of those once; and each text's number at every place."""
    joined = ("\0".join(texts_) + "\0").lower() if texts_ else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.cumsum(codes == 0) - (codes == 0)
    if np.count_nonzero(codes == 0) != len(texts_):  # a text holds the separator itself
        return _letters([t.replace("\0", " ") for t in texts_])
    is_letter = _LETTER[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first other character after a letter stands for all that follow
    keep |= codes == 0
    return np.where(is_letter, codes, 0)[keep].astype(np.uint64), owner[keep]


_LETTER = np.zeros(0x110000, bool)
_LETTER[[c for c in range(0x110000) if chr(c).isalpha()]] = True


def ngrams(texts_: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each n-gram of letters and word ends that ends within a word or right after it, and the number of its text."""
    codes, owner = _letters(texts_)
    codes = np.concatenate([np.zeros(1, np.uint64), codes])
    owner = np.concatenate([np.zeros(1, np.int64), owner])
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        key = (key << np.uint64(21)) | codes[i : len(codes) - n + 1 + i]
    inner = codes[1 : len(codes) - n + 2] != 0  # the second character is a letter
    if n > 2:
        for i in range(1, n - 1):
            inner &= codes[i : len(codes) - n + 1 + i] != 0
    return key[inner], owner[n - 1 :][inner] if n == 1 else owner[1 : len(codes) - n + 2][inner]


def _slots(key: np.ndarray, config: Config) -> Iterator[np.ndarray]:
    h = mix(key)
    for i in range(config.hashes):
        yield ((h >> np.uint64(i * config.slots_log2)) & np.uint64((1 << config.slots_log2) - 1)).astype(np.int64)


def fit(labelled: DataFrame, config: Config = Config()) -> Filters:
    """Filters from rows of (text, lang), without null languages: at most about sample_docs distinct texts of each, chosen by their hash, and of these n-grams at most max_ngrams a language, the most frequent.

    Only these n-grams, and their counts for each language that has them, reach the driver. Every language counts, in
    masks of 64, and one of little text keeps n-grams that are rarer in proportion. Without labelled rows there is no language, and every prediction is und.
    """
    bound_batches(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("of_text", F.xxhash64("text"))
    # Texts are told apart by their hash, so that a large group of copies counts once.
    sizes = {r["lang"]: r["n"] for r in rows.select("lang", "of_text").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    tables = [np.zeros(1 << config.slots_log2, np.uint64) for _ in range(0, len(languages), 64)]
    if not languages:
        return Filters([], tables, np.zeros(0), config)
    share = rows.sparkSession.createDataFrame([(k, min(1.0, config.sample_docs / sizes[k])) for k in languages], "of_lang string, share double")
    unit = F.col("of_text").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    chosen = rows.join(F.broadcast(share), F.col("lang") == F.col("of_lang")).where(unit < F.col("share"))  # a row a language
    sample = chosen.groupBy("lang", "of_text").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, most=1 << 20):
                langs = np.array(b.column("lang").to_pylist(), object)
                docs = b.column("text").to_pylist()
                for lang in sorted(set(langs)):
                    own = [docs[i] for i in np.flatnonzero(langs == lang)]
                    key, n = np.unique(ngrams(own, config.n)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts = materialise(sample.mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rate = counts.withColumn("total", F.sum("n").over(Window.partitionBy("lang"))).withColumn("rate", F.col("n") / F.col("total"))
    best = rate.withColumn("best", F.max("rate").over(Window.partitionBy("gram")))
    own = best.where((F.col("n") >= config.min_count * F.least(F.lit(1.0), F.col("total") / config.min_of)) & (F.col("rate") >= config.min_share * F.col("best")))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    held = own.withColumn("place", first).where(F.col("place") <= config.max_ngrams).select("lang", "gram").toArrow()
    langs, grams = held["lang"].to_numpy(), held["gram"].to_numpy().view(np.uint64)
    fill = np.zeros(len(languages))
    for i, k in enumerate(languages):
        table, bit = tables[i // 64], np.uint64(i % 64)
        for s in _slots(grams[langs == k], config):
            table[s] |= np.uint64(1) << bit
        fill[i] = float(np.mean((table >> bit) & np.uint64(1)))
    return Filters(languages, tables, fill**config.hashes, config)


def predict_batch(docs: list[str], filters: Filters) -> tuple[list[str], np.ndarray]:
    """The language of each text, and its score: the corrected share of the text's n-grams that the language holds."""
    key, owner = ngrams(docs, filters.config.n)
    slots = list(_slots(key, filters.config))
    masks = [np.bitwise_and.reduce([table[s] for s in slots]) for table in filters.tables]
    total = np.bincount(owner, minlength=len(docs)).astype(float)
    held = np.zeros((len(filters.languages), len(docs)))
    for i in range(len(filters.languages)):
        held[i] = np.bincount(owner[(masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1) != 0], minlength=len(docs))
    chance = filters.by_chance[:, None]
    share = np.clip((held / np.maximum(total, 1) - chance) / np.maximum(1 - chance, 1e-9), 0, 1)
    if not len(filters.languages):
        return [UNKNOWN] * len(docs), np.zeros(len(docs))
    best = share.argmax(0)
    return [filters.languages[b] if t and any(map(str.isalpha, d)) else UNKNOWN for b, t, d in zip(best.tolist(), total, docs, strict=True)], np.where(total > 0, share[best, np.arange(len(docs))], 0.0)


def _predicted(b: pa.RecordBatch, filters: Filters) -> tuple[list[str], np.ndarray]:
    return predict_batch(pc.fill_null(b.column("text"), "").to_pylist(), filters)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """lang_pred and score of every row's whole text: und and 0 where it is null or has no letter.

    Nothing but the text is looked at; rows that repeat get the same. Of languages with equal scores, 0 for all
    among them, the first in alphabetical order is taken. Texts are worked on in slices of about a megabyte, a longer one by itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 8 bytes a slot and 64 languages, whatever the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, most=1 << 20):
                langs, scores = _predicted(b, shared.value)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(tidy(run), SCHEMA)


def keep_identified(docs: DataFrame, filters: Filters, least: float = 0.1) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is known with a score of at least `least`."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, most=1 << 20):
                langs, scores = _predicted(b, shared.value)
                yield b.filter(pa.array([k != UNKNOWN and s >= least for k, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidy(flag), T.StructType(docs.schema.fields))
