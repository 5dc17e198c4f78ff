"""Packing tokenised documents into sequences of a fixed length, by bounded-space online best-fit.

A fixed number of bins is open. Each stands in a bitset under its free space, so that the tightest bin that still
holds a piece is the lowest set bit from the piece's length on. When a piece fits nowhere and all bins are open, the
fullest closes and a new one opens. Pieces are placed as they come, in order of their documents. Groups are dealt by a hash of the piece,
so a sequence never waits for another task; what a group leaves underfull at its end is a fixed number of bins.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import distinct_words, gathered, materialise, spread, texts, tidy

PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


#: Stands between words that are encoded together: a token of its own, and of no text without it.
MARK = "\x01"


class WordTokens:
    """Ids as the tokenizer gives them. No match of its pattern crosses a blank or a line end, or goes from a letter to a full stop and the like, so what stands between them is encoded once for all texts of a batch; the first `kept` words, among them the frequent ones, once a worker. Words and ids stand in Arrow and numpy arrays, of which a worker holds a few bytes a word."""

    def __init__(self, path: str, kept: int = 200_000) -> None:
        self.lib, self.kept = Tokenizer.from_file(path), kept
        self.words, self.flat, self.lengths = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        (self.mark,) = self.lib.encode(MARK, add_special_tokens=False).ids

    def learn(self, words: pa.Array, together: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and the number of each word's. Words are encoded a thousand together, as one text with marks between them; where one holds a mark, each by itself."""
        flat, lengths = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(words), together):
            part = words.slice(i, together).to_pylist()
            if any(MARK in w for w in part):
                each = [np.array(e.ids, "<u4") for e in self.lib.encode_batch_fast(part, add_special_tokens=False)]
                flat += each
                lengths.append(np.fromiter(map(len, each), np.int64, len(each)))
            else:
                (e,) = self.lib.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)
                ids = np.array(e.ids, "<u4")
                marks = ids == self.mark
                flat.append(ids[~marks])
                lengths.append(np.diff(np.concatenate([[-1], np.flatnonzero(marks), [len(ids)]])) - 1)
        return np.concatenate(flat), np.concatenate(lengths)

    def encode(self, docs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each text's."""
        words, codes, counts = distinct_words(pc.replace_substring_regex(pc.replace_substring(docs, "\n", " "), "([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?*#%&$])", r"\1 \2"), " ")
        words = words.cast(pa.string())  # the session may ask for large ones
        place = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(place))
        own, each = self.learn(new)
        held = len(self.words)
        at = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = held + np.arange(len(new))
        flat, lengths = np.concatenate([self.flat, own]), np.concatenate([self.lengths, each])
        if more := min(len(new), self.kept - held):
            self.words, self.lengths = pa.concat_arrays([self.words, new.slice(0, more)]), lengths[: held + more].copy()
            self.flat = flat[: self.lengths.sum()].copy()
        start = np.cumsum(lengths) - lengths
        return spread(flat, start[at], lengths[at], codes, counts)


_WORDS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One a worker process, since loading takes a second."""
    if path not in _WORDS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core already
        _WORDS[path] = WordTokens(path)
    return _WORDS[path]


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's ids and then end_id, cut into pieces of size ids where longer.

    A null or empty text is end_id alone. Rows that repeat are documents of their own, told apart by copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = word_tokens(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in gathered(batches, least=2 << 20):
            ids, counts = own.encode(b.column("text"))
            rows, at = [], 0
            for doc, copy, n in zip(b.column("doc_id").to_pylist(), b.column("copy").to_pylist(), counts.tolist(), strict=True):
                own_ids = ids[at : at + n].tobytes() + end
                at += n
                for k, i in enumerate(range(0, len(own_ids), 4 * size)):
                    part = own_ids[i : i + 4 * size]
                    rows.append((doc, copy, k, i // 4, len(part) // 4, zlib.crc32(part)))
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "copy", "piece", "start", "length", "ids_crc32"])

    return texts(docs).withColumn("copy", F.monotonically_increasing_id()).mapInArrow(tidy(run), PIECES)


def best_fit(lengths: list[int], size: int, n_open: int) -> tuple[list[int], list[int]]:
    """The bin of each length, and the place there."""
    by_free: list[list[int]] = [[] for _ in range(size + 1)]
    bits, used, opened = 0, 0, 0  # bit f: some open bin has f free
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for k, n in enumerate(lengths):
        if fits := bits >> n:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                bits ^= 1 << free
        else:
            if opened >= n_open:  # the fullest closes
                fullest = (bits & -bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    bits ^= 1 << fullest
                opened -= 1
            b, free, used, opened = used, size, used + 1, opened + 1
        where[k], offset[k] = b, size - free
        free -= n
        if free:
            by_free[free].append(b)
            bits |= 1 << free
        else:
            opened -= 1
    return where, offset


def pack(cut: DataFrame, size: int = 2048, n_open: int = 1024, group_rows: int = 65_536, rows: int | None = None) -> DataFrame:
    """Places each piece in a sequence. rows: the number of pieces, or of documents, if it is known; it sets the number of groups of about group_rows each.

    No piece may be longer than size. An empty table gives none.
    """
    n_groups = max(1, -(-(cut.count() if rows is None else rows) // group_rows))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "copy", "piece"], kind="stable")  # an order of its own, whatever the exchange brings first
        where, offset = best_fit(group["length"].tolist(), size, n_open)
        return group.assign(sequence_id=group["bucket"].iloc[0] * (1 << 32) + np.array(where, "int64"), offset=offset).drop(columns="bucket")

    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(n_groups)))
    return dealt.groupBy("bucket").applyInPandas(place, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack; the pieces are written once, since sizes of groups follow from their number."""
    cut = materialise(pieces(docs, tokenizer, size, end_id))
    return pack(cut, size).drop("copy")
