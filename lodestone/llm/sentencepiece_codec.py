"""Encoding and decoding with a merge-type SentencePiece vocabulary.

The agenda: all adjacent symbol pairs whose concatenation is a piece, in order of that piece's score, the leftmost
first among equals. The best pair merges, its two neighbouring pairs are looked up anew, until no pair is left. Words
(split before each word mark) never share a piece, so the agenda runs over all new words of an Arrow batch at once,
as a matrix with one word a row, and each word is worked out once a worker.

Every new word is also encoded by the sentencepiece library; words on which the two differ are counted in n_differing
(none in any test). The ids are the agenda's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import slices, texts, tidy

MARK = "▁"
LONG_WORD = 64
SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string, n_differing long"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_differing long"


class Codec:
    """cache_chars bounds the memory of the words worked out so far."""

    def __init__(self, model: str, cache_chars: int = 6_000_000) -> None:
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        self.byte_id = {}
        self.pieces: dict[str, int] = {}
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.pieces[piece] = i
        if len(self.byte_id) != 256:
            raise ValueError("a vocabulary with byte fallback is needed")
        self.n = n
        self.char_id = np.full(0x110000, -1, np.int32)
        pairs: dict[int, int] = {}
        for piece, i in self.pieces.items():
            if len(piece) == 1:
                self.char_id[ord(piece)] = i
            for k in range(1, len(piece)):
                left, right = self.pieces.get(piece[:k]), self.pieces.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * n + right] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        scores = [lib.get_score(i) for i in range(n)]
        steps = {x: r for r, x in enumerate(sorted(set(scores)))}
        self.rank_of = [steps[x] for x in scores]  # equal scores have equal ranks
        self.pair_piece = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.pair_rank = np.array([self.rank_of[i] for i in self.pair_piece.tolist()], np.int32)
        self.ints = list(range(n))  # one object a number
        self.decimals = list(map(str, range(n)))
        if lib.normalize("a") != MARK + "a" or any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a vocabulary whose words start with a mark is needed, without marks inside pieces")
        self.pairs = pairs
        self.cache_chars, self.cached = cache_chars, 0
        self.cache: dict[str, tuple[int, ...]] = {}
        self.differing = 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair forms, -1 where none."""
        keys = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_rank[at], -1)

    def agenda(self, words: list[str]) -> list[list[int]]:
        """Ids of words of one length. A row holds a word's symbols, and a second matrix the ranks of its pairs."""
        n, width = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, width).astype(np.int32)
        ids = self.char_id[codes]
        ids = np.where(ids < 0, -2 - codes, ids)  # a character without a piece, for byte fallback
        left = np.full(n, width)
        if width > 1:
            rank = self.ranks(ids[:, :-1], ids[:, 1:])
            live, row, cols = np.arange(n), ids.copy(), np.arange(width)[None, :]
            while len(live):
                best = rank.argmax(1)
                more = rank[np.arange(len(live)), best] >= 0
                if not more.all():
                    ids[live[~more]] = row[~more]
                    live, row, rank, best = live[more], row[more], rank[more], best[more]
                    if not len(live):
                        break
                each = np.arange(len(live))
                pair = row[each, best].astype(np.int64) * self.n + row[each, best + 1]
                row[each, best] = self.pair_piece[np.searchsorted(self.pair_keys, pair)]
                src = np.minimum(cols + (cols > best[:, None]), width - 1)
                row = np.take_along_axis(row, src, 1)
                row[:, -1] = -1  # a place that's free
                rank = np.take_along_axis(rank, np.minimum(src[:, :-1], width - 2), 1)
                rank[:, -1] = -1
                for at in (best - 1, best):
                    ok = np.flatnonzero((at >= 0) & (at < width - 1))
                    rank[ok, at[ok]] = self.ranks(row[ok, at[ok]], row[ok, at[ok] + 1])
                left[live] -= 1
        return [self.finish(r[:k]) for r, k in zip(ids.tolist(), left.tolist(), strict=True)]

    def finish(self, symbols: list[int]) -> list[int]:
        if min(symbols, default=0) >= 0:
            return symbols
        return list(chain.from_iterable([s] if s >= 0 else [self.byte_id[b] for b in chr(-2 - s).encode()] for s in symbols))

    def heap_agenda(self, word: str) -> list[int]:
        """The same for one long word: a heap of pairs over a linked list of symbols."""
        ids = [int(i) if i >= 0 else -2 - ord(c) for c, i in zip(word, self.char_id[list(map(ord, word))], strict=True)]
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap: list[tuple[float, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (m := self.pair_of(ids[i], ids[j])) >= 0:
                heappush(heap, (-self.rank_of[m], i, j, m, ids[i] * self.n + ids[j]))

        for i in range(len(ids) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, m, key = heappop(heap)
            if ids[i] is None or ids[j] is None or after[i] != j or ids[i] * self.n + ids[j] != key:
                continue
            ids[i], ids[j] = m, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return self.finish([i for i in ids if i is not None])

    def pair_of(self, left: int, right: int) -> int:
        return self.pairs.get(left * self.n + right, -1) if left >= 0 and right >= 0 else -1

    def learn(self, words: set[str]) -> None:
        """Work out new words, and compare with the library."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, same in by_length.items():
            block = max(1, 60_000 // (length + 1))
            for i in range(0, len(same), block):
                part = same[i : i + block]
                marked = [MARK + w for w in part]
                own = self.agenda(marked) if length < LONG_WORD else map(self.heap_agenda, marked)
                for w, ids, check in zip(part, own, self.library(part), strict=True):
                    self.differing += ids != check
                    self.cache[w] = tuple([self.ints[i] for i in ids])

    def library(self, words: list[str]) -> list[list[int]]:
        """The library puts a mark before each word; of an empty word nothing would be left, and the mark is a piece itself."""
        found = self.lib.encode([w.replace(MARK, " ") for w in words], num_threads=1)
        return [ids if w else [self.lib.piece_to_id(MARK)] for w, ids in zip(words, found, strict=True)]

    def split(self, text: str) -> list[str]:
        """The words of the normalised text, each without the mark it begins with."""
        s = self.lib.normalize(text)
        if not s:
            return []
        if MARK + MARK not in s and s[-1] != MARK:
            return s[1:].split(MARK)
        return [w[1:] for w in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", s)]

    def encode(self, docs: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        cut = [self.split(t) for t in docs]
        found = [list(map(self.cache.get, words)) for words in cut]
        new = {w for words, own in zip(cut, found, strict=True) if None in own for w, f in zip(words, own, strict=True) if f is None}
        if new:
            if (more := sum(map(len, new))) + self.cached > self.cache_chars:
                self.cache, self.cached = {}, 0
                new = set(chain.from_iterable(cut))
                more = sum(map(len, new))
            self.cached += more
            self.learn(new)
        for words, own in zip(cut, found, strict=True):
            yield list(chain.from_iterable(map(self.cache.__getitem__, words) if None in own else own))

    def in_decimals(self, ids: list[int]) -> str:
        return ",".join(map(self.decimals.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """One a worker process, so that words stay known from task to task."""
    if model not in _CODECS:
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from slices(b, most=4 << 20)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Ids and decoded text of every row's whole text.

    A null text is empty: no ids, an empty decoded text. Rows that repeat are encoded each; other columns don't matter.
    Texts are worked on in slices of about four megabytes, a longer one by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for b in _batches(batches):
            before = own.differing
            ids = list(own.encode(b.column("text").to_pylist()))
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([own.lib.decode(i) if i else "" for i in ids], pa.string()), pa.array([own.differing - before] + [0] * (n - 1) if n else [], pa.int64())],
                names=["doc_id", "n_tokens", "ids", "decoded", "n_differing"],
            )

    return texts(docs).mapInArrow(tidy(run), SCHEMA)


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """The same, with SHA-256 of the decimal ids joined by commas and of the decoded text in place of both; n_differing stands at the first row of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for b in _batches(batches):
            before, rows = own.differing, []
            for ids in own.encode(b.column("text").to_pylist()):
                decoded = own.lib.decode(ids) if ids else ""
                rows.append((len(ids), hashlib.sha256(own.in_decimals(ids).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            n, ids_sha, text_sha = zip(*rows, strict=True) if rows else ((), (), ())
            fixed = [own.differing - before] + [0] * (len(rows) - 1) if rows else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(fixed, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_differing"])

    return texts(docs).mapInArrow(tidy(run), DIGESTS)
