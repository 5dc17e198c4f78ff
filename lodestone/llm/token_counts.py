"""Token counts of byte-level BPE that follow edits.

A document is a sequence of pre-tokens, each with a number of tokens of its own. A segment tree over blocks of
pre-tokens holds sums of code points and tokens. An edit finds its blocks by a walk down the tree; pre-tokens are cut
anew from a little before the edit (a cut can depend on the pre-token after it) until a cut falls where one stood
before; only these are encoded, and the sums above the blocks touched are updated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

BLOCK = 128
CONTEXT = 3  # pre-tokens before an edit that are cut anew
SCHEMA = "doc_id long, n_chars long, n_tokens long, n_edits long, edited_n_chars long, edited_n_tokens long, n_reencoded long"


class PreTokens:
    """Cuts text by the tokenizer's pattern, and counts the tokens of each pre-token; counts are kept, up to a bound."""

    def __init__(self, ranks: str, pattern: str, kept: int = 300_000) -> None:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern, self.kept = regex.compile(pattern), kept
        self.known: dict[str, int] = {}

    def count(self, pieces: list[str]) -> list[int]:
        if len(self.known) > self.kept:
            self.known = {}
        found = list(map(self.known.get, pieces))
        for i, n in enumerate(found):
            if n is None:
                n = self.known.get(pieces[i])
                if n is None:
                    n = self.known[pieces[i]] = len(self.lib._encode_single_piece(pieces[i]))
                found[i] = n
        return found


class CountedText:
    """One document. Blocks hold the lengths and token counts of their pre-tokens; chars and tokens are heaps of sums over them."""

    def __init__(self, text: str, cut: PreTokens, pieces: list[str] | None = None) -> None:
        self.text, self.cut, self.encoded = text, cut, 0
        pieces = cut.pattern.findall(text) if pieces is None else pieces
        self._build(list(map(len, pieces)), cut.count(pieces))

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.blocks = [(lengths[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(lengths), BLOCK)] or [([], [])]
        self.leaves = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        for i, (a, b) in enumerate(self.blocks):
            self.chars[self.leaves + i], self.tokens[self.leaves + i] = sum(a), sum(b)
        for i in range(self.leaves - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds code point `at` (the last one at the end), and where it begins."""
        i, begin = 1, 0
        while i < self.leaves:
            i *= 2
            if at - begin >= self.chars[i] and begin + self.chars[i] < self.chars[1]:
                begin += self.chars[i]
                i += 1
        return min(i - self.leaves, len(self.blocks) - 1), begin

    def replace(self, start: int, end: int, new: str) -> None:
        """Put `new` in place of the code points start..end; places beyond the text mean its end."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        first, begin = self._find(max(start - 1, 0))
        lengths, counts = self.blocks[first]
        k, at = 0, begin
        while k < len(lengths) and at + lengths[k] < start:
            at += lengths[k]
            k += 1
        while k < CONTEXT and first:  # the context reaches into the block before
            first -= 1
            before = self.blocks[first]
            begin -= sum(before[0])
            k += len(before[0])
            lengths, counts = before[0] + lengths, before[1] + counts
        at = begin + sum(lengths[: max(0, k - CONTEXT)])
        k = max(0, k - CONTEXT)
        # Old cuts from the first place on that can serve as a joint again.
        shift = len(new) - (end - start)
        old_text, self.text = self.text, self.text[:start] + new + self.text[end:]
        block, old = first, at
        own = self._from(first, k, begin, at)
        pieces: list[str] = []
        pos, joint = at, None
        match = self.cut.pattern.match
        while True:
            if pos >= end + shift:
                while old < pos - shift and (step := next(own, None)) is not None:
                    old, block = step
                if old == pos - shift and old >= end:
                    joint = (old, block)
                    break
            if pos >= len(self.text):
                joint = (len(old_text), len(self.blocks) - 1)
                break
            pieces.append(match(self.text, pos).group())
            pos += len(pieces[-1])
        self.encoded += len(pieces)
        kept_before = self._upto(first, at)
        last, tail = self._tail(joint, first)
        new_counts = self.cut.count(pieces)
        self._put(first, last, kept_before[0] + list(map(len, pieces)) + tail[0], kept_before[1] + new_counts + tail[1])

    def _from(self, block: int, k: int, begin: int, at: int) -> Iterator[tuple[int, int]]:
        """Ends of the old pre-tokens after place `at`, with their blocks."""
        end = begin
        for b in range(block, len(self.blocks)):
            for n in self.blocks[b][0]:
                end += n
                if end > at:
                    yield end, b

    def _begin(self, block: int) -> int:
        i, begin = self.leaves + block, 0
        while i > 1:
            if i % 2:
                begin += self.chars[i - 1]
            i //= 2
        return begin

    def _upto(self, block: int, at: int) -> tuple[list[int], list[int]]:
        lengths, counts = self.blocks[block]
        end, k = self._begin(block), 0
        while end < at:
            end += lengths[k]
            k += 1
        return lengths[:k], counts[:k]

    def _tail(self, joint: tuple[int, int], first: int) -> tuple[int, tuple[list[int], list[int]]]:
        """The last block touched, and what stands in it after the joint."""
        at, block = joint
        block = max(block, first)
        lengths, counts = self.blocks[block]
        end, k = self._begin(block), 0
        while k < len(lengths) and end < at:
            end += lengths[k]
            k += 1
        return block, (lengths[k:], counts[k:])

    def _put(self, first: int, last: int, lengths: list[int], counts: list[int]) -> None:
        if len(lengths) > 4 * BLOCK * (last - first + 1):  # too much for these blocks: build all anew
            before, after = self.blocks[:first], self.blocks[last + 1 :]
            self._build([n for b in before for n in b[0]] + lengths + [n for b in after for n in b[0]], [n for b in before for n in b[1]] + counts + [n for b in after for n in b[1]])
            return
        self.blocks[first] = (lengths, counts)
        for b in range(first + 1, last + 1):
            self.blocks[b] = ([], [])
        touched = {self.leaves + b for b in range(first, last + 1)}
        for i in touched:
            a, b = self.blocks[i - self.leaves]
            self.chars[i], self.tokens[i] = sum(a), sum(b)
        while touched := {i // 2 for i in touched if i > 1}:
            for i in touched:
                self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]


_CUTS: dict[str, PreTokens] = {}


def pre_tokens(ranks: str, pattern: str) -> PreTokens:
    """One a worker process, since loading takes a second."""
    if ranks not in _CUTS:
        _CUTS[ranks] = PreTokens(ranks, pattern)
    return _CUTS[ranks]


EDITS = "array<struct<start: bigint, end: bigint, text: string>>"


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with a column of each document's edits, from rows (doc_id, seq, start, end, text); a join by doc_id, so that either side may be large."""
    own = edits.groupBy(F.col("doc_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text"))).alias("edits"))
    own = own.select("of", F.transform("edits", lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["text"].alias("text"))).alias("edits"))
    return docs.select("doc_id", "text").join(own, F.col("doc_id") == F.col("of"), "left").drop("of")


def count(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Tokens of every row's whole text before and after its edits (doc_id, text, edits), which are applied in order, each to what the ones before left.

    n_reencoded: the pre-tokens that were cut and encoded for the edits. A null text is empty, null edits are none, an
    edit's null text is empty and its null places are the start. Rows that repeat are counted each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("edits").cast(EDITS).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = pre_tokens(ranks, pattern)
        for whole in batches:
            for b in slices(whole):
                out = []
                for text, edits in zip(b.column("text").to_pylist(), b.column("edits").to_pylist(), strict=True):
                    doc = CountedText(text, cut)
                    before = doc.n_tokens
                    for e in edits or ():
                        if e is not None:
                            doc.replace(e["start"] or 0, e["end"] or 0, e["text"] or "")
                    out.append((len(text), before, len(edits or ()), len(doc.text), doc.n_tokens, doc.encoded))
                cols = np.array(out, np.int64).reshape(-1, 6).T
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, cols)], names=["doc_id", "n_chars", "n_tokens", "n_edits", "edited_n_chars", "edited_n_tokens", "n_reencoded"])

    return rows.mapInArrow(tidy(run), SCHEMA)
