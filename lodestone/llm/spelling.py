"""Spelling variants: words of a corpus one edit apart, by range reporting in two dimensions.

A word u arises from w by an edit at place i if it begins with w's first i code points and ends with the rest. Words
that begin so are an interval of all words in order, words that end so an interval of them in reversed order; a wavelet
tree over the one order's places in the other reports what lies in both. As both intervals fix every code point but one,
what is reported is near: no pair is made that isn't.

Words are dealt into cells. A cell (m, lo, hi) holds words of m and m + 1 code points that share the first lo and all after
the first hi, for edits at the places lo to hi - 1 of the shorter one; two cells cover all edits of a word. A cell that
many words share is halved until it is small: where its width is one, an alphabet bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise, partitions, tidy


@dataclass(frozen=True)
class Config:
    min_length: int = 5
    min_count: int = 3
    #: A word's form has at least so many times its count.
    ratio: int = 2
    #: Words that a cell may hold before it is halved, and that are worked on at once.
    most: int = 32_768
    #: Cells halved in a round at most, so that what is broadcast is bounded; there are as many rounds as it takes.
    at_once: int = 1000


#: What a run of letters is.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, word) of every maximal run of letters of Latin-1 in the whole texts, A-Z in lower case; a null text has none."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("word"))


def misspelt(words: DataFrame, one_in: int = 97) -> Column:
    """The word, or with one code point less where crc32 of `doc_id:word` tells so; a null doc_id is no text there."""
    h = F.crc32(F.concat(F.coalesce(words["doc_id"].cast("string"), F.lit("")), F.lit(":"), words["word"]))
    at = F.pmod(h, F.length(words["word"])).cast("int")
    less = F.concat(F.substring(words["word"], F.lit(1), at), F.substring(words["word"], at + 2, F.length(words["word"])))
    return F.when(h % one_in == 0, less).otherwise(words["word"])


def counted(words: DataFrame, config: Config = Config()) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; counts are combined inside tasks first."""
    own = words.where(F.length("word") >= config.min_length).groupBy("word").agg(F.count("*").alias("n"))
    return own.where(F.col("n") >= config.min_count)


def _cell(m: Column, lo: Column, hi: Column, longer: Column) -> Column:
    """A cell, and a number that stands for it and what its words share: a clash of numbers only puts cells together."""
    shared = F.struct(F.substring("word", F.lit(1), lo), F.substring("word", hi + 1 + longer.cast("int"), F.length("word")))
    return F.struct(m.alias("m"), lo.alias("lo"), hi.alias("hi"), longer.alias("longer"), F.xxhash64(m, lo, hi, shared).alias("cell"))


def cells(vocabulary: DataFrame, config: Config) -> DataFrame:
    """(word, n, m, lo, hi, longer, cell): each word in two cells as the shorter of a pair and in two as the longer."""
    n, no = F.length("word"), F.lit(False)
    half = F.floor(n / 2).cast("int")
    half_less = F.floor((n - 1) / 2).cast("int")
    zero = F.lit(0)
    four = F.array(_cell(n, zero, half, no), _cell(n, half, n + 1, no), _cell(n - 1, zero, half_less, F.lit(True)), _cell(n - 1, half_less, n, F.lit(True)))
    rows = materialise(vocabulary.select("word", "n", F.inline(four)))
    while True:
        sizes = rows.where(F.col("hi") - F.col("lo") > 1).groupBy("m", "lo", "hi", "cell").agg(F.count("*").alias("size"))
        large = materialise(sizes.where(F.col("size") > config.most).orderBy(F.desc("size")).limit(config.at_once).drop("size"))
        if not large.limit(1).count():
            return rows
        met = rows.join(F.broadcast(large.withColumn("large", F.lit(True))), ["m", "lo", "hi", "cell"], "left")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(_cell(F.col("m"), F.col("lo"), mid, F.col("longer")), _cell(F.col("m"), mid, F.col("hi"), F.col("longer")))
        split = met.where("large").select("word", "n", F.inline(halves))
        rows = materialise(met.where("large IS NULL").select("word", "n", "m", "lo", "hi", "longer", "cell").unionByName(split))


class Wavelet:
    """A wavelet tree over distinct numbers, one array of counts a bit: which of the numbers at places lo to hi - 1 lie in a range."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.bits = max(1, int(len(numbers) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for b in reversed(range(self.bits)):
            zero = (numbers >> b) & 1 == 0
            upto = np.zeros(len(numbers) + 1, np.int32)
            np.cumsum(zero, out=upto[1:])
            self.zeros.append(upto)
            numbers = np.concatenate([numbers[zero], numbers[~zero]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, number) with the number at lo <= place < hi and least <= number < most; all queries go down the tree together."""
        query, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for b, upto in zip(reversed(range(self.bits)), self.zeros, strict=True):
            lo0, hi0, all0 = upto[lo], upto[hi], upto[-1]
            lo = np.concatenate([lo0, all0 + lo - lo0])
            hi = np.concatenate([hi0, all0 + hi - hi0])
            query = np.concatenate([query, query])
            value = np.concatenate([value, value | (1 << b)])
            stays = (hi > lo) & (value < most[query]) & (value + (1 << b) > least[query])
            lo, hi, query, value = lo[stays], hi[stays], query[stays], value[stays]
        return query, value


class _Order:
    """Words of two lengths in order: the interval of those that share the first i code points with each."""

    def __init__(self, codes: np.ndarray) -> None:
        width = codes.shape[1]
        self.order = np.argsort(np.ascontiguousarray(codes).view(f"S{width}").ravel(), kind="stable")
        ranked = codes[self.order]
        differs = ranked[1:] != ranked[:-1]
        self.common = np.concatenate([[-1], np.where(differs.any(1), differs.argmax(1), width), [-1]]) if len(codes) else np.array([-1, -1])
        self.place = np.empty(len(codes), np.int64)
        self.place[self.order] = np.arange(len(codes))

    def interval(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """By place: where the words begin and end that share i code points."""
        cuts = np.flatnonzero(self.common < i)
        group = np.searchsorted(cuts, np.arange(len(self.order)), "right")
        return cuts[group - 1], cuts[group]


def near(codes: np.ndarray, longer: np.ndarray, m: int, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of numbers of words, each once, of an edit at a place from lo to hi - 1 of the shorter word.

    codes: a row of bytes a word, those of m of them with a 0 at the end, the longer ones with m + 1. Two replacements of
    one word by each other are given once; of equal insertions side by side, the first counts.
    """
    n = len(codes)
    backward = codes[:, ::-1].copy()
    backward[~longer, :m], backward[~longer, m] = codes[~longer, :m][:, ::-1], 0
    fore, back = _Order(codes), _Order(backward)
    sides = {}
    for kind in (False, True):
        # Words of one length alone, by their places among all.
        in_fore, in_back = longer[fore.order] == kind, longer[back.order] == kind
        upto_fore, upto_back = np.concatenate([[0], np.cumsum(in_fore)]), np.concatenate([[0], np.cumsum(in_back)])
        words = fore.order[in_fore]
        sides[kind] = upto_fore, upto_back, back.order[in_back], Wavelet(upto_back[back.place[words]]) if len(words) else None
    asking = np.flatnonzero(~longer)
    for i in range(lo, hi):
        begin, end = fore.interval(i)
        begin, end = begin[fore.place[asking]], end[fore.place[asking]]
        for kind, rest in ((False, m - i - 1), (True, m - i)):
            upto_fore, upto_back, named, tree = sides[kind]
            if rest < 0 or tree is None:
                continue
            least, most = back.interval(rest)
            least, most = upto_back[least[back.place[asking]]], upto_back[most[back.place[asking]]]
            first, last = upto_fore[begin], upto_fore[end]
            # A word alone in one of the intervals has no other there.
            may = np.flatnonzero(np.minimum(last - first, most - least) > (0 if kind else 1))
            query, value = tree.report(first[may], last[may], least[may], most[may])
            a, b = asking[may][query], named[value]
            keep = (codes[b, i] != codes[a, i - 1]) if kind and i else (np.ones(len(a), bool) if kind else a < b)
            yield a[keep], b[keep]


def _best(words: list[str], n: np.ndarray, longer: np.ndarray, m: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with any near one, how many, and the best of them: the most frequent, of equal ones the first in order. Takes the pairs place by place."""
    codes = np.zeros((len(words), m + 1), np.uint8)
    codes[longer] = np.frombuffer("".join(w for w, x in zip(words, longer, strict=True) if x).encode("latin-1"), np.uint8).reshape(-1, m + 1)
    codes[~longer, :m] = np.frombuffer("".join(w for w, x in zip(words, longer, strict=True) if not x).encode("latin-1"), np.uint8).reshape(-1, m)
    standing = np.empty(len(words), np.int64)
    ranked = np.lexsort((np.argsort(np.argsort(codes.view(f"S{m + 1}").ravel())), -n))
    standing[ranked] = np.arange(len(words))
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    for a, b in near(codes, longer, m, lo, hi):
        count += np.bincount(a, minlength=len(words)) + np.bincount(b, minlength=len(words))
        np.minimum.at(best, a, standing[b])
        np.minimum.at(best, b, standing[a])
    found = np.flatnonzero(count)
    return found, count[found], ranked[best[found]]


def _found(rows: DataFrame, config: Config) -> DataFrame:
    """(word, near, best_n, best): what each cell finds for each of its words."""
    bound_batches(rows.sparkSession)
    names = ["word", "n", "m", "lo", "hi", "longer", "cell"]

    def worked(held: pa.Table) -> pa.RecordBatch | None:
        cell = held.column("cell").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(cell)]]))
        held = held.filter(pa.array(np.repeat(sizes, sizes) > 1))
        if not held.num_rows:
            return None
        words, n, longer = held.column("word").to_pylist(), held.column("n").to_numpy(), held.column("longer").to_numpy()
        found, count, best = _best(words, n, longer, *(held.column(c)[0].as_py() for c in ("m", "lo", "hi")))
        return pa.RecordBatch.from_arrays([held.column("word").combine_chunks().take(pa.array(found)), pa.array(count), pa.array(n[best]), held.column("word").combine_chunks().take(pa.array(best))], ["word", "near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            held = pa.table(b) if held is None else pa.concat_tables([held, pa.table(b)])
            # Whole cells of one kind are worked on, as many as make a block.
            while held is not None and held.num_rows:
                kind = np.stack([held.column(c).to_numpy() for c in ("m", "lo", "hi")])
                same = int(np.argmin(np.append((kind == kind[:, :1]).all(0), False)))
                cell = held.column("cell").to_numpy()
                ends = np.flatnonzero(cell[1:same] != cell[: same - 1]) + 1
                if same < held.num_rows:
                    ends = np.append(ends, same)
                if not len(ends) or (same == held.num_rows and ends[-1] < config.most):
                    break
                end = int(ends[max(0, np.searchsorted(ends, config.most, "right") - 1)])
                if (out := worked(held.slice(0, end))) is not None:
                    yield out
                held = held.slice(end)
        while held is not None and held.num_rows:
            if (out := worked(held)) is not None:
                yield out
            held = None

    dealt = rows.select(*names).repartition(max(partitions(rows.sparkSession), 1), "m", "lo", "hi", "cell").sortWithinPartitions("m", "lo", "hi", "cell")
    return dealt.mapInArrow(tidy(run), "word string, near long, best_n long, best string")


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the forms end. Each round a word jumps as far as its goal has come; those at the end take no part any more."""
    going, done = formed, None
    while True:
        ahead = going.select(F.col("word").alias("form"), F.col("form").alias("next"))
        met = materialise(going.join(ahead, "form", "left").select("word", F.coalesce("next", "form").alias("form"), F.col("next").isNotNull().alias("goes")))
        arrived = met.where("NOT goes").select("word", F.col("form").alias("root"))
        done = arrived if done is None else done.unionByName(arrived)
        going = met.where("goes").select("word", "form")
        if not going.limit(1).count():
            return done
        # A word that has arrived can still be the goal of others: it goes nowhere, so their next round ends there.
        going = going.join(done.select(F.col("word").alias("form"), F.col("root").alias("to")), "form", "left").select("word", F.coalesce("to", "form").alias("form"))


def variants(vocabulary: DataFrame, config: Config = Config()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word (word, n), words being distinct, of Latin-1 and without a NUL.

    n_near: how many words differ by one inserted, deleted or replaced code point. form: the most frequent of them, of
    equal ones the first in code-point order, if it has at least `ratio` times the word's count; else null. root: where
    the forms end, the word itself if it has none. A word may be long; an empty vocabulary gives no rows.
    """
    words = materialise(vocabulary.select("word", "n"))
    found = _found(cells(words, config), config)
    better = F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form"))
    of = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(better).alias("best"))
    near_ = words.join(of, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    has = -F.col("best.less") >= config.ratio * F.col("n")
    formed = materialise(near_.select("word", "n", "n_near", F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    roots = _roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
