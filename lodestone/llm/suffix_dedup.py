"""Removal of long strings that stood earlier, by suffix arrays.

A string of `length` bytes counts as repeated where it also starts earlier: in a document with a smaller id, or before
in the same.

1. The corpus is dealt into shards of about `block` bytes of whole texts (longer ones in blocks that overlap). Each
   shard's suffixes are sorted (Larsson-Sadakane refinement, in numpy), the common prefixes of neighbours follow by
   Kasai's rule, and so the shard knows its strings: the earliest of each, and the others, which repeat. From here on
   only the earliest count, so a passage that stands a thousand times in a shard leaves it once.
2. Shards can only share a string if they share its anchor, the q-gram with the smallest hash in it. Each shard lists
   its anchors once, with their places; the anchors of several shards are counted and joined.
3. The segments around these go to merging shards, which sort them in the same way. A frequent anchor's segments are
   dealt over several of these, each of which passes on its earliest strings in order.
4. Such sorted lists are merged by binary search, which leaves the earliest of each string.

Nothing is judged by a hash alone: hashes choose what to compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, POWERS, ROW, bound_batches, ids_name_rows, materialise, mix, numbered, partitions, range_hashes, slices, tidy


@dataclass(frozen=True)
class Config:
    """gram: bytes of an anchor, less than length. hot: segments of one anchor that a merging shard takes; more are dealt over several. block: bytes of a shard."""

    length: int = 100
    gram: int = 24
    hot: int = 1000
    block: int = 1 << 18


# --- suffix arrays --------------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros following the end; one more for the end itself."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").ravel().astype(np.uint64)


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes sorted by their first `depth` bytes or more (zeros follow the end): the first eight bytes give groups, and each round sorts the groups still larger than one by the rank of what stands as far on as they are sorted to."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int32)
    key = _words(data)[:n]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    head = np.r_[True, key[1:] != key[:-1]]
    del key
    rank = np.zeros(n + 1, np.int32)  # the place of a group's first suffix, plus one; past the end 0
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0)) + 1
    sorted_to = 8
    while sorted_to < depth:
        open_ = np.flatnonzero(~(head & np.r_[head[1:], True])).astype(np.int32)
        if not len(open_):
            break
        at = order[open_]
        by = (rank[at].astype(np.int64) << 32) | rank[np.minimum(at + sorted_to, n)]
        sort = np.argsort(by)
        at, by = at[sort], by[sort]
        order[open_] = at
        head[open_] = np.r_[True, by[1:] != by[:-1]]
        rank[at] = open_[np.maximum.accumulate(np.where(head[open_], np.arange(len(at)), 0))] + 1
        sorted_to *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in order, the bytes (up to most) it shares with the one before it. By Kasai's rule the next place shares one byte less with the same neighbour's next, so that bytes are compared, eight at a time, only where neighbours change, and anew after `most` places."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int32)
    place = np.arange(n, dtype=np.int32)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (data[:-1] == data[before[:-1]])
    start = np.maximum.accumulate(np.where(follows, 0, place))
    start += (place - start) // most * most
    live = np.flatnonzero((start == place) & (before >= 0)).astype(np.int32)
    words, shared, done = _words(data), np.zeros(n, np.int32), 0
    while len(live) and done < 2 * most:  # what follows within `most` places is one byte less each
        differ = words[np.minimum(live + done, n)] ^ words[np.minimum(before[live] + done, n)]
        ended = differ != 0
        x = differ[ended]
        shared[live[ended]] = done + sum((x < np.uint64(1 << 8 * k)).astype(np.int32) for k in range(1, 8))
        live, done = live[~ended], done + 8
        shared[live] = done
    shared = np.minimum(shared, n - np.maximum(place, before))
    shared = np.maximum(shared[start] - (place - start), 0)
    return np.minimum(shared[order], most)


def first_starts(data: np.ndarray, is_start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which starts are the first of their string of `length` bytes in data; and the suffixes in order."""
    order = suffix_array(data, length)
    run = np.cumsum(common_prefixes(data, order, length) < length, dtype=np.int32)
    chosen = is_start[order]
    at, run = order[chosen], run[chosen]
    first = np.zeros(len(data), bool)
    if len(at):  # of suffixes with `length` bytes in common, those that are starts are equal strings
        first[np.minimum.reduceat(at, np.flatnonzero(np.r_[True, run[1:] != run[:-1]]))] = True
    return first, order


# --- shards of the corpus -----------------------------------------------------------------


def anchor_places(data: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """The place of the anchor of each string of data, and the hash of each gram."""
    at = np.arange(len(data) - config.gram + 1)
    full = range_hashes(data, at, at + config.gram)
    key = (full & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # the leftmost of equals
    width, reach = config.length - config.gram + 1, 1
    while 2 * reach <= width:
        key = np.minimum(key[: len(key) - reach], key[reach:])
        reach *= 2
    if reach < width:
        key = np.minimum(key[: len(key) - (width - reach)], key[width - reach :])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int32), full


#: A shard's row: anchor and the first of its runs; `more` has its other runs, as doc_id, starts, doc_id, starts... starts is lo * 2**16 + n. again: a run that repeats within the shard, under any anchor.
LISTED = "anchor long, again boolean, doc_id long, starts long, more array<long>"


def _listed(anchor: np.ndarray, again: bool, sizes: np.ndarray, doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row an anchor, with the next `size` of the runs."""
    starts = (lo << 16) | n
    head = np.cumsum(sizes) - sizes
    other = np.ones(len(doc), bool)
    other[head] = False
    flat = np.column_stack([doc[other], starts[other]]).ravel()
    offsets = pa.array(np.r_[0, np.cumsum(2 * (sizes - 1))].astype(np.int32), mask=np.r_[sizes == 1, False])
    more = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(np.full(len(head), again)), pa.array(doc[head]), pa.array(starts[head]), more], names=["anchor", "again", "doc_id", "starts", "more"])


def _runs(at: np.ndarray, *tells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of consecutive places begin, and their lengths; a run is of places of which `tells` say the same."""
    new = np.r_[True, at[1:] != at[:-1] + 1][: len(at)]
    for x in tells:
        new[1:] |= x[at[1:]] != x[at[:-1]]
    new |= np.arange(len(at)) % 0x8000 == 0  # a length fits 16 bits
    return at[new], np.diff(np.r_[np.flatnonzero(new), len(at)])


def corpus_shard(data: np.ndarray, doc: np.ndarray, base: np.ndarray, size: np.ndarray, config: Config) -> Iterator[pa.RecordBatch]:
    """What a shard of texts says, which stand one after the other in data, in ascending order of (doc, base), base being where a block of a longer text begins: the runs of starts that repeat within it, and for each anchor of the others their runs."""
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    begin = np.cumsum(size) - size
    is_start = np.arange(len(data)) - begin[owner] <= (size - config.length)[owner]
    if not is_start.any():
        return
    first, _ = first_starts(data, is_start, config.length)
    again = is_start & ~first
    begin_of, start_of = base[owner] - begin[owner], doc[owner]
    if again.any():
        lo, n = _runs(np.flatnonzero(again), owner)
        of = start_of[lo]
        yield _listed(mix(of), True, np.ones(len(lo), np.int64), of, begin_of[lo] + lo, n)
    place, full = anchor_places(data, config)
    lo, n = _runs(np.flatnonzero(first), owner, place)
    anchor = full[place[lo]]
    order = np.argsort(anchor, kind="stable")
    anchor, lo, n = anchor[order], lo[order], n[order]
    head = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    yield _listed(anchor[head], False, np.diff(np.r_[head, len(anchor)]), start_of[lo], begin_of[lo] + lo, n)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, one after the other, and the length of each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    return np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8), np.diff(offsets)


def corpus_shards(rows: DataFrame, config: Config) -> DataFrame:
    """What all shards of rows (doc_id, text) say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        POWERS.grow(config.block + 2 * config.length)
        for whole in batches:
            for b in slices(whole, most=config.block):
                doc = b.column("doc_id").to_numpy()
                order = np.argsort(doc, kind="stable")
                data, size = _bytes_of(b.column("text").take(pa.array(order)))
                if len(data) <= config.block:
                    yield from corpus_shard(data, doc[order], np.zeros(len(doc), np.int64), size, config)
                    continue
                for lo in range(0, len(data) - config.length + 1, config.block):  # one text
                    part = data[lo : lo + config.block + config.length - 1]
                    yield from corpus_shard(part, doc, np.array([lo]), np.array([len(part)]), config)

    return rows.mapInArrow(tidy(run), LISTED)


# --- shards of what several have ------------------------------------------------------------


def _segments(docs: DataFrame, config: Config) -> DataFrame:
    """docs (doc_id, text, around) has a list of (starts, anchor, split). A row for each run of starts, with the bytes that its strings span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, most=1 << 20):
                lists = b.column("around")
                n = pc.list_value_length(lists).to_numpy()
                around = lists.flatten()
                starts = around.field("starts").to_numpy()
                lo, count = starts >> 16, starts & 0xFFFF
                doc = np.repeat(b.column("doc_id").to_numpy(), n)
                ends = np.cumsum(n)
                for i, text in enumerate(b.column("text")):
                    raw, upto = text.as_buffer().to_pybytes(), int(ends[i])  # slices of a memoryview are never freed by pa.array
                    at = upto - int(n[i])
                    while at < upto:  # a long text has many segments
                        to = min(at + 20_000, upto)
                        piece = [raw[s : s + c + config.length - 1] for s, c in zip(lo[at:to].tolist(), count[at:to].tolist(), strict=True)]
                        held = (around.field("anchor")[at:to], around.field("split")[at:to], pa.array(doc[at:to]), pa.array(lo[at:to]), pa.array(piece, pa.binary()))
                        yield pa.RecordBatch.from_arrays(list(held), names=["anchor", "split", "doc_id", "lo", "piece"])
                        at = to

    return docs.mapInArrow(tidy(run), "anchor long, split int, doc_id long, lo long, piece binary")


def merging_shard(anchor: np.ndarray, split: np.ndarray, doc: np.ndarray, lo: np.ndarray, piece: pa.Array, config: Config) -> Iterator[pa.RecordBatch]:
    """Runs of starts that repeat among these segments; and, of anchors dealt over several shards, each string's earliest place, with the string, in order."""
    coded = piece.dictionary_encode()
    kind, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    size = pc.binary_length(pieces).to_numpy().astype(np.int64)
    order = np.lexsort((lo, doc, kind))
    earliest = order[np.r_[True, kind[order][1:] != kind[order][:-1]]]
    again = np.ones(len(kind), bool)
    again[earliest] = False  # by Kasai's rule, an equal segment repeats at each of its starts
    found = [(doc[again], lo[again], size[kind[again]] - config.length + 1)]
    # Of equal segments the earliest is left; it needs sorting if its anchor has another, or another shard.
    names, inverse, n = np.unique(anchor[earliest], return_inverse=True, return_counts=True)
    left = earliest[(n[inverse] > 1) | (split[earliest] >= 0)]
    if len(left):
        left = left[np.lexsort((lo[left], doc[left]))]
        data, size = _bytes_of(pieces.take(pa.array(kind[left])))
        owner = np.repeat(np.arange(len(left), dtype=np.int32), size)
        begin = np.cumsum(size) - size
        at = np.arange(len(data))
        is_start = at - begin[owner] <= (size - config.length)[owner]
        first, order = first_starts(data, is_start, config.length)
        where = lo[left][owner] - begin[owner]
        more, n = _runs(np.flatnonzero(is_start & ~first), owner)
        found.append((doc[left][owner[more]], where[more] + more, n))
        heads = order[(first & (split[left] >= 0)[owner])[order]]
        windows = np.lib.stride_tricks.sliding_window_view(data, config.length)
        for some in np.split(heads, range(STRINGS, len(heads), STRINGS)):
            strings = _binary(windows[some], config.length)
            yield _found(doc[left][owner[some]], where[some] + some, np.ones(len(some), np.int64), pa.array(split[left][owner[some]]), strings)
    docs, los, n = (np.concatenate(c) for c in zip(*found, strict=True))
    yield _found(docs, los, n, pa.nulls(len(docs), pa.int32()), pa.nulls(len(docs), pa.binary()))


#: Strings of a batch that a merging shard passes on.
STRINGS = 1 << 15


def _binary(rows: np.ndarray, length: int) -> pa.Array:
    """Rows of bytes as binary values."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(length)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _found(doc: np.ndarray, lo: np.ndarray, n: np.ndarray, shard: pa.Array, string: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int64()), shard, string], names=["doc_id", "lo", "n", "shard", "string"])


def merging_shards(segments: DataFrame, config: Config) -> DataFrame:
    """A partition is sorted in shards of about `block` bytes of whole anchors, or of whole parts of anchors that are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(rows).combine_chunks()
            yield from merging_shard(*[t.column(c).to_numpy() for c in ("anchor", "split", "doc_id", "lo")], t.column("piece").chunk(0), config)

        for whole in batches:
            for b in slices(whole, "piece", most=config.block):
                name, split = b.column("anchor").to_numpy(), b.column("split").to_numpy()
                cut = b.num_rows - int(((name == name[-1]) & (split == split[-1]))[::-1].argmin() or b.num_rows)  # rows come sorted; the last part of an anchor may go on
                if size > config.block and (cut or [held[-1].column(c)[len(held[-1]) - 1].as_py() for c in ("anchor", "split")] != [name[0], split[0]]):
                    held.append(b.slice(0, cut))
                    yield from done([h for h in held if h.num_rows])
                    held, size = [], 0
                    b = b.slice(cut)
                held.append(b)
                size += b.nbytes
        if held:
            yield from done(held)

    dealt = segments.repartition("anchor", "split").sortWithinPartitions("anchor", "split")
    return dealt.mapInArrow(tidy(run), "doc_id long, lo long, n long, shard int, string binary")


# --- merging sorted shards --------------------------------------------------------------------

#: Bytes of strings that are merged at a time.
PART_BYTES = 4 << 20


def merged(a: tuple, b: tuple) -> tuple[tuple, tuple]:
    """Two sorted lists of strings (strings, doc_id, lo), each string once in each, as one with the earliest place of each, by binary search of one in the other; and the places (doc_id, lo) that repeat."""
    (s, doc, lo), (t, of, at) = a, b
    to = np.searchsorted(s, t)
    both = s[np.minimum(to, len(s) - 1)] == t
    i, j = to[both], np.flatnonzero(both)
    earlier = (of[j] < doc[i]) | ((of[j] == doc[i]) & (at[j] < lo[i]))
    later = np.where(earlier, doc[i], of[j]), np.where(earlier, lo[i], at[j])
    doc, lo = doc.copy(), lo.copy()
    doc[i], lo[i] = np.where(earlier, of[j], doc[i]), np.where(earlier, at[j], lo[i])
    new = ~both
    return (np.insert(s, to[new], t[new]), np.insert(doc, to[new], of[new]), np.insert(lo, to[new], at[new])), later


def merge_shards(found: DataFrame, n_parts: int, config: Config) -> DataFrame:
    """The starts found, and those of strings that another shard has earlier. A hash deals the strings over n_parts; in each part the shards' sorted lists are merged two and two, and a task holds one part at a time."""

    def merge(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        strings = np.frombuffer(_bytes_of(t.column("string").chunk(0))[0], f"S{config.length}")
        shard, doc, lo = (t.column(c).to_numpy() for c in ("shard", "doc_id", "lo"))
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
        lists = [(strings[i:j], doc[i:j], lo[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        while len(lists) > 1:
            pairs = [merged(a, b) for a, b in zip(lists[::2], lists[1::2], strict=False)]
            for _, (of, at) in pairs:
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(at), pa.array(np.ones(len(of), np.int64))], names=["doc_id", "lo", "n"])
            lists = [m for m, _ in pairs] + lists[len(lists) // 2 * 2 :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            known = pc.is_null(b.column("string"))
            yield b.select(["doc_id", "lo", "n"]).filter(known)
            rest = b.filter(pc.invert(known))
            part = rest.column("part").to_numpy()
            for piece in np.split(np.arange(len(part)), np.flatnonzero(part[1:] != part[:-1]) + 1):
                if not len(piece):
                    continue
                if held and held[-1].column("part")[0].as_py() != part[piece[0]]:
                    yield from merge(held)
                    held = []
                held.append(rest.slice(piece[0], len(piece)))
        if held:
            yield from merge(held)

    dealt = found.withColumn("part", F.pmod(F.when(F.col("string").isNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("string")), F.lit(n_parts)))
    return dealt.repartition("part").sortWithinPartitions("part", "shard", "string").mapInArrow(tidy(run), "doc_id long, lo long, n long")


# --- the operator -----------------------------------------------------------------------------


def repeats(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """rows (doc_id, text), an id for each, without nulls, with `found`: the runs (lo, n) of starts of repeated strings, or null."""
    bound_batches(rows.sparkSession)
    of_anchor = Window.partitionBy("anchor", "again")  # a row a shard, however often the shard has it
    n_runs = F.sum(F.coalesce(F.size("more") / 2, F.lit(0)).cast("long") + 1)
    counted = corpus_shards(rows, config).withColumn("n_shards", F.count("*").over(of_anchor)).withColumn("n_runs", n_runs.over(of_anchor))
    several = materialise(counted.where("again OR n_shards > 1").drop("n_shards"))
    pair = lambda i: F.struct(F.get("more", 2 * i).alias("doc_id"), F.get("more", 2 * i + 1).alias("starts"))
    others = several.where("NOT again AND more IS NOT NULL").select("anchor", "n_runs", F.inline(F.transform(F.sequence(F.lit(0), (F.size("more") / 2).cast("int") - 1), pair)))
    run = several.where("NOT again").select("anchor", "n_runs", "doc_id", "starts").unionByName(others)
    n_strings = run.where(F.col("n_runs") > config.hot).agg(F.sum(F.col("starts").bitwiseAND(F.lit(0xFFFF).cast("long")))).first()[0] or 0
    split = F.when(F.col("n_runs") > config.hot, F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n_runs") / config.hot))).otherwise(-1).cast("int")
    around = run.withColumn("split", split).groupBy("doc_id").agg(F.collect_list(F.struct("starts", "anchor", "split")).alias("around"))
    segments = _segments(rows.join(around, "doc_id").select("doc_id", "text", "around"), config)
    within = several.where("again").select("doc_id", F.shiftright("starts", 16).alias("lo"), F.col("starts").bitwiseAND(F.lit(0xFFFF).cast("long")).alias("n"))
    # At most so many strings are passed on; a part of them is about as large as a shard's.
    n_parts = partitions(rows.sparkSession) + n_strings * config.length // PART_BYTES
    starts = merge_shards(merging_shards(segments, config), n_parts, config).unionByName(within)
    # The texts come from the exchange that the segments came from: it is one query, and the exchange is the same.
    return rows.join(starts.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("found")), "doc_id", "left")


def _kept(raw: bytes, lo: np.ndarray, n: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """The bytes left without the runs of repeated starts, the number removed, and the number of removed runs of bytes."""
    if not len(lo):
        return raw, 0, 0
    order = np.argsort(lo)
    lo, reach = lo[order], np.maximum.accumulate((lo + n)[order] + length - 1)
    head = np.flatnonzero(np.r_[True, lo[1:] > reach[:-1]])
    start, end = lo[head], reach[np.r_[head[1:] - 1, len(lo) - 1]]
    cuts = [0, *np.column_stack([start, end]).ravel().tolist(), len(raw)]
    return b"".join(raw[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True)), int((end - start).sum()), len(head)


def _rests(b: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, int, int, bool]]:
    """For each row (text, found): what _kept gives, and whether anything was found."""
    runs = b.column("found").flatten()
    lo, n = runs.field("lo").to_numpy(), runs.field("n").to_numpy()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column("found")), 0).to_numpy()).tolist()
    for text, i, j in zip(b.column("text"), [0, *ends[:-1]], ends, strict=True):
        yield *_kept(text.as_buffer().to_pybytes(), lo[i:j], n[i:j], length), j > i


def deduplicate(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): what is left of every whole text, in bytes; a cut may fall inside a character.

    A null text is empty. Rows that share an id are one document, with the smallest of their texts; the rows without an id come first, as one.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if not ids_name_rows(docs):
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, most=2 << 20):
                done = list(_rests(b, config.length))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(d[0]) + d[1] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([d[0] for d in done], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = repeats(rows, config).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def remove_repeats(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """The rows of docs, all columns as they are but for text (and n_chars, if there is one), without the repeated strings.

    Halves of characters at a cut go as well. A document goes if nothing but white space is left of it; one of which
    nothing was removed stays as it is. What stood earlier is told by the ids or, where any is null or repeats, by the
    order of the rows, each of which is a document of its own.
    """
    known = ids_name_rows(docs)
    columns = docs.columns
    schema = docs.select(*columns).schema
    docs = docs if known else numbered(docs)
    key = F.coalesce(F.col("doc_id" if known else ROW).cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The other columns go by the id alone and meet the text where the found runs have met it.
    other = docs.select(key.alias("own_id"), F.col("text").isNull().alias("no_text"), *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(columns) if c != "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, most=2 << 20):
                kept = [left.decode(errors="ignore") if any_ else None for left, _, _, any_ in _rests(b, config.length)]
                same = pa.array([k is None for k in kept], pa.bool_())
                old = pc.if_else(b.column("no_text"), pa.nulls(len(kept), pa.string()), b.column("text"))
                cols = {c: b.column(f"own_{i}") for i, c in enumerate(columns) if c != "text"}
                cols["text"] = pc.if_else(same, old, pa.array(kept, pa.string()))
                if "n_chars" in cols:
                    cols["n_chars"] = pc.if_else(same, cols["n_chars"], pa.array([None if k is None else len(k) for k in kept], cols["n_chars"].type))
                stays = pa.array([k is None or bool(k.strip()) for k in kept], pa.bool_())
                yield pa.RecordBatch.from_arrays([cols[c] for c in columns], names=columns).filter(stays)

    return repeats(rows, config).join(other, F.col("doc_id") == F.col("own_id")).drop("doc_id", "own_id").mapInArrow(tidy(run), schema)
