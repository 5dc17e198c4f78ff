"""Similarity join of documents by the Jaccard coefficient of their word shingles: a size-aware heavy-light join.

Light (small) sets enumerate all subsets of the fixed sizes that a linked pair must have in common, and meet where two
of these are equal. Heavy (large) sets stand in the inverted lists of their rarest shingles, as many as a linked pair
can't avoid to share, and these lists are scanned. The boundary is where both together cost least, by the sizes of all
sets and the lengths of all lists; it decides what work is done, never what is found.
Sets a little above it do both, so that pairs across it meet too.

Equal sets are one class throughout, with the smallest doc_id for its representative, so copies cost nothing further.
Only members of a list whose odd sketches differ in few enough bits (a lower bound of how far the sets differ) are
compared, set against set. That happens in two rounds. First each member meets the most central one of its lists, and
members too far from that one meet each other; links found make components. Then, of lists that still join different
components, all pairs across these are compared. So no link between components is lost, while a group of n near copies
doesn't cost n * n pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, ids_name_rows, matched, materialise, mix, numbered, partitions, shingle_sets, slices, texts, tidy
from .components import connected_components


@dataclass(frozen=True)
class Config:
    """Linked: den * intersection >= num * union. sample: always 1, as every document is counted. buckets_log2: shingles are counted in so many buckets of hashes, which orders the lists. light: the boundary, where it isn't to be chosen. largest_light: no boundary lies above this."""

    width: int = 3
    num: int = 90
    den: int = 100
    sample: int = 1
    buckets_log2: int = 18
    light: int | None = None
    largest_light: int = 1000

    def __post_init__(self) -> None:
        if self.sample != 1:
            raise ValueError("sample must be 1: every document is counted")

    def overlap(self, a: int, b: int) -> int:
        """The smallest intersection of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, size: int) -> int:
        return size - -(-self.num * size // self.den) + 1

    def deletions(self, size: int, largest: int) -> int:
        """How many of its elements a linked partner of at most `largest` may lack."""
        partners = range(-(-self.num * size // self.den), min(self.den * size // self.num, largest) + 1)
        return max((size - o for b in partners if (o := self.overlap(size, b)) <= min(size, b)), default=0)

    def subsets(self, size: int, largest: int) -> int:
        return sum(comb(size, d) for d in range(self.deletions(size, largest) + 1))

    def largest_boundary(self) -> int:
        """No boundary can lie above this."""
        if self.light is not None:
            return self.light
        for size in range(1, self.largest_light + 1):
            if self.subsets(size, self.den * size // self.num) > 100_000:
                return size - 1
        return self.largest_light

    def boundary(self, costs: dict[int, tuple[int, float]]) -> int:
        """The largest light size. costs: for each size the number of sets, and what their lists cost: a row each, and the comparisons with half of the other members.

        Every subset that a light set enumerates is a row.
        """
        if self.light is not None:
            return self.light
        best, least = 0, sum(scan for _, scan in costs.values())
        rest = least
        for size in range(1, self.largest_boundary() + 1):
            rest -= costs.get(size, (0, 0.0))[1]
            largest = self.den * size // self.num
            total = rest + sum(n * self.subsets(s, largest) for s, (n, _) in costs.items() if s <= largest)
            if total <= least:
                best, least = size, total
        return best


def sketch(own: np.ndarray) -> np.ndarray:
    """A bitmap in which each element turns one bit over: two bitmaps differ in at most as many bits as the sets in elements. Its number of bits is the power of two below the set's size, 256 at least: in a small set, elements that fall on one bit would hide much of the distance."""
    words = 1 << max(2, int(len(own)).bit_length() - 7)
    bit = mix(own ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(64 * words - 1)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def subset_keys(own: np.ndarray, config: Config, light: int) -> np.ndarray:
    """The keys of a set's subsets, if it is small enough to meet a light one."""
    size, out = len(own), []
    largest = config.den * light // config.num
    if not 0 < size <= largest:
        return np.zeros(0, np.uint64)
    mixed = mix(own)
    total = mixed.sum(keepdims=True)
    for d in range(config.deletions(size, largest) + 1):
        out += [(total - mixed[list(gone)].sum(keepdims=True))[0] for gone in combinations(range(size), d)]
    return mix(np.array(out, np.uint64) ^ np.uint64(0x589965CC75374CC3))


def keys_of(own: np.ndarray, config: Config, light: int, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The keys under which a set is listed. frequent: sorted numbers of buckets, with their counts."""
    size, out = len(own), [subset_keys(own, config, light)]
    if size > light:
        if len(frequent):
            bucket = own >> np.uint64(64 - config.buckets_log2)
            at = np.minimum(np.searchsorted(frequent, bucket), len(frequent) - 1)
            often = np.where(frequent[at] == bucket, counts[at], 0)
            if often.any():
                own = own[np.lexsort((own, often))]
        out.append(own[: config.prefix(size)])
    return np.concatenate(out)


def _sets(docs: DataFrame, config: Config, emit, schema: str) -> DataFrame:  # noqa: ANN001
    """emit(ids, sets) gives the columns of schema for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, most=1 << 20):
                yield pa.RecordBatch.from_pydict(emit(b.column("doc_id"), shingle_sets(b.column("text").to_pylist(), config.width)))

    return docs.mapInArrow(tidy(run), schema)


def frequent_shingles(docs: DataFrame, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of shingles (by the first bits of their hashes) that hold more than twice as many as the average, sorted, and their counts over all documents. It only orders lists.

    Each task counts all of its documents in one array of fixed size; these are added piece by piece.
    """
    buckets, pieces = 1 << config.buckets_log2, 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for b in slices(whole, most=1 << 20):
                own = np.concatenate(shingle_sets(b.column("text").to_pylist(), config.width))
                total += np.bincount((own >> np.uint64(64 - config.buckets_log2)).astype(np.int64), minlength=buckets)
        if total.any():
            yield added({k: x for k, x in enumerate(np.array_split(total, pieces))})

    def added(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"piece": pa.array(list(sums), pa.int32()), "total": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, x in zip(b.column("piece").to_pylist(), b.column("total"), strict=True):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(x.as_buffer(), np.int64)
        if sums:
            yield added(sums)

    schema = "piece int, total binary"
    rows = docs.select("text").mapInArrow(tidy(count), schema).repartition("piece").mapInArrow(tidy(add), schema).collect()
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.concatenate([np.frombuffer(r["total"], np.int64) for r in sorted(rows, key=lambda r: r["piece"])])
    frequent = np.flatnonzero(total > max(2.0, 2 * total.mean()))
    return frequent.astype(np.uint64), total[frequent]


def profiles(docs: DataFrame, config: Config, order: Broadcast) -> DataFrame:
    """(doc_id, class_a, class_b, size, sketch, keys, small): what lists need of each set; class_a and class_b are equal for equal sets. keys: those of a heavy set. small: the set itself, where it may turn out light or meet a light one."""
    largest = config.den * config.largest_boundary() // config.num

    def emit(ids: pa.Array, sets: list[np.ndarray]) -> dict:
        a = [mix(s).sum() + np.uint64(len(s)) for s in sets]
        b = [mix(s ^ np.uint64(0xE7037ED1A0B428DB)).sum() for s in sets]
        lists = pa.list_(pa.int64())
        return {
            "doc_id": ids,
            "class_a": pa.array(np.array(a, np.uint64).view(np.int64)),
            "class_b": pa.array(np.array(b, np.uint64).view(np.int64)),
            "size": pa.array([len(s) for s in sets], pa.int64()),
            "sketch": pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
            "keys": pa.array([keys_of(s, config, 0, *order.value).view(np.int64) for s in sets], lists),
            "small": pa.array([s.view(np.int64) if len(s) <= largest else None for s in sets], lists),
        }

    return _sets(docs, config, emit, "doc_id long, class_a long, class_b long, size long, sketch binary, keys array<long>, small array<long>")


def representatives(profile: DataFrame) -> DataFrame:
    """One row for each class of equal sets, without the empty ones."""
    first = [F.first(c).alias(c) for c in ("size", "sketch", "keys", "small")]
    return profile.where("size > 0").groupBy("class_a", "class_b").agg(F.min("doc_id").alias("rep"), *first)


def _shared(posted: DataFrame) -> DataFrame:
    """(key, rep, size, n) of keys that several have."""
    return materialise(posted.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("key", "rep", "size", "n"))


def heavy_lists(reps: DataFrame) -> DataFrame:
    return _shared(reps.select("rep", "size", F.explode(F.array_distinct("keys")).alias("key")))


def light_lists(reps: DataFrame, config: Config, light: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [np.unique(subset_keys(np.array(s, np.int64).view(np.uint64), config, light)).view(np.int64) for s in b.column("small").to_pylist()]
            yield pa.RecordBatch.from_pydict({"rep": b.column("rep"), "size": b.column("size"), "keys": pa.array(keys, pa.list_(pa.int64()))})

    small = reps.where(F.col("size") <= config.den * light // config.num).select("rep", "size", "small")
    return _shared(small.mapInArrow(tidy(emit), "rep long, size long, keys array<long>").select("rep", "size", F.explode("keys").alias("key")))


def costs_of(reps: DataFrame, shared: DataFrame, config: Config) -> dict[int, tuple[int, float]]:
    """What Config.boundary takes, from all distinct sets and all lists: at most a row a size up to the largest light one, all others together."""
    most = config.den * config.largest_light // config.num + 1
    size = F.least("size", F.lit(most)).alias("size")
    rows = {r["size"]: (r["sets"], float(r["keys"])) for r in reps.groupBy(size).agg(F.count("*").alias("sets"), F.sum(F.size("keys")).alias("keys")).collect()}
    pairs = {r["size"]: r["pairs"] for r in shared.groupBy(size).agg(F.sum((F.col("n") - 1) / 2.0).alias("pairs")).collect()}
    return {k: (sets, keys + pairs.get(k, 0.0)) for k, (sets, keys) in rows.items()}


def list_costs(docs: DataFrame, config: Config, order: Broadcast) -> dict[int, tuple[int, float]]:
    """costs_of() the sets of docs."""
    reps = materialise(representatives(profiles(docs, config, order)))
    return costs_of(reps, heavy_lists(reps), config)


def _near(cols: dict, i: np.ndarray, j: np.ndarray, config: Config) -> np.ndarray:
    """Which pairs of rows may be linked, by their sizes and the bits in which their sketches differ."""
    size, words, begin, flat = cols["size"], cols["words"], cols["begin"], cols["flat"]
    out = config.den * np.minimum(size[i], size[j]) >= config.num * np.maximum(size[i], size[j])
    most = (size[i] + size[j]) * (config.den - config.num) // (config.den + config.num)
    at = np.flatnonzero(out)
    wide, narrow = np.maximum(words[i[at]], words[j[at]]), np.minimum(words[i[at]], words[j[at]])
    for w, n in set(zip(wide.tolist(), narrow.tolist(), strict=True)):
        own = at[(wide == w) & (narrow == n)]
        for k in range(0, len(own), max(1, 500_000 // w)):
            part = own[k : k + max(1, 500_000 // w)]
            bits = np.zeros((len(part), n), np.uint64)
            for side in (i[part], j[part]):  # the wider one folds: its bit number is the same hash to more places
                for m in (w, n) if w != n else (w,):
                    which = np.flatnonzero(words[side] == m)
                    rows = flat[begin[side[which]][:, None] + np.arange(m)]
                    bits[which] ^= np.bitwise_xor.reduce(rows.reshape(len(which), m // n, n), 1)
            out[part] = np.bitwise_count(bits).sum(1) <= most[part]
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Blocks of rows, sorted by key, in which no key's run is cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (held and held[-1].column("key")[0].as_py() != key[0]):
            held.append(b.slice(0, cut))
            yield _columns(held)
            held = []
        held.append(b.slice(cut))
    if held:
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    cols = {c: t.column(c).to_numpy() for c in t.column_names if c != "sketch"}
    sketches = t.column("sketch").to_pylist()
    cols["words"] = np.array([len(x) // 8 for x in sketches], np.int64)
    cols["begin"] = np.cumsum(cols["words"]) - cols["words"]
    cols["flat"] = np.frombuffer(b"".join(sketches), np.uint64)
    return cols


def _scan(lists: DataFrame, found, schema: str) -> DataFrame:  # noqa: ANN001
    """found(columns, start, end) gives rows for each block of whole runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _runs(batches):
            if not len(cols["key"]):
                continue
            start = np.flatnonzero(np.r_[True, cols["key"][1:] != cols["key"][:-1]])
            for out in found(cols, start, np.r_[start[1:], len(cols["key"])]):
                yield pa.RecordBatch.from_pydict(out)

    return lists.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), schema)


CENTRAL, OTHER, LISTED = 0, 1, 2


def _across(rows: np.ndarray, against: np.ndarray, size: np.ndarray, config: Config) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each of `rows` with those of `against` whose size allows a link."""
    order = against[np.argsort(size[against], kind="stable")]
    sizes = size[order]
    for i in rows.tolist():
        lo = np.searchsorted(sizes, -(-config.num * size[i] // config.den), "left")
        hi = np.searchsorted(sizes, config.den * size[i] // config.num, "right")
        j = order[lo:hi]
        yield np.full(len(j), i), j


def first_pairs(lists: DataFrame, config: Config) -> DataFrame:
    """(kind, a, b, weight): of each list, each near member with the most central one (in most lists); pairs of which one isn't near it; and the list (as key a) with its near members b, for the second round."""

    def found(cols: dict, start: np.ndarray, end: np.ndarray) -> Iterator[dict]:
        rep, weight, size = cols["rep"], cols["weight"], cols["size"]
        order = np.lexsort((rep, -weight, cols["key"]))
        center = np.empty(len(order), np.int64)
        center[order] = np.repeat(order[start], end - start)
        each = np.arange(len(order))
        near = _near(cols, center, each, config)
        star = near & (center != each)
        yield _rows(CENTRAL, rep[center[star]], rep[star], weight[center[star]])
        starred = np.add.reduceat(star.astype(int), start) > 0  # one star is enough: the first round may take another center for it
        kept = near & np.repeat(starred, end - start)
        yield _rows(LISTED, cols["key"][kept], rep[kept], weight[kept])
        left: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        away = np.add.reduceat((~near).astype(int), start)
        for s, e in zip(start[away > 0].tolist(), end[away > 0].tolist(), strict=True):
            if e - s < 3:
                continue
            members = np.arange(s, e)
            for i, j in _across(members[~near[s:e]], members[members != center[s]], size, config):
                ok = (j != i) & (near[j] | (j > i))
                left.append((i[ok], j[ok]))
                n += int(ok.sum())
                if n > 200_000:
                    yield from _others(cols, left, config)
                    left, n = [], 0
        yield from _others(cols, left, config)

    return _scan(lists, found, "kind int, a long, b long, weight long")


def _others(cols: dict, pairs: list[tuple[np.ndarray, np.ndarray]], config: Config) -> Iterator[dict]:
    if pairs:
        i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        ok = _near(cols, i, j, config)
        a, b = cols["rep"][i[ok]], cols["rep"][j[ok]]
        yield _rows(OTHER, np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.int64))


def _rows(kind: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> dict:
    return {"kind": pa.array(np.full(len(a), kind, np.int32)), "a": pa.array(a), "b": pa.array(b), "weight": pa.array(weight)}


def cross_pairs(lists: DataFrame, config: Config) -> DataFrame:
    """All near pairs of one list that are in different components."""

    def found(cols: dict, start: np.ndarray, end: np.ndarray) -> Iterator[dict]:
        part = cols["component"]
        mixed = np.minimum.reduceat(part, start) != np.maximum.reduceat(part, start)
        for s, e in zip(start[mixed].tolist(), end[mixed].tolist(), strict=True):
            # The largest component needs no pairs of its own members: the others meet it.
            names, inverse, n = np.unique(part[s:e], return_inverse=True, return_counts=True)
            members = np.arange(s, e)
            small = inverse != n.argmax()
            for i, j in _across(members[small], members, cols["size"], config):
                ok = (part[j] != part[i]) & (~small[j - s] | (j > i))
                yield from _others(cols, [(i[ok], j[ok])], config)

    return _scan(lists, found, "kind int, a long, b long, weight long").select("a", "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, config: Config) -> DataFrame:
    """The pairs (a, b) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                keep.append(config.den * both >= config.num * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: sets.select(F.col("doc_id").alias(c), F.col("set").alias(f"set_{c}"))
    # A set with many pairs goes once to each of several tasks, among which its pairs are dealt.
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(partitions(pairs.sparkSession))).alias("part"))
    set_a = dealt.select("a", "part").distinct().join(of("a"), "a")
    return dealt.join(of("b"), "b").join(set_a, ["a", "part"]).select("a", "b", "set_a", "set_b").mapInArrow(tidy(run), "a long, b long")


def classes_and_links(docs: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep, n_shingles) for every row, and (node, component) for representatives that some link reaches.

    Ids name rows. Empty sets are linked with nothing.
    """
    rows = texts(docs)
    order = docs.sparkSession.sparkContext.broadcast(frequent_shingles(rows, config))  # at most 16 bytes a bucket
    profile = materialise(profiles(rows, config, order))
    reps = materialise(representatives(profile))
    members = profile.select("doc_id", "class_a", "class_b", "size").join(reps.select("class_a", "class_b", "rep"), ["class_a", "class_b"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), F.col("size").alias("n_shingles"))
    shared = heavy_lists(reps)
    light = config.light if config.light is not None else config.boundary(costs_of(reps, shared, config))
    if light:
        shared = shared.where(F.col("size") > light).unionByName(light_lists(reps, config, light))
    shared = shared.select("key", "rep")
    weights = shared.groupBy("rep").agg(F.count("*").alias("weight"))
    listed = materialise(weights.join(reps.select("rep", "size", "sketch"), "rep"))
    lists = shared.join(listed, "rep").select("key", "rep", "weight", "size", "sketch")

    scanned = materialise(first_pairs(lists, config))
    central = scanned.where(F.col("kind") == CENTRAL).groupBy("b").agg(F.max(F.struct("weight", "a")).getField("a").alias("a")).select("a", "b")
    first = materialise(central.unionByName(scanned.where(F.col("kind") == OTHER).select("a", "b").distinct()))
    links = materialise(verified(first, _sets_of(first, rows, config), config))
    parts = connected_components(links)
    placed = listed.join(parts, F.col("rep") == F.col("node"), "left").select("rep", "weight", "size", "sketch", F.coalesce("component", "rep").alias("component"))
    again = scanned.where(F.col("kind") == LISTED).select(F.col("a").alias("key"), F.col("b").alias("rep"))
    mixed = again.join(placed.select("rep", "component"), "rep").groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    second = materialise(cross_pairs(again.join(mixed, "key", "left_semi").join(placed, "rep").select("key", "rep", "weight", "size", "sketch", "component"), config))
    more = materialise(verified(second, _sets_of(second, rows, config), config))
    return members, connected_components(links.unionByName(more))


def _sets_of(pairs: DataFrame, rows: DataFrame, config: Config, most: int = 1_000_000) -> DataFrame:
    """(doc_id, set) of the representatives in pairs. Their ids are broadcast if they are at most `most`, or else joined."""

    def whole(ids: pa.Array, sets: list[np.ndarray]) -> dict:
        return {"doc_id": ids, "set": pa.array([s.tobytes() for s in sets], pa.binary())}

    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    chosen = F.broadcast(wanted) if wanted.count() <= most else wanted
    of = _sets(rows.join(chosen, "doc_id", "left_semi"), config, whole, "doc_id long, set binary")
    return materialise(of)


def _components(docs: DataFrame, config: Config) -> DataFrame:
    """components() of docs whose ids name their rows."""
    members, parts = classes_and_links(docs, config)
    return members.join(parts, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def components(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: component_id is the smallest doc_id reachable by links, its own included.

    A null or empty text has an empty set and is a component of its own. Rows that share an id, or have none, are
    documents of their own: they are linked by their texts alone. A null id is no smallest one; a component without any
    other has a null component_id. A text may be of any length: it is read in blocks, and its set is held as a whole.
    """
    if ids_name_rows(docs):
        return _components(docs, config)
    rows = numbered(docs)
    found = materialise(_components(rows.select(F.col(ROW).alias("doc_id"), "text"), config).withColumnRenamed("doc_id", "row").withColumnRenamed("component_id", "part"))
    own = materialise(found.join(rows.select(F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id")), "row"))
    least = own.groupBy("part").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    return matched(own, least, ["part"], F.col("n") * 1000 > own.count()).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, config: Config = Config(width=5, num=80, den=100)) -> DataFrame:
    """One row of each component of docs, all columns as they are: that with the smallest id.

    Where ids are null or repeat, each row is a document of its own, and goes only if another of its component stays; rows without an id come last, and of equal ids the first row stays.
    """
    if not ids_name_rows(docs):
        rows = numbered(docs)
        found = _components(rows.select(F.col(ROW).alias("doc_id"), "text"), config).select(F.col("doc_id").alias("row"), "component_id")
        order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("row").alias("row"))
        first = found.join(rows.select(F.col(ROW).alias("row"), "doc_id"), "row").groupBy("component_id").agg(F.min(order).getField("row").alias("kept_row"))
        return rows.join(first, F.col(ROW) == F.col("kept_row"), "left_semi").drop(ROW)
    kept = _components(docs, config).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi")
