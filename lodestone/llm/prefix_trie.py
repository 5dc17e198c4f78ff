"""The trie of conversations: what is shared by conversations that begin with the same turns.

A pass over each conversation's turns in order gives the polynomial fingerprint of every prefix. Prefixes of one depth and
fingerprint are a group; its members' last turns are compared whole with those of its representative, its smallest
member, and so is the prefix before; as every prefix is in such a group, a group that passes holds one sequence of turns.
Members that differ are split off and everything is worked out again. Sums over subtrees double the levels they cover
each round, so that rounds follow the logarithm of the longest conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, POWERS, bound_batches, matched, materialise, mix, tidy

_SPLIT = np.uint64(0xD1B54A32D192ED03)


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of each conversation, numbered from 1 by turn (null first), then role and text; null role or text is empty, and rows without a conversation take no part."""
    own = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return own.withColumn("place", F.row_number().over(by)).drop("turn")


def rebuilt(conversations: DataFrame, family: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations after each conversation c takes over the first h turns of c - c % family in place of its own first h, h being crc32(c) % modulus.

    The places keep their numbers: they have gaps where the other one is shorter. A conversation may be left without turns.
    """
    turns = ordered(conversations)
    head = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(modulus))
    every = turns.where("place = 1").select("conv_id", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("first_id"))
    given = turns.where(F.col("place") < modulus).withColumnRenamed("conv_id", "first_id")
    heads = every.join(given, "first_id").where("place <= h").select("conv_id", "place", "role", "text")
    rest = turns.where(F.col("place") > head).select("conv_id", "place", "role", "text")
    return heads.unionByName(rest), every.select("conv_id")


class _Prefixes:
    """Fingerprints of the prefixes of sorted turns, a batch at a time; a conversation may go on in the next one.

    The fingerprint of h1..hd is the sum of h_i * BASE**(d-i): as BASE is odd, sums of h_i * BASE**-i, cumulative over
    the whole batch, give all of them at once.
    """

    def __init__(self, bits: int) -> None:
        self.bits, self.conv, self.held = bits, None, np.zeros(1, np.uint64)

    def take(self, conv: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Depths and fingerprints of the rows, and for each the fingerprints 1, 2, 4, ... turns before (flat, with counts)."""
        n = len(conv)
        new = np.ones(n, bool)
        new[1:] = conv[1:] != conv[:-1]
        new[0] = conv[0] != self.conv
        before = 0 if new[0] else len(self.held) - 1
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        depth = np.arange(n) - start + 1
        depth[start == 0] += before if not new[0] else 0
        POWERS.grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * POWERS.down[:n], out=sums[1:])
        own = (sums[1:] - sums[start]) * POWERS.up[np.arange(n)]
        if before:
            first = int(np.flatnonzero(new)[0]) if new.any() else n
            raw = self.held[-1]
            lift = np.multiply.accumulate(np.full(first, BASE, np.uint64))
            own[:first] += raw * lift
        # All fingerprints of the conversations at hand, each after that of its empty prefix, so that those before are at hand.
        heads = np.flatnonzero(new)
        lead = self.held if not new[0] else np.zeros(0, np.uint64)
        table = np.insert(own, heads, np.zeros(len(heads), np.uint64)) if len(heads) else own
        table = np.concatenate([lead, table])
        at = np.arange(n) + np.cumsum(new) + len(lead)
        counts = np.floor(np.log2(depth)).astype(np.int64) + 1
        ends = np.cumsum(counts)
        step = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
        far = np.repeat(at, counts) - (np.int64(1) << step)
        level = np.repeat(depth, counts) - (np.int64(1) << step)
        self.conv = conv[-1]
        last = int(depth[-1])
        self.held = table[at[-1] - last : at[-1] + 1].copy()
        return depth, self._named(own, depth), self._named(table[far], level), counts

    def _named(self, raw: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """What is kept of a fingerprint; that of the empty prefix is 0."""
        return np.where(depth > 0, mix(raw) >> np.uint64(64 - self.bits), np.uint64(0)).view(np.int64)


def scan(turns: DataFrame, bits: int = 64) -> DataFrame:
    """(conv_id, depth, role, text, split, fp, up) of turns (conv_id, place, role, text, split): up has the fingerprints 1, 2, 4, ... turns before."""
    bound_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Prefixes(bits)
        for b in batches:
            if not b.num_rows:
                continue
            h, split = b.column("h").to_numpy().view(np.uint64), b.column("split").to_numpy().astype(np.uint64)
            # A turn that was split off counts as another.
            h = np.where(split > 0, mix(h + split * _SPLIT), h)
            depth, fp, up, counts = state.take(b.column("conv_id").to_numpy(), h)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(up))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(depth.astype(np.int32)), b.column("role"), b.column("text"), b.column("split"), pa.array(fp), lists], ["conv_id", "depth", "role", "text", "split", "fp", "up"])

    hashed = turns.select("conv_id", "place", "role", "text", F.xxhash64("role", "text").alias("h"), "split")
    dealt = hashed.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(tidy(run), "conv_id long, depth int, role string, text string, split int, fp long, up array<long>")


def _split_off(scanned: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """scanned as turns again, where the members of a group that differ from its representative are marked at the first such turn; None if no group holds two sequences."""
    mixed = nodes.groupBy("depth", "fp").agg(F.count("*").alias("n"), F.min("conv_id").alias("rep")).where("n > 1").select("depth", "fp", "rep")
    if not mixed.limit(1).count():
        return None
    above = F.get("up", F.lit(0))
    theirs = scanned.select(F.col("conv_id").alias("rep"), F.col("depth"), F.struct(above.alias("above"), "role", "text").alias("theirs"))
    other = scanned.join(mixed, ["depth", "fp"]).join(theirs, ["rep", "depth"]).where(F.struct(above.alias("above"), "role", "text") != F.col("theirs"))
    first = other.groupBy("conv_id").agg(F.min("depth").alias("depth")).withColumn("more", F.lit(1))
    marked = scanned.join(first, ["conv_id", "depth"], "left")
    return materialise(marked.select("conv_id", F.col("depth").alias("place"), "role", "text", (F.col("split") + F.coalesce("more", F.lit(0))).alias("split")))


_LISTED = "depth int, fp long, first_id long, ids string"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node in sorted (depth, fp, conv_id), comma-joined, a batch at a time."""
    for b in batches:
        if not b.num_rows:
            continue
        depth, fp, conv = (b.column(c).to_numpy() for c in ("depth", "fp", "conv_id"))
        starts = np.flatnonzero(np.concatenate([[True], (depth[1:] != depth[:-1]) | (fp[1:] != fp[:-1])]))
        ids = [",".join(map(str, x.tolist())) for x in np.split(conv, starts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(depth[starts]), pa.array(fp[starts]), pa.array(conv[starts]), pa.array(ids)], ["depth", "fp", "first_id", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest a node of sorted runs (depth, fp, first_id, ids): they go through it one after the other, so that a node with any number of them takes no memory."""
    key, digest = None, None
    names = ["depth", "fp", "ends_sha256"]
    for b in batches:
        out: list[tuple] = []
        for *own, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "fp", "ids")), strict=True):
            if own == key:
                digest.update(b"," + ids.encode())
                continue
            if key:
                out.append((*key, digest.hexdigest()))
            key, digest = own, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], _DIGESTS)
    if key:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, digest.hexdigest()), strict=True))], _DIGESTS)


_DIGESTS = pa.schema([("depth", pa.int32()), ("fp", pa.int64()), ("ends_sha256", pa.string())])


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, fp, ends_sha256) of (depth, fp, conv_id). Ids are sorted and joined by ranges, which divide a node that many conversations end at; only the digest itself is one pass over the joined runs."""
    runs = ends.repartitionByRange("depth", "fp", "conv_id").sortWithinPartitions("depth", "fp", "conv_id").mapInArrow(_listed, _LISTED)
    return runs.repartition("depth", "fp").sortWithinPartitions("depth", "fp", "first_id").mapInArrow(_digested, "depth int, fp long, ends_sha256 string")


def _rolled_up(tree: DataFrame) -> DataFrame:
    """tree with n_leaves and saved_tokens summed over subtrees. After round k they cover what lies fewer than 2**k levels below; up tells each node's ancestor at that distance."""
    longest = tree.agg(F.max("depth")).first()[0] or 0
    for k in range(int(longest).bit_length()):
        above = tree.where(F.size("up") > k).groupBy((F.col("depth") - (1 << k)).alias("depth"), F.get("up", F.lit(k)).alias("fp")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        added = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
        rest = [c for c in tree.columns if c not in {"n_leaves", "saved_tokens"}]
        tree = materialise(tree.join(above, ["depth", "fp"], "left").select(*rest, added("n_leaves", "more_leaves"), added("saved_tokens", "more_saved")))
    return tree


def trie(turns: DataFrame, conversations: DataFrame, bits: int = 64) -> DataFrame:
    """The nodes of the trie of turns (conv_id, place, role, text) of conversations (conv_id), one row each:
    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    A node is a sequence of turns, equal in role and text, with which some conversation begins; conv_id is the smallest
    member. The root, of depth 0 and without a turn, has all conversations, also those without turns, and a null
    parent. saved_tokens: over the subtree, each node's bytes of its last text for every member but one. A text may be
    empty or as long as a row can be. Without conversations there is no node. bits: of a fingerprint; with few of them
    sequences clash, which costs rounds but changes nothing.
    """
    todo: DataFrame | None = turns.select("conv_id", "place", "role", "text", F.lit(0).alias("split"))
    while todo is not None:
        scanned = materialise(scan(todo, bits))
        kept = scanned.groupBy("depth", "fp", F.get("up", F.lit(0)).alias("above"), "role", "text").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
        nodes = materialise(kept.select("depth", "fp", "above", "conv_id", "n_convs", F.octet_length("text").cast("long").alias("n_bytes")))
        todo = _split_off(scanned, nodes)

    every = materialise(conversations.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id IS NOT NULL").distinct())
    zero = lambda t: F.lit(0).cast(t)
    root = every.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero("int").alias("depth"), zero("long").alias("fp"), F.lit(None).cast("long").alias("above"), "conv_id", "n_convs", zero("long").alias("n_bytes"))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("fp")).agg(F.count("*").alias("n_children"))
    up = scanned.select("conv_id", "depth", "up")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    tree = nodes.unionByName(root).join(children, ["depth", "fp"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = tree.join(up, ["conv_id", "depth"], "left").withColumns({"n_leaves": leaf, "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")})
    tree = _rolled_up(materialise(tree.drop("n_bytes", "above")))

    ends = scanned.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by("fp", "depth").alias("fp"))
    turnless = every.join(ends, "conv_id", "left_anti").select("conv_id", zero("int").alias("depth"), zero("long").alias("fp"))
    tree = tree.join(_ends_digests(ends.unionByName(turnless)), ["depth", "fp"], "left")
    tree = materialise(tree.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))))
    parents = tree.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("above"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = matched(tree.where("depth > 0").withColumn("above", F.get("up", F.lit(0))), parents.withColumnRenamed("n_children", "of"), ["depth", "above"], F.col("of") * 1000 > tree.count())
    long = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return below.select(*long, "ends_sha256").unionByName(tree.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*long, "ends_sha256"))
