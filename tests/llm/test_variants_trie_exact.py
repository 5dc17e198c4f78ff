"""Spelling variants, the trie of conversations and exact duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, prefix_trie, spelling

# --- spelling -------------------------------------------------------------------------------


def counts_by_force(rows: list[tuple]) -> dict[str, int]:
    found: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += len(word) >= 5
    return {w: n for w, n in found.items() if n >= 3}


def variants_by_force(n: dict[str, int]) -> list[tuple]:
    near: dict[str, set[str]] = {w: set() for w in n}
    for a in n:
        for b in n:
            if a != b and abs(len(a) - len(b)) < 2:
                less = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
                replaced = len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
                if replaced or a in less(b) or b in less(a):
                    near[a].add(b)
    best = {w: min(x, key=lambda u: (-n[u], u)) for w, x in near.items() if x}
    form = {w: u for w, u in best.items() if n[u] >= 2 * n[w]}

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def variants(docs: DataFrame, config: spelling.Config) -> list[tuple]:
    runs = spelling.runs(docs)
    own = spelling.counted(runs.select(spelling.misspelt(runs).alias("word")), config)
    return sorted(tuple(r) for r in spelling.variants(own, config).collect())


@pytest.fixture(scope="module")
def misspelt_rows() -> list[tuple]:
    random.seed(5)
    words = ["".join(random.choices("abÀ", k=random.randint(5, 8))) for _ in range(80)] + ["x" * n for n in (5, 6, 7, 40, 41, 600, 601)]
    chain = [w for w, n in (("katte", 4), ("katter", 10), ("katters", 24), ("kattersx", 60), ("kattersxy", 130)) for _ in range(n)]
    each = [w for w in words for _ in range(random.randint(1, 12))] + chain
    random.shuffle(each)
    rows = [(None if i % 9 == 0 else i, " 1".join(each[i * 5 : i * 5 + 5])) for i in range(len(each) // 5)]
    return [*rows, rows[3], rows[3], (1, None), (2, ""), (3, "12 ×÷ 34"), (4, "Straße STRASSE straße " * 9)]


@pytest.mark.parametrize("config", [spelling.Config(), spelling.Config(most=20, at_once=7)], ids=["default", "small cells"])
def test_spelling(spark: SparkSession, misspelt_rows: list[tuple], config: spelling.Config) -> None:
    docs = spark.createDataFrame(misspelt_rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(0) for c in ("word", "n", "m", "cell", "form")})
    got = variants(docs, config)
    assert got == variants_by_force(counts_by_force(misspelt_rows))
    assert sum(r[1] is not None for r in got) > 5
    assert {r[2] for r in got if r[0].startswith("katte")} == {"kattersxy"}  # forms of forms


def test_spelling_of_nothing(spark: SparkSession) -> None:
    assert variants(spark.createDataFrame([], "doc_id long, text string"), spelling.Config()) == []


def test_a_cell_of_most_words_is_halved(spark: SparkSession) -> None:
    """A third of all words share a beginning and an end; cells stay small and nothing near is lost."""
    random.seed(6)
    words = sorted({"a" * 9 + "".join(random.choices("bcdefghijk", k=3)) + "z" * 9 for _ in range(300)} | {"".join(random.choices("lmnopqrst", k=10)) for _ in range(500)})
    n = {w: random.randint(3, 50) for w in words}
    vocabulary = spark.createDataFrame(list(n.items()), "word string, n long")
    config = spelling.Config(most=40)
    cells = spelling.cells(vocabulary, config)
    assert cells.where("hi - lo > 1").groupBy("m", "lo", "hi", "cell").count().agg(F.max("count")).first()[0] <= 40
    assert sorted(tuple(r) for r in spelling.variants(vocabulary, config).collect()) == variants_by_force(n)


def test_wavelet_reports_what_lies_in_both_ranges() -> None:
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 17, 64, 200):
        numbers = rng.permutation(n)
        tree = spelling.Wavelet(numbers)
        lo, hi, least, most = (rng.integers(0, n + 1, 50) for _ in range(4))
        query, value = tree.report(lo, hi, least, most)
        expected = [(q, v) for q in range(50) for v in numbers[lo[q] : hi[q]] if least[q] <= v < most[q]]
        assert sorted(zip(query.tolist(), value.tolist(), strict=True)) == sorted(expected)


# --- the trie -------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def rebuilt_by_force(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = turns.get(first, [])[:h] + v[h:]
    return out


def trie_by_force(turns: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members = defaultdict(list)
    for c, v in turns.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    below = defaultdict(list)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        leaves[p] = sum(leaves[x] for x in below[p]) or 1
        saved[p] = sum(saved[x] for x in below[p]) + (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(m) if len(turns[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks() -> list[tuple]:
    random.seed(3)
    rows = [(random.choice([None, *range(-12, 40)]), random.choice([None, 0, 1, 2, 3, 3, 4]), random.choice([None, "u", "a"]), random.choice([None, "x", "y", "é" * 3])) for _ in range(400)]
    rows += [(c, i, "u", f"t{i % 3}") for c, n in ((77, 300), (78, 270)) for i in range(n)]  # long ones, alike up to where one ends
    rows += [(c, i, "u", "long " * 9000) for c in (80, 85) for i in range(2)]
    return rows + [(100 + c, i, "u", f"same {i}") for c in range(60) for i in range(3)] + [(99, 0, "u", "x"), (99, 0, "u", "x")]


@pytest.mark.parametrize("bits", [64, 11], ids=["fingerprints", "clashing fingerprints"])
def test_trie(spark: SparkSession, talks: list[tuple], bits: int) -> None:
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # conversations go on in the next batch
    try:
        table = spark.createDataFrame(talks, TURNS).repartition(3).withColumns({c: F.lit(1) for c in ("place", "depth", "fp", "up", "split", "h")})
        got = sorted((tuple(r) for r in prefix_trie.trie(*prefix_trie.rebuilt(table), bits=bits).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == trie_by_force(rebuilt_by_force(talks))


def test_clashing_prefixes_are_split(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    rounds = []
    plain = prefix_trie._split_off  # noqa: SLF001

    def told(*args: DataFrame) -> DataFrame | None:
        rounds.append(plain(*args))
        return rounds[-1]

    monkeypatch.setattr(prefix_trie, "_split_off", told)
    turns = {c: [("u", f"{c % 3}"), ("a", f"{c % 7}"), ("u", f"{c}")] for c in range(60)}
    rows = [(c, i + 1, *t) for c, v in turns.items() for i, t in enumerate(v)]
    table = spark.createDataFrame(rows, "conv_id long, place int, role string, text string")
    got = prefix_trie.trie(table, table.select("conv_id"), bits=9)
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie_by_force(turns)
    assert len(rounds) > 1
    assert rounds[-1] is None


def test_trie_of_nothing(spark: SparkSession) -> None:
    assert prefix_trie.trie(*prefix_trie.rebuilt(spark.createDataFrame([(None, 1, "u", "x")], TURNS))).collect() == []
    # A conversation that is left without turns ends at the root.
    c = next(c for c in range(6, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    assert [tuple(r)[:7] for r in prefix_trie.trie(*prefix_trie.rebuilt(spark.createDataFrame([(c, None, None, None)], TURNS))).collect()] == [(c, 0, None, 1, 0, 1, 0)]


# --- exact duplicates -----------------------------------------------------------------------


def labelled_by_force(rows: list[tuple]) -> Counter:
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out: Counter = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0))):
            out[(i, keep, len(ids), k == len(ids) - 1, sha)] += 1
    return out


@pytest.fixture(scope="module")
def copies() -> list[tuple]:
    random.seed(8)
    texts = ["", " ", "a", "A", "a ", "é", "é", "long " * 40_000, *(f"text {i}" for i in range(20))]
    rows = [(i, random.choice(texts)) for i in range(200)] + [(300 + i, "hot") for i in range(150)]
    return [*rows, (900, None), (901, None), (902, "alone")]


def labels(df: DataFrame) -> Counter:
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_exact_duplicates(spark: SparkSession, copies: list[tuple], clashing: DataFrame, rows: list[tuple]) -> None:
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(7).withColumns({c: F.lit(1) for c in ("digest", "salt", "place", "bits", "keep_id", "kept")})
    assert labels(exact_dedup.deduplicate(docs)) == labelled_by_force(copies)
    # Digests that clash, in a bitmap of one row: texts alone tell groups apart.
    for digest in (lambda c: F.crc32(c) % 3, lambda c: F.lit(5)):
        assert labels(exact_dedup.labelled(docs, digest=digest, bitmap_rows=1)) == labelled_by_force(copies)
    assert labels(exact_dedup.deduplicate(clashing)) == labelled_by_force([r[:2] for r in rows])


def test_exact_duplicates_with_null_and_repeated_ids(spark: SparkSession, copies: list[tuple]) -> None:
    random.seed(9)
    rows = [(random.choice([None, 5, i]), t) for i, t in copies]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("other", F.lit("x"))
    assert labels(exact_dedup.deduplicate(docs)) == labelled_by_force(rows)
    assert Counter(r["text"] or "" for r in exact_dedup.unique(docs).collect()) == Counter({t or "": 1 for _, t in rows})
    assert exact_dedup.unique(docs).columns == ["doc_id", "text", "other"]


def test_exact_duplicates_edges(spark: SparkSession, empty: DataFrame) -> None:
    assert exact_dedup.deduplicate(empty).collect() == []
    assert exact_dedup.unique(empty).columns == empty.columns
    docs = spark.createDataFrame([(1, "A b"), (2, "a B")], "doc_id long, text string")
    assert {r["keep_id"] for r in exact_dedup.deduplicate(docs, normal=F.lower).collect()} == {2}


def test_native_plan(spark: SparkSession, copies: list[tuple]) -> None:
    plan = exact_dedup.deduplicate(spark.createDataFrame(copies, "doc_id long, text string"))._jdf.queryExecution().toString()  # noqa: SLF001
    assert not re.search("Python|Pandas|Arrow", plan)
