"""Each operator against a brute-force version, on tables with every odd case."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import common, fingerprints, jaccard_join, language_id, license_scan, lm_scoring, packing, sentencepiece_codec, suffix_dedup, token_counts, topk_search
from lodestone.llm.components import connected_components

VECTORS = "vec_id long, embedding array<float>, label int"


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def tokens(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))


# --- 1 ------------------------------------------------------------------------------


def best_by_force(rows, k):  # noqa: ANN001, ANN201
    own = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(1024 * float(np.float32(x))) for x in v]
            own[i] = min(own.get(i, q), q)
    out = set()
    for i, v in own.items():
        if i % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in own.items() if j != i and len(w) == len(v))
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(found[:k], 1)}
    return out


def test_topk(spark):  # noqa: ANN001
    random.seed(2)
    rows = [(i, [random.choice([-0.5, 0.0, 0.25, random.uniform(-1, 1)]) for _ in range(6)], 0) for i in range(900)]
    rows += [(900, None, 0), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (902, [math.nan] * 6, 0), (903, [math.inf] + [0.0] * 5, 0), (904, [], 0), (None, [0.1] * 6, 0), (1000, [0.5, 0.5], 0), (1001, [0.5, 0.1], 0)]
    rows += rows[:3] + [(7, [0.9] * 6, 0)] + [(2000 + i, [0.25] * 6, 0) for i in range(40)]
    table = spark.createDataFrame(rows, VECTORS).withColumns({"rank": F.lit(1), "shard": F.lit(2), "dim": F.lit(3), "score": F.lit(4)})
    for size in ({}, {"shard_rows": 100, "block_rows": 3, "page_shards": 4, "leaf": 4}):
        got = topk_search.search(table, F.col("vec_id") % 100 == 0, 10, **size)
        assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == best_by_force(rows, 10)
    assert topk_search.search(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).collect() == []


def test_topk_large_components(spark):  # noqa: ANN001
    rows = [(0, [0.5, 1.0], 0)] + [(i, [3.0e6 + i % 7, -1.0], 0) for i in range(1, 30)]  # products stay below 2**53
    got = topk_search.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, 3, shard_rows=8, leaf=2)
    assert {tuple(r) for r in got.collect()} == best_by_force(rows, 3)


def test_topk_sends_only_what_can_win(spark, monkeypatch):  # noqa: ANN001
    """Of vectors in far groups, a query asks a few shards beside its first one; a stored tree answers as a built one does."""
    rng = np.random.default_rng(3)
    groups = rng.normal(size=(16, 8)) * 3
    rows = [(i, (groups[i % 16] + rng.normal(size=8) * 0.01).tolist(), 0) for i in range(3200)]
    sent = []
    visit = topk_search._visit
    monkeypatch.setattr(topk_search, "_visit", lambda trees, asking, k: sent.append((trees.count(), asking.select(F.sum(F.size("query_ids"))).first()[0] or 0)) or visit(trees, asking, k))
    got = topk_search.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, 10, shard_rows=100, leaf=16)
    assert {tuple(r) for r in got.collect()} == best_by_force(rows, 10)
    (shards, first), (_, later) = sent
    assert first == 32 and later < 32 * (shards - 1) / 2
    ids, m = np.arange(300), rng.integers(-50, 50, (300, 5)).astype(float)
    tree = topk_search.BallTree.built(ids, m, 8)
    for q in range(20):
        want = sorted(((int(s), -j) for j, s in enumerate((m @ m[q]).astype(int)) if j != q), reverse=True)[:4]
        assert sorted(tree.search(m[q], q, 4, float("-inf")), reverse=True) == want


# --- 2 ------------------------------------------------------------------------------


def test_licences(spark, rows, clashing, empty):  # noqa: ANN001
    extra = [(1000, "MIT License mit license", "en", "s", 0), (1001, "the MIK mit", None, None, 0), (1002, "GNU General PUBLIC license, GNU general Public", None, None, 0), (1003, "licensed under the apache license version 3 2 0", None, None, 0), (1004, "CC BY-SA cc by cc  by", None, None, 0)]
    every = rows + extra
    got = {r["doc_id"]: r for r in license_scan.scan(clashing.select("doc_id", "text", "lang", "key", "template").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", "text", "lang").withColumns({"key": F.lit(0), "template": F.lit(0)}))).collect()}
    assert len(got) == len(every)
    for i, t, *_ in every:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        places, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            for k in range(len(words)):
                if words[k : k + len(p)] == p:
                    places.append(k)
                    labels.add(label)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert "apache-2.0" in got[1003]["labels"]  # one word too many, or another
    assert license_scan.scan(empty).collect() == []


def test_licence_rows_that_repeat(spark):  # noqa: ANN001
    twice = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (1, "mit")], "doc_id long, text string")
    assert sorted((r["n_words"], r["n_base"]) for r in license_scan.scan(twice).collect()) == [(1, 0), (2, 1)]


# --- 3 ------------------------------------------------------------------------------


def test_fingerprints(spark, rows, clashing, empty):  # noqa: ANN001
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(clashing).collect()}
    order = sorted(rows)
    seen = {}
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert t.split() or not r["fingerprint"]
        if edited == t:
            assert r["near_edited"] == 1
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    def sketch(t):  # noqa: ANN001, ANN202
        words, out = re.findall(r"[^\x20\x09-\x0D]+", t), set()
        for k in range(max(1, len(words) - 4) if words else 0):
            h = 42  # each word's hash is the seed of the next
            for w in words[k : k + 5]:
                h = xxhash.xxh64_intdigest(w.encode(), h)
            out.add(h - (1 << 64) if h >= 1 << 63 else h)
        return {h for h in out if h < -(1 << 63) + (1 << 64) // 5}

    def held(a, b, same):  # noqa: ANN001, ANN202
        small = min(len(a), len(b))
        return len(a & b) / small if small else float(same)

    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 4
        changed = t[: len(t) - m] + after[:m]
        own, edited, following = sketch(t), sketch(changed), sketch(after)
        r = got[i]
        assert r["fingerprint"] == "".join(f"{h % (1 << 64):016x}" for h in sorted(own))
        assert r["edited_fingerprint"] == "".join(f"{h % (1 << 64):016x}" for h in sorted(edited))
        assert (r["near_edited"], r["near_next"]) == pytest.approx((held(own, edited, t == changed), held(own, following, t == after)))
    assert fingerprints.fingerprint(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b"), (3, "c d"), (3, "c d")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1) for r in fingerprints.fingerprint(odd).collect()) == [-1, 3]


def test_empty_sketches_are_alike_for_equal_texts_alone(spark):  # noqa: ANN001
    words = [f"q{i}" for i in range(200)]
    sketched = fingerprints.with_sketch(spark.createDataFrame([(w,) for w in words], "w string"), "w", "s")
    bare = [r["w"] for r in sketched.where("size(s) = 0").orderBy("w").limit(3).collect()]
    docs = spark.createDataFrame([(1, bare[0]), (2, bare[1]), (3, bare[1]), (4, bare[2])], "doc_id long, text string")
    got = fingerprints.fingerprint(docs).orderBy("doc_id").collect()
    assert [r["fingerprint"] for r in got] == [""] * 4
    assert [r["near_next"] for r in got] == [0, 1, 0, 0]
    same = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r["near_edited"], r["near_next"]) for r in fingerprints.fingerprint(same).collect()] == [(1, 1), (1, 1)]


def test_containment_of_unequal_documents(spark):  # noqa: ANN001
    random.seed(4)
    whole = [f"w{random.random()}" for _ in range(4000)]
    table = spark.createDataFrame([(0, " ".join(whole[1000:1400]), " ".join(whole))], "i int, a string, b string")
    both = fingerprints.with_sketch(fingerprints.with_sketch(table, "a", "sa"), "b", "sb")
    assert both.select(fingerprints.containment(F.col("sa"), F.col("sb"))).first()[0] == 1
    assert 600 < len(both.first()["sb"]) < 1000
    # Sketches of parts that share the words of a shingle merge to that of the whole; of edits, a likeness near the true one is left.
    parts = [" ".join(whole[i : i + 404]) for i in range(0, 4000, 400)]
    merged = fingerprints.with_sketch(spark.createDataFrame([(p,) for p in parts], "p string"), "p", "s").collect()
    assert sorted({h for r in merged for h in r["s"]}) == both.first()["sb"]
    edited = " ".join(whole[:3000] + [f"x{random.random()}" for _ in range(1000)])
    pair = fingerprints.with_sketch(fingerprints.with_sketch(spark.createDataFrame([(" ".join(whole), edited)], "a string, b string"), "a", "sa"), "b", "sb")
    assert abs(pair.select(fingerprints.containment(F.col("sa"), F.col("sb"))).first()[0] - 0.75) < 0.06


# --- 4 ------------------------------------------------------------------------------


def language_rows(n=400):  # noqa: ANN001, ANN201
    random.seed(6)
    alphabet = {"en": ["th", "er", "on", "an", "ing"], "de": ["sch", "ein", "ung", "ch", "ß"], "fr": ["eau", "é", "oi", "ç", "que"]}
    return [(i, " ".join("".join(random.choices(alphabet[lang], k=random.randint(1, 4))) for _ in range(random.randint(4, 60))), lang) for i in range(n) for lang in [random.choice(list(alphabet))]]


def test_language(spark, docs, empty):  # noqa: ANN001
    rows = language_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.fit(table.where("doc_id % 4 <> 2").select("text", "lang"))
    got = {r["doc_id"]: r for r in language_id.predict(table, filters).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if i % 4 == 2]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "a"), (5, "\0 th \0er"), (6, "日本")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in language_id.predict(odd, filters).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
    assert language_id.predict(docs, language_id.fit(empty)).where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert language_id.predict(empty, filters).count() == 0
    kept = language_id.keep_identified(odd.withColumn("score", F.lit(1)), filters, 0.0)
    assert {r["doc_id"] for r in kept.collect()} == {4, 5, 6} and kept.columns == ["doc_id", "text", "score"]


def test_language_masks():
    """Masks, popcounts and correction against sets of n-grams and plain counting, with languages in two mask words."""
    random.seed(7)
    config = language_id.Config(slots_log2=14)
    words = ["".join(random.choices("abcdefgh", k=4)) for _ in range(300)]
    names = [f"l{k:02d}" for k in range(70)]
    held = {k: set(language_id.ngrams([" ".join(random.sample(words, 40))], 3)[0].tolist()) for k in names}
    tables, fill = [np.zeros(1 << 14, np.uint64) for _ in range(2)], []
    for i, k in enumerate(names):
        for s in language_id._slots(np.array(sorted(held[k]), np.uint64), config):
            tables[i // 64][s] |= np.uint64(1 << i % 64)
        fill.append(np.mean((tables[i // 64] >> np.uint64(i % 64)) & np.uint64(1)))
    filters = language_id.Filters(names, tables, np.array(fill) ** 3, config)
    docs = [" ".join(random.choices(words, k=30)) for _ in range(20)]
    langs, scores = language_id.predict_batch(docs, filters)
    for doc, lang, score in zip(docs, langs, scores, strict=True):
        grams = language_id.ngrams([doc], 3)[0].tolist()
        by_slot = {g: [int(s[0]) for s in language_id._slots(np.array([g], np.uint64), config)] for g in set(grams)}
        shares = []
        for i, k in enumerate(names):
            n = sum(all(int(tables[i // 64][s]) >> i % 64 & 1 for s in by_slot[g]) for g in grams)
            assert n >= sum(g in held[k] for g in grams)
            shares.append(min(1, max(0, (n / len(grams) - fill[i] ** 3) / (1 - fill[i] ** 3))))
        assert (lang, score) == (names[shares.index(max(shares))], pytest.approx(max(shares)))


def test_no_language_is_left_out(spark):  # noqa: ANN001
    """Seventy languages, of which one has a group of copies, in columns of names that are used inside."""
    random.seed(8)
    rows = [(100 * k + i, " ".join(chr(0x4E00 + 20 * k + random.randrange(8)) * 3 for _ in range(12)), f"l{k:02d}") for k in range(70) for i in range(6)]
    rows += [(100_000 + i, rows[0][1], "l00") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("of_text", "of_lang", "share", "gram", "n", "rate", "best", "place")})
    filters = language_id.fit(table, language_id.Config(min_count=1))
    assert len(filters.languages) == 70
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(table, filters).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    kept = language_id.keep_identified(table, filters)
    assert kept.columns == table.columns and kept.count() == len(rows)


def test_language_of_little_text(spark):  # noqa: ANN001
    """One short text is all there is of a language, beside a long one of another: no n-gram of it occurs five times."""
    polish = "Zażółć gęślą jaźń, niech każdy usłyszy"
    english = " ".join("the other thing that they were thinking of was on the way there".split()) + " "
    table = spark.createDataFrame([(1, polish, "pl"), (2, english * 500, "en"), (3, polish, None), (4, "they were there", None)], "doc_id long, text string, lang string")
    filters = language_id.fit(table)
    got = {r["doc_id"]: (r["lang_pred"], r["score"] > 0.5) for r in language_id.predict(table, filters).collect()}
    assert got == {1: ("pl", True), 2: ("en", True), 3: ("pl", True), 4: ("en", True)}


# --- 5 ------------------------------------------------------------------------------


def removed_by_force(rows, length):  # noqa: ANN001, ANN201
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if (w := raw[p : p + length]) in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("config", [suffix_dedup.Config(), suffix_dedup.Config(hot=2), suffix_dedup.Config(length=12, gram=4, hot=5, block=64)])
def test_suffix_dedup(spark, rows, clashing, config):  # noqa: ANN001
    random.seed(8)
    extra = [(1000 + i, "".join(random.choices("ab", k=random.randint(0, 90)))) for i in range(60)]
    every = [(r[0], r[1]) for r in rows] + extra
    table = clashing.select("doc_id", "text", "around", "found").unionByName(spark.createDataFrame(extra, "doc_id long, text string").withColumns({"around": F.lit(0), "found": F.lit(0)}))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.deduplicate(table, config).collect()}
    assert got == removed_by_force(every, config.length)


def test_merging_is_on_the_ordinary_path(spark, monkeypatch):  # noqa: ANN001
    """A passage of more documents than a merging shard takes comes by the sorted lists that binary search merges."""
    random.seed(18)
    word = lambda n: " ".join(f"{random.randrange(10**6)}" for _ in range(n))
    passage = word(40)
    rows = [(i, f"{word(15)} {passage} {word(15)}") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    config = suffix_dedup.Config(hot=7)
    merge, seen = suffix_dedup.merge_shards, []
    monkeypatch.setattr(suffix_dedup, "merge_shards", lambda found, *more: seen.append(found) or merge(found, *more))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.deduplicate(table, config).collect()}
    assert got == removed_by_force(rows, 100)
    lists = seen[0].where("string IS NOT NULL").groupBy("shard").count().collect()
    assert len(lists) > 1 and min(r["count"] for r in lists) >= 100


def test_merged_lists():
    random.seed(19)
    for _ in range(50):
        lists = []
        for k in range(2):
            strings = sorted({"".join(random.choices("ab", k=3)).encode() for _ in range(random.randint(1, 8))})
            lists.append((np.array(strings, "S3"), np.array([random.randint(0, 3) for _ in strings]), np.array([100 * k + random.randint(0, 50) for _ in strings])))
        places = {}
        for strings, doc, lo in lists:
            for s, d, at in zip(strings.tolist(), doc.tolist(), lo.tolist(), strict=True):
                places.setdefault(s, []).append((d, at))
        (strings, doc, lo), (of, at) = suffix_dedup.merged(*lists)
        assert list(zip(strings.tolist(), doc.tolist(), lo.tolist(), strict=True)) == [(s, *min(p)) for s, p in sorted(places.items())]
        assert sorted(zip(of.tolist(), at.tolist(), strict=True)) == sorted(max(p) for p in places.values() if len(p) > 1)


def test_suffix_dedup_edges(spark, empty):  # noqa: ANN001
    assert suffix_dedup.deduplicate(empty).collect() == []
    odd = spark.createDataFrame([(None, "y" * 120), (None, "z"), (1, "y" * 120), (1, "y" * 120)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.deduplicate(odd).collect()) == [(0, 119), (1, 120)]
    texts = {1: "é" * 200, 2: "é" * 60 + "rest", 3: "é" * 60, 4: None}
    rest = suffix_dedup.remove_repeats(spark.createDataFrame([(i, t, t and len(t), "k") for i, t in texts.items()], "doc_id long, text string, n_chars long, row string"))
    left = {i: x[3].decode(errors="ignore") for i, x in removed_by_force(texts.items(), 100).items()}
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in rest.where("doc_id <> 4").collect()) == [(i, left[i], len(left[i])) for i in (1, 2)] and not left[3]
    assert rest.where("doc_id = 4").first()["text"] is None and rest.columns == ["doc_id", "text", "n_chars", "row"]


def test_suffix_arrays():
    random.seed(9)
    for _ in range(40):
        raw = "".join(random.choices("ab", k=random.randint(1, 300))).encode() * random.choice([1, 3])
        depth = random.choice([8, 16, 40])
        order = suffix_dedup.suffix_array(np.frombuffer(raw, np.uint8), depth)
        keys = [raw[i : i + depth].ljust(depth, b"\0") for i in order.tolist()]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(raw)))

        def shared(a, b, raw=raw, depth=depth):  # noqa: ANN001, ANN202
            n = 0
            while n < depth and max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
                n += 1
            return n

        own = suffix_dedup.common_prefixes(np.frombuffer(raw, np.uint8), order, depth).tolist()
        assert own == [0] + [shared(a, b) for a, b in zip(order.tolist(), order.tolist()[1:], strict=False)]


# --- 6 ------------------------------------------------------------------------------


def test_token_counts(spark, rows, clashing, empty):  # noqa: ANN001
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    cut = token_counts.PreTokens(ranks, pattern)
    random.seed(10)
    edits = {r[0]: [(random.randint(0, 400), random.randint(0, 400), random.choice(["", " the", "'s", "  ", "é\n"])) for _ in range(random.randint(0, 4))] for r in rows}
    table = spark.createDataFrame([(i, k, *e) for i, es in edits.items() for k, e in enumerate(es)], "doc_id long, seq int, start long, end long, text string")
    got = {r["doc_id"]: r for r in token_counts.count(token_counts.with_edits(clashing, table), ranks, pattern).collect()}
    for i, t, *_ in rows:
        t = now = t or ""
        for s, e, new in edits[i]:
            s = min(s, len(now))
            now = now[:s] + new + now[max(s, min(e, len(now))) :]
        r = got[i]
        assert (r["n_chars"], r["n_tokens"], r["n_edits"], r["edited_n_chars"], r["edited_n_tokens"]) == (len(t), len(cut.lib.encode_ordinary(t)), len(edits[i]), len(now), len(cut.lib.encode_ordinary(now)))
    assert got[63]["n_reencoded"] < 600 * max(1, got[63]["n_edits"])
    assert token_counts.count(empty.withColumn("edits", F.lit(None)), ranks, pattern).collect() == []


def test_counted_text():
    cut = token_counts.PreTokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    random.seed(11)
    parts = ["a", "b", " ", "  ", "\n", "'", "s", "'s", "1", "!", "é", "\t", "word", "the ", "😀"]
    for _ in range(300):
        doc = token_counts.CountedText("".join(random.choices(parts, k=random.randint(0, 400))), cut)
        for _ in range(4):
            s = random.randint(0, len(doc.text) + 2)
            e, new = s + random.randint(0, 10), "".join(random.choices(parts, k=random.randint(0, 6)))
            expected = doc.text[:s] + new + doc.text[max(s, e) :]
            doc.replace(s, e, new)
            assert doc.text == expected and doc.n_tokens == len(cut.lib.encode_ordinary(expected))


# --- 7 ------------------------------------------------------------------------------


def test_lm_scores(spark, rows, clashing, empty):  # noqa: ANN001
    held_out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    config = lm_scoring.Config(words=6, classes=5, head=9)
    scored = lm_scoring.score(clashing, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1, config)
    got = {r["doc_id"]: r for r in scored.collect()}
    toks = {r[0]: [*tokens(r[1]), None] for r in rows}
    c = Counter(w for i, ws in toks.items() if not held_out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert r["score"] < 0
    none = lm_scoring.score(clashing, F.lit(False), config).collect()
    assert {r["n_known"] for r in none} == {0} and all(math.isfinite(r["score"]) for r in none)
    assert lm_scoring.score(empty, F.lit(True), config).collect() == []


def test_lm_is_normalised_and_learns():
    config = lm_scoring.Config(words=4, classes=3, rate=0.2)
    rng = np.random.default_rng(0)
    model = lm_scoring.Model(rng.normal(size=(4, 9, 16)).astype(np.float32), rng.normal(size=(8, 16)).astype(np.float32), rng.normal(size=8).astype(np.float32))
    context = rng.integers(0, 9, (20, 4))
    total = sum(10.0 ** lm_scoring.log_probabilities(np.full(20, k), context, model).astype(float) for k in range(8))
    assert np.allclose(total, 1, atol=1e-5)
    docs = [" ".join(["aa", "bb", "cc", "dd"] * 30)] * 40
    words, ending, _ = lm_scoring.word_hashes(docs)
    distinct, first, n = np.unique(words, return_index=True, return_counts=True)
    known = lm_scoring.Counts(distinct, n, np.arange(4), np.ones(4, bool), 40, int(n.sum()) + 40, 5, np.zeros(3), np.zeros(3))
    trained = lm_scoring.train(docs, known, config)
    token, context, *_ = lm_scoring.sequences(docs[:1], known, config)
    assert lm_scoring.log_probabilities(token, context, trained).mean() > math.log10(0.5)


def test_lm_learns_from_all_documents(spark):  # noqa: ANN001
    """Documents of every group and of any length count, and neither the order nor the partitions of rows matter."""
    texts = {i: " ".join(["aa", "bb", "cc", "dd"] * (20_000 if i == 5 else 30)) for i in range(64)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    config = lm_scoring.Config(words=4, classes=3, group_docs=4, block_chars=1000)
    known = lm_scoring.summarise(lm_scoring.word_counts(table.select("text"), config), len(texts), config)
    models = []
    for t in (table.repartition(5), table.coalesce(1).orderBy(F.desc("doc_id"))):
        model, n = lm_scoring.train_all(t, len(texts), known, config)
        assert n == known.tokens
        models.append(model)
    assert all(np.array_equal(getattr(models[0], k), getattr(models[1], k)) for k in ("places", "vectors", "bias"))
    long = lm_scoring.score(table.where("doc_id = 5"), F.lit(True), lm_scoring.Config(words=4, classes=3)).first()
    assert long["score"] / long["n_tokens"] > math.log10(0.5)


# --- 8 ------------------------------------------------------------------------------


def components_by_force(rows, config):  # noqa: ANN001, ANN201
    sets = {}
    for i, t in rows:
        w = tokens(t)
        sets[i] = {tuple(w[k : k + config.width]) for k in range(len(w) - config.width + 1)} if len(w) >= config.width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):  # noqa: ANN001, ANN202
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and config.den * len(sets[a] & sets[b]) >= config.num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("config", [jaccard_join.Config(), jaccard_join.Config(width=5, num=80), jaccard_join.Config(width=1, num=60, sample=1), jaccard_join.Config(width=2, num=100), *(jaccard_join.Config(light=n, num=80) for n in (0, 12, 30))])
def test_jaccard_join(spark, rows, clashing, config):  # noqa: ANN001
    random.seed(12)
    base = [f"w{k}" for k in range(60)]
    extra = []
    for i in range(60):  # a group of near copies, and small sets that differ by a word
        words = list(base)
        for k in random.sample(range(60), random.choice([1, 2, 3, 6])):
            words[k] = f"e{i}"
        extra.append((2000 + i, " ".join(words)))
        extra.append((3000 + i, " ".join(base[: random.randint(1, 13)])))
    table = clashing.select("doc_id", "text", "rep", "size", "key" if "key" in clashing.columns else "n").unionByName(spark.createDataFrame(extra, "doc_id long, text string").withColumns({"rep": F.lit(0), "size": F.lit(0), "key": F.lit(0)}))
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.components(table, config).collect()}
    assert got == components_by_force([(r[0], r[1]) for r in rows] + extra, config)


def test_boundary_follows_the_data(spark):  # noqa: ANN001
    """Small sets with long lists are enumerated, and the same sets with lists of their own are listed."""
    random.seed(17)
    config = jaccard_join.Config(width=1, num=80, sample=1)
    none = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    crowded = [(i, " ".join([*(f"w{k}" for k in range(9)), f"e{i}"])) for i in range(400)]
    apart = [(i, " ".join(f"w{i}x{k}" for k in range(10))) for i in range(400)]
    light = {}
    for name, rows in (("crowded", crowded), ("apart", apart)):
        costs = jaccard_join.list_costs(spark.createDataFrame(rows, "doc_id long, text string"), config, none)
        assert costs[10][0] == 400
        light[name] = config.boundary(costs)
    assert light["apart"] < 10 <= light["crowded"]
    table = spark.createDataFrame(crowded[:60], "doc_id long, text string")
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.components(table, config).collect()} == components_by_force(crowded[:60], config)


def test_jaccard_lists_of_two(spark):  # noqa: ANN001
    """A middle set listed with each of its neighbours in a list of two: the first round takes one center for it, the second must take the other."""
    random.seed(14)
    rows, config = [], jaccard_join.Config(light=9)
    none = np.zeros(0, np.uint64)
    while len(rows) < 30:
        w = [f"v{random.randrange(10**9)}" for _ in range(14)]
        whole, first, last = jaccard_join.shingle_sets([" ".join(w), " ".join(w[:3]), " ".join(w[-3:])], 3)
        if set(jaccard_join.keys_of(whole, config, 9, none, none).tolist()) == {int(first[0]), int(last[0])}:
            rows += [(len(rows), " ".join(w[:-1])), (len(rows) + 1, " ".join(w[1:])), (len(rows) + 2, " ".join(w))]
    for _ in range(40):  # chains of near copies
        w = [f"c{random.randrange(10**9)}" for _ in range(random.randint(10, 40))]
        for _ in range(6):
            rows.append((len(rows), " ".join(w)))
            w = random.choice([w[1:], w[:-1], [*w, "x"], ["y", *w]])
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.components(table, config).collect()} == components_by_force(rows, config)


def test_jaccard_edges(spark, empty):  # noqa: ANN001
    assert jaccard_join.components(empty).collect() == []
    few = spark.createDataFrame([(3, "a b c d", "x"), (2, "a b c d", "y"), (9, None, "z"), (8, "", "z")], "doc_id long, text string, rep string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.components(few).collect()} == {(3, 2), (2, 2), (9, 9), (8, 8)}
    kept = jaccard_join.keep_one(few)
    assert {r["doc_id"] for r in kept.collect()} == {2, 8, 9} and kept.columns == few.columns


def test_sketches_bound_distance():
    random.seed(13)
    for _ in range(100):
        a = np.unique(np.array([random.getrandbits(64) for _ in range(random.randint(1, 400))], np.uint64))
        b = np.unique(np.concatenate([a[random.randint(0, 20) :], np.array([random.getrandbits(64) for _ in range(random.randint(0, 60))], np.uint64)]))
        x, y = jaccard_join.sketch(a), jaccard_join.sketch(b) if len(b) else np.zeros(1, np.uint64)
        n = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(s.reshape(-1, n), 0) for s in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components(spark):  # noqa: ANN001
    random.seed(14)
    edges = [(random.randint(0, 200), random.randint(0, 200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)]
    root = {}

    def find(x):  # noqa: ANN001, ANN202
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert {x: got.get(x, x) for x in linked} == {x: find(x) for x in linked}


# --- 9 ------------------------------------------------------------------------------


def test_sentencepiece(rows, clashing, empty):  # noqa: ANN001
    model = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece_codec.Codec(model).lib
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode(clashing, model).collect()}
    digests = {r["doc_id"]: r for r in sentencepiece_codec.encode_digests(clashing, model).collect()}
    for i, t, *_ in rows:
        ids = lib.encode(t or "")
        decoded = lib.decode(ids) if ids else ""
        assert (got[i]["n_tokens"], got[i]["ids"], got[i]["decoded"]) == (len(ids), ids, decoded)
        assert (digests[i]["ids_sha256"], digests[i]["decoded_sha256"]) == (hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert sum(r["n_differing"] for r in got.values()) == 0
    assert sentencepiece_codec.encode_digests(empty, model).collect() == []


def test_agenda_alone():
    codec = sentencepiece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"), cache_chars=2000)
    random.seed(15)
    texts = ["", " ", "  a  b\n c", "▁a ▁", "x" * 300, "日本語😀" * 40, "\x00\t\r a", *["".join(random.choices("abcth ▁é😀.", k=random.randint(1, 120))) for _ in range(400)]]
    assert list(codec.encode(texts)) == codec.lib.encode(texts)
    assert codec.differing == 0
    assert codec.heap_agenda("▁" + "abcabc" * 30) == codec.lib.encode("abcabc" * 30)


# --- 10 -----------------------------------------------------------------------------


def check_packed(rows, got, size, tokenizer):  # noqa: ANN001, ANN201
    lib = packing.word_tokens(tokenizer).lib
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in parts] == [(k, s, min(size, len(ids) - s)) for k, s in enumerate(range(0, len(ids), size))]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in parts)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_packing(rows, clashing, empty):  # noqa: ANN001
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(clashing, tokenizer, 256).collect()
    n = check_packed([(r[0], r[1]) for r in rows], got, 256, tokenizer)
    assert n <= 1.2 * sum(r["length"] for r in got) / 256 + 1
    assert packing.pack_documents(empty, tokenizer).collect() == []


def test_best_fit():
    random.seed(16)
    for n_open in (1, 3, 50):
        lengths = [random.randint(1, 64) for _ in range(500)]
        where, offset = packing.best_fit(lengths, 64, n_open)
        used = Counter()
        for w, o, n in zip(where, offset, lengths, strict=True):
            assert o == used[w]
            used[w] += n
        assert max(used.values()) <= 64
    assert packing.best_fit([40, 30, 24, 34], 64, 9)[0] == [0, 1, 0, 1]


@pytest.mark.parametrize("n_open", [1, 4, 1000])
def test_best_fit_against_a_plain_list(n_open):  # noqa: ANN001
    """The open bins in a list: the tightest that fits takes the piece, the fullest closes where none does."""
    random.seed(17)
    lengths = [random.choice([64, random.randint(1, 64), random.randint(1, 9)]) for _ in range(3000)]
    free, closed = [], []
    for n in lengths:
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
            left = min(fits) - n
        else:
            if len(free) >= n_open:
                closed.append(min(free))
                free.remove(min(free))
            left = 64 - n
        (free if left else closed).append(left)
    where, _ = packing.best_fit(lengths, 64, n_open)
    used = Counter()
    for w, n in zip(where, lengths, strict=True):
        used[w] += n
    assert sorted(64 - u for u in used.values()) == sorted(free + closed)


def test_batches_are_gathered():
    batches = [packing.pa.RecordBatch.from_pydict({"n": [i], "text": ["x" * size]}) for i, size in enumerate([3, 0, 9, 1, 40, 2, 0])]
    for least in (1, 10, 100):
        got = list(common.gathered(iter(batches), least=least))
        assert [n for b in got for n in b["n"].to_pylist()] == list(range(7))
        assert all(sum(map(len, b["text"].to_pylist())) >= least for b in got[:-1])
    assert list(common.gathered(iter([]))) == [] and list(common.gathered(iter([batches[0].slice(0, 0)]))) == []


def test_word_by_word_encoding_is_the_tokenizers():
    own = packing.word_tokens(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", "a b", "don't  It's x\x1c y", "éÉ é ́a", "<|endoftext|> a<|startoftext|>b", "ΑΣ Σ İK", "a\n\nb \t c", "😀日本", "\x01", "a \x01 b\x01c", "x.,y é***! ,. z's.'t", "w.\u0301 a*\u0338 e\u0301, \u0301, q<\u0338", "<|endoftext|>. a<|endoftext|>,b", ", ".join(f"w{i}" for i in range(3000)), "\u00a0a.\u2003b;\r\nc"]
    ids, n = own.encode(packing.pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [own.lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_ids_of_many_batches_are_the_tokenizers():
    """Words that are known from earlier batches, new ones, ones beyond what is kept, ones with a mark, and large strings."""
    random.seed(23)
    own = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"), kept=50)
    vocabulary = ["".join(random.choices("abcdeé.,'9\x01", k=random.randint(0, 6))) for _ in range(300)]
    for kind in (packing.pa.string(), packing.pa.large_string()) * 3:
        texts = [" ".join(random.choices(vocabulary, k=random.choice([0, 1, 40]))) for _ in range(20)]
        ids, n = own.encode(packing.pa.array(texts, kind))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [own.lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(own.words) == len(own.lengths) == 50 and own.lengths.sum() == len(own.flat)
    ids, n = own.encode(packing.pa.array([], packing.pa.string()))
    assert not len(ids) and not len(n)


def test_spread_in_blocks():
    rng = np.random.default_rng(24)
    flat, start, lengths = rng.integers(0, 99, 400), rng.integers(0, 390, 60), rng.integers(0, 10, 60)
    counts = np.array([0, 7, 0, 500, 1, 0])
    codes = rng.integers(0, 60, counts.sum())
    parts = np.split(codes, np.cumsum(counts)[:-1])
    for block in (1, 7, 1000):
        out, n = common.spread(flat, start, lengths, codes, counts, block)
        assert out.tolist() == [x for c in codes for x in flat[start[c] : start[c] + lengths[c]].tolist()]
        assert n.tolist() == [int(lengths[p].sum()) for p in parts]


def test_packing_holds_little_of_its_texts(spark, monkeypatch):  # noqa: ANN001
    """What a task of packing holds besides Arrow's and the tokenizer's own: less than 30 MB, of 12 MB of texts in batches of 1 MB."""
    random.seed(25)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(3, 9))) for _ in range(150_000)]
    texts = [" ".join(random.choices(vocabulary, k=1500)) for _ in range(1200)]
    batches = [packing.pa.RecordBatch.from_pydict({"doc_id": [*range(i, i + 100)], "text": texts[i : i + 100], "copy": [*range(i, i + 100)]}) for i in range(0, 1200, 100)]

    class Direct:
        def withColumn(self, *_):  # noqa: ANN002, ANN202, N802
            return self

        def mapInArrow(self, run, _):  # noqa: ANN001, ANN202, N802
            return run

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "texts", lambda _: Direct())
    monkeypatch.setattr(packing, "_WORDS", {tokenizer: packing.WordTokens(tokenizer)})
    run = packing.pieces(None, tokenizer)
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter(batches))) >= 1200
        assert tracemalloc.get_traced_memory()[1] < 30e6
    finally:
        tracemalloc.stop()


def test_lm_sums_by_products(monkeypatch):  # noqa: ANN001
    """Tokens with one context share a sum, worked out as a sum of products; weights too large for that are scored one by one."""
    rng = np.random.default_rng(3)
    context = rng.integers(0, 9, (700, 4))[rng.integers(0, 700, 3000)]
    token = rng.integers(0, 8, 3000)
    asked, plain = [], lm_scoring.log_sums
    monkeypatch.setattr(lm_scoring, "log_sums", lambda c, *rest: asked.append(len(c)) or plain(c, *rest))
    for size in (1.0, 40.0):
        model = lm_scoring.Model(rng.normal(size=(4, 9, 16)).astype(np.float32), (size * rng.normal(size=(8, 16))).astype(np.float32), rng.normal(size=8).astype(np.float32))
        tables = lm_scoring.exponentials(model)
        assert (tables is None) == (size > 1)
        x = sum(model.places[k].astype(float)[context[:, k]] for k in range(4)) @ model.vectors.T.astype(float) + model.bias
        expected = (x[np.arange(3000), token] - np.logaddexp.reduce(x, axis=1)) / math.log(10)
        assert np.allclose(lm_scoring.log_probabilities(token, context, model, tables), expected, rtol=1e-4, atol=1e-4)
    assert asked == [len(np.unique(context, axis=0))] * 2
    assert not len(lm_scoring.log_probabilities(token[:0], context[:0], model))


def test_every_document_is_counted(spark):  # noqa: ANN001
    """A shingle of every document stands out however few there are, and the boundary's costs are those of all sets and lists."""
    config = jaccard_join.Config(width=1, num=80)
    rows = [(i, " ".join(["often", *(f"w{i}x{k}" for k in range(9))])) for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    often = jaccard_join.shingle_sets(["often"], 1)[0]
    own = {int(x) >> 64 - config.buckets_log2 for x in often}
    frequent, counts = jaccard_join.frequent_shingles(table, config)
    assert len(own & set(frequent.tolist())) == 1 and counts.max() >= 12
    costs = jaccard_join.list_costs(table, config, spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64))))
    assert costs[10][0] == 12
    with pytest.raises(ValueError, match="every document"):
        jaccard_join.Config(sample=8)
