"""The pipeline's stages against brute force, and the contract of the registered queries."""

from __future__ import annotations

import random

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import jaccard_join
from lodestone.llm.queries import QUERIES

from .test_operators import check_packed, components_by_force, removed_by_force
from .test_variants_trie_exact import counts_by_force, rebuilt_by_force, trie_by_force

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):  # noqa: ANN001
    random.seed(20)
    parts = {"en": ["th", "er", "on", "an", "ing"], "de": ["sch", "ein", "ung", "ch", "ß"]}
    word = lambda lang: "".join(random.choices(parts[lang], k=random.randint(1, 3)))
    passage = " ".join(word("en") for _ in range(60))
    rows = []
    for i in range(150):
        lang = random.choice(["en", "de"])
        text = " ".join(word(lang) for _ in range(random.randint(20, 120))) + (" " + passage if i % 7 == 0 else "")
        rows.append((i, text, lang, "s", len(text)))
    rows += [(200, None, "en", "s", None), (201, "12345 !!!", "en", "s", 9), (202, rows[3][1], "en", "s", 0), (203, rows[5][1] + " th", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)))
        seen.append((name, docs.collect()))
    identified, single, rest, packed = (x for _, x in seen)
    assert {r["doc_id"] for r in identified} == {r[0] for r in rows} - {200, 201}
    expected = {i for i, _, c in components_by_force([(r["doc_id"], r["text"]) for r in identified], jaccard_join.Config(width=5, num=80)) if i == c}
    assert {r["doc_id"] for r in single} == expected and not {202, 203} & expected
    gone = removed_by_force([(r["doc_id"], r["text"]) for r in single], 100)
    assert {r["doc_id"]: r["text"] for r in rest} == {i: x[3].decode(errors="ignore") for i, x in gone.items() if x[3].strip()}
    assert sum(passage in r["text"] for r in rest) == 1
    for stage in (identified, single, rest):
        assert list(stage[0].asDict()) == COLUMNS
    check_packed([(r["doc_id"], r["text"]) for r in rest], packed, 2048, public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == sorted(str(type(r)(**{k: v for k, v in r.asDict().items() if k not in {"sequence_id", "offset"}})) for r in packed)


def test_null_and_repeated_ids(spark, tmp_path):  # noqa: ANN001
    """A row goes only as a near copy or when nothing is left of it, whatever its id."""
    random.seed(22)
    parts = {"en": ["th", "er", "on", "an", "ing"], "de": ["sch", "ein", "ung", "ch", "ß"]}
    text = lambda lang: " ".join("".join(random.choices(parts[lang], k=random.randint(2, 4))) for _ in range(60))
    rows = [(i, text(lang), lang, "s", 0) for i in [*range(40), *[None] * 10, *[7] * 10] for lang in [random.choice(["en", "de"])]]
    clean = sorted(r[1] for r in rows)
    rows += [(None, rows[3][1], rows[3][2], "copy", 0), (7, rows[-1][1], rows[-1][2], "copy", 0), (7, "th " + rows[45][1], rows[45][2], "near", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)))
        seen.append(docs.collect())
    assert len(seen[0]) == len(rows)
    # Of the text without an id and its near copy with id 7, the one with an id stays; of the others, the clean ones.
    expected = sorted([t for t in clean if t != rows[45][1]] + ["th " + rows[45][1]])
    assert sorted(r["text"] for r in seen[1]) == expected
    assert sorted(r["text"] for r in seen[2]) == expected and list(seen[2][0].asDict()) == COLUMNS
    assert len(seen[3]) == len(expected)


def test_registered_queries(spark, tmp_path):  # noqa: ANN001
    random.seed(21)
    words = ["the", "mit", "license", "of", "und", "schön"]
    docs = [(i, " ".join(random.choices(words, k=30)), random.choice(["en", "de"]), "s", 0) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    vectors = [(i, [random.uniform(-1, 1) for _ in range(8)], 0) for i in range(210)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    talks = [(i // 4, i % 4, "user", random.choice(words)) for i in range(80)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    expected = {"op1": 30, "op11": len(counts_by_force([d[:2] for d in docs])), "op12": len(trie_by_force(rebuilt_by_force(talks)))}
    for name, query in QUERIES.items():
        n = query(spark, str(tmp_path)).select(F.count("*")).first()[0]
        assert n == expected.get(name.split("_")[0], 40), name
