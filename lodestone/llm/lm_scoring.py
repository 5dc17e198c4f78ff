"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

The model predicts, from the last few tokens, the next one among the most frequent words, the end, and classes of all
other words (by their last two bytes): a predicted vector is the sum of one vector for each context place, its products
with all outputs' vectors are one matrix product a block, and a softmax over these gives normalised probabilities. A
word of a class then has its share of the class's count (add-half smoothed, with room for one unknown word).

What is learnt covers all training documents: word counts come from a shuffle, and those of rare words reach the
documents by a join. The vectors are trained in two rounds, the first on one document in eight, the second on all the
others: documents are dealt into groups by a hash, each group is one pass from the round's shared vectors, and what the
groups come to is averaged by their tokens. Only a bounded head of the counts and one set of vectors a round pass
through the driver. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, slices, texts, tidy, word_hashes


@dataclass(frozen=True)
class Config:
    """words: outputs that are words; classes: of all others. head: words whose counts each worker holds. group_docs: about how many documents one pass of training goes through before vectors are averaged; block_chars: texts are shuffled by tokens within blocks of this length."""

    words: int = 384
    classes: int = 127
    head: int = 131_072
    context: int = 4
    size: int = 16
    noise: int = 128
    batch: int = 1024
    rate: float = 0.15
    group_docs: int = 1024
    block_chars: int = 1_000_000


@dataclass(frozen=True)
class Counts:
    """What is known of the training tokens on the driver: the head's words (sorted hashes) with counts and outputs, and totals."""

    head: np.ndarray
    count: np.ndarray
    output: np.ndarray  # of each head word: its own, or its class
    own: np.ndarray  # whether it is an output of its own
    docs: int
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray


@dataclass(frozen=True)
class Model:
    """Outputs: words, then the end, then classes; the context has one more entry, for before the text."""

    places: np.ndarray  # context x (outputs + 1) x size
    vectors: np.ndarray  # outputs x size
    bias: np.ndarray


def class_of(ending: np.ndarray, config: Config) -> np.ndarray:
    return (mix(ending) % np.uint64(config.classes)).astype(np.int64)


def word_counts(docs: DataFrame, config: Config) -> DataFrame:
    """(word, class, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                words, ending, _ = word_hashes(b.column("text").to_pylist())
                word, first, n = np.unique(words, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(class_of(ending[first], config)), pa.array(n, pa.int64())], names=["word", "class", "n"])

    return docs.mapInArrow(tidy(run), "word long, class long, n long").groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


def summarise(counts: DataFrame, docs: int, config: Config) -> Counts:
    top = counts.orderBy(F.desc("n"), "word").limit(config.head).toArrow()
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    by_class = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    tokens, words = np.zeros(config.classes), np.zeros(config.classes)
    for r in by_class:
        tokens[r["class"]], words[r["class"]] = r["n"], r["v"]
    word, kind, n = top["word"].to_numpy().view(np.uint64), top["class"].to_numpy(), top["n"].to_numpy()
    own = np.arange(len(word)) < config.words
    np.subtract.at(tokens, kind[own], n[own])
    np.subtract.at(words, kind[own], 1)
    output = np.where(own, np.arange(len(word)), config.words + 1 + kind)
    order = np.argsort(word)
    return Counts(word[order], n[order], output[order], own[order], docs, (total["n"] or 0) + docs, total["v"] + (docs > 0), tokens, words)


def outputs_of(words: np.ndarray, ending: np.ndarray, known: Counts, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """The output of each token, and its place in the head or -1."""
    if not len(known.head):
        return config.words + 1 + class_of(ending, config), np.full(len(words), -1)
    at = np.minimum(np.searchsorted(known.head, words), len(known.head) - 1)
    hit = known.head[at] == words
    return np.where(hit, known.output[at], config.words + 1 + class_of(ending, config)), np.where(hit, at, -1)


def sequences(docs: list[str], known: Counts, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' tokens with the end of each: outputs, contexts (a row a token), and of each text the number of tokens; and the words' hashes and head places, -2 for an end."""
    words, ending, counts = word_hashes(docs)
    distinct, first, inverse = np.unique(words, return_index=True, return_inverse=True)
    output, place = outputs_of(distinct, ending[first], known, config)
    ends = np.cumsum(counts)  # an end after each text's words
    n = len(words) + len(docs)
    is_end = np.zeros(n, bool)
    is_end[ends + np.arange(len(docs))] = True
    token, at, word = np.full(n, config.words, np.int32), np.full(n, -2, np.int32), np.zeros(n, np.uint64)
    token[~is_end], at[~is_end], word[~is_end] = output[inverse], place[inverse], words
    sizes = counts + 1
    inside = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    none = config.words + 1 + config.classes
    context = np.full((n, config.context), none, np.int32)
    for k in range(config.context):
        ok = inside > k
        context[ok, k] = token[np.flatnonzero(ok) - k - 1]
    return token, context, sizes, word, at


def noise_of(known: Counts, config: Config) -> np.ndarray:
    """Noise comes by the outputs' frequencies."""
    freq = np.full(config.words + 1 + config.classes, 0.5)
    np.add.at(freq, known.output[known.own], known.count[known.own])
    freq[config.words] += known.docs
    freq[config.words + 1 :] += known.class_tokens
    return freq / freq.sum()


def shapes(config: Config) -> list[tuple[int, ...]]:
    n_out = config.words + 1 + config.classes
    return [(config.context, n_out + 1, config.size), (n_out, config.size), (n_out,)]


def start(known: Counts, config: Config) -> np.ndarray:
    """What all groups of the first round start from, in one row: places, vectors and bias, then for each weight its sum of squared gradients."""
    random = np.random.default_rng(7)
    places, vectors = (random.normal(0, 0.1, shape) for shape in shapes(config)[:2])
    weights = np.concatenate([places.ravel(), vectors.ravel(), np.log(noise_of(known, config))])
    return np.concatenate([weights, np.full_like(weights, 1e-2)]).astype(np.float32)


def parts_of(state: np.ndarray, config: Config) -> list[np.ndarray]:
    """Views of places, vectors and bias, and of their sums."""
    ends = np.cumsum([int(np.prod(shape)) for shape in shapes(config)] * 2)
    return [x.reshape(shape) for x, shape in zip(np.split(state, ends[:-1]), shapes(config) * 2, strict=True)]


def _sums(rows: int, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sum of the rows of x at each place."""
    flat = (at.astype(np.int64)[:, None] * x.shape[1] + np.arange(x.shape[1])).ravel()
    return np.bincount(flat, x.ravel(), rows * x.shape[1]).reshape(rows, x.shape[1]).astype(np.float32)


def steps(state: np.ndarray, docs: list[str], known: Counts, config: Config, random: np.random.Generator) -> int:
    """One pass of noise-contrastive estimation over the texts, with noise shared in a batch; it changes state, and gives the number of tokens."""
    noise_p = noise_of(known, config)
    places, vectors, bias, *sums = parts_of(state, config)
    n_out = len(bias)
    token, context, *_ = sequences(docs, known, config)
    shift = np.log(config.noise * noise_p).astype(np.float32)
    order = random.permutation(len(token))
    cut = np.cumsum(noise_p)
    cut /= cut[-1]
    for i in range(0, len(order), config.batch):
        some = order[i : i + config.batch]
        w, c = token[some], context[some]
        noise = np.searchsorted(cut, random.random(config.noise), "right")  # as random.choice() draws them
        q = places[0][c[:, 0]]
        for k in range(1, config.context):
            q += places[k][c[:, k]]
        of_w, of_noise = vectors[w], vectors[noise]
        good = (q * of_w).sum(1) + bias[w] - shift[w]
        h = q @ of_noise.T
        h += bias[noise] - shift[noise]
        np.negative(h, out=h)
        np.exp(h, out=h)
        h += 1
        np.reciprocal(h, out=h)
        g = 1 / (1 + np.exp(-good)) - 1
        to_q = g[:, None] * of_w + h @ of_noise
        to_v = _sums(n_out, w, g[:, None] * q) + _sums(n_out, noise, h.T @ q)
        to_b = (np.bincount(w, g, n_out) + np.bincount(noise, np.ones(len(h), np.float32) @ h, n_out)).astype(np.float32)
        to_p = np.stack([_sums(n_out + 1, c[:, k], to_q) for k in range(config.context)])
        for x, grad, total in zip((places, vectors, bias), (to_p, to_v, to_b), sums, strict=True):
            grad /= len(some)
            total += grad * grad
            x -= config.rate * grad / np.sqrt(total)
    return len(token)


def train(docs: list[str], known: Counts, config: Config) -> Model:
    """One group's pass from the start."""
    state = start(known, config)
    if docs:
        steps(state, docs, known, config, np.random.default_rng(7))
    return Model(*parts_of(state, config)[:3])


#: Weights times tokens are added as whole numbers of this fraction, so that their sum doesn't depend on the order.
FRACTION = float(1 << 16)


def train_round(training: DataFrame, n_groups: int, state: np.ndarray, known: Counts, config: Config) -> tuple[np.ndarray, int]:
    """The average, by tokens, of what one pass over each group of training (text, key) makes of state; and the number of tokens.

    A group is what has one remainder of key, in the order of key, wherever its rows stand. Each task adds up its groups and sends one row of fixed size.
    """
    shared = training.sparkSession.sparkContext.broadcast((known, state))  # bounded by config
    pieces = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, begin = shared.value
        total, tokens = np.zeros(len(begin), np.int64), 0
        own, group, random, seen, block, held = begin.copy(), None, None, 0, [], 0

        def flush() -> None:
            nonlocal seen, block, held
            if block:
                seen += steps(own, block, known, config, random)
            block, held = [], 0

        def close() -> None:
            nonlocal tokens
            flush()
            np.add(total, np.rint(own.astype(np.float64) * (seen * FRACTION)).astype(np.int64), out=total)
            tokens += seen

        for b in batches:
            for g, text in zip(b.column("group").to_pylist(), b.column("text"), strict=True):
                if g != group:
                    if group is not None:
                        close()
                    own, group, random, seen = begin.copy(), g, np.random.default_rng([7, g]), 0
                block.append(text.as_py())
                held += len(block[-1])
                if held >= config.block_chars:
                    flush()
        if group is not None:
            close()
            cut = np.array_split(total, pieces)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(range(pieces), pa.int32()), "tokens": pa.array([tokens] * pieces, pa.int64()), "total": pa.array([x.tobytes() for x in cut], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for p, n, x in zip(b.column("piece").to_pylist(), b.column("tokens").to_pylist(), b.column("total"), strict=True):
                own = sums.setdefault(p, [0, 0])
                own[0] += n
                own[1] = own[1] + np.frombuffer(x.as_buffer(), np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"piece": pa.array(list(sums), pa.int32()), "tokens": pa.array([n for n, _ in sums.values()], pa.int64()), "total": pa.array([x.tobytes() for _, x in sums.values()], pa.binary())})

    schema = "piece int, tokens long, total binary"
    dealt = training.withColumn("group", F.pmod(F.shiftright("key", 3), F.lit(n_groups))).repartition("group").sortWithinPartitions("group", "key", "text")
    rows = dealt.select("group", "text").mapInArrow(tidy(run), schema).repartition("piece").mapInArrow(tidy(add), schema).collect()
    if not rows:
        return state, 0
    total = np.concatenate([np.frombuffer(r["total"], np.int64) for r in sorted(rows, key=lambda r: r["piece"])])
    return (total / (rows[0]["tokens"] * FRACTION)).astype(np.float32), rows[0]["tokens"]


def train_all(training: DataFrame, n_docs: int, known: Counts, config: Config) -> tuple[Model, int]:
    """Vectors, and the number of tokens they were trained on, from every row of training (doc_id, text): one in eight of them in the first round, all others in the second, which starts from the first one's average."""
    rows = training.select("text", F.xxhash64("doc_id", "text").alias("key"))
    state, tokens = start(known, config), 0
    for early in (True, False):
        share = n_docs / 8 if early else 7 * n_docs / 8
        part = rows.where((F.pmod("key", F.lit(8)) == 0) == F.lit(early))
        state, n = train_round(part, max(1, int(-(-share // config.group_docs))), state, known, config)
        tokens += n
    return Model(*parts_of(state, config)[:3]), tokens


#: Exponents whose sum is below this have products that a float32 holds.
SAFE = 80.0


def exponentials(model: Model) -> np.ndarray | None:
    """exp() of each place's part of each output's score (context x (outputs + 1) x outputs), the bias with the first: a product of one row a place is exp() of the scores. None where numbers are so large that products may not be held."""
    parts = model.places @ model.vectors.T
    parts[0] += model.bias
    if not np.abs(parts).max((1, 2)).sum() < SAFE:
        return None
    return np.exp(parts, out=parts)


def log_sums(context: np.ndarray, model: Model, tables: np.ndarray | None, block: int = 256) -> np.ndarray:
    """The logarithm of the sum of exp(score) over all outputs, for each context."""
    out = np.empty(len(context), np.float32)
    n_places = context.shape[1]
    if tables is not None:
        some, more = (np.empty((block, len(model.bias)), np.float32) for _ in range(2))
        for i in range(0, len(context), block):
            c = context[i : i + block]
            x, y = some[: len(c)], more[: len(c)]
            tables[0].take(c[:, 0], 0, out=x, mode="clip")
            for k in range(1, n_places):
                tables[k].take(c[:, k], 0, out=y, mode="clip")
                if k < n_places - 1:
                    x *= y
            out[i : i + block] = np.einsum("ij,ij->i", x, y) if n_places > 1 else x.sum(1)
        return np.log(out, out=out)
    turned = np.ascontiguousarray(model.vectors.T)
    for i in range(0, len(context), block):
        score = predicted(context[i : i + block], model) @ turned
        score += model.bias
        top = score.max(1)
        score -= top[:, None]
        np.exp(score, out=score)
        out[i : i + block] = np.log(score.sum(1)) + top
    return out


def predicted(context: np.ndarray, model: Model) -> np.ndarray:
    q = model.places[0][context[:, 0]]
    for k in range(1, context.shape[1]):
        q += model.places[k][context[:, k]]
    return q


def log_probabilities(token: np.ndarray, context: np.ndarray, model: Model, tables: np.ndarray | None = None, block: int = 8192) -> np.ndarray:
    """log10 of each token's output's probability, normalised over all outputs; tokens with one context share its sum. tables: those of exponentials(), or none."""
    out = np.empty(len(token), np.float32)
    if not len(token):
        return out
    rows = model.places.shape[1]
    if rows ** context.shape[1] < 1 << 63:
        key = np.zeros(len(token), np.int64)
        for k in range(context.shape[1]):
            key = key * rows + context[:, k]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        sums = log_sums(context[first], model, tables)[inverse]
    else:
        sums = log_sums(context, model, tables)
    for i in range(0, len(token), block):
        w = token[i : i + block]
        out[i : i + block] = np.einsum("ij,ij->i", predicted(context[i : i + block], model), model.vectors[w]) + model.bias[w]
    out -= sums
    return out / np.float32(np.log(10))


PARTS = "doc_id long, copy long, word long, times long, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, learn: Column, config: Config = Config()) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row's whole text, learning from the rows where `learn` holds.

    A null or empty text is its end alone. Rows that repeat are scored each, and count each where they are learnt from.
    Without training rows every count is zero.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    training = rows.where("learn")
    n_docs = training.select("doc_id").count()
    counts = materialise(word_counts(training.select("text"), config))
    known = summarise(counts, n_docs, config)
    model, _ = train_all(training, n_docs, known, config)
    shared = docs.sparkSession.sparkContext.broadcast((known, model))  # bounded by config

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        tables = exponentials(model)
        total = np.log10(known.tokens + 0.5 * (known.distinct + 1))
        per_class = np.log10(known.class_tokens + 0.5 * (known.class_words + 1))
        head_log = np.log10(np.append(known.count, [known.docs, 0]) + 0.5)  # the end at -2, none at -1
        for whole in batches:
            for b in slices(whole, most=2 << 20):
                ids, copies = b.column("doc_id"), b.column("copy")
                token, context, sizes, word, at = sequences(b.column("text").to_pylist(), known, config)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                in_class = token > config.words
                rare = at == -1
                gain = log_probabilities(token, context, model, tables).astype(np.float64)
                gain[in_class] -= per_class[token[in_class] - config.words - 1]
                gain[in_class & ~rare] += head_log[at[in_class & ~rare]]
                counted = ~rare & ((at >= 0) | (known.docs > 0))
                add = lambda x: np.bincount(owner, x, len(sizes))  # noqa: E731, B023
                key, times = np.unique(np.rec.fromarrays([owner[rare], word[rare]]), return_counts=True) if rare.any() else (np.rec.fromarrays([owner[:0], word[:0]]), np.zeros(0, np.int64))
                n, m = len(sizes), len(key)
                of = pa.array(np.concatenate([np.arange(n), key.f0]))
                none = np.zeros(m)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(of), copies.take(of), pa.array(np.concatenate([np.zeros(n, np.int64), key.f1.view(np.int64)]), mask=np.arange(n + m) < n), pa.array(np.concatenate([np.zeros(n, np.int64), times])), pa.array(np.concatenate([sizes, none.astype(np.int64)])), pa.array(np.concatenate([add(counted).astype(np.int64), none.astype(np.int64)])), pa.array(np.concatenate([add(np.where(rare, 0.0, head_log[at])) - sizes * total, none])), pa.array(np.concatenate([add(gain), none]))],
                    names=["doc_id", "copy", "word", "times", "n_tokens", "n_known", "base", "score"],
                )

    parts = materialise(rows.select("doc_id", "text", F.monotonically_increasing_id().alias("copy")).mapInArrow(tidy(run), PARTS))
    of_word = counts.select(F.col("word").alias("of"), F.col("n"))
    rare = parts.where(F.col("word").isNotNull()).join(of_word, F.col("word") == F.col("of"), "left")
    seen = rare.select("copy", F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("n_known"), (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("more"))
    by_doc = seen.groupBy("copy").agg(F.sum("n_known").alias("more_known"), F.sum("more").alias("more"))
    own = parts.where(F.col("word").isNull())
    zero = F.lit(0)
    return own.join(by_doc, "copy", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
