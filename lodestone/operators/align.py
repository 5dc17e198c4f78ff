"""Aligning the lines of chunks with the lines of a text in two languages."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Mapping
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources import shared

ALIGNED = "chunk_idx int, seq int, original_content string, content string, matched boolean"
_ALIGNED_ARROW = pa.schema([("chunk_idx", pa.int32()), ("seq", pa.int32()), ("original_content", pa.string()), ("content", pa.string()), ("matched", pa.bool_())])

#: Bytes of an Arrow batch that are Python objects at a time, and rows and code points that are sent on at a time.
READ_BYTES, SENT_ROWS, SENT_CHARS = 1 << 20, 4096, 1 << 20


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of the batches, of which few are Python objects at a time."""
    for b in batches:
        n = max(1, b.num_rows * READ_BYTES // max(1, b.nbytes))
        for at in range(0, b.num_rows, n):
            part = b.slice(at, n)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of few rows and not much text."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= SENT_ROWS or size >= SENT_CHARS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


_SCANNED = "line string, line_no long, part int, kind string, least array<long>"
_SCANNED_ARROW = pa.schema([("line", pa.string()), ("line_no", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("least", pa.list_(pa.int64()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one range in order, lines before references that equal them. What begins with a line follows it directly, so that lines wait on a stack, each inside the one below it, until a text doesn't begin with them.

    Rows of kind done, of kind open for lines whose references may go on in the next range, and one of kind first: the
    first reference of the range, with the lowest number of those that share its first 0, 1, 2, ... code points.
    """
    return _batches(_scanned(_rows(batches, "s", "line_no", "part")), _SCANNED_ARROW)


def _scanned(rows: Iterable[tuple]) -> Iterator[tuple]:
    stack: list[list] = []
    first, common, part = None, 0, None
    lowest: dict[int, int] = {}

    def popped(kind: str) -> tuple:
        line, n = stack.pop()
        if stack and n is not None:
            stack[-1][1] = n if stack[-1][1] is None else min(stack[-1][1], n)
        return line, n, part, kind, None

    for s, n, part in rows:  # noqa: B007
        while stack and not s.startswith(stack[-1][0]):
            yield popped("done")
        if n is None:
            stack.append([s, None])
            continue
        if first is None:
            first, common = s, len(s)
        while not s.startswith(first[:common]):
            common -= 1
        lowest[common] = min(lowest.get(common, n), n)
        if stack:
            stack[-1][1] = n if stack[-1][1] is None else min(stack[-1][1], n)
    while stack:
        yield popped("open")
    if first is not None:
        least, held = [], None
        for k in range(len(first), -1, -1):
            held = min(lowest.get(k, held), held) if held is not None else lowest.get(k)
            least.append(held)
        yield first, None, part, "first", least[::-1]


def first_prefix_match(lines: DataFrame, reference: DataFrame) -> DataFrame:
    """lines (line, ...) with line_no, the lowest number of a reference line (line_no, ref) that begins with it, or null.

    Distinct lines and references are sorted together by ranges: those that begin with a line are an interval after it,
    read once, however many begin alike. An interval that reaches into later ranges meets their first references, a row
    a range. The empty line begins all; a null line or reference has no part in it.
    """
    refs = reference.where("ref IS NOT NULL AND line_no IS NOT NULL").groupBy(F.col("ref").alias("s")).agg(F.min(F.col("line_no").cast("long")).alias("line_no"))
    own = lines.where("line IS NOT NULL").select(F.col("line").alias("s")).distinct().withColumn("line_no", F.lit(None).cast("long"))
    sorted_ = refs.unionByName(own).repartitionByRange("s").sortWithinPartitions("s", F.asc_nulls_first("line_no")).withColumn("part", F.spark_partition_id())
    found = shared.written(sorted_.mapInArrow(_scan, _SCANNED))
    waiting = found.where("kind = 'open'").select("line", F.col("part").alias("of_part"))
    # Lengths alone, at most as many as the longest line has code points.
    lengths = waiting.agg(F.collect_set(F.length("line")).alias("lengths"))
    firsts = found.where("kind = 'first'").join(F.broadcast(lengths)).select("part", F.col("line").alias("first"), "least", F.explode(F.filter("lengths", lambda n: n <= F.length("line"))).alias("n"))
    beginnings = firsts.select("part", F.expr("left(first, n)").alias("beginning"), F.expr("least[n]").alias("later"))
    more = waiting.join(beginnings, (F.col("line") == F.col("beginning")) & (F.col("part") > F.col("of_part"))).groupBy(F.col("line").alias("of_line")).agg(F.min("later").alias("later"))
    lowest = found.where("kind <> 'first'").select("line", "line_no").join(more, F.col("line") == F.col("of_line"), "left")
    lowest = lowest.select(F.col("line").alias("of_line"), F.least("line_no", "later").alias("line_no")).where("line_no IS NOT NULL")
    return lines.join(lowest, F.col("line") == F.col("of_line"), "left").drop("of_line")


def zip_lines(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines (doc, line_no, text) of two texts with the same number, as far as both go."""
    return left.join(right.withColumnRenamed("text", "other"), ["doc", "line_no"])


def walk(items: Iterable[Mapping], compat: bool = True) -> Iterator[tuple[str, str, bool]]:
    """(original_content, content, matched) of one chunk's lines in order, each with its candidate (line, de, en): the fold of align(). Of the lines, those that a reference line takes on are held at a time, and the one after."""
    rest, ahead = iter(items), deque()

    def has(k: int) -> bool:
        while len(ahead) <= k and (x := next(rest, None)) is not None:
            ahead.append(x if x["line"] else BLANK)
        return len(ahead) > k

    while has(0):
        line, de, en = ahead[0]["line"], ahead[0]["de"], ahead[0]["en"]
        taken, upto, k = 1, 1, 0
        if line and de is not None:
            whole = line
            while has(k := k + 1):
                if not ahead[k]["line"]:
                    continue
                longer = f"{whole} {ahead[k]['line']}"
                if not de.startswith(longer):
                    break
                whole, taken, upto = longer, taken + 1, k + 1
            yield de, en, True
        elif line:
            yield line, "", False
        for _ in range(taken if compat else upto):
            ahead.popleft()


BLANK = {"line": "", "de": None, "en": None}


def align(chunks: DataFrame, reference: DataFrame, compat: bool = True) -> DataFrame:
    """ALIGNED rows: each chunk's lines (chunk_idx, lines array of normalised lines) against the reference (line_no, de, en) in ascending order.

    A line takes the first reference line that begins with it, and following lines while the text joined stays a
    beginning; the entry holds the whole reference line in both languages. Lines come with their candidates by a join on their beginnings and stream
    through the fold in order, so that a chunk of any length, and any number of them, needs the room of a few lines. compat: a blank line between lines taken doesn't count among them, so that the last of them comes again.
    """
    lines = shared.written(chunks.select("chunk_idx", F.posexplode("lines").alias("at", "line")))
    usable = reference.where(F.col("en").isNotNull()).select("line_no", F.struct("de", "en").alias("both"), F.col("de").alias("ref"))
    found = first_prefix_match(lines.where("line <> ''"), usable)
    found = found.join(usable.select(F.col("line_no").alias("n"), "both"), F.col("line_no") == F.col("n"), "left")
    with_blank = found.select("chunk_idx", "at", "line", "both").unionByName(lines.where("line = ''").select("chunk_idx", "at", "line", F.lit(None).cast("struct<de:string,en:string>").alias("both")))

    def entries(rows: Iterator[tuple]) -> Iterator[tuple]:
        for idx, own in groupby(rows, itemgetter(0)):
            for seq, x in enumerate(walk(({"line": line, "de": de, "en": en} for _, line, de, en in own), compat)):
                yield idx, seq, *x

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(entries(_rows(batches, "chunk_idx", "line", "de", "en")), _ALIGNED_ARROW)

    ordered = with_blank.select(F.col("chunk_idx").cast("int").alias("chunk_idx"), "at", "line", "both.de", "both.en").repartition("chunk_idx").sortWithinPartitions("chunk_idx", "at", "line", "de", "en")
    return ordered.mapInArrow(fold, ALIGNED)


ATTRIBUTES = {"id": "string", "title": "string", "relevantChunksIds": "array<string>", "keywords": "array<string>"}
NONE_YET = ("availableKeywords", "negativeKeywords", "parameters")


def consolidate(aligned: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(chunk_idx, content, original_content): the lines of each chunk in order; a chunk without any isn't there.

    With chunks (chunk_idx and any of ATTRIBUTES), their attributes as well, and empty lists of those that are none yet.
    """
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]), "\n").alias(c)
    whole = aligned.groupBy("chunk_idx").agg(joined("content"), joined("original_content"))
    if chunks is None:
        return whole
    none = F.array().cast("array<string>")
    default = {"title": F.lit("N/A"), "relevantChunksIds": none, "keywords": none}
    own = {k: F.coalesce(F.col(k), default[k]) if k in default else F.col(k) for k in ATTRIBUTES if k in chunks.columns}
    named = {k: own.get(k, default.get(k, F.lit(None).cast(t))) for k, t in ATTRIBUTES.items()}
    attributes = chunks.select(F.col("chunk_idx").alias("of_idx"), *[v.alias(k) for k, v in named.items()])
    return whole.join(attributes, F.col("chunk_idx") == F.col("of_idx")).select("chunk_idx", *ATTRIBUTES, *[none.alias(k) for k in NONE_YET], "content", "original_content")


def counts(chunks: DataFrame, aligned: DataFrame) -> DataFrame:
    """One row: how many chunks there are and were consolidated, how many entries, and how many of these are unmatched."""
    of = aligned.agg(F.countDistinct("chunk_idx").alias("n_consolidated"), F.count("*").alias("n_entries"), F.count_if(~F.col("matched")).alias("n_unmatched"))
    return chunks.agg(F.count("*").alias("n_chunks")).join(of)


def unmatched(aligned: DataFrame) -> DataFrame:
    return aligned.where(~F.col("matched")).select("chunk_idx", "seq", F.col("original_content").alias("original_line"))


def normalised_lines(content: str = "content") -> Column:
    return F.transform(F.split(content, "\n"), text.normalize_spaces)
