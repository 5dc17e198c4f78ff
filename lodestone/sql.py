"""Functions for Spark SQL. Their bodies are SQL, so that the optimiser sees through them; the walk over a chunk's lines is a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from .functions import text
from .operators import align

DOT = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0.0D, (s, x) -> s + x)"
#: Name, parameters, type and body of each.
FUNCTIONS = {
    "py_strip": ("s STRING", "STRING", "btrim(s, {py})"),
    "js_trim": ("s STRING", "STRING", "btrim(s, {js})"),
    "is_blank": ("s STRING", "BOOLEAN", "btrim(s, {py}) = ''"),
    "preview": ("s STRING", "STRING", "CASE WHEN length(s) > 150 THEN concat(left(s, 150), '...') ELSE s END"),
    "vector_norm": ("a ARRAY<DOUBLE>", "DOUBLE", f"sqrt({DOT.format('a', 'a')})"),
    "cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"CASE WHEN sqrt({DOT.format('a', 'a')}) * sqrt({DOT.format('b', 'b')}) = 0 THEN double('NaN') ELSE {DOT.format('a', 'b')} / (sqrt({DOT.format('a', 'a')}) * sqrt({DOT.format('b', 'b')})) END"),
    "kwh": ("watts DOUBLE, seconds DOUBLE", "DOUBLE", "watts * seconds / 3600D / 1000D"),
    "queue_seconds": ("position BIGINT", "BIGINT", "greatest(greatest(position, 1) - 1, 1) * 40"),
    "approx_tokens": ("s STRING", "INT", "cast(ceil(length(s) / 4) AS INT)"),
}


def _literal(chars: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04X}" for c in chars) + "'"


class AlignLines:
    """(seq, original_content, content, matched) of an array of lines with their candidates (line, de, en)."""

    def eval(self, lines: list[Row]) -> Iterator[tuple]:
        for seq, x in enumerate(align.walk([r.asDict() for r in lines or []])):
            yield (seq, *x)


def register(spark: SparkSession, prefix: str = "lodestone_") -> list[str]:
    """Makes the functions known to the session, and tells their names."""
    chars = {"py": _literal(text.PY_CHARS), "js": _literal(text.JS_CHARS)}
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body.format(**chars)}")
    spark.udtf.register(f"{prefix}align_lines", udtf(AlignLines, returnType="seq int, original_content string, content string, matched boolean"))
    return [prefix + name for name in (*FUNCTIONS, "align_lines")]
