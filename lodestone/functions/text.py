"""Text functions with the white-space rules of the languages the corpora were written by."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip() and as String.trim() know it.
PY_SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
JS_SPACE = r"\t-\r\x20\xa0  -     　﻿"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


#: The same one by one: Python's white space, and JavaScript's, which lacks four separators and NEL, and has the byte-order mark.
PY_CHARS = "".join(c for c in map(chr, range(0x10000)) if c.isspace())
JS_CHARS = "".join(c for c in PY_CHARS if c not in "\x1c\x1d\x1e\x1f\x85") + "\ufeff"


def py_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(PY_CHARS))


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(JS_CHARS))


def is_blank(c: Column) -> Column:
    """Whether py_strip() leaves nothing; it reads no further than the first letter."""
    return F.rlike(c, F.lit(rf"\A[{PY_SPACE}]*\z"))


def normalize_spaces(c: Column) -> Column:
    """Each run of white space becomes one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"[{PY_SPACE}]+", " "))


def splitlines(c: Column) -> Column:
    """Lines by any line end; none after a last one, and none of an empty text."""
    lines = F.split(c, LINE_END)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def nonblank_lines(c: Column) -> Column:
    return F.filter(splitlines(c), lambda x: ~is_blank(x))


def heading(line: Column) -> Column:
    """Marks the headings of a regulation's lines."""
    return F.when(F.startswith(line, F.lit("KAPITEL")), F.concat(F.lit("# "), line)).when(F.startswith(line, F.lit("ABSCHNITT")), F.concat(F.lit("## "), line)).when(F.startswith(line, F.lit("Artikel")), F.concat(F.lit("### "), line)).otherwise(line)


#: A heading and the line of its title, then what stands alone on a line before its text.
TITLED = r"(# KAPITEL\s+[IVXLCDM]+|## ABSCHNITT\s+\d+|ANHANG\s+[IVXLCDM]+)\n([^\n]+)|(### \bArtikel\s+\d+)\n([^\n]+)"
NUMBERED = [(r"\((\d+)\)\s*\n", "($1) "), (r"([a-z])\)\s*\n", "$1) "), (r"(\d+)\.\s*\n", "$1. ")]


def join_titles(c: Column) -> Column:
    return F.regexp_replace(c, TITLED, "$1$3: $2$4")


def join_numbers(c: Column) -> Column:
    for pattern, put in NUMBERED:
        c = F.regexp_replace(c, pattern, put)
    return c


#: The words that begin a heading, and its mark.
MARKS = [("KAPITEL", "#"), ("ABSCHNITT", "##"), ("Artikel", "###")]


def preprocess(c: Column) -> Column:
    """A regulation's text as Markdown: blank lines go, headings get their marks and titles, enumerators their text. Each step is one expression over the whole text."""
    lines = py_strip(F.regexp_replace(F.regexp_replace(c, LINE_END, "\n"), rf"\n[{PY_SPACE}]*\n", "\n"))
    for word, mark in MARKS:
        lines = F.regexp_replace(lines, rf"(?dm)^{word}", f"{mark} {word}")
    return join_numbers(join_titles(lines))


def base64(c: Column) -> Column:
    """UTF-8 in Base64, in one line."""
    return F.translate(F.base64(F.encode(c, "UTF-8")), "\r\n", "")


def preview(c: Column, n: int = 150) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def or_else(c: Column, other: Column) -> Column:
    """The first, unless it is empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def rule_before_titles(c: Column) -> Column:
    """A rule right before each line that begins with a source's title."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.when(F.startswith(js_trim(x), F.lit("Titel:")), F.concat(F.lit("<hr>"), x)).otherwise(x))
    return F.array_join(lines, "\n")


def approx_tokens(c: Column) -> Column:
    """A token for every four code points, none for an empty text. Any other counter may take its place."""
    return F.ceil(F.length(c) / 4).cast("int")


def fill_template(template: str, context: Column, query: Column) -> Column:
    """The template with {context_str} and {query_str} filled in, both as they are; {{ and }} are braces. Other fields are an error."""
    parts: list[Column] = []
    for text, field, spec, conversion in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is not None:
            if field not in {"context_str", "query_str"} or spec or conversion:
                raise ValueError(f"the template has an unknown field: {field!r}")
            parts.append(context if field == "context_str" else query)
    return F.concat(*parts) if parts else F.lit("")


def embedding_text(c: Column, role: str, model: str) -> Column:
    """What is embedded: with its role in front for the models that were trained so. role: query or passage."""
    return F.concat(F.lit(f"{role}: "), c) if "multilingual-e5" in model else c


def hover(title: Column, length: Column, content: Column, most: int = 3000) -> Column:
    """What a node of the graph shows."""
    return F.concat(F.lit("Title: "), title, F.lit(" | Content Length: "), length.cast("string"), F.lit(" | "), F.left(F.coalesce(content, F.lit("No content available")), F.lit(most)), F.lit("..."))


def mail_link(to: str, subject: Column, body: Column) -> Column:
    """A mailto link; a blank is %20 there, not +."""
    # Beyond letters and digits, these stand as they are: - _ . ! ~ * ' ( )
    plain = {"+": "%20", "%21": "!", "%7E": "~", "%27": "'", "%28": "(", "%29": ")"}

    def encoded(c: Column) -> Column:
        c = F.url_encode(c)
        for k, v in plain.items():
            c = F.replace(c, F.lit(k), F.lit(v))
        return c

    return F.concat(F.lit(f"mailto:{to}?subject="), encoded(subject), F.lit("&body="), encoded(body))


def root_of(path: Column, at: str = "src") -> Column:
    """What stands in a path before the first place of a folder's name."""
    return F.split_part(path, F.lit(at), F.lit(1))
