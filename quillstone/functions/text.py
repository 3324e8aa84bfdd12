"""Text expressions: tokens, words, normalisation, citations, labels.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1)), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Pieces between Unicode white space, none of them empty."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_space(text: Column) -> Column:
    """One kind of line break, one blank for runs of blanks and tabs, at most one empty line, no white space at the ends."""
    x = F.regexp_replace(text, "\r\n?", "\n")
    x = F.regexp_replace(x, "[ \t]+", " ")
    return strip(F.regexp_replace(x, "\n{3,}", "\n\n"))


def merge_lines(text: Column) -> Column:
    """Lines of one paragraph joined by a blank; blank lines keep separating paragraphs."""
    lines = F.transform(F.split(text, "\n", -1), strip)
    marked = F.array_join(F.transform(lines, lambda x: F.when(x == "", F.lit("\u0000")).otherwise(x)), " ")
    return strip(F.regexp_replace(F.regexp_replace(marked, "( ?\u0000)+ ?", "\n\n"), "^\n\n|\n\n$", ""))


def normalize_text(text: Column) -> Column:
    """``merge_lines`` of ``normalize_space``."""
    return merge_lines(normalize_space(text))


def compact(text: Column) -> Column:
    """For literal comparison: white space runs as one blank, none at the ends, lower case."""
    return F.lower(strip(F.regexp_replace(text, r"(?U)\s+", " ")))


def footer_key(text: Column) -> Column:
    """The label of a footer ``<label> | <year> Form 10-K | <page>`` in lower case, or null."""
    one = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    key = F.regexp_extract(one, r"(?i)^([^|\n]+\|\s*\d{4}\s+Form\s+10-K)\s*\|\s*\d+$", 1)
    return F.when(key != "", F.lower(key))


def only_symbols(text: Column) -> Column:
    """Nothing but trademark signs and white space."""
    return text.rlike(r"(?U)^[®™\s]+$")


def citations(answer: Column) -> Column:
    """Labels E1, E2 … cited in square brackets, each once, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(E\d+)\]"), F.lit(1)))


def without_citations(answer: Column) -> Column:
    return F.regexp_replace(answer, r"\[E\d+\]", "")


def location_label(source: Column) -> Column:
    """A reader's label of a source location, by format."""
    fmt = source["fmt"]
    path = F.when(F.size(source["heading_path"]) > 0, F.array_join(source["heading_path"], " / "))
    docx = F.concat_ws(
        ", ", path, F.when(source["paragraph"].isNotNull(), F.concat(F.lit("paragraph "), source["paragraph"].cast("string"))), F.when(source["table_no"].isNotNull(), F.concat(F.lit("table "), source["table_no"].cast("string")))
    )
    return (
        F.when(fmt == "pdf", F.concat(F.lit("page "), source["page"].cast("string")))
        .when(fmt == "xlsx", F.concat(source["sheet"], F.lit("!"), source["cell_range"]))
        .otherwise(docx)
    )


def document_id(content: Column) -> Column:
    """SHA-256 of the bytes, in hexadecimal."""
    return F.sha2(content, 256)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
