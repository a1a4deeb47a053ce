"""Literal search and replacement, escaping, number and date spans, file names and tables, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amounts, dates and numbers in either script; fixed values.
NUMBER_DATE = (
    "(?:[$৳€£¥]|BDT\\s*|USD\\s*|Rs\\.?\\s*)[0-9০-৯]+(?:[.,][0-9০-৯]+)*"
    "|\\b[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}\\b"
    "|\\b[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?%?\\b"
    "|[০-৯]+(?:,[০-৯]{3})*(?:\\.[০-৯]+)?%?"
)


def number_spans(text: Column) -> Column:
    """Amounts, dates and numbers of a text, in order."""
    return F.regexp_extract_all(text, F.lit(NUMBER_DATE), F.lit(0))


def find_next(text: Column, term: str, start: Column) -> Column:
    """Place (from 0) of the next occurrence from start on, else of the first one; -1 for none."""
    at = F.locate(term, text, 1)
    return (F.coalesce(F.nullif(F.expr("0") + _locate(text, term, start), F.lit(0)), at) - 1).cast("long")


def _locate(text: Column, term: str, start: Column) -> Column:
    after = F.locate(term, F.substring(text, start + 1, F.length(text)))
    return F.when(after > 0, after + start).otherwise(0)


def replace_all(text: Column, term: str, by: str) -> tuple[Column, Column]:
    """(text, count) after replacing a literal everywhere."""
    n = F.size(F.split(text, "\\Q" + term + "\\E", -1)) - 1
    return F.replace(text, F.lit(term), F.lit(by)), n.cast("long")


def escape_html(text: Column) -> Column:
    """&, <, > and both quotes as references."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def ascii_filename(name: Column, other: str = "document.txt") -> Column:
    """The ASCII letters, digits, dots, spaces, hyphens and underscores of a name; other where none is left."""
    kept = F.trim(F.regexp_replace(name, "[^A-Za-z0-9. _-]", ""))
    return F.when(kept != "", kept).otherwise(other)


def download_headers(name: Column, content: Column, mime: str = "text/plain; charset=utf-8") -> Column:
    """Headers of a download: an ASCII name and the whole one percent-encoded, type and length in bytes."""
    whole = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    return F.struct(
        F.lit(mime).alias("content_type"), F.concat(F.lit('attachment; filename="'), ascii_filename(name), F.lit("\"; filename*=UTF-8''"), whole).alias("content_disposition"),
        F.octet_length(content).cast("long").alias("content_length"),
    )


def table_text(headers: Column, rows: Column) -> Column:
    """Markdown of an entry form: blank headers become Col, blank cells -."""
    filled = lambda xs, other: F.transform(xs, lambda x: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", F.trim(x)).otherwise(other))
    line = lambda xs: F.concat(F.lit("| "), F.array_join(xs, " | "), F.lit(" |\n"))
    body = F.array_join(F.transform(rows, lambda r: line(filled(r, "-"))), "")
    return F.concat(F.lit("\n\n"), line(filled(headers, "Col")), line(F.transform(headers, lambda h: F.lit(":---"))), body, F.lit("\n"))


def strip_comments(text: Column) -> Column:
    """HTML comments taken out."""
    return F.regexp_replace(text, "(?s)<!--.*?-->", "")
