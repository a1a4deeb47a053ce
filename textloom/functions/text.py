"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of trimming and word splitting.
WS = "[ \\t\\n\\x0B\\f\\r]"
EMAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"
URL = "https?://[^ \\t\\n\\x0B\\f\\r)\\]>]+"


def long(c: Column) -> Column:
    return c.cast("long")


def words(c: Column) -> Column:
    """Number of white-space separated words; 0 for null and blank."""
    return long(F.coalesce(F.regexp_count(c, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)))


def lines(c: Column) -> Column:
    return long(F.coalesce(F.size(F.split(c, "\n", -1)), F.lit(0)))


def sentences(c: Column) -> Column:
    """Non-blank pieces between runs of sentence ends."""
    return long(F.coalesce(F.size(F.filter(F.split(c, "[।!?.\\n]+", -1), lambda x: F.regexp_count(x, F.lit("[^ \\t\\n\\x0B\\f\\r]")) > 0)), F.lit(0)))


def reading_minutes(word_count: Column) -> Column:
    """At 200 words a minute, one at least."""
    return F.greatest(F.lit(1).cast("long"), long(F.ceil(word_count / F.lit(200.0))))


def human_size(n: Column) -> Column:
    """Bytes as B, KB (one decimal), MB or GB (two); a half goes to the even digit, as in C; null for null."""
    n = n.cast("long")

    def scaled(shift: int, digits: int, unit: str) -> Column:
        whole = F.shiftright(n, shift)
        part = (n - F.shiftleft(whole, shift)) * 10**digits
        low = F.shiftright(part, shift)
        rest, half = part - F.shiftleft(low, shift), F.lit(1 << (shift - 1))
        low = low + F.when((rest > half) | ((rest == half) & (low % 2 == 1)), 1).otherwise(0)
        whole, low = whole + F.floor(low / 10**digits), low % 10**digits
        return F.concat(whole.cast("string"), F.lit("."), F.lpad(low.cast("string"), digits, "0"), F.lit(unit))

    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, scaled(10, 1, " KB"))
        .when(n < 1024**3, scaled(20, 2, " MB"))
        .otherwise(scaled(30, 2, " GB"))
    )


def fence_errors(c: Column) -> Column:
    """Odd numbers of code fences and of $$ marks are errors."""
    return long(F.regexp_count(c, F.lit("```")) % 2 + F.regexp_count(c, F.lit("\\$\\$")) % 2)


def empty_links(c: Column) -> Column:
    return long(F.regexp_count(c, F.lit("\\[[^\\]]*\\]\\([ \\t]*\\)")))


def normalize_markdown(c: Column) -> Column:
    """Trailing white space of lines goes; three or more line ends become two."""
    c = F.regexp_replace(c, "[ \\t\\x0B\\f\\u00A0\\u1680\\u2000-\\u200A\\u202F\\u205F\\u3000]+(?=\\r?\\n|\\z)", "")
    return F.regexp_replace(c, "\\n{3,}", "\n\n")


def capital_tokens(c: Column) -> Column:
    """Sorted distinct tokens of two to six capitals."""
    return F.array_sort(F.array_distinct(F.filter(F.split(c, "[^\\p{L}\\p{N}_]+"), lambda x: x.rlike("^[A-Z]{2,6}$"))))


def token_estimate(word_count: Column) -> Column:
    """int(words * 1.3) + 1."""
    return long(F.floor(word_count * F.lit(1.3))) + 1


def drop_cid_lines(c: Column) -> Column:
    """Lines with more than one cid:n mark go."""
    return F.array_join(F.filter(F.split(c, "\n", -1), lambda x: F.regexp_count(x, F.lit("(?i)\\(?cid:[0-9]+\\)?")) <= 1), "\n")


MATH = "\\$\\$[^$]+\\$\\$|\\$[^$\\n]+\\$"


def line_ending(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\r\n")), "CRLF").when(F.contains(c, F.lit("\r")), "CR").otherwise("LF")


def indent(c: Column) -> Column:
    """tab, space or none, by how lines begin."""
    return F.when(c.rlike("(^|\\n)\\t"), "tab").when(c.rlike("(^|\\n)  "), "space").otherwise("none")


def slides(c: Column) -> Column:
    """Pieces with text between rule lines."""
    return F.filter(F.split(c, "\\n(?:-{3,}|\\*{3,}|_{3,})[ \\t]*\\n", -1), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))


def fence_lines(c: Column) -> Column:
    """Lines as structs (line, kind, open): kind is fence, code inside a fence, or text; open says whether a fence is open after the line."""
    state = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<line:string,kind:string,open:boolean>>").alias("out"))

    def step(a: Column, line: Column) -> Column:
        fence = F.trim(line).startswith("```")
        now = F.when(fence, ~a["open"]).otherwise(a["open"])
        kind = F.when(fence, "fence").when(a["open"], "code").otherwise("text")
        return F.struct(now.alias("open"), F.concat(a["out"], F.array(F.struct(line.alias("line"), kind.alias("kind"), now.alias("open")))).alias("out"))

    return F.aggregate(F.split(c, "\n", -1), state, step, lambda a: a["out"])
