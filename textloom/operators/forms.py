"""Pages of placed words as form tables: columns of a page, cells of a row, table regions, Markdown.

Words: doc, page, text, x0, x1, top. All of a page is one row of arrays after one shuffle by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.bengali import bind
from textloom.operators.layout import clusters

#: Points, shares and counts of the form rules; fixed values.
ROW_HEIGHT, GROUP_GAP, PARAGRAPH_SHARE, PARAGRAPH_CHARS, NEAR, EDGE = 5, 50.0, 0.55, 60, 40, 20
PAGE_WIDTH, LEAST_WIDTH, PER_INCH, COLUMNS, TABLE_SHARE = 612.0, 30.0, 10.0, 15, 0.2
NUMBERING = "^\\.\\d+$"


def cell_of(x: Column, columns: Column) -> Column:
    """Range join of a place with its columns: the first whose next column begins more than EDGE beyond x, else the last."""
    later = F.array_position(F.transform(F.slice(columns, 2, F.greatest(F.size(columns) - 1, F.lit(0))), lambda c: x < F.coalesce(c, F.lit(float("inf"))) - EDGE), F.lit(True))
    return F.when(F.size(columns) > 0, F.coalesce(F.nullif(later, F.lit(0)), F.size(columns)).cast("int") - 1)


def aligned(xs: Column, columns: Column) -> Column:
    """How many columns are the first within NEAR of some x."""
    first = F.transform(xs, lambda x: F.nullif(F.array_position(F.transform(columns, lambda c: F.abs(x - c) < NEAR), F.lit(True)), F.lit(0)))
    return F.when(F.size(columns) > 0, F.size(F.array_distinct(F.array_compact(first)))).otherwise(0)


def tolerance(xs: Column) -> Column:
    """Gap that parts columns of sorted places: the 70th percentile of gaps over 5, held within 25 to 50; 35 under three gaps."""
    later, earlier = F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0)))
    wide = F.sort_array(F.filter(F.zip_with(later, earlier, lambda a, b: a - b), lambda g: g > 5))
    return bind(wide, lambda gaps: F.when(F.size(gaps) < 3, F.lit(35.0)).otherwise(F.least(F.greatest(F.get(gaps, F.floor(F.size(gaps) * 0.7).cast("int")), F.lit(25.0)), F.lit(50.0))))


def is_form(columns: Column, width: Column) -> Column:
    """Whether a page's columns look like a form's: two or more, wide enough, not too dense, not too many for the page."""
    n = F.size(columns)
    span = F.element_at(columns, -1) - F.element_at(columns, 1)
    return F.when(n > 1, (span / n >= LEAST_WIDTH) & (n / (span / 72) <= PER_INCH) & (n <= F.greatest(F.lit(COLUMNS), F.floor(20 * width / PAGE_WIDTH)))).otherwise(F.lit(False))


def is_table(rows: Column) -> Column:
    """Whether rows of cells make a table: three rows or more, three to ten columns, at most 30 % of cells over 30 characters."""
    cells = F.flatten(rows)
    long = F.size(F.filter(cells, lambda c: F.length(c) > 30))
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    return (F.size(rows) >= 3) & width.between(3, 10) & (F.size(cells) > 0) & (long <= 0.3 * F.size(cells))


def aligned_table(rows: Column, separator: bool = True) -> Column:
    """Markdown of rows of cells, padded to the widest of each column: blank rows and null cells go; without rows it is empty."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    clean = F.filter(clean, lambda r: F.exists(r, lambda c: F.trim(c) != ""))
    n = F.coalesce(F.array_min(F.transform(clean, lambda r: F.size(r))), F.lit(0))
    widths = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_max(F.transform(clean, lambda r: F.length(F.get(r, i)))))).otherwise(F.array().cast("array<int>"))
    line = lambda r: F.concat(F.lit("|"), F.array_join(F.zip_with(F.slice(r, 1, F.size(widths)), widths, lambda c, w: F.rpad(c, w, " ")), "|"), F.lit("|"))
    lines = F.transform(clean, line)
    if separator:
        rule = F.concat(F.lit("|"), F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w)), "|"), F.lit("|"))
        lines = F.when(F.size(lines) > 0, F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))).otherwise(lines)
    return F.array_join(lines, "\n")


def page_rows(words: DataFrame) -> DataFrame:
    """doc, page, rows: a page's rows by height, each with its words in x order, text and starts of word groups. One shuffle."""
    y = F.bround(F.col("top") / ROW_HEIGHT) * ROW_HEIGHT
    w = words.select("doc", "page", F.struct(y.alias("y"), F.col("x0").cast("double").alias("x0"), "text", F.col("x1").cast("double").alias("x1")).alias("w"))
    w = w.groupBy("doc", "page").agg(F.sort_array(F.collect_list("w")).alias("w"))
    begins = lambda i: (i == 0) | ~F.get("w", i)["y"].eqNullSafe(F.get("w", i - 1)["y"])
    line = lambda t: F.struct(t.alias("words"), F.array_join(F.transform(t, lambda x: x["text"]), " ").alias("text"), clusters(F.transform(t, lambda x: x["x0"]), GROUP_GAP).alias("groups"))
    rows = bind(F.filter(F.sequence(F.lit(0), F.size("w") - 1), begins), lambda at: _pieces(at, F.size("w"), lambda i, j: bind(F.slice("w", i + 1, j - i), line)))
    return w.select("doc", "page", rows.alias("rows"))


def _pieces(starts: Column, n: Column, f) -> Column:
    """f of first place and end of each piece of n places; a piece ends where the next one starts."""
    return F.zip_with(starts, F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n)), f)


def form_pages(words: DataFrame, width: float = PAGE_WIDTH) -> DataFrame:
    """doc, page, columns, table_rows, rows, markdown: tables of aligned rows and plain lines between; markdown is null where the page is no form.

    A page is one if its rows of three groups or more give form-like columns and a fifth of its rows are table rows: neither
    paragraphs nor numbered items, and with words at two columns or more. Words tie by text. Pages without words are absent.
    What an inner function needs of the page is bound outside it, so that it is made once a page, not once a word.
    """
    p = page_rows(words)
    paragraph = lambda r: (F.element_at(r["words"], -1)["x1"] - F.element_at(r["words"], 1)["x0"] > width * PARAGRAPH_SHARE) & (F.length(r["text"]) > PARAGRAPH_CHARS)
    starts = F.sort_array(F.flatten(F.transform(F.filter("rows", lambda r: (F.size(r["groups"]) >= 3) & ~paragraph(r)), lambda r: r["groups"])))
    p = p.withColumn("columns", bind(starts, lambda xs: bind(tolerance(xs), lambda gap: _clusters_by(xs, gap))))
    form = is_form(F.col("columns"), F.lit(width))
    numbered = lambda r: F.trim(F.element_at(r["words"], 1)["text"]).rlike(NUMBERING)
    flag = lambda r: F.coalesce(~paragraph(r) & ~numbered(r) & (aligned(F.transform(r["words"], lambda t: t["x0"]), F.col("columns")) >= 2), F.lit(False))
    p = p.withColumn("flags", F.transform("rows", flag)).withColumn("table_rows", F.size(F.filter("flags", lambda x: x)))
    p = p.withColumn("form", F.coalesce(form & (F.col("table_rows") >= TABLE_SHARE * F.size("rows")), F.lit(False)))
    # a part is a plain row, or a run of table rows
    begins = F.filter(F.sequence(F.lit(0), F.size("flags") - 1), lambda i: (i == 0) | ~F.get("flags", i) | ~F.get("flags", i - 1))
    part = lambda i, j: F.when(F.get("flags", i), bind(F.transform(F.slice("rows", i + 1, j - i), lambda r: _cells(r["words"], F.col("columns"))), _form_table)).otherwise(F.get("rows", i)["text"])
    markdown = bind(begins, lambda at: F.array_join(_pieces(at, F.size("flags"), part), "\n"))
    p = p.withColumn("markdown", F.when(F.col("form"), markdown))
    return p.select("doc", "page", "columns", "table_rows", F.size("rows").alias("rows"), "markdown")


def _cells(words: Column, columns: Column) -> Column:
    """The text of a row's words by column; each word's column is looked up once."""
    placed = F.transform(words, lambda t: F.struct(cell_of(t["x0"], columns).alias("c"), t["text"].alias("text")))
    return bind(placed, lambda w: F.transform(F.sequence(F.lit(0), F.size(columns) - 1), lambda c: F.array_join(F.transform(F.filter(w, lambda t: t["c"] == c), lambda t: t["text"]), " ")))


def _clusters_by(xs: Column, gap: Column) -> Column:
    empty = F.array().cast("array<double>")
    return F.aggregate(xs, empty, lambda a, x: F.when((F.size(a) == 0) | (x - F.get(a, F.size(a) - 1) > gap), F.concat(a, F.array(x))).otherwise(a))


def _form_table(rows: Column) -> Column:
    n = F.size(F.element_at(rows, 1))
    widths = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.lit(3), F.array_max(F.transform(rows, lambda r: F.length(F.get(r, i))))))

    def table(widths: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.zip_with(r, widths, lambda c, w: F.rpad(c, w, " ")), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
        return bind(F.transform(rows, line), lambda x: F.array_join(F.concat(F.slice(x, 1, 1), F.array(rule), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))), "\n"))

    return bind(widths, table)


def join_numbering(text: Column) -> Column:
    """Lines that are only '.N' joined with the next line that holds text; blank lines between go."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("mark"), F.lit(None).cast("string").alias("raw"), F.array().cast("array<string>").alias("gap"))

    def step(a: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, "^\\s+|\\s+$", "")
        lone = bare.rlike(NUMBERING)
        open_ = a["mark"].isNotNull()
        out = F.when(open_ & (bare != ""), F.concat(a["out"], F.array(F.concat_ws(" ", a["mark"], bare)))).when(~open_ & ~lone, F.concat(a["out"], F.array(line))).otherwise(a["out"])
        starts = ~open_ & lone
        return F.struct(
            out.alias("out"), F.when(starts, bare).when(open_ & (bare == ""), a["mark"]).alias("mark"), F.when(starts, line).when(open_ & (bare == ""), a["raw"]).alias("raw"),
            F.when(open_ & (bare == ""), F.concat(a["gap"], F.array(line))).otherwise(F.array().cast("array<string>")).alias("gap"),
        )

    end = lambda a: F.when(a["raw"].isNotNull(), F.concat(a["out"], F.array(a["raw"]), a["gap"])).otherwise(a["out"])
    return F.array_join(F.aggregate(F.split(text, "\n", -1), state, step, end), "\n")
