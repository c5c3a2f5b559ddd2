"""Page layout as rows: text normalisation, heading sizes, lines, tables, running lines, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import rx, strip

# Limits, patterns and the names of the steps.
LEAST_SIZE, LEVELS = 11.5, 3
LINE_GAP = 2.0
RUNNING_SHARE, RUNNING_WINDOW, RUNNING_PAGES = 0.8, 3, 3
PAGE_FOOTER = rx(r"^\s*\d+\s*\(\s*\d+\s*\)\s*$")
LEADERS = rx(r"\.{5,}\s*\d+\s*$")
STEPS = ("smart_quotes_to_ascii", "ligatures_expanded", "nb_hyphens_to_ascii", "double_spaces_collapsed", "space_before_punctuation_removed")
QUOTES = ("“”‘’‚‛", "\"\"''''")
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff"}
DASHES = ("‐‑–", "---")
# End of the fixed values.


def normalise(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with ``column`` in plain signs, and ``applied``: the steps that changed it, in order.

    Null texts stay null with no steps applied.
    """
    steps = [F.translate(F.col(column), *QUOTES)]
    joined = steps[-1]
    for sign, letters in LIGATURES.items():
        joined = F.replace(joined, F.lit(sign), F.lit(letters))
    steps.append(joined)
    steps.append(F.translate(joined, *DASHES))
    steps.append(F.regexp_replace(steps[-1], " {2,}", " "))
    steps.append(F.regexp_replace(steps[-1], " ([,;:!?.])", "$1"))
    before = [F.col(column), *steps[:-1]]
    applied = F.array_compact(F.array(*[F.when(a != b, F.lit(name)) for a, b, name in zip(before, steps, STEPS)]))
    return df.withColumns({"applied": applied, column: steps[-1]})


def heading_levels(sizes: DataFrame, *by: str) -> DataFrame:
    """The three largest distinct sizes, rounded to tenths, as levels 1 to 3 per ``by``."""
    rows = sizes.where(F.col("size") >= LEAST_SIZE).select(*by, F.round("size", 1).alias("size")).distinct()
    level = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("size")))
    return rows.withColumn("level", level).where(F.col("level") <= LEVELS)


def lines_of(chars: DataFrame, *by: str) -> DataFrame:
    """Characters (``by``, page, top, x0, size, text) as lines (``by``, page, line_no, top, size, text).

    Characters run from top to bottom and left to right; one further than
    ``LINE_GAP`` from the first of its line begins a new line. The fold runs in
    the row of each page.
    """
    rows = chars.withColumn("y", F.round("top", 1))
    rows = rows.groupBy(*by, "page").agg(F.array_sort(F.collect_list(F.struct("y", "x0", "size", "text"))).alias("chars"))
    empty = F.array().cast("array<struct<top:double,sizes:array<double>,text:string>>")

    def step(acc: Column, c: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = F.coalesce(F.abs(c["y"] - last["top"]) <= LINE_GAP, F.lit(False))
        grown = F.struct(last["top"].alias("top"), F.concat(last["sizes"], F.array(c["size"].cast("double"))).alias("sizes"), F.concat(last["text"], c["text"]).alias("text"))
        fresh = F.struct(c["y"].cast("double").alias("top"), F.array(c["size"].cast("double")).alias("sizes"), c["text"].alias("text"))
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    rows = rows.select(*by, "page", F.posexplode(F.aggregate("chars", empty, step)).alias("line_no", "l"))
    mean = F.aggregate("l.sizes", F.lit(0.0), lambda a, x: a + x) / F.size("l.sizes")
    return rows.select(*by, "page", "line_no", "l.top", mean.alias("size"), "l.text")


def outside_boxes(chars: DataFrame, boxes: DataFrame, *by: str) -> DataFrame:
    """``chars`` (``by``, page, x0, x1, top, bottom) whose centre lies in none of ``boxes`` of its page."""
    boxes = boxes.select(*[F.col(c).alias(f"of_{c}") for c in by], F.col("page").alias("p"), F.col("x0").alias("l"), F.col("x1").alias("r"), F.col("top").alias("t"), F.col("bottom").alias("b"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    same = F.col("page") == F.col("p")
    for c in by:
        same = same & (F.col(c) == F.col(f"of_{c}"))
    return chars.join(boxes, same & x.between(F.col("l"), F.col("r")) & y.between(F.col("t"), F.col("b")), "left_anti")


def pipe_table(cells: Column) -> Column:
    """Rows of cells as a table of pipes: header, rule, rows cut or filled to its width."""
    width = F.size(cells[0])
    fit = lambda row: F.slice(F.concat(F.transform(row, lambda c: strip(F.coalesce(c, F.lit("")))), F.array_repeat(F.lit(""), width)), F.lit(1), width)
    line = lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))
    body = F.transform(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), lambda r: line(fit(r)))
    table = F.array_join(F.concat(F.array(line(fit(cells[0])), line(F.array_repeat(F.lit("---"), width))), body), "\n")
    return F.when((F.size(cells) > 0) & (width > 0), table)


def running_lines(lines: DataFrame, *by: str) -> DataFrame:
    """Lines at the top or bottom of most pages: ``by``, place (header, footer), text.

    lines: ``by``, page, line_no, text. The first and last ``RUNNING_WINDOW``
    lines of a page count; a text runs if it has at least ``RUNNING_SHARE`` of
    the pages, and two, in documents of ``RUNNING_PAGES`` pages or more.
    """
    text = strip(F.col("text"))
    rows = lines.select(*by, "page", "line_no", text.alias("text")).where("text <> ''")
    pages = lines.select(*by, "page").distinct().groupBy(*by).agg(F.count("*").alias("n_pages"))
    window = Window.partitionBy(*by, "page")
    rows = rows.withColumns({"first": F.row_number().over(window.orderBy("line_no")), "last": F.row_number().over(window.orderBy(F.desc("line_no")))})
    places = F.array_compact(F.array(F.when(F.col("first") <= RUNNING_WINDOW, "header"), F.when(F.col("last") <= RUNNING_WINDOW, "footer")))
    counts = rows.select(*by, "text", F.explode(places).alias("place")).groupBy(*by, "place", "text").agg(F.count("*").alias("n"))
    needed = F.greatest(F.lit(2), F.floor(F.col("n_pages") * RUNNING_SHARE))
    return counts.join(pages, list(by)).where((F.col("n_pages") >= RUNNING_PAGES) & (F.col("n") >= needed)).select(*by, "place", "text", "n")


def skipped(text: Column) -> Column:
    """Whether a line is a page number or a leader line."""
    return text.rlike(PAGE_FOOTER) | text.rlike(LEADERS)


def assembled(lines: DataFrame, levels: DataFrame, running: DataFrame, *by: str) -> DataFrame:
    """A row per ``by`` and page, in the order of page: page mark, headings by size, body lines; skipped and running lines left out.

    lines: ``by``, page, line_no, size, text. A document may be long beyond any
    row, so its pages stay apart; joined in order they are its text.
    """
    keys = list(by)
    rows = normalise(lines.withColumn("text", strip(F.col("text"))).where("text <> ''").join(running.select(*by, "text").distinct(), [*keys, "text"], "left_anti"))
    rows = rows.where(~skipped(F.col("text"))).withColumn("size", F.round("size", 1)).join(levels, [*keys, "size"], "left")
    body = F.when(F.col("level").isNotNull(), F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"), F.lit("\n"))).otherwise(F.concat("text", F.lit("\n")))
    after = F.lag("level").over(Window.partitionBy(*by, "page").orderBy("line_no"))
    body = F.when(F.col("level").isNull() & after.isNotNull(), F.concat(F.lit("\n"), body)).otherwise(body)
    rows = rows.select(*by, "page", "line_no", body.alias("body"))
    marks = lines.select(*by, "page").distinct().select(*by, "page", F.lit(-1).alias("line_no"), F.concat(F.lit("\n<!-- page="), F.col("page"), F.lit(" -->\n")).alias("body"))
    rows = rows.unionByName(marks).groupBy(*by, "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "body"))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["body"]), "")
    return rows.select(*by, "page", F.regexp_replace(whole, r"\n{4,}", "\n\n\n").alias("markdown_text"))
