"""Tables inside stored pages to rows, with expressions alone: result, profile, split, trial and calendar pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions.scalars import clean_text, first_int, seconds

#: The few references that such pages use.
REFERENCES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"}


def plain(cell: Column) -> Column:
    """The text of a piece of markup."""
    out = F.regexp_replace(cell, r"(?s)<[^>]*>", " ")
    for ref, sign in REFERENCES.items():
        out = F.replace(out, F.lit(ref), F.lit(sign))
    return clean_text(out)


def elements(html: Column, tag: str) -> Column:
    """The inner markup of all elements of a name, in page order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)(?=</{tag}>|<{tag}\b|\z)"), F.lit(1))


def table_rows(pages: DataFrame, html: str, key: Sequence[str], row: str = "tr", cell: str = "t[dh]") -> DataFrame:
    """(key, row_no, cells): every row of every table of a page, its cells as plain text."""
    rows = pages.select(*key, F.posexplode(elements(F.col(html), row)).alias("row_no", "_row"))
    cells = F.regexp_extract_all("_row", F.lit(rf"(?is)<{cell}\b[^>]*>(.*?)(?=</{cell}>|<{cell}\b|\z)"), F.lit(1))
    return rows.select(*key, "row_no", F.transform(cells, plain).alias("cells"))


def cell(i: int) -> Column:
    return F.get(F.col("cells"), F.lit(i))


def carry_down(rows: DataFrame, key: Sequence[str], col: str, out: str) -> DataFrame:
    """Fills blanks of a column from the nearest row above on the same page."""
    w = Window.partitionBy(*key).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(F.when(F.col(col) != "", F.col(col)), ignorenulls=True).over(w))


def result_rows(pages: DataFrame, html: str, key: Sequence[str]) -> DataFrame:
    """Runners of result pages: position, saddle, name, draw, time and price, from rows of seven cells or more."""
    rows = table_rows(pages, html, key).where((F.size("cells") >= 7) & cell(1).rlike(r"^\d+$"))
    return rows.select(*key, first_int(cell(0)).alias("finish_pos"), cell(1).cast("int").alias("saddle"), cell(2).alias("horse_name"), first_int(cell(3)).alias("draw"), seconds(cell(5)).alias("time_s"), cell(6).try_cast("double").alias("win_odds"))


def dividend_rows(pages: DataFrame, html: str, key: Sequence[str]) -> DataFrame:
    """Payouts (pool, combination, dividend); a pool's name stands in its first row only."""
    rows = table_rows(pages, html, key).where(F.size("cells") == 3).withColumn("_pool", cell(0))
    rows = carry_down(rows, key, "_pool", "pool")
    return rows.select(*key, "pool", cell(1).alias("combination"), F.replace(cell(2), F.lit(","), F.lit("")).try_cast("double").alias("dividend")).where("dividend is not null")


def profile_pairs(pages: DataFrame, html: str, key: Sequence[str]) -> DataFrame:
    """Label and value pairs of a profile as a map; a label that repeats keeps its first value."""
    rows = table_rows(pages, html, key).where(F.size("cells") >= 2).select(*key, "row_no", F.rtrim(F.regexp_replace(cell(0), r"\s*:$", "")).alias("label"), F.element_at("cells", -1).alias("val"))
    first = rows.where("label <> ''").groupBy(*key, "label").agg(F.min_by("val", "row_no").alias("val"))
    return first.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "val")))).alias("profile"))


def birth_year(as_of: Column, age: Column) -> Column:
    return F.year(as_of) - age.try_cast("int")


def sectional_rows(pages: DataFrame, html: str, key: Sequence[str], most: int = 6) -> DataFrame:
    """(saddle, section_index, section_time_s) of rows with a saddle and up to ``most`` split cells; blanks go."""
    rows = table_rows(pages, html, key).where((F.size("cells") >= 4) & cell(1).rlike(r"^\d+$"))
    out = rows.select(*key, cell(1).cast("int").alias("saddle"), F.posexplode(F.slice("cells", 4, most)).alias("section", "raw"))
    return out.select(*key, "saddle", (F.col("section") + 1).alias("section_index"), F.regexp_extract("raw", r"(\d+\.\d+)", 1).try_cast("double").alias("section_time_s")).where("section_time_s is not null")


def comment_rows(pages: DataFrame, html: str, key: Sequence[str]) -> DataFrame:
    """(saddle, comment) of rows with a comment; dashes are none."""
    rows = table_rows(pages, html, key).where((F.size("cells") >= 4) & cell(1).rlike(r"^\d+$"))
    return rows.select(*key, cell(1).cast("int").alias("saddle"), F.element_at("cells", -1).alias("comment")).where("comment not in ('', '-', '--', '---')")


def trial_rows(pages: DataFrame, html: str, key: Sequence[str]) -> DataFrame:
    """Runners of trial pages with the batch number of the header row above them."""
    rows = table_rows(pages, html, key).withColumn("_head", F.regexp_extract(F.array_join("cells", " "), r"(?i)batch\s*(\d+)", 1))
    rows = carry_down(rows, key, "_head", "batch").where((F.size("cells") >= 5) & (F.col("_head") == ""))
    return rows.select(*key, F.col("batch").try_cast("int").alias("batch"), cell(0).alias("horse_name"), first_int(cell(1)).alias("draw"), seconds(cell(2)).alias("time_s"), cell(3).alias("result"), cell(4).alias("comment")).where("batch is not null")


def calendar_days(pages: DataFrame, html: str, year: str, month: str) -> DataFrame:
    """Meeting days of month pages: cells that begin with a day and name a venue."""
    cells = pages.select(year, month, F.explode(elements(F.col(html), "td")).alias("_c")).select(year, month, plain(F.col("_c")).alias("_t"))
    day = F.regexp_extract("_t", r"^(\d{1,2})\b", 1).try_cast("int")
    ok = F.col("_t").rlike(r"\b(ST|HV)\b") & day.between(1, 31)
    return cells.where(ok).select(F.make_date(F.col(year), F.col(month), day).alias("race_date"), F.regexp_extract("_t", r"\b(ST|HV)\b", 1).alias("venue")).distinct()


def links(pages: DataFrame, html: str, key: Sequence[str]) -> DataFrame:
    """(position, address, text) of every link of a page."""
    found = pages.select(*key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\b[^>]*href\s*=\s*\"[^\"]*\"[^>]*>.*?</a>"), F.lit(0))).alias("position", "_a"))
    return found.select(*key, "position", F.regexp_extract("_a", r"(?is)href\s*=\s*\"([^\"]*)\"", 1).alias("href"), plain(F.col("_a")).alias("label"))
