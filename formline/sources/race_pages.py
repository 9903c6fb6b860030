"""Race, meeting and profile pages as typed rows: a page's tables are folded inside its own row, so nothing is shuffled.

A page's markup becomes an array of tables, each an array of rows of cells. The table that is wanted is found by its
header row, class or first words; header names lead to a row's cells, and what carries over from row to row (a pool's
name, a header) is carried by a fold over the rows. Malformed or missing parts give nulls or no rows, never an error;
null pages give none.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions.scalars import day_of, first_int, seconds, whole_float
from formline.sources.pages import plain

#: Venues by name, labels of the header table, surfaces, and the header titles of result and form tables.
VENUES = {"happy valley": "HV", "sha tin": "ST"}
HEADER = r"(?i)RACE\s+(\d+)\s*\((\d+)\)"
CLASS_LINE = r"(?i)\b\d+\s*M\b"


def _title(prefix: Sequence[str] = (), part: Sequence[str] = (), whole: Sequence[str] = ()) -> Callable[[Column], Column]:
    """Whether a lower-case title begins with, holds or is one of these."""

    def test(t: Column) -> Column:
        out = F.lit(False)
        for x in prefix:
            out = out | t.startswith(x)
        for x in part:
            out = out | t.contains(x)
        for x in whole:
            out = out | (t == x)
        return out

    return test


RESULT_TITLES = {
    "pos": _title(["pla"]), "saddle": _title(["horse no", "h.no"], whole=["h. no"]), "horse": _title(whole=["horse"]), "jockey": _title(["jockey"]), "trainer": _title(["trainer"]), "act_wt": _title(["act"]),
    "declar_wt": _title(part=["declar"]), "draw": _title(["dr"]), "lbw": _title(part=["lbw"]), "running": _title(part=["running"]), "finish_time": _title(part=["finish time"]), "win_odds": _title(part=["win odds"]),
}
FORM_TITLES = {
    "race_index": _title(whole=["race index", "raceindex"]), "pos": _title(["pla"]), "date": _title(whole=["date"]), "course": _title(["rc"], ["track"]), "dist": _title(["dist"]), "going": _title(whole=["g"]),
    "race_class": _title(part=["class"]), "draw": _title(["dr"]), "rating": _title(["rtg"], ["rating"]), "trainer": _title(["trainer"]), "jockey": _title(["jockey"]), "lbw": _title(part=["lbw"]), "win_odds": _title(part=["win odds"]),
    "act_wt": _title(["act"]), "running": _title(part=["running"]), "finish_time": _title(part=["finish time"]), "declar_wt": _title(part=["declar"]), "gear": _title(part=["gear"]),
}


def _all(markup: Column, tag: str) -> Column:
    """Whole elements of a name, up to their end or the next one's start."""
    return F.regexp_extract_all(markup, F.lit(rf"(?is)<{tag}\b[^>]*>.*?(?=</{tag}>|<{tag}\b|\z)"), F.lit(0))


def _inner(element: Column) -> Column:
    return F.regexp_replace(element, r"(?s)^<[^>]*>", "")


def tables(html: Column) -> Column:
    """array<struct<classes: array<string>, rows: array<array<string>>>>: every table of a page, its cells as markup."""

    def one(t: Column) -> Column:
        names = F.regexp_extract(t, r"""(?is)^<table\b[^>]*?\bclass\s*=\s*["']?([^"'>]*)""", 1)
        rows = F.transform(_all(t, "tr"), lambda r: F.transform(_all(r, "t[dh]"), _inner))
        return F.struct(F.split(F.trim(names), r"\s+").alias("classes"), rows.alias("rows"))

    return F.transform(_all(F.coalesce(html, F.lit("")), "table"), one)


def _first(array: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(array, test), F.lit(0))


def _some(text: Column) -> Column:
    return F.when(text != "", text)


def _whole(row: Column) -> Column:
    """The text of a row, its cells one after another."""
    return F.trim(F.array_join(F.transform(row, plain), " "))


def titled_rows(pages: DataFrame, html: str, key: Sequence[str], titles: Mapping[str, Callable[[Column], Column]], need: Sequence[str], css: str | None = None) -> DataFrame:
    """(key, row_no, names, cells): rows below the header of a page's first table that has ``need`` among its titles.

    With ``css`` only the first table of that class is looked at. The last of two columns with one title counts.
    """

    def named(row: Column) -> Column:
        def name(c: Column) -> Column:
            t = F.lower(plain(c))
            out = F.lit("")
            for n, test in reversed(titles.items()):
                out = F.when(test(t), n).otherwise(out)
            return out

        return F.transform(row, name)

    def headed(t: Column) -> Column:
        heads = F.transform(t["rows"], named)
        fits = F.transform(heads, lambda h: F.forall(F.array(*map(F.lit, need)), lambda n: F.array_contains(h, n)))
        at = F.array_position(fits, F.lit(True)).cast("int")
        return F.struct(t["rows"].alias("rows"), F.get(heads, at - 1).alias("names"), at.alias("at"))

    every = tables(F.col(html))
    if css:
        every = F.slice(F.filter(every, lambda t: F.array_contains(t["classes"], css)), 1, 1)
    found = pages.withColumn("_t", _first(F.transform(every, headed), lambda t: t["at"] > 0)).where("_t IS NOT NULL")
    below = F.slice("_t.rows", F.col("_t.at") + 1, F.size("_t.rows"))
    return found.select(*key, F.col("_t.names").alias("names"), F.posexplode(below).alias("row_no", "cells"))


def field(name: str) -> Column:
    """The markup of a row's cell under a title; null where there is none."""
    at = F.size("names") - F.array_position(F.reverse("names"), F.lit(name)).cast("int")
    return F.when(F.array_contains("names", F.lit(name)), F.get("cells", at))


def text(name: str) -> Column:
    return F.coalesce(plain(field(name)), F.lit(""))


def linked_id(markup: Column, parameter: str) -> Column:
    """An id that a cell's first link with such a parameter carries."""
    return _some(F.regexp_extract(F.coalesce(markup, F.lit("")), rf"""(?is)<a\b[^>]*\bhref\s*=\s*["']?[^"'>]*?{parameter}=([A-Za-z0-9_]+)""", 1))


def runner_rows(pages: DataFrame, html: str, key: Sequence[str]) -> DataFrame:
    """Runners of result pages by the titles of their table; rows without a number or a name go."""
    rows = titled_rows(pages, html, key, RESULT_TITLES, ("pos", "win_odds"))
    link = F.regexp_extract(F.coalesce(field("horse"), F.lit("")), r"(?is)<a\b[^>]*>(.*?)</a>", 1)
    name = F.when(F.coalesce(field("horse"), F.lit("")).rlike(r"(?is)<a\b"), plain(link)).otherwise(F.trim(F.regexp_replace(text("horse"), r"\(.*?\)\s*$", "")))
    return rows.select(
        *key, first_int(text("pos")).alias("finish_pos"), text("pos").alias("finish_pos_raw"), F.upper(text("pos")).contains("DH").alias("dead_heat"), first_int(text("saddle")).alias("saddle"),
        linked_id(field("horse"), "horseid").alias("horse_id"), name.alias("horse_name"), linked_id(field("jockey"), "jockeyid").alias("jockey_code"), _some(text("jockey")).alias("jockey_name"),
        linked_id(field("trainer"), "trainerid").alias("trainer_code"), _some(text("trainer")).alias("trainer_name"), first_int(text("act_wt")).alias("actual_weight"), first_int(text("declar_wt")).alias("declared_weight"),
        first_int(text("draw")).alias("draw"), _some(text("lbw")).alias("lbw_raw"), _some(text("running")).alias("running_position_raw"), seconds(text("finish_time")).alias("finish_time_s"), whole_float(text("win_odds")).alias("win_odds"),
    ).where("saddle IS NOT NULL AND horse_name <> ''")


def payout_rows(pages: DataFrame, html: str, key: Sequence[str]) -> DataFrame:
    """(pool, combination, dividend) of the table that begins with "Dividend"; a row of two cells belongs to the pool above."""
    found = _first(tables(F.col(html)), lambda t: (F.size(t["rows"]) > 0) & (_whole(F.get(t["rows"], F.lit(0))) == "Dividend"))
    rows = F.transform(found["rows"], lambda r: F.filter(F.transform(r, plain), lambda c: c != ""))
    kind = "array<struct<pool:string,combination:string,raw:string>>"
    start = F.struct(F.lit(None).cast("string").alias("pool"), F.array().cast(kind).alias("out"))

    def step(acc: Column, cells: Column) -> Column:
        full = F.size(cells) >= 3
        more = (F.size(cells) == 2) & acc["pool"].isNotNull()
        pool = F.when(full, F.get(cells, F.lit(0))).otherwise(acc["pool"])
        at = F.when(full, F.lit(1)).otherwise(F.lit(0))
        one = F.array(F.struct(pool.alias("pool"), F.get(cells, at).alias("combination"), F.get(cells, at + 1).alias("raw")))
        return F.struct(pool.alias("pool"), F.when(full | more, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    got = pages.select(*key, F.explode(F.aggregate(rows, start, step, lambda acc: acc["out"])).alias("x"))
    return got.select(*key, "x.pool", "x.combination", whole_float(F.col("x.raw")).alias("dividend")).where("dividend IS NOT NULL AND pool NOT IN ('Pool', 'Dividend')")


def race_headers(pages: DataFrame, html: str, key: Sequence[str]) -> DataFrame:
    """One row per page: race_index, race_class, distance_m, rating_band, race_name, prize_hkd, going, course, rail, surface; nulls without a header table."""
    found = _first(tables(F.col(html)), lambda t: (F.size(t["rows"]) > 0) & plain(F.coalesce(F.get(F.get(t["rows"], F.lit(0)), F.lit(0)), F.lit(""))).rlike(HEADER))
    df = pages.select(*key, F.transform(found["rows"], lambda r: F.transform(r, plain)).alias("_rows"))
    pair = lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda j: F.struct(F.rtrim(F.regexp_replace(F.get(r, j), r"[ :]+$", "")).alias("label"), F.coalesce(F.get(r, j + 1), F.lit("")).alias("value")))
    some = F.filter("_rows", lambda r: F.size(r) > 0)
    df = df.withColumns({"_lead": F.transform(some, lambda r: F.get(r, F.lit(0))), "_pairs": F.flatten(F.transform(some, pair))})

    def labelled(name: str) -> Column:
        return _some(F.try_element_at(F.filter("_pairs", lambda p: p["label"] == name), F.lit(-1))["value"])

    header, class_line = _first(F.col("_lead"), lambda c: c.rlike(HEADER)), _first(F.col("_lead"), lambda c: c.rlike(CLASS_LINE))
    prize = _first(F.col("_lead"), lambda c: F.upper(c).startswith("HK$"))
    name = _first(F.col("_lead"), lambda c: (c != "") & (c == F.upper(c)) & ~c.rlike(HEADER) & ~c.rlike(CLASS_LINE) & ~F.upper(c).startswith("HK$") & c.rlike(r"\p{L}"))
    up = F.upper(labelled("Course"))
    return df.select(
        *key, F.regexp_extract(header, HEADER, 2).try_cast("int").alias("race_index"), _some(F.trim(F.get(F.split(class_line, " - "), F.lit(0)))).alias("race_class"),
        F.regexp_extract(class_line, r"(?i)(\d+)\s*M", 1).try_cast("int").alias("distance_m"), _some(F.regexp_extract(class_line, r"\(([^)]*)\)", 1)).alias("rating_band"), name.alias("race_name"), first_int(prize).alias("prize_hkd"),
        labelled("Going").alias("going"), labelled("Course").alias("course"), _some(F.regexp_extract(labelled("Course"), r'"([^"]+)"', 1)).alias("rail"),
        F.when(up.contains("ALL WEATHER") | up.contains("AWT"), "ALL WEATHER TRACK").when(up.contains("TURF"), "TURF").alias("surface"),
    )


def races(pages: DataFrame, html: str, key: Sequence[str]) -> DataFrame:
    """Race headers with the winner's time, null without one; no markup is shuffled, only keys and times."""
    final = runner_rows(pages, html, key).where("finish_pos = 1").groupBy(*key).agg(F.min_by("finish_time_s", "saddle").alias("final_time_s"))
    return race_headers(pages, html, key).join(final, list(key), "left")


def meeting_dates(pages: DataFrame, html: str, key: Sequence[str]) -> DataFrame:
    """(key, race_date): dates of the drop-down list of meetings."""
    lists = F.filter(_all(F.coalesce(F.col(html), F.lit("")), "select"), lambda s: s.rlike(r"""(?is)^<select\b[^>]*\b(?:id|name)\s*=\s*["']?selectId\b"""))
    return pages.select(*key, F.explode(_all(F.get(lists, F.lit(0)), "option")).alias("_o")).select(*key, day_of(plain(_inner(F.col("_o")))).alias("race_date")).where("race_date IS NOT NULL")


def meetings(pages: DataFrame, html: str, key: Sequence[str]) -> DataFrame:
    """(key, venue, n_races): the venue that a meeting page names and how many races it has."""
    page = F.coalesce(F.col(html), F.lit(""))
    card = F.regexp_extract(page, r"""(?is)<(\w+)\b[^>]*class\s*=\s*["'][^"']*\bjs_racecard\b[^>]*>(.*?)</\1>""", 2)
    where = F.lower(plain(F.when(card != "", card).otherwise(page)))
    venue = F.lit(None).cast("string")
    for name, code in reversed(VENUES.items()):
        venue = F.when(where.contains(name), code).otherwise(venue)
    listed = F.size(F.filter(tables(F.col(html)), lambda t: F.array_contains(t["classes"], "result")))
    named = F.size(F.array_distinct(F.regexp_extract_all(plain(page), F.lit(HEADER), F.lit(1))))
    return pages.select(*key, venue.alias("venue"), F.when(listed > 0, listed).otherwise(named).alias("n_races"))


def _label(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def _labelled(label: str) -> Callable[[Column], Column]:
    return lambda p: p["label"] == label


def _parts(c: Column) -> tuple[Column, Column]:
    """The two sides of a slash."""
    return tuple(_some(F.trim(F.get(F.split(c, "/"), F.lit(i)))) for i in (0, 1))


def horse_profiles(pages: DataFrame, html: str, key: Sequence[str], as_of: Column) -> DataFrame:
    """One row per page: name, origin, age and year of birth, colour, sex, breeding, people, ratings and stakes.

    Active horses have origin and age in one row, retired ones an origin alone, and so no year of birth.
    """
    rows = F.flatten(F.transform(F.filter(tables(F.col(html)), lambda t: F.array_contains(t["classes"], "table_eng_text")), lambda t: F.transform(t["rows"], lambda r: F.transform(r, plain))))
    pairs = F.transform(F.filter(rows, lambda r: (F.size(r) >= 3) & (F.get(r, F.lit(1)) == ":")), lambda r: F.struct(_label(F.get(r, F.lit(0))).alias("label"), F.get(r, F.lit(2)).alias("value")))
    title = plain(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    df = pages.select(*key, pairs.alias("_pairs"), _some(F.get(F.split(title, " - "), F.lit(0))).alias("name"), as_of.alias("_as_of"))

    def bio(label: str) -> Column:
        return _some(F.try_element_at(F.filter("_pairs", lambda p: p["label"] == label), F.lit(-1))["value"])

    both = _parts(bio("countryoforiginage"))
    country, age = F.when(bio("countryoforiginage").isNotNull(), both[0]).otherwise(bio("countryoforigin")), first_int(both[1])
    colour, sex = _parts(bio("coloursex"))
    named = {"import_type": "importtype", "sire": "sire", "dam": "dam", "dams_sire": "damssire", "owner": "owner", "trainer": "trainer"}
    numbers = {"current_rating": "currentrating", "last_rating": "lastrating", "season_start_rating": "startofseasonrating", "season_stakes": "seasonstakes", "total_stakes": "totalstakes"}
    return df.select(
        *key, "name", country.alias("country_of_origin"), age.alias("age"), (F.year("_as_of") - age).alias("birth_year"), colour.alias("colour"), sex.alias("sex"),
        *(bio(v).alias(k) for k, v in named.items()), *(first_int(bio(v)).alias(k) for k, v in numbers.items()),
    )


def form_rows(pages: DataFrame, html: str, key: Sequence[str]) -> DataFrame:
    """Past runs of horse pages, in page order; season headings and spacers go."""
    rows = titled_rows(pages, html, key, FORM_TITLES, ("race_index", "pos"), css="bigborder").where(F.size("cells") >= 5)
    venue, track = _parts(text("course"))
    course = _some(F.regexp_replace(F.trim(F.coalesce(F.get(F.split(text("course"), "/"), F.lit(2)), F.lit(""))), '^"+|"+$', ""))
    out = rows.select(
        *key, "row_no", first_int(text("race_index")).alias("race_index"), first_int(text("pos")).alias("finish_pos"), text("pos").alias("finish_pos_raw"), day_of(text("date")).alias("run_date"), venue.alias("venue"), track.alias("track"), course.alias("course"),
        first_int(text("dist")).alias("distance_m"), _some(text("going")).alias("going"), _some(text("race_class")).alias("race_class"), first_int(text("draw")).alias("draw"), first_int(text("rating")).alias("rating"),
        linked_id(field("jockey"), "jockeyid").alias("jockey_code"), linked_id(field("trainer"), "trainerid").alias("trainer_code"), _some(text("lbw")).alias("lbw_raw"), whole_float(text("win_odds")).alias("win_odds"), first_int(text("act_wt")).alias("actual_weight"),
        _some(text("running")).alias("running_position_raw"), seconds(text("finish_time")).alias("finish_time_s"), first_int(text("declar_wt")).alias("declared_weight"), _some(text("gear")).alias("gear"),
    )
    return out.where("race_index IS NOT NULL OR finish_pos_raw <> ''")


def person_profiles(pages: DataFrame, html: str, key: Sequence[str]) -> DataFrame:
    """One row per jockey or trainer page: name, age, nationality, the season and the day its figures reach, and the figures."""
    every = tables(F.col(html))
    first, stats = F.get(every, F.lit(0)), _first(every, lambda t: F.array_contains(t["classes"], "table_bd"))
    df = pages.select(
        *key, F.flatten(F.transform(first["rows"], lambda r: F.transform(r, plain))).alias("_head"), F.transform(stats["rows"], lambda r: F.transform(r, plain)).alias("_rows")
    )
    heading = F.array_join(F.coalesce(F.get("_rows", F.lit(0)), F.array().cast("array<string>")), " ")
    pair = lambda r: F.transform(F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0))), lambda i: F.struct(_label(F.get(r, i)).alias("label"), F.coalesce(F.get(r, i + 1), F.lit("")).alias("value")))
    pairs = F.filter(F.flatten(F.transform(F.filter("_rows", lambda r: F.size(r) > 1), pair)), lambda p: (p["label"] != "") & p["value"].startswith(":"))
    df = df.withColumns({"_pairs": pairs, "_heading": heading})

    def stat(*labels: str) -> Column:
        found = (F.try_element_at(F.filter("_pairs", _labelled(x)), F.lit(-1))["value"] for x in labels)
        return F.coalesce(*(_some(F.trim(F.regexp_replace(v, "^:+", ""))) for v in found))

    figures = {"wins": ("noofwins",), "seconds": ("noof2nds",), "thirds": ("noof3rds",), "fourths": ("noof4ths",), "total_starts": ("totalrides", "totalrunners"), "stakes": ("stakeswon",), "wins_last10": ("noofwinsinpast10racedays",)}
    return df.select(
        *key, _some(F.get("_head", F.lit(0))).alias("name"), F.regexp_extract(F.array_join("_head", " "), r"Age:\s*(\d+)", 1).try_cast("int").alias("age"), stat("nationality").alias("nationality"),
        _some(F.regexp_extract("_heading", r"(\d{2}/\d{2})\s*Season", 1)).alias("season"), day_of(F.regexp_extract("_heading", r"Meeting of\s*(\d{2}/\d{2}/\d{4})", 1)).alias("up_to_date"),
        *(first_int(stat(*v)).alias(k) for k, v in figures.items()), whole_float(F.regexp_replace(stat("win"), "%+$", "")).alias("win_pct"),
    )
