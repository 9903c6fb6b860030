"""Scalar functions on columns: parsing of raw tokens, calendar labels, keys. All are native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beaten-length words and their lengths.
LENGTH_WORDS = {
    "": 0.0, "-": 0.0, "---": 0.0, "NOSE": 0.02, "NSE": 0.02, "SHD": 0.05, "SH": 0.05, "HD": 0.1, "HEAD": 0.1,
    "NK": 0.3, "NECK": 0.3, "N": 0.3, "DH": 0.0, "DIST": 30.0,
}
#: Fraction signs.
FRACTIONS = {"¼": 0.25, "½": 0.5, "¾": 0.75}
#: Paid places by the least field that pays them.
PLACE_RULES = ((7, 3), (5, 2), (1, 0))


def lengths(raw: Column) -> Column:
    """Beaten lengths of a token: a word, or a whole number, a fraction or both, such as ``1-1/2``; null if it is none."""
    token = F.trim(F.regexp_replace(F.upper(raw), "[\\s\u00a0]+", " "))
    grammar = r"^(?:(\d+)(?![\d/ ]*/)|(\d+)[ -]+(?=\d+ ?/))?[ -]*(?:(\d+) ?/ ?(\d+)|([¼½¾]))?$"
    found = [F.regexp_extract(token, grammar, i) for i in range(1, 6)]
    whole, behind, over, under = (x.try_cast("double") for x in found[:4])
    part = F.element_at(F.create_map(*(F.lit(x) for kv in LENGTH_WORDS.items() for x in kv)), token)
    sign = sum((F.when(found[4] == k, v).otherwise(0.0) for k, v in FRACTIONS.items()), F.lit(0.0))
    number = F.coalesce(whole, behind, F.lit(0.0)) + F.coalesce(F.try_divide(over, under), F.lit(0.0)) + sign
    fits = token.rlike(grammar) & token.rlike(r"[\d¼½¾]") & ~F.coalesce(under == 0, F.lit(False))
    return F.coalesce(part, F.when(fits, number))


def season_label(day: Column) -> Column:
    """Season from September to August as ``2025-26``."""
    first = F.year(day) - (F.month(day) < 9).cast("int")
    return F.concat(first.cast("string"), F.lit("-"), F.lpad(F.pmod(first + 1, F.lit(100)).cast("string"), 2, "0"))


def paid_places(field: Column, rules: Sequence[tuple[int, int]] = PLACE_RULES) -> Column:
    """Paid places of a field: those of the largest rule that it reaches, else none."""
    out = F.lit(0)
    for least, places in sorted(rules):
        out = F.when(field >= least, F.lit(places)).otherwise(out)
    return out


def rail_offset(raw: Column) -> Column:
    """The signed whole number in a rail token; 0 if it has none."""
    return F.coalesce(F.regexp_extract(raw, r"([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def class_ord(raw: Column, unknown: float | None = None, group: float = 0.5) -> Column:
    """Class as a number, lower for better company: ``Class 3`` is 3, a group race 0.5, a griffin race 4.5."""
    number = F.regexp_extract(raw, r"^Class\s+(\d)", 1).try_cast("double")
    rest = F.when(raw.rlike("(?i)group"), F.lit(group)).when(raw.rlike("(?i)griffin"), F.lit(4.5)).otherwise(F.lit(unknown).cast("double"))
    return F.coalesce(number, rest)


def clean_text(raw: Column) -> Column:
    """White space, no-break spaces included, as single spaces, trimmed."""
    return F.trim(F.regexp_replace(raw, "[\\s\u00a0]+", " "))


def first_int(raw: Column) -> Column:
    """The first whole number of a text, thousands commas left out; null if none."""
    return F.regexp_extract(F.replace(raw, F.lit(","), F.lit("")), r"(-?\d+)", 1).try_cast("int")


def whole_float(raw: Column) -> Column:
    """A text that is a number, commas left out; null otherwise."""
    return F.trim(F.replace(raw, F.lit(","), F.lit(""))).try_cast("double")


def seconds(raw: Column) -> Column:
    """Seconds of ``1:38.85``, ``58.5`` or ``1.38.85``; null otherwise."""
    t = F.trim(raw)
    minutes = F.regexp_extract(t, r"^(\d+)[:.](\d{1,2})\.(\d+)$", 1).try_cast("double")
    rest = F.concat(F.regexp_extract(t, r"^\d+[:.](\d{1,2})\.\d+$", 1), F.lit("."), F.regexp_extract(t, r"^\d+[:.]\d{1,2}\.(\d+)$", 1)).try_cast("double")
    plain = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)$", 1).try_cast("double")
    return F.coalesce(minutes * 60 + rest, plain)


def day_of(raw: Column) -> Column:
    """A date of ``31/12/2024``, ``31/12/24`` (2000 on) or ``2024/12/31``; null otherwise."""
    t = F.trim(raw)
    year = F.regexp_extract(t, r"^\d{1,2}/\d{1,2}/(\d{2}|\d{4})$", 1).try_cast("int")
    dmy = F.make_date(F.when(year < 100, year + 2000).otherwise(year), F.regexp_extract(t, r"^\d{1,2}/(\d{1,2})/", 1).try_cast("int"), F.regexp_extract(t, r"^(\d{1,2})/", 1).try_cast("int"))
    ymd = F.try_to_timestamp(t, F.lit("yyyy/M/d")).cast("date")
    ok = t.rlike(r"^\d{1,2}/\d{1,2}/(\d{2}|\d{4})$")
    return F.when(ok, dmy).otherwise(F.when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), ymd))


def going_ord(raw: Column, order: Sequence[str]) -> Column:
    """Place of a ground state in an order from firm to heavy; null if it isn't there."""
    steps = F.create_map(*(x for i, s in enumerate(order) for x in (F.lit(s), F.lit(float(i)))))
    return F.element_at(steps, F.upper(F.trim(raw)))


def surface_of(location: Column) -> Column:
    """Turf or all-weather by the words of a location."""
    up = F.upper(location)
    return F.when(up.contains("ALL WEATHER") | up.contains("DIRT") | up.contains("AWT"), "AWT").when(location.isNotNull(), "TURF")


#: Venues by the words that name them.
VENUE_WORDS = {"happy valley": "HV", "sha tin": "ST"}


def venue_of(location: Column) -> Column:
    """The venue that a location names; null if none."""
    low, out = F.lower(location), F.lit(None).cast("string")
    for words, code in reversed(VENUE_WORDS.items()):
        out = F.when(low.contains(words), code).otherwise(out)
    return out


def track_of(location: Column) -> Column:
    """ALL WEATHER TRACK or TURF where a location says so; null otherwise."""
    up = F.upper(location)
    return F.when(up.contains("ALL WEATHER") | up.contains("AWT"), "ALL WEATHER TRACK").when(up.contains("TURF"), "TURF")


def is_turf(surface: Column) -> Column:
    """1 if a surface's name has turf in it, 0 if not, null without one."""
    return F.upper(surface).contains("TURF").cast("int")


def course_token(raw: Column) -> Column:
    """The course letters inside quotes, such as ``C+3``; null if none."""
    found = F.regexp_extract(raw, r"[\"“']([A-C](?:\s*\+\s*\d)?)[\"”']", 1)
    return F.when(found != "", F.replace(found, F.lit(" "), F.lit("")))


def combination_pair(raw: Column) -> Column:
    """``2,8`` as a sorted array of two numbers; null if it isn't two."""
    parts = F.array_sort(F.transform(F.split(raw, ","), lambda x: F.trim(x).try_cast("int")))
    return F.when((F.size(parts) == 2) & ~F.exists(parts, lambda x: x.isNull()), parts)


def entity_id(url: Column, name: str) -> Column:
    """The value of a query parameter of a link, whatever its case; null if missing."""
    found = F.regexp_extract(url, rf"(?i)[?&]{name}=([^&#]+)", 1)
    return F.when(found != "", found)


def key_string(*cols: Column) -> Column:
    return F.concat_ws("-", *(c.cast("string") for c in cols))


def valid_horse_id(raw: Column) -> Column:
    return raw.rlike(r"^HK_\d{4}_[A-Z0-9]{4}$")


def valid_race_no(no: Column) -> Column:
    return no.between(1, 14)


def noise(*keys: Column, cells: int = 1_000_000) -> Column:
    """A number in [0, 1) that follows from the keys alone: a canary feature, which must have no effect."""
    whole = F.conv(F.substring(F.md5(F.concat_ws("-", *(k.cast("string") for k in keys))), 1, 8), 16, 10).cast("long")
    return F.pmod(whole, F.lit(cells)) / F.lit(float(cells))


def last_position(raw: Column) -> Column:
    """The last number of a list of running positions such as ``3 4 1``."""
    return F.element_at(F.split(F.trim(raw), r"\s+"), -1).try_cast("int")


def early_position(raw: Column) -> Column:
    """The mean of the first third, one at least, of a list of running positions."""
    parts = F.split(F.trim(raw), r"\s+")
    head = F.transform(F.slice(parts, 1, F.greatest(F.lit(1), F.floor(F.size(parts) / 3).cast("int"))), lambda x: x.try_cast("double"))
    return F.aggregate(head, F.lit(0.0), lambda s, x: s + x) / F.size(head)


def trial_failed(result: Column) -> Column:
    return F.coalesce(result, F.lit("")).rlike("(?i)fail|required").cast("double")


def trial_easy(comment: Column) -> Column:
    return F.coalesce(comment, F.lit("")).rlike(r"(?i)\b(easily|impressive|comfortabl|strongly|well in hand)")


def local_time(ts: Column, zone: str = "Asia/Hong_Kong") -> Column:
    return F.from_utc_timestamp(ts, zone)
