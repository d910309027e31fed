"""Column functions on review text, star cells and date cells. Java's \\s and \\w are ASCII without (?U)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]")
_TOKEN = re.compile(r"[a-z0-9'-]+", re.ASCII)

#: Units of an Excel serial day, as numbers that may be one, and the day that is 0.
SERIAL_FROM, SERIAL_TO, SERIAL_EPOCH = 20000, 200000, "1899-12-30"
#: Text dates that are understood, in this order.
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"]
#: Words for numbers of stars, and for whole verdicts.
STAR_WORDS = {"一": 1.0, "二": 2.0, "三": 3.0, "四": 4.0, "五": 5.0}
VERDICTS = {"差评": 1.0, "中评": 3.0, "好评": 5.0}
YES, NO, UNKNOWN = "是", "否", "无"


def quoted(text: str) -> str:
    """A Java pattern that matches just this text."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-#&~])", r"\\\1", text)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression named in a lambda is computed at each call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Removes white space of any script at both ends; F.trim knows the plain space only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def merge_columns(columns: list[Column]) -> Column:
    """The texts of several columns in one, each stripped, joined by a space; null counts as empty."""
    filled = [F.when(strip(c) != "", strip(c)) for c in columns]
    return F.concat_ws(" ", *filled)


def content_first(content: Column, title: Column) -> Column:
    """The content, or the title where there is none."""
    body = strip(F.coalesce(content, F.lit("")))
    return F.when(body != "", body).otherwise(strip(F.coalesce(title, F.lit(""))))


def phrase_steps(phrases: dict[str, str], native: dict[str, str] | None = None) -> list[tuple[str, str, bool]]:
    """(source, target, whole word?) in order of use: the native map, then keys with CJK characters, then the others.

    Within each, long sources come first. A single Latin token is replaced as a whole word, all else anywhere.
    """
    cjk = {k: v for k, v in phrases.items() if _CJK.search(k)}
    steps = []
    for table in (native or {}, cjk, {k: v for k, v in phrases.items() if k not in cjk}):
        for source, target in sorted(table.items(), key=lambda x: -len(x[0])):
            source, target = source.strip().lower(), target.strip()
            if source and target:
                steps.append((source, target, " " not in source and bool(_TOKEN.fullmatch(source))))
    return steps


def clean_text(text: Column, steps: list[tuple[str, str, bool]] = (), prefix: str | None = None) -> Column:
    """Lower case, phrases replaced, the prefix removed, white space collapsed and stripped. Null becomes empty."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for source, target, whole in steps:
        if whole:
            out = F.regexp_replace(out, rf"(?U)(?<!\w){quoted(source)}(?!\w)", target.replace("\\", r"\\").replace("$", r"\$"))
        else:
            out = F.replace(out, F.lit(source), F.lit(target))
    if prefix:
        out = F.regexp_replace(out, f"(?iu){prefix}", "")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def is_blank(text: Column) -> Column:
    """Nothing but white space and the punctuation of an empty review."""
    return text.isNull() | text.rlike(r"(?U)^[。，,\s]*$")


def star_of(cell: Column) -> Column:
    """Stars in a cell: a number, star signs, a word for a number, or a verdict; else null."""
    text = F.lower(strip(cell.cast("string")))
    count = lambda sign: F.char_length(text) - F.char_length(F.replace(text, F.lit(sign), F.lit("")))
    word = F.regexp_extract(text, f"([{''.join(STAR_WORDS)}])星", 1)
    out = F.when((text == "") | (text == "nan"), None)
    out = out.when(text.rlike(r"\d"), F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double"))
    for sign in ("⭐", "*"):
        out = out.when(F.contains(text, F.lit(sign)), count(sign).cast("double"))
    for k, v in STAR_WORDS.items():
        out = out.when(word == k, v)
    for k, v in VERDICTS.items():
        out = out.when(F.contains(text, F.lit(k)), v)
    return out


def bad_by_star(cell: Column, most: float) -> Column:
    """Whether a review is bad by its stars: yes, no, or unknown where the cell has none."""
    star = star_of(cell)
    return F.when(star.isNull(), UNKNOWN).when(star <= most, YES).otherwise(NO)


def date_of(cell: Column) -> Column:
    """The day of a date cell as text: a date, yyyymmdd, an Excel serial day, year-month-day signs or a usual format.

    Anything else, null too, gives an empty text. Text dates are those of DATE_FORMATS.
    """
    text = strip(cell.cast("string"))
    number = F.when(text.rlike(r"^\d+\.?\d*$"), text.try_cast("double"))
    compact = F.when(number.between(19000101, 21001231) & (number == F.floor(number)), F.try_to_timestamp(number.cast("long").cast("string"), F.lit("yyyyMMdd")))
    serial = F.when((number > SERIAL_FROM) & (number < SERIAL_TO), F.date_add(F.to_date(F.lit(SERIAL_EPOCH)), F.floor(number).cast("int")))
    parts = [F.regexp_extract(text, r"(?U)(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})", i) for i in (1, 2, 3)]
    signs = F.when(parts[0] != "", F.try_to_timestamp(F.concat_ws("-", *parts), F.lit("yyyy-M-d")))
    usual = [F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
    day = F.coalesce(*[x.cast("date") for x in (compact, serial, signs, *usual)])
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


def cut_tags(cell: Column) -> Column:
    """The tags of a cell with several: cut at slashes and bars, stripped, without blanks and nan."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), r"[/｜|]+"), strip)
    return F.filter(parts, lambda x: (x != "") & (F.lower(x) != "nan"))


def heights_cm(text: Column) -> Column:
    """Heights in a text in centimetres: cm, feet, and feet with inches."""
    cm = F.transform(F.regexp_extract_all(text, F.lit(r"(?iU)(\d+(?:\.\d+)?)\s*(?:cm|厘米)"), 1), lambda x: x.cast("double"))
    feet = F.transform(F.regexp_extract_all(text, F.lit(r"(?iU)(\d+(?:\.\d+)?)\s*(?:ft|feet|foot|英尺)"), 1), lambda x: x.cast("double") * 30.48)
    both = r"(?iU)(\d+)\s*(?:英尺|ft|')\s*(\d{1,2})"
    whole, inches = (F.regexp_extract_all(text, F.lit(both), i) for i in (1, 2))
    mixed = F.zip_with(whole, inches, lambda a, b: a.cast("double") * 30.48 + b.cast("double") * 2.54)
    return F.concat(cm, feet, mixed)


def height_label(text: Column, expected: float, tolerance: float, small: str, large: str, fine: str, hint: str) -> Column:
    """A label for the greatest height in a text against the expected one; without any, `small` if the hint is there."""
    most = F.array_max(heights_cm(text))
    out = F.when(most < expected - tolerance, small).when(most > expected + tolerance, large).when(most.isNotNull(), fine)
    return out.when(text.rlike(hint), small)


def length_cm(cell: Column) -> Column:
    """A configured length in centimetres: cm, m, feet, or a bare number."""
    text = F.lower(strip(cell.cast("string")))
    number = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(text.rlike("cm|厘米"), number).when(F.contains(text, F.lit("m")), number * 100).when(text.rlike("ft|feet|foot|英尺"), number * 30.48).otherwise(number)


def shorten(text: Column, most: int = 50) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
