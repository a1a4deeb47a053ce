"""Bengali numbers and dates inside text, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import bengali

#: Spellings besides the number table's own; fixed values.
VARIANTS = {"ছয়": 6, "নয়": 9, "কুড়ি": 20, "কুড়ি": 20, "পয়ত্রিশ": 35, "পঁয়ত্রিশ": 35, "পয়তাল্লিশ": 45, "পঁয়তাল্লিশ": 45, "পয়ষট্টি": 65, "পঁয়ষট্টি": 65, "আটাশি": 88}
#: Units of number words; fixed values.
UNITS = {"শত": 100, "শো": 100, "হাজার": 1_000, "লাখ": 100_000, "লক্ষ": 100_000, "কোটি": 10_000_000}
MINUS = ("ঋণাত্মক", "মাইনাস")
POINT = "দশমিক"
#: Gregorian months in Bengali and English; fixed values.
GREGORIAN_BN = "জানুয়ারি ফেব্রুয়ারি মার্চ এপ্রিল মে জুন জুলাই আগস্ট সেপ্টেম্বর অক্টোবর নভেম্বর ডিসেম্বর".split()
GREGORIAN_EN = "january february march april may june july august september october november december".split()
#: Latin names of the months of the Bengali year; fixed values.
MONTHS_LATIN = "Baishakh Jaishtha Ashadha Shravana Bhadra Ashwin Kartik Agrahayana Pausha Magha Phalguna Chaitra".split()
_SPACE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\x1C-\\x1F\\x85]"
_DIGIT = "[০-৯0-9]"


def _integer_words(digits: Column) -> Column:
    return bengali.number_words(digits.cast("decimal(38,0)").cast("long"))


def any_number_words(value: Column) -> Column:
    """Words of a number written in either script: a leading minus and a decimal part (digit by digit) are read; empty for anything else.

    Whole parts below 10^14.
    """
    s = bengali.to_ascii_digits(F.trim(value.cast("string")))
    negative = s.startswith("-")
    s = F.when(negative, F.trim(F.substring(s, 2, 1 << 30))).otherwise(s)
    whole = F.regexp_extract(s, "^\\+?([0-9]*)", 1)
    dotted = F.contains(s, F.lit("."))
    whole = F.when(dotted & (whole == ""), F.lit("0")).otherwise(whole)
    fits = F.length(F.regexp_replace(whole, "^0+", "")) <= 14
    valid = F.when(dotted, s.rlike("^\\+?[0-9]*\\.")).otherwise(s.rlike("^\\+?[0-9]+$")) & fits
    table = F.array(*[F.lit(w) for w in bengali.NUMBERS])
    tail = F.regexp_replace(F.regexp_extract(s, "\\.(.*)$", 1), "[^0-9]", "")
    digits = F.transform(F.filter(F.split(tail, ""), lambda d: d != ""), lambda d: F.element_at(table, d.cast("int") + 1))
    words = _integer_words(F.when(fits, whole))
    words = F.when(dotted, F.concat(words, F.lit(f" {POINT} "), F.array_join(digits, " "))).otherwise(words)
    return F.when(valid, F.when(negative, F.concat(F.lit(f"{MINUS[0]} "), words)).otherwise(words)).otherwise(F.lit(""))


def words_number(text: Column) -> Column:
    """Integer behind number words: a fold over tokens that adds small numbers and closes at each unit; unknown tokens are passed over.

    A hundred multiplies what stands before it, higher units close it as well. Null for blank text. Within a 64-bit integer.
    """
    s = F.regexp_replace(F.regexp_replace(text, f"^{_SPACE}+", ""), f"{_SPACE}+$", "")
    negative = s.startswith(MINUS[0]) | s.startswith(MINUS[1])
    s = F.regexp_replace(s, f"^(?:{'|'.join(MINUS)}){_SPACE}*", "")
    known = {w: i for i, w in enumerate(bengali.NUMBERS)} | VARIANTS
    small = F.create_map(*[F.lit(x) for w, n in known.items() for x in (w, n)])
    unit = F.create_map(*[F.lit(x) for w, n in UNITS.items() for x in (w, n)])
    zero = F.lit(0).cast("long")

    def step(acc: Column, token: Column) -> Column:
        n, u = F.element_at(small, token).cast("long"), F.element_at(unit, token).cast("long")
        scaled = F.when(acc["open"] != 0, acc["open"]).otherwise(F.lit(1)) * u
        closes = u.isNotNull() & (u > 100)
        opened = F.when(n.isNotNull(), acc["open"] + n).when(closes, zero).when(u.isNotNull(), scaled).otherwise(acc["open"])
        return F.struct(F.when(closes, acc["done"] + scaled).otherwise(acc["done"]).alias("done"), opened.alias("open"))

    end = F.aggregate(F.filter(F.split(s, f"{_SPACE}+"), lambda t: t != ""), F.struct(zero.alias("done"), zero.alias("open")), step, lambda a: a["done"] + a["open"])
    return F.when(text.rlike(f"[^{_SPACE[1:]}"), F.when(negative, -end).otherwise(end))


def _rewrite(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """text with each match of a pattern changed; a null change leaves the match."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.concat(F.element_at(gaps, 1), F.array_join(F.transform(found, lambda m, i: F.concat(F.coalesce(change(m), m), F.element_at(gaps, i + 2))), ""))


def _first_of(names: list[str], text: Column) -> Column:
    """Number (from 1) of the first name that text contains; null for none."""
    out = F.lit(None).cast("int")
    for i in range(len(names), 0, -1):
        out = F.when(F.contains(text, F.lit(names[i - 1])), i).otherwise(out)
    return out


_GREGORIAN = f"({_DIGIT}{{1,2}}){_SPACE}+([a-zA-Z\\u0980-\\u09FF]+)[,\\s]+({_DIGIT}{{4}})"
_BANGABDA = f"({_DIGIT}{{1,2}}){_SPACE}+([^\\s,]+)[,\\s]+({_DIGIT}{{4}}){_SPACE}*(?:বঙ্গাব্দ)?"


def _month_of_bangabda(name: Column) -> Column:
    return _first_of(bengali.MONTHS, F.replace(F.replace(name, F.lit("বঙ্গাব্দ"), F.lit("")), F.lit("আষাঢ়"), F.lit(bengali.MONTHS[2])))


def dates_to_bangabda(text: Column) -> Column:
    """Gregorian dates of a text (day, month name in either language, year) in the Bengali calendar; dates that do not exist stay."""

    def parts(m: Column) -> Column:
        day, name, year = (F.regexp_extract(m, _GREGORIAN, g) for g in (1, 2, 3))
        return F.struct(bengali.to_ascii_digits(day).alias("d"), F.least(_first_of(GREGORIAN_EN, F.lower(name)), _first_of(GREGORIAN_BN, name)).alias("m"), bengali.to_ascii_digits(year).alias("y"))

    said = lambda b: F.concat(bengali.to_bengali_digits(b["day"].cast("string")), F.lit(" "), b["month_name"], F.lit(" "), bengali.to_bengali_digits(b["year"].cast("string")), F.lit(" বঙ্গাব্দ"))
    calendar = lambda when: F.when(when.isNotNull(), bengali.bind(bengali.bangabda(when), said))
    day_of = lambda p: F.try_to_date(F.concat_ws("-", p["y"], F.lpad(p["m"].cast("string"), 2, "0"), F.lpad(p["d"], 2, "0")))
    change = lambda m: bengali.bind(parts(m), lambda p: F.when(p["m"].isNotNull(), bengali.bind(day_of(p), calendar)))
    return _rewrite(F.coalesce(text, F.lit("")), _GREGORIAN, change)


def dates_to_gregorian(text: Column) -> Column:
    """Dates of the Bengali calendar in a text as Gregorian dates; those without a known month stay."""

    def parts(m: Column) -> Column:
        day, name, year = (F.regexp_extract(m, _BANGABDA, g) for g in (1, 2, 3))
        return F.struct(bengali.to_ascii_digits(day).cast("int").alias("d"), _month_of_bangabda(name).alias("m"), bengali.to_ascii_digits(year).cast("int").alias("y"))

    names = F.array(*[F.lit(x) for x in GREGORIAN_BN])
    said = lambda when: F.concat_ws(" ", bengali.to_bengali_digits(F.dayofmonth(when).cast("string")), F.element_at(names, F.coalesce(F.month(when), F.lit(1))), bengali.to_bengali_digits(F.year(when).cast("string")), F.lit("খ্রিষ্টাব্দ"))
    change = lambda m: bengali.bind(parts(m), lambda p: F.when(p["m"].isNotNull(), bengali.bind(bengali.gregorian(p["d"], p["m"], p["y"]), said)))
    return _rewrite(F.coalesce(text, F.lit("")), _BANGABDA, change)


def approximate_gregorian(text: Column) -> Column:
    """'day month, year CE (Approx)' of the first Bengali date: the year is 594 on from the tenth month, else 593; without a known month the year alone."""
    pattern = f"({_DIGIT}+)\\s*([^\\s,]+)[,\\s]+({_DIGIT}{{4}})"
    day, name, year = (F.regexp_extract(text, pattern, g) for g in (1, 2, 3))
    month = _month_of_bangabda(name)
    year = bengali.to_ascii_digits(year).cast("int")
    latin = F.when(month.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in MONTHS_LATIN]), F.coalesce(month, F.lit(1))))
    said = F.concat(bengali.to_ascii_digits(day).cast("long").cast("string"), F.lit(" "), latin, F.lit(", "), (year + F.when(month >= 10, 594).otherwise(593)).cast("string"), F.lit(" CE (Approx)"))
    return F.when(text.rlike(pattern), F.coalesce(said, F.concat((year + 593).cast("string"), F.lit(" CE (Approx)"))))
