"""Bengali script, digits, number words and calendar as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "০১২৩৪৫৬৭৮৯"

#: Number words 0 to 99; fixed values.
NUMBERS = (
    "শূন্য এক দুই তিন চার পাঁচ ছয় সাত আট নয় দশ এগারো বারো তেরো চৌদ্দ পনেরো ষোলো সতেরো আঠারো উনিশ বিশ একুশ বাইশ তেইশ চব্বিশ পঁচিশ ছাব্বিশ সাতাশ আটাশ ঊনত্রিশ "
    "ত্রিশ একত্রিশ বত্রিশ তেত্রিশ চৌত্রিশ পঁয়ত্রিশ ছত্রিশ সাঁইত্রিশ আটত্রিশ ঊনচল্লিশ চল্লিশ একচল্লিশ বিয়াল্লিশ তেতাল্লিশ চুয়াল্লিশ পঁয়তাল্লিশ ছেচল্লিশ সাতচল্লিশ আটচল্লিশ ঊনপঞ্চাশ "
    "পঞ্চাশ একান্ন বায়ান্ন তিপ্পান্ন চুয়ান্ন পঞ্চান্ন ছাপ্পান্ন সাতান্ন আটান্ন ঊনষাট ষাট একষট্টি বাষট্টি তেষট্টি চৌষট্টি পঁয়ষট্টি ছেষট্টি সাতষট্টি আটষট্টি ঊনসত্তর "
    "সত্তর একাত্তর বাহাত্তর তিয়াত্তর চুয়াত্তর পঁচাত্তর ছিয়াত্তর সাতাত্তর আঠাত্তর ঊনআশি আশি একাশি বিরাশি তিরাশি চৌরাশি পঁচাশি ছিয়াশি সাতাশি অষ্টআশি ঊননব্বই "
    "নব্বই একানব্বই বিরানব্বই তিরানব্বই চুরানব্বই পঁচানব্বই ছিয়ানব্বই সাতানব্বই আটানব্বই নিরানব্বই"
).split()

#: Months of the calendar and the day of the year on which each begins; fixed values.
MONTHS = "বৈশাখ জ্যৈষ্ঠ আষাঢ় শ্রাবণ ভাদ্র আশ্বিন কার্তিক অগ্রহায়ণ পৌষ মাঘ ফাল্গুন চৈত্র".split()
MONTH_DAYS = [31] * 5 + [30] * 7


def to_bengali_digits(c: Column) -> Column:
    return F.translate(c, "0123456789", DIGITS)


def to_ascii_digits(c: Column) -> Column:
    return F.translate(c, DIGITS, "0123456789")


def leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def bangabda(date: Column) -> Column:
    """struct(day, month, month_name, year) of a Gregorian date.

    The year begins on 14 April; Falgun (month 11) has 31 days when the Gregorian year in which the
    Bengali year began is leap, and days past the last month stay in it.
    """
    start_year = F.year(date) - F.when(date < F.make_date(F.year(date), F.lit(4), F.lit(14)), 1).otherwise(0)
    offset = F.datediff(date, F.make_date(start_year, F.lit(4), F.lit(14)))
    long_falgun = F.when(leap(start_year), 1).otherwise(0)
    begins, at = [], F.lit(0)
    for m, days in enumerate(MONTH_DAYS):
        begins.append(at)
        at = at + days + (long_falgun if m == 10 else 0)
    month, first = F.lit(1), F.lit(0)
    for m, b in enumerate(begins[1:], 2):
        month, first = F.when(offset >= b, m).otherwise(month), F.when(offset >= b, b).otherwise(first)
    return F.struct(
        (offset - first + 1).cast("long").alias("day"), month.cast("long").alias("month"),
        F.element_at(F.array(*[F.lit(x) for x in MONTHS]), month).alias("month_name"), (start_year - 593).cast("long").alias("year"),
    )


def gregorian(day: Column, month: Column, year: Column) -> Column:
    """Date of a Bengali day, month (1-12) and year."""
    start = F.make_date((year + 593).cast("int"), F.lit(4), F.lit(14))
    shift = F.lit(0)
    for m in range(1, 12):
        extra = F.when(leap(year + 593), 1).otherwise(0) if m == 11 else F.lit(0)
        shift = shift + F.when(month > m, F.lit(MONTH_DAYS[m - 1]) + extra).otherwise(0)
    return F.date_add(start, (shift + day - 1).cast("int"))


def number_words(n: Column) -> Column:
    """Words of an integer from 0 to below 10^14 (crores are themselves written in words); empty outside."""
    table = F.array(*[F.lit(x) for x in NUMBERS])
    word = lambda c: F.element_at(table, (c + 1).cast("int"))

    def below_crore(n: Column) -> Column:
        parts = []
        for unit, size, span in (("লাখ", 100_000, 100), ("হাজার", 1_000, 100), ("শত", 100, 10)):
            q = F.floor(n / F.lit(size)) % span
            parts.append(F.when(q > 0, F.concat(word(q), F.lit(f" {unit}"))))
        parts.append(F.when(n % 100 > 0, word(n % 100)))
        return F.concat_ws(" ", *parts)

    crores = F.floor(n / F.lit(10_000_000))
    head = F.when(crores > 0, F.concat(below_crore(crores), F.lit(" কোটি")))
    rest = F.when(n % 10_000_000 > 0, below_crore(n % 10_000_000))
    return F.when(n == 0, F.lit(NUMBERS[0])).when((n > 0) & (n < 10**14), F.concat_ws(" ", head, rest)).otherwise(F.lit(""))


_W = "[^ \\t\\n\\x0B\\f\\r]"


def bind(c: Column, f) -> Column:
    """f of a column that is evaluated once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def script_counts(c: Column) -> Column:
    """struct(bn, en, other) of words: a word of both scripts counts half for each. Four counts over the whole text."""
    n = lambda rx: F.coalesce(F.regexp_count(c, F.lit(rx)), F.lit(0)).cast("double")
    bn, en = "[\\u0980-\\u09FF]", "[A-Za-z]"
    raw = F.struct(n(f"{_W}++").alias("n"), n(f"{_W}*{bn}{_W}*+").alias("b"), n(f"{_W}*{en}{_W}*+").alias("e"), F.when(c.rlike(bn), n(f"(?={_W}*{bn}){_W}*{en}{_W}*+")).otherwise(0.0).alias("m"))
    return bind(raw, lambda r: F.struct((r["b"] - r["m"] / 2).alias("bn"), (r["e"] - r["m"] / 2).alias("en"), (r["n"] - r["b"] - r["e"] + r["m"]).alias("other")))


def ratio(counts: Column) -> Column:
    """struct(bn, en, other): bn and en as shares of words with a script, other of all words; text without a word is other."""
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return bind(counts, lambda r: F.struct(
        share(r["bn"], r["bn"] + r["en"]).alias("bn"), share(r["en"], r["bn"] + r["en"]).alias("en"),
        F.when(r["bn"] + r["en"] + r["other"] > 0, r["other"] / (r["bn"] + r["en"] + r["other"])).otherwise(1.0).alias("other"),
    ))


def sentence_class(r: Column) -> Column:
    """en for a neutral text, bn or en from 0.8 up, else mixed."""
    return bind(r, lambda x: F.when((x["bn"] == 0) & (x["en"] == 0), "en").when(x["bn"] >= 0.8, "bn").when(x["en"] >= 0.8, "en").otherwise("mixed"))
