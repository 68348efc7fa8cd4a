"""Small Column functions: parsing, rounding, scaling, display."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import rules

#: What is stripped from texts of facts: ASCII white space and the ideographic space.
SPACES = " \t\n\x0b\f\r　"
DIGITS, FULL_WIDTH = "0123456789", "０１２３４５６７８９"


def strip(c: Column) -> Column:
    """Without white space at either end, the ideographic space included."""
    return F.btrim(c, F.lit(SPACES))


def plain_number(text: Column) -> Column:
    """What is left of a stripped text without commas and underscores between digits, full-width digits as digits."""
    ascii_ = F.octet_length(text) == F.char_length(text)
    plain = F.when(ascii_, F.replace(text, F.lit(","), F.lit(""))).otherwise(F.translate(text, f"{FULL_WIDTH},", DIGITS))
    return F.when(text.contains("_"), F.regexp_replace(plain, r"(?<=\d)_(?=\d)", "")).otherwise(plain)


def number(plain: Column) -> Column:
    """The double, maybe infinite, that a plain text stands for; null if it has other signs than those of numbers, as a cast knows more words and
    suffixes than numbers have."""
    return F.when(plain.rlike(r"\A[0-9+.eE-]+\z"), plain.try_cast("double"))


def parse_number(text: Column) -> Column:
    """The double that a fact's text stands for; null if blank, not a number or not finite.

    Commas are dropped, full-width digits count as digits, and an underscore between digits is ignored.
    """
    return let(strip(text), lambda s: let(plain_number(s), lambda p: let(number(p), lambda n: F.when(F.abs(n) < float("inf"), n))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def local_name(tag: Column) -> Column:
    """What follows the last brace of a qualified name."""
    return F.substring_index(tag, "}", -1)


def bucket_of(low: Column, prior: str = "prioryear") -> Column:
    """P3 for a context in lower case."""
    plain = re.fullmatch(r"\w*", prior)
    when = F.when(low.contains(prior) if plain else low.rlike(prior), "previous_").when(low.contains("current"), "current_")
    return F.concat(when, F.when(low.contains("duration"), "duration").when(low.contains("instant"), "instant"))


def context_bucket(ref: Column, prior: str = "prioryear") -> Column:
    """The period that a context stands for, or null. prior is a pattern, so that callers may widen it."""
    return let(F.lower(ref), lambda low: bucket_of(low, prior))


def round2(x: Column) -> Column:
    """To two places by the exact binary value, halves to even, as records made in Python are rounded.

    The product with 100 is rounded itself, so what it lost is worked out (Dekker, 1971: either half of x times 100 is exact) and decides
    where the product lies right between two results.
    """

    def rounded(v: Column) -> Column:
        product, wide = v * 100, v * float((1 << 27) + 1)
        high = wide - (wide - v)
        lost = (high * 100 - product) + (v - high) * 100
        whole = F.floor(product).cast("double")
        rest = product - whole
        up = F.when((rest > 0.5) | ((rest == 0.5) & (lost > 0)), 1.0).when((rest == 0.5) & (lost == 0), F.abs(whole % 2)).otherwise(0.0)
        return F.when(F.abs(v) >= float(1 << 45), v).otherwise((whole + up) / 100)

    return let(x, rounded)


def round1(x: Column) -> Column:
    """To one place, halves up, as the web front end does."""
    return F.floor(x * 10 + 0.5) / 10


def pct(n: Column, d: Column) -> Column:
    """P5."""
    return round2(n / F.nullif(d, F.lit(0.0)) * 100)


def growth(now: Column, before: Column) -> Column:
    """P6."""
    return round2((now / F.nullif(before, F.lit(0.0)) - 1) * 100)


def finite(x: Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def scale(x: Column, low: float, high: float) -> Column:
    """Place of x between low and high, from 0 to 100; low may be the larger one."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (x - low) / (high - low) * 100))


def clamp(x: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))


def first_match(cases: list[tuple[Column, str]], otherwise: Column | str | None = None) -> Column:
    out = None
    for when, then in cases:
        out = F.when(when, then) if out is None else out.when(when, then)
    return out if otherwise is None else out.otherwise(otherwise)


def rating(score: Column) -> Column:
    """P14."""
    return first_match([(score >= least, name) for least, name in rules.RATINGS], rules.LOWEST_RATING)


def band(score: Column, available: Column) -> Column:
    """Colour band of a score."""
    return first_match([(~available, "unknown")] + [(score >= least, name) for least, name in rules.BANDS], "low")


def tidy(x: Column, places: int) -> Column:
    """A number rounded halves up, with thousands separators and at most so many places."""
    ten = 10**places
    text = F.format_number(F.floor(x * ten + 0.5) / ten, places)
    return F.regexp_replace(text, r"\.?0+$", "") if places else text


def value_text(value: Column, unit: str) -> Column:
    """Value and unit, a plus before a positive amount of money, a dash for none."""
    plus = F.when(value > 0, "+").otherwise("") if unit == "億円" else F.lit("")
    return F.coalesce(F.concat(plus, tidy(value, 1), F.lit(unit)), F.lit("—"))


def delta_text(value: Column, previous: Column, unit: str, label: Column | str = rules.YEAR_LABEL) -> Column:
    """Difference from the previous value; points for percentages."""
    d = value - previous
    sign = F.when(d > 0, "+").otherwise("")
    none = F.concat(label if isinstance(label, Column) else F.lit(label), F.lit("なし"))
    return F.coalesce(F.concat(sign, tidy(d, 1), F.lit("pt" if unit == "%" else unit)), none)


def percent_text(x: Column) -> Column:
    return F.coalesce(F.concat(F.when(x > 0, "+").otherwise(""), tidy(x, 2), F.lit("%")), F.lit("前日比なし"))


def volume_text(x: Column) -> Column:
    """Shares in hundred millions, ten thousands or ones."""
    many = F.when(x >= 1e8, F.concat(tidy(x / 1e8, 1), F.lit("億株"))).when(x >= 1e4, F.concat(tidy(x / 1e4, 1), F.lit("万株"))).otherwise(F.concat(F.format_number(F.floor(x + 0.5), 0), F.lit("株")))
    return F.coalesce(many, F.lit("出来高なし"))


def yen_text(x: Column) -> Column:
    return F.concat(F.lit("￥"), F.when(x < 100, tidy(x, 1)).otherwise(tidy(x, 0)))


def direction(delta: Column, dead: float = 0.05) -> Column:
    """Up, down or flat."""
    return F.when(delta > dead, "up").when(delta < -dead, "down").otherwise("flat")
