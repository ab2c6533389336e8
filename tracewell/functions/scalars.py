"""Column helpers: exact rounding, cost, buckets, display formats, text matching."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.constants import FLAT_RATE, MESSAGE_BUCKETS, MODEL_RATES, PROMPT_BUCKETS

NANO_PER_CENT = 10_000_000

MESSAGE_LABELS = ("abandoned", "short", "medium", "long")
MESSAGE_LABELS_LONG = ("abandoned (1-3 msgs)", "short (4-10 msgs)", "medium (11-30 msgs)", "long (30+ msgs)")
PROMPT_LABELS = ("short", "medium", "detailed")
PROMPT_LABELS_LONG = ("short (<50 chars)", "medium (50-200)", "detailed (200+)")


def int_div(num: Column, den: Column) -> Column:
    return F.call_function("div", num, den)


def ratio_round(num: Column, den: Column, digits: int = 0, percent: bool = False) -> Column:
    """num / den (times 100 for a percentage) rounded half away from zero, as double.

    NULL where den is 0 or NULL. Whole numbers throughout, so a tie is a tie
    and does not depend on how the quotient falls in binary.
    """
    scale = 10 ** (digits + (2 if percent else 0))
    top = F.abs(num.cast("decimal(30,0)")) * F.lit(2 * scale)
    bottom = F.abs(F.nullif(den, F.lit(0)).cast("decimal(30,0)"))
    size = int_div(top + bottom, bottom * F.lit(2))
    signed = F.when((num < 0) != (den < 0), -size).otherwise(size)
    return signed.cast("double") / F.lit(float(10**digits))


def nano_rate(dollars_per_million: float) -> int:
    """Dollars per million tokens as whole nano-dollars per token."""
    nano = Decimal(str(dollars_per_million)) * 1000
    if nano != nano.to_integral_value():
        raise ValueError(f"rate {dollars_per_million} is finer than a nano-dollar per token")
    return int(nano)


def cost_nano(tokens_in: Column, tokens_out: Column, rates: tuple[float, float] = FLAT_RATE) -> Column:
    return tokens_in * F.lit(nano_rate(rates[0])) + tokens_out * F.lit(nano_rate(rates[1]))


def usd(nano: Column) -> Column:
    """Nano-dollars to dollars, rounded half up in whole cents."""
    return int_div(nano + F.lit(NANO_PER_CENT // 2), F.lit(NANO_PER_CENT)) / F.lit(100.0)


def model_family(model: Column, families: Sequence[str] = tuple(MODEL_RATES)) -> Column:
    """The first family whose name is part of the model name, else NULL."""
    out = F.lit(None).cast("string")
    for family in reversed(families):
        out = F.when(F.contains(F.lower(model), F.lit(family)), F.lit(family)).otherwise(out)
    return out


def bucket(value: Column, bounds: Sequence[int], labels: Sequence[str], inclusive: bool) -> Column:
    """Ordered thresholds; NULL and everything past the last bound get the last label."""
    out = None
    for bound, label in zip(bounds, labels):
        test = value <= bound if inclusive else value < bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(labels[-1])


def message_bucket(count: Column, labels: Sequence[str] = MESSAGE_LABELS) -> Column:
    return bucket(count, MESSAGE_BUCKETS, labels, inclusive=True)


def prompt_bucket(prompt: Column, labels: Sequence[str] = PROMPT_LABELS) -> Column:
    return bucket(F.length(prompt), PROMPT_BUCKETS, labels, inclusive=False)


def day_before(as_of: dt.date, days: int) -> Column:
    """The first day of a window of ``days`` that ends at ``as_of``."""
    if days <= 0:
        raise ValueError("days must be positive")
    return F.lit(as_of - dt.timedelta(days=days))


def human_count(n: Column, ties: str = "even") -> Column:
    """1234567 -> 1.2M, 2500 -> 2K, 999 -> 999, NULL -> 0.

    ``ties="even"`` is the terminal's rule, ``ties="up"`` the web page's, which
    also rounds below 1000.
    """
    if ties not in ("even", "up"):
        raise ValueError("ties is 'even' or 'up'")
    rnd = F.bround if ties == "even" else F.round
    exact = n.cast("decimal(24,6)")
    millions = rnd(exact / F.lit(1_000_000).cast("decimal(7,0)"), 1).cast("decimal(24,1)").cast("string")
    thousands = rnd(exact / F.lit(1_000).cast("decimal(4,0)"), 0).cast("decimal(24,0)").cast("string")
    small = n.cast("string") if ties == "even" else F.floor(exact + F.lit(Decimal("0.5"))).cast("string")
    return (
        F.when(n.isNull(), "0")
        .when(n >= 1_000_000, F.concat(millions, F.lit("M")))
        .when(n >= 1_000, F.concat(thousands, F.lit("K")))
        .otherwise(small)
    )


def money(dollars: Column) -> Column:
    return F.when(dollars.isNull(), "$0").otherwise(F.format_string("$%.2f", dollars))


def clean_label(name: Column, width: int = 20) -> Column:
    """A project label for display: no leading dash or dot, cut to ``width``."""
    return F.left(F.regexp_replace(F.coalesce(name, F.lit("")), r"^[-.]", ""), F.lit(width))


def delta_percent(current: Column, previous: Column) -> Column:
    """Change in whole percent; NULL where there is nothing to compare with."""
    return ratio_round(current - previous, previous, 0, percent=True).cast("bigint")


def matches_wildcard(text: Column, query: str) -> Column:
    """Case-insensitive substring search in which % and _ of the query are wildcards.

    A backslash is a plain character, so an escape character is chosen that the
    query does not contain.
    """
    escape = next((c for c in "~^!|#@`" if c not in query), "\x01")
    return F.ilike(text, F.lit(f"%{query}%"), F.lit(escape))


def matches_literal(text: Column, query: str) -> Column:
    """Case-insensitive substring search for the query exactly as typed."""
    return F.contains(F.lower(text), F.lower(F.lit(query)))


def matches(text: Column, query: str, literal: bool = False) -> Column:
    if not query:
        raise ValueError("query is empty")
    return matches_literal(text, query) if literal else matches_wildcard(text, query)
