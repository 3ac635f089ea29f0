"""Column functions over text-typed tables. All stay native Spark expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(name: str) -> Column:
    """Text as a double; what is not a number is NULL."""
    return F.expr(f"try_cast(`{name}` as double)")


def to_id(name: str) -> Column:
    """Text or number as a whole number, also from forms like ``1.7E+11`` or ``42.0``; anything else is NULL."""
    exact = f"try_cast(`{name}` as decimal(38, 4))"
    return F.expr(f"if({exact} = floor({exact}), try_cast({exact} as bigint), null)")


def percent_of(part: str, total: str) -> Column:
    """``part`` in percent of ``total``, both possibly text; NULL when either is no number or the total is zero."""
    return F.expr(f"try_divide(try_cast(`{part}` as double), try_cast(`{total}` as double)) * 100")


def flag_over(value: Column, limit: float) -> Column:
    """1 above the limit, 0 up to it, NULL for a missing value."""
    return F.when(value > limit, 1).when(value <= limit, 0)


def ordinal(name: str, levels: Sequence[str]) -> Column:
    """1-based position among the declared levels; other values are NULL."""
    return F.nullif(F.array_position(F.array(*map(F.lit, levels)), F.col(name)), F.lit(0)).cast("int")


def relabel(name: str, labels: Mapping[str, str]) -> Column:
    """Whole values replaced by their label; values without one stay."""
    pairs = F.create_map(*[F.lit(v) for item in labels.items() for v in item])
    return F.coalesce(F.try_element_at(pairs, F.col(name)), F.col(name))


def replace_patterns(name: str, replacements: Mapping[str, str]) -> Column:
    """Regex replacements applied one after the other, in the order given."""
    out = F.col(name)
    for pattern, replacement in replacements.items():
        out = F.regexp_replace(out, pattern, replacement)
    return out


def matches_any(name: str, terms: Sequence[str]) -> Column:
    """Whether the text matches one of the regex terms, case-sensitively.

    Terms without regex characters are plain substring searches, which are much faster; the rest is one alternation.
    """
    plain = [t for t in terms if re.escape(t).replace("\\ ", " ").replace("\\-", "-") == t]
    patterns = [t for t in terms if t not in plain]
    tests = [F.contains(F.col(name), F.lit(t)) for t in plain]
    if patterns:
        tests.append(F.col(name).rlike("|".join(patterns)))
    return reduce(Column.__or__, tests)


def thousands(name: str) -> Column:
    """Rounded to a whole number, halves to the even one, with thousands separators."""
    return F.format_number(F.col(name), 0)
