"""Rule expressions: labels, ordered overrides, validity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

Rule = tuple[Column, object]


def _value(v: object) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def first_rule(rules: Sequence[Rule], default: object = None) -> Column:
    """The first rule that holds gives the value."""
    out = _value(default)
    for test, value in reversed(list(rules)):
        out = F.when(test, _value(value)).otherwise(out)
    return out


def last_rule(rules: Sequence[Rule], default: object = None) -> Column:
    """Every rule is applied in turn, so the last one that holds gives the value."""
    return first_rule(list(reversed(list(rules))), default)


def override(base: str, better: str) -> Column:
    """The better value where there is one."""
    return F.coalesce(F.col(better), F.col(base))


def same_flag(a: str, b: str) -> Column:
    """1 where both sides are equal and known, else 0."""
    return F.coalesce((F.col(a) == F.col(b)).cast("int"), F.lit(0))


def valid_on(day: str, start: str, end: str | None = None) -> Column:
    """Strictly inside the validity interval; the end may be absent."""
    at = F.lit(day).cast("timestamp")
    inside = F.col(start) < at
    return inside & (F.col(end) > at) if end else inside


def sign_of(c: str, positive: str) -> Column:
    return F.when(F.col(c) == positive, 1).otherwise(-1)


def not_in(c: str, values: Sequence) -> Column:
    """Outside a literal list; null counts as outside."""
    return F.coalesce(~F.col(c).isin(*values), F.lit(True))
