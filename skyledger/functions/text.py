"""Text expressions: key cleaning, repairs, splits, coordinates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Ids that a spreadsheet turned into scientific notation.
SCIENTIFIC_IDS = {"1e4": "10000", "1e2": "100", "1e7": "10000000", "2e5": "200000",
                  "2e7": "20000000", "3e0": "3"}
# Names with a broken character, and their repair.
BROKEN_NAMES = {"Myst�re": "Mystere", "A�rospatiale": "Aerospatiale",
                "Br�guet": "Breguet"}
MISSING_CODE = "-999"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_key(c: str | Column) -> Column:
    """Trimmed, lower case, without apostrophes."""
    return F.replace(F.lower(F.trim(_col(c))), F.lit("'"), F.lit(""))


def recode(c: str | Column, codes: Mapping[str, str]) -> Column:
    """Whole-value recoding; values outside the map stay."""
    out = _col(c)
    picked = F.lit(None)
    for old, new in codes.items():
        picked = F.when(out == old, F.lit(new)).otherwise(picked)
    return F.coalesce(picked, out)


def recode_or_null(c: str | Column, codes: Mapping) -> Column:
    """Whole-value recoding; values outside the map become null."""
    out = _col(c)
    picked = F.lit(None)
    for old, new in codes.items():
        picked = F.when(out == old, F.lit(new)).otherwise(picked)
    return picked


def repair_ids(c: str | Column) -> Column:
    return recode(c, SCIENTIFIC_IDS)


def repair_text(
    c: str | Column, repairs: Mapping[str, str] = BROKEN_NAMES, missing: Sequence[str] = ()
) -> Column:
    """Mend broken substrings; a value holding one of ``missing`` becomes the missing code."""
    out = _col(c)
    for old, new in repairs.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    for mark in missing:
        out = F.when(F.contains(out, F.lit(mark)), F.lit(MISSING_CODE)).otherwise(out)
    return out


def has(c: str | Column, part: str, any_case: bool = False) -> Column:
    """Substring test in which null counts as no."""
    hit = _col(c).ilike(f"%{part}%") if any_case else F.contains(_col(c), F.lit(part))
    return F.coalesce(hit, F.lit(False))


def is_plain(c: str | Column, allowed: str = r"-\w /,;()<`") -> Column:
    """True where every character is of the allowed class."""
    return ~_col(c).rlike(f"[^{allowed}]")


def digits(c: str | Column, pattern: str = r"(\d+)") -> Column:
    """First number matched by a pattern, null where there is none."""
    found = F.regexp_extract(_col(c), pattern, 1)
    return F.when(found != "", found.cast("int"))


def part(c: str | Column, sep: str, i: int) -> Column:
    """``i``-th piece, from 1; negative counts from the end."""
    return F.split_part(_col(c), F.lit(sep), F.lit(i))


def right_split(c: str | Column, sep: str = "/") -> tuple[Column, Column]:
    """(everything before, everything after) the last separator."""
    text = _col(c)
    tail = F.substring_index(text, sep, -1)
    head = F.when(
        F.contains(text, F.lit(sep)),
        F.left(text, F.length(text) - F.length(tail) - len(sep)),
    )
    return head, tail


def title(c: str | Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere."""
    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([a-z]+|[^a-z]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.right(r, F.length(r) - 1))),
        "",
    )


def tokens(c: str | Column) -> Column:
    return F.split(F.lower(_col(c)), " ")


def joined(*columns: str | Column, sep: str = "") -> Column:
    """Composite key; null if any piece is null."""
    pieces: list[Column] = []
    for i, c in enumerate(columns):
        if i and sep:
            pieces.append(F.lit(sep))
        pieces.append(_col(c).cast("string"))
    return F.concat(*pieces)


def degrees(c: str | Column) -> Column:
    """``D-M-S.sssH`` to signed decimal degrees (N and E positive)."""
    text = _col(c)
    last = part(text, "-", 3)
    sign = F.when(F.right(text, F.lit(1)).isin("N", "E"), 1.0).otherwise(-1.0)
    seconds = F.left(last, F.length(last) - 1)
    number = lambda x: x.try_cast("double")
    return sign * (
        number(part(text, "-", 1)) + number(part(text, "-", 2)) / 60 + number(seconds) / 3600
    )
