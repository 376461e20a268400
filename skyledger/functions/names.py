"""Column-name handling: snake case, renames, lenient projection."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame


def snake_case(name: str) -> str:
    """Word borders become underscores, then every run of other signs does."""
    name = re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z\d])(?=[A-Z])", "_", name)
    return re.sub(r"\W+", "_", name.lower())


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])


def prefix_digit_columns(df: DataFrame, prefix: str = "y") -> DataFrame:
    """Names that start with a digit get a prefix: 2019_ops -> y2019_ops."""
    return df.toDF(*[prefix + c if c[:1].isdigit() else c for c in df.columns])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def title_name(name: str, fixes: Mapping[str, str] | None = None) -> str:
    """facility_id -> Facility (a trailing ``_id`` is dropped), lto_count -> Lto Count."""
    words = re.sub(r"_id$", "", snake_case(name)).split("_")
    text = " ".join(w.capitalize() for w in words if w)
    for old, new in (fixes or {}).items():
        text = text.replace(old, new)
    return text


def title_columns(df: DataFrame, fixes: Mapping[str, str] | None = None) -> DataFrame:
    return df.toDF(*[title_name(c, fixes) for c in df.columns])


def select_existing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Those of the wanted columns that exist, in the wanted order."""
    have = set(df.columns)
    return df.select(*[c for c in columns if c in have])


def suffixed(df: DataFrame, suffix: str, keep: Iterable[str] = ()) -> DataFrame:
    """Append a suffix to every column but the kept ones."""
    keep = set(keep)
    return df.toDF(*[c if c in keep else c + suffix for c in df.columns])
