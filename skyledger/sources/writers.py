"""Sinks: flat tables, one file set per group, result sets, table replacement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

ROWS_PER_FILE = 2_000_000


def write_flat(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    df.write.mode("overwrite").options(**options).format(fmt).save(path)


def write_by_group(
    df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet", spread: bool = True, **options
) -> None:
    """One directory per group value.

    With ``spread`` the rows are first rebalanced on the keys, which gathers small
    groups and cuts large ones over several tasks, so that no task writes a whole
    hot group and no group is scattered in tiny files.
    """
    out = df.hint("rebalance", *keys) if spread else df
    (
        out.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE)
        .options(**options).partitionBy(*keys).format(fmt).save(path)
    )


def write_group_files(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet", **options) -> None:
    """One directory per group, whose files hold all columns, the keys too.

    The directories are named by copies of the keys (``of_<key>=...``), so a file that is
    handed on alone still tells its group. Groups are gathered and cut as in ``write_by_group``.
    """
    named = df.withColumns({f"of_{k}": F.col(k) for k in keys})
    write_by_group(named, path, [f"of_{k}" for k in keys], fmt, **options)


def read_group_files(spark: SparkSession, path: str, fmt: str = "parquet", **of) -> DataFrame:
    """The tables of ``write_group_files`` without the copies of the keys; ``of`` names one group, whose files only are read."""
    df = spark.read.format(fmt).load(path)
    for key, value in of.items():
        df = df.where(F.col(f"of_{key}") == value)
    return df.drop(*[c for c in df.columns if c.startswith("of_") and c[3:] in df.columns])


def replace_groups(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet") -> None:
    """Replace the groups of a ``write_by_group`` table that ``df`` has rows of.

    The files of all other groups stay as they are, and writing the same rows again
    changes nothing.
    """
    (
        df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(*keys).format(fmt).save(path)
    )


def write_checked(df: DataFrame, path: str, checks: Mapping[str, Column], fmt: str = "parquet", **options) -> dict[str, int]:
    """Write a table and check its rows in the same pass.

    ``checks`` are tests that every row has to pass; null is a failure. Gives the number of rows
    and, if a test fails, raises an error with the number of rows that failed each.
    """
    seen = Observation()
    failed = [F.count_if(~F.coalesce(test, F.lit(False))).alias(name) for name, test in checks.items()]
    write_flat(df.observe(seen, F.count(F.lit(1)).alias("rows"), *failed), path, fmt, **options)
    found = seen.get
    wrong = {name: found[name] for name in checks if found[name]}
    if wrong:
        raise ValueError("rows that failed a check: " + ", ".join(f"{name} {n}" for name, n in wrong.items()))
    return found


def write_tsv_by_group(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    write_by_group(df, path, keys, "csv", sep="\t", header=True)


def write_result_set(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet", **options) -> None:
    """Several named tables of one deliverable, a directory each."""
    for name, df in tables.items():
        write_flat(df, f"{path}/{name}", fmt, **options)


def create_table(df: DataFrame, name: str) -> DataFrame:
    """Create (or replace) a managed table from a query and return it."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def append_rows(df: DataFrame, name: str) -> None:
    """Add rows to a table, columns matched by name."""
    target = df.sparkSession.table(name).columns
    df.select(*target).write.mode("append").insertInto(name)


def replace_rows(df: DataFrame, name: str) -> None:
    """Replace a table's contents, keeping its definition."""
    target = df.sparkSession.table(name).columns
    df.select(*target).write.mode("overwrite").insertInto(name, overwrite=True)


def drop_rows(df: DataFrame, bad: Column) -> DataFrame:
    """Repair by deletion: rows for which the test holds go; unknown stays."""
    return df.where(~F.coalesce(bad, F.lit(False)))


def set_constant(df: DataFrame, column: str, value, where: Column | None = None) -> DataFrame:
    """Repair by constant update, of all rows or those that pass a test."""
    new = F.lit(value).cast(df.schema[column].dataType)
    return df.withColumn(column, new if where is None else F.when(where, new).otherwise(F.col(column)))
