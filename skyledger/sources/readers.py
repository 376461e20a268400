"""Scans: delimited text, Parquet, keyed partitions, database tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from skyledger.functions.text import digits


def read_delimited(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ","
) -> DataFrame:
    """Text with a header row, quoted fields and a declared schema.

    Cells that do not fit their declared type become null.
    """
    return (
        spark.read.schema(schema)
        .options(header=True, sep=sep, quote='"', escape='"', mode="PERMISSIVE",
                 enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        .csv(path)
    )


FORMAT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
CORRUPT = "_corrupt_line"


def parse_lines(
    lines: DataFrame, line: str, schema: T.StructType | str, sep: str = ","
) -> tuple[DataFrame, DataFrame]:
    """Delimited text in a column: typed rows, and apart from them the rows that do not fit.

    Both keep the other columns of ``lines``; a parsed column takes the place of one of its
    name. The rows that do not fit keep their line and get a ``reason``: ``no line``, ``number of fields``,
    or the columns whose text is not of their type, in the schema's order.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    ddl = lambda fields: ", ".join(f"`{f}` {t}" for f, t in [*fields, (CORRUPT, "string")])
    options = {**FORMAT, "sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    typed = F.from_csv(line, ddl([(f.name, f.dataType.simpleString()) for f in schema]), options)
    plain = F.from_csv(line, ddl([(f.name, "string") for f in schema]), options)
    parsed = lines.withColumns({"_typed": typed, "_plain": plain})
    blank = F.coalesce(F.trim(line) == "", F.lit(True))
    fits = ~blank & F.col(f"_typed.{CORRUPT}").isNull()
    others = [c for c in lines.columns if c != line and c not in schema.names]
    good = parsed.where(fits).select(*others, *[F.col(f"_typed.`{f.name}`").alias(f.name) for f in schema])
    wrong = F.concat_ws(", ", *[
        F.when(F.col(f"_plain.`{f.name}`").isNotNull() & F.col(f"_typed.`{f.name}`").isNull(), f.name) for f in schema])
    reason = F.when(blank, "no line").when(F.col(f"_plain.{CORRUPT}").isNotNull(), "number of fields").otherwise(wrong)
    bad = parsed.where(~fits).select(*others, line, reason.alias("reason"))
    return good, bad


def read_lines(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ","
) -> tuple[DataFrame, DataFrame]:
    """Delimited files without header: typed rows, and the lines that do not fit with the reason and their file."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file_name"))
    return parse_lines(lines, "line", schema, sep)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    return read_delimited(spark, path, schema, ",")


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    return read_delimited(spark, path, schema, "\t")


def read_text_columns(
    spark: SparkSession, path: str | list[str], columns: Sequence[str], sep: str = ","
) -> DataFrame:
    """Every column as text, for tables whose values are cleaned before casting."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return read_delimited(spark, path, schema, sep)


def with_file_keys(df: DataFrame, patterns: Mapping[str, str], numbers: Sequence[str] = ()) -> DataFrame:
    """Add keys taken from the name of the file a row came from.

    ``patterns`` maps a new column to a regular expression with one group; the
    columns in ``numbers`` are cast to int.
    """
    name = F.col("_metadata.file_name")
    found = {
        key: digits(name, p) if key in numbers else F.regexp_extract(name, p, 1)
        for key, p in patterns.items()
    }
    return df.withColumns(found)


def read_group(spark: SparkSession, path: str, column: str, value: str | None = None) -> DataFrame:
    """One partition of a keyed dataset, or all of them."""
    df = spark.read.parquet(path)
    return df if value is None else df.where(F.col(column) == value)


def read_parquet(
    spark: SparkSession, path: str, schema: T.StructType | str, where=None
) -> DataFrame:
    """Parquet with a declared schema; a predicate on partition columns prunes files."""
    df = spark.read.schema(schema).parquet(path)
    return df if where is None else df.where(where)


def check_schema(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Fail before any work when a declared column is missing or of another type."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {', '.join(wrong)}")
    return df


def read_database(
    spark: SparkSession, url: str, table: str, split_on: str | None = None,
    bounds: tuple[int, int] | None = None, parts: int = 16, **options: str,
) -> DataFrame:
    """A database table or query; with ``split_on`` it is read in parallel ranges."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_on and bounds:
        reader = reader.options(partitionColumn=split_on, lowerBound=bounds[0],
                                upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def query_source(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """A SQL text over named DataFrames, written ``{name}`` in the text."""
    return spark.sql(sql, **tables)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small constant table."""
    return spark.createDataFrame(list(rows), schema)
