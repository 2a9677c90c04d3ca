"""Reading response tables and word lists, and checking them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, null_value: str | None = None, **options) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes. Without a schema all columns are strings: types are never guessed."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST" if schema else "PERMISSIVE")
    if null_value is not None:
        r = r.option("nullValue", null_value)
    for k, v in options.items():
        r = r.option(k, v)
    return (r.schema(schema) if schema else r).csv(path)


def read_json(spark: SparkSession, path: str, lines: bool = False, schema: StructType | str | None = None) -> DataFrame:
    """A JSON array of records, or one record a line; malformed content raises when it is read."""
    r = spark.read.option("multiLine", not lines).option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """One sheet of a workbook; needs openpyxl, and the sheet to fit on the driver, as workbooks do."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl; save the sheet as CSV instead") from e
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """Extension: a table of a database over JDBC."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): one word a line, trimmed and lower-cased; blank lines and lines from # on are skipped."""
    word = F.lower(F.trim("value"))
    return spark.read.text(path).select(word.alias("word")).filter((F.col("word") != "") & ~F.col("word").startswith("#")).distinct()


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """df itself; raises ValueError for missing columns or an empty table."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df


def validate(df: DataFrame, required: list[str], min_rows: int = 1) -> tuple[bool, str]:
    """(valid, message), from one pass: required columns, number of rows, columns that are wholly NULL."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        return False, f"Missing required columns: {', '.join(missing)}"
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(required)]).first()
    if row["_n"] < min_rows:
        return False, f"Table has {row['_n']} rows; at least {min_rows} are needed"
    empty = [c for i, c in enumerate(required) if row[f"_{i}"] == 0]
    return (False, f"Columns without values: {', '.join(empty)}") if empty else (True, "Valid")
