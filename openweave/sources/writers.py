"""Writing results: CSV with joined lists, directories of tables, text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame, separator: str = ", ") -> DataFrame:
    """Arrays of scalars joined to text; structs, maps and other arrays as JSON: what a CSV file can hold."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.MapType, T.ArrayType)):
            out.append(F.array_join(F.col(f.name).cast("array<string>"), separator).alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            out.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_words(words: DataFrame, path: str, header: str | None = None, column: str = "word") -> int:
    """A word list, one word a line in order, with an optional comment first; returns the number of words."""
    lines = words.select(F.lit(1).alias("k"), F.col(column).alias("value"))
    if header:
        lines = lines.unionByName(words.sparkSession.createDataFrame([(0, f"# {header}")], "k int, value string"))
    lines.orderBy("k", "value").select("value").coalesce(1).write.mode("overwrite").text(path)
    return words.count()


def export_all(tables: dict[str, DataFrame], directory: str, form: str = "csv") -> dict[str, str]:
    """Every table into its own folder of the directory, as csv, json or parquet; returns the folders."""
    out = {}
    for name, df in tables.items():
        path = f"{directory.rstrip('/')}/{name}"
        if form == "csv":
            write_csv(df, path)
        elif form == "json":
            write_json(df, path)
        elif form == "parquet":
            df.write.mode("overwrite").parquet(path)
        elif form == "excel":
            raise RuntimeError("workbooks need openpyxl; choose csv, json or parquet")
        else:
            raise ValueError(f"unknown form {form}")
        out[name] = path
    return out


def non_analytic(assessed: DataFrame, path: str, include_review: bool = True) -> int:
    """Writes the answers to be excluded (and reviewed); returns their number."""
    wanted = ["exclude", "review"] if include_review else ["exclude"]
    rows = assessed.filter(F.col("quality_recommendation").isin(wanted))
    write_csv(rows, path)
    return rows.count()


def write_text(spark: SparkSession, text: str, path: str) -> str:
    """One text as one UTF-8 file on any file system Spark knows (methods documents, summaries, reports); returns the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return path


def csv_package(tables: dict[str, DataFrame], rows: int = 100_000) -> bytes:
    """Small tables as one zip archive of CSV files, in memory; a table beyond ``rows`` is refused: export_all writes any size."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            page = flat(df).limit(rows + 1).toPandas()
            if len(page) > rows:
                raise ValueError(f"{name} has more than {rows} rows")
            z.writestr(f"{name}.csv", page.to_csv(index=False))
    return out.getvalue()


def download_link(df: DataFrame, filename: str, label: str, rows: int = 10_000, form: str = "csv") -> str:
    """A small table as a data link, csv or json; tables beyond ``rows`` are refused."""
    import base64

    page = flat(df).limit(rows + 1).toPandas()
    if len(page) > rows:
        raise ValueError(f"more than {rows} rows")
    kinds = {"csv": ("text/csv", lambda: page.to_csv(index=False)), "json": ("application/json", lambda: page.to_json(orient="records"))}
    if form not in kinds:
        raise ValueError(f"unknown form {form}")
    kind, body = kinds[form]
    return f'<a href="data:{kind};base64,{base64.b64encode(body().encode()).decode()}" download="{filename}">{label}</a>'
