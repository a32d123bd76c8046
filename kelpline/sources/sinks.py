"""Writers: Parquet tables, JSON documents, one document a key, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .key_files import KeyFiles


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def json_ready(c: Column, kind: T.DataType, digits: int = 4) -> Column:
    """The column for JSON: NaN becomes null, floats are rounded, dates are ISO days."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.round(F.nanvl(c, F.lit(None).cast("double")), digits)
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: json_ready(x, kind.elementType, digits))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(json_ready(c[f.name], f.dataType, digits).alias(f.name) for f in kind)))
    return c


def documents(df: DataFrame) -> DataFrame:
    """One JSON text a row, in column ``json``, nulls written out."""
    cols = [json_ready(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def file_key(c: Column) -> Column:
    """A key as a file name."""
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")


def write_documents(df: DataFrame, key: str, path: str) -> None:
    """``<key>.json`` in ``path`` for each row, many a task, there only when all are written.

    Rows are dealt out by file name; a null key, or two rows of one name, fail
    the job, and then no file has changed. Files of other keys stay.
    """
    cols = [json_ready(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    rows = df.select(file_key(F.col(key).cast("string")).alias("key"), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))
    df.sparkSession.dataSource.register(KeyFiles)
    rows.repartition("key").write.format("key_files").option("suffix", ".json").mode("append").save(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """Raw lines passed through, such as filtered JSON lines."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
