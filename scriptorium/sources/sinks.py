"""Writers: JSON lines, CSV and text, partitioned or plain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON object per line, null fields kept; `by` makes one folder per value."""
    writer = df.write.option("ignoreNullFields", False)
    (writer.partitionBy(by) if by else writer).json(path)


def csv(df: DataFrame, path: str, null: str = "\\N") -> None:
    """With a header; null fields are written as `null`, so they differ from empty ones."""
    df.write.option("header", True).option("nullValue", null).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def text(df: DataFrame, column: str, path: str, separator: str = "\n\n") -> None:
    """The column's texts, each with the separator behind it; null texts are left out."""
    df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).write.text(path, lineSep=separator)
