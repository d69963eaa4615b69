"""Row filters."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_modalities(df: DataFrame, variable: str, values: list[str]) -> DataFrame:
    """Rows whose variable is listed; with an empty list those that have it at all; all rows if there is no such variable."""
    if variable not in df.columns:
        return df
    return df.filter(F.col(variable).isin(*values)) if values else df.filter(F.col(variable).isNotNull())


def free(df: DataFrame, predicate: str) -> DataFrame:
    """Rows for which a predicate in SQL holds; all rows if it cannot be understood."""
    try:
        return df.filter(predicate)
    except PySparkException:
        return df


def since(df: DataFrame, column: str, instant: str) -> DataFrame:
    return df.filter(F.col(column) > F.lit(instant).cast(df.schema[column].dataType))
