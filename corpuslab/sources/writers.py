"""Tables and texts made ready for export, and the calls that write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles as text with so many decimals."""
    return df.select(*[F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    fixed(df, digits).write.csv(path, header=True)


def starred_blocks(df: DataFrame, header: Column, body: str = "text") -> DataFrame:
    """value: header, line end, body, empty line."""
    return df.select(F.concat(header, F.lit("\n"), F.coalesce(body, F.lit("")), F.lit("\n\n")).alias("value"))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """value: a row of a Markdown table, bars escaped."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def report_lines(df: DataFrame, form: str, *columns: str) -> DataFrame:
    """value: one formatted line for each row."""
    return df.select(F.format_string(form, *columns).alias("value"))


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.csv(f"{path}/vertices", header=True)
    edges.write.csv(f"{path}/edges", header=True)
