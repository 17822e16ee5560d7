"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.session import scratch_path

# The white space of all word rules, as characters and as a regular expression class.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: The same lower-casing for Python code over bytes.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: a lineage cut that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once, also where it is used inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str = "text") -> Column:
    """A text, empty where null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(value: Column) -> Column:
    return F.translate(value, UPPER, LOWER)


def carried(df: DataFrame, **own: Column) -> DataFrame:
    """The whole row as one struct `_row`, next to named working columns: no name of the input can clash with a working name."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"), *[value.alias(name) for name, value in own.items()])


def opened(df: DataFrame, columns: list[str], **own: Column) -> DataFrame:
    """Undo `carried`: the input's columns in their order, then the given results; a result replaces an input column of its name."""
    names = {name.lower() for name in own}
    replaced = {c.lower(): c for c in columns if c.lower() in names}
    out = [own[next(n for n in own if n.lower() == c.lower())].alias(c) if c.lower() in names else F.col("_row").getField(c).alias(c) for c in columns]
    return df.select(*out, *[value.alias(name) for name, value in own.items() if name.lower() not in replaced])
