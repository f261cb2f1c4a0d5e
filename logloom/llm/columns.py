"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def quoted(name: str) -> str:
    """A column's name for F.col, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of df that have none of these names, in any letter case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array; empty for an empty text."""
    return F.array_remove(F.split(text, SPACE_CLASS), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")
