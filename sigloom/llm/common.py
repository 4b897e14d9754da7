"""Helpers shared by the operators: column access that survives clashing names, text rules, and tables between steps."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.session import cut_lineage, release

#: White space of the text rules, as characters and as the regular expression of a word.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the ``wanted`` columns (new name = name in ``df``).

    Columns are found by position, so further columns may have any names, also ones that differ in case alone or repeat.
    """
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return inner.select(*[F.col(f"c{df.columns.index(name)}").alias(new) for new, name in wanted.items()])


class Carried:
    """A frame whose columns are renamed by position while an operator works on it, and get their names back at the end."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.frame = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def col(self, name: str) -> Column:
        return F.col(f"c{self.names.index(name)}")

    def back(self, frame: DataFrame, **replaced: Column) -> DataFrame:
        columns = [replaced.get(name, F.col(f"c{i}")).alias(f"c{i}") for i, name in enumerate(self.names)]
        return frame.select(*columns).toDF(*self.names)


def without_space(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """All words of a text that is not null."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


class Written:
    """Tables in the shared checkpoint folder, so that a lost executor costs one step and not the whole job.

    ``drop`` deletes those that no later plan reads; what a returned frame still reads goes when the session ends.
    """

    def __init__(self, spark):
        self.spark = spark

    def table(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df)

    def drop(self, *tables: DataFrame) -> None:
        release(*tables)
