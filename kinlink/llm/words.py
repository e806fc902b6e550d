"""Words: maximal runs of characters other than space and U+0009 to U+000D."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PATTERN = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERN)), F.lit(0)).cast("long")


def split_words(text: str | None) -> list[bytes]:
    """The words as UTF-8: ``bytes.split`` cuts at exactly the six characters of the pattern."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


#: Rows that go to Python together where a row holds a whole text.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Makes Spark hand whole texts to Python in small batches, so that workers stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)


def each(column) -> Iterator:
    """The values of an Arrow column, one at a time."""
    for x in column:
        yield x.as_py()
