"""Reading the corpus tables, and the settings of tasks that hand texts to Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Characters a task turns into arrays at once; bounds its memory whatever the texts are.
CHARS_AT_ONCE = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(doc_id: Column, parts: int) -> Column:
    """Unsigned crc32 of the id's text, modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns that a result is about to add, in whatever case they are written."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def slices(texts: list[str], most: int = CHARS_AT_ONCE):
    """Ranges of consecutive texts of at most ``most`` characters, or of one longer text."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
