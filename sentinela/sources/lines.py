"""Raw text lines: fixed-width layouts, header and footer lines, dates kept in a header line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, StringType

from sentinela.config import LiteralColumn
from sentinela.functions.text import slice_text
from sentinela.sources.ranges import Head, file_heads, head_lines, last_start


def read_lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """One row per line, in the column ``value``."""
    return decoded(spark.read.text(path), encoding)


def decoded(lines: DataFrame, encoding: str) -> DataFrame:
    """The text reader keeps a line's bytes as they are; other encodings are decoded here."""
    if encoding.upper().replace("-", "") == "UTF8":
        return lines
    return lines.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))


def positioned_lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """Lines with the split of the file they were read from: ``value, _file, _block, _length, _size``.

    A scan of its own: nothing is written, and the split is the one in force when the rows are read.
    """
    lines = spark.read.text(path).select("value", *[
        F.col(f"_metadata.{name}").alias(to) for name, to in (
            ("file_path", "_file"), ("file_block_start", "_block"), ("file_block_length", "_length"), ("file_size", "_size"))])
    return decoded(lines, encoding)


def _edges_of(file: str | None, block: int, length: int, size: int, header: int, footer: bool) -> tuple[int, bool]:
    """How many of a split's first rows are header lines of its file, and whether its last row is the file's last.

    A split holds the lines that begin after its start and up to its end; the first one also the line at its start.
    A split that is a whole file is known without a look at the file, a compressed one included.
    """
    if file is None:
        return header, footer

    def held(at: int) -> bool:
        return (block < at or block == at == 0) and at <= block + length

    head = sum(map(held, Head(file, header, compressed=False).starts)) if header else 0
    return head, footer and held(last_start(file, size))


def _inner_rows(header: int, footer: bool):
    """Whether each row of a stream of splits is neither a header nor a last line, one row late."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        split, seen, head, last, late = None, 0, 0, False, None
        for batch in batches:
            files, blocks, lengths, sizes, paths = (column.to_numpy() for column in batch)
            n = len(files)
            if not n:
                yield pd.Series([], dtype=bool)
                continue
            kept = np.ones(n, bool)
            starts = np.flatnonzero(np.r_[True, (files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])])
            for start, end in zip(starts, [*starts[1:], n]):
                if (files[start], blocks[start]) != split:
                    if last and start:
                        kept[start - 1] = False
                    elif last:
                        late = False
                    split, seen = (files[start], blocks[start]), 0
                    head, last = _edges_of(paths[start], blocks[start], lengths[start], sizes[start], header, footer)
                kept[start:min(end, start + max(0, head - seen))] = False
                seen += end - start
            before, late = ([] if late is None else [late]), kept[-1]
            yield pd.Series(np.r_[before, kept[:-1]].astype(bool))
        if late is not None:
            yield pd.Series([bool(late) and not last])

    # Not to be moved past another filter: it depends on seeing every row of the scan, in order.
    return F.pandas_udf(run, BooleanType()).asNondeterministic()


def drop_edge_lines(lines: DataFrame, header: int = 0, footer: bool = False) -> DataFrame:
    """``positioned_lines`` without the first ``header`` and, on request, the last line of each file.

    One pass over each split with one row of look-ahead. Where a file has several splits, its task asks the file
    itself by two short reads which of its edge lines begin in the split, so the result does not depend on how files
    are split, and no text leaves the JVM.
    """
    if not (header or footer):
        return lines
    whole = (F.col("_block") == 0) & (F.col("_length") >= F.col("_size"))
    kept = _inner_rows(int(header), bool(footer))(
        F.xxhash64("_file"), F.col("_block"), F.col("_length"), F.col("_size"), F.when(~whole, F.col("_file")))
    return lines.withColumn("_kept", kept).filter("_kept").drop("_kept")


def header_line(lines: DataFrame, line: int = 0, encoding: str = "UTF-8") -> DataFrame:
    """Line number ``line`` (0-based) of every file that has it, as ``_file``, ``_line``; one row per file."""
    heads = file_heads(lines.sparkSession, lines.inputFiles(), int(line) + 1, encoding)
    return heads.filter(F.col("_place") == int(line)).select("_file", "_line")


def with_header_line(df: DataFrame, line: int = 0, encoding: str = "UTF-8") -> DataFrame:
    """Add ``_line``, line number ``line`` of the file (``_file``) each row came from; NULL where it has none.

    A task reads the beginning of each of its files, so rows meet their header without a join or shuffle.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for files in batches:
            names, at = np.unique(files.to_numpy(), return_inverse=True)
            found = [(*head_lines(f, line + 1, encoding), *[None] * (line + 1))[line] for f in names]
            yield pd.Series(np.array(found, object)[at] if len(names) else [], dtype=object)

    return df.withColumn("_line", F.pandas_udf(run, StringType())(F.col("_file")))


def add_literal_date(df: DataFrame, literal: LiteralColumn) -> DataFrame:
    """Constant date column."""
    if literal.value is None:
        raise ValueError(f"literal column {literal.name!r} has no constant value")
    return df.withColumn(literal.name, F.try_to_date(F.lit(literal.value), literal.mask))


def add_date_from_line(df: DataFrame, lines: DataFrame, literal: LiteralColumn, encoding: str = "UTF-8") -> DataFrame:
    """Date cut out of a header line of the file each row came from (``_file``)."""
    date = F.try_to_date(slice_text(F.col("_line"), literal.start, literal.end), literal.mask)
    return with_header_line(df, literal.line, encoding).withColumn(literal.name, date).drop("_line")


def cut_fixed_width(df: DataFrame, layout: list[tuple[str, int, int]], positional: tuple[str, ...] = ()) -> DataFrame:
    """Cut ``value`` into columns ``(name, start, end)``; blanks are trimmed unless positional."""
    columns = []
    for name, start, end in layout:
        piece = slice_text(F.col("value"), start, end)
        columns.append((piece if name in positional else F.trim(piece)).alias(name))
    rest = [c for c in df.columns if c != "value"]
    return df.select(*columns, *rest)
