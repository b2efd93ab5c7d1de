"""Delimited files, with or without a header."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sentinela.sources.lines import drop_edge_lines, header_line, with_header_line
from sentinela.sources.ranges import file_heads
from sentinela.staging import stage


def align_header(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Upper-case names in the expected order; absent columns become NULL, others are dropped."""
    present = {c.upper(): c for c in df.columns}
    columns = []
    for name in (n.upper() for n in names):
        source = F.col(f"`{present[name]}`") if name in present else F.lit(None).cast("string")
        columns.append(source.alias(name))
    return df.select(*columns)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    names: Iterable[str] | None = None,
    header: bool = True,
    sep: str | None = ",",
    encoding: str = "UTF-8",
    align: bool = False,
    **options: str,
) -> DataFrame:
    """Read delimited text as strings.

    Without a header the columns take ``names``. With ``align`` each file's header is matched
    to ``names`` by name (see ``read_aligned``).
    """
    names = list(names or [])
    if not header and not names:
        raise ValueError("a file without a header needs column names")
    if not sep:
        raise ValueError("a delimited file needs a separator")
    reader = spark.read.options(sep=sep, encoding=encoding, header=header, **options)
    if not header:
        schema = StructType([StructField(n, StringType(), True) for n in names])
        return reader.schema(schema).csv(path)
    if not align:
        return reader.csv(path)
    return read_aligned(spark, path, names, sep, encoding, **options)


def read_aligned(spark: SparkSession, path: str | list[str], names: Iterable[str], sep: str = ",",
                 encoding: str = "UTF-8", uniform_header: bool = False, **options: str) -> DataFrame:
    """Read files whose headers may differ in order or content; columns in upper case.

    The CSV reader binds every file it is given by the first one's header. So files are grouped by
    header, the reader reads each group, and the groups are put together by name. A short read of
    every file finds the headers; ``uniform_header`` saves that where all files agree.
    """
    names = [n.upper() for n in names]
    reader = spark.read.options(sep=sep, encoding=encoding, header=True, **options)
    if uniform_header:
        return align_header(reader.csv(path), names)
    # A list of files for each header, as Spark's own listing of the folder holds it.
    groups = file_headers(spark, path, encoding).groupBy("_line").agg(F.collect_list("_file").alias("files")).collect()
    if not groups:
        raise ValueError(f"no data files in {path}")
    groups = sorted(sorted(unquote(f) for f in g.files) for g in groups)
    parts = [align_header(reader.csv(files), names) for files in groups]
    return reduce(DataFrame.unionByName, parts)


def file_headers(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """First line of every file, as ``_file``, ``_line``; reads the beginnings of the files only."""
    return file_heads(spark, spark.read.text(path).inputFiles(), 1, encoding).select("_file", "_line")


def _cells(c: Column, width: int, sep: str, options: dict[str, str]) -> Column:
    places = [f"c{i}" for i in range(width)]
    parsed = F.from_csv(c, ", ".join(f"{p} string" for p in places), {"sep": sep, **options})
    return F.array(*[parsed[p] for p in places])


def read_without_edges(lines: DataFrame, names: Iterable[str], header: bool, sep: str | None, skip_first: bool = False,
                       skip_last: bool = False, encoding: str = "UTF-8", **options: str) -> DataFrame:
    """Delimited rows without the first and/or last data line of each file, all text, plus ``_file``, ``_block``.

    ``lines`` are ``positioned_lines``. A header line is not a data line: it names the columns and
    goes as well. A record is one line here; files with line breaks inside quotes are refused.
    """
    if not sep:
        raise ValueError("a delimited file needs a separator")
    if str(options.get("multiLine", options.get("multiline", False))).lower() == "true":
        raise ValueError("edge lines cannot be dropped from files whose records span lines")
    names = list(names)
    kept = drop_edge_lines(lines, int(header) + int(skip_first), skip_last).filter(F.trim("value") != "")
    if not header:
        cells = _cells(F.col("value"), len(names), sep, options)
        return kept.select(*[cells[i].alias(n) for i, n in enumerate(names)], "_file", "_block")
    # There are few different headers, however many files: each is cut once, and rows find its titles by the line.
    headers = stage(header_line(lines, encoding=encoding).select("_line").distinct(), "header-lines")
    separators = F.length(F.regexp_replace("_line", "[^" + re.escape(sep) + "]", ""))
    width = (headers.agg(F.max(separators)).first()[0] or 0) + 1
    titles = F.transform(_cells(F.col("_line"), width, sep, options), lambda h: F.upper(F.trim(h))).alias("_titles")
    rows = with_header_line(kept, encoding=encoding).join(headers.select("_line", titles), "_line", "left")
    rows = rows.withColumn("_cells", _cells(F.col("value"), width, sep, options))
    return rows.select(*[
        F.try_element_at("_cells", F.nullif(F.array_position("_titles", F.lit(n.upper())).cast("int"), F.lit(0))).alias(n.upper())
        for n in names], "_file", "_block")
