"""CSV members of ZIP archives."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sentinela.sources.ranges import opened

ROWS_PER_BATCH = 20_000


def unzip_csv(archives: DataFrame, names: Iterable[str], sep: str = ",", encoding: str = "latin-1") -> DataFrame:
    """Rows of the first CSV member of every archive (column ``path``, an address), all text.

    Columns are matched to ``names`` by the member's header. A task reads an archive's directory
    and then its member by byte ranges and unpacks it as a stream, so it holds a batch of rows, whatever
    the size of the archive. A ZIP stream cannot be split: an archive is the unit of parallelism. An
    archive without a CSV member is an error.
    """
    wanted = [n.upper() for n in names]

    def member_rows(archive: str) -> Iterator[pd.DataFrame]:
        with opened(archive) as file, zipfile.ZipFile(file) as packed:
            members = [m for m in packed.namelist() if m.lower().endswith(".csv")]
            if not members:
                raise ValueError(f"no CSV file in {archive}")
            with packed.open(members[0]) as stream:
                try:
                    chunks = pd.read_csv(stream, sep=sep, encoding=encoding, dtype=str, na_filter=False, index_col=False,
                                         chunksize=ROWS_PER_BATCH)
                except pd.errors.EmptyDataError:
                    return
                for chunk in chunks:
                    chunk.columns = [c.strip().upper() for c in chunk.columns]
                    found = chunk.reindex(columns=wanted).astype(object)
                    yield found.where(found.notna() & (found != ""), None)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive in batch["path"]:
                yield from member_rows(archive)

    schema = ", ".join(f"`{n}` string" for n in wanted)
    return archives.select("path").mapInPandas(unpack, schema)


def read_zipped_csv(spark: SparkSession, path: str | list[str], names: Iterable[str], sep: str = ",",
                    encoding: str = "latin-1") -> DataFrame:
    """``unzip_csv`` of the archives at ``path``, which Spark lists without reading them."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
    return unzip_csv(listed, names, sep, encoding)
