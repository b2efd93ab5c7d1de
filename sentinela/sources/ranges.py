"""Files read by byte ranges, among them their first and last lines, whose cost does not grow with the files.

Tasks open files through Arrow's file systems (local, S3, GCS, Azure, HDFS). Lines end as Spark's text reader ends
them: with a line feed, a carriage return, or both.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1 << 16
FILES_PER_TASK = 64
# Names that Hadoop's clients have for stores that Arrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfs", "abfss": "abfss"}
_BREAK = re.compile(rb"\r\n|\n|\r")
_MARK = b"\xef\xbb\xbf"


def _located(uri: str):
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


class _Ranges(io.RawIOBase):
    """A file of any store as a stream that can be sought in; each read is one range."""

    def __init__(self, uri: str):
        system, path = _located(uri)
        self._file, self._at = system.open_input_file(path), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self._file.size()}[whence]
        return self._at

    def readinto(self, buffer) -> int:
        found = self._file.read_at(len(buffer), self._at)
        buffer[:len(found)] = found
        self._at += len(found)
        return len(found)

    def close(self) -> None:
        if not self.closed:
            self._file.close()
        super().close()


def opened(uri: str, buffer: int = 1 << 20) -> io.BufferedReader:
    """A file to read from any place, ``buffer`` bytes at a time."""
    return io.BufferedReader(_Ranges(uri), buffer)


class Head:
    """The beginning of a file, as far as its first ``lines`` lines; compressed files are unpacked on the way."""

    def __init__(self, uri: str, lines: int, compressed: bool = True):
        system, path = _located(uri)
        self.data, self.ended, found = b"", False, 0
        with system.open_input_stream(path, compression="detect" if compressed else None, buffer_size=0) as stream:
            while not self.ended and found < lines:
                more = stream.read(CHUNK)
                self.ended = not more
                self.data += more
                # A carriage return at the very end may be the first half of a break.
                whole = self.data if self.ended else self.data.removesuffix(b"\r")
                found = sum(1 for _ in _BREAK.finditer(whole))
        ends = [m.span() for m in _BREAK.finditer(self.data)][:lines]
        starts = [0, *[end for _, end in ends]]
        stops = [begin for begin, _ in ends]
        if len(stops) < lines and starts[-1] < len(self.data):
            stops.append(len(self.data))
        self.starts = starts[:len(stops)]
        self.lines = [self.data[a:b] for a, b in zip(self.starts, stops)]
        if self.lines:
            self.lines[0] = self.lines[0].removeprefix(_MARK)


def last_start(uri: str, size: int) -> int:
    """Byte offset at which the last line of an uncompressed file begins."""
    system, path = _located(uri)
    data, at = b"", size
    with system.open_input_file(path) as file:
        while at > 0:
            step = min(CHUNK + len(data), at)
            at -= step
            data = file.read_at(step, at) + data
            body = data[:-2] if data.endswith(b"\r\n") else data[:-1] if data[-1:] in b"\r\n" else data
            found = max(body.rfind(b"\n"), body.rfind(b"\r"))
            if found >= 0:
                return at + found + 1
    return 0


@lru_cache(maxsize=64)
def head_lines(uri: str, lines: int, encoding: str) -> tuple[str, ...]:
    return tuple(line.decode(encoding, "replace") for line in Head(uri, lines).lines)


class _Files(InputPartition):
    def __init__(self, files: Sequence[str]):
        self.files = files


class FileHeads(DataSource):
    """Rows ``_file, _place, _line, _read``: the first lines of files, and the bytes that were read for them.

    Options: ``files`` (JSON list), ``lines`` (default 1), ``encoding``.
    """

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "_file string, _place int, _line string, _read long"

    def reader(self, schema) -> DataSourceReader:
        return _HeadReader(self.options)


class _HeadReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.lines, self.encoding = int(options.get("lines", 1)), options.get("encoding", "UTF-8")

    def partitions(self) -> Sequence[InputPartition]:
        parts = range(0, len(self.files), FILES_PER_TASK)
        return [_Files(self.files[i:i + FILES_PER_TASK]) for i in parts] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for file in partition.files:
            head = Head(file, self.lines)
            for place, line in enumerate(head.lines):
                yield file, place, line.decode(self.encoding, "replace"), len(head.data)


def file_heads(spark: SparkSession, files: Sequence[str], lines: int = 1, encoding: str = "UTF-8") -> DataFrame:
    """The first ``lines`` lines of every file, as ``_file, _place, _line, _read``."""
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").options(files=json.dumps(list(files)), lines=lines, encoding=encoding).load()
