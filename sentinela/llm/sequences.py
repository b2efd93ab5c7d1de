"""Token ids as Arrow stream files of equal-length sequences.

The tokens of all documents, each closed by an end token, form one run in ascending order of their
ids. The run is cut into files (one a task), and a file into sequences of ``LENGTH`` tokens with a
mask that is false for the padding of its last sequence. A file is an Arrow stream whose batches hold
two fixed-size-list columns and the same number of sequences each, so the place of any token follows
from its number alone, and a mapped file hands out sequences and masks without copying them. Beside
each file lies a stream with the documents in it. The manifest, one row a file, gives where each
file's tokens start in the whole run.

A task writes under a name of its own and renames the file when it is whole, so a task that is run
again leaves one whole file. Files lie in the folder that ``spark.checkpoint.dir`` names.

Defined cases: a null text counts as empty and gives the end token alone; documents of equal id stand
by the hash of their text; a null id comes first; an empty table gives no files and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sentinela.llm import bpe
from sentinela.llm.tables import text_or_empty

LENGTH, ROWS = 1024, 512
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


@dataclass(frozen=True)
class Manifest:
    """Where the files lie, and the number of tokens before each of them."""

    root: str
    starts: tuple[int, ...]


def _names(root: str, part: int) -> tuple[str, str]:
    return f"{root}/part-{part:06d}.arrows", f"{root}/docs-{part:06d}.arrows"


def _schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Cuts a run of tokens into batches of equal-length sequences."""

    def __init__(self, sink, vocabulary_size: int, length: int = LENGTH, rows: int = ROWS):
        self.kind = pa.uint16() if vocabulary_size <= 1 << 16 else pa.uint32()
        self.schema, self.length, self.rows = _schema(self.kind, length), length, rows
        self.stream, self.waiting, self.size, self.total = pa.ipc.new_stream(sink, self.schema), [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.rows * self.length:
            run, whole = np.concatenate(self.waiting), self.rows * self.length
            for i in range(0, self.size - whole + 1, whole):
                self._write(run[i:i + whole])
            rest = run[self.size // whole * whole:]
            self.waiting, self.size = [rest], len(rest)

    def _write(self, ids: np.ndarray) -> None:
        padded = -(-len(ids) // self.length) * self.length
        values = np.zeros(padded, self.kind.to_pandas_dtype())
        values[: len(ids)] = ids
        mask = pa.array(np.arange(padded) < len(ids))
        columns = [pa.FixedSizeListArray.from_arrays(a, self.length) for a in (pa.array(values, self.kind), mask)]
        self.stream.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.size:
            self._write(np.concatenate(self.waiting))
        self.stream.close()


class SequenceFile:
    """Random access to the sequences, masks and tokens of one file."""

    def __init__(self, source):
        self.batches = list(pa.ipc.open_stream(source))
        self.rows = self.batches[0].num_rows if self.batches else 0
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def sequence(self, row: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of one sequence."""
        batch = self.batches[row // self.rows]
        return tuple(batch.column(c)[row % self.rows].values for c in ("ids", "mask"))

    def tokens(self, start: int, count: int) -> np.ndarray:
        """Tokens from their place in the file's run."""
        whole, found = self.rows * self.length, []
        while count > 0:
            inside = start % whole
            taken = min(count, whole - inside)
            values = self.batches[start // whole].column("ids").flatten()
            found.append(values.slice(inside, taken).to_numpy(zero_copy_only=True))
            start, count = start + taken, count - taken
        return found[0] if len(found) == 1 else np.concatenate(found or [np.empty(0, np.uint16)])


def _source(root: str, name: str):
    """A mapped file where the folder is a local or mounted one, else an open one."""
    system, path = fs.FileSystem.from_uri(name)
    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)


def write(df: DataFrame, root: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> Manifest:
    """Encode and write all documents; one shuffle puts them in ascending order of their ids.

    Documents that share an id are ordered by a hash of their text and by their place, so that the rows of
    one id, or all rows without one, go over as many tasks as they need.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    order = "doc_id", F.xxhash64("text"), "place"
    docs = docs.withColumn("place", F.monotonically_increasing_id())
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order).drop("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = bpe.encoder(vocabulary), TaskContext.get().partitionId()
        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        finals = _names(base, part)
        drafts = [f"{f}.{uuid.uuid4().hex}" for f in finals]
        with system.open_output_stream(drafts[0]) as sink, system.open_output_stream(drafts[1]) as index_sink:
            writer = SequenceWriter(sink, max(coder.names) + 1)
            index = pa.ipc.new_stream(index_sink, INDEX)
            documents = 0
            for batch in batches:
                first, counts = writer.total, []
                for ids, _ in coder.encode(batch.column("text"), decode=False):
                    writer.add(np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
                    counts.append(len(ids) // 4 + 1)
                starts = first + np.cumsum(counts) - counts
                columns = [batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())]
                index.write_batch(pa.record_batch(columns, schema=INDEX))
                documents += len(counts)
            writer.close(), index.close()
        if documents:
            for draft, final in zip(drafts, finals):
                # Left by an attempt whose executor was lost after renaming.
                if system.get_file_info(final).type != fs.FileType.NotFound:
                    system.delete_file(final)
                system.move(draft, final)
            yield pa.RecordBatch.from_pydict({"part": [part], "tokens": [writer.total]})
        else:
            for draft in drafts:
                system.delete_file(draft)

    written = sorted(ordered.mapInArrow(run, "part long, tokens long").collect())
    if not written:
        return Manifest(root, ())
    tokens = np.zeros(written[-1].part + 1, np.int64)
    tokens[[r.part for r in written]] = [r.tokens for r in written]
    return Manifest(root, tuple(np.where(tokens > 0, np.cumsum(tokens) - tokens, -1).tolist()))


def read(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the files; a task a file."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest.starts:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("id").to_pylist():
                if manifest.starts[part] < 0:
                    continue
                ids_name, docs_name = _names(manifest.root, part)
                file = SequenceFile(_source(manifest.root, ids_name))
                for docs in pa.ipc.open_stream(_source(manifest.root, docs_name)):
                    starts, counts = (docs.column(c).to_numpy() for c in ("start", "n_tokens"))
                    sums = [zlib.crc32(file.tokens(s, n).astype("<u4")) for s, n in zip(starts.tolist(), counts.tolist())]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": docs.column("doc_id"), "start": pa.array(starts + manifest.starts[part], pa.int64()),
                        "n_tokens": docs.column("n_tokens"), "ids_crc32": pa.array(sums, pa.int64()),
                    })

    return spark.range(0, len(manifest.starts), 1, len(manifest.starts)).mapInArrow(run, schema)
