"""Token ids in Arrow files of equal-length sequences.

A dataset is a folder. Each ``tokens-*.arrow`` is in the Arrow file format (the stream format between a magic word and a
footer that lists its batches) and has two fixed-size-list columns: ``ids`` (uint16 where the vocabulary allows it,
else uint32) and ``mask`` (true for ids, false for the padding of a file's last sequence). Sequences are cut from the
ids of all documents in ascending order, every document with its end id, without a gap. A list column's values are one
buffer, so sequences and documents of a memory-mapped file are views of it, and any of them is found by arithmetic.
``documents-*.arrow`` beside it has (doc_id, first, n_tokens) for the documents of the file, in order; the table
``manifest`` has a row a file with the number of ids before it. Batches are not compressed: compressed ones can't be
mapped.

Every task writes the files of its range of documents under private names and renames them when they are complete; a
task that runs again replaces them by equal ones. Files end at the first document that passes ``file_tokens``; tasks
hold one batch. The path's file system must be one that Arrow opens (local or shared folder, hdfs, s3, gs).

Results: null text is an empty document of the end id alone; rows of one doc_id are separate documents, ordered by a
hash of their texts; null ids come first; other columns are ignored; an empty table makes an empty dataset. Ranges are
cut by (doc_id, hash, row number), so an id or text with a third of all rows is dealt over many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerline.llm.byte_bpe import shared_encoder
from ledgerline.llm.common import give_back, slices, tidily
from ledgerline.llm.word_spans import in_slices

SEQUENCE = 2048
BATCH = 256  # sequences
FILE_TOKENS = 1 << 27
END = 0
_MANIFEST = "part int, roll int, stem string, n_documents long, n_tokens long, n_sequences long"


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class FileWriter:
    """One pair of files; ``add`` ids of whole documents, then ``close``."""

    def __init__(self, folder: str, stem: str, id_type: pa.DataType, kind: np.dtype, length: int) -> None:
        self.fs, self.folder = _open(folder)
        self.stem, self.kind, self.length = stem, np.dtype(kind), length
        self.private = f"{self.folder}/.{stem}-{uuid.uuid4().hex}"
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.doc_schema = pa.schema([("doc_id", id_type), ("first", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(f"{self.private}-{x}") for x in ("tokens", "documents")]
        self.writers = [pa.ipc.new_file(s, schema) for s, schema in zip(self.sinks, (self.schema, self.doc_schema), strict=True)]
        self.rest = np.zeros(0, self.kind)
        self.n_tokens = self.n_documents = self.n_sequences = 0

    def _put(self, ids: np.ndarray, real: int) -> None:
        """``ids`` are whole sequences, the first ``real`` of them are no padding."""
        mask = pa.array(np.arange(len(ids)) < real) if real < len(ids) else pa.array(np.ones(len(ids), bool))
        self.writers[0].write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
                                                     pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))
        self.n_sequences += len(ids) // self.length

    def add(self, doc_id: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        ends = self.n_tokens + np.cumsum(counts)
        self.writers[1].write_batch(pa.record_batch([doc_id, pa.array(ends - counts), pa.array(counts)], schema=self.doc_schema))
        self.n_tokens, self.n_documents = self.n_tokens + len(ids), self.n_documents + len(counts)
        ids = np.concatenate([self.rest, ids.astype(self.kind)])
        step = BATCH * self.length
        full = len(ids) // step * step
        for a in range(0, full, step):
            self._put(ids[a:a + step], step)
        self.rest = ids[full:].copy()

    def close(self) -> None:
        if len(self.rest):
            padded = np.zeros(-(-len(self.rest) // self.length) * self.length, self.kind)
            padded[:len(self.rest)] = self.rest
            self._put(padded, len(self.rest))
        for w, s in zip(self.writers, self.sinks, strict=True):
            w.close()
            s.close()
        for x in ("tokens", "documents"):
            self.fs.move(f"{self.private}-{x}", f"{self.folder}/{x}-{self.stem}.arrow")


def _writer(folder: str, vocabulary: str, id_type: pa.DataType, end: int, length: int, file_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(vocabulary)
        kind = np.dtype("<u2") if encoder.vocabulary_size() <= 1 << 16 else np.dtype("<u4")
        part, roll, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for at, texts in in_slices(batch.column("text")):
                ids, counts = encoder.encode(texts)
                ids = np.insert(ids, np.cumsum(counts), end)
                if out is None:
                    out = FileWriter(folder, f"{part:06d}-{roll:04d}", id_type, kind, length)
                out.add(batch.column("doc_id").slice(at, len(texts)), ids, counts + 1)
                if out.n_tokens >= file_tokens:
                    yield _closed(out, part, roll)
                    out, roll = None, roll + 1
        if out is not None:
            yield _closed(out, part, roll)

    return tidily(run)


def _closed(out: FileWriter, part: int, roll: int) -> pa.RecordBatch:
    out.close()
    return pa.record_batch({"part": pa.array([part], pa.int32()), "roll": pa.array([roll], pa.int32()), "stem": [out.stem],
                            "n_documents": [out.n_documents], "n_tokens": [out.n_tokens], "n_sequences": [out.n_sequences]})


def write(docs: DataFrame, vocabulary: str, folder: str, end: int = END, length: int = SEQUENCE, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode the texts of ``docs`` (doc_id, text), write the dataset to ``folder`` and return its manifest."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    written = f"{folder}/written"
    rows.mapInArrow(_writer(folder, vocabulary, id_type, end, length, file_tokens), _MANIFEST).write.parquet(written)
    files = spark.read.schema(_MANIFEST).parquet(written)
    start = F.sum("n_tokens").over(Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1))
    files.withColumn("start", F.coalesce(start, F.lit(0))).write.parquet(f"{folder}/manifest")  # a row a file
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST + ", start long").parquet(f"{folder}/manifest")


class TokenFile:
    """Random access to one file: sequences and documents as views of the mapped buffer."""

    def __init__(self, folder: str, stem: str) -> None:
        fs, at = _open(folder)
        name = f"{at}/tokens-{stem}.arrow"
        self.source = pa.memory_map(name) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(name)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def _values(self, batch: int, column: int) -> pa.Array:
        return self.reader.get_batch(batch).column(column).flatten()

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of sequence ``i`` (a view) and its mask (unpacked from bits)."""
        batch, row = divmod(i, BATCH)
        part = slice(row * self.length, (row + 1) * self.length)
        return (self._values(batch, 0)[part].to_numpy(), self._values(batch, 1)[part].to_numpy(zero_copy_only=False))

    def ids(self, first: int, n: int) -> list[np.ndarray]:
        """``n`` ids from ``first`` on: a view for each batch they stand in."""
        out, step = [], BATCH * self.length
        while n > 0:
            batch, a = divmod(first, step)
            got = self._values(batch, 0).slice(a, min(n, step - a)).to_numpy()
            out.append(got)
            first, n = first + len(got), n - len(got)
        return out


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)
        for files in batches:
            for file in files.to_pylist():
                tokens = TokenFile(folder, file["stem"])
                with fs.open_input_file(f"{at}/documents-{file['stem']}.arrow") as source:
                    documents = pa.ipc.open_file(source)
                    for k in range(documents.num_record_batches):
                        docs = documents.get_batch(k)
                        for a, b in slices(docs.column("n_tokens").to_numpy(), 1 << 20):
                            first, n = (docs.column(c).to_numpy()[a:b] for c in ("first", "n_tokens"))
                            ids = np.concatenate(tokens.ids(int(first[0]), int(n.sum()))).astype("<u4")
                            offsets = np.append(0, np.cumsum(n * 4))
                            packed = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
                            yield pa.record_batch([docs.column("doc_id").slice(a, b - a), pa.array(file["start"] + first), pa.array(n), packed.cast(pa.binary())],
                                                  names=["doc_id", "start", "n_tokens", "ids"])
        give_back()

    return run


def read(spark: SparkSession, folder: str, id_type: T.DataType = T.LongType()) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document from the files; ``start`` counts the ids of all documents before
    it, ``ids`` are packed as little-endian unsigned 32-bit integers."""
    files = manifest(spark, folder).select("stem", "start")
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return files.repartition(max(1, files.count())).mapInArrow(_reader(folder), schema)
