"""Token-id files: Arrow's random-access file format, with record batches of fixed-size lists.

A file holds equal-length sequences of ids and masks (true where an id stands), so a reader maps it and
takes any sequence of any batch by its number, without copying or decoding. A third column indexes the
documents that end in each sequence. Files hold whole documents, in ascending id order; the manifest
lists each file's first document and its numbers of documents and ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.llm.common import shared_tokenizer, stage_path, write_stage

SEQUENCE, BATCH = 2048, 256         # ids of a sequence, sequences of a record batch


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def file_schema(length: int) -> pa.Schema:
    ends = pa.list_(pa.struct([("doc_id", pa.int64()), ("end", pa.int32())]))
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", ends)],
                     metadata={"sequence_length": str(length)})


def _filesystem(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


class SequenceWriter:
    """Cuts documents to sequences and writes them by record batches, holding one batch at a time."""

    def __init__(self, sink, length: int, batch: int) -> None:
        self.length, self.batch, self.schema = length, batch, file_schema(length)
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held, self.size, self.ends = [], 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.ends.append((doc_id, self.size))
        if self.size >= self.length * self.batch:
            self.flush(self.size // self.length)

    def flush(self, sequences: int, last: bool = False) -> None:
        """Writes full sequences, and at the end the rest, filled up with zeros under a false mask."""
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint16)
        full = sequences * self.length
        rest, ids = ids[full:], ids[:full]
        mask = np.ones(len(ids), bool)
        if last and len(rest):
            pad = self.length - len(rest)
            ids = np.concatenate([ids, rest, np.zeros(pad, np.uint16)])
            mask = np.concatenate([mask, np.ones(len(rest), bool), np.zeros(pad, bool)])
            rest, sequences = rest[:0], sequences + 1
        ends = [[] for _ in range(sequences)]
        later = []
        for doc_id, end in self.ends:          # a document ends in the sequence of its last id
            row = (end - 1) // self.length
            (ends[row].append({"doc_id": doc_id, "end": end - row * self.length}) if row < sequences else later.append((doc_id, end - full)))
        for at in range(0, sequences, self.batch):
            n = min(self.batch, sequences - at)
            span = slice(at * self.length, (at + n) * self.length)
            self.out.write_batch(pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(ids[span]), self.length),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask[span]), self.length),
                 pa.array(ends[at:at + n], self.schema.field("ends").type)], schema=self.schema))
        self.held, self.size, self.ends = [rest], len(rest), later

    def close(self) -> None:
        self.flush(self.size // self.length, last=True)
        self.out.close()


def open_sequences(path: str) -> pa.ipc.RecordBatchFileReader:
    """A reader with random access to the batches; a local file is mapped, not read."""
    system, at = _filesystem(path)
    return pa.ipc.open_file(pa.memory_map(at) if system.type_name == "local" else system.open_input_file(at))


def _write(folder: str, tokenizer: str, end_id: int, length: int, batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared_tokenizer(tokenizer, True)
        writer = sink = first = None
        path, docs, ids_total = f"{folder}/{uuid.uuid4().hex}.arrow", 0, 0       # a repeated task writes a file of its own
        for b in batches:
            for doc_id, key, text in zip(*b.columns):
                if writer is None:
                    system, at = _filesystem(path)
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    sink, first = system.open_output_stream(at), (doc_id.as_py(), key.as_py())
                    writer = SequenceWriter(sink, length, batch)
                ids = np.append(tok.encode(text.as_py()), np.uint16(end_id))
                writer.add(doc_id.as_py(), ids)
                docs, ids_total = docs + 1, ids_total + len(ids)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.binary()), pa.array([docs], pa.int64()), pa.array([ids_total], pa.int64())],
                ["path", "first_id", "first_key", "n_docs", "n_ids"])
    return run


def write_token_files(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                      end_id: int = 2, length: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """Writes the files and returns their manifest: path, first_id, first_key, n_docs, n_ids, start (ids
    in all files before).

    A document is its whole text's ids and ``end_id``; a null text is empty. Rows are ordered by id (null
    first), repeated ids by their text's digest, so a repeated id is dealt to as many files as it needs.
    ``folder`` must be shared by all executors; by default it is a new one in the checkpoint folder. The
    manifest names the files of the tasks that counted; a file of a lost attempt is in no manifest.
    """
    spark = docs.sparkSession
    folder = folder or stage_path(spark, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("key"), F.col(text_col).alias("text"))
    sorted_rows = rows.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    manifest = write_stage(sorted_rows.mapInArrow(_write(folder, tokenizer or default_tokenizer(), end_id, length, batch),
                                                  "path string, first_id long, first_key binary, n_docs long, n_ids long"), "token-manifest")
    over = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_key", "path")        # a row per file
    return manifest.withColumn("start", F.sum("n_ids").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            reader, crc, size = open_sequences(path), 0, 0
            for k in range(reader.num_record_batches):
                part = reader.get_batch(k)
                length = part.column(0).type.list_size
                ids = part.column(0).flatten().to_numpy()                   # a view of the mapped file
                mask = part.column(1).flatten().to_numpy(zero_copy_only=False)
                out, at = [], 0
                for row, ends in enumerate(part.column(2).to_pylist()):
                    for e in ends:
                        end = row * length + e["end"]
                        piece = ids[at:end].astype("<u4")
                        size, crc, at = size + len(piece), zlib.crc32(piece.tobytes(), crc), end
                        out.append((e["doc_id"], start, size, crc))
                        start, size, crc = start + size, 0, 0
                rest = ids[at:][mask[at:]].astype("<u4")
                size, crc = size + len(rest), zlib.crc32(rest.tobytes(), crc)
                cols = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the files: start counts the ids of all
    documents before it, the crc32 is of its ids as little-endian unsigned 32-bit integers."""
    files = write_stage(manifest.select("path", "start"), "token-read")
    n = max(1, files.count())
    return files.repartition(n).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes the files and returns what reading them back gives for every document. An empty table
    writes no file and returns no rows; other columns are not read."""
    return read_documents(write_token_files(docs, **options))
