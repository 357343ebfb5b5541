"""Token ids as Arrow stream files of fixed-size lists.

A shard holds the ids of a range of doc_ids, in ascending order, as record batches
of two columns: `ids`, fixed_size_list<uint16 or uint32>[length], and `mask`,
fixed_size_list<uint8>[length / 8], a bit for each place, lowest first, 1 for real
ids (only a shard's last sequence is padded).  Buffers are uncompressed, so sequence i of a memory-mapped shard is a
view of the file: no copy, no parsing.  Beside each shard lies a small Arrow
stream with the doc_id, first id and number of ids of its documents.

Null texts count as empty (they hold the end id alone), null doc_ids come first,
repeated doc_ids each keep their own row (ties in the order of their texts),
other columns are not read, an empty table gives no shard.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_bytes, record_batch, scratch_path, shuffle_partitions, staged, table
from .tokens import load, tokenizer_path

LENGTH = 1024
#: Text in a shard, and documents.
SHARD_BYTES, SHARD_ROWS = 64_000_000, 1_000_000
#: Documents whose index entries are held before they are written.
INDEX_ROWS = 50_000
#: Sequences in a record batch.
GROUP = 256
INDEX = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
SHARD = pa.schema([("shard", pa.string()), ("number", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def sequence_schema(bits: int, length: int) -> pa.Schema:
    kind = pa.uint16() if bits == 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), -(-length // 8)))])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Appends documents to a shard; memory holds one record batch of sequences and INDEX_ROWS entries of the index."""

    def __init__(self, uri: str, bits: int, length: int):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.schema, self.length = sequence_schema(bits, length), length
        self.kind = np.uint16 if bits == 16 else np.uint32
        self.out = self.fs.open_output_stream(self.path)
        self.writer = pa.ipc.new_stream(self.out, self.schema)
        self.docs_out = self.fs.open_output_stream(self.path + ".docs")
        self.docs = pa.ipc.new_stream(self.docs_out, INDEX)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_docs = 0
        self.index: list[tuple[int, int, int]] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.n_ids, len(ids)))
        self.n_ids += len(ids)
        self.n_docs += 1
        if len(self.index) >= INDEX_ROWS:
            self.docs.write_batch(record_batch(INDEX, self.index))
            self.index = []
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        if self.n_held >= GROUP * self.length:
            self._flush(self.n_held // self.length * self.length)

    def _flush(self, n: int, padding: int = 0) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        now, rest = flat[:n], flat[n:]
        self.held, self.n_held = [rest], len(rest)
        if n + padding:
            ids = np.concatenate([now, np.zeros(padding, self.kind)])
            real = np.ones(n + padding, np.uint8)
            real[n:] = 0
            mask = np.packbits(real.reshape(-1, self.length), axis=1, bitorder="little")
            for at in range(0, len(mask), GROUP):
                part = ids[at * self.length : (at + GROUP) * self.length], mask[at : at + GROUP].ravel()
                columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), f.type.list_size) for x, f in zip(part, self.schema, strict=True)]
                self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(self.n_held, -self.n_held % self.length)
        self.writer.close()
        self.out.close()
        if self.index:
            self.docs.write_batch(record_batch(INDEX, self.index))
        self.docs.close()
        self.docs_out.close()


class ShardReader:
    """Random access to a shard: sequences and documents as numpy views of the mapped file where the file system allows it."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_stream(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.batches = [(b.column(0).flatten().to_numpy(zero_copy_only=True), b.column(1).flatten().to_numpy(zero_copy_only=True)) for b in self.reader]
        self.starts = np.cumsum([0, *(len(ids) for ids, _ in self.batches)])
        docs = fs.open_input_file(path + ".docs")
        self.docs = pa.ipc.open_stream(docs).read_all()

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the packed mask of a sequence, as views."""
        k = int(np.searchsorted(self.starts, i * self.length, side="right")) - 1
        at, wide = i - int(self.starts[k]) // self.length, -(-self.length // 8)
        return self.batches[k][0][at * self.length : (at + 1) * self.length], self.batches[k][1][at * wide : (at + 1) * wide]

    def ids(self, first: int, n: int) -> np.ndarray:
        k = int(np.searchsorted(self.starts, first, side="right")) - 1
        out = []
        while n > 0:
            part = self.batches[k][0][first - self.starts[k] :][:n]
            out.append(part)
            first, n, k = first + len(part), n - len(part), k + 1
        return out[0] if len(out) == 1 else np.concatenate(out)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, mode: str, end_id: int, bits: int = 16, length: int = LENGTH) -> DataFrame:
    """Writes the shards (eagerly) and returns one row per shard: shard (URI), number, n_docs, n_ids.

    Shard number is the place of its range of (doc_id, hash of the text), so that
    rows that share a doc_id, or have none, are more than one shard's.  A task writes under a name of
    its own attempt and the row that it returns says which file counts, so a task
    that is run again, or twice at once, does no harm.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long")).alias("bytes"), F.count("*").alias("rows")).first()
    parts = max(shuffle_partitions(spark), 8, (size["bytes"] or 0) // SHARD_BYTES, size["rows"] // SHARD_ROWS)  # a shard and its index stay small however large the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer = TaskContext.get(), None
        tokenizer = load(vocabulary, mode)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1).cast(pa.string())), strict=True):
                if writer is None:
                    uri = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
                    writer = ShardWriter(uri, bits, length)
                writer.add(k, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            yield record_batch(SHARD, [(uri, task.partitionId(), writer.n_docs, writer.n_ids)])

    order = [F.col("k").asc_nulls_first(), F.col("h")]
    ordered = doc_bytes(docs).withColumn("h", F.xxhash64("t")).repartitionByRange(parts, *order).sortWithinPartitions(*order, "t").drop("h")
    return staged(ordered.mapInArrow(run, "shard string, number int, n_docs long, n_ids long"), "shards")


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_token_files(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = F.sum("n_ids").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1))  # a row per shard
    based = shards.select("shard", F.coalesce(before, F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard, out = ShardReader(uri), []
                for docs in shard.docs.to_batches():
                    for k, first, n in zip(*(c.to_pylist() for c in docs.columns), strict=True):
                        out.append((k, start + first, n, zlib.crc32(shard.ids(first, n).astype("<u4").tobytes())))
                        if len(out) == 8192:
                            yield record_batch(READ, out)
                            out = []
                yield record_batch(READ, out)

    return based.repartition(max(1, shards.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"), tokenizer_path("word_bpe_49k.json"), "space", end_id=2)
    return read_token_files(shards)
