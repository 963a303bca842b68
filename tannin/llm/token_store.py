"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents as blocks of 128.  Of each block the
minimum is subtracted, the rest is packed at the width that a given share of the block
fits into, and the outliers follow as a list of positions and full values.  A table of
block starts gives access to any block; a table of documents gives their ends.

    MAGIC | blocks | table of blocks | table of documents | two lengths | MAGIC

Block: 16 bytes per bit of width, then 5 bytes per exception (position, u32 value).
Both tables are Arrow streams.  A short last block is filled up with its minimum.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tannin.llm.word_ids import word_ids
from tannin.llm.words import documents_of, segment_sums, sliced, split_words
from tannin.sources import sinks

MAGIC = b"TPFOR001"
BLOCK = 128
#: Share of a block that its width must hold; the rest are exceptions.
PERCENTILE = 0.9
BATCH_BYTES = 4 << 20
_LENGTHS = np.array([int(i).bit_length() for i in range(1 << 16)], np.uint8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    high = values >> 16
    return np.where(high > 0, _LENGTHS[high] + 16, _LENGTHS[values & 0xFFFF]).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values as rows of bytes, ``width`` bits a value."""
    whole = values.astype("<u2" if width <= 16 else "<u4")
    bits = np.unpackbits(whole.view(np.uint8), axis=1, bitorder="little")
    bits = bits.reshape(len(values), BLOCK, -1)[:, :, :width]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    size = 16 if width <= 16 else 32
    bits = np.zeros((len(packed), BLOCK, size), np.uint8)
    bits[:, :, :width] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, width)
    whole = np.packbits(bits.reshape(len(packed), -1), axis=1, bitorder="little")
    return whole.view("<u2" if size == 16 else "<u4").astype(np.uint32)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE):
    """Whole blocks of ids as bytes; also base, width and byte length of each block."""
    rows = ids.astype(np.uint32).reshape(-1, BLOCK)
    base = rows.min(axis=1)
    rest = rows - base[:, None]
    lengths = bit_lengths(rest)
    at = min(BLOCK, max(1, int(np.ceil(percentile * BLOCK)))) - 1
    width = np.partition(lengths, at, axis=1)[:, at].astype(np.int64)
    outlier = lengths > width[:, None]
    block, position = np.nonzero(outlier)
    count = outlier.sum(axis=1)
    size = 16 * width + 5 * count
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    kept = np.where(outlier, 0, rest)
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        out[starts[of][:, None] + np.arange(16 * w)] = _pack(kept[of], w)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    to = starts[block] + 16 * width[block] + 5 * nth
    out[to] = position
    out[to[:, None] + np.arange(1, 5)] = rest[block, position].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, base, width.astype(np.uint8), size


def decode_blocks(data: np.ndarray, starts: np.ndarray, base: np.ndarray, width: np.ndarray,
                  size: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``data``."""
    width, size = width.astype(np.int64), size.astype(np.int64)
    rest = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        rest[of] = _unpack(data[starts[of][:, None] + np.arange(16 * w)], w)
    count = (size - 16 * width) // 5
    block = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[block] + 16 * width[block] + 5 * nth
    rest[block, data[at]] = data[at[:, None] + np.arange(1, 5)].copy().view("<u4").ravel()
    return (rest + base.astype(np.uint32)[:, None]).ravel()


class StoreWriter:
    """Writes one file; ids arrive in lists, whole blocks leave at once."""

    def __init__(self, out, percentile: float = PERCENTILE):
        self.out, self.percentile, self.at = out, percentile, len(MAGIC)
        self.rest, self.total = np.zeros(0, np.uint32), 0
        self.blocks: list[pa.RecordBatch] = []
        self.docs: list[pa.RecordBatch] = []
        out.write(MAGIC)

    def add(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their ids one after another."""
        self.docs.append(pa.RecordBatch.from_arrays(
            [doc_ids, pa.array(counts, pa.int64())], ["doc_id", "n_tokens"]))
        self.total += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        self.rest = ids[whole:].astype(np.uint32)
        self._flush(ids[:whole])

    def _flush(self, ids: np.ndarray) -> None:
        if len(ids):
            data, base, width, size = encode_blocks(ids, self.percentile)
            starts = self.at + np.cumsum(size) - size
            self.out.write(data.tobytes())
            self.at += len(data)
            self.blocks.append(pa.RecordBatch.from_arrays(
                [pa.array(starts, pa.int64()), pa.array(base, pa.uint32()),
                 pa.array(width, pa.uint8()), pa.array(size.astype(np.int32))],
                ["start", "base", "width", "size"]))

    def close(self) -> None:
        if len(self.rest):
            self._flush(np.concatenate(
                [self.rest, np.full(BLOCK - len(self.rest), self.rest.min(), np.uint32)]))
        sizes = []
        for batches in (self.blocks, self.docs):
            sink = io.BytesIO()
            if batches:
                with pa.ipc.new_stream(sink, batches[0].schema) as stream:
                    for batch in batches:
                        stream.write_batch(batch)
            self.out.write(sink.getvalue())
            sizes.append(sink.tell())
        self.out.write(struct.pack("<QQ", *sizes) + MAGIC)


class StoreReader:
    """Access to one file: documents, and any range of ids by the block starts."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        source.seek(end - 24)
        *sizes, magic = struct.unpack("<QQ8s", source.read(24))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(end - 24 - sum(sizes))
        self.blocks, self.docs = (self._table(source.read(n)) for n in sizes)

    @staticmethod
    def _table(data: bytes):
        return pa.ipc.open_stream(data).read_all() if data else None

    def ids(self, first: int, stop: int) -> np.ndarray:
        """Ids first to stop - 1 of the file; only their blocks are read."""
        if stop <= first:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, (stop - 1) // BLOCK + 1
        starts, base, width, size = (
            self.blocks.column(c).slice(a, b - a).to_numpy() for c in ("start", "base", "width", "size"))
        self.source.seek(int(starts[0]))
        data = np.frombuffer(self.source.read(int(starts[-1] + size[-1] - starts[0])), np.uint8)
        ids = decode_blocks(data, starts - starts[0], base, width, size)
        return ids[first - a * BLOCK:stop - a * BLOCK]


def _files(folder: str):
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") \
        else (fs.LocalFileSystem(), folder)


def write_store(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2,
                percentile: float = PERCENTILE) -> DataFrame:
    """Encode every whole text and write files of ids in ascending order of doc_id.

    Rows are dealt by ranges of doc_id (null first; rows of one doc_id by a hash of their
    texts, so a frequent id spreads as well) and sorted; each task writes a file of its own
    into ``folder``, a folder that all executors share (by default a new one in
    ``spark.checkpoint.dir``).  ``tokenizer`` must drop white space.  ``end_id`` follows
    each document; a null or empty text has only that.

    Result: the stored list of files (shard, file, n_docs, n_ids), to be given to
    ``read_store``.  A repeated task writes another file; only listed files count.
    """
    folder = folder or sinks.scratch_path(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer, n_docs = word_ids(tokenizer), None, 0
        shard = TaskContext.get().partitionId()
        files, root = _files(folder)
        path = f"{root.rstrip('/')}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        for batch in sliced(batches, "text", BATCH_BYTES):
            if writer is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(path)
                writer = StoreWriter(out, percentile)
            words = split_words(batch.column("text"))
            distinct, index = words.distinct()
            flat, counts = coder.gather(coder.slots_of(distinct)[index])
            sizes = segment_sums(counts, words.offsets)
            ids = np.insert(flat, np.cumsum(sizes), np.uint32(end_id))
            writer.add(batch.column("doc_id"), sizes + 1, ids)
            n_docs += len(sizes)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "file": path, "n_docs": n_docs, "n_ids": writer.total}],
                pa.schema([("shard", pa.int32()), ("file", pa.string()),
                           ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = documents_of(docs, "doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    listed = dealt.mapInArrow(write, "shard int, file string, n_docs long, n_ids long")
    return sinks.materialize(listed)


def read_store(files: DataFrame, kind: str = "long", folder: str | None = None) -> DataFrame:
    """Documents of the listed files.

    Result: doc_id (of type ``kind``), start (ids of all documents before it), n_tokens,
    ids (binary: little-endian unsigned 32-bit ids), in file order within a partition.
    """
    before = F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    placed = files.select("shard", "file", F.coalesce(before, F.lit(0)).alias("first"))
    # a file per task; the list has a row per file
    placed = placed.repartitionByRange(max(1, files.rdd.getNumPartitions()), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = _files(row["file"])
                with files.open_input_file(path) as source:
                    store = StoreReader(source)
                    if store.docs is None:
                        continue
                    counts = store.docs.column("n_tokens").to_numpy()
                    ends = np.concatenate([[0], np.cumsum(counts)])
                    doc_ids = store.docs.column("doc_id").combine_chunks()
                    at = 0
                    while at < len(counts):
                        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 20), "right")) - 1)
                        ids = store.ids(int(ends[at]), int(ends[stop])).astype("<u4")
                        sizes = (ends[at:stop + 1] - ends[at]) * 4
                        data = pa.Array.from_buffers(
                            pa.large_binary(), stop - at,
                            [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(ids)])
                        yield pa.RecordBatch.from_arrays(
                            [doc_ids.slice(at, stop - at), pa.array(ends[at:stop] + row["first"]),
                             pa.array(counts[at:stop]), data.cast(pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"])
                        at = stop

    return placed.mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids binary")
