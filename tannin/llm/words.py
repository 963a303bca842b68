"""Words of whole texts as Arrow arrays, and batches balanced by bytes.

A word is a maximal run of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The same words as a pattern for SQL expressions.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def text_column(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case and every other character as it is."""
    return F.translate(column, UPPER, LOWER)


def word_count(column: Column) -> Column:
    """Number of words as a JVM expression, 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass
class WordLists:
    """Words of several texts: those of text i are words[offsets[i]:offsets[i + 1]]."""

    offsets: np.ndarray
    words: pa.Array

    def distinct(self) -> tuple[pa.Array, np.ndarray]:
        """Distinct words, and for each word the index of its distinct word."""
        coded = self.words.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)

    def lists(self, values: pa.Array) -> pa.Array:
        """A value per word as one list per text."""
        return pa.LargeListArray.from_arrays(pa.array(self.offsets), values)


def split_words(texts: pa.Array) -> WordLists:
    """Words of each text; null texts have none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
    # a space at either end of a text leaves an empty string
    kept = np.asarray(pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False), bool)
    upto = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
    offsets = upto[np.concatenate([[0], ends])]
    if not kept.all():
        words = words.filter(pa.array(kept))
    return WordLists(offsets, words)


def byte_slices(texts: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``max_bytes`` of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > max_bytes:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def sliced(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches balanced by the bytes of their texts."""
    for batch in batches:
        for start, stop in byte_slices(batch.column(text), max_bytes):
            yield batch.slice(start, stop - start)


# glibc only; numpy's arrays lie in malloc's memory
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at their end the free memory of Arrow and of malloc goes back to the system.

    Workers are kept between tasks, and what one holds unused is missing to the next stage.
    """
    yield from batches
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]], 0 for empty ranges."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def documents_of(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, the text never null."""
    return df.select(*(text_column(c).alias(c) if c == "text" else F.col(c) for c in columns))
