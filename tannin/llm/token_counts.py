"""Token counts of whole texts.

Texts are encoded in Arrow functions that return lengths only.  Rows go to the
tokenizer in batches of about ``batch_bytes`` of text, so one very long text does not
share a batch with many others, and a longer text is split where no token can lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tannin.llm.word_ids import word_ids
from tannin.llm.words import documents_of, segment_sums, sliced, split_words

BATCH_BYTES = 4 << 20
#: Texts longer than this are cut for tokenizers that keep white space.
LONG_TEXT = 1 << 16
#: A space between two words: no token lies across the place before it.
_BOUNDARY = re.compile(r"(?<=[^\s])(?= [A-Za-z])")


def split_long(text: str, limit: int = LONG_TEXT, drop: bool = False) -> list[str]:
    """Cut a text before single spaces into pieces of about ``limit`` characters.

    A stretch without such a place stays whole.  With ``drop`` the space at a cut goes, for
    tokenizers that put one before each text.
    """
    pieces, start = [], 0
    while len(text) - start > limit:
        found = _BOUNDARY.search(text, start + limit)
        if not found:
            break
        pieces.append(text[start:found.start()])
        start = found.start() + drop
    return [*pieces, text[start:]]


def _drops_white_space(tokenizer) -> bool:
    cut = tokenizer.pre_tokenizer and tokenizer.pre_tokenizer.pre_tokenize_str("a b")
    return bool(cut) and [piece for piece, _ in cut] == ["a", "b"]


class _ByWord:
    """Tokenizers that drop white space: every distinct word is encoded once."""

    def __init__(self, path: str):
        self.coder = word_ids(path)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        words = split_words(texts)
        distinct, index = words.distinct()
        lengths = self.coder.lengths(self.coder.slots_of(distinct))
        return segment_sums(lengths[index], words.offsets)


class _ByText:
    """Other tokenizers: whole texts, long ones in pieces."""

    def __init__(self, encode_lengths, drop: bool = False):
        self.encode_lengths, self.drop = encode_lengths, drop

    def __call__(self, texts: pa.Array) -> np.ndarray:
        pieces = [split_long(t or "", drop=self.drop) for t in texts.to_pylist()]
        flat = [p for each in pieces for p in each]
        offsets = np.cumsum([0, *map(len, pieces)])
        return segment_sums(np.array(self.encode_lengths(flat), np.int64), offsets)


_COUNTERS: dict[str, object] = {}


def _counter(path: str):
    if path not in _COUNTERS:
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            _COUNTERS[path] = _ByText(lambda texts: [
                len(ids) for ids in processor.encode(texts, num_threads=1)], drop=True)
        else:
            coder = word_ids(path)
            _COUNTERS[path] = _ByWord(path) if _drops_white_space(coder.tokenizer) else _ByText(
                lambda texts: [len(c) for c in coder.tokenizer.encode_batch_fast(
                    texts, add_special_tokens=False)])
    return _COUNTERS[path]


def token_counts(
    docs: DataFrame, tokenizer: str, batch_bytes: int = BATCH_BYTES, limit: int = 2048
) -> DataFrame:
    """Bytes and tokens of every document.

    ``tokenizer`` is a ``.json`` file of the tokenizers library or a ``.model`` file of
    sentencepiece, readable on every executor.  No tokens are added; special strings
    inside texts are handled as the library does by default.

    Result: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), a row per row of
    ``docs``: repeated rows and null ids are kept as they are.  Null and empty texts have
    0 bytes and 0 tokens.  Other columns of ``docs`` are not read.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in sliced(batches, "text", batch_bytes):
            counted = pa.array(counter(batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), counted],
                ["doc_id", "n_bytes", "n_tokens"])

    read = documents_of(docs, "doc_id", "text").withColumn(
        "n_bytes", F.octet_length("text").cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = read.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
