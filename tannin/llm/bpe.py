"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct words of a block of a partition lie one after another in one symbol array.
An index maps each rank of the merge list to all positions of its pair; the active
ranks are applied in ascending order to all their positions at once, and only the lists
of the pairs beside a merged position change.

A tokenizer file states its normalisation (NFC, white space, lower case), its cutting
pattern, the byte alphabet and the merges.  Files with other steps raise ValueError.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tannin.llm.words import byte_slices, documents_of, segment_sums, split_words, tidy

#: Text whose distinct words are merged together; bounds a worker's memory.
BLOCK_BYTES = 12 << 20
#: Text whose ids leave a worker in one Arrow batch.
BATCH_BYTES = 2 << 20


def byte_letters() -> list[str]:
    """A printable character for each byte: itself if printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """The merge list as sorted pair keys, and the merging of many words at once."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]]):
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.size = max(vocabulary.values()) + 1
        self.left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        self.right = np.array([vocabulary[b] for _, b in merges], np.int64)
        self.joined = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        # the first of equal pairs counts
        self.keys, self.ranks = np.unique(self.left * self.size + self.right, return_index=True)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for pairs that never merge."""
        if not len(self.keys):
            return np.full(len(left), -1)
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], -1)

    def apply(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words; word k is symbols[starts[k]:starts[k + 1]].

        Returns the ids that are left and the number of ids of each word.
        """
        symbols, n = symbols.astype(np.int32), len(symbols)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        edges = starts[np.diff(starts, append=n + 1) > 0]  # starts of words, and n
        after[edges[edges > 0] - 1] = -1
        before[edges[edges < n]] = -1

        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(positions: np.ndarray) -> None:
            positions = positions[after[positions] >= 0]
            ranks = self.ranks_of(symbols[positions], symbols[after[positions]])
            known = ranks >= 0
            positions, ranks = positions[known], ranks[known]
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, group in zip(ranks[np.concatenate([[0], cuts])].tolist() if len(ranks) else (),
                                   np.split(positions, cuts)):
                if rank not in lists:
                    lists[rank] = []
                    heapq.heappush(active, rank)
                lists[rank].append(group)

        index(np.arange(n, dtype=np.int32))
        while active:
            rank = heapq.heappop(active)
            held = lists.pop(rank)
            at = np.unique(held[0] if len(held) == 1 else np.concatenate(held))
            a, b = self.left[rank], self.right[rank]
            at = at[symbols[at] == a]
            follow = after[at]
            at = at[(follow >= 0) & (symbols[follow] == b)]
            if a == b and len(at) > 1:
                # of overlapping pairs in a run, the first, third and so on
                runs = np.flatnonzero(np.concatenate([[True], after[at[:-1]] != at[1:]]))
                place = np.arange(len(at)) - np.repeat(runs, np.diff(runs, append=len(at)))
                at = at[place % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbols[at], symbols[gone] = self.joined[rank], -1
            after[at] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            previous = before[at]
            index(np.concatenate([previous[previous >= 0], at[inside]]))
        left = symbols >= 0
        upto = np.concatenate([[0], np.cumsum(left)])
        return symbols[left], np.diff(upto[starts])


class Bpe:
    """Encoding of words by a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, steps = held["model"], held["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in held["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] \
                or [s["type"] for s in steps] != ["Split", "ByteLevel"] or held["decoder"] \
                or not (steps[0]["invert"] and steps[0]["behavior"] == "Removed") \
                or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
            raise ValueError(f"{path} states steps that are not supported")
        self.cut = regex.compile(steps[0]["pattern"]["Regex"])
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") \
            if self.special else None
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.merges = Merges(vocabulary, model["merges"])
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in letters], np.int64)
        names = {i: t for t, i in [*vocabulary.items(), *self.special.items()]}
        self.tokens = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.string())

    def cuts(self, word: str) -> list[str | int]:
        """Pieces of a word that merges stay within, and ids of special strings."""
        if self.special_cut and "<" in word and self.special_cut.search(word):
            pieces: list[str | int] = []
            for part in self.special_cut.split(word):
                if part in self.special:
                    pieces.append(self.special[part])
                else:
                    pieces += self._cut_plain(part)
            return pieces
        return self._cut_plain(word)

    def _cut_plain(self, word: str) -> list[str]:
        if word.isascii():
            word = word.lower()
            return [word] if word.isalpha() else self.cut.findall(word)
        if max(word) > "\u024f" and any(unicodedata.category(c) == "Cn" for c in word):
            # Unicode versions differ on characters this Python does not know
            word = self.library.normalizer.normalize_str(word)
            return [word[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(word)]
        word = unicodedata.normalize("NFC", word)
        # each character alone, so that no letter depends on those beside it
        word = "".join(c.lower() for c in word) if "Σ" in word else word.lower()
        return self.cut.findall(word)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and the number of each."""
        places: dict[str, int] = {}
        held: list[int] = []  # pieces by place; special strings as -1 - id
        counts = []
        for word in words:
            pieces = self.cuts(word)
            counts.append(len(pieces))
            for piece in pieces:
                held.append(-1 - piece if isinstance(piece, int)
                            else places.setdefault(piece, len(places)))
        encoded = [p.encode() for p in places]
        raw = np.frombuffer(b"".join(encoded), np.uint8)
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)))])
        symbols = self.inner[raw]
        symbols[starts[1:] - 1] = self.last[raw[starts[1:] - 1]]
        ids, sizes = self.merges.apply(symbols, starts)
        # a special string is a piece of one id
        held = np.array(held, np.int64)
        extra = np.flatnonzero(held < 0)
        begin = np.concatenate([np.cumsum(sizes) - sizes, len(ids) + np.arange(len(extra))])
        sizes = np.concatenate([sizes, np.ones(len(extra), np.int64)])
        ids = np.concatenate([ids, -1 - held[extra]])
        held[extra] = len(places) + np.arange(len(extra))
        lengths = sizes[held]
        ends = np.cumsum(lengths)
        flat = ids[np.arange(ends[-1] if len(ends) else 0)
                   + np.repeat(begin[held] - ends + lengths, lengths)]
        offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return flat, segment_sums(lengths, offsets)

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of id lists: token strings joined by spaces, special ones kept."""
        values = ids.flatten()
        if len(values) and not 0 <= pc.min(values).as_py() <= pc.max(values).as_py() < len(self.tokens):
            raise ValueError("an id is not in the vocabulary")
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.tokens.take(values)), " ")


_KNOWN: dict[str, Bpe] = {}


def _bpe(path: str) -> Bpe:
    if path not in _KNOWN:
        _KNOWN[path] = Bpe(path)
    return _KNOWN[path]


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in batches of about ``BLOCK_BYTES`` of text."""
    held, size = [], 0
    for batch in batches:
        for start, stop in byte_slices(batch.column("text"), BLOCK_BYTES // 4):
            piece = batch.slice(start, stop - start)
            bytes_of = pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
            if held and size + bytes_of > BLOCK_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(piece)
            size += bytes_of
    if held:
        yield pa.concat_batches(held)


def encode(docs: DataFrame, tokenizer: str, decoded: bool = False) -> DataFrame:
    """Token ids of every whole text, nothing added.

    Result: doc_id, n_tokens, ids (array of int), a row per row of ``docs``; other
    columns are not read.  Null and empty texts have an empty list.  With ``decoded`` the
    same worker decodes the ids again, into a column of that name.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer)
        for block in _blocks(batches):
            words = split_words(block.column("text"))
            distinct, index = words.distinct()
            ids, counts = bpe.encode(distinct.to_pylist())
            begin = np.cumsum(counts) - counts
            for start, stop in byte_slices(block.column("text"), BATCH_BYTES):
                lo, hi = words.offsets[start], words.offsets[stop]
                lengths = counts[index[lo:hi]]
                ends = np.cumsum(lengths)
                total = int(ends[-1]) if len(ends) else 0
                flat = ids[np.arange(total) + np.repeat(begin[index[lo:hi]] - ends + lengths, lengths)]
                sizes = segment_sums(lengths, words.offsets[start:stop + 1] - lo)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
                found = {"doc_id": block.column("doc_id").slice(start, stop - start),
                         "n_tokens": pa.array(sizes, pa.int64()), "ids": lists}
                if decoded:
                    found["decoded"] = bpe.decode(lists)
                yield pa.RecordBatch.from_pydict(found)
            del block, words, distinct, index, ids, lists, found
            pa.default_memory_pool().release_unused()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return documents_of(docs, "doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of ``encoded`` with the text of their ids as column ``decoded``.

    Null lists give an empty text; an id outside the vocabulary raises.
    """
    schema = T.StructType([*encoded.schema, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer)
        for batch in tidy(batches):
            ids = batch.column("ids")
            step = max(1, len(ids) // 8)
            for start in range(0, len(ids), step):
                piece = batch.slice(start, step)
                decoded = bpe.decode(piece.column("ids"))
                yield pa.RecordBatch.from_arrays([*piece.columns, decoded], [*piece.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
