"""Ids of words from a tokenizer file, each distinct word encoded once.

Safe boundaries: the tokenizer drops white space before it cuts texts into tokens, and
its special strings hold none, so the ids of a text are those of its words one after
another.  A run of letters and the marks .,;:!? after it never share a token either.
`tests/llm` holds both against whole-text encoding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MARKS = ".,;:!?"
#: Words encoded in one call of the library.
LOT = 2000


class IdStore:
    """Id lists one after another; list k is flat[starts[k]:starts[k + 1]]."""

    def __init__(self):
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def append(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, np.asarray(ids, np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts, dtype=np.int64)])

    def counts(self, slots: np.ndarray) -> np.ndarray:
        return self.starts[slots + 1] - self.starts[slots]

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists in ``slots`` one after another, and the length of each."""
        begin, counts = self.starts[slots], self.counts(slots)
        ends = np.cumsum(counts)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + counts, counts)
        return self.flat[places], counts


class WordIds:
    """Ids of words, remembered for up to ``max_words`` words.

    When that is reached, words that were asked for only once are forgotten, and more of
    them if those that are left exceed half of the room.  So the memory is bounded, and
    common words are not encoded again; no result depends on it.
    """

    def __init__(self, tokenizer, max_words: int = 1_000_000):
        self.tokenizer, self.max_words = tokenizer, max_words
        suffix = tokenizer.model.end_of_word_suffix or ""
        vocabulary = tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.slots: dict[str, int] = {}
        self.of_words = IdStore()
        self.asked = np.zeros(0, np.int32)  # how often, by slot
        self._forget_parts()

    def _forget_parts(self) -> None:
        self.parts: dict[str, int] = {"": 0}
        self.of_parts = IdStore()
        self.of_parts.append([], [0])

    def forget(self) -> None:
        """Keep the words asked for most often, no more than half of the room."""
        least = 2
        while np.count_nonzero(self.asked >= least) > self.max_words // 2:
            least *= 2
        kept = np.flatnonzero(self.asked >= least)
        names = list(self.slots)
        ids, counts = self.of_words.gather(kept)
        self.slots = {names[k]: slot for slot, k in enumerate(kept.tolist())}
        self.of_words = IdStore()
        self.of_words.append(ids, counts)
        self.asked = np.zeros(len(kept), np.int32)
        self._forget_parts()

    def slots_of(self, words: pa.Array) -> np.ndarray:
        """The place of each distinct word in ``of_words``; new words are encoded."""
        words = words.to_numpy(zero_copy_only=False)
        if len(self.slots) + len(words) > self.max_words:
            self.forget()
        found = list(map(self.slots.get, words))
        fresh = [w for w, slot in zip(words, found) if slot is None]
        if fresh:
            self._encode(fresh)
            found = map(self.slots.__getitem__, words)
        found = np.fromiter(found, np.int64, len(words))
        self.asked[found] += 1
        return found

    def lengths(self, slots: np.ndarray) -> np.ndarray:
        return self.of_words.counts(slots)

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in ``slots`` one after another, and the number of each."""
        return self.of_words.gather(slots)

    def _encode(self, words: list[str]) -> None:
        cut: list[str] = []
        letters: dict[str, None] = {}
        others: dict[str, None] = {}
        for word in words:
            stem = word.rstrip(MARKS)
            if stem.isalpha():
                marks = word[len(stem):]
                if stem.isascii():
                    stem = stem.lower()
                if stem not in self.parts:
                    letters[stem] = None
            else:
                stem, marks = word, ""
                if stem not in self.parts:
                    others[stem] = None
            if marks and marks not in self.parts:
                others[marks] = None
            cut += (stem, marks)
        self._encode_letters(list(letters))
        self._encode_each(list(others))
        parts = np.fromiter(map(self.parts.__getitem__, cut), np.int64, len(cut))
        ids, counts = self.of_parts.gather(parts)
        self.slots.update(zip(words, range(len(self.slots), len(self.slots) + len(words))))
        self.of_words.append(ids, counts[0::2] + counts[1::2])
        self.asked = np.concatenate([self.asked, np.zeros(len(words), np.int32)])

    def _add_parts(self, parts: list[str], ids, counts) -> None:
        self.parts.update(zip(parts, range(len(self.parts), len(self.parts) + len(parts))))
        self.of_parts.append(ids, counts)

    def _encode_each(self, words: list[str]) -> None:
        if not words:
            return
        coded = [c.ids for c in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self._add_parts(words, [i for ids in coded for i in ids], list(map(len, coded)))

    def _encode_letters(self, words: list[str]) -> None:
        """Words of letters only, joined by spaces: each ends with a word-end token.

        Where the ends do not add up, a word has become several, and each is encoded alone.
        """
        ids, counts = [], []
        for at in range(0, len(words), LOT):
            lot = words[at:at + LOT]
            got = np.array(self.tokenizer.encode_batch_fast(
                [" ".join(lot)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends_word[got]) + 1
            if len(ends) == len(lot) and ends[-1] == len(got):
                ids.append(got)
                counts.append(np.diff(ends, prepend=0))
            else:
                coded = [c.ids for c in self.tokenizer.encode_batch_fast(lot, add_special_tokens=False)]
                ids.append(np.array([i for each in coded for i in each], np.int64))
                counts.append(np.array(list(map(len, coded)), np.int64))
        if ids:
            self._add_parts(words, np.concatenate(ids), np.concatenate(counts))


_KNOWN: dict[str, WordIds] = {}


def word_ids(tokenizer_path: str) -> WordIds:
    """The coder of this worker process for a tokenizer file."""
    if tokenizer_path not in _KNOWN:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _KNOWN[tokenizer_path] = WordIds(tokenizer)
    return _KNOWN[tokenizer_path]
