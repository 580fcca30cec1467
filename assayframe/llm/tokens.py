"""Token ids of whole texts, word by word."""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Iterable
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

# Words remembered with their ids, in two generations of this many; about 80 MB each.
REMEMBERED = 300_000
# Words encoded side by side, and what the vocabulary has at the end of a word.
JOINED, WORD_END = 200, "</w>"
# Text that is parted into words at once, so that a word is looked up once in it.
BLOCK_BYTES = 8 << 20


class WordEncoder:
    """Ids by a tokenizer that drops white space, so that the ids of a text are those
    of its words side by side. Words seen lately are not encoded again.

    Ids come as little-endian bytes, of two bytes each if the vocabulary allows.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        # The same vocabulary and merges for words that are a piece already.
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @property
    def dtype(self) -> str:
        return "<u2" if self.kind == "H" else "<u4"

    def id_bytes(self, ids: Iterable[int]) -> bytes:
        packed = array(self.kind, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _learn(self, new: list[str]) -> None:
        """Put the ids of these words into ``recent``."""
        # Marks at the end, after a letter, are a piece of their own.
        heads = {}
        for word in new:
            if not word[-1:].isalnum():
                head = word.rstrip(punctuation)
                if head != word and head[-1:].isalpha() and "<|" not in word:
                    heads[word] = head
        asked = {heads.get(w, w) for w in new} | {w[len(head) :] for w, head in heads.items()}
        plain, others = [], []
        for word in asked.difference(self.recent):
            (plain if self._is_piece(word) else others).append(word)
        others += self._learn_pieces([plain[i : i + JOINED] for i in range(0, len(plain), JOINED)])
        for word, found in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            self.recent[word] = self.id_bytes(found.ids)
        for word, head in heads.items():
            self.recent[word] = self.recent[head] + self.recent[word[len(head) :]]

    @staticmethod
    def _is_piece(text: str) -> bool:
        """Whether a word is one run of letters that the tokenizer leaves as it is."""
        return text.isalpha() and text.lower() == text and (text.isascii() or is_normalized("NFC", text))

    def _learn_pieces(self, groups: list[list[str]]) -> list[str]:
        """Encode runs of letters side by side, which is cheaper, and part their ids
        behind each that ends a word. Returns the words where that can't be right."""
        texts = [" ".join(words) for words in groups]
        left = []
        for words, found in zip(groups, self.pieces.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, dtype=self.dtype)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * ids.itemsize
            if len(ends) != len(words):
                left += words
                continue
            data, start = ids.tobytes(), 0
            for word, end in zip(words, ends.tolist()):
                self.recent[word] = data[start:end]
                start = end
        return left

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of each of these different words."""
        if len(self.recent) > REMEMBERED:
            self.older, self.recent = self.recent, {}
        found = [*map(self.recent.get, words)]
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            ids = self.older.get(words[i])
            if ids is None:
                new.append(words[i])
            else:
                self.recent[words[i]] = ids
        self._learn(new)
        for i in missing:
            found[i] = self.recent[words[i]]
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; none of a null one."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        # The tokenizer lower-cases anyway, but not the names of special tokens.
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(lower)
        words = split.flatten().dictionary_encode()
        known = pa.array(self._ids_of(words.dictionary.to_pylist()), pa.large_binary())
        flat = known.take(words.indices)
        bounds = split.offsets.to_numpy()
        ends = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, 8 * flat.offset)[bounds - bounds[0]].tolist()
        data = memoryview(flat.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:])]


_encoders: dict[int, WordEncoder] = {}


def encoder_of(definition: str) -> WordEncoder:
    """One encoder per Python process, so that tasks share what it remembers."""
    key = hash(definition)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(definition)
    return _encoders[key]


def read_definition(path: str) -> str:
    """A tokenizer's file, read by the driver and sent to the tasks."""
    with open(path, encoding="utf-8") as file:
        return file.read()
