"""Token ids of whole texts with a public tokenizer, batch by batch inside tasks.

The vocabulary splits at white space first, so a text's ids are those of its blank-separated words in
order. A batch is split and its distinct words found by Arrow; only words not met before by this worker
reach the tokenizer. The ids equal those of encoding the text at once (tested over whole tables).
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept per worker; beyond that the memory starts anew.
MEMO_WORDS = 300_000
#: Bytes of text tokenised at once.
SLICE_BYTES = 4 << 20

_PUNCT = string.punctuation.replace("'", "")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class WordEncoder:
    """Ids of words, remembered in one pool of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.symbols = _byte_symbols()
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.parts: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.starts = np.zeros(1 << 16, np.int32)
        self.lengths = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _plain(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def _letters(self, word: str) -> bytes | None:
        """Ids of a run of letters that no normalisation but lower case changes; None for other words."""
        if not word.isalpha():
            return None
        if word.isascii():
            low = word.lower()
        elif max(word) < "ɐ" and "İ" not in word:
            low = "".join([self.symbols[b] for b in word.lower().encode()])
        else:
            return None
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(low)])

    def ids(self, word: str) -> bytes:
        """The word's ids as little-endian 32-bit numbers."""
        core = word.rstrip(_PUNCT)
        ids = self.parts.get(core)
        if ids is None:
            if "<|" not in word:
                ids = self._letters(core)
            if ids is None:
                return self._plain(word)
            self.parts[core] = ids
        if len(core) < len(word):
            tail = word[len(core):]
            end = self.tails.get(tail)
            if end is None:
                end = self.tails[tail] = self._plain(tail)
            return ids + end
        return ids

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        found = list(map(self.ids, words))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        k = len(self.words)
        self.words.update(zip(words, range(k, k + len(words))))
        self.starts = _room(self.starts, k + len(words))
        self.lengths = _room(self.lengths, k + len(words))
        self.pool = _room(self.pool, self.used + len(flat))
        self.starts[k : k + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[k : k + len(words)] = lengths
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each text has. Null is empty."""
        if len(self.words) > MEMO_WORDS:
            self._forget()
        words = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = self.words
        self._learn([w for w in distinct if w not in known])
        at = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[codes] if distinct else np.zeros(0, np.int64)
        lengths = self.lengths[at]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(total)]
        word_ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)]
        return ids, np.diff(word_ends)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder; its memory lasts from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text at most, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same documents with ``end_id`` after each."""
    out = np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32)
    return out, counts + 1
