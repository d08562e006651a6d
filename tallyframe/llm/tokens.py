"""Token ids of whole texts by a byte-level BPE of the tokenizers library.

The library is given every distinct word of a task once; a text's ids are then
put together from its words' ids. That is exact, because a byte-level BPE cuts
a text into words by a fixed pattern first and never merges across words:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Words are cut and looked up for a whole Arrow batch at a time. The library gets
new words already cut, and spelled in the vocabulary's letters for bytes: its
own cutting and spelling take twice the time of its merging.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tallyframe.llm import units

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_CACHED_WORDS = 600_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The class of every code point in the pattern."""
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = np.where((np.arange(a, b + 1) >= 0xD800) & (np.arange(a, b + 1) < 0xE000), _OTHER, kind)
    return out


def _word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the pattern begins a new word (or a row begins)."""
    text = data.tobytes().decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(points)
    head = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each code point
    kind = _kinds()[points]
    row = np.zeros(n + 1, bool)
    inner = offsets[(offsets < len(data))]
    row[np.searchsorted(head, inner)] = True
    row[n] = True
    begin = row[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    starts = begin.copy()
    # White space before something: its last character stands alone, or leads
    # the next word if it is a blank.
    last = kind == _SPACE
    last[:-1] &= ~last[1:] & ~row[1:n]
    last[-1] = False
    starts |= last
    blank = last & (points == 0x20)
    starts[1:] &= ~blank[:-1]
    # Contractions: a lone apostrophe that leads, then s t re ve m ll d.
    quote = np.flatnonzero(begin & (points == 0x27))
    quote = quote[np.append(begin, True)[quote + 1] & ~row[quote + 1] & ~np.append(False, blank)[quote]]
    for p in (quote + 1).tolist():
        pair = points[p : p + 2]
        first = chr(pair[0])
        two = first + chr(pair[1]) if len(pair) > 1 and not row[p + 1] else ""
        size = 1 if first in "stmd" else 2 if two in ("re", "ve", "ll") else 0
        if size:
            starts[p] = False
            if p + size < n and kind[p + size] == _LETTER and not row[p + size]:
                starts[p + size] = True
    return head[starts]


def _letters() -> np.ndarray:
    """The code point that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.zeros(256, np.uint16)
    out[printable] = printable
    out[np.setdiff1d(np.arange(256), printable)] = 0x100 + np.arange(256 - len(printable))
    return out


class Encoder:
    """Ids of batches of texts; keeps the words it has met, up to a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        cut = whole.pre_tokenizer
        if whole.normalizer or not (isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space):
            raise ValueError("this is no plain byte-level vocabulary")
        # Words come cut and spelled in the vocabulary's letters, one to a line.
        self._tokenizer = Tokenizer(whole.model)
        self._tokenizer.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self._letters = _letters()
        vocabulary = self._tokenizer.get_vocab()
        self._bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self._bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self._forget()

    def _forget(self) -> None:
        """No words: sorted hashes, where each one's ids begin, how many, the ids."""
        self._known = np.zeros(0, np.uint64)
        self._begin = self._size = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word). Words are given to the library as lines of
        one text; the bytes that each id stands for tell where a word ends."""
        length = ends - starts
        stop = np.cumsum(length)
        text = np.full(int(stop[-1]) + len(stop), 0x0A, np.uint16)
        inside = np.ones(len(text), bool)
        inside[stop + np.arange(len(stop))] = False
        text[inside] = self._letters[data[np.repeat(starts - (stop - length), length) + np.arange(int(stop[-1]))]]
        lines = text.astype("<u2").tobytes().decode("utf-16-le")
        ids = np.array(self._tokenizer.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.uint32)
        reached = np.cumsum(self._bytes[ids])
        last = np.searchsorted(reached, stop)
        if not len(ids) or reached[-1] != stop[-1] or (reached[last] != stop).any():
            raise ValueError("this vocabulary does not spell every byte")
        return ids, np.diff(last, prepend=-1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, first id of each row and the total)."""
        data, offsets = units.column_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = _word_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        words = pa.array(units.ranges(units.running(data), starts, ends)).dictionary_encode()
        distinct = words.dictionary.to_numpy()
        order = np.argsort(distinct)
        distinct = distinct[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which = rank[words.indices.to_numpy()]
        if len(self._known) > _CACHED_WORDS:
            self._forget()
        place = np.searchsorted(self._known, distinct)
        here = np.minimum(place, max(len(self._known) - 1, 0))
        have = self._known[here] == distinct if len(self._known) else np.zeros(len(distinct), bool)
        if not have.all():
            example = np.empty(len(distinct), np.int64)
            example[which] = np.arange(len(which))
            new = example[~have]
            ids, size = self._learn(data, starts[new], ends[new])
            self._begin = np.insert(self._begin, place[~have], len(self._ids) + np.cumsum(size) - size)
            self._size = np.insert(self._size, place[~have], size)
            self._known = np.insert(self._known, place[~have], distinct[~have])
            self._ids = np.concatenate([self._ids, ids])
            place = np.searchsorted(self._known, distinct)
        size = self._size[place][which]
        first = np.cumsum(size) - size
        total = int(size.sum())
        ids = self._ids[np.repeat(self._begin[place][which] - first, size) + np.arange(total)]
        return ids, np.append(first, total)[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process, shared by its tasks."""
    return Encoder(path)


def with_end(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after each row."""
    rows = np.diff(first)
    out = np.full(len(ids) + len(rows), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(rows)), rows)] = ids
    return out, first + np.arange(len(first))
