"""Token ids of whole texts with a public byte-level tokenizer file, for Arrow tasks.

Byte-level pre-tokenization always starts a new piece at a single space between two visible
characters, and where a Latin letter meets punctuation or a lone line break. A text's ids are
therefore the ids of the parts between such places, one after the other. Each task keeps the ids of
the parts it has met (keyed by their bytes, emptied when full), so only new parts
go through the tokenizer; the rest is array work on blocks of texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

from .words import distinct_runs, text_bytes

END_ID = 0
_OTHER, _LETTER, _MARK, _VISIBLE, _SPACE, _LINE = range(6)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[0x21:0x7F] = _VISIBLE
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = _MARK  # "'" may take letters along
_KIND[[c for c in range(0x41, 0x7B) if chr(c).isalpha()]] = _LETTER
_KIND[0x20], _KIND[0x0A] = _SPACE, _LINE


def id_dtype(vocab_size: int) -> str:
    """Smallest little-endian unsigned type that holds every id."""
    return "<u2" if vocab_size <= 1 << 16 else "<u4"


def part_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Byte offsets at which the parts of the texts in ``data`` begin (``text_starts`` included)."""
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))  # Latin letters of two bytes
    lead = lead[~((data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)))]
    kind[lead] = _LETTER
    kind[lead + 1] = _LETTER
    letter, mark = kind == _LETTER, kind == _MARK
    seen = (kind >= _LETTER) & (kind <= _VISIBLE)
    between = np.zeros(len(data), dtype=bool)  # a visible character on either side
    between[1:-1] = seen[:-2] & seen[2:]
    between[text_starts[text_starts < len(data)]] = False
    before = text_starts[(text_starts > 0)] - 1
    between[before[before < len(data)]] = False
    mark |= (kind == _LINE) & between
    cut = (kind == _SPACE) & between
    cut[1:] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    cut[text_starts[text_starts < len(data)]] = True
    return np.flatnonzero(cut)


class PartEncoder:
    """Ids of texts as arrays of little-endian unsigned integers of type ``dtype``."""

    def __init__(self, path: str, max_parts: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = id_dtype(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.max_parts = max_parts
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # a part -> its place in starts and lengths
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, self.dtype), 0

    def _learn(self, parts: list[bytes]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        at, to, total = len(self.known), len(self.known) + len(parts), int(lengths.sum())
        while to > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        if self.used + total > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool) + total)
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), self.dtype, total)
        self.starts[at:to] = self.used + np.cumsum(lengths) - lengths
        self.lengths[at:to] = lengths
        self.known.update(zip(parts, range(at, to)))
        self.used += total

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """The ids of the UTF-8 texts ``data[bounds[i]:bounds[i + 1]]``, no special tokens added."""
        if len(self.known) > self.max_parts:
            self._forget()
        data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        if not len(data):
            return [np.zeros(0, self.dtype)] * (len(bounds) - 1)
        starts = part_starts(data, bounds[:-1])
        parts, which = distinct_runs(data, np.append(starts, len(data)))
        new = [p for p in parts if p not in self.known]
        if new:
            self._learn(new)
        place = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))[which]
        lengths = self.lengths[place]
        total = np.zeros(len(place) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        ids = self.pool[np.repeat(self.starts[place] - total[:-1], lengths) + np.arange(total[-1])]
        cuts = total[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str) -> PartEncoder:
    """One encoder per Python worker and tokenizer file."""
    return PartEncoder(path)


def encode_rows(texts, path: str, block: int = 2 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """Yield ``(row, ids)`` for an Arrow string column; a null text is empty. Every array ends with
    the end id. Texts are taken in blocks of about ``block`` bytes."""
    enc = encoder(path)
    data, bounds = text_bytes(texts)
    end = np.array([END_ID], dtype=enc.dtype)
    row, n = 0, len(bounds) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + block, side="right")) - 1)
        raw = data[bounds[row] : bounds[to]].tobytes()
        special = any(s in raw for s in enc.special)
        for i, ids in enumerate(enc.encode(data, bounds[row : to + 1])):
            if special:  # such strings are found before any cutting
                text = data[bounds[row + i] : bounds[row + i + 1]].tobytes()
                if any(s in text for s in enc.special):
                    ids = enc.encode_whole(text.decode())
            yield row + i, np.concatenate([ids, end])
        row = to
