"""Words of texts as numbers, block by block, for operators that hash or count word sequences inside a task."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are numbered together hold about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: A text is split into words in pieces of about so many bytes, so that a very long one never is a list of words.
PIECE_BYTES = 1 << 20


def separators(kept: bytes, lower: bool) -> bytes:
    """A translation of UTF-8 bytes: what is not in ``kept`` becomes a space, A-Z may become a-z."""
    table = bytearray(b" " * 256)
    for b in kept:
        table[b] = b
    if lower:
        for b in range(65, 91):
            table[b] = table[b + 32]
    return bytes(table)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes of text, or one row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """``data`` cut at spaces."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def numbered(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(numbers, lengths, words): all words of the texts as numbers, how many each text has, the distinct words by number."""
    vocabulary: dict[bytes, int] = defaultdict(count().__next__)
    number, lengths, parts = vocabulary.__getitem__, [], []
    for text in texts.cast(pa.binary()):
        n = 0
        for piece in pieces((text.as_py() or b"").translate(table)):
            words = piece.split()
            parts.append(np.fromiter(map(number, words), np.int64, len(words)))
            n += len(words)
        lengths.append(n)
    return np.concatenate(parts) if parts else np.empty(0, np.int64), np.array(lengths, np.int64), list(vocabulary)


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, alike in every process."""
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, np.uint64)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of each element of rows of the given lengths."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
