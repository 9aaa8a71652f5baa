"""Words of a batch of texts as Arrow arrays: split and numbered by Arrow's own kernels, not word by word in Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(column: pa.Array, size: int = 6 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Slices of whole texts (null: empty) of about `size` bytes each, with the number of the first text."""
    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(lengths), 0
    while first < len(column):
        before = int(ends[first - 1]) if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield first, column.slice(first, stop - first).fill_null("")
        first = stop


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and how many each text has. ASCII white space is what parts words."""
    found = pc.ascii_split_whitespace(texts)
    words = found.flatten()
    bounds = found.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    # White space at a text's ends leaves an empty word there.
    full = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return words.filter(full), np.diff(kept[bounds])


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each word its place among the distinct words, and these."""
    if not len(words):
        return np.zeros(0, dtype=np.int64), words
    d = words.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def as_bytes(words: pa.Array) -> list[bytes]:
    """The words as Python bytes, cut from their buffer."""
    if not len(words):
        return []
    words = pa.concat_arrays([words])  # from its own first byte on
    bounds = np.frombuffer(words.buffers()[1], dtype=np.int32, count=words.offset + len(words) + 1)[words.offset :].tolist()
    data = words.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


class Known:
    """A bounded memory of words and a number for each; `learn` gives the numbers of unknown ones."""

    def __init__(self, limit: int):
        self.limit, self.words, self.values = limit, pa.array([], pa.string()), np.zeros(0, dtype=np.int64)

    def __call__(self, distinct: pa.Array, learn) -> np.ndarray:
        at = pc.index_in(distinct, value_set=self.words)
        new = at.is_null().to_numpy(zero_copy_only=False)
        out = np.empty(len(distinct), dtype=np.int64)
        out[~new] = self.values[at.drop_null().to_numpy()]
        if new.any():
            unknown = distinct.filter(pa.array(new))
            out[new] = values = learn(as_bytes(unknown))
            if len(self.words) + len(unknown) > self.limit:
                self.words, self.values = self.words[:0], self.values[:0]
            if len(unknown) <= self.limit:
                self.words, self.values = pa.concat_arrays([self.words, unknown]), np.concatenate([self.values, values])
        return out
