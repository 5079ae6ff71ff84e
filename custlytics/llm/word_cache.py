"""Token ids of texts from a bounded cache of their words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa

#: Words whose ids a worker process remembers; characters of text handled at once.
CACHE_WORDS, SLICE_CHARS = 1 << 20, 1 << 21


class WordCache:
    """Word -> its ids as little-endian 32-bit integers.  ``encode`` maps a
    list of new words to such bytes.  A full cache forgets the new words of a
    call after it, and starts afresh once it has forgotten many times its
    size (the text has changed), so memory is bounded by the cache and the
    words of one call."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = CACHE_WORDS):
        self.encode, self.limit = encode, limit
        self.known: dict[str, bytes] = {}
        self.forgotten = 0

    def documents(self, split: list[list[str]], tail: bytes = b"") -> list[bytes]:
        """The ids of each document's words in order, ``tail`` at the end."""
        known = self.known
        words = list(chain.from_iterable(split))
        found = list(map(known.get, words))                  # one lookup a word
        places = [i for i, ids in enumerate(found) if ids is None]
        if places:
            fresh = list(dict.fromkeys([words[i] for i in places]))
            made = dict(zip(fresh, self.encode(fresh), strict=True))
            for i in places:
                found[i] = made[words[i]]
            if len(known) < self.limit:
                known.update(made)
            else:
                self.forgotten += len(made)
                if self.forgotten > 16 * self.limit:
                    known.clear()
                    self.forgotten = 0
        ends = list(accumulate(map(len, split), initial=0))
        return [b"".join(found[a:b]) + tail for a, b in pairwise(ends)]


def to_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def from_bytes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i4")


def list_array(documents: list[bytes]) -> pa.ListArray:
    """array<int> of the documents' ids, without a Python object an id."""
    ends = np.cumsum([0, *map(len, documents)]) // 4
    flat = pa.array(np.frombuffer(b"".join(documents), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about SLICE_CHARS of text each."""
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_CHARS)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))
