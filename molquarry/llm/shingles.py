"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from molquarry.llm.common import WordHashes, ascii_words, gram_hashes, text_slices


def shingle_sets(batches: Iterator[pa.RecordBatch], text_column: int, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches, bounded in rows and bytes, with each row's sorted set of k-word shingle hashes. A text of fewer words is one shingle, a
    text without words has none. Two different shingles of a corpus of n share a hash with a chance of n^2 / 2^65."""
    hashes = WordHashes()
    for part, texts in text_slices(batches, text_column):
        yield part, [np.unique(gram_hashes(hashes.of(ascii_words(t)), k)) for t in texts]
