"""Words of Arrow text columns as flat numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from formline.llm.common import ship

ship(__name__)


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts, one after another, and the number of words of each text.

    Words are runs of anything but ASCII white space, after lower-casing A-Z; a null text has none.
    """
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    count = np.diff(lists.offsets.to_numpy())
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        of = np.repeat(np.arange(len(texts)), count)[~empty]
        count = np.bincount(of, minlength=len(texts))
        flat = flat.filter(pa.array(~empty))
    return flat.dictionary_encode(), count


def hash_known(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in words), np.uint64, len(words))


def hash_words(words: pa.DictionaryArray) -> np.ndarray:
    """A 64-bit hash per word; each distinct word is hashed once."""
    known = hash_known(words.dictionary)
    return known[words.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)


def pieces(batch: pa.RecordBatch, column: int | tuple[int, ...], size: int = 2_000_000):
    """Parts of a batch whose texts, in one column or several, add up to ``size`` bytes or to a single row.

    The parts are copies: kernels for text misread slices of batches that came from Spark.
    """
    columns = column if isinstance(column, tuple) else (column,)
    length = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    start = total = 0
    for i, n in enumerate(length):
        if total and total + n > size:
            yield batch.take(pa.array(np.arange(start, i)))
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.take(pa.array(np.arange(start, batch.num_rows)))
