"""64-bit shingle fingerprints computed in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SEED = 42
#: Shingle hashes expanded to single bits at a time; bounds the memory of very long texts.
CHUNK = 1 << 16


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step with full avalanche (unsigned arithmetic wraps)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words_per_shingle: int) -> np.ndarray:
    """XXH64 hashes (seed 42, unsigned) of a text's word shingles in order, repeats included.

    Words are runs free of ASCII white space after lower-casing A-Z. A text with
    fewer words than a shingle hashes whole; one without words (null included)
    has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - words_per_shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[min(words_per_shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes (unsigned); zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: str | None, words_per_shingle: int = 4) -> int:
    """Majority bits of the hashes of a text's shingles; zero without words."""
    return majority(shingle_hashes(text, words_per_shingle))


def simhash_batch(texts: pa.Array, words_per_shingle: int = 4) -> pa.Array:
    values = np.fromiter((simhash(t, words_per_shingle) for t in texts.to_pylist()), np.uint64, len(texts))
    return pa.array(values.view(np.int64))


def shingle_set(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes (signed) of a text's shingles."""
    return np.unique(shingle_hashes(text, words_per_shingle).view(np.int64))


def signature(shingles: np.ndarray) -> int:
    """Hash (signed) that stands for a whole shingle set; zero for the empty one."""
    digest = xxhash.xxh64_intdigest(shingles.tobytes(), SEED) if len(shingles) else 0
    return digest - (1 << 64) if digest >> 63 else digest
