"""Word shingles of texts as 64-bit hashes, for a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Odd numbers drawn once, so that every machine hashes alike.
_DRAWN = np.random.Generator(np.random.PCG64(20240611))
_BYTES = _DRAWN.integers(1, 1 << 63, 256, np.uint64)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_STEP = np.uint64(int(_DRAWN.integers(1, 1 << 63)) * 2 + 1)
_PLACES = _DRAWN.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Texts are hashed together up to about so many bytes.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z lower-cased, and how many words each text has."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_SPACE[buf]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, firsts))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(sizes.sum()) - np.repeat(at, sizes)
    power = np.multiply.accumulate(np.full(int(sizes.max()), _STEP, np.uint64))
    return mix(np.add.reduceat(_BYTES[buf[inside]] * power[place], at)), counts


def shingle_sets(texts: Sequence[str | None], n: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text: of ``n`` words, or its whole sequence if it has fewer; none without words."""
    chunk, size = [], 0
    for text in texts:
        chunk.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(chunk[-1])
        if size >= CHUNK_BYTES:
            yield from _sets(chunk, n)
            chunk, size = [], 0
    if chunk:
        yield from _sets(chunk, n)


def _sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    words, counts = word_hashes(texts)
    joined = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        joined += words[k : k + len(joined)] * _PLACES[k]
    joined = mix(joined)
    at = 0
    for count in counts.tolist():
        if count >= n:
            yield np.unique(joined[at : at + count - n + 1])
        elif count:
            few = np.concatenate([words[at : at + count] * _PLACES[:count], np.full(count, _PLACES[n])])
            yield mix(few.sum(dtype=np.uint64, keepdims=True))
        else:
            yield np.zeros(0, np.uint64)
        at += count


def fingerprint(shingles: np.ndarray) -> int:
    """A signed 64-bit number for a set; different sets share one with probability 2**-64."""
    one = (shingles * _PLACES[60]).sum(dtype=np.uint64, keepdims=True)
    two = mix(shingles ^ _PLACES[61]).sum(dtype=np.uint64, keepdims=True)
    return int(mix(one ^ two * _PLACES[62]).view(np.int64)[0])
