"""Word shingles as 64-bit hashes and min-max signatures, vectorised over batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes that are hashed at once; a longer text is cut between words.
PIECE = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        n = max(n, 2 * PIECE)
        for k, base in enumerate((int(_P), pow(int(_P), -1, 1 << 64))):
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of ``data``, words being parted by ASCII white space."""
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * _M2)), starts


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words; equal words have equal hashes in every text."""
    held, size = [], 0

    def flush() -> Iterator[np.ndarray]:
        h, starts = _hash_words(b"\n".join(held))
        ends = np.cumsum([len(t) + 1 for t in held])
        yield from np.split(h, np.searchsorted(starts, ends[:-1]))

    for t in texts:
        if len(t) > PIECE:
            if held:
                yield from flush()
                held, size = [], 0
            parts, at = [], 0
            while at < len(t):
                end = at + PIECE
                while end < len(t) and not t[end : end + 1].isspace():
                    end += 1
                parts.append(_hash_words(t[at:end])[0])
                at = end
            yield np.concatenate(parts)
            continue
        held.append(t)
        size += len(t)
        if size > PIECE:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def encoded(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; nothing for null."""
    return text.encode("utf-8", "replace").lower() if isinstance(text, str) else b""


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; fewer words are one shingle."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, k)
    s = words[: n - size + 1].copy()
    for j in range(1, size):
        s = mix(s + words[j : n - size + 1 + j] * _P)
    return np.unique(mix(s ^ np.uint64(size)))


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    for words in word_hashes([encoded(t) for t in texts]):
        yield shingle_set(words, k)


def set_key(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


class MinMax:
    """Min-max hashing: of each permutation both the least and the greatest value are kept.

    ``bands`` bands of ``rows`` values need half as many permutations. A pair of similarity s
    shares a band with probability 1 - (1 - s ** rows) ** bands.
    """

    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = -(-bands * rows // 2)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        self.place = np.arange(bands, dtype=np.uint64)

    def band_keys(self, s: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band of a set that isn't empty."""
        x = (s >> np.uint64(32)).astype(np.uint32)
        low, high = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32), np.zeros(len(self.a), dtype=np.uint32)
        for i in range(0, len(x), 1024):
            v = self.a[:, None] * x[None, i : i + 1024] + self.b[:, None]
            np.minimum(low, v.min(axis=1), out=low)
            np.maximum(high, v.max(axis=1), out=high)
        values = np.stack([low, high], axis=1).reshape(-1)[: self.bands * self.rows].reshape(self.bands, self.rows).astype(np.uint64)
        key = mix(self.place + np.uint64(1))
        for j in range(self.rows):
            key = mix(key ^ (values[:, j] + np.uint64((j + 1) * int(_P) % (1 << 64))))
        return key.view(np.int64)


    def many(self, s: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Band keys of many sets, one row each: set i is ``s`` from ``start[i]`` to the next."""
        if not len(start):
            return np.zeros((0, self.bands), dtype=np.int64)
        x, values = (s >> np.uint64(32)).astype(np.uint32), []
        for a, b in zip(self.a, self.b, strict=True):
            v = a * x + b
            values += [np.minimum.reduceat(v, start), np.maximum.reduceat(v, start)]
        key = []
        for i in range(self.bands):
            h = np.full(len(start), i, dtype=np.uint64)
            for j in range(self.rows):
                h = mix(h ^ (values[i * self.rows + j].astype(np.uint64) + np.uint64((j + 1) * int(_P) % (1 << 64))))
            key.append(h.view(np.int64))
        return np.stack(key, axis=1)


def same_share(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


class Paragraphs:
    """The lines of many texts as arrays, a row for each line that has a word.

    ``text`` and ``pos`` say which line of which text, ``order`` counts the lines with words,
    ``words`` their words, ``n`` their distinct shingles; ``k1`` and ``k2`` name the set, and
    ``bands`` has a row of band keys for each line.
    """

    def __init__(self, texts: list[str | None], k: int, hashing: MinMax):
        counts, line_of, hashes, owner, place = [], [], [], [], []
        base = 0
        for i, words in enumerate(_lines([encoded(t) for t in texts])):
            h, line = words
            if len(h):
                new = np.flatnonzero(np.diff(line, prepend=-1))
                owner.append(np.full(len(new), i))
                place.append(line[new])
                counts.append(np.diff(np.append(new, len(h))))
                line_of.append(np.repeat(np.arange(base, base + len(new)), counts[-1]))
                hashes.append(h)
                base += len(new)
        empty = np.zeros(0, dtype=np.int64)
        join = lambda x: np.concatenate(x) if x else empty
        self.text, self.pos, self.words = join(owner), join(place), join(counts)
        self.order = np.arange(base) - np.searchsorted(self.text, self.text)
        h, line = join(hashes).astype(np.uint64), join(line_of)
        s, of = self._shingles(h, line, k)
        by = np.lexsort((s, of))
        s, of = s[by], of[by]
        distinct = np.ones(len(s), dtype=bool)
        distinct[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
        s, of = s[distinct], of[distinct]
        start = np.flatnonzero(np.diff(of, prepend=-1))
        self.n = np.diff(np.append(start, len(s)))
        sums = lambda x: np.add.reduceat(x, start).view(np.int64) if len(start) else empty
        self.k1, self.k2 = sums(mix(s)), sums(mix(s ^ _M1))
        self.bands = hashing.many(s, start)

    def _shingles(self, h: np.ndarray, line: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        size = np.minimum(self.words, k)[line] if len(line) else line
        out, of = [], []
        for m in range(1, k + 1):
            n = max(0, len(h) - m + 1)
            ok = (size[:n] == m) & (line[:n] == line[m - 1 : m - 1 + n])
            at = np.flatnonzero(ok)
            s = h[at]
            for j in range(1, m):
                s = mix(s + h[at + j] * _P)
            out.append(mix(s ^ np.uint64(m)))
            of.append(line[at])
        return np.concatenate(out), np.concatenate(of)


def _lines(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, its words' hashes and the line that each word stands in."""
    for t, h in zip(texts, word_hashes(texts), strict=True):
        if not len(h):
            yield h, np.zeros(0, dtype=np.int64)
            continue
        b = np.frombuffer(t, dtype=np.uint8)
        word = ~((b == 32) | ((b >= 9) & (b <= 13)))
        starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
        yield h, np.searchsorted(np.flatnonzero(b == 10), starts)
