"""Words and n-grams as 64-bit hashes, by numpy over blocks of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

WORD = re.compile(r"\w+")
BLOCK_CHARS = 1 << 19
_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xFF51AFD7ED558CCD)
_LAST_WORD_CHAR = 0x33480  # no code point from here on is a letter or digit
_SPECIAL = np.uint32(0xFFFFFFFF)
_tables: dict[str, np.ndarray] = {}


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores of the whole text."""
    return WORD.findall(text.lower()) if text else []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M
    return h ^ (h >> np.uint64(29))


def _letters() -> np.ndarray:
    """Code point -> its lower case + 1 if it is a word character, else 0; _SPECIAL
    for the two whose lower case is longer or depends on what surrounds it."""
    if "letters" not in _tables:
        t = np.zeros(0x110000, np.uint32)
        for i in range(_LAST_WORD_CHAR):
            c = chr(i)
            if c.isalnum() or c == "_":
                t[i] = ord(c.lower()) + 1 if len(c.lower()) == 1 else _SPECIAL
        t[0x3A3] = _SPECIAL
        _tables["letters"] = t
    return _tables["letters"]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """K**i and K**-i modulo 2**64."""
    if len(_tables.get("up", ())) < size:
        size = max(1 << 20, 1 << (size - 1).bit_length())
        for name, base in (("up", int(_K)), ("down", pow(int(_K), -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _tables[name] = np.cumprod(p)
    return _tables["up"], _tables["down"]


def _hash_joined(parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    v = _letters()[np.frombuffer(("\0" + "\0".join(parts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)]
    if v.max() == _SPECIAL:
        return _hash_joined([p.lower() for p in parts])
    w = v > 0
    edges = np.flatnonzero(w[1:] != w[:-1]) + 1
    starts = edges[0::2]
    up, down = _powers(len(v))
    if len(starts):
        sums = np.add.reduceat(v * up[: len(v)], edges)[0::2]
        h = mix(sums * down[starts] + (edges[1::2] - starts).astype(np.uint64) * _M)
    else:
        h = np.zeros(0, np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    return h, np.diff(np.searchsorted(starts, ends), prepend=0)


def _pieces(text: str) -> Iterator[str]:
    """A long text cut between words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK_CHARS)
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):
            end += 1
        yield text[at:end]
        at = end


def word_blocks(texts: Sequence[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, hashes of the words, number of words of each) of blocks of texts.

    Words are those of ``words``; NULL has none.
    """
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= BLOCK_CHARS):
            size += len(texts[end] or "") + 1
            end += 1
        if size > 2 * BLOCK_CHARS:  # one long text
            h = np.concatenate([_hash_joined([p])[0] for p in _pieces(texts[at])])
            yield at, end, h, np.array([len(h)])
        else:
            yield at, end, *_hash_joined([t or "" for t in texts[at:end]])
        at = end


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of one text."""
    for _, _, h, _ in word_blocks([text]):
        return h
    return np.zeros(0, np.uint64)


def distinct_runs(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` holds runs of ``sizes``, sorted here in place: (sorted distinct values of each run, their numbers)."""
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        if b - a > 1:
            values[a:b].sort()
    if not len(values):
        return values, sizes
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[(ends - sizes)[sizes > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return values[new], kept[ends] - kept[ends - sizes]


def gram_blocks(texts: Sequence[str | None], n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, grams, sizes): per text the sorted distinct hashes of its word
    n-grams; a text of fewer than ``n`` words (but one at least) is one gram."""
    for first, last, h, counts in word_blocks(texts):
        starts = np.cumsum(counts) - counts
        sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        ends = np.cumsum(sizes)
        at = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        length = np.repeat(np.minimum(counts, n), sizes)
        acc = mix(h)
        out = acc[at]
        for m in range(2, n + 1):
            acc = acc * _K + np.concatenate([mix(h[m - 1 :]), np.zeros(min(m - 1, len(h)), np.uint64)])
            own = length >= m
            out[own] = mix(acc[at[own]])
        yield first, last, *distinct_runs(out, sizes)


def set_ids(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit hash per set of at least one gram, as signed integers."""
    starts = np.cumsum(sizes) - sizes
    if not len(starts):
        return np.zeros(0, np.int64)
    return mix(np.add.reduceat(mix(grams ^ _K), starts) + sizes.astype(np.uint64) * _M).view(np.int64)


def numbered(blocks: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Blocks of hashes, emptied, as one array of numbers from 0, and how many there are."""
    names = np.zeros(0, np.uint64)
    for block in blocks:
        names = np.union1d(names, block)
    out = np.empty(sum(map(len, blocks)), np.int32)
    end = len(out)
    while blocks:
        block = blocks.pop()
        out[end - len(block) : end] = np.searchsorted(names, block)
        end -= len(block)
    return out, len(names)


def overlaps(tokens: np.ndarray, distinct: int, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 1_000_000) -> np.ndarray:
    """Sizes of the intersections of the sets ``a[i]`` and ``b[i]`` of ``numbered`` tokens; ``a``
    is sorted. About ``most`` tokens are looked at a time."""
    mark = np.zeros(distinct, bool)
    out = np.zeros(len(a), np.int64)
    if not len(a):
        return out
    cuts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = tokens[starts[a[lo]] : starts[a[lo]] + sizes[a[lo]]]
        mark[own] = True
        total = np.cumsum(sizes[b[lo:hi]])
        p = 0
        while p < hi - lo:
            q = max(p + 1, int(np.searchsorted(total, (total[p - 1] if p else 0) + most, "right")))
            other = b[lo + p : lo + q]
            n = sizes[other]
            ends = np.cumsum(n)
            hit = mark[tokens[np.repeat(starts[other] - (ends - n), n) + np.arange(ends[-1])]]
            out[lo + p : lo + q] = np.add.reduceat(hit, ends - n, dtype=np.int64)
            p = q
        mark[own] = False
    return out
