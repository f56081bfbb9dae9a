"""Operator 3: exact n-gram Jaccard self-join with token-combination prefixes.

Method. A document is the set of its word n-grams ("tokens"). Tokens have one
global order, rare before frequent (``_sketch`` counts all of them). Two sets
with Jaccard >= t share at least a = ceil(t * |x|) tokens, so at most |x| - a
of x's tokens are missing from the other set. Tokens whose corpus count lies
far above the sketch's mean are *frequent* and belong to one of ``GROUPS``
two-token classes; all others form the single-token class. The prefix is
extended until ``sum over classes of (tokens in the prefix - (k - 1))`` reaches
|x| - a + m: then two similar sets share at least m signatures, each a
single rare token or a pair of frequent tokens of one class, and only those are
indexed. Pairs that share as many and pass the length and positional filters are
verified on whole sets.

Small sets cannot afford the extension of every class; sets below ``_small``
index plain single-token prefixes instead, and so do, in addition, all sets
long enough to be their partners. No posting list is capped.

At scale. Signatures travel as one blob per map flush and hash bucket; the number
of buckets follows the number of signatures. A bucket's pairs go, as runs of ranks
in a table of its sets, to the reducer of the pair's first set, where the shares
of all buckets are added up; dense runs, as among near copies, take about a byte a
pair. Pairs are verified where their group's candidates meet, in slices of bounded
pair count, so a set is shipped once per slice and not once per pair. Equal sets are
one entry everywhere. ``jaccard_classes`` reports a row per document: a slice sends
on a count of links per set and a spanning forest, never its pairs.

Large groups of near copies share hundreds of signatures a pair, so they are kept out of
the index. A *pivot* is a set of a crowded min-hash key; the sets at least
``reach`` similar to it are its *ball*. As 1 - Jaccard is a metric, whatever is similar to one of
the ball has Jaccard >= reach + t - 1 with the pivot. One map finds all such sets,
and each of the ball is compared with all of them, in pairs of blocks of bounded size. This is
exact whatever the pivots are: those that none is chosen for stay in the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import spread
from . import _sketch
from ._codec import framed, planes, unframed, unplaned
from ._store import dropped, released, staged, written_bytes
from ._text import gram_blocks, mix, numbered, overlaps, set_ids

GROUPS = 8
SHARED_GRAMS = 6
FOLDED = 64  # tokens of a set whose parities take one word
PER_BUCKET, PER_FLUSH = 1_500_000, 800_000
PAIRS_AT_ONCE = 2_000_000  # of a bucket or a reducer, in memory
PAIRS_PER_SLICE = 1_500_000
PAIRS_PER_SLOT = 200_000
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
CROWD = 256  # different sets of one min-hash key that make a pivot
PIVOTS, PIVOT_TOKENS = 256, 2_000_000  # at most, and tokens of all of them
BLOCK_SETS, BLOCK_TOKENS = 1_000, 500_000
_EPS = 1e-9


def sized(df: DataFrame) -> DataFrame:
    """A staged table, with a broadcast hint if it has at most BROADCAST_ROWS rows and BROADCAST_BYTES of files."""
    return F.broadcast(df) if written_bytes(df) <= BROADCAST_BYTES and df.count() <= BROADCAST_ROWS else df


def least_overlap(size: int, t: float) -> int:
    return max(1, math.ceil(t * size - _EPS))


def _small(t: float, m: int, frequent: int) -> int:
    """Smallest size at which every class can be extended; without frequent tokens there is one class."""
    size = 1
    while least_overlap(size, t) < m + (GROUPS if frequent < 256 else 0):
        size += 1
    return size


def signatures(tokens: np.ndarray, sizes: np.ndarray, levels: np.ndarray, frequent: int, t: float, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, number of the set) of the signatures of sets of ``sizes`` >= 1
    tokens each, of which similar ones share ``m`` if both have ``_small`` tokens, else one."""
    # a token's level before its hash is the global order
    k = (levels[_sketch.bucket(tokens)].astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a > 1:
            k[a:b].sort()
    pos = np.arange(len(k)) - np.repeat(starts, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    need = sizes - np.maximum(1, np.ceil(t * sizes - _EPS)).astype(np.int64) + 1
    small = _small(t, m, frequent)
    first = np.add.reduceat(k < np.uint64(frequent << 56), starts, dtype=np.int64) if frequent < 256 else sizes
    plain = np.flatnonzero(pos < np.where(sizes <= (small - 1) / t + _EPS, need, 0)[owner])
    need = need + m - 1
    large = sizes >= small
    rare = np.flatnonzero(pos < np.where(large, np.minimum(first, need), 0)[owner])
    hs, ps, ds = [mix(k[plain] + np.uint64(1)), mix(k[rare])], [pos[plain], pos[rare]], [owner[plain], owner[rare]]
    for d in np.flatnonzero(large & (first < need)).tolist():
        f, own = int(first[d]), k[starts[d] + first[d] : ends[d]]
        group = (own & np.uint64(GROUPS - 1)).astype(np.int64)
        gain = np.ones(len(own), np.int64)
        gain[np.unique(group, return_index=True)[1]] = 0
        end = int(np.searchsorted(np.cumsum(gain), need[d] - f)) + 1
        for g in np.unique(group[:end]):
            x = np.sort(own[:end][group[:end] == g])
            i, j = np.triu_indices(len(x), 1)
            hs.append(mix(x[i] * np.uint64(3) + mix(x[j])))
            ps.append(np.zeros(len(i), np.int64))
            ds.append(np.full(len(i), d))
    return np.concatenate(hs), np.concatenate(ps), np.concatenate(ds)


def _profile(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = _sketch.Counter()
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            for first, last, grams, sizes in gram_blocks(pdf["text"].tolist(), n):
                counts.add(grams)
                own = np.flatnonzero(sizes)
                yield pd.DataFrame({"id": ids[first:last][own], "size": sizes[own].astype(np.int32), "sid": set_ids(grams, sizes[own]), "key": min_keys(grams, sizes[own]), "slice": -1, "blob": None})
        rows = list(counts.rows())
        yield pd.DataFrame({"id": 0, "size": 0, "sid": 0, "key": 0, "slice": [r[0] for r in rows], "blob": [r[1] for r in rows]})

    return run


def min_keys(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number of each set of at least one token that similar sets often share: of three min-hashes."""
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(len(sizes), np.uint64)
    for k in (1, 2, 3):
        least = np.minimum.reduceat(mix(tokens + np.uint64(k)), starts) if len(starts) else out
        out = mix(out * np.uint64(3) + least)
    return out.view(np.int64)


class Pivots:
    """Sets that all others are compared with, by an inverted list of their tokens."""

    def __init__(self, sets: list[np.ndarray], t: float) -> None:
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.reach = max(t, 1.2 - t)  # so that sets without a token in common are never in question
        self.around = self.reach + t - 1
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        at = np.argsort(tokens, kind="stable")
        self.names, first = np.unique(tokens[at], return_index=True)
        self.ends, self.owner = np.append(first, len(at)), owner[at]
        self.mark = np.zeros(1 << 20, bool)
        self.mark[self.names >> np.uint64(44)] = True

    def shared(self, tokens: np.ndarray, sizes: np.ndarray, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the set, pivot, tokens in common), ordered, of all that have one."""
        hit = np.flatnonzero(self.mark[tokens >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.names, tokens[hit]), len(self.names) - 1)
        ok = self.names[at] == tokens[hit]
        at, own = at[ok], np.searchsorted(np.cumsum(sizes), hit[ok], "right")
        n = self.ends[at + 1] - self.ends[at]
        total = np.cumsum(n)
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
            own_n = n[a:b]
            pivot = self.owner[np.repeat(self.ends[at[a:b]] - (np.cumsum(own_n) - own_n), own_n) + np.arange(own_n.sum())]
            key, count = np.unique(np.repeat(own[a:b], own_n) * len(self.sizes) + pivot, return_counts=True)
            keys.append(key)
            times.append(count)
            a = b
        key, count = added(np.concatenate(keys), np.concatenate(times))
        return key // len(self.sizes), key % len(self.sizes), count

    def around_of(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ball of each set or the number of pivots; number of the set and pivot of all pairs in question)."""
        i, pivot, both = self.shared(tokens, sizes)
        j = both / (sizes[i] + self.sizes[pivot] - both)
        ball = np.full(len(sizes), len(self.sizes))
        inside = j >= self.reach - _EPS
        np.minimum.at(ball, i[inside], pivot[inside])
        near = j >= self.around - 1e-6
        return ball, i[near], pivot[near]


def _balls(n: int, shared):
    """(pivot, sid, size, own): the sets in question for each pivot's ball, ``own`` those in it. Pairs of two balls are those of the first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots = shared.value
        for pdf in batches:
            for tokens, sizes in _gram_sets(n)(pdf["text"].tolist()):
                if len(sizes):
                    ball, i, pivot = pivots.around_of(tokens, sizes)
                    ok = pivot <= ball[i]
                    i, pivot = i[ok], pivot[ok]
                    yield pd.DataFrame({"pivot": pivot.astype(np.int32), "sid": set_ids(tokens, sizes)[i], "size": sizes[i].astype(np.int32), "own": ball[i] == pivot})

    return run


def _found_pivots(docs: DataFrame, reps: DataFrame, t: float, n: int) -> Pivots | None:
    """Of each crowded min-hash key the set that most documents have."""
    keys = reps.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("copies")).alias("c"), "sid", "rep", "size")).alias("p"))
    rows = keys.where(F.col("n") >= CROWD).orderBy(F.desc("n"), "key").limit(PIVOTS).select("p.sid", "p.rep", "p.size").collect()
    total, kept = 0, {}
    for r in rows:
        if total + r["size"] <= PIVOT_TOKENS:
            total += r["size"]
            kept[r["sid"]] = r["rep"]
    if not kept:
        return None
    found = {}
    for (text,) in docs.where(F.col("id").isin(list(kept.values()))).select("text").toLocalIterator():
        for _, _, grams, sizes in gram_blocks([text], n):
            if sizes[0] and (sid := int(set_ids(grams, sizes)[0])) in kept:
                found[sid] = grams
    return Pivots([found[s] for s in kept if s in found], t)


def parities(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of each set: the parities of its tokens in 128 hashed cells. Sets of at most
    FOLDED tokens have the xor of both in the first. Cells that differ between two
    sets each need a token that only one of them has."""
    starts = np.cumsum(sizes) - sizes
    cell = (tokens >> np.uint64(20)) & np.uint64(127)
    bit = np.uint64(1) << (cell & np.uint64(63))
    words = [np.bitwise_xor.reduceat(np.where((cell >> np.uint64(6)) == k, bit, np.uint64(0)), starts) for k in (0, 1)]
    small = sizes <= FOLDED
    return np.where(small, words[0] ^ words[1], words[0]), np.where(small, np.uint64(0), words[1])


def _index(sets, t: float, shared, frequent: int, buckets: int, m: int, bits: bool):
    """``sets(texts)`` gives blocks (tokens, sizes) of the sets of texts; equal ones of a task are sent once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels = shared.value
        held: list[tuple] = []
        n_sets, n_entries, known = 0, 0, set()

        def flush() -> pd.DataFrame:
            h, p, d, sid, size, low, high = (np.concatenate(x) for x in zip(*held))
            b = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            at = np.argsort(b * len(sid) + d)
            h, p, d = mix(h[at]).astype("<u4"), p[at], d[at]
            ends = np.searchsorted(b[at], np.arange(buckets + 1))
            out = []
            for k in range(buckets):
                own = slice(ends[k], ends[k + 1])
                if ends[k] < ends[k + 1]:
                    first = np.flatnonzero(np.concatenate(([True], d[own][1:] != d[own][:-1])))
                    docs = d[own][first]
                    words = (low[docs].tobytes(), high[docs][size[docs] > FOLDED].tobytes()) if bits else (b"", b"")
                    out.append((k, h[own].tobytes(), planes(p[own]), planes(np.diff(np.append(first, ends[k + 1] - ends[k]))), sid[docs].tobytes(), planes(size[docs]), *words))
            return pd.DataFrame(out, columns=["bucket", "h", "p", "n", "sids", "sizes", "low", "high"])

        for pdf in batches:
            for tokens, sizes in sets(pdf["text"].tolist()):
                sids = set_ids(tokens, sizes)
                if len(known) >= 400_000:
                    known.clear()
                new = np.array([not (s in known or known.add(s)) for s in sids.tolist()], bool)
                tokens, sizes, sids = tokens[np.repeat(new, sizes)], sizes[new], sids[new]
                if not len(sizes):
                    continue
                words = parities(tokens, sizes) if bits else (np.zeros(0, np.uint64),) * 2
                h, p, d = signatures(tokens, sizes, levels, frequent, t, m)
                held.append((h, p.astype(np.uint32), d + n_sets, sids, sizes, *words))
                n_sets += len(sizes)
                n_entries += len(h)
                if n_entries >= PER_FLUSH:
                    yield flush()
                    held, n_sets, n_entries = [], 0, 0
        if held:
            yield flush()
        held.clear()
        known.clear()
        released()

    return run


def _near(first: np.ndarray, end: np.ndarray, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of ``first[i] <= j < end[i]``, ``most`` or so at a time."""
    n = np.maximum(0, end - first)
    total = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        own = n[a:b]
        if own.any():
            i = np.repeat(np.arange(a, b), own)
            yield i, np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + first[i]
        a = b


def _candidates(t: float, m: int, frequent: int, reducers: int, bits: bool):
    """A bucket's blobs -> per reducer the pairs that share a signature here and how many,
    PAIRS_AT_ONCE or so at a time. A pair goes to the reducer of its first set by size and number.

    Pairs of one signature are formed within the bounds of size only. Where one
    shared signature suffices (m = 1), the positions are taken for those of the first
    common token, at which no earlier one adds to the overlap.
    """

    most_pairs = PAIRS_AT_ONCE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches) or [pd.DataFrame({"sids": []})])
        if not len(pdf):
            return
        sids = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["sids"]])
        names, first, doc = np.unique(sids, return_index=True, return_inverse=True)
        size = np.concatenate([unplaned(x) for x in pdf["sizes"]]).astype(np.int32)
        if bits:
            low = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["low"]])
            high = np.zeros(len(low), np.uint64)
            high[size > FOLDED] = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["high"]])
        size = size[first]
        order = np.argsort(size, kind="stable")  # ranks of sets go by size
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        size = size[order]
        if bits:
            low, high = low[first][order], high[first][order]
            fold = low ^ high
        d = np.repeat(rank[doc], np.concatenate([unplaned(x) for x in pdf["n"]]))
        h = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["h"]])
        p = np.concatenate([unplaned(x).astype(np.int32) for x in pdf["p"]])
        names = names[order]
        del sids, doc, first, rank, order, pdf
        key = h.astype(np.uint64)
        key <<= np.uint64(32)
        key |= d.view(np.uint32)
        del h, d
        at = np.argsort(key).astype(np.int32)
        key, p = key[at], p[at]
        del at
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]  # equal sets are one entry
        key, p = key[new], p[new]
        d = (key & np.uint64(0xFFFFFFFF)).astype(np.int32)
        most = np.searchsorted(size, np.floor(size / t + 1e-6), "right").astype(np.uint64)  # first rank too large for each
        end = np.searchsorted(key, (key & np.uint64(0xFFFFFFFF00000000)) + most[d]).astype(np.int32)
        small = _small(t, m, frequent)
        del key, new, most
        # by reducer and first set, so that what is emitted at a time has all pairs of its first sets
        to = (mix(names.view(np.uint64)) % np.uint64(reducers)).astype(np.int64)
        by = np.argsort(to[d] * len(size) + d, kind="stable").astype(np.int32)
        total = np.cumsum(np.maximum(0, end[by].astype(np.int64) - by - 1))
        lasts = np.flatnonzero(np.append(d[by][1:] != d[by][:-1], True)) + 1  # where the entries of a set end
        lo = 0
        while lo < len(by):
            fits = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most_pairs, "right"))
            k = max(int(np.searchsorted(lasts, fits, "right")) - 1, int(np.searchsorted(lasts, lo, "right")))
            own, lo = by[lo : lasts[k]], int(lasts[k])
            found, held, seen, times = [], 0, np.empty(0, np.uint64), np.empty(0, np.int64)

            def merged() -> tuple[np.ndarray, np.ndarray]:
                key, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
                return added(np.concatenate([seen, key]), np.concatenate([times, n])) if len(seen) else (key, n)

            for i, j in _near(own + 1, end[own]):
                i = own[i]
                a, b = d[i], d[j]
                if bits:
                    apart = (size[a] + size[b]) * ((1 - t) / (1 + t)) + _EPS  # tokens that only one of two similar sets has
                    ok = np.bitwise_count(fold[a] ^ fold[b]) <= apart
                    i, j, a, b, apart = i[ok], j[ok], a[ok], b[ok], apart[ok]
                    ok = (size[a] <= FOLDED) | (np.bitwise_count(low[a] ^ low[b]) + np.bitwise_count(high[a] ^ high[b]) <= apart)
                    i, j, a, b = i[ok], j[ok], a[ok], b[ok]
                sa, sb = size[a], size[b]
                need = np.ceil(t / (1 + t) * (sa + sb) - _EPS)
                pi, pj = p[i], p[j]
                ok = (np.minimum(pi, pj) if m > 1 else 0) + np.minimum(sa - pi, sb - pj) >= need
                a, b = a[ok], b[ok]
                found.append((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
                held += len(a)
                if held > max(1_000_000, len(seen)):
                    seen, times = merged()
                    found, held = [], 0
            seen, times = merged()
            ia, ib = (seen >> np.uint64(32)).astype(np.int64), (seen & np.uint64(0xFFFFFFFF)).astype(np.int64)
            times[size[ia] < small] = m
            at = np.argsort(to[ia], kind="stable")
            cuts = np.flatnonzero(np.diff(to[ia[at]], prepend=-1, append=-1))
            out = []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                one = at[x:y]
                out.append((int(to[ia[one[0]]]), len(one), pair_blob(names, ia[one], ib[one], np.minimum(times[one], m))))
            del found, seen, times, ia, ib, at
            if out:
                yield pd.DataFrame(out, columns=["reducer", "pairs", "blob"])
            released()

    return run


def added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their numbers."""
    if not len(key):
        return key, n
    at = np.argsort(key, kind="stable")
    key = key[at]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n[at], first)


def pair_blob(names: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs of numbers a < b of ``names``, ordered by (a, b): a table of the names in use and runs of ranks in it."""
    used = np.unique(np.concatenate([a, b]))
    a, b = np.searchsorted(used, a), np.searchsorted(used, b)
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    before = np.concatenate(([0], b[:-1]))
    before[first] = a[first]
    return framed([names[used].tobytes(), planes(np.diff(a[first], prepend=0)), planes(np.diff(np.append(first, len(a)))), planes(b - before), planes(n)])


def blob_pairs(blob: bytes, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names of a, names of b, n) of a ``pair_blob``, of those a that are in one of ``parts`` by hash."""
    names, a, runs, gaps, n = unframed(blob)
    names, runs, gaps = np.frombuffer(names, np.int64), unplaned(runs), unplaned(gaps)
    a = np.repeat(np.cumsum(unplaned(a)), runs)
    total = np.cumsum(gaps)
    first = np.cumsum(runs) - runs
    b = total - np.repeat(total[first] - gaps[first], runs) + a
    a, n = names[a], unplaned(n)
    if parts == 1:
        return a, names[b], n
    own = mix(mix(a.view(np.uint64)) + np.uint64(1)) % np.uint64(parts) == part
    return a[own], names[b[own]], n[own]


def _merged(m: int):
    """Blobs of a reducer -> its pairs a < b that share ``m`` signatures in all, PAIRS_AT_ONCE or so of the blobs' pairs at a time."""
    most_pairs = PAIRS_AT_ONCE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blobs, total = [], 0
        for pdf in batches:
            blobs += pdf["blob"].tolist()
            total += int(pdf["pairs"].sum())
        parts = -(-total // most_pairs)
        for part in range(parts):
            a, b, n = (np.concatenate(x) for x in zip(*(blob_pairs(x, part, parts) for x in blobs)))
            names, ranks = np.unique(np.concatenate([a, b]), return_inverse=True)
            key = (ranks[: len(a)].astype(np.uint64) << np.uint64(32)) | ranks[len(a) :].astype(np.uint64)
            key, n = added(key, n)
            key = key[n >= m]
            a, b = names[(key >> np.uint64(32)).astype(np.int64)], names[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
            del a, b, n, names, ranks, key
            released()

    return run


def _tokens(sets: pd.DataFrame, blocks) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]:
    """``numbered`` tokens of ``sets``, how many, and the start, size and sid of each different set, by sid."""
    wanted = sets["sid"].to_numpy()
    tokens, sizes, sids = [], [], []
    for first, last, grams, n in blocks(sets["text"].tolist()):
        own = np.flatnonzero(n)
        sid = np.zeros(last - first, np.int64)
        sid[own] = set_ids(grams, n[own])
        right = (sid == wanted[first:last]) & (n > 0)  # a row may repeat an id with another text
        tokens.append(grams[np.repeat(right, n)])
        sizes.append(n[right])
        sids.append(sid[right])
    (tokens, distinct), sizes, sids = numbered(tokens), np.concatenate(sizes), np.concatenate(sids)
    starts = np.cumsum(sizes) - sizes
    uniq, at = np.unique(sids, return_index=True)
    return tokens, distinct, starts[at], sizes[at], uniq


def verify(pairs: pd.DataFrame, sets: pd.DataFrame, blocks, t: float) -> pd.DataFrame:
    """The (a, b, jaccard) of ``pairs`` with Jaccard >= ``t``; ``sets`` has sid and
    text, ``blocks(texts)`` gives (first, last + 1, tokens, sizes) with a set per text."""
    if not len(pairs) or not len(sets):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "jaccard": np.zeros(0)})
    tokens, distinct, starts, sizes, uniq = _tokens(sets, blocks)
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    order = np.argsort(a, kind="stable")
    ia, ib = np.searchsorted(uniq, a[order]), np.searchsorted(uniq, b[order])
    return _similar(tokens, distinct, starts, sizes, uniq, ia, ib, t)


def _similar(tokens: np.ndarray, distinct: int, starts: np.ndarray, sizes: np.ndarray, uniq: np.ndarray, ia: np.ndarray, ib: np.ndarray, t: float) -> pd.DataFrame:
    both = overlaps(tokens, distinct, starts, sizes, ia, ib)
    j = both / (sizes[ia] + sizes[ib] - both)
    ok = j >= t - _EPS
    out = pd.DataFrame({"a": uniq[ia[ok]], "b": uniq[ib[ok]], "jaccard": j[ok]})
    del tokens, both, j, ok
    released()
    return out


def _block_pairs(n: int, t: float):
    """Sets of two blocks (``block`` and ``other`` of each; of one, if these are equal) -> their similar pairs with one in the ball at least."""

    def run(sets: pd.DataFrame) -> pd.DataFrame:
        tokens, distinct, starts, sizes, uniq = _tokens(sets, lambda texts: gram_blocks(texts, n))
        names, first = np.unique(sets["sid"].to_numpy(), return_index=True)
        at = first[np.searchsorted(names, uniq)]
        own, block = sets["own"].to_numpy()[at].astype(bool), sets["block"].to_numpy()[at]
        if sets["block"].iloc[0] == sets["other"].iloc[0]:
            ia, ib = np.triu_indices(len(uniq), 1)
        else:
            first = min(sets["block"].iloc[0], sets["other"].iloc[0])
            low, high = np.flatnonzero(block == first), np.flatnonzero(block > first)
            ia, ib = np.repeat(low, len(high)), np.tile(high, len(low))
        ok = own[ia] | own[ib]
        return _similar(tokens, distinct, starts, sizes, uniq, ia[ok], ib[ok], t)

    return run


def _verify(n: int, t: float):
    return lambda pairs, sets: verify(pairs, sets, lambda texts: gram_blocks(texts, n), t)


def linked(found: pd.DataFrame) -> pd.DataFrame:
    """Verified pairs -> per set its links among them and the least set that they connect it to."""
    names, ranks = np.unique(np.concatenate([found["a"].to_numpy(), found["b"].to_numpy()]), return_inverse=True)
    a, b = ranks[: len(found)], ranks[len(found) :]
    root = np.arange(len(names))
    while len(a):
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return pd.DataFrame({"sid": names, "links": np.bincount(ranks, minlength=len(names)), "root": names[root]})


def _gram_sets(n: int, shared=None):
    """The sets of texts, without those in a ball of the ``shared`` pivots."""

    def sets(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, _, grams, sizes in gram_blocks(texts, n):
            sizes = sizes[sizes > 0]
            if shared is not None and len(sizes):
                out = shared.value.around_of(grams, sizes)[0] == len(shared.value.sizes)
                grams, sizes = grams[np.repeat(out, sizes)], sizes[out]
            yield grams, sizes

    return sets


def candidate_pairs(rows: DataFrame, sets, t: float, levels: np.ndarray, frequent: int, prefixes: int, m: int, bits: bool = False, per_bucket: int | None = None) -> DataFrame:
    """Distinct (a, b) of set hashes, a < b, that may have Jaccard >= ``t`` as they share ``m`` signatures; ``rows`` has ``text``.

    ``bits`` sends each set's ``parities`` along, for sets of up to some 200 tokens.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(levels)
    buckets, reducers = max(1, -(-prefixes // (per_bucket or PER_BUCKET))), int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = rows.select("text").mapInPandas(_index(sets, t, shared, frequent, buckets, m, bits), "bucket int, h binary, p binary, n binary, sids binary, sizes binary, low binary, high binary")
    # a bucket is a task
    met = index.repartitionById(buckets, F.col("bucket")).mapInPandas(_candidates(t, m, frequent, reducers, bits), "reducer int, pairs long, blob binary")
    return staged(met.repartitionById(reducers, F.col("reducer")).mapInPandas(_merged(m), "a long, b long"), "candidates")


def placed_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the ``slot`` to verify them in. Those whose first has the same
    smallest neighbour go together, in slices of at most about PAIRS_PER_SLICE;
    a slot has several such groups."""
    spark = pairs.sparkSession
    label = pairs.select(F.col("a").alias("s"), F.col("a").alias("o")).union(pairs.select("b", "a")).groupBy("s").agg(F.min("o").alias("g"))
    placed = pairs.join(label, pairs.a == label.s).select("a", "b", "g")
    slices = F.ceil(F.count("*").over(W.partitionBy("g")) / PAIRS_PER_SLICE)
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // PAIRS_PER_SLOT))
    return staged(placed.select("a", "b", F.pmod(F.xxhash64("g", F.pmod(F.xxhash64("a"), slices)), F.lit(slots)).cast("int").alias("slot")), "placed")


def _ball_sets(docs: DataFrame, reps: DataFrame, shared, n: int) -> tuple[DataFrame, DataFrame]:
    """(slot, sid, text, own, block, other): texts of the sets to compare for the balls, each slot two blocks of a ball; table to drop"""
    balls = staged(docs.select("text").mapInPandas(_balls(n, shared), "pivot int, sid long, size int, own boolean").distinct(), "jaccard-balls")
    rows = balls.groupBy("pivot").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.sum(F.col("own").cast("long")).alias("own")).where("own > 0").orderBy("pivot").collect()
    base, numbers = 0, []
    for r in rows:
        blocks = max(-(-r["n"] // BLOCK_SETS), -(-r["tokens"] // BLOCK_TOKENS))
        numbers.append((r["pivot"], base, blocks))
        base += blocks * blocks
    plan = docs.sparkSession.createDataFrame(numbers, "pivot int, base long, blocks long")
    wanted = balls.join(F.broadcast(plan), "pivot").join(reps.select("sid", F.col("rep").alias("id")), "sid")
    wanted = staged(wanted.select("id", "sid", "own", "base", "blocks", F.pmod(F.xxhash64("sid"), F.col("blocks")).alias("block")), "jaccard-wanted")
    dropped(balls)
    each = docs.join(sized(wanted), "id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    slot = F.col("base") + F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    return each.select(slot.alias("slot"), "sid", "text", "own", "block", "other"), wanted


def _gathered(docs: DataFrame, t: float, n: int, result, schema: str):
    """(id, size, sid of each document; smallest id of each sid; ``result`` of the similar pairs of each slot; tables to drop)"""
    spark = docs.sparkSession
    profile = staged(docs.mapInPandas(_profile(n), "id long, size int, sid long, key long, slice int, blob binary"), "jaccard-profile")
    known = staged(profile.where("slice < 0").select("id", "size", "sid", "key").distinct(), "jaccard-known")
    totals = known.agg(F.sum("size"), F.sum(F.ceil(F.col("size") * (1 - t)) + SHARED_GRAMS)).first()
    grams, prefixes = (int(x or 0) for x in totals)
    levels = _sketch.classes(profile.where("slice >= 0"))
    dropped(profile)
    reps = staged(known.groupBy("sid").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("key").alias("key")), "jaccard-reps")
    frequent = int(round(2 * math.log2(4 * grams / _sketch.WIDTH + 1024)))
    pivots = _found_pivots(docs, reps, t, n)
    shared = spark.sparkContext.broadcast(pivots) if pivots else None
    pairs = candidate_pairs(docs, _gram_sets(n, shared), t, levels, frequent, prefixes, SHARED_GRAMS)
    placed = placed_pairs(pairs)
    dropped(pairs)
    members = placed.select("slot", F.col("a").alias("sid")).union(placed.select("slot", "b")).distinct()
    members = staged(members.join(reps, "sid").select("sid", "slot", F.col("rep").alias("id")), "jaccard-members")
    sets = docs.join(sized(members), "id").select("slot", "sid", "text")
    found = placed.groupBy("slot").cogroup(sets.groupBy("slot")).applyInPandas(lambda pairs, sets: result(_verify(n, t)(pairs, sets)), schema)
    held = [known, reps, placed, members]
    if pivots:
        near, wanted = _ball_sets(docs, reps, shared, n)
        compared = _block_pairs(n, t)
        found = found.union(near.groupBy("slot").applyInPandas(lambda sets: result(compared(sets)), schema))
        held.append(wanted)
    return known.select("id", "size", "sid"), reps.select("sid", "rep", "copies"), found, held


def _prepared(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    return spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).where("id IS NOT NULL AND text IS NOT NULL")


def ngram_jaccard_join(docs: DataFrame, threshold: float = 0.6, n: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of documents whose word ``n``-gram sets have Jaccard >= ``threshold``.

    Returns (doc_id_a, doc_id_b, jaccard), a < b. Documents with equal sets are
    represented by the smallest id of them: it alone pairs with near copies, and
    it pairs with each of its equals at jaccard 1; the pairs left out follow
    from these. NULL ids, NULL texts and texts without a word are in no pair;
    rows that repeat an id and its text count once; an empty table gives no
    pairs; other columns are ignored. A text below ``n`` words is one gram.
    ``threshold`` lies in (0, 1]. Sets are told apart by 64-bit hashes.
    """
    t = float(threshold)
    known, reps, checked, held = _gathered(_prepared(docs, t, id_col, text_col), t, n, lambda found: found, "a long, b long, jaccard double")
    ra, rb = reps.select(F.col("sid").alias("a"), F.col("rep").alias("ra")), reps.select(F.col("sid").alias("b"), F.col("rep").alias("rb"))
    near = checked.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("doc_id_a"), F.greatest("ra", "rb").alias("doc_id_b"), "jaccard")
    same = known.join(reps, "sid").where("id <> rep").select(F.col("rep").alias("doc_id_a"), F.col("id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    out = staged(near.union(same).groupBy("doc_id_a", "doc_id_b").agg(F.round(F.max("jaccard"), 6).alias("jaccard")), "jaccard")
    dropped(*held)
    return out


def jaccard_classes(docs: DataFrame, threshold: float = 0.6, n: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same join in a row per document: (doc_id, class_id, copy_of, copies, links).

    ``links`` is the number of other gram sets with Jaccard >= ``threshold`` to the
    document's, each counted whatever the size of its group; ``copy_of`` the smallest
    id with an equal set and ``copies`` how many ids have it; ``class_id`` the smallest
    id that links and equal sets lead to. A document without links or equals is
    a class of its own, and so is one whose text is NULL or has no word, with 0
    ``copies``. NULL ids have no row; rows that repeat an id are one: with several
    texts it has the sets of all of them, its ``copy_of`` is the least and its ``links``
    their sum. An empty table gives no rows; other columns are ignored.
    """
    t = float(threshold)
    known, reps, found, held = _gathered(_prepared(docs, t, id_col, text_col), t, n, linked, "sid long, links long, root long")
    found = staged(found, "jaccard-links")
    rep = reps.select("sid", "rep")
    edges = found.where("sid <> root").select("sid", "root").distinct()
    edges = edges.join(rep, "sid").select("root", F.col("rep").alias("doc_id_b")).join(rep.withColumnRenamed("sid", "root"), "root").select(F.col("rep").alias("doc_id_a"), "doc_id_b")
    same = known.join(rep, "sid").where("id <> rep").select(F.col("rep").alias("doc_id_a"), F.col("id").alias("doc_id_b"))
    groups = duplicate_groups(edges.union(same))
    per = known.join(reps, "sid").join(found.groupBy("sid").agg(F.sum("links").alias("links")), "sid", "left")
    per = per.groupBy("id").agg(F.min("rep").alias("copy_of"), F.sum("copies").alias("copies"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    out = ids.join(per, ids["doc_id"] == per["id"], "left").join(groups, "doc_id", "left")
    first = F.coalesce("copy_of", "doc_id")
    out = staged(out.select("doc_id", F.least(F.coalesce("group_id", "doc_id"), first).alias("class_id"), first.alias("copy_of"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links")), "jaccard-classes")
    dropped(*held, found)
    return out


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """Connected components of (doc_id_a, doc_id_b): (doc_id, group_id).

    ``group_id`` is the smallest id of the component. Alternates large-star and
    small-star steps, each a shuffle of the remaining edges, until they no
    longer change; no step holds a component in one place. NULL ids are
    dropped, and a document of no pair has no row.
    """
    edges = staged(pairs.select(F.col("doc_id_a").alias("u"), F.col("doc_id_b").alias("v")).where("u <> v").distinct(), "groups")
    by_u = W.partitionBy("u")
    mark = None
    while True:
        both = edges.union(edges.select("v", "u"))
        large = both.withColumn("m", F.least("u", F.min("v").over(by_u))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        low = down.withColumn("m", F.min("v").over(by_u))
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct()
        after = staged(small, "groups")
        dropped(edges)
        edges = after
        new = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(v, u) % 1000003)")).first())
        if new == mark:
            break
        mark = new
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).union(edges.select("v", "v").distinct())


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.6, n: int = 2) -> DataFrame:
    """``docs`` without all but the smallest doc_id of each class of ``jaccard_classes``.

    Rows with a NULL doc_id or without words are kept. Rows that repeat a doc_id
    are kept or dropped together. Columns are those of ``docs``.
    """
    classes = jaccard_classes(docs, threshold, n)
    gone = staged(classes.where("doc_id <> class_id").select("doc_id"), "gone")
    dropped(classes)
    return docs.alias("l").join(sized(gone).alias("r"), F.expr("l.doc_id = r.doc_id"), "left_anti")
