"""Signatures of an exact set similarity join by partitions of the universe.

Two sets with Jaccard similarity of at least ``t`` differ in at most ``h = k * (a + b)`` elements,
``a`` and ``b`` their sizes and ``k = (1 - t) / (1 + t)``. If the universe is hashed into ``m`` segments and
the segments are given allowances ``v`` of 0, 1 or 2 that add up to more than ``h``, then some segment with
``v > 0`` differs in fewer than ``v`` elements: it is equal (``v = 1``) or one element apart (``v = 2``).
So it suffices to look up, for each set, its segments with ``v > 0``, and for ``v = 2`` also each segment
with one element left out. With ``r - 1`` more segments of allowance 1, at least ``r`` of them must be equal,
so pairs with fewer equal segments (``shared``) fall away before any set is compared.

Sets are grouped into size bands. A set is indexed under its own band and looks for partners of at most its
own size in that band and in the one below. Bands of small sets use few segments of allowance 2, bands of
large sets many of allowance 1; within a band each set spends its allowance on the segments whose
content is rarest (``hot`` gives the document frequency of shingles that are not rare).
"""

from __future__ import annotations

import math

import numpy as np

INDEX, PROBE, LESS = 1, 2, 4
#: Bits of an element's hash; the rest of a 64-bit number holds the place of its set in a batch.
HASH_BITS = 50


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (the splitmix constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct_sets(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct upper ``HASH_BITS`` bits of 64-bit hashes by owner (0 to n - 1), sorted, and the bounds of each owner's part (n + 1)."""
    if n > 2 ** (64 - HASH_BITS):
        raise ValueError("too many sets in a batch")
    # owner and hash in one number: sorting plain integers is much faster than sorting by two keys
    key = np.sort((owner.astype(np.uint64) << np.uint64(HASH_BITS)) | (hashes >> np.uint64(64 - HASH_BITS)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount((key >> np.uint64(HASH_BITS)).astype(np.int64), minlength=n), out=bounds[1:])
    return key & np.uint64(2**HASH_BITS - 1), bounds


class Bands:
    """Size bands of a threshold with the number of segments of each."""

    def __init__(self, threshold: float, slack: float = 0.2, small: int = 48, shared: int = 4, largest: int = 2**31):
        self.t, self.k, self.shared = threshold, (1 - threshold) / (1 + threshold), shared
        self.low, self.high = [], []
        low = 1
        while low <= largest:
            high = max(low, self._div(low))
            self.low.append(low)
            self.high.append(high)
            low = high + 1
        self.high_array = np.array(self.high, np.int64)
        #: allowance of a segment and number of segments, by band
        self.allow = np.where(self.high_array <= small, 2, 1)
        need = np.array([self.differ(self._div(r), r) + 1 for r in self.high], np.int64)
        self.segments = np.ceil(np.where(self.allow == 2, (need + 1) // 2, need + shared - 1) * np.where(self.allow == 2, 1.0, 1 + slack)).astype(np.int64)

    def _div(self, size: int) -> int:
        """The largest size that a partner of a set of this size can have."""
        return int(math.floor(size / self.t + 1e-9))

    def differ(self, a: int, b: int) -> int:
        """The most elements in which sets of these sizes can differ."""
        return int(math.floor(self.k * (a + b) + 1e-9))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high_array, sizes)


def signatures(
    sets: np.ndarray, bounds: np.ndarray, bands: Bands, hot: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, owner and flags of each entry; flags say whether it is indexed, probed, and lacks an element.

    ``sets`` and ``bounds`` are as from ``shingle_sets``; empty sets have no signatures.
    """
    sizes = np.diff(bounds)
    band = bands.of(sizes)
    cost_of = _frequency(sets, hot)
    out = []
    for below in (0, 1):
        for b in np.unique(band[sizes > 0]):
            at = b - below
            if at < 0:
                continue
            own = np.flatnonzero((band == b) & (sizes > 0))
            if below:  # only those that can have a partner there
                own = own[bands.high_array[at] >= np.ceil(bands.t * sizes[own] - 1e-9)]
            if len(own):
                out.append(_of_band(sets, bounds, sizes, own, at, bands, cost_of, index=not below))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _frequency(sets: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    keys, counts = hot
    if not len(keys):
        return np.ones(len(sets), np.float32)
    at = np.minimum(np.searchsorted(keys, sets), len(keys) - 1)
    return np.where(keys[at] == sets, counts[at], 1).astype(np.float32)


def _of_band(sets, bounds, sizes, own, at, bands, cost_of, index):
    at = int(at)
    m, allow = int(bands.segments[at]), int(bands.allow[at])
    n = sizes[own]
    starts = np.concatenate([[0], np.cumsum(n)])
    element = np.repeat(bounds[own] - starts[:-1], n) + np.arange(starts[-1])
    h = sets[element]
    local = np.repeat(np.arange(len(own)), n)
    segment = local * m + (mix(h) % np.uint64(m)).astype(np.int64)
    salted = mix(h + np.uint64(0x51ED2701 * (at + 1)))
    total = _sum(segment, salted, len(own) * m)
    count = np.bincount(segment, minlength=len(own) * m)
    tag = np.tile(np.arange(m, dtype=np.uint64), len(own))
    # the rarest element bounds how many other sets can hold the same content
    cost = np.full(len(own) * m, np.float32(1e9))
    np.minimum.at(cost, segment, cost_of[element])
    cost = cost.reshape(len(own), m) / np.maximum(count.reshape(len(own), m), 1) ** 2
    partner = np.minimum(bands.high_array[at], n)
    need = np.floor(bands.k * (n + partner) + 1e-9).astype(np.int64) + 1
    take = -(-need // allow) if allow == 2 else need + bands.shared - 1
    rank = np.empty_like(cost, dtype=np.int64)
    np.put_along_axis(rank, np.argsort(cost, axis=1, kind="stable"), np.arange(m)[None, :], axis=1)
    probe = (rank < take[:, None]).ravel()
    kept = np.ones(len(own) * m, bool) if index else probe
    full = np.flatnonzero(kept)
    salt = np.uint64(0x9E3779B97F4A7C15 * (at + 1) % 2**64)
    flags = (INDEX if index else 0) | np.where(probe, PROBE, 0)
    parts = [(mix(total[full] + tag[full] * salt), full // m, flags[full])]
    if allow == 2:
        inside = np.flatnonzero(kept[segment])
        seg = segment[inside]
        parts.append((mix(total[seg] - salted[inside] + tag[seg] * salt), seg // m, flags[seg] | LESS))
    sig, owner, flag = (np.concatenate(x) for x in zip(*parts, strict=True))
    return sig, own[owner], flag.astype(np.uint8)


def _sum(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values modulo 2^64 by position, exact: in three parts that floats can hold."""
    out = np.zeros(n, np.uint64)
    for shift, bits in ((0, 22), (22, 22), (44, 20)):
        part = (values >> np.uint64(shift)) & np.uint64(2**bits - 1)
        out += np.bincount(where, part.astype(np.float64), n).astype(np.uint64) << np.uint64(shift)
    return out


def matches(
    sig: np.ndarray, owner: np.ndarray, flags: np.ndarray, sizes: np.ndarray, bands: Bands, block: int = 4_000_000
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (larger or equal set, other set) and the number of segments they share.

    A pair is a candidate once its numbers from all parts of the signatures add up to ``bands.shared``.

    ``sizes`` by owner. Pairs whose sizes rule them out are left out. Works through the groups in blocks.
    """
    order = np.lexsort((owner, sig))
    sig, owner, flags = sig[order], owner[order], flags[order]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    length = np.diff(np.append(start, len(sig)))
    big = length > 1
    start, length = start[big], length[big]
    group = np.repeat(np.arange(len(start)), length)
    entry = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    ask = (flags[entry] & PROBE) > 0
    group, entry = group[ask], entry[ask]
    work = np.cumsum(length[group])
    out = []
    i = 0
    while i < len(entry):
        j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + block)))
        g, e = group[i:j], entry[i:j]
        n = length[g]
        other = np.repeat(start[g] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        e = np.repeat(e, n)
        a, b = owner[e], owner[other]
        ok = (a != b) & ((flags[other] & INDEX) > 0) & ((flags[e] & flags[other] & LESS) == 0)
        ok &= (sizes[b] < sizes[a]) | ((sizes[b] == sizes[a]) & (a > b))
        ok &= sizes[b] >= bands.t * sizes[a] - 1e-9
        if ok.any():
            out.append(np.unique(a[ok].astype(np.uint64) << np.uint64(32) | b[ok].astype(np.uint64), return_counts=True))
        i = j
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    pairs, at = np.unique(np.concatenate([x for x, _ in out]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([n for _, n in out])).astype(np.int64)
    a, b = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return a, b, np.where(bands.allow[bands.of(sizes[b])] == 2, bands.shared, counts)
