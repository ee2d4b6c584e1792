"""Blockwise suffix sorting with a difference cover: which of the suffixes of a block agree in their first bytes.

The suffixes are sorted by their first WIDTH bytes. Those that tie are sorted on by three-way partition, where two
suffixes are compared at the next offset at which both stand at a sample position: samples stand at the residues of a
difference cover, so there is one within the first V bytes, and the samples' ranks are computed before. Memory is a
small multiple of the block, whatever the ties.
"""

from __future__ import annotations

import numpy as np

from .common import prefix

V, WIDTH = 31, 32
#: A perfect difference set; each residue modulo V is a difference of two of these.
COVER = (1, 5, 11, 24, 25, 27)


def shifts() -> np.ndarray:
    """For two residues, the least shift that brings both into the cover."""
    out = np.zeros((V, V), np.int64)
    for a in range(V):
        for b in range(V):
            out[a, b] = next(d for d in range(V) if (a + d) % V in COVER and (b + d) % V in COVER)
    return out


SHIFT = shifts()


def dense(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Rank of each item, equal for equal keys, given the order that sorts them."""
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(heads: np.ndarray, n: int, blocks: int) -> np.ndarray:
    """Ranks of the sample positions below n by the ``blocks`` times V bytes from there on; 0 elsewhere.

    Ranks of V bytes are doubled, and the last step lets two of the longest overlap.
    """
    inside = np.zeros(V, bool)
    inside[list(COVER)] = True
    at = np.flatnonzero(inside[np.arange(n) % V])
    room = np.zeros(n + V * blocks + 1, np.int64)
    keys = [heads[np.minimum(at + 8 * k, len(heads) - 1)] for k in range(4)]
    keys[3] = keys[3] >> np.uint64(8)  # V bytes: the last word but one byte
    rank, have = dense(np.lexsort(keys[::-1]), keys), 1
    while have < blocks:
        more = min(have, blocks - have)
        room[at] = rank
        pair = (rank << 32) | room[at + V * more]
        rank, have = dense(np.argsort(pair, kind="stable"), [pair]), have + more
    room[at] = rank
    return room


def repeated(data: np.ndarray, start: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each start equal those at another start of the same bucket. All lie within ``data``."""
    out = np.zeros(len(start), bool)
    if len(start) < 2:
        return out
    heads = prefix(data).byteswap()  # so that numbers are in the order of bytes
    keys = [heads[start + 8 * k] for k in range(WIDTH // 8)]
    order = np.lexsort([*keys[::-1], bucket])
    group = dense(order, [bucket, *keys])[order]
    blocks = max(1, (length - V + 1) // V)
    ranks = cover_ranks(heads, len(data), blocks)
    tail = [length - 8 * k for k in range((length - V * blocks + 7) // 8, 0, -1)]
    while True:
        size = np.bincount(group)
        tied = size[group] > 1
        order, group = order[tied], group[tied]
        if not len(order):
            return out
        _, first, group = np.unique(group, return_index=True, return_inverse=True)
        size = np.bincount(group)
        p = start[order]
        q = p[first + size // 2][group]  # the pivot of each group
        shift = SHIFT[p % V, q % V]
        side = np.sign(ranks[p + shift] - ranks[q + shift])
        even = np.flatnonzero(side == 0)
        for t in tail:
            a, b = heads[p[even] + t], heads[q[even] + t]
            side[even] = np.where(a < b, -1, np.where(a > b, 1, 0))
            even = even[a == b]
        many = np.bincount(group[even], minlength=len(size)) > 1
        out[order[even]] = many[group[even]]
        rest = side != 0
        order, part = order[rest], 2 * group[rest] + (side[rest] > 0)
        by = np.argsort(part, kind="stable")
        order, group = order[by], part[by]
