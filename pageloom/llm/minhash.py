"""SuperMinHash signatures of word-shingle sets.

Every element draws a random permutation of the m slots and offers slot p[j] the value j + r, r uniform in [0, 1); a
slot keeps its least offer. Ranks of one element are a permutation, so its offers spread evenly over the slots, which makes
the similarity estimate vary less than independent minima do. Since an offer of step j is at least j, the steps end as soon
as every slot holds less than the next step. Steps run over all elements of many documents at once; documents that are
settled drop out.
"""

from __future__ import annotations

import numpy as np

from pageloom.llm.words import Words, mix, runs

_U = np.uint64


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of all rows, one after the other, and each row's first place in them.

    A row with fewer than k words (but any) has its whole sequence as its only shingle.
    """
    first, n = w.first, np.diff(w.first)
    rows = len(n)
    all_runs = runs(w.hash, k)
    row = w.row_of()
    at = np.arange(len(row)) - first[:-1][row]
    good = np.flatnonzero(at[: len(all_runs)] <= (n[row] - k)[: len(all_runs)])
    values, owner = all_runs[good], row[good]
    for i in np.flatnonzero((n > 0) & (n < k)):
        short = runs(w.hash[first[i] : first[i + 1]], int(n[i]), 1)
        values, owner = np.concatenate([values, short]), np.concatenate([owner, [i]])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(rows + 1))


def signatures(values: np.ndarray, first: np.ndarray, m: int, piece: int = 1 << 16) -> np.ndarray:
    """Signature matrix (rows, m) of the sets ``values[first[i]:first[i+1]]``; rows of empty sets stay infinite."""
    rows = len(first) - 1
    h = np.full((rows, m), np.inf)
    owner = np.repeat(np.arange(rows), np.diff(first))
    for low in range(0, len(values), piece):
        v, o = values[low : low + piece], owner[low : low + piece]
        _offer(h, v, o, m)
    return h


def _offer(h: np.ndarray, v: np.ndarray, o: np.ndarray, m: int) -> None:
    flat = h.reshape(-1)
    perm: np.ndarray | None = None
    for j in range(m):
        if j:
            low, high = o[0], o[-1] + 1
            keep = (h[low:high].max(axis=1) >= j)[o - low]
            if not keep.all():
                v, o = v[keep], o[keep]
                if perm is not None:
                    perm = perm[keep]
        if not len(v):
            return
        x = mix(v, j + 1)
        r = (x >> _U(11)).astype(np.float64) * 2.0**-53
        k = j + ((mix(x, 991) >> _U(32)) * _U(m - j) >> _U(32)).astype(np.int64)
        if j == 0:
            slot = k
            first_slot = k
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint16), (len(v), 1))
                if len(first_slot) != len(v):
                    first_slot = first_slot[keep]
                at = np.arange(len(v))
                perm[at, first_slot] = 0
                perm[:, 0] = first_slot
            at = np.arange(len(v))
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
        np.minimum.at(flat, o * m + slot, j + r)


def bands(h: np.ndarray, rows: int) -> np.ndarray:
    """Band hashes (documents, m // rows) as signed 64-bit values."""
    bits = np.ascontiguousarray(h).view(np.uint64)
    n, m = h.shape
    out = np.empty((n, m // rows), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(m // rows):
            x = np.full(n, b + 1, dtype=np.uint64)
            for c in range(b * rows, (b + 1) * rows):
                x = mix(x * _U(0x9E3779B97F4A7C15) + bits[:, c])
            out[:, b] = x
    return out.view(np.int64)
