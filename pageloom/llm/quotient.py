"""Counting quotient filters over word-id n-grams: lossless, compact, sorted, mergeable.

An n-gram of up to three word ids of ``b`` bits is packed into ``3 * b`` bits (a missing third id is 0) and scrambled by a
Feistel network, which is a permutation, so no two n-grams share a key and every key can be turned back. The scrambled key is
spread evenly whatever the words. Its leading bits name the shard and, after those, the quotient; the other bits are the
remainder, kept in full. A filter holds the entries in order of quotient and remainder: one bit string says in unary how
many entries each quotient has, remainders take their whole bytes, counters one byte (larger ones an escape and eight).
Two filters are merged as sorted runs; equal keys add their counters.

Keys are kept in two halves of at most 48 bits, so ids may have up to 32 bits.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from pageloom.llm.words import mix

ROUNDS = 4
_HEAD = struct.Struct("<BBBQQ")
_U = np.uint64


def _mask(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


def halves(bits: int) -> tuple[int, int]:
    """Bits of the two halves of a packed key of three ids."""
    return 3 * bits - 3 * bits // 2, 3 * bits // 2


def scramble(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of n-grams (rows of three ids) as two halves."""
    wl, wr = halves(bits)
    upper, lower = wl - bits, 2 * bits - wl
    a, b, c = (ids[:, i].astype(np.uint64) for i in range(3))
    left = a << _U(upper) | b >> _U(lower)
    right = (b & _mask(lower)) << _U(bits) | c
    for i in range(ROUNDS):
        left ^= mix(right, 2 * i + 11) & _mask(wl)
        right ^= mix(left, 2 * i + 12) & _mask(wr)
    return left, right


def unscramble(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    wl, wr = halves(bits)
    upper, lower = wl - bits, 2 * bits - wl
    left, right = left.copy(), right.copy()
    for i in reversed(range(ROUNDS)):
        right ^= mix(left, 2 * i + 12) & _mask(wr)
        left ^= mix(right, 2 * i + 11) & _mask(wl)
    middle = (left & _mask(upper)) << _U(lower) | right >> _U(bits)
    return np.stack([left >> _U(upper), middle, right & _mask(bits)], axis=1).astype(np.int64)


def _planes(values: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` of each value in whole bytes."""
    size = -(-bits // 8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _values(raw: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    size = -(-bits // 8)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(n, size)
    return out.view("<u8").reshape(-1).astype(np.uint64), at + n * size


@dataclass
class Filter:
    """Keys in order, with a counter each; ``bits`` are those of an id."""

    bits: int
    left: np.ndarray
    right: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, count: np.ndarray, bits: int) -> Filter:
        """Counted n-grams, each once."""
        left, right = scramble(ids, bits)
        order = _order(left, right, bits)
        return Filter(bits, left[order], right[order], count[order].astype(np.int64))

    def ids(self) -> np.ndarray:
        return unscramble(self.left, self.right, self.bits)

    def cut(self, lead: int, more: int) -> list[tuple[int, Filter]]:
        """Parts by the ``lead + more`` leading bits of the key, with those bits."""
        if lead + more == 0 or not len(self.left):
            return [(0, self)] if len(self.left) else []
        prefix = (self.left >> _U(halves(self.bits)[0] - lead - more)).astype(np.int64)
        at = np.flatnonzero(np.diff(prefix, prepend=prefix[0] - 1))
        to = np.append(at[1:], len(prefix))
        return [(int(prefix[a]), Filter(self.bits, self.left[a:b], self.right[a:b], self.count[a:b])) for a, b in zip(at.tolist(), to.tolist(), strict=True)]

    def pack(self, lead: int) -> bytes:
        """The filter's bytes; all keys share their ``lead`` leading bits, which are left out."""
        wl, wr = halves(self.bits)
        n = len(self.left)
        q = min(wl - lead, max(n - 1, 0).bit_length())
        rest = wl - lead - q
        quotient = ((self.left & _mask(wl - lead)) >> _U(rest)).astype(np.int64)
        unary = np.zeros(n + (1 << q), dtype=np.uint8)
        unary[quotient + np.arange(n)] = 1
        large = self.count >= 255
        return b"".join([
            _HEAD.pack(self.bits, lead, q, n, int(large.sum())), np.packbits(unary).tobytes(), _planes(self.left & _mask(rest), rest),
            _planes(self.right, wr), np.where(large, 255, self.count).astype(np.uint8).tobytes(), self.count[large].astype("<i8").tobytes(),
        ])

    @staticmethod
    def unpack(raw: bytes, prefix: int) -> Filter:
        bits, lead, q, n, escapes = _HEAD.unpack_from(raw)
        wl, wr = halves(bits)
        rest, at = wl - lead - q, _HEAD.size
        size = -(-(n + (1 << q)) // 8)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n + (1 << q)))
        quotient = (ones - np.arange(n)).astype(np.uint64)
        low, at = _values(raw, at + size, n, rest)
        right, at = _values(raw, at, n, wr)
        count = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
        if escapes:
            count[count == 255] = np.frombuffer(raw, "<i8", escapes, at + n)
        left = _U(prefix << (wl - lead)) | quotient << _U(rest) | low
        return Filter(bits, left, right, count)


def _order(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Places of keys in ascending order; sorted runs one after the other are merged rather than sorted anew."""
    if 3 * bits <= 64:
        return np.argsort(left << _U(halves(bits)[1]) | right, kind="stable")
    return np.lexsort((right, left))


def merge(filters: list[Filter]) -> Filter:
    """One filter with the counters of all; at least one filter, all of ids of the same number of bits."""
    if len(filters) == 1:
        return filters[0]
    left, right = np.concatenate([f.left for f in filters]), np.concatenate([f.right for f in filters])
    count = np.concatenate([f.count for f in filters])
    order = _order(left, right, filters[0].bits)
    left, right, count = left[order], right[order], count[order]
    new = np.ones(len(left), dtype=bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at = np.flatnonzero(new)
    return Filter(filters[0].bits, left[at], right[at], np.add.reduceat(count, at) if len(at) else count)
