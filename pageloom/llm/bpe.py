"""Byte-level BPE: encode whole texts to ids and back.

A text is cut by the tokenizer's pattern; every piece is encoded on its own. Two tiers: a minimal perfect hash over the
vocabulary answers pieces that are tokens themselves; any other piece starts as linked single bytes and a heap yields
the next merge (lowest rank, leftmost) until none is left. Pieces once seen are remembered per Python worker, up to
``REMEMBERED`` of them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from pageloom.llm.common import by_rows

REMEMBERED = 400_000


def _ranges(keep, stop: int) -> str:
    """A character class of the code points below ``stop`` for which ``keep`` holds (surrogates left out)."""
    out, begin = [], None
    for c in range(stop + 1):
        inside = c < stop and not 0xD800 <= c <= 0xDFFF and keep(chr(c))
        if inside and begin is None:
            begin = c
        elif not inside and begin is not None:
            out.append(f"\\U{begin:08x}" + (f"-\\U{c - 1:08x}" if c - 1 > begin else ""))
            begin = None
    return "".join(out)


@lru_cache(maxsize=2)
def splitter(stop: int = sys.maxunicode + 1) -> re.Pattern[str]:
    r"""The pattern 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+ for the standard library.

    Letters and numbers are spelt out as classes, and white space is Unicode's (without the separators 1C-1F). The
    alternatives before the last two begin with different characters, so the most frequent one may come first. For texts
    of code points below ``stop`` shorter classes do, which match several times faster.
    """
    letter = _ranges(lambda c: unicodedata.category(c)[0] == "L", stop)
    number = _ranges(lambda c: unicodedata.category(c)[0] == "N", stop)
    space = _ranges(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f", stop)
    return re.compile(
        f" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def pieces(text: str) -> list[str]:
    """The tokenizer's pieces of a text; together they are the text."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return splitter().findall(text)
    return splitter(256).findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token, blank, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class PerfectHash:
    """Minimal perfect hash by displacement: as many slots as keys, one probe and one comparison per look-up.

    Keys fall into small buckets; the largest buckets first look for a displacement that sends all their keys to free
    slots; buckets of one key take the slots that are left, whose number is stored instead (below zero).
    """

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        n = max(1, len(keys))
        buckets: dict[int, list[int]] = {}
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        self.width = max(1, n // 3)
        for i, h in enumerate(hashes):
            buckets.setdefault(h % self.width, []).append(i)
        self.shift = [0] * self.width
        self.keys: list[bytes | None] = [None] * n
        self.values = [-1] * n
        taken = bytearray(n)
        single = []
        for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                single.append((b, members[0]))
                continue
            d = 0
            while True:
                slots = []
                for i in members:
                    s = self._slot(hashes[i], d, n)
                    if taken[s] or s in slots:
                        break
                    slots.append(s)
                else:
                    break
                d += 1
            self.shift[b] = d
            for i, s in zip(members, slots, strict=True):
                taken[s] = 1
                self.keys[s], self.values[s] = keys[i], ranks[keys[i]]
        free = (s for s in range(n) if not taken[s])
        for b, i in single:
            s = next(free)
            self.shift[b] = -s - 1
            self.keys[s], self.values[s] = keys[i], ranks[keys[i]]

    @staticmethod
    def _slot(h: int, d: int, n: int) -> int:
        return ((h >> 32) + d * ((h & 0xFFFFFFFF) | 1) ^ d) % n

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.width]
        s = -d - 1 if d < 0 else self._slot(h, d, len(self.keys))
        return self.values[s] if self.keys[s] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: repeatedly join the adjacent pair of lowest rank, the leftmost on a tie.

    Parts are nodes of a linked list over byte positions. The heap holds joins as rank and place; an entry is stale when
    the join now possible at its place has another rank.
    """
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that starts here ends
    begin = list(range(-1, n))  # where the part before it starts
    now = [ranks.get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]
    heap = [(r, i) for i, r in enumerate(now) if r >= 0]
    heapq.heapify(heap)
    while heap:
        rank, a = heapq.heappop(heap)
        if now[a] != rank:
            continue
        b = end[a]
        c = end[a] = end[b]
        now[b] = now[a] = -1
        if c < n:
            begin[c] = a
            r = now[a] = ranks.get(piece[a : end[c]], -1)
            if r >= 0:
                heapq.heappush(heap, (r, a))
        z = begin[a]
        if z >= 0:
            r = now[z] = ranks.get(piece[z:c], -1)
            if r >= 0:
                heapq.heappush(heap, (r, z))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """Piece of text -> its ids as little-endian 32-bit bytes, filled as pieces are met."""

    def __init__(self, path: str):
        self.ranks = ranks = read_ranks(path)
        self.perfect = PerfectHash(ranks)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.perfect.get(raw)
        ids = [whole] if whole >= 0 else merge(raw, self.ranks)
        out = np.array(ids, dtype="<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, pieces(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary of little-endian 32-bit ids) of every whole text; a null or empty text has no ids.

    Rows stay rows: repeated keys or texts are encoded as often as they occur, and a null key stays null.
    """

    def run(batch: pa.RecordBatch) -> dict:
        enc = encoder(path)
        return {"key": batch.column("key"), "ids": pa.array([enc.encode(t or "") for t in batch.column("text").to_pylist()], pa.binary())}

    return by_rows(docs.selectExpr(f"cast(`{key}` as bigint) as key", f"`{text}` as text"), run, "key bigint, ids binary").withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, raw binary): the bytes that the ids stand for."""

    def run(batch: pa.RecordBatch) -> dict:
        enc = encoder(path)
        raw = [enc.decode(np.frombuffer(b or b"", "<u4").tolist()) for b in batch.column("ids").to_pylist()]
        return {"key": batch.column("key"), "raw": pa.array(raw, pa.binary())}

    return by_rows(encoded.selectExpr(f"`{key}` as key", "ids"), run, "key bigint, raw binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, and the sha-256 of the ids and of the bytes decoded from them, in one pass over the texts."""

    def run(batch: pa.RecordBatch) -> dict:
        enc = encoder(path)
        n, ids_sha, raw_sha = [], [], []
        for t in batch.column("text"):
            ids = enc.encode(t.as_py() or "")
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            raw_sha.append(hashlib.sha256(enc.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
        return {"key": batch.column("key"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": raw_sha}

    rows = docs.selectExpr(f"cast(`{key}` as bigint) as key", f"`{text}` as text")
    return by_rows(rows, run, "key bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
