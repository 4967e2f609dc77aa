"""Language-model scoring by context-tree weighting over bytes.

A text is a sequence of bytes with one end symbol behind it. Every byte is eight binary decisions, so a byte belongs to a path
of eight nodes among 255. For each node there is a tree of contexts: none, the last byte, and so on up to the last ``DEPTH``
bytes. Every context counts the zeros and ones that followed it in training and gives the Krichevsky-Trofimov estimate of that
sequence; the weighted probability of a context is half its own estimate and half the product of the contexts that lengthen it.
After training this turns into a fixed mixture of the depths for each decision, and the product over a byte's eight decisions
is its probability. A context never met predicts one half, which is what the same formulas say.

A context of ``DEPTH`` bytes and the byte behind it are one 64-bit key, exactly. What is gathered is the number of times each
key occurs in training, which grows with the corpus and stays in Spark: a block, which is a run of rows of a partition, sends
its distinct keys, as compressed arrays, to buckets chosen by the last three bytes of the context, so that a bucket has all
contexts of depth 3 and more that it needs. Contexts of two bytes and less are bounded by the 2**24 byte trigrams whatever the
corpus size; the buckets give their counts and the folded weights of what lengthens them, the driver ends the fold and
broadcasts the upper tree (65,793 rows of 3 * 256 single-precision values at most), and the buckets answer each block with its
keys' log probabilities.

The base score needs the count of each word in the corpus, which has no such bound either: a block's distinct words travel with
its keys. Its texts are written once, compressed, beside both, and all three meet the answers by block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import blocks
from pageloom.llm.common import give_back
from pageloom.llm.words import _LOWER, CHUNK_BYTES, bytes_of, chunks, mix, words
from pageloom.session import bucketed, shuffles_forgotten

#: The end symbol, which no UTF-8 text holds; it also stands before a text's first bytes.
END = 0xFF


#: Bytes of the longest context; with the byte behind it they fill 64 bits.
DEPTH = 7
#: Depth of the contexts that a bucket has whole, and the bits of a bucket's number.
BUCKET_DEPTH = 3
BUCKET_BITS = 12
#: Bits of a bucket's number that differ between words.
WORD_BITS = 10
#: Keys that a task takes up before it folds them, at least; a bucket is never split.
GROUP_KEYS = 1 << 21
#: A block here has the text of so many blocks of other operators: the longer it is, the fewer keys travel.
BLOCKS = 3
#: What a row between blocks and buckets is about: a block's keys or words of one bucket, or some of its texts.
KEYS, WORDS, TEXTS = 0, 1, 2
_ROWS = "_block bigint, kind int, bucket int, m bigint, raw binary"


def context_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For all rows' bytes and end symbols in order their keys, and each row's first place.

    From its highest byte down a key has the byte before, the byte before that, and so on, and the byte itself as its lowest.
    """
    buffer, offsets = bytes_of(texts)
    n, rows = len(buffer), len(offsets) - 1
    if not rows:
        return np.zeros(0, np.uint64), offsets
    # end symbols that only serve as context, then each row's bytes and its end symbol
    begin = offsets + np.arange(rows + 1)
    inside = np.ones(n + rows, dtype=bool)
    inside[begin[1:] - 1] = False
    padded = np.full(DEPTH + n + rows, END, dtype=np.uint8)
    padded[DEPTH:][inside] = _LOWER[buffer]
    # eight bytes read as a little-endian number have the last byte on top; turned around it is the lowest
    read = np.ndarray(n + rows, "<u8", padded, strides=(1,))
    keys = read << np.uint64(8)
    keys |= read >> np.uint64(8 * DEPTH)
    # what lies before a row is not its context: end symbols, all bits set, take that place
    size = np.diff(begin)
    for i in range(min(DEPTH, int(size.max()))):
        keys[begin[:-1][size > i] + i] |= np.uint64((1 << 8 * (DEPTH - i)) - 1 << 8)
    return keys, begin


def _changes(values: np.ndarray) -> np.ndarray:
    """Whether a value differs from the one before it."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return new


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their numbers; the array given gets sorted."""
    values.sort()
    first = np.flatnonzero(_changes(values))
    distinct = values[first]
    first[:-1] = first[1:] - first[:-1]
    first[-1:] = len(values) - first[:-1].sum()
    return distinct, first


def _with_others(met: np.ndarray, times: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their numbers with other such values, whose numbers are 0 unless they are among the first."""
    at = np.searchsorted(met, others)
    new = np.ones(len(others), bool)
    new[at < len(met)] = met[at[at < len(met)]] != others[at < len(met)]
    return np.insert(met, at[new], others[new]), np.insert(times, at[new], 0)


def _summed(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the sums of their numbers, and each value's place among the distinct ones."""
    order = np.argsort(values)
    values = values[order]
    new = _changes(values)
    first, place = np.flatnonzero(new), np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return values[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64), place


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (mix(keys >> np.uint64(64 - 8 * BUCKET_DEPTH)) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)


def _word_bucket(h: np.ndarray) -> np.ndarray:
    """Words take every fourth bucket: they are fewer than keys."""
    return (h >> np.uint64(64 - WORD_BITS)).astype(np.uint16) << np.uint16(BUCKET_BITS - WORD_BITS)


_ZSTD, _SIZES, _NOTHING = pa.Codec("zstd"), struct.Struct("<QQ"), np.zeros(0, np.uint8)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays, each compressed by itself, behind their bytes' numbers before and after."""
    out = []
    for array in arrays:
        packed = _ZSTD.compress(array.tobytes(), asbytes=True) if array.size else b""
        out += [_SIZES.pack(array.nbytes, len(packed)), packed]
    return b"".join(out)


def _unpacked(raw: bytes) -> list[np.ndarray]:
    """The bytes of what ``_packed`` was given."""
    out, at = [], 0
    while at < len(raw):
        size, packed = _SIZES.unpack_from(raw, at)
        at += _SIZES.size
        out.append(np.frombuffer(_ZSTD.decompress(raw[at : at + packed], size), np.uint8) if size else _NOTHING)
        at += packed
    return out


def _planes(column: np.ndarray) -> np.ndarray:
    """An array's first bytes, then its second bytes and so on."""
    return column.view(np.uint8).reshape(len(column), column.itemsize).T


def _joined(planes: np.ndarray, kind: str) -> np.ndarray:
    """What ``_planes`` was given."""
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _small(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as one byte each, and those of 255 and more."""
    return np.minimum(n, 255).astype(np.uint8), n[n >= 255].astype("<i8")


def _whole(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """What ``_small`` was given."""
    n = small.astype(np.int64)
    n[small == 255] = large.view("<i8")
    return n


_EIGHT = np.arange(8, dtype=np.uint8)


#: A key's count and the number of bytes it shares with the key before are one byte; counts from here on are told apart.
MANY = 31


def _key_cells(keys: np.ndarray, n: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """Keys and counts from cut to cut, each part sorted: of a key the bytes that differ from the key before, from the first such on."""
    differ = keys.copy()
    differ[1:] ^= keys[:-1]
    shared = np.zeros(len(keys), np.uint8)
    for i in range(1, 8):
        shared += differ < np.uint64(1 << (64 - 8 * i))
    shared[cuts[:-1]] = 0
    del differ
    spelt = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[_EIGHT >= shared[:, None]]
    at = np.concatenate([[0], np.cumsum(8 - shared.astype(np.int64))])[cuts].tolist()
    both = shared | np.minimum(n, MANY).astype(np.uint8) << np.uint8(3)
    many = np.flatnonzero(n >= MANY)
    large, many = n[many].astype("<i8"), np.searchsorted(many, cuts).tolist()
    cuts, out = cuts.tolist(), []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
        out.append(_packed(both[a:b], large[many[i] : many[i + 1]], spelt[at[i] : at[i + 1]]))
    return out


def _cell_keys(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All keys and counts of the cells, in order."""
    both, large, spelt = (np.concatenate([_NOTHING, *parts]) for parts in list(zip(*map(_unpacked, cells), strict=True)) or [()] * 3)
    n = (both >> np.uint8(3)).astype(np.int64)
    n[n == MANY] = large.view("<i8")
    shared = both & np.uint8(7)
    table = np.zeros((len(shared), 8), np.uint8)
    table[_EIGHT >= shared[:, None]] = spelt
    for i in range(7):
        # a byte holds until it is spelt out again
        told = np.flatnonzero(shared <= i)
        table[:, i] = np.repeat(table[told, i], np.diff(np.append(told, len(shared))))
    return table.view(">u8").reshape(-1).astype(np.uint64), n


def _word_cells(h: np.ndarray, n: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """Sorted words and counts from cut to cut."""
    steps = h.copy()
    steps[1:] -= h[:-1]
    steps[cuts[:-1]] = h[cuts[:-1]]
    cuts, out = cuts.tolist(), []
    for a, b in zip(cuts, cuts[1:]):  # noqa: B905
        out.append(_packed(_planes(steps[a:b]), *_small(n[a:b])))
    return out


def _cell_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A cell's words and counts."""
    steps, small, large = _unpacked(raw)
    return np.cumsum(_joined(steps, "<u8"), dtype=np.uint64), _whole(small, large)


def _cuts(bucket: np.ndarray) -> np.ndarray:
    """First places of sorted buckets, and the end."""
    return np.append(np.flatnonzero(_changes(bucket)), len(bucket))


def _apart(part: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    """A part's training texts and its others."""
    held = part.column("held_out")
    return part.column("text").filter(pc.invert(held)), part.column("text").filter(held)


def _block_keys(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct keys by bucket, there sorted, how often they occur in its training texts, and where buckets begin."""
    # all training keys from the front, all others from the back: the one large array is sorted in place
    every = np.empty(sum(len(bytes_of(p.column("text"))[0]) + p.num_rows for p in parts), np.uint64)
    front, back = 0, len(every)
    for part in parts:
        training, others = _apart(part)
        own, _ = context_keys(others)
        every[back - len(own) : back] = own
        back -= len(own)
        own, _ = context_keys(training)
        every[front : front + len(own)] = own
        front += len(own)
    met, times = _distinct(every[:front])
    others, _ = _distinct(every[front:])
    del every
    keys, n = _with_others(met, times, others)
    del met, times, others
    # keys of a bucket lie in runs with the same last bytes of the context
    first = np.flatnonzero(_changes(keys >> np.uint64(64 - 8 * BUCKET_DEPTH)))
    bucket = _bucket(keys[first])
    order = np.argsort(bucket, kind="stable")
    size, bucket = np.diff(np.append(first, len(keys)))[order], bucket[order]
    at = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(first[order] - at[:-1], size) + np.arange(len(keys))
    return keys[place], n[place], at[_cuts(bucket)]


def _block_words(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct words, sorted, how often they occur in its training texts, and where buckets begin."""
    hashes = [[words(texts, lower=True).hash for texts in _apart(part)] for part in parts]
    training, others = map(np.concatenate, zip(*hashes, strict=True))
    h, n = _with_others(*_distinct(training), _distinct(others)[0])
    return h, n, _cuts(_word_bucket(h))


def _rows(block: int, kind: int, bucket: np.ndarray, m: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
    columns = [np.full(len(raw), block, np.int64), np.full(len(raw), kind, np.int32), bucket.astype(np.int32), m.astype(np.int64)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(raw, pa.binary())], ["_block", "kind", "bucket", "m", "raw"])


def _stored(part: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_batch(part)
    return sink.getvalue().to_pybytes()


def _block_rows(block: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block asks the buckets, and its texts with the number of those in training."""
    keys, n, cuts = _block_keys(parts)
    yield _rows(block, KEYS, _bucket(keys[cuts[:-1]]), np.diff(cuts), _key_cells(keys, n, cuts))
    del keys, n
    h, n, cuts = _block_words(parts)
    yield _rows(block, WORDS, _word_bucket(h[cuts[:-1]]), np.diff(cuts), _word_cells(h, n, cuts))
    for i, part in enumerate(parts):
        training = part.num_rows - (part.column("held_out").true_count)
        yield _rows(block, TEXTS, np.array([i]), np.array([training]), [_stored(part)])
    give_back()


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition's blocks; a block has one text at least."""
    block, parts, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for part in chunks(batch, "text", min(CHUNK_BYTES, block_bytes)):
            n = len(bytes_of(part.column("text"))[0])
            if parts and size + n > block_bytes:
                yield from _block_rows(block, parts)
                block, parts, size = block + 1, [], 0
            parts.append(part)
            size += n
    if parts:
        yield from _block_rows(block, parts)


class _Tree:
    """Contexts of ``BUCKET_DEPTH`` to ``DEPTH`` bytes of whole buckets: their counts by node, folded from the longest up."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.gamma = _LogGamma()
        #: by depth, longest first: sorted (context, byte) with counts, and the place of each longer one among them
        self.entries, self.counts, self.up = [keys], [n], []
        for depth in range(DEPTH - 1, BUCKET_DEPTH - 1, -1):
            longer = self.entries[-1]
            # a longer entry is its context and a byte; the context's oldest byte is the second lowest
            entry = (longer >> np.uint64(16)) << np.uint64(8) | (longer & np.uint64(255))
            shorter, at = np.unique(entry, return_inverse=True)
            self.entries.append(shorter)
            self.up.append(at)
            self.counts.append(np.bincount(at, weights=self.counts[-1], minlength=len(shorter)).astype(np.int64))

    def level(self, level: int, predict: bool):
        """One of the eight decisions: first entry of each node of the shortest contexts and ln of its weighted probability;
        with ``predict`` also the mixed probability of each key's bit by these contexts."""
        shift, bit_at = np.uint64(8 - level), np.uint64(7 - level)
        folded, before, nodes = None, None, []
        for k, (entry, n) in enumerate(zip(self.entries, self.counts, strict=True)):
            new = _changes(entry >> shift)
            first = np.flatnonzero(new)
            node = np.cumsum(new) - 1
            every = np.add.reduceat(n, first)
            ones = np.add.reduceat(np.where(entry & (np.uint64(1) << bit_at), n, 0), first)
            own, parent = self.gamma.estimate(every - ones, ones), None
            if k:
                parent = node[self.up[k - 1][before]]
                below = np.bincount(parent, weights=folded, minlength=len(first))
                weight, folded = _mixed(own, below)
            else:
                weight, folded = np.ones(len(first)), own
            if predict:
                nodes.append((node, parent, weight, every, ones))
            before = first
        if not predict:
            return first, folded, None
        # from the shortest contexts on, by node: what is settled for a zero and a one, and what is left to longer contexts
        zero = one = rest = None
        for k in reversed(range(len(nodes))):
            _, _, weight, every, ones = nodes[k]
            p0, p1 = (every - ones + 0.5) / (every + 1.0), (ones + 0.5) / (every + 1.0)
            if rest is None:
                zero, one, rest = weight * p0, weight * p1, 1 - weight
            else:
                parent = nodes[k + 1][1]
                left = rest[parent]
                share = left * weight
                zero, one, rest = zero[parent] + share * p0, one[parent] + share * p1, left * (1 - weight)
        at = nodes[0][0]
        return first, folded, np.where(self.entries[0] & (np.uint64(1) << bit_at), one[at], zero[at])


def _mixed(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of a context's own estimate, and ln of the mean of the estimate and what the longer contexts give."""
    apart = np.exp(-np.abs(below - own))
    weight = np.where(below > own, apart, 1.0) / (1 + apart)
    return weight, np.maximum(own, below) + np.log(1 + apart) - np.log(2.0)


def _two(entry: np.ndarray) -> np.ndarray:
    """The last two bytes of entries of depth ``BUCKET_DEPTH``, the older one first."""
    c = (entry >> np.uint64(8 * (BUCKET_DEPTH - 1))).astype(np.int64)
    return (c & 255) << 8 | c >> 8


def _merged(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of rows with their counts, and all rows' keys' places among them."""
    return _summed(*_cell_keys([row[4] for row in rows]))


def _merged_words(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of rows with their counts, and all rows' words' places among them."""
    each, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for row in rows:
        h, n = _cell_words(row[4])
        each.append(h)
        times.append(n)
    return _summed(np.concatenate(each), np.concatenate(times))


def _groups(batches):
    """Rows of whole buckets about keys and about words, together ``GROUP_KEYS`` of both or little more, from rows sorted by bucket."""
    held, size, last = {KEYS: [], WORDS: []}, 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("_block", "kind", "bucket", "m", "raw")), strict=True):
            if size >= GROUP_KEYS and row[2] != last:
                yield held[KEYS], held[WORDS]
                held, size = {KEYS: [], WORDS: []}, 0
                give_back()
            held[row[1]].append(row)
            size += row[3]
            last = row[2]
    if size:
        yield held[KEYS], held[WORDS]
    give_back()


#: In place of a key: the numbers of words met in training, all and distinct.
TOKENS, DISTINCT = -1, -2


def _upper_sums(batches):
    """(key, n, deeper) of contexts of two bytes: by byte its count, by node the folded weights of the longer contexts."""
    names = ["key", "n", "deeper"]
    for rows, word_rows in _groups(batches):
        _, c, _ = _merged_words(word_rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TOKENS, DISTINCT], pa.int32()), pa.array([int(c.sum()), int((c > 0).sum())], pa.int64()), pa.array([0.0, 0.0])], names)
        keys, n, _ = _merged(rows)
        tree = _Tree(keys[n > 0], n[n > 0])
        entry, counts = tree.entries[-1], tree.counts[-1]
        if not len(entry):
            continue
        two = _two(entry)
        contexts, at = np.unique(two, return_inverse=True)
        total, deeper = np.zeros((len(contexts), 256), np.int64), np.zeros((len(contexts), 256))
        np.add.at(total, (at, (entry & np.uint64(255)).astype(np.int64)), counts)
        for level in range(8):
            first, folded, _ = tree.level(level, False)
            node = ((entry[first] & np.uint64(255)) | np.uint64(256)) >> np.uint64(8 - level)
            np.add.at(deeper, (at[first], node.astype(np.int64)), folded)
        r, c = np.nonzero((total != 0) | (deeper != 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array((contexts[r] << 8 | c).astype(np.int32)), pa.array(total[r, c]), pa.array(deeper[r, c])], names)


def _by_row(values: np.ndarray, rows: list[tuple]) -> list[np.ndarray]:
    """The rows' shares of their values."""
    return np.split(values, np.cumsum([row[3] for row in rows])[:-1]) if rows else []


def _answer_rows(rows: list[tuple], raw: list[bytes]) -> pa.RecordBatch:
    """Rows like those given, with other content."""
    columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[:4] or [()] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())], ["_block", "kind", "bucket", "m", "raw"])


def _answers(batches, upper: Upper):
    """For the rows of each block and bucket the log10 probabilities of its keys or the counts of its words, in their order."""
    for rows, word_rows in _groups(batches):
        _, counts, at = _merged_words(word_rows)
        yield _answer_rows(word_rows, [_packed(*_small(own)) for own in _by_row(counts[at], word_rows)])
        if not rows:
            continue
        keys, n, at = _merged(rows)
        tree, value = _Tree(keys, n), np.ones(len(keys))
        c = (keys >> np.uint64(48)).astype(np.int64)
        row = upper.row[(c & 255) << 8 | c >> 8].astype(np.int64) << 8
        zero, one, rest = (table.reshape(-1) for table in (upper.zero, upper.one, upper.rest))
        # none of the eight factors is near the smallest number
        for level in range(8):
            node = row | (((keys & np.uint64(255)) | np.uint64(256)) >> np.uint64(8 - level)).astype(np.int64)
            settled = np.where(keys >> np.uint64(7 - level) & np.uint64(1), one[node], zero[node]).astype(np.float64)
            value *= settled + rest[node] * tree.level(level, True)[2]
        value = np.log10(value).astype("<f4")[at]
        yield _answer_rows(rows, [_packed(_planes(own)) for own in _by_row(value, rows)])


class _LogGamma:
    """ln of the products (1/2)(3/2)...(n - 1/2) and 1*2*...*n: summed up for small n, Stirling's series beyond."""

    EXACT = 4096

    def __init__(self):
        k = np.arange(self.EXACT, dtype=np.float64)
        self.half = np.concatenate([[0.0], np.cumsum(np.log(k + 0.5))])
        self.whole = np.concatenate([[0.0], np.cumsum(np.log(k + 1.0))])

    @staticmethod
    def _stirling(x: np.ndarray) -> np.ndarray:
        return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)

    def _of(self, n: np.ndarray, exact: np.ndarray, shift: float, base: float) -> np.ndarray:
        small = n <= self.EXACT
        if small.all():
            return exact[n]
        out = exact[np.where(small, n, 0).astype(np.int64)]
        out[~small] = self._stirling(n[~small] + shift) - base
        return out

    def estimate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """ln of the Krichevsky-Trofimov probability of a sequence of a zeros and b ones."""
        ln_root_pi = 0.5 * np.log(np.pi)
        return self._of(a, self.half, 0.5, ln_root_pi) + self._of(b, self.half, 0.5, ln_root_pi) - self._of(a + b, self.whole, 1.0, 0.0)


class Model:
    """Rows of log10 probabilities of the 256 byte values, and the row of every two-byte context."""

    def __init__(self, table: np.ndarray, row: np.ndarray):
        self.table, self.row = table, row

    def score(self, keys: np.ndarray) -> np.ndarray:
        return self.table[self.row[keys >> 8], keys & 255]


class Upper:
    """Contexts of two bytes and less: by node the probabilities of a zero and a one that they settle, and what they leave to longer ones.

    The three sum to one, but none is the difference of the others: in single precision what is rare would be lost next to 1.
    """

    def __init__(self, zero: np.ndarray, one: np.ndarray, rest: np.ndarray, row: np.ndarray):
        self.zero, self.one, self.rest, self.row = zero, one, rest, row


def _levels(counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Zeros and ones at the nodes of each of the eight decisions, first decision first."""
    out = []
    for _ in range(8):
        pairs = counts.reshape(len(counts), counts.shape[1] // 2, 2)
        out.append((pairs[..., 0], pairs[..., 1]))
        counts = pairs.sum(axis=2)
    return out[::-1]


def upper_tree(keys: np.ndarray, n: np.ndarray, deeper: np.ndarray | None = None) -> Upper:
    """The upper tree of trigram counts.

    ``deeper`` has for a key's context and, in place of its byte, a node the folded ln weights of the contexts that lengthen
    it; without, contexts of two bytes are the longest.
    """
    contexts, at = np.unique(keys >> 8, return_inverse=True)
    two = np.zeros((len(contexts), 256), dtype=np.int64)
    np.add.at(two, (at, keys & 255), n)
    longer = np.zeros((len(contexts), 256))
    if deeper is not None:
        np.add.at(longer, (at, keys & 255), deeper)
    lasts, parent = np.unique(contexts & 255, return_inverse=True)
    one = np.zeros((len(lasts), 256), dtype=np.int64)
    np.add.at(one, parent, two)
    root = one.sum(axis=0, keepdims=True)
    # rows: contexts of two bytes, then of one (their second byte unmet), then none met
    row = np.full(1 << 16, len(contexts) + len(lasts), dtype=np.int32)
    for i, c in enumerate(lasts.tolist()):
        row[c :: 256] = len(contexts) + i
    row[contexts] = np.arange(len(contexts))
    zero, ones, rest = (np.zeros((len(contexts) + len(lasts) + 1, 256), np.float32) for _ in range(3))
    gamma, ln2 = _LogGamma(), np.log(2.0)
    for level, ((a2, b2), (a1, b1), (a0, b0)) in enumerate(zip(_levels(two), _levels(one), _levels(root), strict=True)):
        e2, e1, e0 = gamma.estimate(a2, b2), gamma.estimate(a1, b1), gamma.estimate(a0, b0)
        nodes = slice(1 << level, 2 << level)
        if deeper is None:
            w2 = np.ones_like(e2)
        else:
            w2 = 1 / (1 + np.exp(np.clip(longer[:, nodes] - e2, -700, 700)))
            e2 = np.logaddexp(e2, longer[:, nodes]) - ln2
        below = np.zeros_like(e1)
        np.add.at(below, parent, e2)
        w1 = 1 / (1 + np.exp(np.clip(below - e1, -700, 700)))
        mixed = np.logaddexp(e1, below) - ln2
        below = mixed.sum(axis=0, keepdims=True)
        w0 = 1 / (1 + np.exp(np.clip(below - e0, -700, 700)))
        for settled, of_bit in ((zero, 0), (ones, 1)):
            p2, p1, p0 = ((n[of_bit] + 0.5) / (n[0] + n[1] + 1.0) for n in ((a2, b2), (a1, b1), (a0, b0)))
            of_two = w0 * p0 + (1 - w0) * (w1[parent] * p1[parent] + (1 - w1[parent]) * w2 * p2)
            of_one = w0 * p0 + (1 - w0) * w1 * p1
            settled[:, nodes] = np.concatenate([of_two, of_one, w0 * p0])
        rest[:, nodes] = np.concatenate([(1 - w0) * (1 - w1[parent]) * (1 - w2), (1 - w0) * (1 - w1), 1 - w0])
    return Upper(zero, ones, rest, row)


def train(keys: np.ndarray, n: np.ndarray) -> Model:
    """The weighted model of trigram counts, with two bytes as the longest context."""
    upper = upper_tree(keys, n)
    table = np.zeros(upper.one.shape)
    for level in range(8):
        nodes = slice(1 << level, 2 << level)
        by_bit = np.log10(np.stack([p[:, nodes].astype(np.float64) + 0.5 * upper.rest[:, nodes] for p in (upper.zero, upper.one)], axis=2))
        table.reshape(len(table), 1 << level, 2, 1 << (7 - level))[:] += by_bit[..., None]
    return Model(table.astype(np.float32), upper.row)


#: An odd number: keys multiplied by it, or by its powers, are spread evenly, and still differ.
_SPREAD = 0x9E3779B97F4A7C15
#: Rows whose keys are sorted together, at most; a key's lowest bits give way to the row's number.
SORTED_ROWS = 1 << 14
#: Keys that are sorted together; a part's are never apart.
SORTED_KEYS = 1 << 22
#: Cells that are decoded at once where only their keys are wanted.
CELLS = 256
#: Sorted keys that are looked up at once.
SLICE_KEYS = 1 << 20


def _spread(keys: np.ndarray, value: np.ndarray, bits: np.uint64) -> tuple[np.uint64, np.ndarray, np.ndarray]:
    """A number that spreads distinct keys so that they differ without their lowest bits; so cut they are sorted, with their values."""
    by = 1
    while True:
        by = by * _SPREAD % (1 << 64)
        cut = keys * np.uint64(by)
        order = np.argsort(cut)
        cut = cut[order]
        cut >>= bits
        if _changes(cut).all():
            return np.uint64(by), cut, value[order]


class _Found:
    """Places of values among sorted ones that are spread evenly."""

    def __init__(self, values: np.ndarray):
        self.values = values
        bits = max(1, len(values).bit_length() - 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.zeros((1 << bits) + 1, np.int32 if len(values) < 1 << 31 else np.int64)
        np.cumsum(np.bincount((values >> self.shift).astype(np.int64), minlength=1 << bits), out=self.start[1:])

    def __call__(self, values: np.ndarray) -> np.ndarray:
        at = self.start[values >> self.shift]
        missed = np.flatnonzero(self.values[at] != values)
        while len(missed):
            at[missed] += 1
            missed = missed[self.values[at[missed]] != values[missed]]
        return at


def _row_sums(parts: list[pa.RecordBatch], by: np.uint64, bits: np.uint64, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
    """By row the sum of its keys' values; ``by``, ``cut`` and ``value`` are those of ``_spread``."""
    every = np.empty(sum(len(bytes_of(p.column("text"))[0]) + p.num_rows for p in parts), np.uint64)
    at, rows = 0, 0
    for part in parts:
        keys, begin = context_keys(part.column("text"))
        keys *= by
        keys >>= bits
        keys <<= bits
        keys |= np.repeat(np.arange(rows, rows + part.num_rows, dtype=np.uint64), np.diff(begin))
        every[at : at + len(keys)] = keys
        at, rows = at + len(keys), rows + part.num_rows
    every.sort()
    out, low = np.zeros(rows), (np.uint64(1) << bits) - np.uint64(1)
    for at in range(0, len(every), SLICE_KEYS):
        own = every[at : at + SLICE_KEYS]
        keys = own >> bits
        first = np.flatnonzero(_changes(keys))
        met, times = keys[first], np.diff(np.append(first, len(keys)))
        begin, end = np.searchsorted(cut, met[0]), np.searchsorted(cut, met[-1]) + 1
        found = value[begin:end].astype(np.float64)
        if len(met) < len(found):
            found = found[np.searchsorted(cut[begin:end], met)]
        out += np.bincount((own & low).astype(np.int64), weights=np.repeat(found, times), minlength=rows)
    return out


def _model_scores(parts: list[pa.RecordBatch], keys: np.ndarray, value: np.ndarray) -> Iterator[np.ndarray]:
    """Of each part the sums of its texts' log10 probabilities, from those of the block's distinct keys."""
    runs, rows, size = [], [], 0
    for part in parts:
        own = len(bytes_of(part.column("text"))[0]) + part.num_rows
        if not runs or rows[-1] + part.num_rows > SORTED_ROWS or size + own > SORTED_KEYS:
            runs.append([])
            rows.append(0)
            size = 0
        runs[-1].append(part)
        rows[-1] += part.num_rows
        size += own
    bits = np.uint64((max(rows, default=1) - 1).bit_length())
    by, cut, value = _spread(keys, value, bits)
    del keys
    for run in runs:
        sums = _row_sums(run, by, bits, cut, value)
        yield from np.split(sums, np.cumsum([p.num_rows for p in run])[:-1])


def _block_scores(parts: list[pa.RecordBatch], scores: list[np.ndarray], h: np.ndarray, n: np.ndarray, totals: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """Base and model scores of a block's texts, from its words and their numbers; the totals are of words met in training, all and
    distinct, and of texts in training."""
    tokens, distinct, end = totals
    train_tokens = tokens + end
    below = float(train_tokens + distinct + (end > 0) + 1)
    place = _Found(h)
    for part, score in zip(parts, scores, strict=True):
        w = words(part.column("text"), lower=True)
        c = n[place(w.hash)] if len(w.hash) else np.zeros(0, np.int64)
        met = np.concatenate([[0], np.cumsum(c > 0)])
        first = w.first
        log = np.log10((c + 1.0) / below)
        base = np.array([log[a:b].sum() for a, b in zip(first[:-1], first[1:], strict=True)])
        known = met[first[1:]] - met[first[:-1]] + (end > 0)
        size = np.diff(bytes_of(part.column("text"))[1]) + 1
        columns = {
            "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": np.diff(first) + 1, "n_known": known,
            "train_tokens": np.full(part.num_rows, train_tokens), "base_score": base + np.log10((end + 1.0) / below), "score": score, "n_bytes": size,
        }
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _scored(asked: pa.Table, answers: pa.Table, totals: tuple[int, int, int]) -> pa.Table:
    """Scores of a block's texts, from what the block asked and the answers to it."""
    give_back()

    def cells(rows: pa.Table, kind: int) -> list[bytes]:
        return rows.filter(pc.field("kind") == kind).sort_by("bucket").column("raw").to_pylist()

    parts = [pa.ipc.open_stream(raw).read_next_batch() for raw in cells(asked, TEXTS)]
    told = cells(asked, KEYS)
    keys = np.concatenate([np.zeros(0, np.uint64), *(_cell_keys(told[i : i + CELLS])[0] for i in range(0, len(told), CELLS))])
    del told
    value = np.concatenate([np.zeros(0, np.float32), *(_joined(*_unpacked(raw), "<f4") for raw in cells(answers, KEYS))])
    scores = list(_model_scores(parts, keys, value))
    del keys, value
    h = np.concatenate([np.zeros(0, np.uint64), *(_cell_words(raw)[0] for raw in cells(asked, WORDS))])
    n = np.concatenate([np.zeros(0, np.int64), *(_whole(*_unpacked(raw)) for raw in cells(answers, WORDS))])
    out = pa.Table.from_batches(list(_block_scores(parts, scores, h, n, totals)))
    give_back()
    return out


_SCHEMA = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
    "score double, n_bytes bigint"
)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes.

    Texts whose crc32 of the id, as text, leaves 2 modulo 7 are held out; the model and the word counts are of all others.
    ``score`` is the model's log10 probability of the text's bytes (A-Z folded) and its end, ``n_bytes`` their number; so
    ``-score / n_bytes / log10(2)`` is the code length in bits a byte. ``base_score`` is the add-one unigram score over
    words and an end token. A null text is empty: its end alone is scored. A null id is trained on; repeated rows count and
    are scored as often as they occur; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows = rows.withColumn("held_out", held_out)
    block_bytes = BLOCKS * blocks.BLOCK_BYTES

    # a block's rows are written by one task and stay together, so that its texts need not travel
    asked = bucketed(rows.mapInArrow(lambda batches: _blocks(batches, block_bytes), _ROWS), "_block", dealt=True)
    by_bucket = asked.filter(F.col("kind") != TEXTS).repartition("bucket").sortWithinPartitions("bucket")
    # 2**24 rows and two at most, whatever the input: contexts of two bytes
    with shuffles_forgotten(spark):
        sums = by_bucket.mapInArrow(_upper_sums, "key int, n bigint, deeper double").groupBy("key").agg(F.sum("n").alias("n"), F.sum("deeper").alias("deeper")).toArrow()
    key, n, deeper = (sums.column(c).to_numpy() for c in ("key", "n", "deeper"))
    upper = spark.sparkContext.broadcast(upper_tree(key[key >= 0], n[key >= 0], deeper[key >= 0]))
    texts = asked.filter(F.col("kind") == TEXTS)
    ends = texts.agg(F.sum("m")).head()[0] or 0
    totals = (int(n[key == TOKENS].sum()), int(n[key == DISTINCT].sum()), ends)

    answers = by_bucket.mapInArrow(lambda batches: _answers(batches, upper.value), _ROWS)
    return asked.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(lambda own, told: _scored(own, told, totals), _SCHEMA)
