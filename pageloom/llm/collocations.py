"""Phrase collocation mining: n-grams of two and three words counted in counting quotient filters (see ``quotient``).

1. Texts are lower-cased (A-Z), cut into pieces and words, and gathered by language into blocks of some megabytes. A block is
   a row for each of its distinct words with its count, and its text as numbers of these words in rows of ``CODES_ROW`` words; no row
   or batch is as large as a block, so that reading, writing and sorting them takes little memory. The rows are written once.
2. Words met ``least`` times in their language get ids, the rest cannot be part of a phrase met that often.
3. Each block's words ask for their ids; a block's n-grams become one sorted filter, cut by leading bits of the scrambled
   keys. Parts of equal bits are merged, cut by the next bits, and merged again, until a part covers all blocks of a language
   and about ``SHARD_WORDS`` words. Every merge handles about as many entries as a block has, whatever the size of the corpus.
4. Phrases met ``least`` times leave the filters as rows; scores, the rule on longer phrases and the ranks are joins and
   limits.

A row without a language counts as ``und``; a row without text, or whose text has no words, adds nothing; repeated rows count as
often as they stand. A language without a frequent phrase has no rows in the result. A text longer than a block is a block alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.llm.common import bounded_batches, give_back, materialize
from pageloom.llm.quotient import Filter, merge
from pageloom.operators.skew import per_key_limit, spread_rank

#: Bytes of text in a block, and of all languages' unfinished blocks together.
BLOCK_BYTES, HELD_BYTES = 4 << 20, 16 << 20
#: Words of a block's text in a row, and distinct words in a record batch.
CODES_ROW, WORDS_BATCH = 1 << 16, 1 << 14
#: Words whose n-grams one merged part of a filter covers, on average.
SHARD_WORDS = 1 << 19
#: Bits of the key by which parts are cut at a time.
FAN_BITS = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_INSIDE = ~_BREAK
_INSIDE[[32, 9]] = False

#: A word of a block (its number ``at``, met ``n`` times), or, without a word, a stretch of its text (the ``at``-th, of ``n`` words).
_BLOCKS = "block string, lang string, at bigint, word string, n bigint, codes binary"
_PARTS = "lang string, prefix bigint, lead int, shard_bits int, g bigint, part binary"
_PART_SCHEMA = pa.schema({"lang": pa.string(), "prefix": pa.int64(), "lead": pa.int32(), "shard_bits": pa.int32(), "g": pa.int64(), "part": pa.binary()})


def coded(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the texts as numbers of words, and whether a word is the first of its piece."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    bounds = np.zeros(len(raw) + 2, dtype=bool)
    bounds[1:-1] = inside = _INSIDE[raw]
    start, end = np.flatnonzero(inside & ~bounds[:-2]), np.flatnonzero(inside & ~bounds[2:]) + 1
    pieces = np.cumsum(_BREAK[raw], dtype=np.int64)[start]
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=offsets[1:])
    data = np.ascontiguousarray(_LOWER[raw[inside]])
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(pieces, prepend=-1) != 0


def _rows(block: str, lang: str, at: int, word: pa.Array, n: np.ndarray, codes: pa.Array) -> pa.RecordBatch:
    arrays = [pa.repeat(pa.scalar(block), len(n)), pa.repeat(pa.scalar(lang), len(n)), pa.array(np.arange(at, at + len(n))), word, pa.array(n, pa.int64()), codes]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "lang", "at", "word", "n", "codes"])


def _block(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    words, codes, first = coded(texts)
    if not len(codes):
        return
    block, counts = uuid.uuid4().hex, np.bincount(codes)
    for at in range(0, len(words), WORDS_BATCH):
        some = words.slice(at, WORDS_BATCH).cast(pa.string())
        yield _rows(block, lang, at, some, counts[at : at + WORDS_BATCH], pa.nulls(len(some), pa.binary()))
    marked = (codes << 1 | first).astype("<u4")
    for i, at in enumerate(range(0, len(marked), CODES_ROW)):
        some = marked[at : at + CODES_ROW]
        yield _rows(block, lang, i, pa.nulls(1, pa.string()), np.array([len(some)]), pa.array([some.tobytes()], pa.binary()))


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int, held_bytes: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def done(lang: str) -> Iterator[pa.RecordBatch]:
        size.pop(lang)
        yield from _block(lang, held.pop(lang))

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            for lang, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 1
                if size[lang] >= block_bytes:
                    yield from done(lang)
            if sum(size.values()) >= held_bytes:
                yield from done(max(size, key=size.__getitem__))
    for lang in list(held):
        yield from done(lang)
    give_back()


def ngrams(ids: np.ndarray, first: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of two and three words with ids (not 0), inside pieces, and how often each is met."""
    pair = (ids[:-1] > 0) & (ids[1:] > 0) & ~first[1:]
    at = np.flatnonzero(pair)
    codes = ids[at] * (many + 1) + ids[at + 1]
    two, number, n2 = np.unique(codes, return_inverse=True, return_counts=True)
    # A pair that the next one continues; its number stands in for its two words.
    goes_on = np.flatnonzero(pair[:-1] & pair[1:])
    numbers = np.zeros(len(ids), dtype=np.int64)
    numbers[at] = number
    three, n3 = np.unique(numbers[goes_on] * (many + 1) + ids[goes_on + 2], return_counts=True)
    start = two[three // (many + 1)]
    rows2 = np.stack([two // (many + 1), two % (many + 1), np.zeros_like(two)], axis=1)
    rows3 = np.stack([start // (many + 1), start % (many + 1), three % (many + 1)], axis=1)
    return np.concatenate([rows2, rows3]), np.concatenate([n2, n3])


def _cut(found: Filter, lead: int, shard_bits: int, lang: str, g: int, fan: int) -> list[tuple]:
    more = min(fan, shard_bits - lead)
    return [(lang, prefix, lead + more, shard_bits, g, part.pack(lead + more)) for prefix, part in found.cut(lead, more)]


def _part_rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_PART_SCHEMA.names, r, strict=True)) for r in rows], schema=_PART_SCHEMA)


def _first_parts(block: pa.Table, known: pa.Table, fan: int) -> pa.Table:
    if not (block.num_rows and known.num_rows):
        return _part_rows([])
    give_back()
    lang, info = block.column("lang")[0].as_py(), known.slice(0, 1).to_pylist()[0]
    stretches = block.sort_by("at").column("codes").to_pylist()
    raw = np.frombuffer(b"".join(stretches), "<u4").astype(np.int64)
    codes, first = raw >> 1, (raw & 1).astype(bool)
    ids = np.zeros(int(codes.max()) + 1, dtype=np.int64)
    ids[known.column("pos").to_numpy()] = known.column("id").to_numpy()
    grams, n = ngrams(ids[codes], first, info["many"])
    found = Filter.of(grams, n, int(info["many"]).bit_length())
    return _part_rows(_cut(found, 0, info["shard_bits"], lang, info["g"], fan))


def _merged(parts: pa.Table) -> Filter:
    return merge([Filter.unpack(raw, prefix) for raw, prefix in zip(parts.column("part").to_pylist(), parts.column("prefix").to_pylist(), strict=True)])


def _next_parts(parts: pa.Table, fan: int) -> pa.Table:
    lang, lead, shard_bits, g = (parts.column(c)[0].as_py() for c in ("lang", "lead", "shard_bits", "g"))
    return _part_rows(_cut(_merged(parts), lead, shard_bits, lang, g, fan))


def _frequent(parts: pa.Table, least: int) -> pa.Table:
    found = _merged(parts)
    keep = found.count >= least
    kept = Filter(found.bits, found.left[keep], found.right[keep], found.count[keep])
    w = kept.ids()
    lang = pa.array([parts.column("lang")[0].as_py()] * len(w), pa.string())
    give_back()
    return pa.table({"lang": lang, "w1": w[:, 0], "w2": w[:, 1], "w3": w[:, 2], "a": kept.count})


def exact_score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) on whole numbers of up to 38 digits (a below 10**16)."""
    big = lambda c: c.cast("decimal(38,0)")
    top = (F.lit(1000000).cast("decimal(38,0)") * big(a)).cast("decimal(38,0)") * big(a)
    return F.call_function("div", top.cast("decimal(38,0)"), (big(l) * big(r)).cast("decimal(38,0)"))


def _scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Each phrase with its lowest-scoring cut: (lang, w1, w2, w3, a, l, r, score)."""
    def count_of(df: DataFrame, word: str, out: str) -> DataFrame:
        return df.join(words.select("lang", F.col("id").alias(word), F.col("f").alias(out)), ["lang", word])

    two = phrases.filter("w3 = 0")
    three = phrases.filter("w3 > 0")
    pair = lambda x, y, out: two.select("lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(out))
    a = F.col("a")
    of_two = count_of(count_of(two, "w1", "l"), "w2", "r").select("lang", "w1", "w2", "w3", "a", "l", "r", exact_score(a, F.col("l"), F.col("r")).alias("score"))
    of_three = count_of(count_of(three, "w1", "l1"), "w3", "r2").join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"]).join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"])
    cut = F.least(*[F.struct(exact_score(a, F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)])
    of_three = of_three.withColumn("cut", cut).select("lang", "w1", "w2", "w3", "a", "cut.l", "cut.r", "cut.score")
    return of_two.unionByName(of_three)


def _not_inside(phrases: DataFrame, share: int) -> DataFrame:
    """Phrases without those that stand in a longer one met ``share`` percent as often or more."""
    three = phrases.filter("w3 > 0")
    inner = F.explode(F.array(F.struct(F.col("w1").alias("x"), F.col("w2").alias("y")), F.struct(F.col("w2").alias("x"), F.col("w3").alias("y"))))
    longest = three.select("lang", "a", inner.alias("p")).groupBy("lang", F.col("p.x").alias("w1"), F.col("p.y").alias("w2")).agg(F.max("a").alias("longer"))
    two = phrases.filter("w3 = 0").join(longest, ["lang", "w1", "w2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    return two.select("lang", "w1", "w2", "w3").unionByName(three.select("lang", "w1", "w2", "w3"))


def collocations(
    docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang",
    shard_words: int = SHARD_WORDS, fan_bits: int = FAN_BITS, block_bytes: int = BLOCK_BYTES, held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """The ``top`` phrases of two and three words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is how often the phrase stands, ``l`` and ``r`` the parts of its lowest-scoring cut, ``n`` the language's words.
    Ranks go by score, then ``a``, descending, then the phrase's bytes. ``least`` is 1 at least.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text")).filter("text <> ''")
    blocks = materialize(rows.mapInArrow(lambda batches: _blocks(batches, block_bytes, held_bytes), _BLOCKS))

    told, texts = blocks.filter("word is not null"), blocks.filter("word is null")
    often = materialize(told.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least))
    words = materialize(spread_rank(often, ["lang"], [], "word", "id"))
    shard_bits = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / shard_words)))
    # Keys of three ids have no more than half of their bits to cut by.
    room = F.ceil(F.lit(1.5) * F.ceil(F.log2(F.col("many") + 1))).cast("int")
    langs = materialize(
        texts.groupBy("lang").agg(F.sum("n").alias("n")).join(words.groupBy("lang").agg(F.max("id").alias("many")), "lang")
        .withColumn("shard_bits", F.least(shard_bits.cast("int"), room))
    )
    levels = max(1, -(-(langs.agg(F.max("shard_bits")).head()[0] or 0) // fan_bits))

    def together(level: Column | int) -> Column:
        """Blocks of one number are merged after a level's cut; after a language's last level all are."""
        left = F.greatest(F.ceil(F.col("shard_bits") / fan_bits) - level, F.lit(0))
        return F.pmod(F.col("g"), F.pow(F.lit(2.0), left * fan_bits).cast("bigint"))

    asked = told.select("block", "lang", F.col("at").alias("pos"), "word")
    ids = asked.join(words.join(langs.select("lang", "many", "shard_bits"), "lang"), ["lang", "word"]).select(
        F.col("block").alias("of_block"), "pos", "id", "many", "shard_bits", F.pmod(F.xxhash64("block"), F.lit(1 << 48)).alias("g"))
    parts = texts.select("block", "lang", "at", "codes").groupBy("block").cogroup(ids.groupBy("of_block")).applyInArrow(lambda b, k: _first_parts(b, k, fan_bits), _PARTS)
    for level in range(1, levels):
        parts = parts.withColumn("g", together(level)).groupBy("lang", "prefix", "g").applyInArrow(lambda t: _next_parts(t, fan_bits), _PARTS)
    found = parts.groupBy("lang", "prefix").applyInArrow(lambda t: _frequent(t, least), "lang string, w1 bigint, w2 bigint, w3 bigint, a bigint")
    return _ranked(materialize(found), words, langs, share, top)


def _ranked(phrases: DataFrame, words: DataFrame, langs: DataFrame, share: int, top: int) -> DataFrame:
    kept = materialize(_scored(phrases, words).join(_not_inside(phrases, share), ["lang", "w1", "w2", "w3"], "left_semi"))
    order = [F.desc("score"), F.desc("a")]
    # The last score and count that can be among the first; words are looked up for phrases that reach it.
    last = per_key_limit(kept.select("lang", "score", "a", "w1", "w2", "w3"), "lang", order, top, spread="w1")
    last = last.groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))
    near = kept.join(last, "lang").filter(F.struct("score", "a") >= F.col("last")).drop("last")
    for i in (1, 2, 3):
        near = near.join(words.select("lang", F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}")), ["lang", f"w{i}"], "inner" if i < 3 else "left")
    near = near.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    order.append(F.asc("phrase"))
    best = per_key_limit(near, "lang", order, top, spread="phrase")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")
    return best.withColumn("rank", rank).join(langs.select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
