"""Analysis and vectors for articles: stored model replies, pluggable callables, defaults."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom import schemas
from pageloom.functions import fixed_values as V
from pageloom.functions.bind import bound
from pageloom.functions.jsonx import clean_json, flatten_summary, is_filled_object
from pageloom.functions.text import excerpt, strip, truncate

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]
Analyzer = Callable[[str], dict | None]


def provider_waterfall(replies: DataFrame) -> DataFrame:
    """First provider, by priority, whose reply holds a filled JSON object; null columns when none does.

    ``replies``: (article_id, provider, priority, raw). The best reply is a minimum, computed
    partially before the shuffle.
    """
    parsed = replies.withColumn("_v", clean_json(F.col("raw")))
    valid = F.when(
        is_filled_object(F.col("_v")), F.struct("priority", "provider", F.to_json("_v").alias("reply"))
    )
    best = parsed.groupBy("article_id").agg(F.min(valid).alias("best"))
    return best.select("article_id", "best.provider", "best.reply")


def chat_waterfall(replies: DataFrame) -> DataFrame:
    """First non-empty text by priority, stripped."""
    given = F.when(F.col("raw") != "", F.struct("priority", "provider", strip(F.col("raw")).alias("reply")))
    best = replies.groupBy("article_id").agg(F.min(given).alias("best"))
    return best.select("article_id", "best.provider", "best.reply")


def reply_analysis(best: DataFrame) -> DataFrame:
    """Analysis columns (id, summary, tags, category, urgency) of the replies that were found."""
    v = F.col("_v")
    return (
        best.filter(F.col("reply").isNotNull())
        .select("article_id", F.try_parse_json("reply").alias("_v"))
        .select(
            F.col("article_id").alias("id"),
            flatten_summary(F.try_variant_get(v, "$.summary", "variant"), F.lit(None).cast("string")).alias("summary"),
            F.try_variant_get(v, "$.tags", "array<string>").alias("tags"),
            F.try_variant_get(v, "$.category", "string").alias("category"),
            F.try_variant_get(v, "$.urgency", "int").alias("urgency"),
        )
    )


#: Words of the default vectors: runs of letters, digits and underscores.
_NOT_WORD = r"[^\p{L}\p{N}_]+"


def hashed_grams(text: Column) -> Column:
    """32-bit hashes of the words of a lower-cased text and of its pairs of neighbouring words, as an array."""
    words = F.filter(F.split(F.lower(text), _NOT_WORD), lambda w: w != "")

    def grams(ws: Column) -> Column:
        pairs = F.zip_with(ws, F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(ws, F.filter(pairs, lambda p: p.isNotNull()))

    return F.transform(bound(words, grams), lambda g: F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("bigint"))


def hashed_embedding(text: Column, dim: int = V.EMBEDDING_DIM) -> Column:
    """Default model: each word and word pair adds 1 or -1 (bit 16 of its hash) to the slot its hash names, scaled to unit length.

    Words are cut and hashed by Spark; a batch's hashes are summed into its vectors in one step. Null for a text without more
    than white space; a text without words has a vector of zeros.
    """

    @F.arrow_udf("array<float>")
    def dense(grams: pa.Array) -> pa.Array:
        n = grams.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        codes = grams.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n)), n)
        out = np.bincount(row * dim + codes % dim, weights=np.where((codes >> 16) & 1, 1.0, -1.0), minlength=len(n) * dim).reshape(len(n), dim)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        flat = pa.array((out / np.where(norm == 0, 1.0, norm)).astype(np.float32).reshape(-1))
        offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * dim, mask=None)
        made = pa.ListArray.from_arrays(offsets, flat)
        return pa.ListArray.from_arrays(offsets, flat, mask=grams.is_null()) if grams.null_count else made

    return dense(F.when(strip(text) != "", hashed_grams(text)))


def embedding(
    text: Column, model: Embedder | None = None, dim: int = V.EMBEDDING_DIM, max_chars: int | None = None
) -> Column:
    """Vector of a text; null for empty text and where the model fails.

    ``max_chars`` is for models that read so many characters at most (``EMBEDDING_CHARS`` for the one this
    replaces); without it the whole text counts. A batch that a model fails on is asked for again in halves.
    """
    text = text if max_chars is None else truncate(text, max_chars)
    if model is None:
        return hashed_embedding(text, dim)

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        some = texts[texts.notna() & (texts.str.strip() != "")]
        for at, v in zip(some.index, _vectors(model, some.tolist()), strict=True):
            out[at] = v
        return out

    return embed(text)


def _vectors(model: Embedder, texts: list[str]) -> list:
    """The model's vectors; the texts it fails on have none, found by halving."""
    if not texts:
        return []
    try:
        return list(model(texts))
    except Exception:
        if len(texts) == 1:
            return [None]
    half = len(texts) // 2
    return _vectors(model, texts[:half]) + _vectors(model, texts[half:])


def embed_documents(
    df: DataFrame, text: str = "clean_text", model: Embedder | None = None, dim: int = V.EMBEDDING_DIM,
    max_chars: int | None = None,
) -> DataFrame:
    return df.withColumn("embedding", embedding(F.col(text), model, dim, max_chars))


# Categories of the default analyser with the words that speak for them.
CATEGORY_WORDS = {
    "Technology": ("software", "computer", "internet", "technology"),
    "Politics": ("government", "election", "parliament", "minister"),
    "Science": ("research", "science", "study", "university"),
}
TAG_CHARS, TAGS = 4, 3
_NOT_LETTERS = r"[^\p{L}]+"
_ALARM = r"[!?]|[0-9]+"


def _run_starts(words: Column) -> Column:
    """Places, from 1, at which a new word begins in a sorted array."""
    places = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: ~F.get(words, i - 1).eqNullSafe(F.get(words, i - 2)))


def _most_frequent(words: Column, starts: Column) -> Column:
    counted = F.transform(
        starts,
        lambda at, i: F.struct(
            (at - F.coalesce(F.get(starts, i + 1), F.size(words) + 1)).alias("minus_count"), F.get(words, at - 1).alias("word")
        ),
    )
    return F.transform(F.slice(F.sort_array(counted), 1, TAGS), lambda x: x["word"])


def default_analysis(text: Column) -> Column:
    """Rule-based analysis of a whole text, in built-in functions.

    Tags are the most frequent words of four letters or more; the category is the first whose word
    occurs, else General; urgency grows with exclamation, question marks and numbers.
    """
    words = F.sort_array(F.filter(F.split(F.lower(text), _NOT_LETTERS), lambda w: F.length(w) >= TAG_CHARS))
    tags = bound(words, lambda ws: bound(_run_starts(ws), lambda starts: _most_frequent(ws, starts)))
    low = F.lower(text)
    category = F.lit(None).cast("string")
    for name, keys in CATEGORY_WORDS.items():
        for key in keys:
            category = F.coalesce(category, F.when(low.contains(key), name))
    urgency = F.least(F.lit(10), F.size(F.regexp_extract_all(text, F.lit(_ALARM), 0)) + 1)
    return F.when(
        F.coalesce(text, F.lit("")) != "",
        F.struct(
            excerpt(text).alias("summary"), tags.alias("tags"),
            F.coalesce(category, F.lit("General")).alias("category"), urgency.alias("urgency"),
        ),
    )


#: An analysis with what went wrong: an error of a callable, or null.
TOLD = T.StructType([*schemas.ANALYSIS.fields, T.StructField("error", T.StringType())])


def analysis(text: Column, analyzers: Sequence[Analyzer] | None = None, max_chars: int | None = None) -> Column:
    """``struct(summary, tags, category, urgency)``: the default rules, or the first callable that answers.

    ``max_chars`` is for callables with a limit of their own (``ANALYSIS_CHARS`` for the model this replaces). A
    summary given as a list or object is joined by blanks; a field of the wrong kind is left out, so an odd
    answer costs its row at most a column.
    """
    if not analyzers:
        return default_analysis(text)
    return answer_of(told_analysis(text, analyzers, max_chars))


def told_analysis(text: Column, analyzers: Sequence[Analyzer] | None = None, max_chars: int | None = None) -> Column:
    """The analysis with a field ``error``: the last error of a callable where none has answered, else null.

    Texts that are null or empty aren't asked for; all their fields are null.
    """
    names = schemas.ANALYSIS.fieldNames()
    if not analyzers:
        # The rules always answer.
        found = default_analysis(text)
        return F.struct(*[found[n].alias(n) for n in names], F.lit(None).cast("string").alias("error"))

    @F.pandas_udf(TOLD)
    def analyse(texts: pd.Series) -> pd.DataFrame:
        rows = [_first_answer(analyzers, t) if isinstance(t, str) and t else (None, None) for t in texts]
        return pd.DataFrame(
            [[*(_field(n, (r or {}).get(n)) for n in names), error] for r, error in rows], columns=TOLD.fieldNames(), dtype=object)

    return analyse(text if max_chars is None else truncate(text, max_chars))


def answer_of(told: Column) -> Column:
    """The analysis in a ``told_analysis``; null where nothing was told."""
    names = schemas.ANALYSIS.fieldNames()
    some = F.coalesce(*[told[n].cast("string") for n in names]).isNotNull()
    return F.when(some, F.struct(*[told[n].alias(n) for n in names]))


def _first_answer(analyzers: Sequence[Analyzer], text: str) -> tuple[dict | None, str | None]:
    """The first answer, or the last error."""
    error = None
    for analyze in analyzers:
        try:
            answer = analyze(text)
        except Exception as e:
            error = str(e) or type(e).__name__
            continue
        if isinstance(answer, dict) and answer:
            return answer, None
    return None, error


def _field(name: str, value):
    """One field of an answer in its column's type, or None."""
    if value is None:
        return None
    if name == "tags":
        return [str(v) for v in value if v is not None] if isinstance(value, (list, tuple, set)) else None
    if name == "urgency":
        try:
            return int(float(value))
        except (TypeError, ValueError, OverflowError):
            return None
    if isinstance(value, dict):
        value = [value[k] for k in sorted(value)]
    return " ".join(str(v) for v in value if v is not None) if isinstance(value, (list, tuple)) else str(value)


def analyze_documents(
    df: DataFrame, text: str = "clean_text", analyzers: Sequence[Analyzer] | None = None, max_chars: int | None = None
) -> DataFrame:
    return df.withColumn("analysis", analysis(F.col(text), analyzers, max_chars))
