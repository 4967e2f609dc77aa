"""Language identification by Bayesian evidence fusion.

Evidence for each language, as log likelihoods that add up:

- text: hashed letter trigrams (A-Z and the Latin-1 capitals folded, anything but letters counted as one gap) under a
  multinomial per language, tempered because neighbouring trigrams depend on each other; the extra language ``und`` spreads
  evenly over all trigrams and wins where a text resembles no known language;
- a declared language (of the markup, or of the record), right with probability ``DECLARED``;
- the address suffix, where a country code speaks for a language, right with probability ``SUFFIX``;
- a prior of the host: text votes are summed by host, parent domain and suffix, and each level's shares are smoothed
  with those of the next one, the widest level being all rows.

The text model is fitted on a bounded sample of labelled rows; votes and priors cover all rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import by_rows, give_back, materialize
from pageloom.llm.words import bytes_of, chunks

#: Labelled rows per language for fitting, about (rows are taken by a hash of the key), and languages at most.
SAMPLE, LANGUAGES = 1000, 256
BUCKETS = 1 << 16
TEMPER, SMOOTH = 0.3, 0.5
DECLARED, SUFFIX, STRENGTH = 0.9, 0.8, 5.0
UNKNOWN = "und"

#: Country codes of addresses and the language that most pages there use.
SUFFIX_LANGUAGES = {
    "at": "de", "de": "de", "es": "es", "mx": "es", "ar": "es", "fr": "fr", "uk": "en", "us": "en", "au": "en", "ie": "en",
    "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "se": "sv", "ru": "ru", "jp": "ja", "cn": "zh",
}

# Byte classes: 0 a gap, 1-26 letters, 27-90 bytes of characters beyond ASCII.
_CLASS = np.zeros(256, dtype=np.uint32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + (np.arange(128, 256) & 63)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all rows' letter trigrams, and each row's first place. A row counts as if gaps stood around it."""
    buffer, offsets = bytes_of(texts)
    rows = len(offsets) - 1
    capital = np.zeros(len(buffer), dtype=bool)
    capital[1:] = (buffer[:-1] == 0xC3) & (buffer[1:] >= 0x80) & (buffer[1:] <= 0x9E) & (buffer[1:] != 0x97)
    buffer = np.where(capital, buffer + 32, buffer).astype(np.uint8)
    at = np.arange(len(buffer)) + np.repeat(np.arange(rows) + 1, np.diff(offsets))
    symbol = np.zeros(len(buffer) + rows + 1, dtype=np.uint32)
    symbol[at] = _CLASS[buffer]
    row = np.zeros(len(symbol), dtype=np.int64)
    row[at] = np.repeat(np.arange(rows), np.diff(offsets))
    row[offsets + np.arange(rows + 1)] = np.minimum(np.arange(rows + 1), max(rows - 1, 0))
    keep = np.ones(len(symbol), dtype=bool)
    keep[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0)
    symbol, row = symbol[keep], row[keep]
    a, b, c = symbol[:-2], symbol[1:-1], symbol[2:]
    inner = b > 0
    with np.errstate(over="ignore"):
        key = ((a * np.uint32(128) + b) * np.uint32(128) + c) * np.uint32(2654435761)
    key, owner = (key >> np.uint32(16))[inner].astype(np.int64), row[1:-1][inner]
    return key, np.searchsorted(owner, np.arange(rows + 1))


class TextModel:
    """Log probabilities of trigram buckets by language; the last column is the even spread of ``und``."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        share = (counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * BUCKETS)
        even = np.full((BUCKETS, 1), 1.0 / BUCKETS)
        self.table = np.log(np.concatenate([share, even], axis=1)).astype(np.float32)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Tempered log likelihood (rows, languages + 1); zeros for a row without letters."""
        key, first = grams(texts)
        out = np.zeros((len(first) - 1, self.table.shape[1]))
        full = np.flatnonzero(np.diff(first))
        if len(full):
            for i in range(out.shape[1]):
                out[full, i] = np.add.reduceat(self.table[key, i].astype(np.float64), first[full])
        return out * TEMPER


def fit(labelled: DataFrame, key: str, text: str, label: str) -> TextModel:
    """A text model from about ``SAMPLE`` rows of each label; the ``LANGUAGES`` most frequent labels at most."""
    counts = labelled.filter(F.col(label).isNotNull() & (F.col(label) != "")).groupBy(F.col(label).alias("l")).count()
    kept = {r.l: r["count"] for r in counts.orderBy(F.desc("count"), "l").limit(LANGUAGES).collect()}
    languages = sorted(kept)
    if not languages:
        return TextModel([], np.zeros((BUCKETS, 0)))
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in kept.items() for x in (k, min(1.0, SAMPLE / n))]), F.col(label))
    # two to the 31 even steps of a hash
    lot = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 31)) / float(1 << 31)
    sample = labelled.filter(F.col(label).isin(languages) & (lot < rate)).select(F.col(label).alias("label"), F.col(text).alias("text"))
    place = {name: i for i, name in enumerate(languages)}

    def run(batches):
        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                found, first = grams(part.column("text"))
                lang = np.array([place[x] for x in part.column("label").to_pylist()])
                total += np.bincount(np.repeat(lang, np.diff(first)) * BUCKETS + found, minlength=total.size).reshape(total.shape)
        at, bucket = np.nonzero(total)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[at, bucket])], ["l", "b", "n"])

    got = sample.mapInArrow(run, "l int, b int, n bigint").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((BUCKETS, len(languages)))
    table[got.column("b").to_numpy(), got.column("l").to_numpy()] = got.column("n").to_numpy()
    return TextModel(languages, table)


def _log_share(languages: list[str], value: Column, right: float) -> Column:
    """Log likelihoods of an observed language code; zeros where it is missing or no known language."""
    n = len(languages) + 1
    wrong = float(np.log((1 - right) / max(1, n - 1)))
    one = F.array(*[F.when(value == name, float(np.log(right))).otherwise(wrong) for name in [*languages, UNKNOWN]])
    return F.when(value.isin(languages), one).otherwise(F.array(*[F.lit(0.0)] * n))


def _host_priors(votes: DataFrame, levels: list[str], n: int) -> DataFrame:
    """Levels and log prior: shares of text votes by the narrowest level, smoothed level by level."""
    names = [f"v{i}" for i in range(n)]
    sums = [F.sum(c).alias(c) for c in names]
    tables = materialize(votes.groupBy(*levels).agg(*sums))
    whole = tables.agg(*sums).head()
    every = sum(x or 0.0 for x in whole)
    out = tables.select(*levels)
    prior = [F.lit(((x or 0.0) + 1.0) / (every + n)) for x in whole]
    for i in range(len(levels) - 1, -1, -1):
        keys = levels[i:]
        level = tables.groupBy(*[F.col(k).alias(f"{k}_k") for k in keys]).agg(*[F.sum(c).alias(f"{c}_{i}") for c in names])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_k")) for k in keys])
        out = out.join(level, same, "left").drop(*[f"{k}_k" for k in keys])
        mass = sum((F.col(f"{c}_{i}") for c in names), F.lit(0.0))
        prior = [(F.col(f"{c}_{i}") + STRENGTH * p) / (mass + STRENGTH) for c, p in zip(names, prior, strict=True)]
    return out.select(*levels, F.array(*[F.log(p) for p in prior]).alias("_prior"))


def identify(
    rows: DataFrame, text: str, key: str, label: str | None = None, declared: Column | None = None,
    suffix: Column | None = None, levels: list[Column] | None = None, model: TextModel | None = None,
) -> DataFrame:
    """The rows with ``language`` (a code, or ``und``), ``probability`` and ``kept``.

    ``levels`` are the host and what contains it, narrowest first; ``label`` names the column to fit a text model on if none is
    given. A row is kept if some language is more likely than not and its text has letters; a null or empty text, or one
    without letters, is ``und`` with probability 1. Missing declared languages, suffixes and hosts add nothing
    (rows without host share one prior). Repeated rows are rows. Columns named like the three added ones are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("language", "probability", "kept")
    model = model or fit(rows, key, text, label)
    languages, n = model.languages, len(model.languages) + 1
    shared = spark.sparkContext.broadcast(model)
    levels = levels or [F.lit(None).cast("string")]
    named = [f"_level{i}" for i in range(len(levels))]
    rows = rows.withColumns(dict(zip(named, levels, strict=True)))

    @F.arrow_udf("array<double>")
    def evidence(texts: pa.Array) -> pa.Array:
        done = [shared.value.score(part.column(0)) for part in chunks(pa.RecordBatch.from_arrays([texts], ["t"]), "t")]
        flat = np.concatenate(done) if done else np.zeros((0, n))
        ends = np.arange(len(flat) + 1, dtype=np.int32) * n
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.reshape(-1)))

    def vote(batch: pa.RecordBatch) -> dict:
        found = [shared.value.score(part.column("t")) for part in chunks(batch, "t")]
        x = np.concatenate(found)
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True) * (x != 0).any(axis=1, keepdims=True)
        # one row per group of levels and batch, not per text
        table = pa.table({c: batch.column(c) for c in named} | {f"v{i}": pa.array(p[:, i]) for i in range(n)})
        got = table.group_by(named).aggregate([(f"v{i}", "sum") for i in range(n)])
        return {c: got.column(c).combine_chunks() for c in named} | {f"v{i}": got.column(f"v{i}_sum").combine_chunks() for i in range(n)}

    schema = ", ".join([f"{c} string" for c in named] + [f"v{i} double" for i in range(n)])
    cast = [F.col(c).cast("string").alias(c) for c in named]
    priors = _host_priors(by_rows(rows.select(*cast, F.col(text).alias("t")), vote, schema), named, n)
    # written, so that Spark knows its size and need not shuffle the texts to join it
    priors = materialize(priors.select(*[F.col(c).alias(f"{c}_p") for c in named], "_prior"))

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    same = reduce(lambda a, b: a & b, [F.col(c).cast("string").eqNullSafe(F.col(f"{c}_p")) for c in named])
    total = add(F.col("_text"), F.col("_prior"))
    if declared is not None:
        total = add(total, _log_share(languages, declared, DECLARED))
    if suffix is not None:
        code = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGES.items() for x in kv]), suffix)
        total = add(total, _log_share(languages, code, SUFFIX))
    names = F.array(*[F.lit(x) for x in [*languages, UNKNOWN]])
    out = rows.withColumn("_text", evidence(F.col(text))).join(priors, same, "left").withColumn("_total", total)
    best = F.array_max("_total")
    letters = F.exists("_text", lambda x: x != 0)
    language = F.when(letters, F.element_at(names, F.array_position("_total", best).cast("int"))).otherwise(UNKNOWN)
    share = 1 / F.aggregate(F.col("_total"), F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("_total")))
    out = out.withColumn("language", language).withColumn("probability", F.when(letters, share).otherwise(1.0))
    out = out.withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("probability") >= 0.5))
    return out.drop("_text", "_total", "_prior", *named, *[f"{c}_p" for c in named])


def identify_documents(docs: DataFrame) -> DataFrame:
    """``documents``: the record's language is declared, its source is the host."""
    return identify(docs, "text", "doc_id", label="lang", declared=F.col("lang"), levels=[F.col("source")])


def page_evidence(pages: DataFrame) -> DataFrame:
    """``pages`` with visible text, declared language (``lang`` of the html element), host, parent domain and suffix."""
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>|&[A-Za-z#0-9]+;", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    parts = F.split("_host", r"\.")
    return (
        pages.withColumn("_visible", visible)
        .withColumn("_declared", F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)))
        .withColumn("_host", host)
        .withColumn("_parent", F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), "."))
        .withColumn("_suffix", F.element_at(parts, -1))
    )


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """``pages`` by all four kinds of evidence, with a text model fitted elsewhere."""
    known = page_evidence(pages)
    levels = [F.col("_host"), F.col("_parent"), F.col("_suffix")]
    out = identify(known, "_visible", "page_id", declared=F.col("_declared"), suffix=F.col("_suffix"), levels=levels, model=model)
    return out.drop("_visible", "_declared", "_host", "_parent", "_suffix")
