"""Tokenizing, license scan, language model, substring dedup and near-duplicates against brute force."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import messy, messy_rows, nothing  # noqa: F401

from pageloom.llm import blocks, bpe, ctw, langid, licenses, minhash, neardup, substrings
from pageloom.llm.queries import rank_file


def texts_of(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def split(text):
    return (text or "").encode().split()


# --- byte-level BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_file(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library_and_decode_to_the_text(library):
    rng, enc = random.Random(3), bpe.encoder(rank_file())
    parts = ["a", "b", " ", "  ", "\n", "'s", "'ll", "é", "²", " ", "\x1c", " ", "ñ", "!", "中文", "😀", "the ", "\t", "_1"]
    for _ in range(1500):
        text = "".join(rng.choice([*parts, chr(rng.randrange(1, 0xD800)), chr(rng.randrange(0xE000, 0x110000))]) for _ in range(rng.randrange(50)))
        ids = np.frombuffer(enc.encode(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text), repr(text)
        assert enc.decode(ids) == text.encode()


def test_perfect_hash_is_minimal_and_knows_strangers():
    ranks = {str(i).encode(): i for i in range(1000)}
    table = bpe.PerfectHash(ranks)
    assert len(table.keys) == len(ranks) and None not in table.keys
    assert all(table.get(k) == v for k, v in ranks.items())
    assert table.get(b"absent") == -1
    assert bpe.PerfectHash({}).get(b"x") == -1


def test_bpe_rows(messy, nothing, library):
    got = sorted(map(tuple, bpe.round_trip(messy, rank_file()).collect()), key=repr)
    want = []
    for d, text, *_ in messy_rows():
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = bpe.decode_ids(bpe.encode_texts(messy, rank_file()), rank_file())
    assert sorted((r.doc_id, bytes(r.raw)) for r in back.filter("doc_id is not null").collect()) == sorted(
        (d, (t or "").encode()) for d, t, *_ in messy_rows() if d is not None
    )
    assert bpe.round_trip(nothing, rank_file()).count() == 0


# --- licenses


@pytest.mark.parametrize(
    ("text", "value", "labels"),
    [
        ("MIT", 1.0, {"mit"}),
        ("MIT OR GPL-2.0-only", 1.0, {"mit", "gpl"}),
        ("MIT AND GPL-2.0-only", 0.4, {"mit", "gpl"}),
        ("GPL-2.0-only WITH Classpath-exception-2.0", 0.7, {"gpl"}),
        ("MIT OR Apache-2.0 AND CC-BY-NC-4.0", 1.0, {"mit", "apache", "cc-by-nc"}),
        ("(MIT OR Apache-2.0) AND CC-BY-NC-4.0 */", 0.1, {"mit", "apache", "cc-by-nc"}),
        ("GPL-2.0 or LGPL-2.1 and (AGPL-3.0 with X-1 or Foo-1.0)", 0.6, {"gpl", "lgpl", "agpl", "spdx:foo-1.0"}),
    ],
)
def test_expressions(text, value, labels):
    got, names = licenses.evaluate(licenses.postfix(text))
    assert got == pytest.approx(value) and set(names) == labels


@pytest.mark.parametrize("text", ["", "OR MIT", "MIT AND", "(MIT", "WITH", "MIT OR OR Apache-2.0", ")"])
def test_broken_expressions(text):
    assert licenses.postfix(text) is None


def brute_scan(text):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = []
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def test_scan_rows(spark, data, messy, nothing):
    for df in (messy, spark.read.parquet(f"{data}/documents.parquet")):
        rows = {}
        for r in df.select("doc_id", "text").collect():
            rows.setdefault(r.doc_id, []).append(r.text)
        for r in licenses.scan_licenses(df).collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_scan(rows[r.doc_id][0])
            assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert licenses.scan_licenses(nothing).count() == 0


def test_tags_and_notices():
    raw = b"// SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC-BY-NC-4.0\nAll rights reserved. CC BY-NC, cc by"
    n, base, first, last, base_labels, labels, score = licenses.scan_text(raw)
    assert (base, base_labels) == (3, "cc-by") and labels == "apache,cc-by,cc-by-nc,mit,reserved" and score == 0
    assert first < last < n


# --- substring dedup


def brute_repeats(rows):
    """By row: words and removal marks, rows in order of (id, nulls first); rows of one id and text are one place."""
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        d, words = rows[i][0], split(rows[i][1])
        marks = [False] * len(words)
        for s in range(len(words) - 19):
            place = seen.setdefault(tuple(words[s : s + 20]), (d, s))
            if place != (d, s):
                marks[s : s + 20] = [True] * 20
        out.append((d, words, marks))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 30, 3000])
def test_repeats(spark, data, messy, nothing, monkeypatch, block_bytes):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    for df in (messy, spark.read.parquet(f"{data}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        want = sorted(((d, len(w), sum(m), b" ".join(x for x, gone in zip(w, m, strict=True) if not gone).decode()) for d, w, m in brute_repeats(rows)), key=repr)
        out = substrings.remove_repeats(df)
        assert set(out.columns) - set(df.columns) <= {"n_words", "n_removed", "factors"}
        got = out.select("doc_id", "n_words", "n_removed", "text", "factors").collect()
        assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=repr) == want
        assert all(sum(f.stop - f.start for f in r.factors) == r.n_removed and all(f.stop - f.start >= 20 for f in r.factors) for r in got)
    assert substrings.remove_repeats(nothing).count() == 0


def test_layout_keeps_untouched_texts(messy):
    before = {r.doc_id: r.text for r in messy.select("doc_id", "text").collect()}
    for r in substrings.remove_repeats(messy, layout=True).collect():
        if not r.n_removed:
            assert r.text == (before[r.doc_id] or "")
    assert {r.key for r in substrings.remove_repeats(messy).collect()} == {"own key"}


# --- near-duplicates


def test_signatures_estimate_similarity_with_less_variance():
    rng, m = np.random.default_rng(1), 100
    found = []
    for _ in range(150):
        a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        b = a.copy()
        b[:24] = rng.integers(0, 1 << 63, 24).astype(np.uint64)
        h = minhash.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 300, 600]), m)
        found.append((h[0] == h[1]).mean())
    j = 276 / 324
    assert abs(np.mean(found) - j) < 0.01 and np.std(found) < math.sqrt(j * (1 - j) / m)


def test_a_signature_is_the_minimum_over_elements():
    rng = np.random.default_rng(2)
    values = np.sort(rng.integers(0, 1 << 63, 37).astype(np.uint64))
    single = [minhash.signatures(values[i : i + 1], np.array([0, 1]), 50)[0] for i in range(37)]
    assert (np.minimum.reduce(single) == minhash.signatures(values, np.array([0, 37]), 50)[0]).all()
    assert all(sorted(s.astype(int).tolist()) == list(range(50)) for s in single)


def brute_groups(rows, k, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return [(d, len(s), least.get(g), d == least.get(g)) for (d, _), s, g in zip(rows, sets, group, strict=True)]


@pytest.mark.parametrize(("k", "percent", "rows"), [(3, 85, 5), (5, 80, 4)])
def test_groups(spark, data, messy, nothing, k, percent, rows, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 2)
    for df in (messy, spark.read.parquet(f"{data}/documents.parquet")):
        texts = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        want = sorted(((d, n, c, kept if d is not None else True) for d, n, c, kept in brute_groups(texts, k, percent)), key=repr)
        assert sorted(map(tuple, neardup.near_duplicates(df, k, percent, rows).collect()), key=repr) == want
    assert neardup.near_duplicates(nothing, k, percent, rows).count() == 0


def test_chain_of_near_copies_in_small_blocks(spark, monkeypatch):
    """Documents of which only neighbours are similar enough: the group holds by its links, not by one centre."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i * 3 % 31, " ".join(words[i * 8 : i * 8 + 150])) for i in range(31)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85, 5).collect()
    assert sorted(map(tuple, got)) == sorted(brute_groups(rows, 3, 85))
    assert {r.component_id for r in got} == {0}


def test_keep_one(messy):
    kept = neardup.keep_one(messy, 3, 85, 5)
    assert kept.columns == messy.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert ids[3] == 1 and 7 not in ids and 9 not in ids and ids[4] == 1 and 40 not in ids and ids[None] == 1 and ids[20] == ids[21] == 1


def test_several_texts_under_one_id(spark):
    """Each text is judged by itself: none is lost, and the bands of all of them count."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda t: t.replace("30 ", "30x ", 1)
    rows = [(3, a), (5, a), (5, b), (5, b), (6, near(b)), (7, c), (5, near(c)), (8, None), (8, c + " more"), (None, b)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, 3, 80, 4).collect()}
    assert {(3, 58, 3, True), (5, 58, 3, False), (5, 58, 5, True), (6, 58, 5, False), (7, 58, 5, False), (8, 59, 5, False), (8, 0, 8, True)} <= got
    kept = Counter((r.doc_id, r.text) for r in neardup.keep_one(df, 3, 80, 4).collect())
    assert kept == Counter({(3, a): 1, (5, b): 1, (5, near(c)): 1, (8, None): 1, (None, b): 1})


# --- language model


@pytest.mark.parametrize("block_bytes", [1 << 30, 4000])
def test_scores(spark, data, messy, nothing, monkeypatch, block_bytes):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    for df in (messy, spark.read.parquet(f"{data}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
        tokens = {i: [*(t or "").encode().lower().split(), None] for i, (_, t) in enumerate(rows)}
        counts = Counter(w for i, (d, _) in enumerate(rows) if not out(d) for w in tokens[i])
        n, v = counts.total(), len(counts)
        want = sorted(
            ((d, out(d), len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[i]), 5)) for i, (d, _) in enumerate(rows)),
            key=repr,
        )
        got = ctw.score_texts(df).collect()
        assert sorted(((*r[:5], round(r.base_score, 5)) for r in got), key=repr) == want
    assert ctw.score_texts(nothing).count() == 0
    held = [r for r in got if r.held_out]
    bits = -sum(r.score for r in held) / sum(r.n_bytes for r in held) / math.log10(2)
    assert bits < 3.5, "code length of held-out texts, in bits a byte"


def test_context_tree_against_the_definition():
    """Probabilities of all bytes sum to one, and equal those of a tree weighted node by node."""
    rng = np.random.default_rng(4)
    texts = [bytes(rng.choice(list(b"abcab"), 40)) for _ in range(6)]
    counts = Counter()
    for t in texts:
        s = b"\xff\xff" + t + b"\xff"
        counts.update((s[i] << 16) | (s[i + 1] << 8) | s[i + 2] for i in range(len(s) - 2))
    keys = np.array(sorted(counts))
    model = ctw.train(keys, np.array([counts[k] for k in keys.tolist()]))
    assert np.allclose((10.0 ** model.table.astype(float)).sum(axis=1), 1, atol=1e-4)

    def bits(context, depth, node, level):
        """Zeros and ones at a node after a context of some depth."""
        got = [0, 0]
        for k, n in counts.items():
            c, s = k >> 8, k & 255
            if (depth == 0 or (c & 255) == (context & 255)) and (depth < 2 or c == context) and (s | 256) >> (8 - level) == node:
                got[s >> (7 - level) & 1] += n
        return got

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    contexts = {k >> 8 for k in counts}
    for context, s in [((97 << 8) | 98, 99), ((98 << 8) | 97, 98), ((120 << 8) | 97, 97), (0x7A7A, 97)]:
        total = 0.0
        for level in range(8):
            node, bit = (s | 256) >> (8 - level), s >> (7 - level) & 1
            ab = [bits(context, d, node, level) for d in range(3)]
            inner = {c & 255: sum(kt(*bits(x, 2, node, level)) for x in contexts if x & 255 == c & 255) for c in contexts}
            weighted = {c: np.logaddexp(kt(*bits(c, 1, node, level)), inner[c]) - math.log(2) for c in inner}
            own0, below0 = kt(*ab[0]), sum(weighted.values())
            own1, below1 = kt(*ab[1]), inner.get(context & 255, 0.0)
            w0, w1 = (1 / (1 + math.exp(b - a)) for a, b in ((own0, below0), (own1, below1)))
            p = [(x[bit] + 0.5) / (sum(x) + 1) for x in ab]
            total += math.log10(w0 * p[0] + (1 - w0) * (w1 * p[1] + (1 - w1) * p[2]))
        assert model.score(np.array([context << 8 | s]))[0] == pytest.approx(total, abs=1e-4)


@pytest.mark.parametrize("group_keys", [1 << 21, 1])
def test_scores_mix_all_depths(spark, monkeypatch, group_keys):
    """Scores equal those of a tree of all contexts of up to seven bytes, weighted node by node."""
    monkeypatch.setattr(ctw, "GROUP_KEYS", group_keys)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 300)
    rng, parts = random.Random(6), ["the cat ", "the cart ", "a cat sat ", "abcabc", "é", "B"]
    rows = [(d, "".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for d in range(40)] + [(40, None)]
    text = {d: b"\xff" * 7 + (t or "").lower().encode() + b"\xff" for d, t in rows}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in text}
    counts, longer = {}, {}
    for d, t in text.items():
        for i in range(7, len(t)) if not out[d] else ():
            for k in range(8):
                longer.setdefault(t[i - k + 1 : i] if k else None, set()).add(t[i - k : i])
                for level in range(8):
                    counts.setdefault((t[i - k : i], (t[i] | 256) >> (8 - level)), [0, 0])[t[i] >> (7 - level) & 1] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    memo = {}

    def weighted(context, node):
        """ln of the estimate and of the longer contexts' product; together they are the weighted probability."""
        if (context, node) not in memo:
            own = kt(*counts.get((context, node), (0, 0)))
            below = own if len(context) == 7 else sum(np.logaddexp(*weighted(c, node)) - math.log(2) for c in longer.get(context, ()) if len(c) > len(context))
            memo[context, node] = own, below
        return memo[context, node]

    def probability(t, i, k, node, bit):
        context = t[i - k : i]
        n = counts.get((context, node), (0, 0))
        p = (n[bit] + 0.5) / (sum(n) + 1)
        if k == 7:
            return p
        own, below = weighted(context, node)
        w = 1 / (1 + math.exp(below - own))
        return w * p + (1 - w) * probability(t, i, k + 1, node, bit)

    want = {}
    for d, t in text.items():
        bits = ((i, (t[i] | 256) >> (8 - level), t[i] >> (7 - level) & 1) for i in range(7, len(t)) for level in range(8))
        want[d] = sum(math.log10(probability(t, i, 0, node, bit)) for i, node, bit in bits)
    got = ctw.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx(want, abs=1e-3)


def test_large_counts_follow_the_series():
    g = ctw._LogGamma()
    a, b = np.array([0, 5, 4095, 4097, 10**9]), np.array([3, 4096, 0, 70000, 10**12])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(x + y + 1) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert np.allclose(g.estimate(a, b), want, rtol=1e-9, atol=1e-6)


# --- language ID


def test_text_alone_identifies_held_out_rows(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.filter("doc_id % 2 = 0"), "doc_id", "text", "lang")
    got = langid.identify(docs.filter("doc_id % 2 = 1"), "text", "doc_id", model=model).select("lang", "language", "kept", "text").collect()
    long = [r for r in got if len(r.text) > 40]
    assert sum(r.lang == r.language for r in long) / len(long) > 0.99
    assert all(r.kept for r in long)


def test_unknown_and_empty_texts_go(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs, "doc_id", "text", "lang")
    odd = [(1, None), (2, ""), (3, "12 %% 34 ..."), (4, "これは日本語の文章です。漢字も少しあります。" * 3), (5, "Это русский текст, которого никто не учил. " * 3)]
    got = langid.identify(spark.createDataFrame(odd, "doc_id bigint, text string"), "text", "doc_id", model=model).collect()
    assert {r.doc_id: (r.language, r.kept) for r in got} == {i: ("und", False) for i in range(1, 6)}


def test_evidence_is_fused(spark, data):
    model = langid.fit(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text", "lang")
    short = "<html lang='{}'><body>la</body></html>"
    pages = [(i, f"https://h{i}.example.{tld}/x", short.format(lang)) for i, (tld, lang) in enumerate([("fr", "fr"), ("es", "es"), ("com", "es"), ("com", "fr")])]
    df = spark.createDataFrame([*pages, (9, None, None)], "page_id bigint, url string, html string")
    got = {r.page_id: r.language for r in langid.identify_pages(df, model).collect()}
    assert got == {0: "fr", 1: "es", 2: "es", 3: "fr", 9: "und"}


def test_hosts_lend_their_language(spark, data):
    model = langid.fit(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text", "lang")
    french = spark.read.parquet(f"{data}/documents.parquet").filter("lang = 'fr' and n_chars > 300").select("text").limit(20).collect()
    rows = [(i, r.text, "h") for i, r in enumerate(french)] + [(100, "la", "h"), (101, "la", "other"), (102, "la", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.language, r.probability) for r in langid.identify(df, "text", "doc_id", levels=[langid.F.col("source")], model=model).collect()}
    assert got[100][0] == "fr" and got[100][1] >= got[101][1]


def test_language_rows(messy, nothing):
    got = langid.identify_documents(messy)
    assert got.count() == len(messy_rows()) and set(got.columns) == set(messy.columns) | {"language", "probability", "kept"}
    assert langid.identify_documents(nothing).count() == 0
