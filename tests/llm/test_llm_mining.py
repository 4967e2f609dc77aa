"""Collocations, archives and centroid clusters against brute force, on odd rows, and on nothing."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import messy, messy_rows, nothing  # noqa: F401
from pyspark.sql import functions as F

from pageloom.llm import collocations as C
from pageloom.llm import orchard, quotient, warc

# --- counting quotient filters


@pytest.mark.parametrize("bits", [1, 2, 7, 14, 21, 22, 27, 32])
def test_scrambling_is_a_permutation(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, (500, 3))
    left, right = quotient.scramble(ids, bits)
    wl, wr = quotient.halves(bits)
    assert wl + wr == 3 * bits and int(left.max()) < 1 << wl and int(right.max()) < 1 << wr
    assert (quotient.unscramble(left, right, bits) == ids).all()
    if bits == 2:
        every = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(4)])
        assert len(set(zip(*(x.tolist() for x in quotient.scramble(every, 2)), strict=True))) == 64


@pytest.mark.parametrize("bits", [2, 9, 21, 24, 32])
def test_filters_keep_counts_and_merge(bits):
    rng = random.Random(bits)
    total, filters = Counter(), []
    for _ in range(4):
        own = Counter()
        for _ in range(300):
            own[tuple(rng.randrange(1 << min(bits, 3)) if rng.random() < 0.5 else rng.randrange(1 << bits) for _ in range(3))] += rng.choice([1, 2, 254, 255, 1 << 40])
        total += own
        filters.append(quotient.Filter.of(np.array(list(own)), np.array(list(own.values())), bits))
    for lead, more in ((0, 0), (0, min(3, quotient.halves(bits)[0]))):
        parts = {}
        for f in filters:
            for prefix, part in f.cut(lead, more):
                raw = part.pack(lead + more)
                parts.setdefault(prefix, []).append(quotient.Filter.unpack(raw, prefix))
        got = Counter()
        for some in parts.values():
            whole = quotient.merge(some)
            keys = list(zip(whole.left.tolist(), whole.right.tolist(), strict=True))
            assert keys == sorted(set(keys))
            got.update({tuple(k): n for k, n in zip(whole.ids().tolist(), whole.count.tolist(), strict=True)})
        assert got == total


def test_filters_are_compact():
    rng = np.random.default_rng(1)
    ids = np.unique(rng.integers(0, 1 << 14, (200_000, 3)), axis=0)
    raw = quotient.Filter.of(ids, np.ones(len(ids), np.int64), 14).pack(0)
    assert len(raw) / len(ids) < 6


# --- collocations


def brute_collocations(rows, least, share, top):
    n, counts = Counter(), {}
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f = counts.setdefault(lang or "und", Counter())
            for k in (1, 2, 3):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        made = []
        longer = Counter()
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        for p, a in f.items():
            if len(p) < 2 or a < least or (len(p) == 2 and longer[p] and 100 * longer[p] >= share * a):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            made.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(made)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def test_blocks_leave_in_small_rows_and_batches(monkeypatch):
    """A block's words and text in order, none of it in a row or batch of a block's size."""
    monkeypatch.setattr(C, "CODES_ROW", 1 << 10, raising=False)
    monkeypatch.setattr(C, "WORDS_BATCH", 1 << 8, raising=False)
    texts = [f"Word{i % 3000} and, w{i % 7}" for i in range(9000)]
    batch = pa.record_batch({"lang": ["en"] * len(texts), "text": texts})
    made = list(C._blocks(iter([batch]), 100_000, 200_000))
    assert max(b.nbytes for b in made) < 30_000
    rows = pa.Table.from_batches(made).to_pylist()
    blocks = {r["block"] for r in rows}
    assert len(blocks) > 1
    got, counts = [], Counter()
    for block in sorted(blocks, key=[r["block"] for r in rows].index):
        own = [r for r in rows if r["block"] == block]
        words = [r["word"] for r in own if r["word"] is not None]
        assert [r["at"] for r in own if r["word"] is not None] == list(range(len(words)))
        counts.update({r["word"]: r["n"] for r in own if r["word"] is not None})
        text = [r for r in own if r["word"] is None]
        assert [r["at"] for r in text] == list(range(len(text)))
        codes = [np.frombuffer(r["codes"], "<u4") for r in text]
        assert [len(c) for c in codes] == [r["n"] for r in text]
        got += [(words[c >> 1], c & 1) for c in np.concatenate(codes).tolist()]
    want = [w for i in range(9000) for w in ((f"word{i % 3000}", 1), ("and", 0), (f"w{i % 7}", 1))]
    assert got == want and counts == Counter(w for w, _ in want)


COLLOCATIONS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("words", "fan", "block", "held"), [(1 << 20, 8, 6 << 20, 24 << 20), (400, 1, 3000, 5000), (150, 2, 500, 2000)])
def test_collocations(spark, data, messy, nothing, words, fan, block, held):  # noqa: F811
    odd = [(None, None, "en"), (1, "", "en"), (2, " .,\n", None), (3, "A b C. a b c, a\tb  c a b;d " * 9, None), (4, "x" * 20000, "fr"), (5, "é ß é ß. É ß!" * 5, "de"),
           (3, "A b C. a b c, a\tb  c a b;d " * 9, "und")]
    tables = [messy, spark.createDataFrame(odd, "doc_id bigint, text string, lang string").withColumns({c: F.lit(1) for c in ("n", "word", "block", "w1", "g")})]
    if words == 400:
        tables.append(spark.read.parquet(f"{data}/documents.parquet"))
    for df in tables:
        rows = [(r.lang, r.text) for r in df.select("lang", "text").collect()]
        for least, share, top in ((2, 50, 2000), (1, 90, 7), (10, 50, 40)):
            got = C.collocations(df, least, share, top, shard_words=words, fan_bits=fan, block_bytes=block, held_bytes=held)
            assert sorted(tuple(r[c] for c in COLLOCATIONS) for r in got.collect()) == brute_collocations(rows, least, share, top)
    empty = C.collocations(nothing)
    assert tuple(empty.columns) == COLLOCATIONS and empty.count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10, 10, 10), (9_999_999_999_999, 10_000_000_000_007, 12_345_678_901_234), (3_000_000_000, 3_000_000_001, 9_000_000_000_000), (10, 11, 2**40)]
    df = spark.createDataFrame(cases, "a bigint, l bigint, r bigint")
    got = df.select("a", "l", "r", C.exact_score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert dict(got.dtypes)["s"] == "bigint"
    assert sorted(map(tuple, got.collect())) == sorted((a, x, y, 1000000 * a * a // (x * y)) for a, x, y in cases)


# --- archives

PAGES = [
    (1, "http://www.A.com:8080/x?y=1#z", "<p>é</p>"), (2, "https://b.a.com", "same"), (3, "https://b.a.com", "same"), (3, "https://b.a.com", "same"),
    (4, None, None), (5, "", ""), (None, "http://c.org/n", "same"), (None, "http://c.org/n", "only"), (6, "no url at all", "x\r\n\r\ny\x00"),
    (7, "http://a.com/\r\nWARC-Type: forged", "z" * 300_000), (8, "http://user:pw@d.com/p q/é?ü", "WARC/1.1\r\n\r\n"), (-9, "http://a.com/", "<a>"),
]


def brute_records(rows, least):
    groups = {}
    for i, (page, url, html) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append((page is not None, page or 0, url is not None, url or "", i))
    out = []
    for payload, members in groups.items():
        first = max(members)
        for m in members:
            revisit = len(payload) >= least and m[4] != first[4]
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            out.append((rows[m[4]][0], len(payload), digest, "revisit" if revisit else "response", rows[first[4]][0] if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture()
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    return df.withColumns({c: F.lit("own") for c in ("key", "file", "offset", "digest", "n", "kind")}).repartition(3)


@pytest.mark.parametrize(("lines", "copies", "roll", "least"), [(1024, 1000, 1 << 30, 0), (1, 1, 1, 0), (2, 2, 300, 5)])
def test_round_trip(spark, pages, tmp_path, monkeypatch, lines, copies, roll, least):
    for name, value in (("COPIES", copies), ("ROLL_BYTES", roll), ("READ_BYTES", 200 if lines == 1 else 4 << 20)):
        monkeypatch.setattr(warc, name, value)
    got = warc.archive_round_trip(pages, str(tmp_path / "w"), least, lines)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_records(PAGES, least)
    assert warc.archive_round_trip(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_archive_files_are_warc(pages, tmp_path):
    captures = warc.write_archive(pages, str(tmp_path)).collect()
    assert len(captures) == len(PAGES)
    kinds = Counter()
    for path in tmp_path.glob("*.warc.gz"):
        raw, at = gzip.decompress(path.read_bytes()), 0
        while at < len(raw):
            head, rest = raw[at:].split(b"\r\n\r\n", 1)
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and {b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length"} <= set(fields)
            length = int(fields[b"Content-Length"])
            assert rest[length : length + 4] == b"\r\n\r\n"
            kinds[fields[b"WARC-Type"].decode()] += 1
            at += len(head) + 4 + length + 4
    assert (kinds["response"], kinds["revisit"]) == (8, 4) and kinds["warcinfo"] >= 1


def test_keys_reverse_hosts(spark):
    urls = ["http://www.A.com:8080/x?y=1#z", "https://b.a.com", "https://u:p@b.a.com/?q", "no url", "", None, "mailto:x@y.z", "http://a.com#top"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u")).alias("k")).collect()
    assert [r.k for r in rows] == ["com,a,www:8080)/x?y=1", "com,a,b)/", "com,a,b)/?q", "no url", "", "", "mailto:x@y.z", "com,a)/"]


def test_lookups_find_all_captures_and_read_few_blocks(spark, tmp_path, monkeypatch):
    rows = [(f"com,s{i % 40:02d})/{i % 7}" if i % 3 else "com,hot)/", i, "f", i * 10, 10) for i in range(3000)]
    captures = spark.createDataFrame(rows, warc.CAPTURES)
    files = warc.build_index(captures, str(tmp_path), block_lines=16)
    listed = sorted((r["first"], r["last"], r.lines, r.blocks) for r in files.collect())
    assert sum(x[2] for x in listed) == 3000 and all(x[3] == -(-x[2] // 16) for x in listed)
    assert all(a[1] <= b[0] for a, b in zip(listed, listed[1:], strict=False))
    asked = ["com,hot)/", "com,s05)/3", "absent", "zzz", "com,s05)/3", None]
    keys = spark.createDataFrame([(k,) for k in asked], "key string")
    got = warc.look_up(files, str(tmp_path), keys).collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if r[0] in ("com,hot)/", "com,s05)/3"))
    one = warc.IndexFile(str(tmp_path), max(files.collect(), key=lambda r: r.blocks)["file"])
    assert len(list(one.find("com,absent)/"))) == 0
    one.close()


def test_damage_is_noticed():
    raw = warc.record("response", 4, "http://a.com/", warc.base32_of(hashlib.sha1(b"abc").hexdigest()), 3, b"abc", None, "2024-01-01T00:00:00Z", 0)
    assert warc.parse(raw)[:2] == (4, 3)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(raw.replace(b"abc", b"abd"))


# --- centroid clusters


def brute_clusters(rows, k, rounds, dim, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), [str(x) for x in v], v) for i, v in kept if i is not None)
    centres = [v for _, _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        mine = {}
        for _, v in kept:
            mine.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(mine[j]) for x in zip(*mine[j], strict=True)] if j in mine else c for j, c in enumerate(centres)]
    done = [(i, *nearest(v)) for i, v in kept] if centres else []
    inertia = Counter()
    for _, d, j in done:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((i, j, long(d), long(inertia[j]), long(sum(inertia.values())), digest[j]) for i, d, j in done), key=repr)


CLUSTERS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def vectors_of(seed, n, dim):
    rng = random.Random(seed)
    return [(rng.randrange(n * 2), [rng.choice([0.0, 0.25, -0.5, 1.0]) if seed % 2 else rng.gauss(0, 1) for _ in range(dim)]) for _ in range(n)]


@pytest.mark.parametrize(("seed", "k", "rounds", "dim"), [(1, 16, 3, 3), (2, 5, 2, 4), (3, 1, 1, 2), (4, 16, 0, 8)])
def test_clusters(spark, seed, k, rounds, dim):
    odd = [(None, [0.5] * dim), (900, None), (901, []), (902, [0.5] * (dim + 1)), (903, [float("nan")] * dim), (904, [float("inf")] * dim), (905, [None] * dim), (906, [0.0] * dim), (906, [1.0] * dim)]
    rows = vectors_of(seed, 120, dim) + odd
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("own") for c in ("cluster", "distance", "c", "v", "h", "vector")}).repartition(3)
    got = orchard.orchard_clusters(df, k, rounds, dim)
    assert sorted((tuple(r[c] for c in CLUSTERS) for r in got.collect()), key=repr) == brute_clusters(rows, k, rounds, dim, 64)


def test_few_none_and_huge(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert orchard.orchard_clusters(spark.createDataFrame([], schema)).count() == 0
    assert orchard.orchard_clusters(spark.createDataFrame([(None, [1.0] * 64)], schema)).count() == 0
    for scale in (1e3, 1e7, 1e30):
        rows = [(i, [float(np.float32(scale * math.sin(i * 3 + j))) for j in range(64)]) for i in range(9)]
        got = orchard.orchard_clusters(spark.createDataFrame(rows, schema), k=4)
        assert sorted((tuple(r[c] for c in CLUSTERS) for r in got.collect()), key=repr) == brute_clusters(rows, 4, 3, 64, 64)


def test_search_skips_far_centroids():
    rng = np.random.default_rng(5)
    centres = np.concatenate([rng.integers(0, 50, (8, 4)), rng.integers(100_000, 100_050, (8, 4))])
    points = np.concatenate([rng.integers(0, 50, (200, 4)), rng.integers(100_000, 100_050, (200, 4))])
    search, tried = orchard.Orchard(centres.tolist()), []
    real = orchard.squared
    try:
        orchard.squared = lambda a, b: (tried.append(len(a)), real(a, b))[1]
        best, far = search.nearest(points)
    finally:
        orchard.squared = real
    want = [min((int(((p - c) ** 2).sum()), j) for j, c in enumerate(centres)) for p in points]
    assert [(d, j) for j, d in zip(best.tolist(), far.tolist(), strict=True)] == want
    assert sum(tried) < 0.8 * len(points) * len(centres)


pytestmark = pytest.mark.filterwarnings("ignore::DeprecationWarning")
