"""Top-k search, embedding near-duplicates, chat formatting, packing and components against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from llm_rows import messy, messy_rows, nothing  # noqa: F401
from pageloom.llm import chat, components, embdup, packing, topk
from pageloom.llm.queries import HOSTILE, tokenizer_file

# --- components


@pytest.mark.parametrize("shape", ["path", "star", "random", "odd"])
def test_components(spark, shape):
    rng = random.Random(5)
    if shape == "path":
        order = rng.sample(range(200), 200)
        links = list(zip(order[:-1], order[1:], strict=True))
    elif shape == "star":
        links = [(150, i) for i in range(150)]
    elif shape == "random":
        links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    else:
        links = [(1, 1), (2, 1), (2, 1), (1, 2), (None, 3), (4, None)]
    group = {}
    for a, b in links:
        if a is None or b is None or a == b:
            continue
        x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
        if x is not y:
            x |= y
            for n in y:
                group[n] = x
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted((n, min(g)) for n, g in group.items())


# --- top-k


def vectors(spark, n=300, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(dim)], int(rng.integers(3)), "own") for i in range(n)]
    rows += [(1000, rows[0][1], 0, "own"), (1001, rows[0][1], 0, "own"), (1002, None, 0, "own"), (1003, [None, 1.0], 0, "own")]
    rows += [(1004, [math.nan] * dim, 0, "own"), (1005, [math.inf] * dim, 1, "own"), (1006, [0.0] * dim, 1, "own"), (1007, [], 1, "own")]
    rows += [(1008, [1.0, 2.0], 1, "own"), (None, rows[3][1], 0, "own"), (1009, rows[5][1], None, "own"), (rows[9][0], rows[9][1], rows[9][2], "own")]
    rows += [(1010 + i, [x * (1 + 0.02 * i) + 0.01 for x in rows[20][1]], rows[20][2], "own") for i in range(12)]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, score string").repartition(4)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [16384, 37])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 5)
    rows, df = vectors(spark)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and good(v)]
    want = []
    for q in (0, 9, 50, 1000, 1006, 1007, 1008):
        vec = dict(reversed(whole))[q]
        scored = sorted((-sum(a * b for a, b in zip(vec, v, strict=False)), i) for i, v in whole if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    got = topk.top_k(df, df.filter("vec_id in (0, 9, 50, 1000, 1002, 1004, 1006, 1007, 1008)"))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(df.filter("vec_id < 0"), df).count() == 0


def test_search_stops_on_proof_and_stays_exact():
    rng = np.random.default_rng(3)
    rows = (rng.standard_normal((2000, 8)) * np.array([200, 5, 5, 5, 5, 5, 5, 5])).astype(np.int64)
    block = topk.Block(np.arange(2000), rows)
    q = rows[:7]
    at, row, score = block.search(np.arange(7), q, 5)
    assert len(at) < 7 * 2000 / 2, "most rows are ruled out before they are rescored"
    best = topk._best(at, row, score, 5)
    for i in range(7):
        exact = rows @ q[i]
        want = sorted((-int(s), j) for j, s in enumerate(exact) if j != i)[:5]
        assert [(-int(score[b]), int(row[b])) for b in best[at[best] == i]] == want


def test_huge_components_are_exact(spark):
    rows = [(i, [float(10**7 + i), float(i)]) for i in range(8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), spark.createDataFrame(rows[:1], "vec_id bigint, embedding array<double>"), k=2)
    want = [sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(rows[0][1], rows[i][1], strict=True)) for i in (7, 6)]
    assert [(r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(7, want[0]), (6, want[1])]


# --- embedding near-duplicates


def brute_links(rows, threshold=0.93):
    use = [k for k, (i, v, label, *_) in enumerate(rows) if i is not None and label is not None and good(v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for x in use:
        for y in use:
            a, b = rows[x][1], rows[y][1]
            if x != y and rows[x][2] == rows[y][2] and len(a) == len(b):
                cos = np.dot(a, b) / math.sqrt(np.dot(a, a)) / math.sqrt(np.dot(b, b))
                if cos >= threshold:
                    links[x].add(y)
    out = []
    for k, r in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        component = min(rows[n][0] for n in seen) if r[0] is not None else None
        out.append((r[0], len(links[k]), component, r[0] == component))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("entry", "block"), [(2048, 4096), (2048, 5), (8, 7)])
def test_embedding_groups(spark, monkeypatch, entry, block):
    monkeypatch.setattr(embdup, "PER_ENTRY", entry)
    monkeypatch.setattr(embdup, "BLOCK", block)
    rows, df = vectors(spark)
    got = embdup.embedding_duplicates(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_links(rows)
    assert embdup.embedding_duplicates(df.filter("vec_id < 0")).count() == 0


def test_recall_of_the_index():
    """With a grid of many cells, the cells visited hold nearly all partners placed at the threshold."""
    rng = np.random.default_rng(6)
    x = embdup._unit(rng.standard_normal((4000, 32)))
    index = embdup.MultiIndex(x[:2000], 12, 0.93)
    assert 1 <= index.visits < 144
    probe = x[2000:]
    noise = rng.standard_normal(probe.shape)
    noise = embdup._unit(noise - (noise * probe).sum(axis=1)[:, None] * probe)
    other = 0.93 * probe + math.sqrt(1 - 0.93**2) * noise
    a, b = index.nearest(probe, index.visits), index.nearest(other, index.visits)
    found = (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)
    assert found.mean() >= 0.98


def test_traversal_order_is_by_distance():
    rng = np.random.default_rng(7)
    x = embdup._unit(rng.standard_normal((50, 10)))
    index = embdup.MultiIndex(x, 5, 0.93)
    d1, d2 = index.distances(x)
    for r, cells in enumerate(index.nearest(x, 25)):
        d = d1[r][cells // 5] + d2[r][cells % 5]
        assert len(set(cells.tolist())) == 25 and (np.diff(d) >= -1e-12).all()


# --- chat


def test_escaping_round_trip():
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choice(["<", "|", "\\", "n", "\n", "<|im_end|>", "<|im_start|>", "a", "😀", ""]) for _ in range(12))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        rows = [(text, text), ("assistant", text), ("user", "")]
        assert list(chat.parse(chat.chat_template(rows))) == rows


def test_spans_hold_the_texts_of_an_unknown_template():
    def template(turns):
        return "<s>" + "".join(f"[{i}:{r}]{t}[/{r}]" for i, (r, t) in enumerate(turns))

    rows = [("user", "ab"), ("assistant", "[/assistant]a"), ("assistant", ""), ("user", "b"), ("assistant", "bb")]
    out, spans = chat.render_spans(rows, template, lambda role: role == "assistant")
    assert "".join([out[: spans[0][0]], *(out[a:b] for a, b, *_ in spans)]) == out
    assert [out[c:d] for (_, _, c, d), (r, _) in zip(spans, rows, strict=True) if r == "assistant"] == ["[/assistant]a", "", "bb"]


def test_rewritten_history_is_detected():
    def template(turns):  # shows the thoughts of the last turn only
        return "".join(f"({r}){t if i == len(turns) - 1 else t.split('#')[-1]}\n" for i, (r, t) in enumerate(turns))

    rows = [("user", "hi"), ("assistant", "think#say"), ("user", "more"), ("assistant", "end")]
    out, spans = chat.render_spans(rows, template, lambda role: role == "assistant")
    assert spans[:3] == [None] * 3 and spans[3] is not None and out == template(rows)


def test_any_template_on_spark(spark):
    """A template that hides earlier thoughts rewrites history; one that numbers its turns does not."""
    def hiding(turns):
        return "".join(f"({r}){t if i == len(turns) - 1 else t.split('#')[-1]}\n" for i, (r, t) in enumerate(turns))

    def numbering(turns):
        return "".join(f"[{i}:{r}]{t}\n" for i, (r, t) in enumerate(turns))

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "think#say"), (1, 2, "user", "more"), (1, 3, "assistant", "end"), (2, 0, "user", "a"), (2, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.format_conversations(df, hiding).collect()}
    assert (got[1].rewritten, got[2].rewritten) == (True, False)
    assert [got[1].formatted[x.begin : x.stop] for x in got[1].loss] == ["end"] and [got[2].formatted[x.begin : x.stop] for x in got[2].loss] == ["b"]
    got = {r.conv_id: r for r in chat.format_conversations(df, numbering).collect()}
    assert not got[1].rewritten and [got[1].formatted[x.begin : x.stop] for x in got[1].loss] == ["think#say", "end"]


def test_long_conversations_take_linear_work():
    rows = [("assistant" if i % 2 else "user", f"t{i}") for i in range(40_000)]
    out, spans = chat.render_spans(rows, chat.chat_template, lambda role: role == "assistant", True)
    assert out == chat.chat_template(rows) and all(out[c:d] == t for (_, _, c, d), (r, t) in zip(spans, rows, strict=True) if r == "assistant")
    few = rows[:60]
    assert chat.render_spans(few, chat.chat_template, lambda role: True, True) == chat.render_spans(few, chat.chat_template, lambda role: True)


def test_conversations(spark):
    turns = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a\\n"), (2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", None)]
    turns += [(None, 5, "assistant", "lost"), (-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE), (3, None, "assistant", "first"), (3, 0, "a\nb", "x" * 9000)]
    turns += [(4, i, "assistant" if i % 2 else "user", f"text {i} " * 30) for i in range(300)]
    df = spark.createDataFrame([(*t, "own") for t in turns], "conv_id bigint, turn bigint, role string, text string, formatted string").repartition(5)
    want = []
    for c in {t[0] for t in turns}:
        rows = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = [(r or "", t or "") for _, _, r, t in rows]
        lost = "".join(t for r, t in said if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((c, len(rows), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(lost), sha(lost), len(chat.chat_template(said))))
    assert sorted(map(tuple, chat.format_digests(df).collect()), key=repr) == sorted(want, key=repr)
    for r in chat.format_conversations(df).collect():
        assert not r.rewritten and all("<|" not in r.formatted[x.begin : x.stop] for x in r.loss)
    assert chat.format_digests(df.filter("conv_id > 99")).count() == 0


# --- packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    t.encode_special_tokens = True
    return t


def test_pieces_encode_like_the_library(library):
    rng, table = random.Random(9), packing.piece_table(tokenizer_file())
    parts = ["a", " ", "  ", "\n", "\n\n", "'s", "é", "²", " ", "\x1c", "!", "中文", "😀", "the ", "\t", "<|endoftext|>", "'", "12"]
    texts = ["".join(rng.choice([*parts, chr(rng.randrange(1, 0xD800))]) for _ in range(rng.randrange(30))) for _ in range(800)]
    for text, got in zip(texts, table.encode(texts), strict=True):
        assert np.frombuffer(got, table.kind).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], repr(text)


def test_pieces_are_merged_when_first_looked_up(library, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 2)
    table, asked = packing.Pieces(tokenizer_file()), []
    assert np.frombuffer(table[" hello"], table.kind).tolist() == library.encode(" hello", add_special_tokens=False).ids
    merged = table.merged
    monkeypatch.setattr(table, "merged", lambda piece: asked.append(piece) or merged(piece))
    for text in ("one two three two", "one four"):
        got = table.encode([text])[0]
        assert np.frombuffer(got, table.kind).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]
    assert asked == ["one", " two", " three", " four"]
    assert set(table) == {"one", " four"} and set(table.older) == {" hello", "one", " two", " three"}


def check_pieces(rows, got, library):
    ids = {}
    for d, text in rows:
        ids.setdefault(d, []).append(np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    by_doc, by_sequence = {}, {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        for x in ids[d]:
            n = len(ids[d])
            own = sorted((p for p in pieces if p.doc_tokens == len(x)), key=lambda p: p.start)
            assert sum(p.length for p in own) >= len(x)
            if n == 1:
                assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own[:-1]]]).tolist()
                assert all(zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, pieces in by_sequence.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or s == len(by_sequence) - 1
    assert sum(p.length for p in got) == sum(len(x) for every in ids.values() for x in every)


@pytest.mark.parametrize(("quantum", "window"), [(512, 4), (64, 1), (8, 2), (1024, 64)])
def test_packing(spark, data, messy, nothing, library, monkeypatch, quantum, window):
    monkeypatch.setattr(packing, "QUANTUM", quantum)
    monkeypatch.setattr(packing, "WINDOW_SEQUENCES", window)
    for df in (messy, spark.read.parquet(f"{data}/documents.parquet").repartition(5)):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        check_pieces(rows, packing.pack(df, tokenizer_file()).collect(), library)
    assert packing.pack(nothing, tokenizer_file()).count() == 0


def test_every_window_holds_the_mixture(spark, data):
    """Full windows differ by a quantum or two per source, and sources keep their shares over all of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack(docs, tokenizer_file()).selectExpr("source", "length", f"sequence_id div {packing.WINDOW_SEQUENCES} as w").groupBy("w").pivot("source").sum("length").orderBy("w").collect()
    whole = np.array([[x or 0 for x in r[1:]] for r in got[:-2]])
    assert (whole.sum(axis=1) == 1024 * packing.WINDOW_SEQUENCES).all()
    assert (whole.max(axis=0) - whole.min(axis=0) <= 3 * packing.QUANTUM).all()


def packed_sizes(spark, library, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = packing.pack(df, tokenizer_file()).collect()
    check_pieces([(d, t) for d, t, _ in rows], got, library)
    return got


def test_small_sources_keep_their_documents_whole(spark, library):
    """Many equal sources of less than a quantum: pieces are documents, cut at sequence ends only."""
    rows = [(d, "alpha " * 150, f"s{d}") for d in range(300)]
    got = packed_sizes(spark, library, rows)
    assert len(got) <= 300 + sum(p.length for p in got) // 1024 + 1


@pytest.mark.parametrize(("few", "words"), [(40, 2000), (2, 1100)])
def test_middling_sources_are_spread(spark, library, monkeypatch, few, words):
    """Sources with less than a quantum a window are served over the whole stream, be there enough of them for a queue or not."""
    monkeypatch.setattr(packing, "QUANTUM", 128)
    monkeypatch.setattr(packing, "WINDOW_SEQUENCES", 1)
    rows = [(d, "one two three four five six seven " * 700, "large") for d in range(60)]
    rows += [(100 + d, "alpha " * words, None if d == 0 else f"s{d}") for d in range(few)]
    got = packed_sizes(spark, library, rows)
    every = sum(p.length for p in got)
    for s in {p.source for p in got} - {"large"}:
        served = sorted((p.sequence_id * 1024 + p.offset, p.length) for p in got if p.source == s)
        places = np.array([at + i for at, n in served for i in range(n)])
        ideal = (np.arange(len(places)) + 0.5) * every / len(places)
        quanta = len(places) // 128
        assert np.abs(places - ideal).max() <= 8 * every / quanta + 2 * 1024, s


def test_schedule_places_every_token_once():
    rng = random.Random(10)
    for k in range(200):
        totals = [rng.randrange(1, 3000) for _ in range(rng.randrange(1, 7))]
        window = rng.choice([50, 100, 640])
        weights = [rng.randrange(1, 9) for _ in totals] if k % 2 else None
        schedule, met = packing.Schedule(totals, window, weights), set()
        for s, n in enumerate(totals):
            t = 0
            while t < n:
                place, free = schedule.place(s, t)
                assert free > 0
                met.update(range(place, place + min(free, n - t)))
                t += min(free, n - t)
        assert met == set(range(sum(totals)))
        if weights:  # as long as all queues last, each window holds them by their weights
            first = min(n * sum(weights) // (w * window) for n, w in zip(totals, weights, strict=True)) - 1
            for s, w in enumerate(weights):
                share = sum(schedule.place(s, t)[0] < first * window for t in range(totals[s]))
                assert abs(share - first * window * w / sum(weights)) <= 1 or first <= 0
