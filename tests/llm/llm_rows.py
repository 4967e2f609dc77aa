import pytest

WORDS = "red orange yellow green blue indigo violet black white grey brown pink".split()


def sentence(seed: int, n: int) -> str:
    """n words that hardly repeat in order."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 97))
    return " ".join(out)


def messy_rows():
    """Documents with copies, near copies, shared passages, and every odd case: (doc_id, text, lang, source)."""
    base, other, passage = sentence(1, 120), sentence(2, 90), sentence(3, 60)
    changed = base.split()
    changed[50] = "changed"
    rows = [
        (7, base, "en", "a"), (3, base, "en", "b"), (9, " ".join(changed), "en", "a"), (4, other, "fr", "a"),
        (11, sentence(4, 40) + "\n" + passage + "\n" + sentence(5, 10), "en", "a"), (12, passage + " " + sentence(6, 15), "de", None),
        (20, None, "en", "a"), (21, "", "en", "c"), (22, " \t\n ", None, "a"), (23, "one", "en", "a"), (24, "One two", "en", "a"),
        (25, "one TWO", "en", "a"), (30, "é ß 中文 <|endoftext|>  x", "en", "a"), (31, "word " * 500, "en", "a"),
        (32, "x" * 30000, "en", "a"), (40, other, "fr", "a"), (40, other, "fr", "a"), (None, sentence(8, 30), "en", "a"),
        (41, "gnu general public license gnu general public license, MIT License", "en", "a"),
        (42, sentence(9, 4000), "en", "a"),
    ]
    return rows + [(100 + i, sentence(50 + i, 35), "en" if i % 2 else "de", f"s{i % 3}") for i in range(20)]


SCHEMA = "doc_id bigint, text string, lang string, source string"
#: Names that operators use inside or for results.
CLASH = ("key", "ids", "h", "n", "part", "_block", "rep", "label", "kept", "n_words", "factors", "language", "start")


@pytest.fixture(scope="session")
def messy(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy_rows(), SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH}).repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.filter("doc_id < -5")
