import pytest

CLASHING = ["id", "text_key", "score", "kept", "start", "part", "block", "host", "hashes", "n", "pieces", "_id", "_turn"]

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix old potions in deep caves".split()


def long_text(n):
    return " ".join(WORDS[(i * i + i // 7) % len(WORDS)] + str(i % 97) for i in range(n))


@pytest.fixture
def hard_docs(spark):
    """Nulls, empty and blank texts, a very long one, copies, repeated ids and rows, clashing columns."""
    base = long_text(60)
    near = base.replace(base.split()[0], "changed", 1)
    rows = [
        (1, base), (2, base), (3, near), (3, near), (4, None), (5, ""), (6, " \n\t "),
        (7, long_text(30_000)), (8, "one two"), (9, "ONE  two"), (10, "été ▁ 日本語 \U0001f600 |||"),
        (None, base.replace(base.split()[5], "other", 1)), (None, "other words entirely for a row that has no id at all"), (11, "12 34 !!"),
        (8, "another text under an id that is there already, long enough to differ"),
    ]
    extra = "".join(f", {c} string" for c in CLASHING)
    table = [(i, t, "en" if t and i != 10 else None, "src1", len(t or ""), *["x"] * len(CLASHING)) for i, t in rows]
    return spark.createDataFrame(table, f"doc_id long, text string, lang string, source string, n_chars long{extra}")


@pytest.fixture
def no_docs(hard_docs):
    return hard_docs.filter("false")


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
