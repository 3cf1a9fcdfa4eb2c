import fnmatch
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fpindex.functions.globs import glob_match, glob_prefix, glob_to_regex

CASES = [
    ("*.txt", "readme.txt", True),
    ("dir/*.txt", "dir/readme.txt", True),
    ("**/*.txt", "a/b/c/readme.txt", True),
    ("*.txt", "readme.md", False),
    ("dir/*.txt", "other/readme.txt", False),
    ("file?.txt", "file1.txt", True),
    ("file?.txt", "file10.txt", False),
    ("file?.txt", "file.txt", False),
    ("file[abc].txt", "filea.txt", True),
    ("file[abc].txt", "filed.txt", False),
    ("Read.txt", "read.txt", False),
    ("read.txt", "read.txt", True),
    ("*", "a/b", True),
    ("**/*.pdf", "a.pdf", False),
    ("[!a]*", "bcd", True),
    ("[!a]*", "abc", False),
    (r"\*x", "*x", True),
    (r"\*x", "yx", False),
    ("a[b", "a[b", True),
    ("[]]x", "]x", True),
    ("[a-c]?", "b/", True),
    ("[[:digit:]]*", "7x", True),
    ("a*c", "ac", True),
    ("ab*bc", "abc", False),
    ("a.b", "axb", False),
    ("*b*", "abc", True),
    ("a\nb*", "a\nb\nc", True),
    ("?", "\n", True),
    ("", "", True),
    ("", "a", False),
    ("100%_*", "100%_x", True),
    ("100%_*", "100xxx", False),
]


def test_cases_on_spark(spark):
    globs = sorted({g for g, _, _ in CASES})
    df = spark.createDataFrame([(p,) for p in sorted({p for _, p, _ in CASES})], "p string")
    found = {
        (g, r["p"]): r[f"g{i}"]
        for r in df.select("p", *[glob_match(F.col("p"), g).alias(f"g{i}") for i, g in enumerate(globs)]).collect()
        for i, g in enumerate(globs)
    }
    wrong = [(g, p, e) for g, p, e in CASES if found[g, p] != e]
    assert not wrong


@pytest.mark.parametrize("glob, path, expected", CASES)
def test_cases_of_the_regex(glob, path, expected):
    assert (re.search(glob_to_regex(glob), path) is not None) is expected


@settings(max_examples=300, deadline=None)
@given(st.text("ab*?/.x-", max_size=8), st.text("ab/.x-", max_size=8))
def test_like_the_standard_library(glob, path):
    assert (re.search(glob_to_regex(glob), path) is not None) == fnmatch.fnmatchcase(path, glob)


def test_random_globs_on_spark(spark):
    import random

    random.seed(7)
    globs = ["".join(random.choices("ab*?/[!]c", k=random.randint(0, 6))) for _ in range(60)]
    paths = sorted({"".join(random.choices("abc/[]!", k=random.randint(0, 6))) for _ in range(80)})
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for row in df.select(
        "p", *[glob_match(F.col("p"), g).alias(f"g{i}") for i, g in enumerate(globs)]
    ).collect():
        for i, g in enumerate(globs):
            assert row[f"g{i}"] == (re.search(glob_to_regex(g), row["p"]) is not None), (g, row["p"])


def test_prefix_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.createDataFrame([("files/en/a_b.txt",)], "path string").write.parquet(path)
    df = spark.read.parquet(path).filter(glob_match(F.col("path"), "files/en/[a-c]?b.*"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,files/en/)" in plan
    assert df.count() == 1
    assert glob_prefix("files/en/*") == "files/en/" and glob_prefix("*x") == ""


def test_globs_in_columns_agree_with_the_expressions():
    import random

    import pyarrow as pa

    from fpindex.functions.sql import match_globs

    rng = random.Random(1)
    tokens = ["a", "/", "*", "?", "**/", "[ab]", "[!a]", "[]", "x.pdf", "\n", "é", "[[:alpha:]]", "\\*", "[z-a]", "]", "[^]]"]
    some = ["".join(rng.choice(tokens) for _ in range(rng.randrange(5))) for _ in range(200)]
    paths = ["".join(rng.choice(["a", "b", "/", "x.pdf", "\n", "é", "*", "]"]) for _ in range(rng.randrange(6))) for _ in range(2000)]
    paths, asked = [*paths, None, None], [*(rng.choice([*some, None]) for _ in paths), "*", None]
    found = match_globs(pa.array(paths, pa.string()), pa.array(asked, pa.string())).to_pylist()
    for path, glob, hit in zip(paths, asked, found):
        assert hit == (None if path is None or glob is None else re.search(glob_to_regex(glob), path) is not None)
    assert len(match_globs(pa.array([], pa.string()), pa.array([], pa.string()))) == 0
