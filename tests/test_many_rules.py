import random
import re

import pytest
from pyspark.sql import functions as F

from fpindex.functions.globs import glob_parts, glob_to_regex
from fpindex.operators import rules as ruling
from fpindex.operators.many_rules import first_of_many
from fpindex.operators.rules import Rule, first_rule, match_rules

WORDS = ["a", "bb", "ab", "files", "x.pdf", "report", "2024", "é", "deep/er", ".txt"]


def random_glob(rng):
    return "".join(rng.choice([*WORDS, "*", "?", "/", "[ab]", "**/", "[!x]", "\\*"]) for _ in range(rng.randrange(1, 6)))


def random_paths(rng, n):
    return [(i, "/".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 6))), rng.choice(["u", "v", None])) for i in range(n)]


def plain_first(rules, path, owner):
    for i, (rule, pattern) in enumerate(rules):
        scoped = rule.user_scope == "all" or owner is None or owner == rule.user_scope
        if rule.enabled and scoped and pattern.match(path):
            return i
    return None


def test_parts_of_globs_agree_with_the_whole():
    rng = random.Random(3)
    paths = [p for _, p, _ in random_paths(rng, 200)] + ["", "a", "*", "ab", "a*b"]
    for glob in [random_glob(rng) for _ in range(400)] + ["", "a", "*", "a*a", "*a*", "a*b*", "ab*b"]:
        parts, pattern = glob_parts(glob), re.compile(glob_to_regex(glob))
        for path in paths:
            loose = (
                path.startswith(parts.head) and path.endswith(parts.tail)
                and len(path) >= parts.least and (parts.inner is None or parts.inner in path)
            )
            assert loose or not pattern.match(path), (glob, path)
            if parts.plain:
                assert loose == bool(pattern.match(path)), (glob, path)


@pytest.mark.parametrize("n", [1, 40, 300])
def test_the_table_agrees_with_the_chain(spark, n):
    rng = random.Random(n)
    rules = [
        Rule(f"r{i}", random_glob(rng), rng.choice(["all", "u"]), enabled=rng.random() < 0.9) for i in range(n)
    ]
    files = spark.createDataFrame(random_paths(rng, 300) + [(999, None, "u")], "fileid long, path string, owner string")
    for owner in ("owner", None):
        looked_up = first_of_many(files, rules, owner=owner).select("fileid", "rule_priority")
        chained = files.select("fileid", first_rule(rules, F.col("path"), None if owner is None else F.col(owner)).alias("rule_priority"))
        assert sorted(map(tuple, looked_up.collect())) == sorted(map(tuple, chained.collect()))
    assert first_of_many(files, [Rule("off", enabled=False)]).filter("rule_priority IS NOT NULL").count() == 0


def test_ten_thousand_rules(spark):
    rng = random.Random(8)
    rules = [Rule(f"r{i}", rng.choice([f"files/d{i}/*", f"*/n{i}.pdf", f"files/d{i % 90}/*.t{i}", f"*_{i}_*"]), rng.choice(["all", "u"])) for i in range(10_000)]
    paths = [(i, f"files/d{rng.randrange(12_000)}/n{rng.randrange(12_000)}.pdf", "v") for i in range(2000)]
    paths += [(9000 + i, f"other/x_{i * 7}_y", "u") for i in range(50)]
    files = spark.createDataFrame(paths, "fileid long, path string, owner string")
    matched = match_rules(files, rules)
    plan = matched._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 10 and len(rules) > ruling.MOST_BRANCHES
    compiled = [(r, re.compile(glob_to_regex(r.glob))) for r in rules]
    got = {r.fileid: (r.rule_priority, r.rule_id) for r in matched.collect()}
    for i, path, owner in rng.sample(paths, 150):
        first = plain_first(compiled, path, owner)
        assert got[i] == (first, None if first is None else f"r{first}")
