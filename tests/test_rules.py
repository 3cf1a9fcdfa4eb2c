import json

from pyspark.sql import functions as F

from fpindex.constants import ALGOS
from fpindex.operators.rules import (
    Rule,
    cap_marks,
    collect_rules,
    evaluate_rules,
    match_rules,
    process_rule,
    rule_totals,
)
from fpindex.sources.rules import read_rules, read_string_list, validate_rules

FILES = "fileid long, path string, owner string, mtime long"
STATE = "file_id long, updated_at long, pending_mode string"


def matched(spark, rules, path, owner="alice"):
    df = spark.createDataFrame([(path, owner)], "path string, owner string")
    return match_rules(df, rules).first()["rule_id"]


def test_disabled_rules_are_passed_over(spark):
    rules = [Rule("a", "**/*.jpg", enabled=False), Rule("b", "**/*.pdf"), Rule("c", "**/*.pdf")]
    assert matched(spark, rules, "/alice/files/x.pdf") == "b"
    assert matched(spark, rules, "/alice/files/x.jpg") is None
    assert matched(spark, rules, "/alice/files/x.txt") is None
    assert matched(spark, [], "/x") is None


def test_scopes(spark):
    bob = [Rule("r", "**", user_scope="bob")]
    assert matched(spark, bob, "/x", "alice") is None
    assert matched(spark, bob, "/x", "bob") == "r"
    assert matched(spark, bob, "/x", None) == "r"
    assert matched(spark, [Rule("r", "/")], "/x") == "r"


def test_many_rules_need_no_join(spark):
    rules = [Rule(f"r{i}", f"/dir{i}/*") for i in range(500)] + [Rule("rest")]
    df = spark.range(1000).select(F.concat(F.lit("/dir"), F.col("id"), F.lit("/x")).alias("path"))
    found = match_rules(df, rules, owner=None)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        i = int(r["path"][4:-2])
        assert r["rule_id"] == (f"r{i}" if i < 500 else "rest")


def test_first_rule_owns_a_file_once(spark, rows):
    files = spark.createDataFrame([(1, "/a", "u", 10), (2, "/a", "u", 10), (3, "/a", "u", 10)], FILES)
    state = spark.createDataFrame([(1, 5, None), (2, 10, None)], STATE)
    rules = [Rule("first", "**", mode="missing"), Rule("second", "**")]
    evaluated = evaluate_rules(files, rules, state)
    assert rows(evaluated) == [
        (1, "first", "missing", True),
        (2, "first", "missing", False),
        (3, "first", "missing", True),
    ]
    assert rows(rule_totals(evaluated)) == [("first", 3, 2)]
    assert process_rule(files, rules, state, "second").count() == 0


def test_cap_marks_at_most_so_many_per_rule(spark):
    files = spark.range(150).select(
        F.col("id").alias("fileid"), F.lit("/a").alias("path"), F.lit("u").alias("owner"),
        F.lit(10).cast("long").alias("mtime"),
    )
    state = spark.createDataFrame([], STATE)
    evaluated = evaluate_rules(files, [Rule("r")], state)
    assert evaluated.filter("stale").count() == 150
    assert sorted(r["file_id"] for r in cap_marks(evaluated, 100).collect()) == list(range(100))


def test_read_rules(spark):
    setting = [
        {"id": "a", "enabled": True, "mode": "force", "algos": ["md5", "nope"], "path": "x/*", "userScope": "bob"},
        {"id": "b", "enabled": 0},
        {"id": "c", "enabled": 1, "path": ""},
    ]
    df = spark.createDataFrame([(json.dumps(setting),)], "json string")
    rules = collect_rules(read_rules(df))
    assert rules == [
        Rule("a", "x/*", "bob", "force", ("md5", "nope"), True),
        Rule("b", "**", "all", "auto", ALGOS, False),
        Rule("c", "**", "all", "auto", ALGOS, True),
    ]
    checked = validate_rules(read_rules(df)).orderBy("priority").collect()
    assert [(r["algos"], r["valid"]) for r in checked] == [(["md5"], True), (["sha1"], True), (["sha1"], True)]
    for text in ("[{", "{}", "", None, "[]", '"x"', "[1"):
        broken = spark.createDataFrame([(text,)], "json string")
        assert read_rules(broken).count() == 0


def test_string_lists(spark):
    def listed(text):
        df = spark.createDataFrame([(text,)], "json string")
        return df.select(read_string_list(F.col("json")).alias("x")).first()["x"]

    assert listed('["a","",7,null,{"x":1},"b"]') == ["a", "b"]
    assert listed("[broken") == []
    assert listed(None) == []
