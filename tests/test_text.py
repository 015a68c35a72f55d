import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import classify, rules, text


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("content", ["", "a", "a\n", "\n\n", "a\r\nb\nc"])
def test_lines_and_count(spark, content):
    got = one(spark, text.lines(F.lit(content)))
    assert got == re.split(r"\r?\n", content)
    assert one(spark, text.line_count(F.lit(content))) == (0 if content == "" else len(got))


def test_hits_give_the_line_of_each_match(spark):
    content = "x=1\ny=22\n\nz=3 w=4\n"
    got = one(spark, text.hits(F.lit(content), r"(?m)\w=\d+"))
    expected = [(content[: m.start()].count("\n") + 1, m[0]) for m in re.finditer(r"(?m)\w=\d+", content)]
    assert [(r["line"], r["hit"]) for r in got] == expected
    assert one(spark, text.hits(F.lit("none"), "q")) == []


def test_redact(spark):
    said = "Authorization: Bearer abc.def password=hunter2hunter eyJaaaaaaaaaaaa.bbbbbbbbbbbb.cccccccccccc"
    got = one(spark, text.redact(F.lit(said)))
    assert "hunter2" not in got and "abc.def" not in got and got.count("[REDACTED]") == 3


def test_function_window_stops_at_braces(spark):
    code = ["top", "function f() {", "  a", "  b", "}", "after"]
    rows = spark.createDataFrame([(code,)], "l array<string>")
    got = rows.select(text.function_window(F.col("l"), F.lit(2), 5).alias("x")).first()["x"]
    assert got == "\n".join(code[1:5])


def test_fingerprint_ignores_noise_words_and_close_lines(spark):
    rows = spark.createDataFrame([("s", "r", "./a.ts", 12, "SQL candidate"), ("s", "r", "a.ts", 14, "sql"), ("s", "r", "a.ts", 15, "sql")], "scanner string, rule_id string, path string, start_line int, title string")
    a, b, c = [r[0] for r in rows.select(text.result_fingerprint()).collect()]
    assert a == b != c and len(a) == 16


def test_null_parts_are_empty_in_hashes(spark):
    assert one(spark, text.short_hash(F.lit("a"), F.lit(None), F.lit("b"))) == one(spark, F.substring(F.sha2(F.lit("a||b"), 256), 1, 16))


@pytest.mark.parametrize(
    "path,role", [("package-lock.json", "dependency"), ("node_modules/a.js", "generated"), ("src/a.test.ts", "test"), (".github/workflows/ci.yml", "ci"), ("docs/x.ts", "docs"), ("examples/a.py", "fixture"), ("web/app.ts", "client"), ("src/routes/a.ts", "server-runtime"), ("lib/x.rb", "unknown"), ("", "unknown")]
)
def test_file_role(spark, path, role):
    assert one(spark, classify.file_role(F.lit(path))) == role


@pytest.mark.parametrize("path,first,lang", [("a.py", "", "python"), ("a.TSX", "", "typescript"), ("run", "#!/usr/bin/env node", "javascript"), ("run", "#!/bin/bash", "shell"), ("run", "x", "unknown"), (".bashrc", "", "unknown")])
def test_language(spark, path, first, lang):
    assert one(spark, classify.language(F.lit(path), F.lit(first))) == lang


def test_state_machine(spark):
    state = lambda s, c, v: one(spark, classify.finding_state(F.lit(s), F.lit(c), F.lit(v)))
    assert state("confirmed", "high", "low") == "confirmed_true_positive"
    assert state("suspected", "high", "critical") == "likely_true_positive"
    assert state("suspected", "low", "high") == "needs_context"
    assert state("needs_dynamic_test", "high", "high") == "security_hotspot"
    assert state("false_positive", "high", "high") == "false_positive"


def test_error_kinds(spark):
    kind = lambda m: one(spark, classify.error_kind(F.lit(m)))
    assert [kind(m) for m in ("401 Unauthorized", "credit balance is too low", "HTTP 429", "503", "invalid json", "odd")] == ["authentication", "billing", "rate_limit", "server", "invalid_request", "unknown"]


def test_every_rule_compiles_in_the_jvm(spark):
    patterns = [f"(?im){r[5]}" for r in rules.DEFAULT_RULES] + [r[4] for r in rules.CONFIG_RULES] + [r[3] for r in rules.SINKS + rules.LITE_SINKS + rules.ROUTES] + [rules.SOURCE, rules.SANITIZER]
    assert len({r[0] for r in rules.DEFAULT_RULES}) == 58
    spark.range(1).select(*[text.matches(F.lit("x"), p).alias(str(i)) for i, p in enumerate(patterns)]).collect()


def test_title_overlap(spark):
    assert one(spark, text.title_overlap(F.lit("Open Redirect in login"), F.lit("open-redirect login form"))) == pytest.approx(1.0)
    assert one(spark, text.title_overlap(F.lit("a b"), F.lit("open"))) == 0


def test_mounted_path(spark):
    got = [one(spark, text.mounted_path(F.lit(p))) for p in ("/src/a.ts", "../../src/b.ts", "/repo/c.ts", "d\\e.ts")]
    assert got == ["a.ts", "b.ts", "c.ts", "d/e.ts"]


def test_hits_of_groups_across_lines_and_marks(spark):
    body = "a x=1\nb\nx=22 x=3\n\ufdd0 x=\n4"
    df = spark.createDataFrame([(body,), (None,), ("",), ("none",)], "t string")
    got = [[(h["line"], h["hit"]) for h in r["h"]] for r in df.select(text.hits(F.col("t"), r"x=\s*(\d+)", 1).alias("h")).collect()]
    assert got == [[(1, "1"), (3, "22"), (3, "3"), (4, "4")], [], [], []]
    whole = df.select(text.hits(F.col("t"), r"(?m)^.*x=\s*\d").alias("h")).first()["h"]
    assert [(h["line"], h["hit"]) for h in whole] == [(1, "a x=1"), (3, "x=22 x=3"), (4, "\ufffd x=\n4")]


def test_plain_text_guard_never_hides_a_match(spark):
    from pyspark.sql import functions as F

    from siltstone.functions.text import may_match, required_literals
    from siltstone.sources.files import IMPORTS, ROUTES

    texts = ["import x from 'y'", "from a.b import c", "require_relative './q'", "use A\\B;", "APP.Get('/x')", "@App.Route('/x', methods=['GET'", "@GetMapping('/x')", "  get '/x' do", "Route::any('/x')", "plain", "", "İMPORT ſ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.lower("t"))
    patterns = [*IMPORTS, *(r[3] for r in ROUTES)]
    rows = df.select(*[F.struct(F.rlike("t", F.lit(p)), may_match(F.col("t"), F.col("low"), p)).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    pairs = [tuple(v) for r in rows for v in r]
    assert (True, False) not in pairs and (True, True) in pairs and (False, False) in pairs
    # A text that holds another one of the list is left out; case stays where it is asked for.
    assert required_literals("(exec|execSync)") == ["exec"] and required_literals("a(Foo|Bar)", False) == ["Bar", "Foo"]


def test_slugs_and_names_work_each_text_out_once(spark):
    """A condition and its branch each ran the patterns before."""
    rows = [(" --A_b  C-", "a-b-c", "A_b-C"), ("", "none", "codebase"), (None, "none", "codebase"), ("-- \n", "none", "codebase"), ("É.x\n", "x", ".x"), ("--a--", "a", "a")]
    df = spark.createDataFrame([(t,) for t, _, _ in rows], "t string").select(text.slug(F.col("t"), "none").alias("s"), text.safe_name(F.col("t")).alias("n"))
    assert [tuple(r) for r in df.collect()] == [r[1:] for r in rows]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 2, plan
