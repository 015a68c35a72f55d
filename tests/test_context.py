import json

import pytest
from pyspark.sql import functions as F
from test_detectors import code

from siltstone.functions import text
from siltstone.operators import context
from siltstone.plans import scan
from siltstone.schemas import RESULTS
from siltstone.sources.files import ProjectConfig, parse_config


@pytest.fixture(scope="module")
def files(spark):
    body = "import x from 'y';\n" + "function one() {}\n" * 3 + "pad\n" * 200 + "app.get('/far', f);\nfunction two() { password = 'abcdefgh'; }\n"
    return code(spark, {"src/a.ts": body, ".env": "SECRET=abc", "views/home.ejs": "<%= x %>", "views/dead.ejs": "", "src/r.ts": "app.get('/', (req, res) => {\n  res.render('home', req.query);\n});\n"}).cache()


@pytest.fixture(scope="module")
def results(spark):
    rows = [("semgrep", "r1", "t", "xss", "high", "src/a.ts", 2, 2, "m", None, 0), ("bearer", "r2", "t", "xss", "high", "src/a.ts", 206, 206, "m", None, 1), ("semgrep", "r3", "t", "xss", "high", ".env", 1, 1, "m", None, 2)]
    return spark.createDataFrame(rows, RESULTS)


def test_snippets_and_neighbours(files, results):
    s = {r["ord"]: r for r in context.snippets(results, files).collect()}
    assert (s[0]["start_line"], s[0]["end_line"]) == (1, 27) and s[2]["content"].startswith("[REDACTED ENV")
    assert "abcdefgh" not in s[1]["content"]
    names = {(r["ord"], r["name"]) for r in context.near_symbols(results, files).collect()}
    assert (0, "one") in names and (0, "two") not in names and (1, "two") in names
    assert {r["ord"] for r in context.near_routes(results, files).collect()} == {1}
    assert {r["ord"]: r["scanners"] for r in context.silent_scanners(results, results).collect()}[0] == ["custom-rules", "taint-lite", "config-checks"]
    assert len({r["ord"]: r["related"] for r in context.related(results, results).collect()}[0]) == 2


def test_packs_fit_their_budget(files, results):
    packs = {r["ord"]: r["pack"] for r in context.context_packs(results, files, results, 5000).collect()}
    assert set(packs) == {0, 1, 2} and all(json.loads(p)["result"]["rule_id"] for p in packs.values())
    ranges = context.given_ranges(context.snippets(results, files))
    assert ranges.count() == 3


def test_requested_context(spark, files):
    asked = spark.createDataFrame([("file", "/src/r.ts", 0), ("file", "gone.ts", 1), ("symbol", "two", 2), ("symbol", "nothing", 3), ("symbol", "two", 4)], "kind string, query string, ord int")
    found, missing = context.requested_context(asked, files)
    got = {(r["kind"], r["path"]): r for r in found.collect()}
    assert set(got) == {("file", "src/r.ts"), ("symbol", "src/a.ts")} and got["file", "src/r.ts"]["content"].startswith("1: app.get")
    assert {r["query"] for r in missing.collect()} == {"gone.ts", "nothing"}
    assert context.requested_context(asked, files, 10)[0].agg(F.sum(F.length("content"))).first()[0] == 10


def test_inventory_and_templates(files):
    kinds = {(r["kind"], r["category"]) for r in context.inventory(files).where("path = 'src/r.ts'").collect()}
    assert ("boundary", None) in kinds
    said = {r["path"]: r["summary"] for r in context.inventory_summary(files).collect()}
    assert said["src/r.ts"].startswith("entrypoints=1 trustBoundaries=1") and "sinks=none" in said["views/dead.ejs"]
    live = context.rendered_templates(files.where("path LIKE 'views/%'"), files)
    assert [r["path"] for r in live.collect()] == ["views/home.ejs"]


def test_settings_and_strategy():
    assert context.settings({"AUDIT_MAX_FILE_SIZE": "10", "AUDIT_AI_AUDIT": "false"})["max_file_size"] == 10
    assert context.settings({"AUDIT_AI_AUDIT": "false"})["ai_audit"] is False
    with pytest.raises(ValueError):
        context.settings({"AUDIT_MAX_FILE_SIZE": "-1"})
    assert context.strategy_text(ProjectConfig()) == ""
    assert "in scope: xss, auth" in context.strategy_text(parse_config("vulnerabilityClasses: [xss, auth]\nrulesOfEngagement: none"))
    assert context.class_budgets(["a", "b"], 100, 1, 10) == {"a": (50, 1, 5), "b": (50, 1, 5)}


def test_workspaces(spark, tmp_path):
    scan.write_snapshot(spark.range(1), f"{tmp_path}/w1", "scan", "k")
    (tmp_path / "w2").mkdir()
    (tmp_path / "w3" / "scan").mkdir(parents=True)
    got = {w["name"]: w["state"] for w in context.workspaces(spark, str(tmp_path))}
    assert got == {"w1": "ready", "w2": "empty", "w3": "corrupt"}


def test_windows_of_flagged_files_are_redacted_as_before(spark):
    """Patterns are looked for once a file; its windows equal those that are each redacted by themselves. The patterns ran for every result before."""
    import itertools

    pieces = ["x = 1", "Authorization: Bearer abc.def", "password:", "  'hunter2'", "Cookie: a=b", "-----BEGIN PRIVATE KEY-----", "AAAA", "-----END PRIVATE KEY-----", "ghp_0123456789abcdef0123", "token = Cookie: nn", "sk-0123456789abcdefé", "plain"]
    texts = ["\r\n".join(pieces), "\n".join(reversed(pieces)), "\n".join(pieces[i] for i in (2, 3, 11, 8)), "\n".join(["plain", "token of love", ""]), "", None, *pieces]
    files = spark.createDataFrame([(f"f{i}.ts", "typescript", t, 1, i) for i, t in enumerate(texts)], "path string, language string, content string, line_count int, ord long")
    rows = [("s", "r", "t", "c", "high", f"f{i}.ts", a, a + n, "m", None, i * 100 + a * 4 + n) for i, a, n in itertools.product(range(len(texts)), range(1, 14), range(3))]
    results = spark.createDataFrame(rows, RESULTS)
    got = context.snippets(results, files, around=1)
    plain = results.join(files.select("path", text.lines(F.col("content")).alias("ls")), "path")
    want = plain.select("ord", F.substring(text.redact(text.line_slice(F.col("ls"), F.greatest(F.lit(1), F.col("start_line") - 1), F.least(F.size("ls"), F.col("end_line") + 1))), 1, 12_000).alias("content"))
    assert {(r["ord"], r["content"]) for r in got.select("ord", "content").collect()} == {(r["ord"], r["content"]) for r in want.collect()}
    flags = [r["s"] for r in files.orderBy("ord").select(text.redactable(F.col("content")).alias("s")).collect()]
    assert flags[:6] == [True, True, True, False, False, False]
    assert "inline" in got._jdf.queryExecution().optimizedPlan().toString()
