import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import core, dedupe, history, imports, modelio, policy
from siltstone.schemas import FINDINGS, RESULTS, SCAN_CACHE, SCANS
from siltstone.session import Scratch

FILES = "path string, language string, content string, line_count int, ord long"


def result(spark, rows):
    full = [(r.get("scanner", "semgrep"), r.get("rule", "r"), r.get("title", "t"), r.get("category", "xss"), r.get("severity", "high"), r.get("path", "a.ts"), r.get("line", 1), r.get("line", 1), r.get("message", "m"), r.get("raw"), i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, RESULTS)


def files(spark, code):
    return spark.createDataFrame([(p, "typescript", c, c.count("\n") + 1, i) for i, (p, c) in enumerate(sorted(code.items()))], FILES)


def test_first_wins_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([("a", 3), (None, 1), ("a", 2), (None, 5)], "k string, ord long")
    assert sorted((r["k"] or "", r["ord"]) for r in core.first_wins(df, ["k"]).collect()) == [("", 1), ("a", 2)]
    assert core.first_wins(df.where("false"), ["k"]).count() == 0


def test_breadth_first(spark):
    df = spark.createDataFrame([("a", 9, 1), ("a", 8, 2), ("b", 7, 3), ("a", 1, 4), ("b", 6, 5)], "g string, s int, ord long")
    got = core.breadth_first(df, F.col("g"), [("s", True), ("ord", False)]).select("ord").collect()
    assert [r[0] for r in got] == [1, 3, 2, 5, 4]
    assert [r[0] for r in core.breadth_first(df, F.col("g"), [("s", True), ("ord", False)], 2).select("ord").collect()] == [1, 3]


def test_band_join_equals_nested_loops(spark):
    rows = [("p" if i % 3 else "q", (i * 7) % 40, i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, at int, ord long")
    got = {(r["a"]["ord"], r["b"]["ord"]) for r in core.band_self_join(df, "k", "at", 4).collect()}
    assert got == {(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and abs(a[1] - b[1]) <= 4}


def test_band_pairs_of_blocks_equal_nested_loops(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "x", "x", "y", None]), rng.choice([0, 1, 1, 1, 2, 6, 7, 30, None]), rng.choice(["f", "g"]), i) for i in range(260)] + [("z", 3, "f", 900), ("z", 3, "f", None)]
    df = spark.createDataFrame(rows, "k string, at int, f string, ord long")
    got = [tuple(r) for r in core.band_pairs(df, ["k", "f"], "at", 5, block=8).collect()]
    want = [(a[3], b[3]) for a in rows for b in rows if None not in (*a, *b) and a[0] == b[0] and a[2] == b[2] and a[3] < b[3] and abs(a[1] - b[1]) <= 5]
    assert sorted(got) == sorted(want) and len(want) > 500


def test_band_pairs_are_packed(spark, tmp_path):
    """Pairs come in runs, so that a file of all of them takes little; the query once took 4.6 bytes a pair."""
    from siltstone import queries

    spark.range(1500).selectExpr("id * 7 AS event_id", "TIMESTAMP '2024-01-01 00:00:00' AS ts", "1L AS user_id", "'view' AS event_type", "CAST(id % 4 AS DOUBLE) AS value", "'{\"k\": 1}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    queries.q_band_self_join(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").distinct().count() == 1500 * 1499 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 1500 * 1499 // 2


def test_blocks_meet_a_few_rows_at_a_time(spark):
    """Generated code holds the pairs of one row until it is done: pieces of two blocks, not the blocks' millions of pairs."""
    def met(n, m):
        made = lambda k, step: F.sequence(F.lit(0).cast("long"), F.lit((k - 1) * step).cast("long"), F.lit(step).cast("long"))
        return spark.range(1).select(F.lit(False).alias("_own"), made(n, 2).alias("_xs"), made(m, 3).alias("_ys"))

    for n, m in ((1, 1), (32, 256), (33, 257), (700, 1100)):
        got = core._each_two(met(n, m), core.FEW).select("_x", "_y").toPandas()
        assert len(got) == n * m and set(zip(got["_x"], got["_y"])) == {(2 * i, 3 * j) for i in range(n) for j in range(m)}
    plan = core._each_two(met(9, 9), core.FEW)._jdf.queryExecution().executedPlan().toString()
    # Both sides are cut by expressions that are no part of generated code, which marks its operators with a star.
    cuts = [line for line in plan.splitlines() if "Generate explode(transform" in line]
    assert len(cuts) == 2 and not any("*(" in line for line in cuts)


def test_overlap_pairs_equal_nested_loops(spark):
    """With words that have a bit of their own and with rarer ones, keys that repeat or are missing, in blocks of eight rows."""
    rng = random.Random(11)
    words = [f"word{i}" for i in range(core.COMMON_WORDS + 200)]
    weights = [3 if i < core.COMMON_WORDS else 1 for i in range(len(words))]
    rows = [(rng.choice(["x", "x", "x", "y", None]), rng.choice([i, i, i, 7, None]), sorted(set(rng.choices(words, weights, k=rng.randrange(0, 40))))) for i in range(240)]
    df = spark.createDataFrame(rows, "k string, ord long, w array<string>")
    got = [(r["a"], r["b"], round(r["overlap"], 9)) for r in core.overlap_pairs(df, "k", "w", block=8).collect()]
    told = lambda s, t: round(len({*s} & {*t}) / min(len(s), len(t)), 9) if s and t else 0.0
    want = [(a[1], b[1], told(a[2], b[2])) for a in rows for b in rows if None not in (a[0], a[1], b[0], b[1]) and a[0] == b[0] and a[1] < b[1]]
    assert sorted(got) == sorted(want) and len(want) > 5000
    assert any(set(s[2]) & set(t[2]) & set(words[core.COMMON_WORDS :]) for s in rows for t in rows if s is not t)


def test_overlap_pairs_without_words(spark):
    df = spark.createDataFrame([("x", 1, []), ("x", 2, [])], "k string, ord long, w array<string>")
    assert [tuple(r) for r in core.overlap_pairs(df, "k", "w").collect()] == [(1, 2, 0.0)]


def test_suppression_cuts_only_files_with_the_marker(spark):
    """Any spelling of the marker counts; files without it are left out before their lines are cut, where all were cut before."""
    found = result(spark, [{"path": p, "line": 2} for p in ("a.ts", "b.ts", "c.ts", "d.ts")])
    tree = files(spark, {"a.ts": "// AUDIT:Disable r\nx", "b.ts": "// auDIT-disable-NEXT-line r\nx", "c.ts": "auditor disable\nx", "d.ts": "x\ny"})
    tagged = policy.suppress(found, tree)
    assert {r["path"]: r["suppressed"] is not None for r in tagged.collect()} == {"a.ts": True, "b.ts": True, "c.ts": False, "d.ts": False}
    cuts = policy.suppress(found, Scratch(spark, "marker").table("files", tree))._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[1:]
    assert cuts and all("Contains(lower(content" in cut for cut in cuts)


def test_range_first_and_semi(spark):
    points = spark.createDataFrame([("f", 5), ("f", 50), ("g", 5)], "path string, line int")
    ranges = spark.createDataFrame([("f", 4, 9, 2), ("f", 1, 9, 1)], "path string, start_line int, end_line int, ord int")
    got = {(r["path"], r["line"]): r["hit"]["ord"] if r["hit"] else None for r in core.range_first(points, ranges, "path", "line", "ord").collect()}
    assert got == {("f", 5): 1, ("f", 50): None, ("g", 5): None}
    assert core.range_semi(points, ranges, "path", "line").count() == 1
    assert core.range_semi(points, ranges, "path", "line", anti=True).count() == 2


def test_multiset_diff_keeps_duplicates(spark):
    c = spark.createDataFrame([("x",), ("x",), ("y",)], "f string")
    b = spark.createDataFrame([("y",), ("z",), ("z",)], "f string")
    new, resolved, same = core.multiset_diff(c, b, "f")
    assert (new.count(), resolved.count(), same.count()) == (2, 2, 1)


def test_running_budget_clips_the_last(spark):
    df = spark.createDataFrame([(1, 40), (2, 40), (3, 40)], "o int, n int")
    assert [r["taken"] for r in core.running_budget(df, "n", 100, ["o"]).orderBy("o").collect()] == [40, 40, 20]


def test_thresholds(spark):
    df = spark.createDataFrame([("critical", "high"), ("low", "high"), ("odd", "high"), (None, "low")], "severity string, confidence string")
    assert core.threshold(df, "medium", None).count() == 1
    assert core.threshold(df, "nonsense", None).count() == 4
    assert core.threshold(df, None, "high").count() == 3


SUPPRESSED = "audit:disable r\n// bad\nbad\n// audit:enable r\nbad\n// audit-disable-next-line r\nbad\nbad // audit-disable-line\n"


def test_suppressions_in_order_of_precedence(spark):
    f = files(spark, {"a.ts": SUPPRESSED, "lib/b.ts": "x"})
    rows = result(spark, [{"line": 3}, {"line": 5}, {"line": 7}, {"line": 8}, {"path": "lib/b.ts"}, {"line": 3, "rule": "other"}, {"path": None}])
    got = {r["ord"]: r["suppressed"] for r in policy.suppress(rows, f, ["lib/"]).collect()}
    assert "disable/enable block" in got[0] and got[1] is None and "previous-line" in got[2] and "same-line" in got[3]
    assert "ignored by" in got[4] and got[5] is None and got[6] is None
    summary = policy.suppression_summary(policy.suppress(rows, f, ["lib/"])).first()
    assert summary["suppressed"] == 4 and len(summary["reasons"]) == 4


@pytest.mark.parametrize("path,pattern,hit", [("dist/a.js", "dist/", True), ("x/dist/a.js", "dist/", False), ("a/b.js", "*.js", True), ("a/b.js", "b.js", True), ("a/b.js", "a", True), ("ab/b.js", "a", False)])
def test_ignore_patterns(spark, path, pattern, hit):
    assert spark.range(1).select(policy.ignore_match(F.lit(path), pattern)).first()[0] is hit


def test_policy_filters(spark):
    rows = result(spark, [{"rule": "a"}, {"rule": "b", "scanner": "s"}, {"rule": "c", "severity": "low"}])
    kept = policy.project_policy(rows, ["a"], {"s/b": "info"}).collect()
    assert {(r["rule_id"], r["severity"]) for r in kept} == {("b", "info"), ("c", "low")}
    assert policy.exit_code(rows, "high").first()[0] == 2
    assert policy.exit_code(rows.where("false"), "high").first()[0] == 0
    assert policy.exit_code(rows, "none").first()[0] == 0


def test_noise_reduction_merges_one_family_and_keeps_the_rest(spark):
    rows = result(
        spark,
        [{"category": "sql-injection", "line": 3, "severity": "medium", "title": "sql injection"}, {"category": "sql-injection", "line": 9, "severity": "high", "title": "raw sql", "scanner": "bearer"}, {"category": "sql-injection", "line": 40, "title": "sql injection"}, {"category": "maintainability", "title": "x", "rule": "z", "message": "y"}],
    )
    got = {r["ord"]: r for r in dedupe.reduce_noise(rows).collect()}
    assert set(got) == {1, 2, 3} and got[1]["first_ord"] == 0
    assert got[1]["semantic_deduplication"]["deduplicated_count"] == 1
    assert got[1]["message"].endswith("Deduplicated 1 related finding: semgrep/r/sql injection")
    assert got[3]["semantic_deduplication"] is None


def test_dependencies_are_not_merged(spark):
    rows = result(spark, [{"category": "dependency", "title": "ssrf", "rule": "CVE-2020-1", "scanner": "trivy"}, {"category": "dependency", "title": "ssrf", "rule": "CVE-2020-2", "scanner": "trivy"}])
    assert dedupe.reduce_noise(rows).count() == 2


def finding(spark, rows):
    base = modelio.as_findings(result(spark, rows))
    return base.withColumn("fingerprint", F.concat(F.lit("f"), "ord"))


def test_finding_dedupe_unites_evidence(spark):
    f = finding(spark, [{"title": "xss here", "line": 2}, {"title": "xss there", "line": 4, "severity": "critical"}])
    got = dedupe.dedupe_findings(f).collect()
    assert len(got) == 1 and got[0]["severity"] == "critical" and [e["line"] for e in got[0]["evidence"]] == [2, 4]


def test_baseline(spark):
    a, b = finding(spark, [{"line": 1}, {"line": 2}]), finding(spark, [{"line": 1}])
    d = history.baseline_diff(a, b).first()
    assert (d["new_findings"], d["resolved_findings"], d["unchanged_findings"]) == (1, 0, 1) and d["new_fingerprints"] == ["f1"]
    assert {r["baseline_status"] for r in history.mark_baseline(a, b).collect()} == {"new", "unchanged"}
    assert history.mark_baseline(a, None).where("baseline_status IS NOT NULL").count() == 0


def test_derived_fingerprint_is_used_without_a_stored_one(spark):
    f = finding(spark, [{"title": "A candidate  title"}]).withColumn("fingerprint", F.lit(None).cast("string"))
    assert history.fingerprints(f).first()["fingerprint"] == "xss|high|a.ts|1|a  title|semgrep"  # white space is squeezed before the words go


def test_incremental_over_three_runs(spark):
    cache = spark.createDataFrame([], SCAN_CACHE)
    first = files(spark, {"a.ts": "1", "b.ts": "2"})
    assert history.changed_files(first, cache, "/r").count() == 2
    cache = history.upsert_cache(cache, first, "/r", "2024-01-01 00:00:00")
    assert history.changed_files(first, cache, "/r").count() == 0
    second = files(spark, {"a.ts": "1", "b.ts": "3"})
    assert [r["path"] for r in history.changed_files(second, cache, "/r").collect()] == ["b.ts"]
    merged = history.upsert_cache(cache, second, "/r", "2024-01-02 00:00:00")
    assert merged.count() == 2 and history.changed_files(second, merged, "/r").count() == 0


def test_memory_needs_an_unchanged_file(spark):
    import datetime as dt

    now = finding(spark, [{"line": 1}])
    old = now.withColumn("status", F.lit("false_positive")).withColumn("scan_id", F.lit("s1"))
    scans = spark.createDataFrame([("s1", "/r", dt.datetime(2024, 1, 1), None, "completed", None, None, None)], SCANS)
    for content, status in (("same", "false_positive"), ("changed", "suspected")):
        then = spark.createDataFrame([("s1", "a.ts", "same")], "scan_id string, path string, c string").select("scan_id", "path", F.sha2("c", 256).alias("sha256"))
        memory = history.triage_memory(old, scans, then, "/r", "s2")
        assert history.apply_memory(now, memory, files(spark, {"a.ts": content})).first()["status"] == status
    assert history.negative_evidence(old, scans, "/r", "s2").count() == 1
    assert history.latest_scan(scans, "/r", "s2").first()["id"] == "s1"


def test_approvals_resolve_once(spark):
    from siltstone.schemas import APPROVALS

    rows = [("1", "s", "curl", "p", "low", "r", "t", "pending", None, None), ("2", "s", "curl", "p", "low", "r", "u", "rejected", None, None)]
    a = spark.createDataFrame(rows, APPROVALS)
    d = spark.createDataFrame([("1", "approved"), ("2", "approved")], "id string, status string")
    got = history.resolve_approvals(a, d, "2024-01-01 00:00:00")
    assert {r["id"]: r["status"] for r in got.collect()} == {"1": "approved", "2": "rejected"}
    assert history.approved(spark.createDataFrame([("curl", "t"), ("curl", "u")], "action_type string, target string"), got).count() == 1


USAGE = [
    ('{"usage": {"prompt_tokens": 10, "completion_tokens": 5}}', (10, 10, 5, 15)),
    ('{"usage": {"input_tokens": 10, "cache_read_input_tokens": 4, "cache_creation_input_tokens": 2, "output_tokens": "3"}}', (16, 10, 3, 19)),
    ('{"usage": {"prompt_cache_miss_tokens": 7, "prompt_cache_hit_tokens": 3}}', (10, 7, 0, 10)),
    ("{}", (0, 0, 0, 0)),
    ("not json", (0, 0, 0, 0)),
]


@pytest.mark.parametrize("response,expected", USAGE)
def test_usage(spark, response, expected):
    r = modelio.usage(spark.createDataFrame([(response,)], "response string")).first()
    assert (r["input_tokens"], r["uncached_input_tokens"], r["output_tokens"], r["total_tokens"]) == expected


def test_usage_costs_stay_null_if_none_is_known(spark):
    df = spark.createDataFrame([("p", "low", "m", '{"usage":{"cost": 0.5}}'), ("p", "low", "n", "{}")], "provider string, tier string, model string, response string")
    got = {r["model"]: r["cost"] for r in modelio.usage_summary(modelio.usage(df)).collect()}
    assert float(got["m"]) == 0.5 and got["n"] is None


def test_model_json_is_repaired_and_salvaged(spark):
    text = 'Sure: {"findings": [{"title": "A", "category": "xss", "severity": ["high", "x"], "confidence": "high", "status": "suspected", "path": "a", "startLine": 0, "evidence": [{"path": "a", "line": 3}, {"line": 1}]}, {"title": "broken"}]} end'
    rows = modelio.finding_rows(spark.createDataFrame([(text,)], "response string")).orderBy("place").collect()
    assert [r["valid"] for r in rows] == [True, False]
    assert rows[0]["severity"] == "high" and rows[0]["start_line"] is None and len(rows[0]["evidence"]) == 1


def test_verdicts(spark):
    tries = spark.createDataFrame([(1, 0, "junk"), (1, 1, '{"verdict": "false_positive", "reason": "no"}'), (2, 0, "junk")], "ord long, attempt int, response string")
    got = {r["ord"]: r["verdict"] for r in modelio.first_valid(tries, "ord").collect()}
    assert got == {1: "false_positive", 2: None}
    f = finding(spark, [{}, {"line": 2}])
    v = spark.createDataFrame([(0, "false_positive", "low", "no"), (1, "true_positive", "high", "yes")], "ord long, verdict string, verdict_confidence string, reason string")
    assert [(r["status"], r["confidence"]) for r in modelio.apply_verdicts(f, v).orderBy("ord").collect()] == [("false_positive", "low"), ("likely_true_positive", "medium")]


def test_second_pass_last_decision_counts(spark):
    f = finding(spark, [{}, {"line": 2}, {"line": 3}])
    d = spark.createDataFrame([(0, 0, "reject", None, None, "x"), (0, 1, "keep", "confirmed", "high", "ok"), (1, 0, "reject", None, None, "x")], "ord long, at int, decision string, status string, confidence string, reason string")
    got = {r["ord"]: r["status"] for r in modelio.second_pass(f, d).collect()}
    assert got == {0: "confirmed", 2: "suspected"}


def test_evidence_must_lie_in_read_ranges(spark):
    f = finding(spark, [{"line": 5}, {"line": 50}])
    ranges = spark.createDataFrame([("a.ts", 1, 10)], "path string, start_line int, end_line int")
    assert {r["ord"] for r in modelio.unsupported_evidence(f, ranges).collect()} == {1}
    assert [r["ord"] for r in modelio.supported(f, files(spark, {"a.ts": "x\n" * 60}), ranges).collect()] == [0]


def test_findings_schema(spark):
    assert modelio.as_findings(result(spark, [{}])).columns == [c.split(" ")[0] for c in FINDINGS.replace("array<struct<path:string,line:int,note:string>>", "x").split(", ")]


def test_repeated_rows_stay(spark):
    points = spark.createDataFrame([("f", 5), ("f", 5), ("f", 50)], "path string, line int")
    ranges = spark.createDataFrame([("f", 4, 9, 2), ("f", 1, 9, 1)], "path string, start_line int, end_line int, ord int")
    got = sorted((r["line"], r["hit"]["ord"] if r["hit"] else 0) for r in core.range_first(points, ranges, "path", "line", "ord").collect())
    assert got == [(5, 1), (5, 1), (50, 0)]
    rules = spark.createDataFrame([("x", "^a", 2), ("y", "^ab", 1), ("z", None, 0)], "name string, regex string, ord int")
    rows = spark.createDataFrame([("abc",), ("abc",), ("ax",), ("q",)], "s string")
    for most in (1000, 1):
        core.LITERAL_RULES = most
        got = sorted((r["s"], r["rule"]["name"] if r["rule"] else "") for r in core.theta_first(rows, rules, lambda rule: F.rlike(F.col("s"), rule["regex"]), "ord").collect())
        assert got == [("abc", "y"), ("abc", "y"), ("ax", "x"), ("q", "")]
    core.LITERAL_RULES = 1000


def test_depth_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(36)], "from_path string, to_path string")
    got = {r["path"]: r["depth"] for r in imports.reach_depth(edges, spark.createDataFrame([("n0",)], "path string")).collect()}
    assert got == {f"n{i}": i for i in range(37)}


def test_changed_paths_and_finished_scans(spark, tmp_path):
    from siltstone.sources import files

    (tmp_path / "diff").write_text("a.ts\n./b.ts\r\n\n")
    tree = spark.createDataFrame([("a.ts",), ("b.ts",), ("c.ts",)], "path string")
    assert sorted(r[0] for r in files.only_changed(tree, files.changed_paths(spark, str(tmp_path / "diff"))).collect()) == ["a.ts", "b.ts"]
    assert files.only_changed(tree, files.changed_paths(spark, str(tmp_path / "none"))).count() == 0
    scans = spark.createDataFrame([("1", "running", None), ("2", "running", None), ("3", "failed", None)], "id string, status string, finished_at timestamp")
    done = history.finish_scans(scans, spark.createDataFrame([("1", "completed"), ("9", "completed")], "id string, status string"), "2024-01-01 00:00:00")
    assert [(r["id"], r["status"], r["finished_at"] is None) for r in done.orderBy("id").collect()] == [("1", "completed", False), ("2", "running", True), ("3", "failed", True)]


def test_budgets_back_off():
    assert imports.backed_off(1000, [400, 700], 100, 10_000) == 1000
    assert imports.backed_off(1000, [400, 700], 100, 600) == 489 and imports.backed_off(1000, [10], 700, 600) == 0


def test_families_are_told_once_for_all_branches(spark):
    """Merged findings and classes read rows whose families were written; each branch ran all patterns before."""
    f = finding(spark, [{"title": "SQL injection in query", "line": 3}] * 4)
    merged, (members, pairs) = dedupe.dedupe_findings(f), dedupe.compatible_classes(f)
    assert merged.count() == 1 and members.where("kind = 'family'").count() == 4 and pairs.where("kind = 'family'").count() == 1
    for df in (merged, members, pairs):
        assert "csrf" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_texts_are_told_once_however_many_rows_have_them(spark):
    """Patterns of families run over distinct texts; every row ran all of them before. Nulls among the texts are equal."""
    rows = [{"title": t, "category": c, "message": m, "line": n % 40 + 1, "path": p} for n, (t, c, m, p) in enumerate([("SQL injection", "x", None, "a.ts"), ("plain", None, None, "b.ts"), ("XSS", None, "m", None)] * 30)]
    df = result(spark, rows)
    told = dedupe._families(df)
    assert {(r["title"], r["_family"]) for r in told.collect()} == {("SQL injection", "sql-injection"), ("plain", None), ("XSS", "template-xss")} and told.count() == 90
    merged = dedupe.reduce_noise(df)
    assert "csrf" not in merged._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sum(1 + (r["semantic_deduplication"]["deduplicated_count"] if r["semantic_deduplication"] else 0) for r in merged.collect()) == 90
