import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import classify, text
from siltstone.operators import dependencies, detectors, flow, imports, intelligence
from siltstone.plans import report, scan
from siltstone.schemas import FINDINGS, RESULTS
from siltstone.sources import files as source_files
from siltstone.sources import scanners


def code(spark, files):
    rows = [(p, c, i) for i, (p, c) in enumerate(sorted(files.items()))]
    f = spark.createDataFrame(rows, "path string, content string, ord long")
    return f.withColumn("language", classify.language(F.col("path"), F.col("content"))).withColumn("line_count", text.line_count(F.col("content"))).select("path", "language", "content", "line_count", "ord")


def hits(df):
    return {(r["rule_id"], r["path"], r["start_line"]) for r in df.collect()}


def test_custom_rules(spark):
    f = code(spark, {"a.ts": "x\neval(y)\n", "b.py": "eval(y)\nshell = True\n", "c.txt": "password = process.env.PW\ntoken = 'abcdefghij'\nverify = False", "k.c": "p = kmalloc(4);\nq();\nr = kmalloc(4);\nif (r)\n"})
    got = hits(detectors.custom_rules(f))
    assert ("js-eval", "a.ts", 2) in got and not any(r == "js-eval" and p == "b.py" for r, p, _ in got)
    assert ("python-shell-true", "b.py", 2) in got and ("tls-disabled", "c.txt", 3) in got
    assert ("generic-secret-assignment", "c.txt", 2) in got and ("generic-secret-assignment", "c.txt", 1) not in got
    assert ("c-unchecked-alloc", "k.c", 1) in got and ("c-unchecked-alloc", "k.c", 3) not in got
    secret = detectors.custom_rules(f).where("rule_id = 'generic-secret-assignment'").first()
    assert "abcdefghij" not in secret["message"] and "secret classification" in secret["message"]


def test_config_and_quality(spark):
    f = code(spark, {"config/environments/production.rb": "config.force_ssl = false", "other.rb": "config.force_ssl = false", "s.py": "\nDEBUG = True", "long.ts": "x\n" * 1500})
    assert {("rails-force-ssl-disabled", "config/environments/production.rb", 1), ("django-debug-enabled", "s.py", 2)} <= hits(detectors.config_checks(f))
    assert not any(p == "other.rb" for _, p, _ in hits(detectors.config_checks(f)))
    assert hits(detectors.quality(f)) == {("large-file", "long.ts", 1)}


PATTERNS = {
    "src/a.ts": "app.get('/r', (req, res) => {\n  const to = req.query.next;\n  res.redirect(to);\n});\n",
    "src/b.ts": "app.get('/r', (req, res) => {\n  const to = req.query.next;\n  if (!allowedRedirect(to)) return;\n  res.redirect(to);\n});\n",
    "src/c.ts": "app.post('/admin/export', run);\napp.get('/logout', end);\napp.get('/admin/x', requireAuth, run);\n",
    "src/d.ts": "function f(req) {\n  User.findOne({ id: req.params.id });\n}\n",
    "src/e.ts": "function f(req) {\n  authorize(req.user);\n  User.findOne({ id: req.params.id });\n}\n",
    "src/f.ts": "q = { $where: 'this.a == ' + x }\n",
    "src/g.ts": "a({message: 'User not found'});\nb({message: 'Invalid password'});\n",
    "test/h.test.ts": "q = { $where: 'this.a == ' + x }\n",
    "src/i.ts": "export async function getUrl(url) {\n  return fetch(url);\n}\n",
}


def test_source_patterns(spark):
    got = hits(detectors.source_patterns(code(spark, PATTERNS)))
    assert ("source-open-redirect-variable", "src/a.ts", 3) in got and not any(p == "src/b.ts" and "redirect" in r for r, p, _ in got)
    assert {("source-sensitive-route-without-guard", "src/c.ts", 1), ("source-state-changing-get-logout", "src/c.ts", 2)} & got
    assert ("source-request-controlled-object-id", "src/d.ts", 2) in got and not any(p == "src/e.ts" for _, p, _ in got)
    assert ("source-nosql-where-concat", "src/f.ts", 1) in got and not any(p.startswith("test/") for _, p, _ in got)
    assert ("source-login-distinct-failure-messages", "src/g.ts", 1) in got
    assert ("source-ssrf-wrapper-unvalidated-url", "src/i.ts", 2) in got


def test_business_invariants(spark):
    f = code(spark, {"r.ts": "app.post('/orders/:orderId', (req, res) => {\n  Order.update(req.body.price);\n  order.save();\n});\n"})
    got = {r for r, _, _ in hits(detectors.business_invariants(f))}
    assert "business-invariant-missing-ownership-guard" in got and "business-invariant-client-financial-field" in got
    kinds = {r["category"] for r in detectors.discover_invariants(f).collect()}
    assert {"ownership", "financial-integrity"} <= kinds
    assert detectors.discover_invariants(f, 1).count() == 1


def test_compliance(spark):
    f = code(spark, {"CODEOWNERS": "* @x", "a.ts": "requireAuth();\nsecure: true\nhttpOnly: true\nprocess.env.X\n"})
    none = spark.createDataFrame([], RESULTS)
    got = {r["rule_id"]: r["title"] for r in detectors.compliance(f, none).collect()}
    assert len(got) == 7 and got["compliance-change-management"].startswith("PASS") and got["compliance-session-cookie-protection"].startswith("PASS")
    assert got["compliance-secret-management"].startswith("PASS") and got["compliance-audit-logging"].startswith("UNKNOWN")
    bad = detectors.custom_rules(code(spark, {"b.ts": "password = 'abcdefghijk'\nmd5(x)\n"}))
    got = {r["rule_id"]: r["title"] for r in detectors.compliance(f, bad).collect()}
    assert got["compliance-secret-management"].startswith("FAIL") and got["compliance-crypto-transport"].startswith("FAIL")


def test_gates_and_chain(spark):
    f = code(spark, {"a.ts": "const h = req.headers['host'];\nif (h === admin) return true;\n", "b.ts": "const h = req.headers['host'];\n"})
    got = detectors.header_gates(f).collect()
    assert [(r["rule_id"], r["path"], r["start_line"], r["severity"]) for r in got] == [("host-header-admin-gate", "a.ts", 1, "high")]
    rows = [("custom-rules", "p", "P", "prototype-pollution", "high", "a.ts", 3, 3, "m", None, 0), ("trivy", "CVE-1", "eta", "dependency", "high", "l", None, None, "remote code execution", '{"PkgName":"eta","id":"x"}', 1)]
    both = spark.createDataFrame(rows, RESULTS)
    assert [r["severity"] for r in detectors.pollution_chain(both).collect()] == ["critical"]
    assert detectors.pollution_chain(both.where("ord = 0")).count() == 0


FLOW = {
    "src/exec.js": "export function run(cmd) {\n  exec(cmd);\n}\n",
    "src/server.js": "import { run } from './exec';\nrun(req.query.cmd);\nrun(sanitize(req.query.cmd));\n",
    "app.py": "def load(name):\n    data = request.args\n    path = data\n    open(path)\n    safe = basename(path)\n",
    "x.rb": "a = params[:id]\nb = a\nFile.read(b)\n",
}


def test_taint_lite_follows_assignments(spark):
    got = hits(flow.taint_lite(code(spark, FLOW | {"y.js": "const a = req.body.x;\nexec(a);\nexec(sanitize(a));\nexec(req.body.y);\n"})))
    assert ("taint-command", "y.js", 2) in got and ("taint-command", "y.js", 3) not in got and ("taint-command-direct", "y.js", 4) in got
    assert ("taint-filesystem", "x.rb", 3) in got


def test_taint_flow_across_files_and_backwards(spark):
    got = hits(flow.taint_flow(code(spark, FLOW)))
    assert ("flow-command-interprocedural", "src/server.js", 2) in got and ("flow-command-interprocedural", "src/server.js", 3) not in got
    assert ("flow-filesystem-sink-backtrace", "app.py", 4) in got
    trace = flow.backtraces(code(spark, FLOW)).where("path = 'app.py'").first()
    assert [s["line"] for s in json.loads(trace["raw"])["dataFlow"]] == [2, 2, 3, 4]


def test_functions_and_models(spark):
    f = {r["name"]: r for r in flow.functions(code(spark, FLOW)).collect()}
    assert f["run"]["params"] == ["cmd"] and (f["run"]["start_line"], f["run"]["end_line"], f["run"]["exported"]) == (1, 3, True)
    assert f["load"]["end_line"] == 6
    assert [(m["name"], m["param"], m["sink_line"]) for m in flow.function_sinks(code(spark, FLOW)).collect()] == [("run", "cmd", 2)]


def test_reachability(spark):
    f = code(spark, {"a.ts": "import _ from 'lodash';\n_.template(x);\n", "b.ts": "import y from 'js-yaml';\n", "c.ts": "import { merge as m } from 'lodash/fp';\nm(a);\n"})
    raw = lambda p: json.dumps({"VulnerabilityID": "CVE-1", "PkgName": p})
    rows = [("trivy", "CVE-1", "lodash", "dependency", "high", "l", None, None, "template and merge code execution", raw("lodash"), 0), ("trivy", "CVE-2", "js-yaml", "dependency", "high", "l", None, None, "dos", raw("js-yaml"), 1), ("osv-scanner", "GHSA-1", "nope", "dependency", "high", "l", None, None, "x", raw("nope"), 2)]
    r = spark.createDataFrame(rows, RESULTS)
    got = {x["package"]: (x["status"], x["confidence"]) for x in dependencies.reachability(f, r).collect()}
    assert got == {"lodash": ("vulnerable-api-reachable", "high"), "js-yaml": ("package-imported", "medium"), "nope": ("not-reachable", "low")}
    calls = {(c["path"], c["line"], c["api"]) for c in dependencies.api_calls(f).collect()}
    assert calls == {("a.ts", 2, "template"), ("c.ts", 2, "merge")}
    assert {x["rule_id"] for x in dependencies.reachable_results(f, r).collect()} == {"reachable-vulnerable-api-lodash-template", "reachable-vulnerability-js-yaml"}


def test_import_graph_and_depth(spark):
    f = code(spark, {"src/index.ts": "import './a';\nimport x from '@/lib/b';", "src/a.ts": "import '../lib/b';", "lib/b/index.ts": "", "tsconfig.json": '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./*"]}}}', "p/m.py": "from p.n import q\n", "p/n.py": ""})
    e = {(r["from_path"], r["to_path"]) for r in imports.import_graph(f).collect()}
    assert {("src/index.ts", "src/a.ts"), ("src/a.ts", "lib/b/index.ts"), ("src/index.ts", "lib/b/index.ts"), ("p/m.py", "p/n.py")} <= e
    depth = {r["path"]: r["depth"] for r in imports.reach_depth(imports.import_graph(f), f.where("path = 'src/index.ts'").select("path")).collect()}
    assert depth == {"src/index.ts": 0, "src/a.ts": 1, "lib/b/index.ts": 1}
    assert imports.search(f, "import", most=2).count() == 2


def test_chunks_overlap(spark):
    f = code(spark, {"a.ts": "\n".join(map(str, range(250))), "e.ts": ""})
    got = {(r["path"], r["start_line"], r["end_line"]) for r in source_files.chunks(f).collect()}
    assert got == {("a.ts", 1, 120), ("a.ts", 101, 220), ("a.ts", 201, 250), ("e.ts", 1, 1)}
    assert [(r["start_line"], r["end_line"], r["chunk_count"]) for r in source_files.audit_chunks(f).where("path = 'a.ts'").orderBy("start_line").collect()] == [(1, 180, 2), (181, 250, 2)]


def test_walk_index_and_ignores(spark, tmp_path):
    for p, c in {"a.ts": b"x\n", "node_modules/b.ts": b"y", "bin.dat": b"a\0b", "big.txt": b"z" * 50, "sub/c.py": b"import os\n", "keep.log": b"1", "drop.log": b"2"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(c)
    w = source_files.walk(spark, str(tmp_path), gitignore=["*.log", "!keep.log"])
    got = {r["path"]: r["skipped_reason"] for r in source_files.index(w, max_bytes=40).collect()}
    assert got == {"a.ts": None, "bin.dat": "binary file", "big.txt": "file too large", "sub/c.py": None, "keep.log": None}
    assert [r["path"] for r in source_files.walk(spark, str(tmp_path), include=["sub/**"]).collect()] == ["sub/c.py"]
    assert [r["module"] for r in source_files.imports(source_files.index(w)).where("path = 'sub/c.py'").collect()] == ["os"]
    assert len(source_files.tree_fingerprint(w).first()[0]) == 64


def test_config(spark):
    c = source_files.parse_config("profile: web\ndisabled-rules:\n  - a\n  - 'b'\nseverity-overrides:\n  x: low\nfocusPaths: [src/**, lib]\nincremental: true\n")
    assert (c.profile, c.disabled_rules, c.severity_overrides, c.focus_paths, c.incremental) == ("web", ["a", "b"], {"x": "low"}, ["src/**", "lib"], True)
    assert source_files.parse_config('{"failOn": "high"}').fail_on == "high"
    paths = spark.createDataFrame([("src/a.ts",)], "path string")
    globs = source_files.glob_table(spark, "focusPaths", ["src/**", "nope/**", "src"])
    assert [r["pattern"] for r in source_files.missing_globs(paths, globs).collect()] == ["nope/**"]


BEARER = [
    ('[{"id": "a", "severity": "high"}]', "high"), ('{"findings": [{"id": "a", "severity": "warning"}]}', "low"), ('{"results": [{"id": "a"}]}', "info"), ('{"critical": [{"id": "a"}], "low": []}', "critical"), ('{"report": {"issues": [{"id": "a", "level": "Medium"}]}}', "medium"), ("log {\"high\": [{\"id\": \"a\"}]} tail", "high"),
]


@pytest.mark.parametrize("stdout,severity", BEARER)
def test_bearer_shapes(spark, stdout, severity):
    rows = scanners.bearer(spark.createDataFrame([(stdout,)], "stdout string")).collect()
    assert [(r["rule_id"], r["severity"]) for r in rows] == [("a", severity)]


def test_other_adapters(spark):
    one = lambda f, s: f(spark.createDataFrame([(s,), ("junk",), (None,)], "stdout string")).collect()
    sem = one(scanners.semgrep, '{"results": [{"check_id": "c", "path": "/src/a.py", "start": {"line": 3}, "end": {"line": 4}, "extra": {"message": "m", "severity": "ERROR"}}]}')
    assert [(r["rule_id"], r["path"], r["start_line"], r["end_line"], r["severity"]) for r in sem] == [("c", "a.py", 3, 4, "high")]
    leak = one(scanners.gitleaks, '[{"RuleID": "k", "File": "a", "StartLine": 2, "EndLine": 2, "Match": "token=abcdefgh", "Secret": "abcdefgh"}]')
    assert leak[0]["rule_id"] == "k" and "abcdefgh" not in leak[0]["raw"]
    tri = one(scanners.trivy, '{"Results": [{"Target": "l", "Vulnerabilities": [{"VulnerabilityID": "CVE-1", "Severity": "CRITICAL", "PkgName": "p"}], "Secrets": [{"RuleID": "s", "StartLine": 3}], "Misconfigurations": [{"ID": "m", "Message": "x"}]}, {"Target": "e"}]}')
    assert sorted((r["rule_id"], r["category"], r["severity"]) for r in tri) == [("CVE-1", "dependency", "critical"), ("m", "misconfiguration", "info"), ("s", "secrets", "info")]
    osv = one(scanners.osv, '{"results": [{"source": {"path": "/src/l"}, "packages": [{"package": {"name": "p"}, "vulnerabilities": [{"id": "GHSA-1", "summary": "s"}, {"id": "GHSA-2"}]}]}]}')
    assert [(r["rule_id"], r["title"], r["path"]) for r in osv] == [("GHSA-1", "s", "l"), ("GHSA-2", "GHSA-2", "l")] and json.loads(osv[0]["raw"])["PkgName"] == "p"


def test_scan_end_to_end(spark):
    f = code(spark, FLOW | {"src/routes/a.ts": "app.get('/admin', (req, res) => {\n  eval(req.query.x);\n});\n"})
    report_row = spark.createDataFrame([('{"results": [{"check_id": "in", "path": "/src/app.py", "start": {"line": 1}}, {"check_id": "out", "path": "/src/gone.py", "start": {"line": 1}}]}',)], "stdout string")
    r = scan.scan(f, reports={"semgrep": report_row})
    rules = {x["rule_id"] for x in r.results.collect()}
    assert "in" in rules and "out" not in rules and "compliance-auth-access-control" in rules
    assert r.findings.where("fingerprint IS NULL OR exploitability_score IS NULL").count() == 0
    assert r.findings.where("scanner_source = 'compliance'").count() == 0
    assert 0 < scan.plan_review(r.results, 5).count() <= 5
    assert 0 <= report.health(r.findings).first()[0] <= 100
    log = json.loads(report.sarif(r.findings, "tool").first()["document"])
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == r.findings.count()
    ids = [x["id"] for x in log["runs"][0]["tool"]["driver"]["rules"]]
    assert len(ids) == len(set(ids)) and {x["ruleId"] for x in log["runs"][0]["results"]} == set(ids)
    assert all(x["annotation"].startswith("::error file=") for x in report.ci_annotations(r.findings, "high").collect())
    assert intelligence.proof_packs(r.findings, 3).count() <= 3 and "## Health" in report.markdown(r.results, r.findings)
    page = report.html(r.results, r.findings, {"Warnings": spark.createDataFrame([("<b>",)], "warning string")})
    assert "<svg" in page and 'class="filter"' in page and "&lt;b&gt;" in page and "## Warnings" not in report.markdown(r.results, r.findings)
    blocks = [json.loads(x["document"]) for x in report.sarif(r.findings, "tool", rows=2).collect()]
    listed = [x for b in blocks for x in b["runs"][0]["results"]]
    assert len(blocks) > 1 and len(listed) == r.findings.count()
    assert all({x["ruleId"] for x in b["runs"][0]["results"]} == {x["id"] for x in b["runs"][0]["tool"]["driver"]["rules"]} for b in blocks)
    few = r.findings.select("ord", "title")
    documents = [json.loads(x["document"]) for x in report.json_report({"findings": few, "health": report.health(r.findings)}, rows=2).collect()]
    assert sum(len(d["findings"]) for d in documents) == few.count() and sum(len(d["health"]) for d in documents) == 1
    assert [c.split(" ")[0] for c in FINDINGS.split(", ")][0] == r.findings.columns[0]


def test_snapshots(spark, tmp_path):
    df = spark.range(3)
    key = scan.resume_key("/r", {"a": 1, "format": "html"}, {})
    assert key == scan.resume_key("/r", {"format": "json", "a": 1}, {}) != scan.resume_key("/r", {"a": 2}, {})
    assert scan.read_snapshot(spark, str(tmp_path), "scan", key) is None
    scan.write_snapshot(df, str(tmp_path), "scan", key)
    assert scan.read_snapshot(spark, str(tmp_path), "scan", key).count() == 3
    with pytest.raises(ValueError):
        scan.read_snapshot(spark, str(tmp_path), "scan", "other", strict=True)


def test_incremental_stream(spark, tmp_path):
    from siltstone.streaming import incremental

    src, cache, out, mark = (str(tmp_path / n) for n in ("in", "cache", "out", "mark"))
    run = lambda: incremental.scan_stream(incremental.file_stream(spark, src), detectors.custom_rules, cache, out, mark, "/r", "2024-01-01 00:00:00").awaitTermination(60)
    code(spark, {"a.ts": "eval(x)"}).write.parquet(src)
    run()
    code(spark, {"a.ts": "eval(x)", "b.ts": "eval(y)"}).write.mode("append").parquet(src)
    run()
    assert {(x["path"], x["sha256"][:4]) for x in incremental.read_cache(spark, cache, 1).collect()} == {(p, hashlib.sha256(c.encode()).hexdigest()[:4]) for p, c in (("a.ts", "eval(x)"), ("b.ts", "eval(y)"))}
    for n in range(3):
        code(spark, {"a.ts": f"eval({n})"}).write.mode("append").parquet(src)
        run()
    assert incremental.read_cache(spark, cache, 9).count() == 2
    assert len({b for b, _, _ in incremental._files(spark, cache)}) == 2
    rows = spark.read.parquet(out).where("batch < 2").select("batch", "path").collect()
    assert sorted((r["batch"], r["path"]) for r in rows) == [(0, "a.ts"), (1, "b.ts")]


def test_hits_of_one_rule_do_not_reach_into_the_next(spark):
    rules = [("one", "high", "xss", None, "t", "foo"), ("two", "high", "xss", None, "t", "bar")]
    f = code(spark, {"a.ts": "foo\n" * 1500 + "bar\n" * 20, "b.ts": "foo"})
    rows = detectors.custom_rules(f, rules).orderBy("ord").collect()
    assert len({r["ord"] for r in rows}) == len(rows) == 1521
    assert [r["rule_id"] for r in rows] == ["one"] * 1500 + ["two"] * 20 + ["one"]
    assert [r["start_line"] for r in rows] == [*range(1, 1521), 1]
    many = code(spark, {"a.ts": "\n" * 5000 + "eval(req.query.x);\n", "b.ts": "eval(req.query.x);\n"})
    orders = [(r["path"], r["ord"]) for r in detectors.source_patterns(many).orderBy("ord").collect()]
    assert orders == sorted(orders) and len(set(orders)) == len(orders)


def test_required_literals_never_miss(spark):
    assert detectors.required_literals(r"\b(exec|spawn)\s*\(") == ["exec", "spawn"] and detectors.required_literals(r"[a-z]+|x") == []
    assert detectors.required_literals(r"a?(?:Foo){2}\d") == ["foo"] and detectors.required_literals("(") == []
    samples = {"eval(x)": "js-eval", "exec('a')": "node-child-process"}
    f = code(spark, {f"f{i}.ts": t for i, t in enumerate(samples)})
    assert {r["rule_id"] for r in detectors.custom_rules(f).collect()} >= set(samples.values())


def test_cache_grows_with_its_batches(spark, tmp_path, monkeypatch):
    """Each batch writes its own rows; full levels merge; every state can be read, also by a batch that runs again."""
    from pyspark.sql import functions as F

    from siltstone.streaming import incremental

    monkeypatch.setattr(incremental, "FAN", 3)
    monkeypatch.setattr(incremental, "BUCKETS", 2)
    folder, want = str(tmp_path / "cache"), {}
    for epoch in range(11):
        batch = {f"f{(epoch * 3 + i) % 8}.ts": f"v{epoch}-{i}" for i in range(3)}
        rows = spark.createDataFrame([(p, "typescript", c, 1, 0) for p, c in batch.items()], "path string, language string, content string, line_count int, ord long")
        before = dict(want)
        for again in range(2 if epoch in (4, 9) else 1):
            seen = {r["path"]: r["sha256"] for r in incremental.read_cache(spark, folder, epoch - 1).collect()}
            assert seen == {p: hashlib.sha256(c.encode()).hexdigest() for p, c in before.items()}
            incremental.merge_cache(spark, folder, rows, epoch, "/r", "2024-01-01 00:00:00")
            want.update(batch)
        new = incremental._read(spark, folder, [f for f in incremental._files(spark, folder) if f[1:] == (epoch, 0)])
        assert {r["path"] for r in new.collect()} == set(batch)
        assert {r["path"]: r["sha256"] for r in incremental.read_cache(spark, folder, epoch).collect()} == {p: hashlib.sha256(c.encode()).hexdigest() for p, c in want.items()}
    files = incremental._files(spark, folder)
    assert max(level for _, _, level in files) >= 2 and len(files) <= 2 * 3 * 3
    some = incremental.touched_parts(spark.createDataFrame([("f1.ts",)], "path string"))
    assert {r["path"] for r in incremental.read_cache(spark, folder, 10, some).collect()} < set(want) and incremental.read_cache(spark, folder, 10, some).where(F.col("path") == "f1.ts").count() == 1
