"""Sections of a report from a scan's own data."""

from pyspark.sql import functions as F
from test_detectors import code

from siltstone.operators import audit, modelio
from siltstone.plans import report, scan
from siltstone.schemas import RESULTS
from siltstone.sources.files import ProjectConfig


def test_sections_of_a_scan(spark):
    files = code(spark, {
        "src/server.ts": "import _ from 'lodash';\napp.get('/a/:id', (req, res) => {\n  eval(req.query.x);\n});\n", "package.json": '{"dependencies": {"lodash": "1"}}', "lib/a.py": "password = 'hunter2hunter2'\n",
    })
    done = scan.scan(files)
    vulnerable = [("trivy", "CVE-1", "lodash: template code execution", "dependency", "high", "package-lock.json", None, None, "m", '{"VulnerabilityID": "CVE-1", "PkgName": "lodash"}', 10**12)]
    results = done.results.unionByName(spark.createDataFrame(vulnerable, RESULTS), allowMissingColumns=True)
    used = modelio.usage(spark.createDataFrame([("p", "low", "m", '{"usage": {"input_tokens": 5}}')], "provider string, tier string, model string, response string"))
    jobs = spark.createDataFrame([("succeeded",), ("failed",)], "status string")
    skipped = spark.createDataFrame([("big.bin", "binary file"), ("a.ts", None)], "path string, skipped_reason string")
    rounds = audit.Walk(files, results).run(lambda _: None, 1, 10_000)
    more = report.scan_sections(files, results, done.findings, done.suppressed, ProjectConfig(focus_paths=["src"]), skipped, used, jobs, rounds)
    tables = {title: (df.select(*columns).collect(), columns) for title, df, columns in report.sections(results, done.findings, more)}
    assert len(tables) == 25
    assert tables["Dependency findings"][0][0]["package"] == "lodash" and tables["Warnings"][0][0]["first"] == "big.bin"
    assert any("src/server.ts" in str(r) for r in tables["Security intelligence"][0]) and tables["Model jobs"][0][0]["failed"] == 1
    assert tables["Audit coverage"][0][0]["windows"] >= 1 and tables["Scan strategy"][0][0]["setting"] == "profile"
    page = report.html(results, done.findings, more)
    assert "<h2>Static recon</h2>" in page and "## Static proof packs" in report.markdown(results, done.findings, more)


def test_additional_results_are_whole_unless_asked(spark):
    rows = spark.range(700).select(*[F.lit("x").alias(c) for c in ("scanner", "title", "category", "severity", "message", "raw")], F.concat(F.lit("r"), "id").alias("rule_id"), F.lit("p").alias("path"), F.col("id").cast("int").alias("start_line"), F.lit(1).alias("end_line"), F.col("id").alias("ord"))
    none = modelio.as_findings(rows).limit(0)
    assert report.additional_results(rows, none).count() == 700 and report.additional_results(rows, none, 5).count() == 5


def test_health_does_not_hang_on_the_order_of_findings(spark):
    """38 likely findings of 2 and one suspected of 25 leave 26.7; 15 suspected ones of 5 leave 62.5, that is 63."""
    rows = [(1, "low", "likely_true_positive")] * 38 + [(1, "critical", "suspected")] + [(2, "medium", "suspected")] * 15 + [(3, "critical", "confirmed")] * 9
    # Eight tenths of 5 and of 2 add up to 50.4 and a half of 25 to 12.5; as doubles the sums miss the half by their order.
    halves = [(k, s, w) for k in range(10, 60) for s, w in [("high", "likely_true_positive")] * (k % 5) + [("medium", "suspected")] * (1 + k % 7) + [("low", "likely_true_positive")] * (k % 11)]
    got = dict(report.health(spark.createDataFrame(rows + halves, "key int, severity string, status string"), ["key"]).collect())
    assert (got[1], got[2], got[3]) == (27, 63, 0)
    lost = {}
    for k, s, w in halves:
        lost[k] = lost.get(k, 0) + {"high": 12, "medium": 5, "low": 2}[s] * {"likely_true_positive": 8, "suspected": 5}[w]
    assert {k: got[k] for k in lost} == {k: max(0, (1005 - t) // 10) for k, t in lost.items()}
