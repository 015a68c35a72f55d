import random

from siltstone import queries


def events_table(spark, folder, n, first):
    """An events table with ids from ``first`` on; returns its rows as (id, type, user, line, k)."""
    rng = random.Random(3)
    rows = [(first + i, rng.choice(["click", "error", "signup", "view"]), rng.randrange(120), float(rng.randrange(40)), rng.randrange(100)) for i in range(n)]
    made = [(i, f"2024-01-{1 + i % 28:02d} 00:00:00", u, t, v, f'{{"k": {k}}}') for i, t, u, v, k in rows]
    df = spark.createDataFrame(made, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{folder}/events.parquet")
    return [(i, t, u, int(v), k) for i, t, u, v, k in rows]


def test_compatible_pairs_of_all_events(spark, tmp_path):
    rows = events_table(spark, tmp_path, 300, 2900)
    # The standard remediation ("enforce ...") counts as command injection where the category names no other family.
    family = {i: {2: "template-xss", 4: "sql-injection"}.get(u % 6, "command-injection") for i, _, u, _, _ in rows}
    path = lambda u: "" if u % 17 == 0 else f"src/u{u % 40}.ts"
    expected = set()
    for i, _, u, line, _ in rows:
        for j, _, u2, line2, _ in rows:
            if i < j and path(u) == path(u2) and abs(line - line2) <= 5:
                if family[i] == family[j]:  # every row has a family: another one never fits, the same always does
                    expected.add((i, j))
    got = [tuple(r) for r in queries.q_compatible_pairs(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert any(i >= 3000 for i, _ in expected)


def test_pairs_of_families_are_not_compared(spark, tmp_path):
    """Where every finding has a family, titles and sinks of pairs are not looked at; every pair's were before."""
    events_table(spark, tmp_path, 50, 0)
    assert "array_intersect" not in queries.q_compatible_pairs(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_classes_give_the_pairs(spark):
    """Pairs rebuilt from classes are all compatible pairs, with and without families, sinks and titles."""
    from pyspark.sql import functions as F

    from siltstone.operators import dedupe, modelio
    from siltstone.schemas import RESULTS

    rng = random.Random(7)
    title = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsi", "of", "x"]) for _ in range(rng.randrange(0, 6)))
    rows = [("s", f"rule-number-{rng.randrange(3)}" if rng.random() < 0.4 else "r", title(), rng.choice(["xss", "sql-injection", "misc"]), "high", rng.choice(["a.ts", "A.ts", "b.ts", None]), rng.choice([*range(1, 40), None]), 9, "m", '{"fix": "none"}', i) for i in range(150)]
    findings = modelio.as_findings(spark.createDataFrame(rows, RESULTS)).withColumn("remediation", F.lit("n")).withColumn("reasoning", F.lit("")).withColumn("evidence", F.array().cast("array<struct<path:string,line:int,note:string>>"))
    want = {(r["a"], r["b"]) for r in dedupe.compatible_pairs(findings).select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b")).collect()}
    members, pairs = dedupe.compatible_classes(findings)
    held = {}
    for r in members.collect():
        held.setdefault((r["kind"], r["class"]), []).append(r["ord"])
    listed = pairs.collect()
    got = {(min(x, y), max(x, y)) for r in listed for x in held[r["kind"], r["a"]] for y in held[r["kind"], r["b"]] if x != y}
    assert got == want and len(want) > 100 and {r["kind"] for r in listed} == {"family", "sink", "title"}


def test_source_patterns_of_programs_around_words_that_rules_know(spark, tmp_path):
    words = ["users", "profile", "price", "role", "csrf", "total", "id", "hello"]
    spark.createDataFrame([(i, w, "en") for i, w in enumerate(words)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in queries.q_source_patterns(spark, str(tmp_path)).collect())
    assert got == sorted((rule, f"app/d{i}.ts", line) for i in range(len(words)) for rule, line in (("source-nosql-where-concat", 6), ("source-state-changing-get-logout", 3)))


def counted(spark, df, column):
    """The table with a column that passes through Python, and the count of values that did."""
    from pyspark.sql import functions as F

    calls = spark.sparkContext.accumulator(0)

    def same(x):
        calls.add(1)
        return x

    return df.withColumn(column, F.udf(same, "string").asNondeterministic()(column)), calls


def test_edges_and_imports_are_made_once(spark):
    from siltstone.operators import imports

    edges, calls = counted(spark, spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "from_path string, to_path string"), "to_path")
    assert imports.reach_depth(edges, spark.createDataFrame([("n0",)], "path string")).count() == 7
    assert calls.value == 6
    rows = [(f"a{i}.rb", "ruby", f"require_relative './a{i + 1}'\n", 2, i) for i in range(8)]
    files, calls = counted(spark, spark.createDataFrame(rows, "path string, language string, content string, line_count int, ord long"), "content")
    assert imports.import_graph(files).count() == 7
    # The texts are read for the modules and for the aliases.
    assert calls.value <= 16


def test_title_overlap_cuts_titles_before_they_meet(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "Beta-gamma", "of", "DELTA", "epsilon", "zeta"])
    rows = [(i, f"b{i % 3}", rng.choice(["", None, " ".join(word() for _ in range(rng.randrange(1, 5)))])) for i in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    cut = lambda t: {w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split() if len(w) > 3}
    want = {}
    for i, x, t in rows:
        for j, y, u in rows:
            if x == y and i < j:
                s, r = cut(t), cut(u)
                want[i, j] = len(s & r) / min(len(s), len(r)) if s and r else 0.0
    df = queries.q_title_overlap(spark, str(tmp_path))
    assert {(r["a"], r["b"]): r["overlap"] for r in df.collect()} == want
    # No pattern is run on a pair: all of them are below the join.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan[: plan.index("Join")] and "regexp" in plan


def documents_of(spark, folder, n):
    """Tables of ``n`` English documents, each a program with one route, and no page."""
    spark.createDataFrame([(i, f"hello w{i}", "en") for i in range(n)], "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")


def test_high_risk_counts_every_route(spark, tmp_path):
    """Of 520 programs with a route, each route counts for its file; the first 500 did before."""
    from pyspark.sql import functions as F

    from siltstone.operators import detectors, intelligence

    documents_of(spark, tmp_path, 520)
    files = queries.all_files(spark, str(tmp_path))
    # Two more routes of the last program: they decide which file comes first.
    more = F.concat("content", F.lit("\napp.get('/a/b', go);\napp.get('/c/d', go);"))
    files = files.withColumn("content", F.when(F.col("path") == "app/d519.ts", more).otherwise(F.col("content")))
    entries = intelligence.entrypoints(files)
    assert entries.count() == 522 and intelligence.entrypoints(files, 7).count() == 7
    scored = intelligence.high_risk_files(files, detectors.quality(files), entries, most=1000).collect()
    assert len(scored) == 520 and tuple(scored[0])[:2] == ("app/d519.ts", 60) and {r["score"] for r in scored[1:]} == {20}


def test_traversal_places_every_file(spark, tmp_path):
    """Chunks of all 130 programs are placed, in the order of the files; those of the first 100 files were before. Documents as files are no part of an audit."""
    from siltstone.operators import detectors, imports

    documents_of(spark, tmp_path, 130)
    rows = queries.q_traversal(spark, str(tmp_path)).collect()
    assert {r["path"] for r in rows} == {f"app/d{i}.ts" for i in range(130)}
    assert [r["place"] for r in rows] == [r["file_place"] for r in rows] == list(range(1, 131))
    # With a limit the first files are as they were; a long file's chunks follow each other.
    files = queries.all_files(spark, str(tmp_path)).where("path IN ('app/d1.ts', 'app/d2.ts', 'app/d3.ts')")
    files = files.selectExpr("path", "language", "CASE WHEN path = 'app/d1.ts' THEN concat(content, repeat('\\n', 400)) ELSE content END AS content", "line_count", "ord")
    short = imports.traversal(files, detectors.custom_rules(files), ["app/d1.ts"], 2).collect()
    assert [(r["path"], r["chunk_index"], r["file_place"], r["place"]) for r in short] == [("app/d1.ts", 0, 1, 1), ("app/d1.ts", 1, 1, 2), ("app/d1.ts", 2, 1, 3), ("app/d2.ts", 0, 2, 4)]
