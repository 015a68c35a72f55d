"""Walks of an audit against a plain queue, and chains of attempts against a table of all paths."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F
from test_detectors import code

from siltstone.operators import audit, core, modelio
from siltstone.schemas import RESULTS


def plain_walk(order, entries, graph, sizes, priority, asks, rounds, max_files, max_chars, text):
    """The same walk with a list, one pop at a time. ``sizes``: lines of each file."""
    chunks = {p: [(p, a, min(n, a + 179), k) for k, a in enumerate(range(1, n + 1, 180))] for p, n in sizes.items()}
    queue, queued, read, left, out = deque(), set(), [], max_chars, []

    def push(windows, front=False):
        new = [w for w in windows if w[0] in sizes and w[:3] not in queued and not queued.add(w[:3])]
        queue.extendleft(reversed(new)) if front else queue.extend(new)

    firsts = lambda paths: push([chunks[p][0] for p in paths if p in chunks])
    seen = lambda w: any(p == w[0] and a <= w[1] and b >= w[2] for p, a, b in read)

    def take():
        while queue and seen(queue[0]):
            queue.popleft()
        if not queue:
            firsts([p for p in order if p not in {r[0] for r in read}])
        got, new = [], set()
        while queue and len(got) < 6:
            w = queue.popleft()
            known = {r[0] for r in read}
            if seen(w) or (w[0] not in known | new and len(known) + len(new) >= max_files):
                continue
            got.append(w)
            new.add(w[0]) if w[0] not in known else None
            push(chunks[w[0]][w[3] + 1 : w[3] + 2])
        return got

    firsts(priority)
    firsts([p for p in order if p in entries])
    if not queue:
        firsts(order[:6])
    targets = take()
    for number in range(1, rounds + 1):
        pack, used = [], 0
        for w in targets:
            if used >= left:
                break
            body = "\n".join(text[w[0]].split("\n")[w[1] - 1 : w[2]])[: left - used]
            used += len(body)
            pack.append((w[:3], body))
        if not pack:
            break
        read += [w for w, _ in pack]
        out.append([w for w, _ in pack])
        left -= used
        for (p, _, _), _ in pack:
            firsts(sorted(graph.get(p, ())))
        wanted = asks.get(number, [])
        firsts([p for p, a, _ in wanted if a is None])
        push([(p, a, min(b, sizes[p]), (a - 1) // 180) for p, a, b in wanted if a is not None and p in sizes], front=True)
        targets = take()
        if left <= 0:
            break
    return out


def case(kind, seed=0):
    """files by path -> text, and the edges that their imports make."""
    rng = random.Random(seed)
    names = [f"m{i:02d}.ts" for i in range(14)]
    links = {n: [] for n in names}
    for i, n in enumerate(names):
        if kind == "chain" and i + 1 < len(names):
            links[n] = [names[i + 1]]
        elif kind == "cycle":
            links[n] = [names[(i + 1) % 5], names[(i * 3) % 14]]
        elif kind == "random":
            links[n] = rng.sample(names, 2)
    text = {}
    for i, n in enumerate(names):
        head = "".join(f"import './{m[:-3]}';\n" for m in links[n])
        text[n] = head + "x\n" * (rng.choice([3, 3, 200, 500]) if kind != "chain" else 3) + "end"
    if kind != "bare":
        text["main.ts"] = "import './m00';\nimport './m01';\nend"
    links["main.ts"] = ["m00.ts", "m01.ts"]
    return text, {k: {x for x in v if x != k} for k, v in links.items()}


@pytest.mark.parametrize("kind, asks, rounds, max_files, max_chars", [
    ("chain", {}, 5, 100, 100_000), ("cycle", {2: [("m13.ts", None, None), ("m12.ts", 1, 50), ("gone.ts", 1, 2)]}, 6, 100, 100_000), ("random", {1: [("m09.ts", 181, 900), ("m08.ts", 1, 180)], 3: [("m07.ts", None, None)]}, 6, 7, 100_000), ("random", {}, 12, 100, 900), ("bare", {}, 4, 3, 5_000),
])
def test_walk_as_a_plain_queue(spark, kind, asks, rounds, max_files, max_chars):
    text, graph = case(kind, 3)
    tree = code(spark, text)
    results = spark.createDataFrame([], RESULTS)
    walk = audit.Walk(tree, results, ["m05.ts"], max_files)
    order = [r["path"] for r in walk.ranked.orderBy("rank").collect()]
    assert set(order) == set(text)

    def review(this):
        wanted = asks.get(this.number)
        return spark.createDataFrame([(p, a, b, i) for i, (p, a, b) in enumerate(wanted)], audit.ASKED) if wanted else None

    got = walk.run(review, rounds, max_chars)
    sizes = {p: len(t.split("\n")) for p, t in text.items()}
    want = plain_walk(order, {"main.ts"}, graph, sizes, ["m05.ts"], asks, rounds, max_files, max_chars, text)
    assert [r.ranges for r in got] == want and len(want) > 1
    assert sum(r.chars for r in got) <= max_chars


GOOD = '{"verdict": "true_positive", "confidence": "high", "reason": "r"}'
FULL = '{"title": "t", "category": "xss", "severity": "high", "confidence": "high", "status": "suspected"}'
PATHS = [
    # attempts as (response, error) -> outcome, next, at
    ([(GOOD, None)], "valid", None, 1), ([(FULL, None)], "valid", None, 1), ([("no", None)], "pending", "ask", 1), ([("no", None), (GOOD, None)], "valid", None, 2), ([("no", None), ("no", None)], "pending", "repair", 2), ([("no", None), ("no", None), (GOOD, None)], "valid", None, 3),
    ([("no", None), ("no", None), ("no", None)], "fallback", None, 3), ([("no", None), (" ", None)], "fallback", None, 2), ([(None, "429 rate limit")], "pending", "retry", 1), ([(None, "429 rate limit"), (GOOD, None)], "valid", None, 2), ([(None, "429"), (None, "503")], "failed", None, 2),
    ([(None, "401 unauthorized")], "failed", None, 1), ([("no", None), (None, "timeout"), ("no", None)], "pending", "repair", 3), ([("no", None), ("no", None), (None, "timeout")], "pending", "repair-retry", 3), ([("no", None), ("no", None), (None, "timeout"), (GOOD, None)], "valid", None, 4),
    ([("no", None), ("no", None), (None, "timeout"), (None, "timeout")], "failed", None, 4), ([(GOOD, None), ("no", None)], "valid", None, 1), ([("", None), ("no", None)], "pending", "repair", 2),
]


def test_every_path_of_a_chain(spark):
    rows = [(k, n, response, error) for k, (attempts, *_) in enumerate(PATHS) for n, (response, error) in enumerate(attempts, 1)]
    df = spark.createDataFrame(rows, "key int, attempt int, response string, error string").repartition(3)
    got = {r["key"]: (r["outcome"], r["next"], r["at"]) for r in modelio.settle(df, "key").collect()}
    assert got == {k: tuple(want) for k, (_, *want) in enumerate(PATHS)}


class Fake:
    """Answers by script: the n-th request of a key gets its n-th answer; remembers what was asked."""

    def __init__(self, spark, script):
        self.spark, self.script, self.asked = spark, script, []

    def complete(self, requests):
        rows = requests.collect()
        self.asked += [(r["key"], r["purpose"], r["previous"]) for r in rows]
        at = {r["key"]: sum(k == r["key"] for k, *_ in self.asked) - 1 for r in rows}
        return self.spark.createDataFrame([(r["key"], *self.script[r["key"]][at[r["key"]]]) for r in rows], "key int, response string, error string")


def test_a_scorer_is_asked_until_all_is_settled(spark):
    script = {0: [(GOOD, None)], 1: [("no", None), ("worse", None), (FULL, None)], 2: [(None, "503"), ("no", None), ("", None)], 3: [(None, "403")], 4: [("a", None), ("b", None), (None, "429"), ("c", None)]}
    fake = Fake(spark, script)
    requests = spark.createDataFrame([(k, f"p{k}", "more") for k in script], "key int, prompt string, other string")
    got = {r["key"]: (r["outcome"], r["response"]) for r in modelio.answered(requests, "key", fake).collect()}
    assert got == {0: ("valid", GOOD), 1: ("valid", FULL), 2: ("fallback", ""), 3: ("failed", None), 4: ("fallback", "c")}
    assert [(k, p) for k, p, _ in fake.asked if k == 4] == [(4, "ask"), (4, "ask"), (4, "repair"), (4, "repair-retry")]
    assert (1, "repair", "worse") in fake.asked and len(fake.asked) == 12
    assert modelio.answered(requests.where("false"), "key", fake).count() == 0


def test_points_in_ranges_by_a_sweep(spark):
    rng = random.Random(4)
    pts = [(rng.choice(["a", "b", None]), rng.choice([*range(30), None]), {"m": i}) for i in range(300)]
    rngs = [(rng.choice(["a", "b", "c", None]), a, a + rng.randrange(-2, 9), rng.choice([*range(50), None])) for a in (rng.randrange(30) for _ in range(60))]
    points, ranges = spark.createDataFrame(pts, "path string, line int, extra map<string,int>"), spark.createDataFrame(rngs, "path string, start_line int, end_line int, ord int")
    holds = lambda p, r: p[0] is not None and p[1] is not None and p[0] == r[0] and r[1] <= p[1] <= r[2]
    first = {i: min((r[3] for r in rngs if holds(p, r) and r[3] is not None), default="none" if any(holds(p, r) for r in rngs) else None) for i, p in enumerate(pts)}
    got = {r["extra"]["m"]: (r["hit"] and ("none" if r["hit"]["ord"] is None else r["hit"]["ord"])) for r in core.range_first(points, ranges, "path", "line", "ord").collect()}
    assert got == first and len(got) == 300
    inside = {i for i, h in first.items() if h is not None}
    assert {r["extra"]["m"] for r in core.range_semi(points, ranges, "path", "line").collect()} == inside
    assert {r["extra"]["m"] for r in core.range_semi(points, ranges, "path", "line", anti=True).collect()} == set(range(300)) - inside


def test_a_million_points_and_ranges_of_one_file(spark):
    n = 1_000_000
    points = spark.range(n).select(F.lit("one").alias("path"), F.col("id").alias("line"))
    ranges = spark.range(n).select(F.lit("one").alias("path"), F.col("id").alias("start_line"), (F.col("id") + 50_000).alias("end_line"), (-F.col("id")).alias("ord"))
    assert core.range_semi(points, ranges, "path", "line").count() == n
    few = core.range_first(points.where("line % 10 = 0"), ranges.where("start_line % 10 = 0"), "path", "line", "ord")
    assert few.where("hit.start_line <> line").count() == 0


def test_rule_order_does_not_change_with_the_number_of_rules(spark):
    rows = spark.createDataFrame([("x",)], "s string")
    for extra in (0, 500, 1500):
        rules = spark.createDataFrame([("b", "x", 1), ("a", "x", 1)] + [(f"z{i}", "never", 0) for i in range(extra)], "name string, regex string, ord int")
        assert core.theta_first(rows, rules, lambda rule: F.rlike(F.col("s"), rule["regex"]), "ord").first()["rule"]["name"] == "a"
