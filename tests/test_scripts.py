"""Tokens of scripts, and what is read off them."""

import random

import pytest
from pyspark.sql import functions as F
from test_detectors import code

from siltstone.functions import tablefunctions, text
from siltstone.functions.javascript import facts_of
from siltstone.operators import imports
from siltstone.sources import files as source_files

PLAIN = "\n".join([
    "import express from 'express';", "import { thing } from './thing';", "const app = express();", "const router = express.Router();",
    "export async function handler(req, res) { res.send(req.params.id); }", "export const helper = (value: string) => value.trim();", "class LocalOnly {}",
    "app.get('/users/:id', handler);", "router.post('/items', (req, res) => res.json({ ok: true }));",
])


def named(source):
    return [(s["kind"], s["name"], s["start_line"], s["exported"]) for s in facts_of(source)["symbols"]]


def test_a_plain_module():
    found = facts_of(PLAIN)
    assert found["imports"] == ["express", "./thing"]
    assert named(PLAIN) == [("function", "handler", 5, True), ("function", "helper", 6, True), ("class", "LocalOnly", 7, False)]
    assert [(r["method"], r["route_path"], r["start_line"], r["framework"], r["handler"]) for r in found["routes"]] == [("GET", "/users/:id", 8, "express", "handler"), ("POST", "/items", 9, "express", None)]


@pytest.mark.parametrize("source, modules", [
    ("import {\n  a,\n  b as c, // with 'quotes\n} from './multi';", ["./multi"]),
    ("import d, * as n from 'both';\nimport type { T } from './types';\nimport './effect';", ["both", "./types", "./effect"]),
    ("export * from './all';\nexport * as x from './as';\nexport { a, b as c } from './some';\nexport type { Q } from './q';", ["./all", "./as", "./some", "./q"]),
    ("export const from = 'x';\nexport default from;", []),
    ("const a = require('fs'), b = require(`path`), c = require(name + 'x'), d = o.require('no');", ["fs", "path"]),
    ("const p = import('./lazy'); import.meta.url;", ["./lazy"]),
    ("// import a from 'no'\n/* require('no') */ const s = \"require('no')\";", []),
    ("const t = `require('no') ${ `inner ${ require('deep') }` } } import x from 'no'`; require('after')", ["deep", "after"]),
    ("if (x) /require('no')/.test(y); const z = a / require('yes') / 2;", ["yes"]),
    ("const r = [/[/'\"]`/, /\\//]; import('ok')", ["ok"]),
    ("const o = { a: 1 } / 2; f(); /x'/.test(s); require('end')", ["end"]),
    ("const e = <p>Don't</p>;\nrequire('jsx')", ["jsx"]),
    ("import x = require('legacy');", ["legacy"]),
    ("require('caf\\u00e9'); require('a\\x41\\u{42}\\n')", ["café", "aAB\n"]),
])
def test_imports(source, modules):
    assert facts_of(source)["imports"] == modules


@pytest.mark.parametrize("source, symbols", [
    ("@Part({ a: '}' })\n@Other\nexport default class A extends B { m() { function inner() {} } static function() {} }", [("class", "A", 1, True), ("function", "inner", 3, False)]),
    ("const e = function named() {}, k = class {}, n = 1, { d } = () => 1;\nx = class Hidden {}; foo(function cb() {});", [("function", "e", 1, False), ("class", "k", 1, False)]),
    ("let f = async <T>(a: T,\n  b: (x) => void): Promise<{ a: number }> =>\n  { }", [("function", "f", 1, False)]),
    ("const g = x => x\nconst after = 1\nfunction last() {}", [("function", "g", 1, False), ("function", "last", 3, False)]),
    ("for (const i = () => 1; ;) {}\nexport default function () {}\nexport default function named() {}\nfunction* gen() {}", [("function", "named", 3, True), ("function", "gen", 4, False)]),
    ("const t: (q: number) => string = (q) => 'x';\nconst el = <p>a</p>;\nconst c = a ? function n() {} : (b) => c;", [("function", "t", 1, False)]),
    ("abstract class P {}\ndeclare class D {}\nexport abstract class E {}", [("class", "P", 1, False), ("class", "D", 2, False), ("class", "E", 3, True)]),
])
def test_symbols(source, symbols):
    assert named(source) == symbols


def test_routes():
    source = "router\n  .route('/r')\n  .get('/a', auth, h)\n  .post(`/b`);\nexpress.Router().delete('/c', h); new App().put('/d'); a['get']('/no'); app.get(`/no/${x}`); app.get(path); app?.head('/e', x => y); get('/no')"
    assert [(r["method"], r["route_path"], r["start_line"], r["handler"]) for r in facts_of(source)["routes"]] == [("GET", "/a", 1, "auth"), ("POST", "/b", 1, None), ("DELETE", "/c", 5, "h"), ("PUT", "/d", 5, None), ("HEAD", "/e", 5, None)]


def test_any_text_gives_a_result_in_linear_time():
    rng = random.Random(1)
    pieces = ["import ", "from ", "'a'", "`", "${", "}", "{", "(", ")", "[", "]", "/", "=>", "=", "const ", "function ", "class ", "x", "\n", ";", ",", ".get(", "'/p'", "//c\n", "/*", "*/", "export ", "async ", "<", "@", "new ", '"', "\\", " ", "é"]
    for _ in range(3000):
        facts_of("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))))
    for piece in ("const a=(", "import ", "a.get('x').", "{", "`${", "function f(", "const x=<T,", "@a", "const a=(b):", "{)"):
        facts_of(piece * 20_000)


def test_facts_join_the_patterns(spark):
    tree = code(spark, {"src/a.ts": "import {\n b\n} from './b';\napi.get('/x', h);\napp.get('/y', h);\nexport const f = function () {};\n", "src/b.ts": "", "tool.py": "import os\n@app.get('/p')\ndef g(): pass\n", "none.js": None})
    modules = {(r["path"], r["module"]) for r in source_files.imports(tree).collect()}
    assert {("src/a.ts", "./b"), ("tool.py", "os")} <= modules
    routes = {(r["path"], r["method"], r["route_path"], r["start_line"]) for r in source_files.routes(tree).collect()}
    assert {("src/a.ts", "GET", "/x", 4), ("src/a.ts", "GET", "/y", 5), ("tool.py", "GET", "/p", 2)} <= routes
    found = [r["k"] for r in source_files.routes(tree.where("path = 'src/a.ts'")).orderBy("k").collect()]
    assert found == list(range(len(found)))
    assert ("src/a.ts", "f", 6) in {(r["path"], r["name"], r["start_line"]) for r in source_files.symbols(tree).collect()}
    assert {r["path"] for r in source_files.script_facts(tree).collect()} == {"src/a.ts", "src/b.ts"}


def test_paths_of_any_depth(spark):
    deep = "/".join("abcdefghij"[i % 10] + str(i) for i in range(60))
    cases = {f"{deep}/{'../' * 60}x": "x", f"{deep}/{'../' * 50}x": "/".join(deep.split("/")[:10]) + "/x", "a/./b//c/": "a/b/c", "../../x": "../../x", "a/../../x": "../x", "": "", "./": "", "/abs/../x": "x"}
    df = spark.createDataFrame(list(cases.items()), "p string, want string")
    assert [r["p"] for r in df.where(imports.resolve_folder(F.col("p")) != F.col("want")).collect()] == []


def test_import_graph_resolves_what_may_be_meant(spark):
    up = "../" * 12
    tree = code(spark, {
        "a/b/c/d/e/f/g/h/i/j/k/l/m.ts": f"import x from '{up}top';\nimport y from './n';\n", "top.ts": "import '@/in';", "top/index.js": "", "a/b/c/d/e/f/g/h/i/j/k/l/n.mjs": "", "src/in/__init__.py": "import pkg.mod\nimport near\n", "pkg/mod.py": "", "src/in/near.rb": "import '/pkg/mod'",
    })
    got = {(r["from_path"], r["to_path"]) for r in imports.import_graph(tree).collect()}
    m = "a/b/c/d/e/f/g/h/i/j/k/l/m.ts"
    assert got == {(m, "top.ts"), (m, "top/index.js"), (m, "a/b/c/d/e/f/g/h/i/j/k/l/n.mjs"), ("top.ts", "src/in/__init__.py"), ("src/in/__init__.py", "pkg/mod.py"), ("src/in/__init__.py", "src/in/near.rb"), ("src/in/near.rb", "pkg/mod.py")}


def test_table_functions_agree_with_columns(spark):
    tablefunctions.register(spark)
    df = spark.createDataFrame([(0, "a1\r\nb22\n\nc"), (1, ""), (2, None), (3, "7")], "id int, t string")
    df.createOrReplaceTempView("some_texts")
    sql = {tuple(r) for r in spark.sql("SELECT id, l.line_no, l.line FROM some_texts, LATERAL lines(t) l").collect()}
    assert sql == {(r["id"], r["i"] + 1, r["line"]) for r in text.explode_lines(df, "t").collect()}
    sql = {tuple(r) for r in spark.sql(r"SELECT id, h.line_no, h.hit FROM some_texts, LATERAL regex_hits(t, '[0-9]+') h").collect()}
    assert sql == {(r["id"], r["h"]["line"], r["h"]["hit"]) for r in df.select("id", F.explode(text.hits(F.col("t"), "[0-9]+")).alias("h")).collect()}
