"""Data flow inside and between files: functions, sources, sinks, and how one reaches the other.

Order inside a file decides what a variable holds, so each file is folded on its own, a row at a
time in Arrow batches; files are bounded in size and nothing is shuffled. What links files (a call
to a function whose parameter reaches a sink) is an equi-join on the function's name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import rules as R
from siltstone.functions.text import explode_lines, extension, matches, trim
from siltstone.operators.core import first_wins
from siltstone.schemas import FILE_SPAN, RESULTS, columns_of
from siltstone.session import ship

_LINES = re.compile(r"\r?\n")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_SOURCE, _SANITIZER = re.compile(R.SOURCE), re.compile(R.SANITIZER)
_LITE_SOURCE, _LITE_SANITIZER, _ASSIGN = re.compile(R.LITE_SOURCE), re.compile(R.LITE_SANITIZER), re.compile(R.ASSIGNMENT)
_SINKS = [(i, c, t, re.compile(p)) for i, c, t, p in R.SINKS]
_LITE_SINKS = [(i, c, t, re.compile(p), cwe) for i, c, t, p, cwe in R.LITE_SINKS]
_SUFFICIENT = {k: re.compile(p) for k, p in R.SUFFICIENT.items()}
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _per_file(files: DataFrame, fold, ddl: str) -> DataFrame:
    """Rows that ``fold(path, lines, ord)`` yields for each supported file."""
    ship(files.sparkSession)
    fields = [x.rsplit(" ", 1) for x in ddl.split(", ")]
    schema = pa.schema([(n, _KINDS[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, c, o in zip(*(batch.column(i).to_pylist() for i in range(3))) for r in fold(p, _LINES.split(c or ""), o)]
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    kept = files.where(extension(F.col("path")).isin(*R.FLOW_EXTENSIONS))
    return kept.select("path", "content", "ord").mapInArrow(run, ddl)


def _named(name: str) -> re.Pattern:
    return re.compile(rf"\b{re.escape(name)}\b")


def _owasp(category: str) -> str:
    return "A10:2021-Server-Side Request Forgery" if category == "ssrf" else "A03:2021-Injection"


def _lite(path: str, text: list[str], order: int):
    """Variables that hold outside input, forwards through assignments; their use, or the input itself, in a sink."""
    tainted: dict[str, tuple[int, re.Pattern]] = {}
    seen, nth = set(), 0
    for no, line in enumerate(text, 1):
        found = _ASSIGN.match(line)
        if found and (_LITE_SOURCE.search(found[2]) or any(p.search(found[2]) for _, p in tainted.values())):
            # An update keeps the variable's place, as its first assignment made it.
            tainted[found[1]] = (no, tainted[found[1]][1] if found[1] in tainted else _named(found[1]))
        sink = next((s for s in _LITE_SINKS if s[3].search(line)), None)
        if sink is None or _LITE_SANITIZER.search(line):
            continue
        hits = [(sink[0], f"Variable {name} assigned from user-controlled source at line {at} reaches sink at line {no}.", {"sourceLine": at, "sinkLine": no, "variable": name}) for name, (at, p) in tainted.items() if p.search(line)]
        if _LITE_SOURCE.search(line):
            hits.append((f"{sink[0]}-direct", "User-controlled source appears directly inside dangerous sink.", {"sourceLine": no, "sinkLine": no}))
        for rule, message, raw in hits:
            if (no, rule) not in seen:
                seen.add((no, rule))
                yield ("taint-lite", rule, sink[2], sink[1], "high", path, no, no, message, json.dumps(raw | {"cwe": sink[4], "owasp": _owasp(sink[1])}), order * FILE_SPAN + nth)
                nth += 1


def taint_lite(files: DataFrame) -> DataFrame:
    return _per_file(files, _lite, RESULTS)


_JS = (re.compile(r"^\s*(export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(([^)]*)\)"), re.compile(r"^\s*(export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>"), re.compile(r"^\s*(export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?([A-Za-z_$][\w$]*)\s*=>"))
_DEF = {".py": re.compile(r"^\s*def\s+([A-Za-z_]\w*)\s*\(([^)]*)\)\s*:"), ".php": re.compile(r"^\s*(?:public|private|protected)?\s*function\s+([A-Za-z_]\w*)\s*\(([^)]*)\)"), ".rb": re.compile(r"^\s*def\s+([A-Za-z_][\w!?=]*)\s*(?:\(([^)]*)\)|\s+([^#]+))?")}


def _signature(line: str, ext: str) -> tuple[str, list[str], bool] | None:
    """Name, parameters and whether it is exported, of a line that declares a function."""
    if ext in R.JS:
        found = next(filter(None, (p.match(line) for p in _JS)), None)
        parts = (found[2], found[3], bool(found[1])) if found else None
    else:
        found = _DEF[ext].match(line)
        parts = (found[1], next((g for g in found.groups()[1:] if g is not None), ""), True) if found else None
    if not parts:
        return None
    clean = lambda p: re.sub(r"^\$", "", re.sub(r"^\.\.\.", "", re.sub(r"=.*", "", re.sub(r"[?:].*$", "", p.strip()))))
    names = [n for n in map(clean, parts[1].split(",")) if n]
    return parts[0], [n for n in names if n not in ("self", "cls")] if ext == ".py" else names, parts[2]


def _ends(text: list[str], start: int, ext: str) -> int:
    """Last line (from 1) of the function that starts at index ``start``: by indent, else by braces, 80 lines without any."""
    if ext in (".py", ".rb"):
        indent = len(text[start]) - len(text[start].lstrip())
        for i in range(start + 1, len(text)):
            if text[i].strip() and len(text[i]) - len(text[i].lstrip()) <= indent:
                return i
        return len(text)
    depth, opened = 0, False
    for i in range(start, len(text)):
        depth += text[i].count("{") - text[i].count("}")
        opened = opened or "{" in text[i]
        if opened and depth <= 0:
            return i + 1
    return min(len(text), start + 80)


def _ext(path: str) -> str:
    return "." + path.rsplit(".", 1)[-1]


def _functions(path: str, text: list[str], order: int):
    for i, line in enumerate(text):
        found = _signature(line, _ext(path))
        if found:
            yield (path, found[0], found[1], i + 1, _ends(text, i, _ext(path)), found[2], order * FILE_SPAN + i)


def functions(files: DataFrame) -> DataFrame:
    return _per_file(files, _functions, "path string, name string, params array<string>, start_line int, end_line int, exported boolean, ord long")


def _sink_of(line: str):
    return next((s for s in _SINKS if s[3].search(line)), None)


def occurrences(files: DataFrame) -> DataFrame:
    """kind (source or sink), path, line, code, and a sink's id, category and title; lines are tested by patterns in the JVM."""
    rows = explode_lines(files.where(extension(F.col("path")).isin(*R.FLOW_EXTENSIONS)))
    sink: Column = F.lit(None).cast("struct<sink_id:string,category:string,title:string>")
    for i, c, t, p in reversed(R.SINKS):
        sink = F.when(matches(F.col("line"), p), F.struct(F.lit(i).alias("sink_id"), F.lit(c).alias("category"), F.lit(t).alias("title"))).otherwise(sink)
    source = matches(F.col("line"), R.SOURCE)
    both = F.array_compact(F.array(F.when(source, F.struct(F.lit("source").alias("kind"), F.lit(None).cast("struct<sink_id:string,category:string,title:string>").alias("s"))), F.when(sink.isNotNull(), F.struct(F.lit("sink").alias("kind"), sink.alias("s")))))
    out = rows.select("path", (F.col("i") + 1).alias("line"), F.substring(trim(F.col("line")), 1, 220).alias("code"), (F.col("ord") * FILE_SPAN + F.col("i")).alias("ord"), F.explode(both).alias("b"))
    return out.select("b.kind", "path", "line", "code", "b.s.sink_id", "b.s.category", "b.s.title", "ord")


def _models(path: str, text: list[str], order: int):
    """Functions one of whose parameters stands in a line with a sink: a row a parameter."""
    for i, line in enumerate(text):
        found = _signature(line, _ext(path))
        if not found:
            continue
        name, params, _ = found
        for j in range(i, _ends(text, i, _ext(path))):
            sink = _sink_of(text[j])
            if sink is None or _SANITIZER.search(text[j]):
                continue
            for k, p in enumerate(params):
                if _named(p).search(text[j]):
                    yield (path, name, params, i + 1, k, p, sink[0], sink[1], sink[2], j + 1, (order * 100_000 + i) * 1000 + min(j - i, 999))


_MODEL = "path string, name string, params array<string>, start_line int, at int, param string, sink_id string, category string, title string, sink_line int, ord long"


def function_sinks(files: DataFrame) -> DataFrame:
    return _per_file(files, _models, _MODEL)


def interprocedural(files: DataFrame) -> DataFrame:
    """Calls that pass outside input to a parameter that reaches a sink: calls and models meet by name."""
    rows = explode_lines(files).where(matches(F.col("line"), R.SOURCE) & ~matches(F.col("line"), R.SANITIZER))
    call = r"([A-Za-z_$][\w$]*)\s*\(([^)]*)\)"
    pairs = F.arrays_zip(F.regexp_extract_all("line", F.lit(call), F.lit(1)).alias("name"), F.regexp_extract_all("line", F.lit(call), F.lit(2)).alias("args"))
    calls = rows.select(F.col("path").alias("call_path"), (F.col("i") + 1).alias("call_line"), F.col("ord").alias("file_ord"), F.posexplode(pairs).alias("k", "c"))
    # The first call of a name on a line counts.
    calls = first_wins(calls.select("call_path", "call_line", "file_ord", "k", F.col("c.name").alias("name"), F.col("c.args").alias("args")), ["call_path", "call_line", "name"], ["k"])
    args = F.filter(F.transform(F.split("args", ","), trim), lambda a: a != "")
    hit = calls.join(function_sinks(files), "name").withColumn("arg", F.get(args, F.col("at"))).where(matches(F.col("arg"), R.SOURCE))
    hit = first_wins(hit, ["call_path", "call_line", "path", "start_line", "sink_line", "sink_id"], ["at"])
    reach = F.concat(F.lit("reaches "), F.col("category"), F.lit(" sink"))
    step = lambda p, n, s: F.struct(p.alias("path"), n.alias("line"), s.alias("step"))
    steps = F.array(step(F.col("call_path"), F.col("call_line"), F.lit("user-controlled argument at call site")), step(F.col("path"), F.col("start_line"), F.concat(F.lit("enters "), F.col("name"), F.lit("("), F.array_join("params", ", "), F.lit(")"))), step(F.col("path"), F.col("sink_line"), reach))
    message = F.concat(F.lit("User-controlled argument flows into "), F.col("name"), F.lit(" parameter "), F.col("param"), F.lit(", which "), reach, F.lit(" at "), F.col("path"), F.lit(":"), F.col("sink_line").cast("string"), F.lit("."))
    raw = F.to_json(F.struct(F.col("call_line").alias("sourceLine"), F.col("sink_line").alias("sinkLine"), F.col("path").alias("sinkPath"), F.col("name").alias("function"), F.col("param").alias("parameter"), steps.alias("dataFlow")))
    return _flow(hit, F.concat("sink_id", F.lit("-interprocedural")), F.col("call_path"), F.col("call_line"), message, raw, F.col("ord") * 1000 + F.col("file_ord"))


def _flow(df: DataFrame, rule: Column, path: Column, line: Column, message: Column, raw: Column, order: Column) -> DataFrame:
    made = {"scanner": F.lit("taint-flow"), "rule_id": rule, "title": F.col("title"), "category": F.col("category"), "severity": F.when(F.col("category") == "xss", "medium").otherwise("high"), "path": path, "start_line": line, "end_line": line, "message": message, "raw": raw, "ord": order}
    return df.select(*[made[c].alias(c) for c in columns_of(RESULTS)])


def _assigned(line: str, name: str) -> str | None:
    found = re.search(rf"\b(?:const|let|var)\s+{re.escape(name)}\s*=\s*(.+?);?\s*$", line) or re.search(rf"\b{re.escape(name)}\s*=\s*(.+?);?\s*$", line)
    return found[1] if found else None


def _traced(name: str, text: list[str], first: int, last: int, category: str):
    """Backwards from a sink's variable to outside input: (line, expression, steps, sanitizers), or None."""
    now, steps, cleaners = name, [(last, f"{name} reaches {category} sink")], []
    for no in range(last, first - 1, -1):
        line = text[no - 1]
        value = _assigned(line, now)
        if value is None:
            if _SANITIZER.search(line) and _named(now).search(line):
                cleaners.append((no, line.strip()[:220]))
            continue
        steps.append((no, f"{now} assigned from {value[:120]}"))
        if _SANITIZER.search(value) or _SANITIZER.search(line):
            cleaners.append((no, line.strip()[:220]))
        if _SOURCE.search(value):
            return no, value.strip()[:220], [(no, "request-controlled source assigned to local value"), *reversed(steps)], cleaners
        following = _WORD.search(value)
        if not following or following[0] == now:
            return None
        now = following[0]
    return None


def _backtrace(path: str, text: list[str], order: int):
    spans = [(i + 1, _ends(text, i, _ext(path))) for i, line in enumerate(text) if _signature(line, _ext(path))]
    seen, nth = set(), 0
    for no, whole in enumerate(text, 1):
        sink = _sink_of(whole)
        if sink is None:
            continue
        code = whole.strip()[:220]
        first = next((a for a, b in spans if a <= no <= b), max(1, no - 40))
        inner = re.search(r"\((.*)\)", code)
        names = [n for n in _WORD.findall(inner[1] if inner else code) if n not in R.NOT_VARIABLES and not re.fullmatch("[A-Z_]+", n)]
        found, direct = [], True
        for name in list(dict.fromkeys(names))[:8]:
            got = _traced(name, text, first, no, sink[1])
            if got is None:
                continue
            cleaners = "\n".join(c for _, c in got[3])
            if cleaners and _SUFFICIENT.get(sink[1], _SUFFICIENT[None]).search(cleaners):
                continue
            why = f"Sanitizer-like code exists, but it is not clearly sufficient for {sink[1]}." if cleaners else "No sanitizer or guard was found between source and sink."
            found.append((got[0], got[1], got[2], got[3], why))
            direct = direct and got[0] != no
        if direct and _SOURCE.search(code):
            found.append((no, code, [(no, "request-controlled source appears directly in sink call")], [], "No context-appropriate sanitizer appears before the sink."))
        for at, expression, steps, cleaners, why in found:
            if (at, no, sink[0]) in seen:
                continue
            seen.add((at, no, sink[0]))
            raw = {"sourceLine": at, "sinkLine": no, "dataFlow": [{"path": path, "line": n, "step": s} for n, s in steps], "sanitizerAssessment": {"sanitizers": [{"path": path, "line": n, "code": c} for n, c in cleaners], "sufficient": False, "reason": why}}
            message = f"Sink-first trace found {expression} reaching {sink[1]} sink without a context-sufficient sanitizer."
            yield ("taint-flow", f"{sink[0]}-sink-backtrace", sink[2], sink[1], "medium" if sink[1] == "xss" else "high", path, no, no, message, json.dumps(raw), order * FILE_SPAN + nth)
            nth += 1


def backtraces(files: DataFrame) -> DataFrame:
    """Every sink that outside input reaches inside its function, with the steps and the cleaners on the way."""
    return _per_file(files, _backtrace, RESULTS)


def direct_sinks(files: DataFrame) -> DataFrame:
    """Lines that hold both outside input and a sink, and no cleaner."""
    rows = occurrences(files).where("kind = 'sink'")
    hit = rows.where(matches(F.col("code"), R.SOURCE) & ~matches(F.col("code"), R.SANITIZER))
    step = F.array(F.struct("path", "line", F.lit("source reaches sink on same line").alias("step")))
    raw = F.to_json(F.struct(F.col("line").alias("sourceLine"), F.col("line").alias("sinkLine"), step.alias("dataFlow")))
    return _flow(hit, F.concat("sink_id", F.lit("-direct")), F.col("path"), F.col("line"), F.lit("User-controlled source appears directly inside dangerous sink."), raw, F.col("ord"))


def taint_flow(files: DataFrame) -> DataFrame:
    """Calls, same-line flows and backtraces; unique by path, line and rule, in that order of kinds."""
    parts = [interprocedural(files), direct_sinks(files), backtraces(files)]
    every = parts[0].withColumn("_n", F.lit(0))
    for n, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("_n", F.lit(n)))
    return first_wins(every, ["path", "start_line", "rule_id"], ["_n", "ord"]).drop("_n")
