"""Column -> Column helpers over texts: lines, windows, regex hits, redaction, fingerprints."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEWLINE = r"\r?\n"


def lines(text: Column) -> Column:
    """Lines of a text; an empty text is one empty line, a null has none."""
    return F.split(text, NEWLINE, -1)


def line_count(text: Column) -> Column:
    """0 for an empty text, else the number of lines."""
    return F.when(text == "", 0).otherwise(F.size(lines(text)))


def explode_lines(files: DataFrame, text: str = "content") -> DataFrame:
    """One row a line: the other columns, ``lines`` (the file's array), ``i`` (from 0) and ``line``."""
    return files.withColumn("lines", lines(F.col(text))).select("*", F.posexplode("lines").alias("i", "line"))


def trim(text: Column) -> Column:
    """Strip all white space, not spaces alone."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def matches(text: Column, pattern: str) -> Column:
    """Whether a literal pattern occurs; false for null."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def line_slice(array: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1, inclusive, clamped) as one text."""
    a = F.greatest(first, F.lit(1))
    n = F.greatest(F.least(last, F.size(array)) - a + 1, F.lit(0))
    return F.array_join(F.slice(array, a, n), "\n")


def window(array: Column, i: Column, before: int, after: int) -> Column:
    """Lines i - before to i + after (i from 0) as one text."""
    return line_slice(array, i + 1 - before, i + 1 + after)


_OPENS = r"\b(function|async function|=>)\b|[{]\s*$"
_CLOSES = r"^\s*\}\)?;?\s*$"


def function_window(array: Column, i: Column, radius: int) -> Column:
    """The window of ``radius``, cut at the nearest line above that opens a function and the first below that closes one."""
    low, high = F.greatest(i - radius, F.lit(0)), F.least(i + radius, F.size(array) - 1)
    opened = F.array_max(F.filter(F.sequence(low, i), lambda k: F.get(array, k).rlike(_OPENS)))
    closed = F.array_min(F.filter(F.sequence(i, high), lambda k: F.get(array, k).rlike(_CLOSES)))
    return line_slice(array, F.coalesce(opened, low) + 1, F.coalesce(closed, high) + 1)


def numbered(array: Column, first: Column, width: int = 0) -> Column:
    """``n: line`` for each line, numbers padded on the left to ``width``."""
    number = lambda k: F.lpad((first + k).cast("string"), width, " ") if width else (first + k).cast("string")
    return F.array_join(F.transform(array, lambda line, k: F.concat(number(k), F.lit(": "), line)), "\n")


def line_at(text: Column, offset: Column) -> Column:
    """Line (from 1) that holds the character at an offset from 0."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1


def required_literals(pattern: str, fold: bool = True) -> list[str]:
    """Texts of which one occurs wherever the pattern matches, in lower case unless ``fold`` is false; empty where none are known.

    From the standard library's parse of the pattern: of a sequence the part with the longest
    texts, of alternatives all of theirs, of a repetition those of its body if it occurs at all.
    """
    from re import _parser as parser

    def best(options: list[list[str]]) -> list[str]:
        return max((o for o in options if o and all(t.isascii() for t in o)), key=lambda o: (min(map(len, o)), -len(o)), default=[])

    def walk(items) -> list[str]:
        options, run = [], ""
        for op, value in [*items, (None, None)]:
            if op is parser.LITERAL:
                run += chr(value).lower() if fold else chr(value)
                continue
            options.append([run] if run else [])
            run = ""
            if op is parser.SUBPATTERN:
                options.append(walk(value[-1]))
            elif op is parser.BRANCH:
                parts = [walk(branch) for branch in value[1]]
                options.append([t for p in parts for t in p] if all(parts) else [])
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] > 0:
                options.append(walk(value[2]))
        return best(options)

    try:
        found = walk(parser.parse(pattern))
    except re.error:
        return []
    # A text that holds another one of the list adds nothing.
    least = sorted(t for t in set(found) if not any(o in t and o != t for o in found))
    return least if found and min(map(len, found)) > 1 else []


def may_match(text: Column, low: Column, pattern: str) -> Column:
    """False only where the pattern cannot match: none of the texts that it needs is there. ``low`` is the text in lower case.

    A search for a plain text costs a small part of a search for a pattern.
    """
    anycase = re.match(r"\(\?[a-z]*i", pattern) is not None
    need = [(low if anycase else text).contains(t) for t in required_literals(pattern, anycase)]
    return reduce(lambda a, b: a | b, need) if need else F.lit(True)


#: Characters that no text is meant to hold (Unicode noncharacters); where one does, it is read as U+FFFD.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def hits(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """All matches of a pattern as array<struct<line:int,hit:string>>, lines by the match's start.

    One pass puts a mark before and after each match; lines and matches then come from plain splits,
    linear in the text and in the number of matches. A group other than 0 takes a second pass.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    clean = F.when(text.contains(_OPEN) | text.contains(_CLOSE), F.translate(text, _OPEN + _CLOSE, "\ufffd\ufffd")).otherwise(text)
    marked = F.regexp_replace(clean, pattern, F.lit(f"{_OPEN}$0{_CLOSE}"))
    grouped = marked if not group else F.regexp_replace(clean, pattern, F.lit(f"{_OPEN}${group}{_CLOSE}$0"))
    both = F.array(F.struct(marked.alias("m"), *([grouped.alias("g")] if group else [])))

    def located(s: Column) -> Column:
        many = lambda line: F.length(line) - F.length(F.replace(line, F.lit(_OPEN)))
        at = F.flatten(F.transform(F.split(s["m"], "\n", -1), lambda line, i: F.array_repeat(i + 1, many(line))))
        parts = F.split(s["g" if group else "m"], _OPEN, -1)
        found = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.substring_index(p, _CLOSE, 1))
        return F.zip_with(at, found, lambda line, hit: F.struct(line.cast("int").alias("line"), hit.alias("hit")))

    empty = F.array().cast("array<struct<line:int,hit:string>>")
    # An array of one binds the marked text, so that it is made once.
    return F.coalesce(F.get(F.transform(both, lambda s: F.when(s["m"].contains(_OPEN), located(s)).otherwise(empty)), F.lit(0)), empty)


# What is redacted, in this order. The second pattern stops at a backslash or the
# letter n, as the original does.
REDACTIONS = (
    (r"(?i)Authorization:\s*Bearer\s+[A-Za-z0-9._~+/=-]+", "[REDACTED]"),
    (r"(?i)Cookie:\s*[^\\n]+", "[REDACTED]"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[REDACTED]"),
    (r"\b(?:sk|pk|ghp|glpat|xox[baprs])-?[A-Za-z0-9_]{16,}\b", "[REDACTED]"),
    (r"(?i)((?:api[_-]?key|token|password|secret|passwd|pwd)\s*[:=]\s*['\"]?)[^'\"\s]+", "$1[REDACTED]"),
)


def redact(text: Column) -> Column:
    for pattern, by in REDACTIONS:
        text = F.regexp_replace(text, pattern, by)
    return text


def redactable(text: Column) -> Column:
    """Whether ``redact`` may change some of the lines of a text: false only where it changes no run of them.

    A pattern that matches in some of the lines, after those before it were replaced there, matches in
    all of them: its edges are word boundaries at most, which a line's end is too, and what a
    replacement puts in place of a match stands for characters that serve as well.
    """
    return reduce(lambda a, b: a | b, [matches(text, pattern) for pattern, _ in REDACTIONS])


def or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def normal_path(path: Column, lower: bool = False, dot: bool = True, root: bool = False, mount: bool = False, default: str | None = None) -> Column:
    """One path normaliser; flags tell which variant a caller needs (mount: a leading /src/)."""
    out = F.replace(path if default is None else F.coalesce(path, F.lit(default)), F.lit("\\"), F.lit("/"))
    if dot:
        out = F.regexp_replace(out, r"^\./", "")
    if mount:
        out = F.regexp_replace(out, "^/src/", "")
    if root:
        out = F.regexp_replace(out, "^/+", "")
    return F.lower(out) if lower else out


def mounted_path(path: Column, repo: str = "/repo") -> Column:
    """A scanner's path inside its container (/src/x, ../src/x, an absolute one) relative to the repository."""
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    relative = F.regexp_replace(unix, r"^(?:\.\./)+src/", "")
    return F.when(unix.startswith("/src/"), F.substr(unix, F.lit(6))).when(relative != unix, relative).when(unix.startswith(repo.rstrip("/") + "/"), F.substr(unix, F.lit(len(repo.rstrip("/")) + 2))).otherwise(unix)


def extension(path: Column) -> Column:
    """The last dot and what follows in the file's name; empty for none or for a name that only starts with one."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


_TITLE_NOISE = r"\b(candidate|detected|finding|usage of)\b"


def fingerprint_title(title: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(or_empty(title)), _TITLE_NOISE, ""))


def baseline_title(title: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(or_empty(title), r"\s+", " "), r"(?i)\b(candidate|detected|finding)\b", ""))


def token(text: Column) -> Column:
    """Lower case, runs of _ and - as a dot, anything else outside [a-z0-9.`()] as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(or_empty(text)), "[_-]+", "."), "[^a-z0-9.`()]+", " "))


def semantic_title(title: Column) -> Column:
    return squeeze(F.regexp_replace(token(title), r"\b(candidate|detected|finding|usage of|default|configuration|settings)\b", ""))


def loose(text: Column) -> Column:
    """Words of a title as lower-case letters and digits."""
    return F.trim(F.regexp_replace(F.lower(or_empty(text)), "[^a-z0-9]+", " "))


def title_words(title: Column) -> Column:
    """Distinct words of a title of more than three characters."""
    return F.array_distinct(F.filter(F.split(loose(title), " "), lambda w: F.length(w) > 3))


def words_overlap(x: Column, y: Column) -> Column:
    """Shared words of two titles (``title_words``) over the smaller number of words."""
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))


def title_overlap(a: Column, b: Column) -> Column:
    """Shared words of more than three characters over the smaller title's number of them; where pairs are many, cut the titles before they meet."""
    return words_overlap(title_words(a), title_words(b))


def short_hash(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts between pipes; a null is empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[or_empty(p) for p in parts]), 256), 1, 16)


def fingerprint_bucket(line: Column) -> Column:
    """Line in steps of five, at least 1, as text; empty for none or 0."""
    return F.when(F.coalesce(line, F.lit(0)) == 0, "").otherwise(F.greatest(F.lit(1), (F.floor(line / 5) * 5)).cast("string"))


def semantic_bucket(line: Column, width: Column) -> Column:
    return F.when(F.coalesce(line, F.lit(0)) == 0, "unknown").otherwise(F.floor((F.greatest(F.lit(1), line) - 1) / width).cast("string"))


def candidate_bucket(line: Column) -> Column:
    return F.floor((line - 1) / 5)


def result_fingerprint() -> Column:
    return short_hash(F.lit("scanner"), F.col("scanner"), F.col("rule_id"), normal_path(or_empty(F.col("path"))), fingerprint_bucket(F.col("start_line")), fingerprint_title(F.col("title")))


def finding_fingerprint() -> Column:
    return short_hash(F.lit("finding"), F.col("category"), F.col("severity"), normal_path(or_empty(F.col("path"))), fingerprint_bucket(F.col("start_line")), fingerprint_title(F.col("title")), F.coalesce(F.col("sink"), F.col("scanner_source")))


def derived_fingerprint() -> Column:
    """The stored fingerprint, or one of the row's fields where there is none."""
    made = F.lower(F.concat_ws("|", *[or_empty(F.col(c)) for c in ("category", "severity", "path", "start_line")], baseline_title(F.col("title")), F.split(or_empty(F.col("source")), "[/:]")[0]))
    return F.when(or_empty(F.col("fingerprint")) != "", F.col("fingerprint")).otherwise(made)


def first_sentence(text: Column) -> Column:
    return F.substring(F.split(F.regexp_replace(or_empty(text), r"\s+", " "), r"(?<=[.!?])\s+")[0], 1, 400)


def summary(text: Column, most: int) -> Column:
    """Text without code fences and heading marks, squeezed and cut."""
    plain = F.regexp_replace(F.regexp_replace(or_empty(text), r"(?s)```.*?```", "[code sample omitted]"), r"#+\s*", "")
    return F.substring(squeeze(plain), 1, most)


def _unless_empty(text: Column, default: str) -> Column:
    """The text, or the default for an empty one; a variable of its own, since a condition and its branch are each worked out."""
    return F.get(F.transform(F.array(text), lambda out: F.when(out == "", default).otherwise(out)), F.lit(0))


def slug(text: Column, default: str) -> Column:
    return _unless_empty(F.replace(loose(text), F.lit(" "), F.lit("-")), default)


def html_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def table_cell(text: Column) -> Column:
    """One line, pipes escaped."""
    return squeeze(F.replace(or_empty(text), F.lit("|"), F.lit("\\|")))


def yaml_quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(or_empty(text), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def trace_preview(text: Column, most: int = 600) -> Column:
    return F.substring(squeeze(redact(or_empty(text))), 1, most)


def file_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd-HHmmss")


def safe_name(text: Column, default: str = "codebase") -> Column:
    return _unless_empty(F.btrim(F.regexp_replace(or_empty(text), "[^A-Za-z0-9._-]+", "-"), F.lit("-")), default)


def package_name(raw: Column, title: Column) -> Column:
    """Package of a dependency result: from its JSON, else what precedes the title's first colon."""
    at = [F.get_json_object(raw, p) for p in ("$.PkgName", "$.packageName", "$.package.name", "$.name")]
    return trim(F.coalesce(*at, F.split(title, ":")[0], F.lit("unknown")))
