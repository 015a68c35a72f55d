"""What goes to and comes from a language model, as data: usage, prices, JSON repair, verdicts, validation."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.classify import error_kind, error_retryable
from siltstone.functions.text import matches, or_empty, summary
from siltstone.operators.core import range_semi
from siltstone.schemas import CONFIDENCES, FINDINGS, SEVERITIES, STATUSES, columns_of
from siltstone.session import Scratch, fresh_name
from siltstone.sources.scanners import lenient_json

# Names under which providers report the same number; ``usage.`` inside the usage object, the rest at the top.
_USAGE = {
    "cache_write_tokens": ("usage.cache_creation_input_tokens", "usage.cacheCreationInputTokens", "cache_creation_input_tokens"),
    "cached_tokens": ("usage.cache_read_input_tokens", "usage.cacheReadInputTokens", "usage.prompt_cache_hit_tokens", "usage.promptCacheHitTokens", "usage.input_tokens_details.cached_tokens", "usage.prompt_tokens_details.cached_tokens", "usage.inputTokensDetails.cachedTokens", "usage.promptTokensDetails.cachedTokens", "cache_read_input_tokens", "prompt_cache_hit_tokens"),
    "cache_miss_tokens": ("usage.prompt_cache_miss_tokens", "usage.promptCacheMissTokens", "prompt_cache_miss_tokens"),
    "raw_input_tokens": ("usage.input_tokens", "usage.prompt_tokens", "usage.inputTokens", "usage.promptTokens", "input_tokens"),
    "output_tokens": ("usage.output_tokens", "usage.completion_tokens", "usage.outputTokens", "usage.completionTokens", "output_tokens"),
    "total_tokens": ("usage.total_tokens", "usage.totalTokens", "total_tokens"),
    "cached_input_cost": ("usage.cached_input_cost_usd", "usage.cachedInputCostUsd", "usage.cache_read_input_cost_usd", "usage.cacheReadInputCostUsd", "usage.cache_hit_cost_usd", "usage.cacheHitCostUsd", "usage.cost_details.cached_input_cost_usd", "usage.cost_details.cache_read_input_cost_usd", "usage.cost_details.cache_hit_cost_usd"),
    "input_cost": ("usage.input_cost_usd", "usage.prompt_cost_usd", "usage.inputCostUsd", "usage.promptCostUsd", "usage.input_cost", "usage.prompt_cost", "usage.cost_details.input_cost_usd", "usage.cost_details.prompt_cost_usd", "usage.cost_details.input_tokens_cost", "usage.cost_details.prompt_tokens_cost"),
    "output_cost": ("usage.output_cost_usd", "usage.completion_cost_usd", "usage.outputCostUsd", "usage.completionCostUsd", "usage.output_cost", "usage.completion_cost", "usage.cost_details.output_cost_usd", "usage.cost_details.completion_cost_usd", "usage.cost_details.output_tokens_cost", "usage.cost_details.completion_tokens_cost"),
    "cost": ("usage.cost_usd", "usage.costUsd", "usage.total_cost", "usage.totalCost", "usage.cost", "cost_usd", "costUsd", "total_cost", "cost", "billing.cost", "billing.cost_usd"),
}
MONEY = "decimal(24,12)"


def _members(paths: list[str]) -> str:
    """The type of an object with these members as texts; a dot leads into an object within."""
    inner: dict[str, list[str]] = {}
    for p in dict.fromkeys(paths):
        head, _, rest = p.partition(".")
        inner.setdefault(head, []).extend([rest] if rest else [])
    return ", ".join(f"{name}:{f'struct<{_members(below)}>' if below else 'string'}" for name, below in inner.items())


_ALL = [p for paths in _USAGE.values() for p in paths]
_OWN = [p.removeprefix("usage.") for p in _ALL if p.startswith("usage.")]
_RESPONSE = f"struct<{_members(_ALL + _OWN)}>"


def first_number(*texts: Column) -> Column:
    """The first text that is a finite number."""
    numbers = F.transform(F.array(*texts), lambda t: t.try_cast("double"))
    return F.get(F.filter(numbers, lambda n: n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))), F.lit(0))


def usage(responses: DataFrame) -> DataFrame:
    """Adds token counts and costs of each response (JSON in ``response``); a response without a usage object is one itself.

    The text is parsed once, to an object of all names that are known; the rank of a name among its number's decides.
    """
    top, own = fresh_name(responses, "top"), fresh_name(responses, "own")
    parsed = responses.withColumn(top, F.from_json("response", _RESPONSE))
    heads = dict.fromkeys(p.split(".")[0] for p in _OWN)
    flat = F.struct(*[F.col(top)[h].alias(h) for h in heads])
    rows = parsed.withColumn(own, F.when(F.col(top)["usage"].isNotNull(), F.struct(*[F.col(top)["usage"][h].alias(h) for h in heads])).otherwise(flat))

    def text(path: str) -> Column:
        out = F.col(own) if path.startswith("usage.") else F.col(top)
        for name in path.removeprefix("usage.").split("."):
            out = out[name]
        return out

    rows = rows.withColumns({f"_{k}": first_number(*map(text, paths)) for k, paths in _USAGE.items()} | {"_apart": text("usage.cache_read_input_tokens").isNotNull()})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    written, cached, missed, plain = zero("_cache_write_tokens"), zero("_cached_tokens"), F.col("_cache_miss_tokens"), F.col("_raw_input_tokens")
    apart = (written > 0) | ((cached > 0) & plain.isNotNull() & F.col("_apart"))
    given = F.when(missed.isNotNull(), missed + cached + written).when(plain.isNotNull(), plain + F.when(apart, cached + written).otherwise(0)).otherwise(cached + written)
    money = lambda c: F.col(c).cast(MONEY)
    cost = F.coalesce(money("_cost"), F.when(F.col("_input_cost").isNotNull() | F.col("_output_cost").isNotNull(), F.coalesce(money("_input_cost"), F.lit(0).cast(MONEY)) + F.coalesce(money("_output_cost"), F.lit(0).cast(MONEY))))
    return rows.select(
        *responses.columns, given.cast("long").alias("input_tokens"), cached.cast("long").alias("cached_input_tokens"), written.cast("long").alias("cache_write_input_tokens"), F.coalesce(missed, F.greatest(given - cached - written, F.lit(0.0))).cast("long").alias("uncached_input_tokens"),
        zero("_output_tokens").cast("long").alias("output_tokens"), F.coalesce(F.col("_total_tokens"), given + zero("_output_tokens")).cast("long").alias("total_tokens"), money("_cached_input_cost").alias("cached_input_cost"), money("_input_cost").alias("input_cost"), money("_output_cost").alias("output_cost"), cost.cast(MONEY).alias("cost"),
    )


def price(used: DataFrame, prices: DataFrame) -> DataFrame:
    """Fills missing costs from a price table (provider, aliases, input_per_m, cached_per_m, cache_write_per_m, output_per_m, ord).

    The first entry counts one of whose aliases the model's name, or its part after the last slash,
    equals or starts with (before a dash). The table is configuration.
    """
    from siltstone.operators.core import theta_first

    alias = prices.select(F.struct("*").alias("p"), "ord", F.explode("aliases").alias("alias")).select("p.*", F.lower("alias").alias("alias"))
    model = F.lower("model")
    tail = F.element_at(F.split(model, "/"), -1)
    fits = lambda m, rule: (m == rule["alias"]) | m.startswith(F.concat(rule["alias"], F.lit("-")))
    same = lambda rule: (F.lower(F.col("provider")) == F.lower(rule["provider"])) & rule["alias"].endswith(F.concat(F.lit("/"), tail))
    joined = theta_first(used, alias, lambda rule: fits(model, rule) | fits(tail, rule) | same(rule), "ord")
    part = lambda tokens, rate: (F.col(tokens).cast("decimal(20,0)") * rate.cast("decimal(14,6)") / F.lit(1_000_000).cast("decimal(8,0)")).cast(MONEY)
    r = F.col("rule")
    cached = F.coalesce("cached_input_cost", part("cached_input_tokens", r["cached_per_m"]))
    given = F.coalesce(F.col("input_cost"), (part("uncached_input_tokens", r["input_per_m"]) + part("cache_write_input_tokens", F.coalesce(r["cache_write_per_m"], r["input_per_m"])) + F.coalesce(cached, part("cached_input_tokens", r["input_per_m"]))).cast(MONEY))
    made = F.coalesce(F.col("output_cost"), part("output_tokens", r["output_per_m"]))
    return joined.withColumns({"cached_input_cost": cached, "input_cost": given, "output_cost": made, "cost": F.coalesce(F.col("cost"), (given + made).cast(MONEY))}).drop("rule")


def usage_summary(used: DataFrame) -> DataFrame:
    """Sums by provider, tier and model; a cost that no row has stays null."""
    tokens = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "uncached_input_tokens", "output_tokens", "total_tokens")
    costs = ("cached_input_cost", "input_cost", "output_cost", "cost")
    return used.groupBy("provider", "tier", "model").agg(F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(c) for c in tokens], *[F.sum(c).alias(c) for c in costs]).orderBy("tier", "model")


def job_summary(events: DataFrame) -> DataFrame:
    done = lambda s: F.count_if(F.col("status") == s).alias(s)
    return events.agg(F.count(F.lit(1)).alias("total"), done("succeeded"), done("failed"))


def errors(messages: DataFrame) -> DataFrame:
    """Adds ``kind`` and ``retryable`` to provider messages."""
    return messages.withColumn("kind", error_kind(F.col("message"))).withColumn("retryable", error_retryable(F.col("kind")))


def error_text(error: Column) -> Column:
    """All that a provider's error object says, between spaces."""
    paths = ("message", "status", "statusCode", "code", "type", "error.message", "error.status", "error.code", "error.type")
    v = F.try_parse_json(error)
    said = F.concat_ws(" ", *[F.try_variant_get(v, f"$.{p}", "string") for p in paths])
    return F.when(said != "", said).otherwise(F.lit("AI provider failed"))


def _scalar(v: Column, path: str, allowed: tuple[str, ...]) -> Column:
    """An enumeration's value; of a list, its first allowed text, else its first text."""
    many = F.try_variant_get(v, path, "array<string>")
    return F.coalesce(F.get(F.filter(many, lambda x: x.isin(*allowed)), F.lit(0)), F.get(many, F.lit(0)), F.try_variant_get(v, path, "string"))


def _line_of(v: Column, path: str) -> Column:
    n = F.try_variant_get(v, path, "int")
    return F.when(n > 0, n)


def unwrap(v: Column, *names: str) -> Column:
    """The object itself, or the first of these fields that holds one."""
    return F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")).startswith("OBJECT"), F.try_variant_get(v, f"$.{n}", "variant")) for n in names], v)


def finding_rows(responses: DataFrame) -> DataFrame:
    """Findings from model responses (``response`` text): lenient JSON, unwrapped, repaired; invalid ones have ``valid`` false.

    A list of findings gives a row each, so one that is broken does not cost its siblings.
    """
    v = unwrap(lenient_json(F.col("response")), "finding", "audit", "result")
    items = F.coalesce(F.try_variant_get(v, "$.findings", "array<variant>"), F.array(v))
    rows = responses.select(*responses.columns, F.posexplode(items).alias("place", "f"))
    f = F.col("f")
    text = lambda p: F.try_variant_get(f, f"$.{p}", "string")
    evidence = F.filter(F.transform(F.coalesce(F.try_variant_get(f, "$.evidence", "array<variant>"), F.array().cast("array<variant>")), lambda e: F.struct(F.try_variant_get(e, "$.path", "string").alias("path"), F.try_variant_get(e, "$.line", "int").alias("line"), F.try_variant_get(e, "$.note", "string").alias("note"))), lambda e: e["path"].isNotNull() & (e["line"] > 0))
    out = rows.select(
        *responses.columns, "place", text("title").alias("title"), text("category").alias("category"), _scalar(f, "$.severity", SEVERITIES).alias("severity"), _scalar(f, "$.confidence", CONFIDENCES).alias("confidence"), _scalar(f, "$.status", STATUSES).alias("status"), text("path").alias("path"),
        _line_of(f, "$.startLine").alias("start_line"), _line_of(f, "$.endLine").alias("end_line"), text("source").alias("source"), text("sink").alias("sink"), _line_of(f, "$.sourceLine").alias("source_line"), _line_of(f, "$.sinkLine").alias("sink_line"), evidence.alias("evidence"), text("reasoning").alias("reasoning"), text("remediation").alias("remediation"), F.to_json(f).alias("raw"),
    )
    ok = F.col("title").isNotNull() & F.col("severity").isin(*SEVERITIES) & F.col("confidence").isin(*CONFIDENCES) & F.col("status").isin(*STATUSES)
    return out.withColumn("valid", F.coalesce(ok, F.lit(False)))


def verdict_rows(responses: DataFrame) -> DataFrame:
    """verdict, confidence, reason, requested files and symbols of each response; verdict null where it is none."""
    v = unwrap(lenient_json(F.col("response")), "verdict", "result")
    kind = F.try_variant_get(v, "$.verdict", "string")
    conf = F.try_variant_get(v, "$.confidence", "string")
    listed = lambda p: F.coalesce(F.try_variant_get(v, f"$.{p}", "array<string>"), F.array().cast("array<string>"))
    return responses.select(*responses.columns, F.when(kind.isin("true_positive", "false_positive", "needs_context", "parse_failed"), kind).alias("verdict"), F.when(conf.isin("high", "medium", "low"), conf).otherwise("low").alias("verdict_confidence"), F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit("")).alias("reason"), listed("requestedFiles").alias("requested_files"), listed("requestedSymbols").alias("requested_symbols"))


def first_valid(attempts: DataFrame, key: str) -> DataFrame:
    """Of ordered attempts (key, attempt, response), the first with a verdict; else the last, without one."""
    rows = verdict_rows(attempts)
    row = F.struct(*[F.col(c) for c in rows.columns])
    good = rows.groupBy(key).agg(F.min_by(F.when(F.col("verdict").isNotNull(), row), F.when(F.col("verdict").isNotNull(), F.col("attempt"))).alias("g"), F.max_by(row, F.col("attempt")).alias("l"))
    return good.select(F.coalesce("g", "l").alias("r")).select("r.*")


#: Answers that are asked for before the last one is repaired, and tries of one call that fails but may be repeated.
ASKS, TRIES = 2, 2
#: A key's rows that the chain looks at: all asks with their failed calls, and the repair with its own.
CHAIN = (ASKS + 1) * TRIES


def settle(attempts: DataFrame, key: str) -> DataFrame:
    """What has become of each key after its attempts (key, attempt, response, error), taken in order.

    A state machine folded over the attempts: a call that fails is repeated if its error allows it, ``TRIES``
    times in all, else the key has ``failed``. An answer with a verdict, or with a valid finding, is
    ``valid``. After ``ASKS`` answers without one the last is repaired once, unless it is blank; then the key
    falls back (``fallback``) to the last answer as it is. Columns: key, outcome (null: ``pending``), next (ask,
    retry, repair; null when settled), at (the attempt that settled it), response (of that attempt, or the
    last one), error, asked. Attempts after that are ignored.
    """
    base = verdict_rows(attempts.select(key, "attempt", "response", "error"))
    direct = finding_rows(attempts.select(key, "attempt", "response")).where("valid").groupBy(key, "attempt").agg(F.lit(True).alias("_full"))
    rows = base.join(direct, [key, "attempt"], "left")
    kind = error_kind(F.col("error"))
    step = F.struct("attempt", "response", "error", (F.col("verdict").isNotNull() | F.coalesce("_full", F.lit(False))).alias("valid"), (F.trim(F.coalesce("response", F.lit(""))) == "").alias("blank"), F.coalesce(error_retryable(kind), F.lit(False)).alias("again"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("attempt"))).where(F.col("_n") <= CHAIN)
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(step)).alias("steps"))  # CHAIN a key
    state = "struct<outcome:string,next:string,at:int,response:string,error:string,asked:int,errors:int>"
    start = F.struct(F.lit(None).alias("outcome"), F.lit("ask").alias("next"), F.lit(None).alias("at"), F.lit(None).alias("response"), F.lit(None).alias("error"), F.lit(0).alias("asked"), F.lit(0).alias("errors")).cast(state)

    def move(s: Column, a: Column) -> Column:
        failed, repairing = a["error"].isNotNull(), s["next"].isin("repair", "repair-retry")
        give_up = failed & (~a["again"] | (s["errors"] + 1 >= TRIES))
        asked = s["asked"] + (~failed & ~repairing).cast("int")
        last = (asked >= ASKS) & ~failed & ~repairing & ~a["valid"]
        outcome = F.when(give_up, "failed").when(failed, None).when(a["valid"], "valid").when(repairing | (last & a["blank"]), "fallback")
        following = F.when(outcome.isNotNull(), None).when(failed, F.when(repairing, "repair-retry").otherwise("retry")).when(last, "repair").otherwise("ask")
        new = F.struct(
            outcome.alias("outcome"), following.alias("next"), a["attempt"].cast("int").alias("at"), F.when(failed, s["response"]).otherwise(a["response"]).alias("response"),
            a["error"].alias("error"), asked.alias("asked"), F.when(failed, s["errors"] + 1).otherwise(0).alias("errors"),
        ).cast(state)
        return F.when(s["outcome"].isNotNull(), s).otherwise(new)

    out = listed.select(key, F.aggregate("steps", start, move).alias("s"))
    return out.select(key, F.coalesce("s.outcome", F.lit("pending")).alias("outcome"), F.col("s.next").alias("next"), "s.at", "s.response", "s.error", "s.asked")


class Scorer(Protocol):
    """What answers requests: a table of (key, purpose, prompt, previous) in, (key, response, error) out, a row each.

    ``purpose`` is ask, retry, repair or repair-retry; ``previous`` the answer to improve on, null at first.
    """

    def complete(self, requests: DataFrame) -> DataFrame: ...


def answered(requests: DataFrame, key: str, scorer: Scorer) -> DataFrame:
    """Requests (key, prompt) put to a scorer until each is settled (``settle``), in at most CHAIN rounds.

    Each round asks for the open keys alone and writes their answers to the shared folder; no answer is asked for twice.
    """
    scratch = Scratch(requests.sparkSession, "answers")
    asked = scratch.table("requests", requests.select(key, "prompt"))
    open_ = asked.select(key, F.lit("ask").alias("purpose"), "prompt", F.lit(None).cast("string").alias("previous"))
    every: DataFrame | None = None
    for number in range(1, CHAIN + 1):
        new = scratch.table(f"attempts-{number}", scorer.complete(open_).select(key, F.lit(number).alias("attempt"), "response", "error"))
        every = new if every is None else every.unionByName(new)
        pending = settle(every, key).where("outcome = 'pending'")
        open_ = scratch.table(f"open-{number}", pending.join(asked, key).select(key, F.col("next").alias("purpose"), "prompt", F.col("response").alias("previous")))
        if open_.isEmpty():
            break
    return settle(every, key)


def as_findings(results: DataFrame) -> DataFrame:
    """Results as findings: the deterministic projection (compliance rows are none)."""
    fix = F.coalesce(F.get_json_object("raw", "$.rule.fix"), F.get_json_object("raw", "$.fix"), F.lit("Review the affected code, validate inputs, enforce least privilege, and use safe framework APIs."))
    text = summary(F.coalesce(F.nullif(F.col("message"), F.lit("")), F.col("title")), 260)
    why = F.coalesce(F.get_json_object("raw", "$.rule.description"), F.get_json_object("raw", "$.description"), text)
    made = {
        "title": F.col("title"), "category": F.coalesce("category", F.lit("security")), "severity": F.col("severity"), "confidence": F.when(F.col("scanner") == "custom-rules", "medium").otherwise("high"), "status": F.lit("suspected"), "path": F.col("path"), "start_line": F.col("start_line"), "end_line": F.col("end_line"),
        "source": F.col("scanner"), "sink": F.col("rule_id"), "evidence": F.array(F.struct("path", F.col("start_line").alias("line"), text.alias("note"))), "reasoning": F.concat(F.col("scanner"), F.lit(" reported "), F.col("rule_id"), F.lit(": "), why), "remediation": fix, "scanner_source": F.col("scanner"), "raw": F.col("raw"),
        "fingerprint": F.lit(None).cast("string"), "baseline_status": F.lit(None).cast("string"), "exploitability_score": F.lit(None).cast("int"), "ord": F.col("ord"),
    }
    return results.where("scanner <> 'compliance'").select(*[made[c].alias(c) for c in columns_of(FINDINGS)])


def apply_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with a verdict (ord, verdict, verdict_confidence, reason): rejected, promoted, or as they were."""
    v = verdicts.select(F.col("ord").alias("_o"), "verdict", "verdict_confidence", F.col("reason").alias("_r"))
    joined = findings.join(v, F.col("ord") == F.col("_o"), "left")
    wrong, right = F.col("verdict") == "false_positive", F.col("verdict") == "true_positive"
    said = F.when(wrong, F.concat(F.lit("AI verdict marked this scanner result false_positive: "), F.coalesce(F.nullif(F.col("_r"), F.lit("")), F.lit("No reason supplied."))))
    said = said.when(right, F.concat(F.lit("AI first-pass verdict marked this scanner result true_positive with "), F.col("verdict_confidence"), F.lit(" confidence: "), F.coalesce(F.nullif(summary(F.col("_r"), 300), F.lit("")), F.lit("no reason supplied")), F.lit(".\n"), or_empty(F.col("reasoning"))))
    out = joined.withColumn("reasoning", said.otherwise(F.col("reasoning")))
    out = out.withColumn("confidence", F.when(wrong, "low").when(right, F.when(F.col("verdict_confidence") == "high", "medium").otherwise("low")).otherwise(F.col("confidence")))
    return out.withColumn("status", F.when(wrong, "false_positive").when(right, "likely_true_positive").otherwise(F.col("status"))).select(*findings.columns)


def second_pass(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions by ordinal (ord, at, decision, status, confidence, reason); the last for a row counts.

    reject drops the row; keep and downgrade overwrite status and confidence and append the reason; no decision leaves it.
    """
    last = decisions.groupBy("ord").agg(F.max_by(F.struct("decision", "status", "confidence", "reason"), "at").alias("d")).select(F.col("ord").alias("_o"), "d")
    joined = findings.join(last, F.col("ord") == F.col("_o"), "left").where("d IS NULL OR d.decision <> 'reject'")
    told = F.col("d").isNotNull()
    out = joined.withColumn("status", F.when(told, F.coalesce("d.status", "status")).otherwise(F.col("status"))).withColumn("confidence", F.when(told, F.coalesce("d.confidence", "confidence")).otherwise(F.col("confidence")))
    return out.withColumn("reasoning", F.when(told & (or_empty(F.col("d.reason")) != ""), F.concat(or_empty(F.col("reasoning")), F.lit("\n"), F.col("d.reason"))).otherwise(F.col("reasoning"))).select(*findings.columns)


def critic(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One critic verdict a finding (ord, decision, status, confidence): reject makes it a false positive, downgrade revises it."""
    v = verdicts.select(F.col("ord").alias("_o"), F.col("decision").alias("_d"), F.col("status").alias("_s"), F.col("confidence").alias("_c"))
    joined = findings.join(v, F.col("ord") == F.col("_o"), "left")
    no, less = F.col("_d") == "reject", F.col("_d") == "downgrade"
    out = joined.withColumn("status", F.when(no, "false_positive").when(less, F.coalesce("_s", "status")).otherwise(F.col("status")))
    return out.withColumn("confidence", F.when(no, "low").when(less, F.coalesce("_c", "confidence")).otherwise(F.col("confidence"))).select(*findings.columns)


def unsupported_evidence(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cited lines (ord, path, line) that lie in no range that the reviewer was given."""
    cited = findings.select("ord", F.explode(F.concat(F.transform("evidence", lambda e: F.struct(e["path"].alias("path"), e["line"].alias("line"))), F.array(F.struct("path", F.col("start_line").alias("line"))))).alias("c")).select("ord", "c.*").where("line IS NOT NULL")
    return range_semi(cited, ranges, "path", "line", anti=True)


def supported(findings: DataFrame, files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings whose file was read, whose every cited line lies in it and in a read range, and whose lines speak of their category."""
    known = files.select("path", F.size(F.split("content", r"\r?\n", -1)).alias("_n"))
    inside = findings.join(known, "path").where("start_line BETWEEN 1 AND _n").drop("_n").join(ranges.select("path").distinct(), "path", "left_semi")
    bad = unsupported_evidence(inside, ranges).select("ord").distinct()
    kept = inside.join(bad, "ord", "left_anti")
    low = F.lower(or_empty(F.col("raw")))
    env_only = (F.lower("category") == "secrets") & matches(low, r"(process\.env|import\.meta\.env|os\.environ|getenv\(|env\[)") & ~matches(low, r"(hardcoded|literal|committed|checked in|\.env)")
    in_tests = matches(F.col("path"), r"(?i)(^|/)(__tests__|test|tests|spec|fixtures|examples?)/") & ~matches(low, "prod|production|runtime|reachable")
    return kept.where(~env_only & ~in_tests)
