"""Findings: text rules, suppression, duplicates, coverage, baselines and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators.intervals import touching

#: Patterns of secrets (fixed values): cloud keys, forge tokens, payment keys, private keys.
SECRETS = r"(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|sk_(?:live|prod)_[A-Za-z0-9]{16,}|-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----)"
#: A further pattern that a caller may ask for: a quoted hexadecimal token that is assigned to a telling name.
ASSIGNED_TOKENS = r"(?i)\b(?:token|secret|password|api_?key)\s*[:=]\s*[\"'][0-9a-f]{32,}[\"']"
SEVERITIES = {"info": 0, "warning": 1, "error": 2}


def severity_rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv]), severity)


def secret_lines(lines: DataFrame, pattern: str = SECRETS) -> DataFrame:
    """(path, line, rule_id, severity, evidence) of lines with a secret that aren't comments; the evidence doesn't show it."""
    found = lines.where(F.col("line").rlike(pattern) & ~F.trim("line").rlike(r"^(?:#|;|//)"))
    return found.select("path", F.col("ln").alias("line"), F.lit("SEC-001").alias("rule_id"), F.lit("error").alias("severity"), F.lit("[redacted]").alias("evidence"))


def matching_lines(lines: DataFrame, pattern: str, rule_id: str, severity: str, most: int = 240) -> DataFrame:
    """(path, line, rule_id, severity, evidence) of lines that a pattern matches."""
    found = lines.where(F.col("line").rlike(pattern))
    return found.select("path", F.col("ln").alias("line"), F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), tx.truncated(F.trim("line"), most).alias("evidence"))


def suppressed(findings: DataFrame, lines: DataFrame, marker: str = r"allow ([A-Z]+-\d+) -- \s*\S") -> DataFrame:
    """Findings without those that a comment allows, on its line or the next, with a reason. Errors are never allowed."""
    allowed = lines.select("path", F.explode(F.array(F.col("ln"), F.col("ln") + 1)).alias("line"), F.regexp_extract("line", marker, 1).alias("rule_id")).where("rule_id <> ''").distinct()
    free = findings.where("severity <> 'error'").join(allowed, ["path", "line", "rule_id"], "left_anti")
    return free.unionByName(findings.where("severity = 'error'").select(*free.columns))


def with_overrides(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with the severity that rules (rule_id, enabled, override) give, without those of disabled rules. Rules are a short table."""
    held = findings.join(F.broadcast(rules), "rule_id", "left").where(F.coalesce("enabled", F.lit(True)))
    return held.withColumn("severity", F.coalesce("override", "severity")).drop("enabled", "override")


def duplicate_blocks(lines: DataFrame, n: int = 6, min_bytes: int = 160, min_lines: int = 3) -> DataFrame:
    """(path, line, digest): windows of n normalised lines that are long and varied enough."""
    kept = lines.withColumn("line", tx.normalized_line(F.col("line"))).where("line IS NOT NULL")
    window = Window.partitionBy("path").orderBy("ln").rowsBetween(0, n - 1)
    held = kept.withColumn("block", F.collect_list("line").over(window)).where(F.size("block") == n)
    joined = F.array_join("block", "\n")
    held = held.where((F.octet_length(joined) >= min_bytes) & (F.size(F.array_distinct("block")) >= min_lines))
    return held.select("path", F.col("ln").alias("line"), F.md5(joined.cast("binary")).alias("digest"))


def duplicate_pairs(blocks: DataFrame) -> DataFrame:
    """(first_path, path, first_line, line): a file that has a block which another, the first with it, has as well; once a pair."""
    first = blocks.groupBy("digest").agg(F.min(F.struct("path", "line")).alias("first"), F.countDistinct("path").alias("paths")).where("paths > 1")
    held = blocks.join(first.select("digest", "first"), "digest").where(F.col("path") != F.col("first.path"))
    return held.groupBy(F.col("first.path").alias("first_path"), "path").agg(F.min(F.struct(F.col("line").alias("at"), F.col("first.line").alias("from"))).alias("m")).select("first_path", "path", F.col("m.from").alias("first_line"), F.col("m.at").alias("line"))


def lcov_hits(rows: DataFrame) -> DataFrame:
    """(path, line, hits) of LCOV text given as (file, n, line): the last SF: before a DA: names its path."""
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("path", F.last(F.when(F.col("line").startswith("SF:"), F.substring("line", 4, 1 << 30)), True).over(order))
    part = F.split(F.substring("line", 4, 1 << 30), ",")
    return held.where(F.col("line").startswith("DA:")).select("path", F.get(part, F.lit(0)).cast("long").alias("line"), F.get(part, F.lit(1)).cast("long").alias("hits"))


def changed_coverage(hits: DataFrame, changed: DataFrame) -> DataFrame:
    """One row (coverable, covered, percent): lines with hits among the changed ones that a report names, whole percent."""
    lines = hits.groupBy("path", "line").agg(F.sum("hits").alias("hits"))
    spans = changed.select("path", F.col("start").alias("_from"), F.col("end").alias("_to"))
    touched = touching(lines, spans, ["path"], ("line", "line"), ("_from", "_to"))
    made = touched.agg(F.count(F.lit(1)).alias("coverable"), F.count_if(F.col("hits") > 0).alias("covered"))
    return made.withColumn("percent", F.when(F.col("coverable") > 0, F.floor(100 * F.col("covered") / F.col("coverable")).cast("long")))


def baseline(findings: DataFrame) -> DataFrame:
    """(rule_id, path, evidence, severity, count): a bag of findings, without lines; the first severity is kept."""
    held = findings.withColumn("evidence", tx.normalized_evidence(F.col("rule_id"), F.col("evidence")))
    return held.groupBy("rule_id", "path", "evidence").agg(F.min_by("severity", "line").alias("severity"), F.count(F.lit(1)).alias("count"))


def beyond_baseline(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings without as many of each kind as the baseline has, the first ones by line."""
    held = findings.withColumn("_e", tx.normalized_evidence(F.col("rule_id"), F.col("evidence")))
    rank = Window.partitionBy("rule_id", "path", "_e").orderBy("line")
    held = held.withColumn("_n", F.row_number().over(rank))
    k = known.select("rule_id", "path", F.col("evidence").alias("_e"), F.col("count").alias("_k"))
    return held.join(k, ["rule_id", "path", "_e"], "left").where(F.col("_n") > F.coalesce("_k", F.lit(0))).drop("_e", "_n", "_k")


def gate(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: counts by severity, blocking findings, checks passed and failed, and the status.

    Blocked if a required check failed or a finding blocks; warning if there is anything else; passed otherwise.
    """
    a = findings.agg(
        *[F.count_if(F.col("severity") == s).alias(p) for s, p in (("error", "errors"), ("warning", "warnings"), ("info", "infos"))], F.count_if("blocking").alias("blocking")
    )
    b = checks.agg(F.count_if("success").alias("checks_passed"), F.count_if(~F.col("success")).alias("checks_failed"), F.count_if(~F.col("success") & F.col("required")).alias("_failed"))
    any_ = (F.col("errors") + F.col("warnings") + F.col("infos") + F.col("checks_failed")) > 0
    status = F.when((F.col("_failed") > 0) | (F.col("blocking") > 0), "blocked").when(any_, "warning").otherwise("passed")
    return a.crossJoin(b).withColumn("status", status).drop("_failed")


def blocks(severity: Column, mode: str = "standard", warnings_block: bool = False) -> Column:
    """Whether a finding blocks: never in lite mode; errors otherwise, and warnings too in strict mode or where they are said to."""
    if mode == "lite":
        return F.lit(False)
    return (severity == "error") | (F.lit(warnings_block or mode == "strict") & (severity == "warning"))


def merged_gates(gates: DataFrame) -> DataFrame:
    """One row for many gates (repo, status, errors, warnings): the worst status, and sums."""
    rank = F.when(F.col("status") == "blocked", 2).when(F.col("status") == "warning", 1).otherwise(0)
    worst = F.element_at(F.array(F.lit("passed"), F.lit("warning"), F.lit("blocked")), F.max(rank) + 1)
    return gates.agg(worst.alias("status"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.count(F.lit(1)).alias("repos"))


def compact_report(findings: DataFrame, most: int = 5) -> DataFrame:
    """(n, text): the first findings by path, line and rule as one line each; a report shows a few and counts the rest."""
    order = findings.orderBy("path", "line", "rule_id").limit(most)
    return order.select(F.format_string("- %s %s:%d: %s", "rule_id", "path", "line", "evidence").alias("text"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(json): a SARIF 2.1.0 result for each finding."""
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    region = F.struct(F.col("line").alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("evidence").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("json"))


def hunk_ranges(diff: DataFrame) -> DataFrame:
    """(path, start, end) of unified diff text without context, given as (file, n, line)."""
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    held = diff.withColumn("path", F.last(F.nullif(F.regexp_extract("line", r"^\+\+\+ b/(.*)$", 1), F.lit("")), True).over(order))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start, count = F.regexp_extract("line", hunk, 1), F.regexp_extract("line", hunk, 2)
    held = held.where(start != "").select("path", start.cast("long").alias("start"), F.coalesce(F.nullif(count, F.lit("")).cast("long"), F.lit(1)).alias("count"))
    return held.where("path IS NOT NULL AND count > 0").select("path", "start", (F.col("start") + F.col("count") - 1).alias("end"))


#: Marks of unfinished code (fixed values).
PLACEHOLDERS = r"(?:todo!|unimplemented!|NotImplementedError|NotImplementedException|raise NotImplemented\b|throw new Error\([\"']not implemented)"


def added_placeholders(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, line, evidence) of unfinished code in now (path, ln, line) beyond as many of the same text as before has in the path."""
    mark = lambda df: df.where(F.col("line").rlike(PLACEHOLDERS)).withColumn("evidence", F.trim("line"))
    rank = Window.partitionBy("path", "evidence").orderBy("ln")
    known = mark(before).groupBy("path", "evidence").agg(F.count(F.lit(1)).alias("k"))
    held = mark(now).withColumn("n", F.row_number().over(rank)).join(known, ["path", "evidence"], "left")
    return held.where(F.col("n") > F.coalesce("k", F.lit(0))).select("path", F.col("ln").alias("line"), "evidence")


def fingerprints(symbols: DataFrame) -> DataFrame:
    """(file_id, symbols_hash): a digest of the symbols of each file in the order of their lines."""
    one = F.concat_ws("|", F.lpad(F.col("start_line").cast("string"), 12, "0"), F.lpad(F.col("id").cast("string"), 20, "0"), "qualified", "kind")
    return symbols.groupBy("file_id").agg(F.md5(F.array_join(F.sort_array(F.collect_list(one)), "\n").cast("binary")).alias("symbols_hash"))


def reconciled(commands: DataFrame, detected: DataFrame) -> DataFrame:
    """(name, command, place): commands in their order, then detected ones (name, command, place) of new names, the first of each."""
    first = Window.partitionBy("name").orderBy("place")
    new = detected.join(commands.select("name"), "name", "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    most = commands.agg(F.coalesce(F.max("place") + 1, F.lit(0)).alias("_most"))
    return commands.select("name", "command", "place").unionByName(new.crossJoin(F.broadcast(most)).select("name", "command", (F.col("place") + F.col("_most")).alias("place")))


def climbability(tasks: DataFrame) -> DataFrame:
    """tasks with score: twenty points for each of five things that a task has."""
    points = [F.col(c).cast("int") * 20 for c in ("has_metric", "has_baseline", "has_target", "has_command", "has_scope")]
    return tasks.withColumn("score", sum(points[1:], points[0]).cast("long"))


def session_keys(payloads: DataFrame) -> DataFrame:
    """(event_id, session): the first key that a JSON payload has, in the order of precedence."""
    names = ("session_id", "sessionId", "conversation_id", "conversationId", "thread_id", "k")
    return payloads.select("event_id", F.coalesce(*[F.get_json_object("payload", f"$.{n}") for n in names]).alias("session"))
