"""Static rules against files, finding identities, and review status from run to run."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import finding_id, is_handler_file, is_test_file, lookup, suffix
from loomgraph.functions.vocab import REACHABLE_POINTS, RULE_LANGUAGES, SECURITY_SKIP_DIRS, SEVERITY_POINTS, SEVERITY_RANK
from loomgraph.operators import rules as catalog_of
from loomgraph.operators.rules import RULE_SCHEMA, Rule, languages, rule_rows

_COMMENT = ("//", "#", "/*", "<!--", "--")
MATCHES = "file string, language string, rule_id string, line int, snippet string"


def rules_table(spark: SparkSession, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The catalog as a table of fixed size."""
    return spark.createDataFrame(rule_rows(rules), RULE_SCHEMA)


def scannable(files: DataFrame) -> DataFrame:
    """Files (``path, content``) that the rules look at, with ``language``; folders of dependencies and builds, dot folders and minified files are left out."""
    folders = F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/")
    skip = F.arrays_overlap(folders, F.array(*map(F.lit, SECURITY_SKIP_DIRS))) | F.exists(folders, lambda p: p.startswith(".") & (F.length(p) > 1)) | F.regexp_extract("path", r"([^/]*)$", 1).contains(".min.")
    return files.withColumn("language", lookup(suffix(F.col("path")), RULE_LANGUAGES)).filter((F.col("language") != "") & ~skip)


def required_literal(regex: str) -> str:
    """The longest text, in lower case, that every match of an expression holds; '' if none is plain to see."""
    best = run = ""
    for op, arg in re._parser.parse(regex):
        run = run + chr(arg) if op is re._constants.LITERAL else ""
        best = max(best, run, key=len)
    return best.lower()


def matcher(rules: tuple[Rule, ...]):
    """(language, text) to the rule hits (rule, line, snippet), in catalog order."""
    by: dict[str, list[tuple[Rule, re.Pattern, str]]] = {}
    for rule in rules:
        compiled = re.compile(rule.regex, re.I | (re.M if rule.multiline else 0))
        for language in languages(rule):
            by.setdefault(language, []).append((rule, compiled, required_literal(rule.regex)))

    def match(language: str, text: str | None) -> list[tuple[str, int, str]]:
        if not text or not text.strip() or language not in by:
            return []
        lines, out, low = text.split("\n"), [], text.lower()
        plain = text.isascii()  # other letters match some of ASCII in any case, but are not these in lower case
        for rule, compiled, literal in by[language]:
            if plain and literal not in low:
                continue
            seen = set()
            for m in compiled.finditer(text):
                if m.end() == m.start():
                    continue
                n = text.count("\n", 0, m.start()) + 1
                line = lines[n - 1].rstrip("\r")
                snippet = line.strip()[:120]
                if n in seen or line.lstrip().startswith(_COMMENT) or any(x in snippet for x in rule.noise):
                    continue
                seen.add(n)
                out.append((rule.rule_id, n, snippet))
        return out

    return match


def rule_hits(files: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """``file, language, rule_id, line, snippet`` of every rule hit in files with ``path, language, content``.

    Matches may span lines and count once a rule and line, on their first line;
    comment lines and lines with a noise term of the rule don't count.  Null,
    empty and blank files have no hits.  The catalog goes with the task; text is
    read in Arrow batches and only hits come back.
    """

    used = catalog_of.RULES if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(used)
        for batch in batches:
            hits, at = [], []
            for i, (language, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = match(language, text)
                hits += found
                at += [i] * len(found)
            where = pa.array(at, pa.int64())
            columns = list(zip(*hits)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["file", "language", "rule_id", "line", "snippet"])

    return files.select("path", "language", "content").mapInArrow(run, MATCHES)


def line_hits(lines: DataFrame, text: str, rules: dict[str, str]) -> DataFrame:
    """Rows of ``lines`` with the ``rule_id`` of each expression that its text column matches, without leaving the JVM."""
    marks = F.array(*[F.when(F.col(text).rlike(rx), F.lit(name)) for name, rx in rules.items()])
    return lines.withColumn("rule_id", F.explode(F.filter(marks, lambda m: m.isNotNull())))


def severity_in(severity: Column, path: Column) -> Column:
    """Severity of a hit in its file: one level less in tests, where medium and low don't count (null)."""
    less = F.when(severity == "critical", "high").when(severity == "high", "medium")
    return F.when(is_test_file(path), less).otherwise(severity)


def findings_of(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Findings with identity, severity and reach; two hits of one identity are one finding, on the first line."""
    info = catalog.select("rule_id", F.col("severity").alias("_sev"), "owasp", "cwe", "fix", "description", "ord").dropDuplicates(["rule_id"])
    rows = hits.join(F.broadcast(info), "rule_id").withColumn("severity", severity_in(F.col("_sev"), F.col("file")))  # the catalog is a fixed table
    rows = rows.filter("severity is not null").withColumn("id", finding_id(F.col("file"), F.col("rule_id"), F.col("snippet")))
    first = F.min(F.struct("line", "ord", "severity", "owasp", "cwe", "fix", "description", "language", "snippet")).alias("f")
    return rows.groupBy("id", F.col("rule_id").alias("pattern_id"), "file").agg(first).select("id", "pattern_id", "file", "f.*", is_handler_file(F.col("file")).alias("taint_reachable"))


def risk_points(severity: Column, reachable: Column) -> Column:
    return F.when(reachable, lookup(severity, REACHABLE_POINTS, 0)).otherwise(lookup(severity, SEVERITY_POINTS, 0))


def carry_review(now: DataFrame, before: DataFrame, at: Column) -> DataFrame:
    """Findings of a run with the review status of the run before (``id, status, notes, first_seen``).

    A known finding keeps status, notes and first_seen, one that was resolved
    comes back as unreviewed; a reviewed one that vanished becomes resolved, an
    unreviewed one is dropped.  ``now`` needs the columns of ``before`` but these.
    """
    old = before.groupBy("id").agg(F.max(F.struct("status", "notes", "first_seen")).alias("o")).select("id", "o.*")
    known = now.join(old, "id", "left")
    status = F.when(F.col("status").isNull() | (F.col("status") == "resolved"), "unreviewed").otherwise(F.col("status"))
    kept = known.select(*now.columns, status.alias("status"), "notes", F.coalesce("first_seen", at).alias("first_seen"), at.alias("last_seen"))
    gone = before.join(now.select("id"), "id", "left_anti").filter("status not in ('unreviewed', 'resolved')")
    return kept.unionByName(gone.withColumn("status", F.lit("resolved")), allowMissingColumns=True)


def triage(findings: DataFrame, status: str, *, id: str | None = None, file: str | None = None, notes: str | None = None) -> DataFrame:
    """Findings with the status (and notes, if given) of one id, or of all files whose path contains ``file``, set."""
    if status not in ("false_positive", "verified_vulnerability", "resolved", "unreviewed"):
        raise ValueError(f"unknown status: {status}")
    if not id and not file:
        raise ValueError("name an id or a file")
    hit = F.col("id") == id if id else F.lower("file").contains(file.lower())
    out = findings.withColumn("status", F.when(hit, status).otherwise(F.col("status")))
    return out if notes is None else out.withColumn("notes", F.when(hit, notes).otherwise(F.col("notes")))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_if("taint_reachable").alias("n_reachable"))


def file_risk(findings: DataFrame, top: int | None = 5) -> DataFrame:
    """``file, risk, n, severities``: the files of the highest summed risk, with the severities they have; ties by path."""
    out = findings.groupBy("file").agg(F.sum(risk_points(F.col("severity"), F.col("taint_reachable"))).cast("bigint").alias("risk"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("severity")), ",").alias("severities"))
    return out if top is None else out.orderBy(F.desc("risk"), "file").limit(top)


def summary(now: DataFrame, before: DataFrame) -> DataFrame:
    """One row: findings, files, reachable and false-positive findings of a run, and what is new and gone since the run before."""
    counts = now.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("n_files"), F.count_if(F.coalesce("taint_reachable", F.lit(False))).alias("n_reachable"), F.count_if(F.coalesce("status", F.lit("")) == "false_positive").alias("n_false"))
    new = now.join(before.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("n_new"))
    gone = before.join(now.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("n_gone"))
    one = lambda df: df.withColumn("_k", F.lit(1))  # noqa: E731 - one row each
    return one(counts).join(one(new), "_k").join(one(gone), "_k").drop("_k")


def owasp_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.split_part("owasp", F.lit(":"), F.lit(1)).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def risk_level(findings: DataFrame) -> DataFrame:
    """One row ``level``: the worst severity present, ``none`` without findings."""
    worst = F.min(lookup(F.col("severity"), SEVERITY_RANK, 9))
    return findings.agg(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in SEVERITY_RANK.items() for x in (v, k)]), worst), F.lit("none")).alias("level"))


def display(findings: DataFrame, *, severity: str = "medium", language: str = "", owasp: str = "", file: str = "", hide_false_positives: bool = True, max_results: int = 50) -> DataFrame:
    """Findings to show: filtered, worst first, then by file and line."""
    least = 3 if severity == "all" else SEVERITY_RANK[severity]
    out = findings.filter(lookup(F.col("severity"), SEVERITY_RANK, 9) <= least)
    if language:
        out = out.filter(F.col("language") == language)
    if owasp:
        out = out.filter(F.col("owasp").contains(owasp))
    if file:
        out = out.filter(F.lower("file").contains(file.lower()))
    if hide_false_positives:
        out = out.filter("status is null or status != 'false_positive'")
    return out.orderBy(lookup(F.col("severity"), SEVERITY_RANK, 9), "file", "line", "id").limit(min(500, max_results))


def scan(files: DataFrame, *, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """Files (``path, content``) to findings."""
    return findings_of(rule_hits(scannable(files), rules), rules_table(files.sparkSession, rules))
