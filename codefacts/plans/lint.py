"""The whole run: files to facts, facts to findings, findings through the gate to a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.functions import text
from codefacts.operators import checks, facts, flow, names, nulls, relational, reports, rules, types
from codefacts.session import cut


def default_off() -> list[str]:
    """Checks that run only if asked for."""
    on = {c.name for c in checks.structural() if c.default}
    return sorted({c.name for c in checks.structural()} - on | {"classMembersOrder", "parentNotFound", "redundantCast", "argsReverse", "voidResultUsed", "arrayAccess"})


def all_findings(files: DataFrame, nodes: DataFrame | None = None, known_functions: list[str] = (), rules_: list[rules.Rule] = (), typos: dict[str, str] | None = None, typed: bool = False) -> DataFrame:
    """Findings of every check, and of rules and a dictionary where given. Pass stored ``nodes`` so that files are parsed once for all of them."""
    n = facts.nodes(files) if nodes is None else nodes
    symbols = relational.Symbols(n)
    parts = [checks.run(n), relational.undefined(n, symbols, known_functions), relational.members(n, symbols), relational.siblings(n, symbols), relational.arguments(n), relational.docs(n, symbols), names.findings(n, symbols), flow.findings(files)]
    if rules_:
        parts.append(rules.apply(files, list(rules_)))
    if typos:
        parts.append(checks.misspelt(n, typos))
    if typed:
        typed_ = cut(types.expressions(files))
        parts += [types.redundant_casts(n, typed_), nulls.findings(n, typed_, symbols)]
    # each family has a plan of its own: together they have hundreds of joins, more than a driver should hold at once
    return facts.with_context(reduce(DataFrame.unionByName, [cut(p.select(checks.FINDINGS)) for p in parts]), files)


def report(files: DataFrame, nodes: DataFrame | None = None, disabled: list[str] | None = None, exclude: str | None = None, known_functions: list[str] = (), generated: bool = False, **more: object) -> DataFrame:
    """Findings that pass the gate: enabled checks, no excluded, generated or self-disabled file, no suppressed node."""
    n = facts.nodes(files) if nodes is None else nodes
    found = reports.gate(all_findings(files, n, known_functions, **more), disabled=default_off() if disabled is None else disabled, exclude=exclude)
    if not generated:
        machine = files.where(text.auto_generated(F.col("content"))).select(F.col("path").alias("filename"))
        found = found.join(machine, "filename", "left_anti")
    off = n.where((F.col("kind") == "Comment") & F.contains("text", F.lit("@linter disable"))).select(F.col("path").alias("filename")).distinct()
    found = found.join(off, "filename", "left_anti")
    tags = n.where(F.col("doc").rlike(r"@(?:suppress|noinspection)\s+\S+")).select(
        F.col("path").alias("s_path"), F.col("start_line").alias("s_from"), F.col("end_line").alias("s_to"), F.explode(F.regexp_extract_all("doc", F.lit(r"@(?:suppress|noinspection)\s+(\S+)"), F.lit(1))).alias("s_check")
    )
    inside = (F.col("filename") == F.col("s_path")) & F.col("line").between(F.col("s_from"), F.col("s_to")) & ((F.col("s_check") == "all") | (F.lower("s_check") == F.lower("check_name")))
    return found.join(tags, inside, "left_anti")


def hashed(found: DataFrame) -> DataFrame:
    """Findings with ``hash`` and ``file`` for baselines: FNV-1a over the file's name, check, context and message."""
    from codefacts.functions.hashing import report_hash

    base = F.regexp_extract("filename", r"([^/]*)$", 1)
    return found.withColumns({"file": base, "hash": report_hash(F.concat_ws("#", base, "check_name", F.trim("context"), "message"))})


def rendered(found: DataFrame) -> DataFrame:
    """K1: (filename, line, text) with the text report of each finding."""
    head = F.format_string("%s %s: %s at %s:%d", text.severity(F.col("level")), F.col("check_name"), F.col("message"), F.col("filename"), F.col("line"))
    return found.select("filename", "line", F.concat_ws("\n", head, "context", text.caret(F.col("context"), F.col("start_char"), F.col("end_char"))).alias("text"))


def as_json(found: DataFrame) -> DataFrame:
    """K2: one JSON object for each finding, for a sink of lines."""
    return found.select(F.to_json(F.struct(*found.columns)).alias("value"))


def read_json(lines: DataFrame, schema: str) -> DataFrame:
    """Findings of JSON lines, with the line itself as ``value``."""
    return lines.select("value", F.from_json("value", schema).alias("_r")).select("value", "_r.*")


def baseline_items(baseline: DataFrame) -> DataFrame:
    """K3, O2: (file, items): base-36 hashes with ``*n`` where n > 1, sorted."""
    item: Column = F.concat(text.base36(F.col("hash")), F.when(F.col("cnt") > 1, F.concat(F.lit("*"), F.col("cnt").cast("string"))).otherwise(""))
    return baseline.groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("items"))


def read_baseline(items: DataFrame) -> DataFrame:
    """(file, hash, cnt) of baseline items."""
    e = items.select("file", F.explode("items").alias("item"))
    n = F.when(F.contains("item", F.lit("*")), F.substring_index("item", "*", -1)).otherwise(F.lit("1"))
    return e.select("file", text.from_base36(F.substring_index("item", "*", 1)).alias("hash"), n.cast("long").alias("cnt"))


def fixed(files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """K5: files after all quick fixes."""
    return checks.apply_edits(files, checks.edits(facts.nodes(files) if nodes is None else nodes))


def duplicates(nodes: DataFrame, least: int = 20) -> DataFrame:
    """Functions with the same body, by what they waste; a body has at least ``least`` nodes."""
    body = nodes.where((F.col("kind") == "Block") & (F.col("role") == "body") & F.col("parent_kind").isin("Function", "Method") & (F.col("last_id") - F.col("node_id") >= least))
    g = body.groupBy("hash").agg(F.array_sort(F.collect_set(F.struct("path", "start_line", "fn"))).alias("places"), F.max(F.col("end_pos") - F.col("start_pos")).alias("size"))
    return g.where(F.size("places") > 1).select("hash", "places", (F.col("size") * (F.size("places") - 1)).alias("score")).orderBy(F.desc("score"), "hash")


