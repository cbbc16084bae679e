"""The algebra of findings: baselines, differences, statistics, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def baseline_build(findings: DataFrame, file: str = "file", key: str = "hash") -> DataFrame:
    """(file, hash, cnt): how often each finding is known."""
    return findings.groupBy(F.col(file).alias("file"), F.col(key).alias("hash")).agg(F.count("*").alias("cnt"))


def baseline_suppress(findings: DataFrame, baseline: DataFrame, order: list[str], file: str = "file", key: str = "hash") -> DataFrame:
    """Findings beyond the known number of their (file, hash): a multiset difference.

    Unknown keys skip the numbering: they pass through an anti join. The rest is numbered after a
    limit of nothing but its own key, whose size is the number of equal findings in one file.
    """
    known = baseline.select(F.col("file").alias("_f"), F.col("hash").alias("_h"), F.col("cnt").alias("_c"))
    on = (F.col(file) == F.col("_f")) & (F.col(key) == F.col("_h"))
    new = findings.join(known, on, "left_anti")
    w = Window.partitionBy(file, key).orderBy(*order)
    more = findings.join(known, on).withColumn("_n", F.row_number().over(w)).where(F.col("_n") > F.col("_c")).select(findings.columns)
    return new.unionByName(more)


def ranking(findings: DataFrame, check: str = "check_name", by: list[str] = ()) -> DataFrame:
    """(*by, check_name, n, place): checks by their number of findings, ties by name; the window sees one row for each check."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), check) if by else Window.orderBy(F.desc("n"), check)
    return findings.groupBy(*by, check).agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(w).cast("long"))


def severity_stats(findings: DataFrame, level: str = "level", by: list[str] = ()) -> DataFrame:
    """A row of counts (one for each group of ``by``); every level but notice (3) is critical."""
    return findings.groupBy(*by).agg(
        F.count("*").alias("n_all"),
        F.count_if(F.col(level) != 3).alias("n_critical"),
        F.count_if(F.col(level) == 3).alias("n_minor"),
    )


def report_diff(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Findings of either side that the other lacks, with ``change`` added or deleted."""
    return new.join(old, on, "left_anti").withColumn("change", F.lit("added")).unionByName(old.join(new, on, "left_anti").withColumn("change", F.lit("deleted")))


def diff_summary(diff: DataFrame, check: str) -> DataFrame:
    return diff.groupBy(F.col(check).alias("check")).agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "deleted").alias("deleted"))


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    return (a_from <= b_to) & (a_to >= b_from)


def gate(findings: DataFrame, disabled: list[str] = (), exclude: str | None = None, allow: list[str] | None = None) -> DataFrame:
    """Enabled checks in files that aren't excluded or generated."""
    out = findings
    if allow is not None:
        out = out.where(F.col("check_name").isin(list(allow)))
    if disabled:
        out = out.where(~F.col("check_name").isin(list(disabled)))
    if exclude:
        out = out.where(~F.col("filename").rlike(exclude))
    return out


def path_rules(rows: DataFrame, path: str, rules: list[tuple[str, bool]], default: bool = True) -> Column:
    """Is a path enabled? Of the prefixes that match, the one of most segments decides; at one depth, enabled wins.

    ``*`` stands for any number of segments.
    """
    depth: dict[int, list[tuple[str, bool]]] = {}
    for prefix, on in rules:
        depth.setdefault(len([s for s in prefix.split("/") if s and s != "*"]), []).append((prefix, on))
    out: Column = F.lit(default)
    for d in sorted(depth):
        for on in (False, True):
            hit = F.lit(False)
            for prefix, state in depth[d]:
                if state == on:
                    pattern = "/".join(".*" if s == "*" else s.replace(".", r"\.") for s in prefix.split("/"))
                    hit = hit | F.col(path).rlike(rf"^(?:{pattern})(/|$)")
            out = F.when(hit, F.lit(on)).otherwise(out)
    return out


def aligned(findings: DataFrame, hunks: DataFrame, file: str = "filename", line: str = "line") -> DataFrame:
    """findings with ``old_line``: where their line stood before the hunks of the file; null inside a changed range.

    hunks: (new_name, old_from, old_to, new_from, new_to); a range that ends before it begins is empty.
    """
    h = hunks.select("new_name", F.col("new_from").alias("_from"), F.col("new_to").alias("_to"), ((F.col("old_to") - F.col("old_from")) - (F.col("new_to") - F.col("new_from"))).alias("_shift"))
    per = h.groupBy(F.col("new_name").alias("_file")).agg(F.collect_list(F.struct("_from", "_to", "_shift")).alias("_h"))
    j = findings.join(per, F.col(file) == F.col("_file"), "left")
    inside = F.exists("_h", lambda x: F.col(line).between(x["_from"], x["_to"]))
    # an empty new range stands after its line
    before = F.filter("_h", lambda x: F.when(x["_to"] < x["_from"], x["_from"] < F.col(line)).otherwise(x["_to"] < F.col(line)))
    shift = F.aggregate(before, F.lit(0), lambda s, x: s + x["_shift"].cast("int"))
    return j.withColumn("old_line", F.when(F.col("_h").isNull(), F.col(line)).when(~inside, F.col(line) + shift)).drop("_file", "_h")


def new_by_line(findings: DataFrame, old: DataFrame, hunks: DataFrame, by_check: bool = False) -> DataFrame:
    """Findings whose line, brought back before the change, had no finding (with ``by_check``: none of the same check)."""
    keys = ["filename", "line", *(["check_name"] if by_check else [])]
    seen = old.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    at = aligned(findings, hunks)
    on = (F.col("filename") == F.col("_filename")) & (F.col("old_line") == F.col("_line"))
    if by_check:
        on = on & (F.col("check_name") == F.col("_check_name"))
    return at.join(seen, on, "left_anti").drop("old_line")


def in_changed_lines(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """Findings on lines that a hunk touches."""
    return findings.join(hunks, (F.col("filename") == F.col("new_name")) & F.col("line").between(F.col("new_from"), F.col("new_to")), "left_semi")


def by_allowed_authors(commits: DataFrame, allowed: list[str]) -> bool:
    """is every commit by one of the authors?"""
    return commits.where(~F.col("author").isin(list(allowed))).isEmpty()
