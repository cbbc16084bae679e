"""Sources of code: directories, buffers, version-control trees and unified diffs."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES = "path string, content string"


def directory(spark: SparkSession, path: str, extensions: list[str] = ("php", "inc", "php5", "phtml"), exclude: str | None = None) -> DataFrame:
    """The files below a path with one of the extensions, as (path, content); links aren't followed.

    The extension filter is a glob, applied while listing, so other files are never read.
    """
    glob = "*.{" + ",".join(extensions) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    out = raw.select("path", decoded(F.col("content")).alias("content"))
    return out.where(~F.col("path").rlike(exclude)) if exclude else out


def decoded(content: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def buffers(spark: SparkSession, given: dict[str, str]) -> DataFrame:
    """Files from memory."""
    return spark.createDataFrame(sorted(given.items()), FILES)


class GitTree(DataSource):
    """The blobs of a commit. Options: repository, commit, suffixes (comma-separated), partitions.

    The reader lists the tree once and reads blobs in batches on the executors, which need the repository.
    """

    @classmethod
    def name(cls) -> str:
        return "gittree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _GitReader(self.options)


class _GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.repository, self.commit = options["repository"], options.get("commit", "HEAD")
        self.suffixes = tuple("." + s for s in options.get("suffixes", "php").split(","))
        self.n = int(options.get("partitions", "8"))

    def partitions(self) -> list[InputPartition]:
        said = subprocess.run(["git", "-C", self.repository, "ls-tree", "-r", "-z", self.commit], capture_output=True, check=True).stdout
        blobs = []
        for entry in said.split(b"\0")[:-1]:
            head, _, path = entry.partition(b"\t")
            if head.split()[1] == b"blob" and path.decode().endswith(self.suffixes):
                blobs.append((head.split()[2].decode(), path.decode()))
        return [InputPartition(blobs[i :: self.n]) for i in range(min(self.n, len(blobs)))]

    def read(self, partition: InputPartition):  # noqa: ANN201
        asked = "".join(f"{sha}\n" for sha, _ in partition.value).encode()
        out = subprocess.run(["git", "-C", self.repository, "cat-file", "--batch"], input=asked, capture_output=True, check=True).stdout
        at = 0
        for _, path in partition.value:
            end = out.index(b"\n", at)
            size = int(out[at:end].split()[2])
            yield path, out[end + 1 : end + 1 + size].decode("utf-8", "replace")
            at = end + 2 + size


def git_tree(spark: SparkSession, repository: str, commit: str = "HEAD", suffixes: str = "php") -> DataFrame:
    spark.dataSource.register(GitTree)
    return spark.read.format("gittree").option("repository", repository).option("commit", commit).option("suffixes", suffixes).load()


def ignored(rules: str, path: Column) -> Column:
    """Does an ignore file (one pattern a line, the last that fits decides, ``!`` takes back) leave a path out?

    Paths are relative to the folder of the ignore file. A pattern without a slash inside fits at any
    depth, one with a slash from the folder on; ``*`` and ``?`` stay within a segment, ``**`` crosses
    segments; what lies below a folder that fits is left out too.
    """
    out: Column = F.lit(False)
    for line in rules.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        body = line.lstrip("!").removeprefix("\\")
        rooted, folder = "/" in body.rstrip("/"), body.endswith("/")
        body = body.strip("/")
        pattern, i = "", 0
        while i < len(body):
            if body.startswith("**/", i):
                pattern, i = pattern + "(?:.*/)?", i + 3
            elif body.startswith("**", i):
                pattern, i = pattern + ".*", i + 2
            elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
                pattern, i = pattern + "[" + body[i + 1 : end].replace("!", "^", 1 if body[i + 1] == "!" else 0).replace("\\", "\\\\") + "]", end + 1
            else:
                pattern, i = pattern + {"*": "[^/]*", "?": "[^/]"}.get(body[i], re.escape(body[i])), i + 1
        hit = path.rlike(f"^{'' if rooted else '(?:.*/)?'}{pattern}{'/' if folder else '(?:/|$)'}")
        out = F.when(hit, F.lit(not back)).otherwise(out)
    return out


def _git(repository: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repository, *args], capture_output=True, check=True, text=True).stdout


def merge_base(repository: str, one: str, two: str) -> str:
    """The commit that two lines of work have in common."""
    return _git(repository, "merge-base", one, two).strip()


def untracked(spark: SparkSession, repository: str) -> DataFrame:
    """(path) of files that aren't tracked and that no ignore file leaves out."""
    said = _git(repository, "ls-files", "-z", "--others", "--exclude-standard").split("\0")[:-1]
    return spark.createDataFrame([(x,) for x in said], "path string")


def changes(spark: SparkSession, repository: str, old: str, new: str = "") -> DataFrame:
    """(old_name, new_name, change) between two commits, or a commit and the work tree: added, deleted, modified or renamed."""
    said = _git(repository, "diff", "--name-status", "-z", "-M", old, *([new] if new else [])).split("\0")[:-1]
    rows, i = [], 0
    while i < len(said):
        kind = said[i][0]
        two = kind in "RC"
        a, b = said[i + 1], said[i + 2 if two else i + 1]
        rows.append((None if kind == "A" else a, None if kind == "D" else b, {"A": "added", "D": "deleted", "R": "renamed"}.get(kind, "modified")))
        i += 3 if two else 2
    return spark.createDataFrame(rows, "old_name string, new_name string, change string")


def old_versions(spark: SparkSession, repository: str, commit: str, changed: DataFrame, suffixes: str = "php") -> DataFrame:
    """(path, content) in a commit of the files that changed since."""
    return git_tree(spark, repository, commit, suffixes).join(changed.select(F.col("old_name").alias("path")).distinct(), "path", "left_semi")


def new_versions(spark: SparkSession, repository: str, commit: str, changed: DataFrame, suffixes: str = "php") -> DataFrame:
    """(path, content) in a commit of the files that changed up to it."""
    return git_tree(spark, repository, commit, suffixes).join(changed.select(F.col("new_name").alias("path")).distinct(), "path", "left_semi")


def work_tree(spark: SparkSession, folder: str, changed: DataFrame, extensions: list[str] = ("php", "inc", "php5", "phtml")) -> DataFrame:
    """(path, content) of the changed files as they are in a folder; paths are relative to it."""
    every = directory(spark, folder, extensions)
    root = os.path.abspath(folder).rstrip("/") + "/"
    relative = F.substring_index("path", root, -1)
    return every.withColumn("path", relative).join(changed.select(F.col("new_name").alias("path")).distinct(), "path", "left_semi")


def blame(spark: SparkSession, repository: str, path: str, commit: str = "HEAD") -> DataFrame:
    """(path, line, hash, author) of the lines of one file."""
    rows, authors, head = [], {}, None
    for x in _git(repository, "blame", "--porcelain", commit, "--", path).splitlines():
        m = re.match(r"^([0-9a-f]{40}) \d+ (\d+)", x)
        if m:
            head = (m.group(1), int(m.group(2)))
        elif x.startswith("author "):
            authors[head[0]] = x[7:]
        elif x.startswith("\t"):
            rows.append((path, head[1], head[0], authors[head[0]]))
    return spark.createDataFrame(rows, "path string, line int, hash string, author string")


def git_lines(spark: SparkSession, repository: str, *args: str) -> DataFrame:
    """Lines that a git command prints, as (n, line): the output of one process, on the driver."""
    said = subprocess.run(["git", "-C", repository, *args], capture_output=True, check=True, text=True).stdout
    return spark.createDataFrame(list(enumerate(said.splitlines())), "n long, line string")


def hunks(lines: DataFrame) -> DataFrame:
    """(old_name, new_name, old_from, old_to, new_from, new_to) of a unified diff without context."""
    w = Window.orderBy("n")  # a diff is one ordered text
    named = (
        lines.withColumn("old_name", F.last(F.when(F.col("line").startswith("--- "), F.regexp_replace(F.substring("line", 5, 1 << 20), r"^a/", "")), ignorenulls=True).over(w))
        .withColumn("new_name", F.last(F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.substring("line", 5, 1 << 20), r"^b/", "")), ignorenulls=True).over(w))
        .where(F.col("line").rlike(r"^@@ -\d"))
    )

    def safe(k: int) -> Column:
        x = F.regexp_extract("line", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", k)
        return F.when(x != "", x).otherwise(F.lit("1")).cast("int")

    return named.select("old_name", "new_name", safe(1).alias("old_from"), (safe(1) + safe(2) - 1).alias("old_to"), safe(3).alias("new_from"), (safe(3) + safe(4) - 1).alias("new_to"))


def log(lines: DataFrame) -> DataFrame:
    """hash/author/subject lines; others are dropped."""
    p = F.split("line", "/", 3)
    return lines.where(F.size(p) == 3).select(p[0].alias("hash"), p[1].alias("author"), p[2].alias("subject"))
