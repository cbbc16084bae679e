"""Files to fact tables: one parse of each file, one row for each syntax node.

A row carries what most diagnostics ask about its direct children (kind, name, hash, value of the
first child of each role), so that they are filters over one scan instead of joins. Texts are whole;
only kinds and children whose text a check reads have one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import md5
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from codefacts.sources.php import DEEP, Node, ParseError, parse

NODES = (
    "path string, node_id int, parent_id int, last_id int, ord int, role string, kind string, parent_kind string, parent_bare string, ns string, cls string, fn string, "
    "attrs map<string,string>, kids map<string,string>, hash string, pure boolean, text string, doc string, start_line int, end_line int, "
    "start_char int, end_char int, start_pos int, end_pos int, context string"
)
_MAP = pa.map_(pa.string(), pa.string())
_TYPES = [("path", pa.string()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("last_id", pa.int32()), ("ord", pa.int32()), ("role", pa.string()), ("kind", pa.string()), ("parent_kind", pa.string()), ("parent_bare", pa.string()), ("ns", pa.string()), ("cls", pa.string()), ("fn", pa.string()), ("attrs", _MAP), ("kids", _MAP), ("hash", pa.string()), ("pure", pa.bool_()), ("text", pa.string()), ("doc", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("context", pa.string())]

#: Kinds with effects of their own.
EFFECTS = {"MethodCall", "StaticCall", "New", "Assign", "IncDec", "Include", "Exit", "Eval", "Yield", "Print", "Throw", "Clone"}
#: Built-in functions without effects.
PURE_CALLS = {"strlen", "count", "sizeof", "in_array", "is_array", "is_string", "is_int", "is_null", "is_numeric", "isset", "trim", "ltrim", "rtrim", "substr", "strpos", "strtolower", "strtoupper", "implode", "explode", "array_keys", "array_values", "array_merge", "array_key_exists", "abs", "min", "max", "floor", "ceil", "round", "sprintf", "str_replace", "ucfirst", "lcfirst", "md5", "intval", "gettype", "dirname", "basename"}
#: Nodes, and children by kind of parent and role, whose text a row keeps.
TEXTS = {"Nop", "Float", "Call", "Array", "Param", "Assign", "Comment"}
#: Longer lines aren't repeated in each of their nodes' rows; findings look them up (``with_context``).
CONTEXT = 500
#: Kinds with a scope of their own, kinds around one value, kinds of names without regard to case, attributes that leave the meaning as it is.
CLASSES, FUNCTIONS, WRAPPERS, ANY_CASE = {"Class", "Interface", "Trait", "Enum"}, {"Function", "Method"}, {"Arg", "Item", "Paren"}, {"Name", "Call", "Const"}
LOOKS = {"long", "quote", "keyword", "raw", "raw_modifiers"}
EQUALITY = {"==", "!=", "===", "!=="}  # of Binary
CHILD_TEXTS = {"Param": {"type", "default"}, "Assign": {"left"}, "Index": {"base", "dim"}, "Call": {"arg"}, "Ternary": {"cond", "then", "else"}, "Item": {"key"}, "Case": {"cond"}}


#: Bounds of what a task remembers: so many rows, of texts no longer than this.
MEMO, MEMO_CHARS = 20_000, 2_000


def rows(content: str) -> list[tuple]:
    """The node rows of one file, without its path; a file that doesn't parse has one row of kind SyntaxError."""
    try:
        tree, comments = parse(content)
    except (ParseError, RecursionError) as e:
        at = min(getattr(e, "at", 0), max(len(content) - 1, 0))
        tree, comments = Node("SyntaxError", at, at + 1, attrs={"message": str(e)}), []
    for c in comments:
        tree.parts.append(("comment", Node("Comment", c.start, c.end, attrs={"doc": "1"} if c.kind == "doc" else {})))
    lines = content.split("\n")
    breaks = [-1, *accumulate((len(x) + 1 for x in lines[:-1]), initial=-1)][1:]
    out: list[tuple] = []

    def visit(n: Node, parent: int, above: Node | None, role: str, ord_: int, ns: str, cls: str, fn: str) -> tuple[str, bool]:
        me = len(out)
        out.append(())
        what, attrs = n.kind, n.attrs
        if what == "Namespace":
            ns = attrs.get("name", "")
        if what in CLASSES:
            cls, fn = f"{ns}\\{attrs.get('name') or f'class@{n.start}'}".lstrip("\\"), ""
        elif what in FUNCTIONS:
            fn = (f"{cls}::{attrs['name']}" if what == "Method" else f"{ns}\\{attrs['name']}").lstrip("\\")
        child: dict[str, str] = {}
        counts: dict[str, int] = {}
        pure = what not in EFFECTS and not (what == "Call" and attrs.get("name", "").lower().lstrip("\\") not in PURE_CALLS)
        below = []
        texts = CHILD_TEXTS.get(what, ())
        for k, (r, x) in enumerate(n.parts):
            h, p = visit(x, me, n, r, k, ns, cls, fn)
            below_kind = x.kind
            if below_kind == "Namespace" and not x.parts:
                ns = x.attrs.get("name", "")  # of all that follows
            if r == "comment":
                continue
            below.append(f"{r}:{h}")
            pure = pure and p
            i = counts.get(r, 0)
            counts[r] = i + 1
            if i < 3:
                key = f"{r}{i}" if i else r
                inner = x.parts[0][1] if below_kind in WRAPPERS and x.parts else x
                child[f"{key}.kind"], child[f"{key}.hash"] = below_kind, h
                if r == "cond":
                    child[f"{key}.pure"] = "1" if p else "0"
                if r in texts:
                    child[f"{key}.text"] = content[x.start : x.end]
                if inner is not x:
                    child[f"{key}.inner"] = inner.kind
                if inner.attrs:
                    for name in ("name", "value", "op", "text", "default"):
                        if name in inner.attrs:
                            child[f"{key}.{name}"] = inner.attrs[name]
        for r, k in counts.items():
            child[f"{r}.n"] = str(k)
        for r, flag in (("arg", "spread"), ("case", "default")):
            if r in counts and any(s == r and flag in x.attrs for s, x in n.parts):
                child[f"{r}.any_{flag}"] = "1"
        if what == "Array":
            child |= {f"item.{'keyed' if any(s == 'key' for s, _ in x.parts) else 'unkeyed'}": "1" for r, x in n.parts if r == "item"}
        fixed = ",".join([f"{k}={v.lower() if what in ANY_CASE else v}" for k, v in sorted(attrs.items()) if k not in LOOKS]) if attrs else ""
        digest = md5(f"{what}({fixed})[{'|'.join(below)}]".encode()).hexdigest()
        start, end = n.start, n.end
        at = bisect_left(breaks, start) - 1
        last_at = max(end - 1, start)
        last = bisect_left(breaks, last_at, at) - 1 if last_at > start else at
        line = lines[at]
        text = content[start:end] if what in TEXTS or what == "Binary" and attrs.get("op") in EQUALITY else None
        out[me] = (
            me, parent, len(out) - 1, ord_, role, what, above.kind if above else "", above.attrs.get("bare", "") if above else "", ns, cls, fn, list(attrs.items()), list(child.items()), digest, pure, text, n.doc,
            at + 1, last + 1, start - breaks[at] - 1, last_at - breaks[last] if last == at else len(line), start, end, line if len(line) <= CONTEXT else None,
        )
        return digest, pure

    visit(tree, -1, None, "", 0, "", "", "")
    return out


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node rows of batches of (path, content). Short texts that were met before, as guards and copies are, aren't parsed again."""
    import sys

    sys.setrecursionlimit(DEEP)
    schema = pa.schema(_TYPES)
    paths: list[str] = []
    held: list[tuple] = []
    met: dict[str, list[tuple]] = {}
    in_met = 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip([paths, *zip(*held, strict=True)], _TYPES, strict=True)], schema=schema)

    for batch in batches:
        for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            content = content or ""
            if (found := met.pop(content, None)) is None:
                found = rows(content)
                in_met += len(found) if len(content) <= MEMO_CHARS else 0
            if len(content) <= MEMO_CHARS:
                met[content] = found  # the last one met is the last to go
                while in_met > MEMO:
                    in_met -= len(met.pop(next(iter(met))))
            held += found
            paths += [path] * len(found)
            if len(held) > 20_000:
                yield done()
                paths, held = [], []
    if held:
        yield done()


def nodes(files: DataFrame) -> DataFrame:
    """A row for each node of (path, content); a null content is an empty file. Files are parsed independently: no shuffle."""
    return files.select("path", "content").mapInArrow(batches_of, NODES)


def with_context(found: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with the whole line as context where a row held none. They are computed once: one outer join adds the lines of files that have such lines."""
    from pyspark.sql import functions as F

    lines = F.split("content", "\n", -1)
    long = files.where(F.exists(lines, lambda x: F.length(x) > CONTEXT)).select(F.col("path").alias("_path"), lines.alias("_lines"))
    j = found.join(long, (F.col("filename") == F.col("_path")) & F.col("context").isNull(), "left")
    return j.withColumn("context", F.coalesce("context", F.get("_lines", F.col("line") - 1))).select(found.columns)


def cached(files: DataFrame, at: str) -> DataFrame:
    """nodes() of files, with those parsed before read from the table at ``at``.

    The key is path and md5 of the content, so a changed file is parsed again. New rows are appended
    as a batch of their own; a run that fails leaves the table as it was.
    """
    from pyspark.sql import functions as F

    spark = files.sparkSession
    keyed = files.withColumn("content_md5", F.md5(F.coalesce("content", F.lit(""))))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    missing = keyed
    if there:
        known = spark.read.parquet(at).select("path", "content_md5").distinct()
        missing = keyed.join(known, ["path", "content_md5"], "left_anti")
    digests = missing.select(F.col("path").alias("_path"), "content_md5")
    fresh = nodes(missing).join(digests, F.col("path") == F.col("_path")).drop("_path")
    fresh.write.mode("append").parquet(at)
    wanted = keyed.select(F.col("path").alias("_path"), F.col("content_md5").alias("_md5"))
    return spark.read.parquet(at).join(wanted, (F.col("path") == F.col("_path")) & (F.col("content_md5") == F.col("_md5")), "left_semi").drop("content_md5")
