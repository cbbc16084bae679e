"""Pattern rules: PHP expressions with metavariables, matched against every node.

In a pattern ``$x`` stands for any expression; a name that recurs must stand for equal code, and
``$_`` for anything each time. ``${"x:class"}`` restricts it to a class, ``${"*"}`` in a list of
arguments or items to any number of them. Patterns are compiled on the driver, matched where the
files are parsed, and the first rule that fits a node wins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from codefacts.operators.types import Typer, hint
from codefacts.sources.php import DEEP, Node, ParseError, parse

CLASSES: dict[str, Callable[[Node], bool]] = {
    "var": lambda n: n.kind in ("Var", "VarVar"),
    "int": lambda n: n.kind == "Int",
    "float": lambda n: n.kind == "Float",
    "num": lambda n: n.kind in ("Int", "Float"),
    "str": lambda n: n.kind in ("String", "Template"),
    "char": lambda n: n.kind == "String" and len(n.attrs["value"].encode()) == 1,
    "expr": lambda n: True,
    "call": lambda n: n.kind in ("Call", "MethodCall", "StaticCall"),
    "const": lambda n: n.kind in ("Const", "ClassConstFetch"),
    "func": lambda n: n.kind in ("Closure", "ArrowFunction"),
}
#: Attributes in which equal code may differ.
LOOSE = {"long", "quote", "keyword", "raw", "curly"}
LIMIT = 60  # bytes of a capture that a message holds
FINDINGS = "check_name string, level int, context string, message string, filename string, line int, start_char int, end_char int, replacement string"


@dataclass(frozen=True)
class Rule:
    """A rule: one of ``patterns`` fits, and every filter holds.

    where: captures and regular expressions their text must match; types: captures and the types they must have;
    paths and excluded: parts of a path; location: the capture that is reported; scope: any, root or local;
    other: more sets of filters (rules without patterns), of which one must hold where the first doesn't.
    """

    name: str
    patterns: tuple[str, ...]
    message: str
    level: int = 2
    fix: str | None = None
    where: dict[str, str] = field(default_factory=dict)
    pure: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    types: dict[str, str] = field(default_factory=dict)
    check: str = ""  # the reported name, that of the rule if empty
    location: str = ""
    scope: str = "any"
    strict: bool = False  # ways of writing count too
    other: tuple[Rule, ...] = ()


LEVELS = {"error": 1, "warning": 2, "maybe": 3}


def parse_rules(text: str, source: str = "") -> list[Rule]:
    """The rules of a file: a function is a group, named like its check, each statement of it a pattern.

    The doc comment of a pattern says the rest: @error, @warning or @maybe with the message, @fix,
    @type and @pure and @filter of captures (@or begins another set of them), @path, @path-exclude, @scope,
    @location, @strict-syntax, @name; other tags are notes. ``any:`` before a block shares one comment.
    ValueError for what isn't a rule.
    """
    try:
        tree, _ = parse(text)
    except ParseError as e:
        raise ValueError(f"{source}: {e}") from None
    out: list[Rule] = []

    def add(group: str, doc: str, patterns: list[Node]) -> None:
        lines = re.sub(r"^\s*/\*\*|\*/\s*$", "", doc).split("\n")
        tags = [m.groups() for m in (re.match(r"[\s*]*@([\w-]+)\s*(.*?)\s*$", x) for x in lines) if m]
        given: dict = {"name": f"{group}#{len(out)}", "check": group, "message": ""}
        sets: list[dict] = [{"where": {}, "types": {}, "pure": ()}]
        for tag, value in tags:
            words = value.split()
            if tag in LEVELS:
                given |= {"level": LEVELS[tag], "message": value}
            elif tag == "name":
                given["check"] = value
            elif tag in ("fix", "location", "scope"):
                given[tag] = value.lstrip("$") if tag == "location" else value
            elif tag == "strict-syntax":
                given["strict"] = True
            elif tag == "or":
                sets.append({"where": {}, "types": {}, "pure": ()})
            elif tag == "type" and len(words) == 2:
                sets[-1]["types"][words[1].lstrip("$")] = words[0]
            elif tag == "filter" and len(words) >= 2:
                sets[-1]["where"][words[0].lstrip("$")] = " ".join(words[1:])
            elif tag == "pure":
                sets[-1]["pure"] += tuple(w.lstrip("$") for w in words)
            elif tag in ("path", "path-exclude"):
                key = "paths" if tag == "path" else "excluded"
                given[key] = given.get(key, ()) + (value,)
        if not given["message"]:
            raise ValueError(f"{source}: a rule of {group} says nothing")
        if given.get("scope", "any") not in ("any", "root", "local"):
            raise ValueError(f"{source}: unknown scope {given['scope']!r}")
        code = tuple(text[p.start : p.end] for p in patterns)
        for p in code:
            compile_pattern(p)
        out.append(Rule(patterns=code, **given, **sets[0], other=tuple(Rule(name="", patterns=(), message="", **s) for s in sets[1:])))

    for _, group in tree.parts:
        if group.kind != "Function" or group.get("body") is None:
            continue
        shared = ""
        for _, x in group.get("body").parts:
            if x.kind == "Label":
                if x.attrs["name"] != "any":
                    raise ValueError(f"{source}: {x.attrs['name']}: isn't known")
                shared = x.doc
            elif x.kind == "Block":
                add(group.attrs["name"], shared, [p for _, p in x.parts])
            else:
                add(group.attrs["name"], x.doc, [x])
    return out


def compatible(want: str, types: set[str]) -> bool:
    """is every member of a type one of those wanted? Nothing known is compatible with nothing but mixed."""
    wanted = hint(want)
    if "mixed" in wanted:
        return True
    return bool(types) and all(t in wanted or t.endswith("[]") and "mixed[]" in wanted or t.startswith("\\") and "object" in wanted or t == "int" and "float" in wanted for t in types)


def compile_pattern(text: str) -> Node:
    """The tree of a pattern; ValueError if it isn't one expression or statement, or names an unknown class."""
    try:
        tree, _ = parse(f"<?php {text.rstrip().rstrip(';')};")
    except ParseError as e:
        raise ValueError(f"bad pattern {text!r}: {e}") from None
    tree.parts = [x for i, x in enumerate(tree.parts) if not (i and x[1].kind == "Nop")]
    if len(tree.parts) != 1:
        raise ValueError(f"not one expression: {text!r}")
    n = tree.parts[0][1]
    n = n.get("expr") if n.kind == "Expr" else n
    for x in n.walk():
        m = meta(x)
        if m and m[1] not in ("*", *CLASSES):
            raise ValueError(f"unknown class {m[1]!r}")
    return n


def meta(n: Node) -> tuple[str, str] | None:
    """(name, class) of a metavariable."""
    if n.kind == "Var" and n.attrs["name"] != "this":
        return n.attrs["name"], "expr"
    if n.kind == "VarVar" and n.parts and n.parts[0][1].kind == "String":
        name, _, kind = n.parts[0][1].attrs["value"].partition(":")
        return ("_", "*") if name == "*" else (name, kind or "expr")
    return None


def _many(p: Node) -> bool:
    m = meta(p.parts[0][1]) if p.kind in ("Arg", "Item", "Expr") and len(p.parts) == 1 else meta(p)
    return bool(m) and m[1] == "*"


def _plain(n: Node) -> dict[str, str]:
    return {k: v.lower().lstrip("\\") if n.kind in ("Name", "Call", "Const", "MethodCall", "StaticCall") else v for k, v in n.attrs.items() if k not in LOOSE}


def match(p: Node, n: Node, bound: dict[str, Node], strict: bool = False) -> bool:
    m = meta(p)
    if m:
        name, kind = m
        if not CLASSES[kind](n):
            return False
        if name == "_":
            return True
        if name in bound:
            return bound[name].digest() == n.digest()
        bound[name] = n
        return True
    if p.kind != n.kind:
        return False
    if p.kind in ("Prop", "MethodCall") and (x := p.get("member")) is not None and meta(x) == ("_", "expr"):  # any name
        return _list([y for y in p.parts if y[0] != "member"], [y for y in n.parts if y[0] != "member"], bound, strict)
    if _plain(p) != _plain(n) or strict and p.attrs.get("curly") != n.attrs.get("curly"):
        return False
    return _list(p.parts, n.parts, bound, strict)


def _list(ps: list, ns: list, bound: dict[str, Node], strict: bool = False) -> bool:
    """Children one by one; a wildcard takes as few as it can, with whatever it takes undone on failure."""
    if not ps:
        return not ns
    (role, p), rest = ps[0], ps[1:]
    if _many(p):
        for k in range(len(ns) + 1):
            trial = dict(bound)
            if all(r == role for r, _ in ns[:k]) and _list(rest, ns[k:], trial, strict):
                bound.clear()
                bound.update(trial)
                return True
        return False
    return bool(ns) and ns[0][0] == role and match(p, ns[0][1], bound, strict) and _list(rest, ns[1:], bound, strict)


def fill(template: str, bound: dict[str, str], whole: str, short: bool) -> str:
    """``$$`` is the whole node, ``$x`` a capture; in messages long or many-lined captures stay as they are named."""
    out = template.replace("$$", whole)
    for name, value in sorted(bound.items(), key=lambda kv: -len(kv[0])):
        if not (short and (len(value.encode()) > LIMIT or "\n" in value)):
            out = out.replace(f"${name}", value)
    return out


EFFECTS = {"Call", "MethodCall", "StaticCall", "New", "Assign", "IncDec", "Include", "Exit", "Eval", "Yield", "Print", "Throw"}


def apply(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of the rules over (path, content), with the replacement where a rule has a fix.

    The rules are constants of the query; each file is matched on its own, in one pass over its nodes.
    """
    for r in rules:
        for p in r.patterns:
            compile_pattern(p)
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("two rules have one name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect
        import sys

        by_kind: dict[str, list[tuple[Rule, Node]]] = {}
        for r in rules:
            for p in r.patterns:
                tree = compile_pattern(p)
                by_kind.setdefault("" if meta(tree) else tree.kind, []).append((r, tree))
        schema = pa.schema([("check_name", pa.string()), ("level", pa.int32()), ("context", pa.string()), ("message", pa.string()), ("filename", pa.string()), ("line", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("replacement", pa.string())])
        sys.setrecursionlimit(DEEP)
        for batch in batches:
            out = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    tree, _ = parse(content or "")
                except (ParseError, RecursionError):
                    continue
                breaks = [-1] + [i for i, ch in enumerate(content or "") if ch == "\n"]
                known: dict[int, set[str]] = {}
                if any(f.types for r in rules for f in (r, *r.other)):
                    typer = Typer()
                    typer.walk(tree, {})
                    for _, x, types, _ in typer.found:
                        known[id(x)] = known.get(id(x), set()) | types
                inside = {id(x) for f in tree.walk() if f.kind in ("Function", "Method", "Closure") for x in f.walk()}

                def holds(f: Rule, bound: dict[str, Node], held: dict[str, str]) -> bool:
                    if any(not re.search(pattern, held.get(k, "")) for k, pattern in f.where.items()):
                        return False
                    if any(k in bound and not compatible(t, known.get(id(bound[k]), set())) for k, t in f.types.items()):  # noqa: B023
                        return False
                    return not any(x.kind in EFFECTS for k in f.pure if k in bound for x in bound[k].walk())

                for n in tree.walk():
                    for r, p in by_kind.get(n.kind, []):
                        if r.scope != "any" and (id(n) in inside) != (r.scope == "local"):
                            continue
                        if r.paths and not any(x in path for x in r.paths) or any(x in path for x in r.excluded):
                            continue
                        bound: dict[str, Node] = {}
                        if not match(p, n, bound, r.strict):
                            continue
                        held = {k: content[v.start : v.end] for k, v in bound.items()}
                        if not any(holds(f, bound, held) for f in (r, *r.other)):
                            continue
                        whole = content[n.start : n.end]
                        at_ = bound.get(r.location, n)
                        k = bisect.bisect_left(breaks, at_.start) - 1
                        line = content.split("\n", k + 1)[k]
                        at = at_.start - breaks[k] - 1
                        out.append({"check_name": r.check or r.name, "level": r.level, "context": line, "message": fill(r.message, held, whole, True), "filename": path, "line": k + 1, "start_char": at, "end_char": min(at + at_.end - at_.start, len(line)), "replacement": None if r.fix is None else fill(r.fix, held, whole, False)})
                        break
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select("path", "content").mapInArrow(run, FINDINGS)
