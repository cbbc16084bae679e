"""Constant folding of parsed expressions: arithmetic, bits, booleans, text, casts and comparisons.

Whole numbers have 64 bits and wrap. What isn't known, or what an operator isn't defined for, is UNKNOWN,
and so is everything built on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from codefacts.sources.php import DEEP, Node, ParseError, parse

Value = int | float | bool | str | None
CONSTANTS = "path string, cls string, name string, kind string, value string"


class Unknown:
    """What folding can't tell."""


UNKNOWN = Unknown()


def _wrapped(n: int) -> int:
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


def _number(v: object) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def _whole(v: object) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def arithmetic(op: str, x: object, y: object) -> object:
    """+ - * of two numbers; one float makes the result a float."""
    if not (_number(x) and _number(y)):
        return UNKNOWN
    out = x + y if op == "+" else x - y if op == "-" else x * y
    return _wrapped(out) if _whole(x) and _whole(y) else float(out)


def text(v: object) -> object:
    """A value as PHP writes it in a string."""
    if isinstance(v, bool):
        return "1" if v else ""
    if v is None:
        return ""
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)
    return str(v) if isinstance(v, int | str) else UNKNOWN


def truth(v: object) -> object:
    return UNKNOWN if isinstance(v, Unknown) else v not in (0, "", "0", None) and v is not False


def cast(to: str, v: object) -> object:
    if isinstance(v, Unknown):
        return UNKNOWN
    if to == "bool":
        return truth(v)
    if to == "string":
        return text(v)
    if to in ("int", "float") and (v is None or isinstance(v, int | float)):
        return _wrapped(int(v or 0)) if to == "int" else float(v or 0)
    return UNKNOWN


def compare(op: str, x: object, y: object) -> object:
    """Comparisons of two values of one kind (numbers, texts or booleans)."""
    if isinstance(x, Unknown) or isinstance(y, Unknown):
        return UNKNOWN
    same = type(x) is type(y)
    if op in ("===", "!=="):
        return (same and x == y) == (op == "===")
    if not (same or _number(x) and _number(y)):
        return UNKNOWN
    return {"==": x == y, "!=": x != y}.get(op) if op in ("==", "!=") or x is None else {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def fold(n: Node | None) -> object:
    """The value of an expression, or UNKNOWN."""
    if n is None:
        return UNKNOWN
    k = n.kind
    if k == "Paren":
        return fold(n.get("expr"))
    if k == "Int":
        v = n.attrs["value"]
        return int(v, 0 if v[:2] in ("0x", "0b") else 8 if len(v) > 1 and v[0] == "0" else 10)
    if k == "Float":
        return float(n.attrs["value"])
    if k == "String":
        return n.attrs["value"]
    if k == "Const":
        return {"true": True, "false": False, "null": None}.get(n.attrs["name"].lower(), UNKNOWN)
    if k == "Unary":
        v = fold(n.get("expr"))
        op = n.attrs["op"]
        if op == "!":
            return (not v) if isinstance(v, bool) else UNKNOWN
        return arithmetic("-", 0, v) if op == "-" and _number(v) else v if op == "+" and _number(v) else UNKNOWN
    if k == "Cast":
        return cast(n.attrs["to"], fold(n.get("expr")))
    if k == "Binary":
        op, x, y = n.attrs["op"], fold(n.get("left")), fold(n.get("right"))
        if op in ("+", "-", "*"):
            return arithmetic(op, x, y)
        if op in ("|", "&"):
            return UNKNOWN if not (_whole(x) and _whole(y)) else x | y if op == "|" else x & y
        if op in ("||", "or", "&&", "and"):
            return UNKNOWN if not (isinstance(x, bool) and isinstance(y, bool)) else x or y if op in ("||", "or") else x and y
        if op == ".":
            a, b = text(x), text(y)
            return a + b if isinstance(a, str) and isinstance(b, str) else UNKNOWN
        if op in ("==", "!=", "===", "!==", "<", "<=", ">", ">="):
            return compare(op, x, y)
    return UNKNOWN


def constants(files: DataFrame) -> DataFrame:
    """(path, cls, name, kind, value) of the constants that files declare and whose value folds; kind is that of the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        sys.setrecursionlimit(DEEP)
        schema = pa.schema([(c, pa.string()) for c in ("path", "cls", "name", "kind", "value")])
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    tree, _ = parse(content or "")
                except (ParseError, RecursionError):
                    continue
                todo = [(tree, "")]
                while todo:
                    n, cls = todo.pop()
                    cls = n.attrs.get("name", "") if n.kind in ("Class", "Interface", "Trait", "Enum") else cls
                    v = fold(n.get("value")) if n.kind == "ConstItem" else UNKNOWN
                    if not isinstance(v, Unknown):
                        out.append((path, cls, n.attrs["name"], "null" if v is None else type(v).__name__, text(v)))
                    todo += [(x, cls) for _, x in n.parts]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, CONSTANTS)
