"""Types of expressions: local rules first, names that other files declare second.

The first pass types every expression of a file from literals, operators, hints and the assignments
before it. What depends on another declaration stays lazy, written ``()name`` for a call. The second
pass replaces lazies by joins with the return types of all functions, round by round, until none is
left; what calls itself, or nothing known, is mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.functions import sets
from codefacts.operators.checks import NOTICE, located
from codefacts.session import cut
from codefacts.sources.php import DEEP, Node, ParseError, parse

BOOL_OPS = {"==", "!=", "===", "!==", "<", "<=", ">", ">=", "&&", "||", "and", "or", "xor"}
SCALARS = {"int", "float", "string", "bool", "null", "array", "mixed", "void", "callable", "iterable", "object", "self", "static", "false", "true", "never"}
SAME = {"integer": "int", "boolean": "bool", "double": "float", "real": "float", "false": "bool", "true": "bool", "array": "mixed[]"}
TYPED = "path string, fn string, kind string, start_pos int, end_pos int, types array<string>, returned boolean"


def hint(text: str) -> set[str]:
    """The members of a type as written: a hint or the type of a doc tag."""
    out = {"null"} if text.startswith("?") else set()
    for t in text.lstrip("?").strip("()").split("|"):
        low = t.lower().lstrip("\\")
        if t:
            out.add(SAME.get(low, low) if low in SCALARS or low in SAME else t if t.endswith("[]") else "\\" + t.lstrip("\\"))
    return out


def narrow(types: set[str], cond: Node | None, scope: dict[str, set[str]]) -> dict[str, set[str]]:
    """The scope where a condition holds: instanceof and is_* name a variable's type."""
    if cond is None:
        return scope
    if cond.kind == "Paren":
        return narrow(types, cond.get("expr"), scope)
    if cond.kind == "Binary" and cond.attrs["op"] in ("&&", "and"):
        return narrow(types, cond.get("right"), narrow(types, cond.get("left"), scope))
    if (name := not_null(cond)) is not None:
        return scope | {name: scope.get(name, {"mixed"}) - {"null"} or {"mixed"}}
    if cond.kind == "Instanceof" and cond.get("expr").kind == "Var" and cond.get("class").kind == "Name":
        return scope | {cond.get("expr").attrs["name"]: {"\\" + cond.get("class").attrs["name"].lstrip("\\")}}
    if cond.kind == "Call" and cond.attrs["name"].lower() in ("is_int", "is_string", "is_bool", "is_float", "is_array", "is_null"):
        arg = cond.get("arg")
        if arg is not None and arg.parts and arg.parts[0][1].kind == "Var":
            to = cond.attrs["name"].lower()[3:]
            return scope | {arg.parts[0][1].attrs["name"]: {SAME.get(to, to)}}
    return scope


def _null_test(cond: Node, ops: tuple[str, str]) -> str | None:
    """The variable that a comparison with null by one of ``ops`` is about."""
    if cond.kind == "Binary" and cond.attrs["op"] in ops:
        sides = [cond.get("left"), cond.get("right")]
        for v, other in (sides, sides[::-1]):
            if v.kind == "Var" and other.kind == "Const" and other.attrs["name"].lower() == "null":
                return v.attrs["name"]
    return None


def _tested(n: Node) -> str | None:
    """The variable that isset() or a bare condition is about."""
    if n.kind == "Isset" and len(n.parts) == 1:
        n = n.parts[0][1].parts[0][1] if n.parts[0][1].parts else n
    return n.attrs["name"] if n.kind == "Var" else None


def not_null(cond: Node) -> str | None:
    """A variable that isn't null where the condition holds."""
    if cond.kind == "Unary" and cond.attrs["op"] == "!":
        return is_null(cond.get("expr"))
    return _null_test(cond, ("!==", "!=")) or _tested(cond)


def is_null(cond: Node) -> str | None:
    """A variable that isn't null where the condition doesn't hold."""
    if cond.kind == "Paren":
        return is_null(cond.get("expr"))
    if cond.kind == "Unary" and cond.attrs["op"] == "!":
        return _tested(cond.get("expr"))
    if cond.kind == "Call" and cond.attrs["name"].lower() == "is_null" and (a := cond.get("arg")) is not None and a.parts:
        return _tested(a.parts[0][1])
    return _null_test(cond, ("===", "=="))


def leaves(n: Node | None) -> bool:
    """Does a block end by leaving its function or loop?"""
    if n is None or n.kind == "Block":
        return bool(n and n.parts) and leaves(n.parts[-1][1])
    return n.kind in ("Return", "Continue", "Break") or n.kind == "Expr" and n.get("expr").kind in ("Throw", "Exit")


class Typer:
    def __init__(self) -> None:
        self.found: list[tuple[str, Node, set[str], bool]] = []
        self.fn = ""

    def function(self, n: Node, name: str) -> None:
        saved, self.fn = self.fn, name
        scope: dict[str, set[str]] = {}
        for p in n.all("param"):
            t = p.get("type")
            types = hint(t.attrs["text"]) if t else {"mixed"}
            if p.get("default") is not None and t is not None:
                types = types | (self.type(p.get("default"), {}) - {"mixed"})
            scope[p.attrs["name"]] = {f"{x}[]" for x in types} if p.attrs.get("variadic") else types
        self.walk(n.get("body"), scope)
        self.fn = saved

    def walk(self, n: Node | None, scope: dict[str, set[str]], cls: str = "") -> None:
        """Statements in order; branches work on copies whose types are united afterwards."""
        if n is None:
            return
        if n.kind in ("Function", "Method"):
            self.function(n, f"{cls}::{n.attrs['name']}" if n.kind == "Method" else n.attrs["name"])
        elif n.kind in ("Class", "Trait", "Enum", "Interface"):
            for _, m in n.parts:
                self.walk(m, {}, n.attrs.get("name", ""))
        elif n.kind == "If":
            after = []
            for arm in (n, *n.all("elseif")):
                self.type(arm.get("cond"), scope)
                inner = dict(narrow(set(), arm.get("cond"), scope))
                self.walk(arm.get("then"), inner)
                if not leaves(arm.get("then")):
                    after.append(inner)
            rest = dict(scope)
            if (name := is_null(n.get("cond"))) is not None and name in rest:
                rest[name] = rest[name] - {"null"} or {"mixed"}
            self.walk(n.get("else"), rest)
            for name in {k for s in (*after, rest) for k in s}:
                scope[name] = set().union(*(s.get(name, {"null"}) for s in (*after, rest)))
        elif n.kind == "Foreach":
            of = self.type(n.get("expr"), scope)
            value = n.get("value")
            if value is not None and value.kind == "Var":
                scope[value.attrs["name"]] = {t[:-2] for t in of if t.endswith("[]")} or {"mixed"}
            if (key := n.get("key")) is not None and key.kind == "Var":
                scope[key.attrs["name"]] = {"int", "string"}
            self.walk(n.get("body"), scope)
        elif n.kind == "Return":
            e = n.get("expr")
            types = self.type(e, scope) if e is not None else {"void"}
            self.found.append((self.fn, n, types, True))
        else:
            for _, x in n.parts:
                if x.kind in ("Block", "Case", "Catch", "If", "While", "For", "Do", "Foreach", "Switch", "Try", "Expr", "Return", "Echo", "Function", "Class", "Trait", "Enum", "Interface", "Namespace", "Unset", "Global", "Static"):
                    self.walk(x, scope)
                elif x.kind not in ("Name", "Comment", "UseItem", "Html", "Type", "Param"):
                    self.type(x, scope)

    def type(self, n: Node, scope: dict[str, set[str]]) -> set[str]:
        out = self._type(n, scope)
        self.found.append((self.fn, n, out, False))
        return out

    def _type(self, n: Node, scope: dict[str, set[str]]) -> set[str]:
        k, of = n.kind, lambda role: self.type(n.get(role), scope)
        if k == "Var":
            return set(scope.get(n.attrs["name"], {"mixed"}))
        if k in ("Int", "Float"):
            return {k.lower()}
        if k == "Assign":
            right, left = of("right"), n.get("left")
            op = n.attrs["op"]
            if op in (".=",):
                right = {"string"}
            elif op != "=" and op != "??=":
                right = self.arithmetic(op[:-1], self.type(left, scope), right)
            if left.kind == "Var":
                scope[left.attrs["name"]] = right
            elif left.kind == "Index" and left.get("base").kind == "Var":
                scope[left.get("base").attrs["name"]] = {f"{t}[]" for t in right}
            elif left.kind in ("Array", "List"):
                for item in left.all("item"):
                    v = item.get("value")
                    if v.kind == "Var":
                        scope[v.attrs["name"]] = {t[:-2] for t in right if t.endswith("[]")} or {"mixed"}
            return right
        if k == "Binary":
            op = n.attrs["op"]
            left, right = of("left"), of("right")
            if op in BOOL_OPS:
                return {"bool"}
            if op == "??":
                return left - {"null"} | right if left != {"null"} else right
            return self.arithmetic(op, left, right)
        if k == "Ternary":
            cond = of("cond")
            then = self.type(n.get("then"), dict(narrow(set(), n.get("cond"), scope))) if n.get("then") is not None else cond - {"null"}
            return then | of("else")
        if k == "Array":
            kinds = [self.type(i.get("value"), scope) for i in n.all("item")]
            if not kinds:
                return {"empty_array"}
            return {f"{t}[]" for t in kinds[0]} if all(x == kinds[0] for x in kinds) and len(kinds[0]) == 1 else {"mixed[]"}
        if k in ("Paren", "Clone", "Silence"):
            return of("expr")
        if k == "Cast":
            of("expr")
            return {SAME.get(n.attrs["to"], n.attrs["to"])}
        if k == "Unary":
            inner = of("expr")
            return {"bool"} if n.attrs["op"] == "!" else {"int"} if n.attrs["op"] == "~" else inner if inner <= {"int", "float"} else {"int", "float"}
        if k == "Const" and "name" in n.attrs:
            low = n.attrs["name"].lower()
            return {"bool"} if low in ("true", "false") else {"null"} if low == "null" else {"mixed"}
        if k == "Index":
            base = of("base")
            if n.get("dim") is not None:
                of("dim")
            return {t[:-2] for t in base if t.endswith("[]")} | ({"string"} if "string" in base else set()) or {"mixed"}
        if k == "New":
            for a in n.all("arg"):
                self.walk(a, scope)
            c = n.get("class")
            return {"\\" + c.attrs["name"].lstrip("\\")} if c.kind == "Name" else {"object"}
        if k in ("Closure", "ArrowFunction"):
            saved, self.fn = self.fn, f"{self.fn}{{closure}}"
            if k == "Closure":
                self.walk(n.get("body"), {p.attrs["name"]: {"mixed"} for p in n.all("param")})
            else:
                self.type(n.get("expr"), dict(scope))
            self.fn = saved
            return {"\\Closure"}
        for r, x in n.parts:
            if r == "fn" and x.kind == "Name":
                continue
            if x.kind in ("Arg", "Item", "MatchArm"):
                self.walk(x, scope)
            elif x.kind == "Class":
                self.walk(x, {})
            elif x.kind not in ("Name", "DeprecatedPart"):
                self.type(x, scope)
        if k == "Call":
            return {f"(){n.attrs['name'].lower().lstrip(chr(92))}"} if n.attrs["name"] else {"mixed"}
        if k in ("String", "Template", "Magic"):
            return {"int"} if n.attrs.get("name", "").lower() == "__line__" else {"string"}
        if k in ("Isset", "Empty", "Instanceof"):
            return {"bool"}
        if k == "ClassConstFetch":
            return {"string"} if n.attrs["name"].lower() == "class" else {"mixed"}
        return {"int"} if k in ("IncDec", "Print") else {"mixed"}

    @staticmethod
    def arithmetic(op: str, left: set[str], right: set[str]) -> set[str]:
        if op == ".":
            return {"string"}
        if op in ("&", "|", "^"):
            return {"string"} if left == right == {"string"} else {"int"}
        if op in ("<<", ">>", "%", "<=>"):
            return {"int"}
        if op == "+" and all(t.endswith("[]") or t == "empty_array" for t in left | right):
            return left | right
        return {"int"} if left == right == {"int"} and op != "/" else {"float"} if not any(t.startswith("()") for t in left | right) else {"int", "float"}


def expressions(files: DataFrame) -> DataFrame:
    """(path, fn, kind, start_pos, end_pos, types, returned) of every expression and return; sets are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        schema = pa.schema([("path", pa.string()), ("fn", pa.string()), ("kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("types", pa.list_(pa.string())), ("returned", pa.bool_())])
        sys.setrecursionlimit(DEEP)
        for batch in batches:
            out = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    tree, _ = parse(content or "")
                except (ParseError, RecursionError):
                    continue
                t = Typer()
                t.walk(tree, {})
                out += [{"path": path, "fn": fn, "kind": n.kind, "start_pos": n.start, "end_pos": n.end, "types": sorted(types), "returned": r} for fn, n, types, r in t.found]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select("path", "content").mapInArrow(run, TYPED)


def return_types(typed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fn, types) of every function (A13): its hint, else the union of what it returns, else void.

    A lazy call is replaced by what its function returns, one step in each round, until none is left;
    a call met before adds nothing, so cycles end. A function that reaches itself is mixed as well.
    """
    hints = nodes.where((F.col("kind") == "Type") & (F.col("role") == "ret") & (F.col("parent_kind") == "Function")).select(F.lower(F.substring_index("fn", "\\", -1)).alias("h_fn"), F.col("attrs")["text"].alias("h_text"))
    hinted = hints.groupBy("h_fn").agg(F.min("h_text").alias("h_text"))
    low = F.lower(F.regexp_replace("h_text", r"^\?", ""))
    scalar = F.when(low == "array", F.lit("mixed[]")).when(low.isin(*sorted(SCALARS)), low).otherwise(F.concat(F.lit("\\"), F.regexp_replace("h_text", r"^\??\\?", "")))
    members = F.when(F.startswith("h_text", F.lit("?")), F.array(scalar, F.lit("null"))).otherwise(F.array(scalar))
    all_fns = nodes.where(F.col("kind") == "Function").select(F.lower(F.col("attrs")["name"]).alias("fn")).distinct()
    returns = typed.where("returned").groupBy(F.lower("fn").alias("r_fn")).agg(sets.merged(F.col("types")).alias("r_types"))
    t = all_fns.join(hinted, F.col("fn") == F.col("h_fn"), "left").join(returns, F.col("fn") == F.col("r_fn"), "left")
    t = cut(t.select("fn", F.coalesce(F.when(F.col("h_text").isNotNull(), F.array_sort(members)), F.col("r_types"), F.array(F.lit("void"))).alias("types")))
    lazies = F.filter("types", lambda x: F.startswith(x, F.lit("()")))
    step, t = t, t.withColumn("seen", F.array().cast("array<string>"))
    while not t.where(F.size(lazies) > 0).isEmpty():
        met = t.withColumn("met", F.array_union("seen", lazies))
        new = resolve(t, step, ["fn"])
        t = cut(new.join(met.select("fn", "met"), "fn").select("fn", F.filter("types", lambda x: ~F.startswith(x, F.lit("()")) | ~F.array_contains("met", x)).alias("types"), F.col("met").alias("seen")))
    return t.select("fn", F.when(F.size("types") == 0, F.array(F.lit("mixed"))).otherwise(F.col("types")).alias("types"))


def resolve(typed: DataFrame, returns: DataFrame, keys: list[str]) -> DataFrame:
    """typed with lazies replaced once; unknown names are mixed, and so is a function's own name in its type."""
    lazy = F.exists("types", lambda x: F.startswith(x, F.lit("()")))
    r = returns.select(F.col("fn").alias("_fn"), F.col("types").alias("_types"))
    open_ = typed.where(lazy).select(*keys, F.explode("types").alias("t"))
    own = F.substring("t", F.lit(3), F.lit(1 << 20))
    j = open_.join(r, F.startswith("t", F.lit("()")) & (own == F.col("_fn")), "left")
    itself = (own == F.lower(F.col("fn"))) if "fn" in keys else F.lit(False)
    each = F.when(~F.startswith("t", F.lit("()")), F.array("t")).when(F.col("_types").isNull() | itself, F.array(F.lit("mixed"))).otherwise(F.col("_types"))
    return typed.where(~lazy).select(*keys, "types").unionByName(j.groupBy(*keys).agg(sets.merged(each).alias("types")))


def redundant_casts(nodes: DataFrame, typed: DataFrame) -> DataFrame:
    """redundantCast: a cast to the type that the expression has anyway."""
    kinds = typed.where(~F.col("returned")).select(F.col("path").alias("_p"), F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e"), "types").distinct()
    inner = nodes.where("role = 'expr' AND parent_kind = 'Cast'").select("path", F.col("parent_id").alias("node_id"), F.col("start_pos").alias("i_start"), F.col("end_pos").alias("i_end"))
    casts = nodes.where("kind = 'Cast'").join(inner, ["path", "node_id"]).join(kinds, (F.col("path") == F.col("_p")) & (F.col("i_start") == F.col("_s")) & (F.col("i_end") == F.col("_e")))
    to = F.col("attrs")["to"]
    return located(casts.where((F.size("types") == 1) & (F.col("types")[0] == F.when(to == "array", F.lit("mixed[]")).otherwise(to))).withColumns({"check_name": F.lit("redundantCast"), "level": F.lit(NOTICE), "message": F.format_string("expression already has %s type", to)}))
