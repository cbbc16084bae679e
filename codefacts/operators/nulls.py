"""Null safety: what may be null against parameters and receivers that can't be.

Types come from the pass over each file; a call's from the merged return types. Expressions, arguments
and parameters meet in joins on positions and names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import sets
from codefacts.operators import relational, types
from codefacts.operators.checks import ERROR, WARNING, a, c, kind, text_of
from codefacts.operators.relational import Symbols, finding, resolved
from codefacts.session import cut

#: Kinds of an argument's expression and the check about them
ARGUMENTS = {"Var": "notNullSafetyFunctionArgumentVariable", "Call": "notNullSafetyFunctionArgumentFunctionCall", "StaticCall": "notNullSafetyFunctionArgumentStaticFunctionCall", "Prop": "notNullSafetyFunctionArgumentPropertyFetch", "StaticProp": "notNullSafetyFunctionArgumentPropertyFetch", "Index": "notNullSafetyFunctionArgumentArrayDimFetch", "Array": "notNullSafetyFunctionArgumentList", "List": "notNullSafetyFunctionArgumentList"}
PLAIN = ["int", "float", "string", "bool"]


def _null(types_: Column) -> Column:
    return F.array_contains(types_, "null")


def hinted(nodes: DataFrame, parent: str, role: str) -> DataFrame:
    """(owner, member, types) of the members of classes that have a type."""
    h = nodes.where(kind("Type") & (F.col("role") == role) & (F.col("parent_kind") == parent))
    low = F.lower(F.regexp_replace(a("text"), r"^\\?", ""))
    members = F.split(low, r"\\|")
    return h.select("path", "parent_id", F.lower("cls").alias("owner"), F.lower("fn").alias("of"), F.array_sort(F.when(F.startswith(a("text"), F.lit("?")), F.array_union(members, F.array(F.lit("null")))).otherwise(members)).alias("h_types"))


def expression_types(nodes: DataFrame, typed: DataFrame) -> DataFrame:
    """(path, start_pos, end_pos, types) of every expression: calls by what they return, members of classes by their hints."""
    at = ["path", "start_pos", "end_pos"]
    each = typed.where(~F.col("returned")).groupBy(*at).agg(sets.merged(F.col("types")).alias("types"))
    known = types.resolve(each, types.return_types(typed, nodes), at)
    methods = hinted(nodes, "Method", "ret").groupBy("of").agg(F.first("h_types").alias("m_types"))
    static = resolved(nodes.where(kind("StaticCall") & (a("name") != "") & (c("class.kind") == "Name")).withColumn("name", c("class.name")), nodes, "name")
    static = static.withColumn("of", F.lower(F.concat(F.col("full"), F.lit("::"), a("name")))).join(methods, "of").select(*at, "m_types")
    this = nodes.where(kind("MethodCall") & (c("base.name") == "this")).withColumn("of", F.lower(F.concat(F.col("cls"), F.lit("::"), a("name")))).join(methods, "of").select(*at, "m_types")
    items = nodes.where(kind("PropertyItem")).select("path", "parent_id", F.lower("cls").alias("p_cls"), a("name").alias("p_name"))
    props = items.join(hinted(nodes, "Property", "type").select("path", "parent_id", "h_types"), ["path", "parent_id"]).groupBy("p_cls", "p_name").agg(F.first("h_types").alias("m_types"))
    fetch = nodes.where(kind("Prop") & (c("base.name") == "this")).select(*at, F.lower("cls").alias("p_cls"), a("name").alias("p_name")).join(props, ["p_cls", "p_name"]).select(*at, "m_types")
    better = static.unionByName(this).unionByName(fetch).groupBy(*at).agg(F.first("m_types").alias("m_types"))
    return cut(known.join(better, at, "left").select(*at, F.coalesce("m_types", "types").alias("types")))


def findings(nodes: DataFrame, typed: DataFrame, symbols: Symbols) -> DataFrame:
    """The null-safety checks, voidResultUsed and arrayAccess."""
    at = ["path", "start_pos", "end_pos"]
    t = expression_types(nodes, typed)
    inner = nodes.where((F.col("role") == "expr") & (F.col("parent_kind") == "Arg")).join(t, at)
    args = nodes.where(kind("Arg") & (F.col("parent_kind") == "Call")).select("path", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("call_id"), (F.col("ord") - 1).alias("at"))
    calls = nodes.where(kind("Call") & (a("name") != "")).select("path", F.col("node_id").alias("call_id"), F.lower(F.regexp_replace(a("name"), r"^\\", "")).alias("callee"))
    params = relational.params(nodes).withColumnRenamed("pos", "at")
    given = cut(inner.join(args, ["path", "parent_id"]).join(calls, ["path", "call_id"]).join(params, ["callee", "at"]))
    strict = F.col("p_type").isNotNull() & ~F.lower("p_type").rlike(r"^\?|\bnull\b|^mixed$") & ~F.coalesce(F.col("p_default") == "null", F.lit(False))
    # of an indexed value the base counts, of a list its elements
    base = nodes.where((F.col("role") == "base") & (F.col("parent_kind") == "Index") & kind("Var")).join(t, at).where(_null(F.col("types"))).select("path", F.col("parent_id").alias("node_id")).distinct()
    element = nodes.where((F.col("role") == "value") & (F.col("parent_kind") == "Item") & kind("Var")).join(t, at).where(_null(F.col("types"))).select("path", F.col("parent_id").alias("item_id"))
    element = element.join(nodes.where(kind("Item")).select("path", F.col("node_id").alias("item_id"), F.col("parent_id").alias("node_id")), ["path", "item_id"]).select("path", "node_id").distinct()
    of = given.where(strict)
    name = F.create_map(*[F.lit(x) for kv in ARGUMENTS.items() for x in kv])[F.col("kind")]
    direct = of.where(~kind("Index", "Array", "List") & _null(F.col("types")) & name.isNotNull())
    parts = of.where(kind("Index")).join(base, ["path", "node_id"], "left_semi").unionByName(of.where(kind("Array", "List")).join(element, ["path", "node_id"], "left_semi"))
    message = text_of("%s can't take null for parameter $%s, which this may be", F.col("callee"), F.col("p_name"))
    hits = direct.unionByName(parts).withColumns({"check_name": name, "level": F.lit(ERROR), "message": message})
    one = F.col("types")[0]
    wrong = given.where((F.size("types") == 1) & one.isin(*PLAIN) & F.lower("p_type").isin(*PLAIN) & (one != F.lower("p_type")) & ~((one == "int") & (F.lower("p_type") == "float")))
    out = [relational.located(hits), finding(wrong, "notSafeCall", ERROR, text_of("%s takes %s for parameter $%s, this is %s", F.col("callee"), F.col("p_type"), F.col("p_name"), one))]
    safe = nodes.where(kind("Prop", "MethodCall") & (a("nullsafe") == "1")).select("path", F.col("node_id").alias("parent_id"))
    recv = nodes.where((F.col("role") == "base") & F.col("parent_kind").isin("Prop", "MethodCall") & ~(kind("Var") & (a("name") == "this"))).join(t, at).where(_null(F.col("types"))).join(safe, ["path", "parent_id"], "left_anti")
    method = F.col("parent_kind") == "MethodCall"
    out += [
        finding(recv.where(~method), "notNullSafetyPropertyFetch", ERROR, "A property is read of what may be null"),
        finding(recv.where(method & kind("Var")), "notNullSafetyVariable", ERROR, text_of("A method is called on $%s, which may be null", a("name"))),
        finding(recv.where(method & kind("Call")), "notNullSafetyFunctionCall", ERROR, text_of("A method is called on the result of %s, which may be null", a("name"))),
        finding(nodes.where((F.col("role") == "class") & (F.col("parent_kind") == "StaticCall") & kind("Var")).join(t, at).where(_null(F.col("types"))), "notNullSafetyStaticFunctionCall", ERROR, text_of("A static method is called on $%s, which may be null", a("name"))),
    ]
    void = nodes.where(kind("Call") & (F.col("parent_kind") != "Expr")).join(t, at).where((F.size("types") == 1) & (one == "void"))
    out.append(finding(void, "voidResultUsed", WARNING, text_of("%s gives no value that could be used", a("name"))))
    # an index into an object whose class, known with all its ancestors, isn't ArrayAccess
    indexed = nodes.where((F.col("role") == "base") & (F.col("parent_kind") == "Index")).join(t, at).where((F.size("types") == 1) & F.startswith(one, F.lit("\\"))).withColumn("key", F.lower(F.substring(one, F.lit(2), F.lit(1 << 20))))
    able = symbols.closure.where("ancestor = 'arrayaccess'").select(F.col("child").alias("key"))
    out.append(finding(indexed.join(symbols.classes.select("key"), "key", "left_semi").join(able, "key", "left_anti"), "arrayAccess", WARNING, text_of("%s can't be indexed", one)))
    return reduce(DataFrame.unionByName, out)
