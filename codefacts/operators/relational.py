"""Diagnostics that relate nodes to each other and to the symbols that all files declare.

Symbols are merged to one row for each name before they are joined, so a use meets one declaration.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.operators import hierarchy
from codefacts.operators.checks import ERROR, NOTICE, WARNING, a, c, has, kind, located, n, text_of
from codefacts.session import cut

#: Names that are always declared.
SPECIAL = ["self", "static", "parent"]
PHP_CLASSES = "stdClass Exception ErrorException Error TypeError ValueError ArithmeticError DivisionByZeroError Throwable Traversable Iterator IteratorAggregate ArrayAccess Countable Serializable Stringable JsonSerializable Closure Generator DateTime DateTimeImmutable DateTimeInterface DateInterval ArrayObject ArrayIterator SplObjectStorage InvalidArgumentException RuntimeException LogicException DomainException LengthException OutOfRangeException OutOfBoundsException RangeException OverflowException UnderflowException UnexpectedValueException BadFunctionCallException BadMethodCallException UnitEnum BackedEnum".split()


def short(name: Column) -> Column:
    return F.substring_index(name, "\\", -1)


def uses(nodes: DataFrame) -> DataFrame:
    """(path, alias, full): what a file's use lines import as classes."""
    return nodes.where(kind("UseItem") & (F.col("parent_kind") == "Use")).select("path", F.lower(a("alias")).alias("alias"), F.regexp_replace(a("name"), r"^\\", "").alias("full"))


def resolved(refs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """refs with ``full``: the class that a name means by the file's imports and namespace."""
    first = F.lower(F.substring_index(name, "\\", 1))
    u = uses(nodes).groupBy("path", "alias").agg(F.min("full").alias("imported")).withColumnRenamed("path", "_path")
    rest = F.substring(F.col(name), F.length(F.substring_index(name, "\\", 1)) + 1, F.lit(1 << 20))
    own = F.when(F.col("ns") == "", F.col(name)).otherwise(F.concat_ws("\\", "ns", name))
    full = F.when(F.startswith(F.col(name), F.lit("\\")), F.substring(F.col(name), F.lit(2), F.lit(1 << 20))).when(F.lower(name).isin("self", "static"), F.col("cls")).otherwise(F.coalesce(F.concat("imported", rest), own))
    return refs.join(u, (F.col("path") == F.col("_path")) & (first == F.col("alias")), "left").withColumn("full", full).drop("_path", "alias", "imported")


def classes(nodes: DataFrame) -> DataFrame:
    """One row for each class, interface, trait or enum: of several with one name the longest."""
    d = nodes.where(kind("Class", "Interface", "Trait", "Enum") & (a("name") != ""))
    best = F.max_by(F.struct("cls", "kind", F.coalesce(a("modifiers"), F.lit("")).alias("modifiers"), "doc", "path"), F.struct(F.col("end_line") - F.col("start_line"), "path"))
    return d.groupBy(F.lower("cls").alias("key")).agg(best.alias("b")).select("key", F.col("b.cls").alias("name"), F.col("b.kind").alias("what"), "b.modifiers", "b.doc")


def functions(nodes: DataFrame) -> DataFrame:
    """One row for each function: the least and largest number of arguments, its doc comment."""
    p = nodes.where(kind("Param")).groupBy("path", "parent_id").agg(
        F.count_if(~c("default.kind").isNotNull() & a("variadic").isNull()).alias("least"), F.max(F.when(a("variadic").isNotNull(), 1).otherwise(0)).alias("open"), F.count("*").alias("most")
    ).withColumnsRenamed({"path": "_p", "parent_id": "_id"})
    d = nodes.where(kind("Function", "Method"))
    d = d.join(p, (F.col("path") == F.col("_p")) & (F.col("node_id") == F.col("_id")), "left").na.fill(0, ["least", "most", "open"])
    best = F.max_by(F.struct("fn", "kind", "cls", a("name").alias("name"), F.coalesce(a("modifiers"), F.lit("")).alias("modifiers"), "doc", "least", "most", "parent_kind", c("body.kind").isNotNull().alias("has_body")), F.struct(F.col("end_line") - F.col("start_line"), "path"))
    return d.groupBy(F.lower("fn").alias("key")).agg(best.alias("b")).select("key", "b.*")


def edges(nodes: DataFrame) -> DataFrame:
    """(child, parent, kind) of the class hierarchy, in lower case."""
    refs = nodes.where(kind("Name") & F.col("role").isin("extends", "implements", "trait")).withColumn("name", a("name"))
    return resolved(refs, nodes, "name").select(F.lower("cls").alias("child"), F.lower("full").alias("parent"), F.col("role").alias("edge")).distinct()


def finding(df: DataFrame, name: str, level: int, message: Column | str) -> DataFrame:
    return located(df.withColumns({"check_name": F.lit(name), "level": F.lit(level), "message": F.lit(message) if isinstance(message, str) else message}))


class Symbols:
    """What all files declare: small next to the nodes, computed once and shared by the checks."""

    def __init__(self, nodes: DataFrame) -> None:
        self.functions, self.classes, self.edges = cut(functions(nodes)), cut(classes(nodes)), cut(edges(nodes))
        self.closure = hierarchy.closure(self.edges)


def undefined(nodes: DataFrame, symbols: Symbols, known_functions: list[str] = ()) -> DataFrame:
    """undefinedFunction, undefinedClass, undefinedTrait, nameMismatch, deprecated, argCount, newAbstract, invalidNew, badTraitUse."""
    f, k = symbols.functions, symbols.classes
    spark = nodes.sparkSession
    calls = nodes.where(kind("Call") & (a("name") != "")).withColumn("called", F.regexp_replace(a("name"), r"^\\", ""))
    calls = calls.withColumn("full_key", F.lower(F.when((F.col("ns") == "") | F.startswith(a("name"), F.lit("\\")), F.col("called")).otherwise(F.concat_ws("\\", "ns", "called")))).withColumn("root_key", F.lower("called"))
    plain = f.where("kind = 'Function'").select("key", F.col("fn").alias("declared"), F.col("doc").alias("fdoc"), "least", F.col("name").alias("fname"))
    one, two = plain.toDF(*[f"a_{x}" for x in plain.columns]), plain.toDF(*[f"b_{x}" for x in plain.columns])
    j = calls.join(one, F.col("full_key") == F.col("a_key"), "left").join(two, F.col("root_key") == F.col("b_key"), "left")
    j = j.select(*calls.columns, *[F.coalesce(f"a_{x}", f"b_{x}").alias(f"f_{x}") for x in plain.columns])
    builtin = spark.createDataFrame([(x.lower(),) for x in known_functions], "builtin string")
    missing = j.where("f_key IS NULL").join(F.broadcast(builtin), F.col("root_key") == F.col("builtin"), "left_anti")
    hit = j.where("f_key IS NOT NULL")
    spread = c("arg.any_spread").isNotNull()
    out = [
        finding(missing, "undefinedFunction", ERROR, text_of("Call to undefined function %s", F.col("called"))),
        finding(hit.where((n("arg") < F.col("f_least")) & ~spread), "argCount", ERROR, text_of("Too few arguments for %s, expecting %d, saw %d", F.col("called"), F.col("f_least"), n("arg"))),
        finding(hit.where(F.contains("f_fdoc", F.lit("@deprecated"))), "deprecated", NOTICE, text_of("Call to deprecated function %s", F.col("called"))),
        finding(hit.where((F.lower(short(F.col("called"))) == F.lower("f_fname")) & (short(F.col("called")) != F.col("f_fname"))), "nameMismatch", WARNING, text_of("%s should be spelled as %s", F.col("called"), F.col("f_declared"))),
    ]
    refs = nodes.where(kind("Name") & F.col("role").isin("class", "extends", "implements", "trait", "type") & F.col("parent_kind").isin("New", "StaticCall", "StaticProp", "ClassConstFetch", "Class", "Interface", "TraitUse", "Catch", "Instanceof") & ~F.lower(a("name")).isin(SPECIAL)).withColumn("name", a("name"))
    refs = resolved(refs, nodes, "name").withColumn("ref_key", F.lower("full"))
    r = cut(refs.join(k.toDF(*[f"k_{x}" for x in k.columns]), F.col("ref_key") == F.col("k_key"), "left"))
    php = [x.lower() for x in PHP_CLASSES]
    lost = r.where(F.col("k_key").isNull() & ~F.col("ref_key").isin(php))
    seen = r.where(F.col("k_key").isNotNull())
    new = seen.where("parent_kind = 'New'")
    out += [
        finding(lost.where("role <> 'trait'"), "undefinedClass", ERROR, text_of("Class or interface named \\%s does not exist", F.col("full"))),
        finding(lost.where("role = 'trait'"), "undefinedTrait", ERROR, text_of("Trait named \\%s does not exist", F.col("full"))),
        finding(seen.where((F.lower("full") == F.lower("k_name")) & (F.col("full") != F.col("k_name"))), "nameMismatch", WARNING, text_of("\\%s should be spelled \\%s", F.col("full"), F.col("k_name"))),
        finding(new.where(F.contains("k_modifiers", F.lit("abstract")) & (F.col("k_what") == "Class")), "newAbstract", ERROR, "Cannot instantiate abstract class"),
        finding(new.where(F.col("k_what").isin("Trait", "Interface")), "invalidNew", ERROR, text_of("Cannot instantiate %s %s", F.lower("k_what"), F.col("full"))),
        finding(seen.where(F.contains("k_doc", F.lit("@deprecated")) & (F.col("parent_kind") == "New")), "deprecated", NOTICE, text_of("Try to create instance of the class \\%s that was marked as deprecated", F.col("full"))),
        finding(seen.where((F.col("role") == "extends") & (F.col("parent_kind") == "Class") & F.contains("k_modifiers", F.lit("final"))), "invalidExtendClass", ERROR, text_of("Class %s may not inherit from final class %s", F.col("cls"), F.col("full"))),
        finding(nodes.where(kind("Name") & (F.col("role") == "class") & (F.lower(a("name")) == "parent") & (F.col("parent_kind") == "StaticCall")).join(symbols.edges.where("edge = 'extends'").select("child").distinct(), F.lower("cls") == F.col("child"), "left_anti"), "parentNotFound", ERROR, "Cannot call method on parent as this class does not extend another"),
    ]
    hints = nodes.where(kind("Type") & F.col("role").isin("type", "ret")).withColumn("name", F.regexp_replace(a("text"), r"^\?", ""))
    hinted = resolved(hints, nodes, "name").withColumn("ref_key", F.lower("full")).join(k.where("what = 'Trait'").select(F.col("key").alias("t_key")), F.col("ref_key") == F.col("t_key"))
    out.append(finding(hinted, "badTraitUse", WARNING, text_of("Cannot use trait %s as a type hint", F.col("name"))))
    return reduce(DataFrame.unionByName, out)


def members(nodes: DataFrame, symbols: Symbols) -> DataFrame:
    """undefinedMethod, accessLevel, callStatic, unimplemented, methodSignatureMismatch, parentConstructor."""
    e, f, k, up = symbols.edges, symbols.functions.where("kind = 'Method'"), symbols.classes, symbols.closure
    own = k.select(F.col("key").alias("child"), F.col("key").alias("ancestor"), F.lit(0).cast("long").alias("depth"))
    reach = up.unionByName(own)
    kinds = e.groupBy("parent").agg(F.min(F.when(F.col("edge") == "trait", 1).when(F.col("edge") == "extends", 2).otherwise(3)).alias("rank")).withColumnRenamed("parent", "anc")
    m = f.select(F.lower("cls").alias("owner"), F.lower("name").alias("member"), F.col("name").alias("m_name"), F.col("modifiers").alias("m_mods"), (F.contains("modifiers", F.lit("abstract")) | (F.col("parent_kind") == "Interface")).alias("is_abstract"))
    known = reach.join(m, F.col("ancestor") == F.col("owner")).join(kinds, F.col("ancestor") == F.col("anc"), "left")
    w = Window.partitionBy("child", "member").orderBy(F.col("is_abstract").cast("int"), "depth", F.coalesce("rank", F.lit(0)), "owner")
    # one row for each class and method: what a call of it means
    table = cut(known.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("child", "member", "owner", "m_name", "m_mods", "is_abstract"))
    static = resolved(nodes.where(kind("StaticCall") & (a("name") != "") & (c("class.kind") == "Name")).withColumn("name", c("class.name")), nodes, "name")
    static = static.where(F.lower("name") != "parent").select(*nodes.columns, F.lower("full").alias("on_class"), F.lit(True).alias("static_call"))
    this = nodes.where(kind("MethodCall") & (a("name") != "") & (c("base.name") == "this") & (c("base.kind") == "Var")).withColumns({"on_class": F.lower("cls"), "static_call": F.lit(False)})
    calls = static.unionByName(this).withColumn("wanted", F.lower(a("name")))
    there = calls.join(k.select(F.col("key").alias("have"), "what"), F.col("on_class") == F.col("have")).where("what <> 'Trait'")
    j = cut(there.join(table, (F.col("on_class") == F.col("child")) & (F.col("wanted") == F.col("member")), "left"))
    magic = table.where("member IN ('__call', '__callstatic')").select(F.col("child").alias("magic")).distinct()
    # what may inherit from outside can't be judged
    outside = up.join(k, F.col("ancestor") == F.col("key"), "left_anti").select(F.col("child").alias("opened")).distinct()
    lost = j.where("member IS NULL").join(magic, F.col("on_class") == F.col("magic"), "left_anti").join(outside, F.col("on_class") == F.col("opened"), "left_anti")
    hit = j.where("member IS NOT NULL")
    mods = F.concat(F.lit(" "), F.col("m_mods"), F.lit(" "))
    mine = F.lower("cls")
    inside = reach.select(F.col("child").alias("r_child"), F.col("ancestor").alias("r_anc")).distinct()
    protected = hit.where(F.contains(mods, F.lit(" protected ")) & (mine != F.col("owner"))).join(inside, (mine == F.col("r_child")) & (F.col("owner") == F.col("r_anc")), "left_anti")
    private = hit.where(F.contains(mods, F.lit(" private ")) & (mine != F.col("owner")))
    out = [
        finding(lost, "undefinedMethod", ERROR, text_of("Call to undefined method {\\%s}->%s()", F.col("on_class"), a("name"))),
        finding(private, "accessLevel", ERROR, text_of("Cannot access private method %s->%s()", F.col("owner"), F.col("m_name"))),
        finding(protected, "accessLevel", ERROR, text_of("Cannot access protected method %s->%s()", F.col("owner"), F.col("m_name"))),
        finding(hit.where(F.col("static_call") & ~F.contains(mods, F.lit(" static ")) & (mine != F.col("on_class"))), "callStatic", WARNING, "Calling instance method as static method"),
        finding(hit.where(~F.col("static_call") & F.contains(mods, F.lit(" static "))), "callStatic", WARNING, "Calling static method as instance method"),
        finding(hit.where((F.lower("m_name") == F.col("wanted")) & (F.col("m_name") != a("name"))), "nameMismatch", WARNING, text_of("%s should be spelled as %s", a("name"), F.col("m_name"))),
    ]
    concrete = nodes.where(kind("Class") & ~F.contains(F.coalesce(a("modifiers"), F.lit("")), F.lit("abstract"))).join(table.where("is_abstract").withColumnRenamed("child", "of"), F.lower("cls") == F.col("of"))
    out.append(finding(concrete, "unimplemented", ERROR, text_of("Class %s must implement %s::%s method", F.col("cls"), F.col("owner"), F.col("m_name"))))
    final = m.where(F.contains("m_mods", F.lit("final")) & ~F.contains("m_mods", F.lit("private"))).join(up, F.col("owner") == F.col("ancestor"))
    over = nodes.where(kind("Method")).join(final, (F.lower("cls") == F.col("child")) & (F.lower(a("name")) == F.col("member")))
    out.append(finding(over, "methodSignatureMismatch", ERROR, text_of("Method %s::%s is declared final and cannot be overridden", F.col("owner"), F.col("m_name"))))
    ctor = nodes.where(kind("Method") & (F.lower(a("name")) == "__construct")).join(e.where("edge = 'extends'"), F.lower("cls") == F.col("child"))
    ctor = ctor.join(table.where("member = '__construct' AND NOT is_abstract AND m_mods NOT LIKE '%private%'").select(F.col("child").alias("p_class")), F.col("parent") == F.col("p_class")).drop("child", "parent", "edge", "p_class")
    called = nodes.where(kind("StaticCall") & (F.lower(a("name")) == "__construct") & (F.lower(c("class.name")) == "parent")).select(F.col("path").alias("c_path"), F.col("fn").alias("c_fn")).distinct()
    out.append(finding(ctor.join(called, (F.col("path") == F.col("c_path")) & (F.col("fn") == F.col("c_fn")), "left_anti"), "parentConstructor", WARNING, "Missing parent::__construct() call"))
    return reduce(DataFrame.unionByName, [x.select("check_name", "level", "context", "message", "filename", "line", "start_char", "end_char") for x in out])


def siblings(nodes: DataFrame, symbols: Symbols) -> DataFrame:
    """dupArrayKeys, dupCond, dupCatch, catchOrder, dupGlobal, classMembersOrder, varShadow, argsReverse: nodes against others of one parent."""
    key = ["path", "parent_id"]

    def again(df: DataFrame, by: str) -> DataFrame:
        w = Window.partitionBy(*key, by).orderBy("ord")
        return df.withColumn("_n", F.row_number().over(w)).where("_n > 1")

    items = nodes.where(kind("Item") & c("key.kind").isin("String", "Int", "Const", "ClassConstFetch") & (F.col("parent_kind") == "Array")).withColumn("by", F.when(c("key.kind").isin("String", "Int"), c("key.value")).otherwise(c("key.hash")))
    conds = nodes.where(kind("Case") & c("cond.hash").isNotNull()).withColumn("by", c("cond.hash"))
    # a clause of several types exempts its whole try
    several = nodes.where(kind("Catch") & (n("type") > 1)).select(*key).distinct()
    single = nodes.where(kind("Catch") & (n("type") == 1)).join(several, key, "left_anti")
    catches = single.withColumn("by", F.lower(c("type.name")))
    globals_ = nodes.where(kind("Var") & (F.col("parent_kind") == "Global")).withColumn("by", a("name"))
    out = [
        finding(again(items, "by"), "dupArrayKeys", WARNING, text_of("Duplicate array key %s", c("key.text"))),
        finding(again(conds, "by"), "dupCond", WARNING, text_of("Duplicated switch case for expression %s", c("cond.text"))),
        finding(again(catches, "by"), "dupCatch", WARNING, text_of("Duplicated catch on %s", c("type.name"))),
        finding(again(globals_, "by"), "dupGlobal", WARNING, text_of("Global statement mentions $%s more than once", a("name"))),
    ]
    # conditions without effects that stand earlier in their chain: that of the if itself, then those of its elseifs
    ifs = nodes.where(kind("If") & has("elseif") & (c("cond.pure") == "1")).withColumns({"parent_id": F.col("node_id"), "ord": F.lit(-1)})
    chain = ifs.unionByName(nodes.where(kind("Elseif") & (c("cond.pure") == "1"))).withColumn("by", c("cond.hash"))
    out.append(finding(again(chain, "by"), "dupCond", WARNING, "This condition stands earlier in the same if-else chain"))
    up = symbols.closure.select(F.col("child").alias("sub"), F.col("ancestor").alias("sup"))
    full = resolved(single.withColumn("name", c("type.name")), nodes, "name").withColumn("key", F.lower("full"))
    earlier = full.select(F.col("path").alias("e_path"), F.col("parent_id").alias("e_id"), F.col("ord").alias("e_ord"), F.col("key").alias("e_key"), F.col("full").alias("e_full"))
    covered = full.join(earlier, (F.col("path") == F.col("e_path")) & (F.col("parent_id") == F.col("e_id")) & (F.col("e_ord") < F.col("ord"))).join(up, (F.col("key") == F.col("sub")) & (F.col("e_key") == F.col("sup")))
    out.append(finding(covered.dropDuplicates(["path", "node_id"]), "catchOrder", WARNING, text_of("Catch %s block will never run as it extends %s which is caught above", F.col("full"), F.col("e_full"))))
    first_method = nodes.where(kind("Method") & (F.col("parent_kind") == "Class")).groupBy(*key).agg(F.min("ord").alias("first"))
    late = nodes.where(kind("Property", "ClassConst") & (F.col("parent_kind") == "Class")).join(first_method, key).where("ord > first")
    out.append(finding(late, "classMembersOrder", NOTICE, text_of("%s must go before methods in the class", F.when(kind("Property"), F.concat(F.lit("Property $"), c("item.name"))).otherwise(F.concat(F.lit("Constant "), c("item.name"))))))
    params = nodes.where(kind("Param") & (F.col("fn") != "")).select(F.col("path").alias("p_path"), F.col("fn").alias("p_fn"), a("name").alias("p_name")).distinct()
    loops = nodes.where(kind("Var") & (F.col("parent_kind") == "Foreach") & F.col("role").isin("value", "key"))
    out.append(finding(loops.join(params, (F.col("path") == F.col("p_path")) & (F.col("fn") == F.col("p_fn")) & (a("name") == F.col("p_name")), "left_semi"), "varShadow", WARNING, text_of("Variable $%s shadow existing variable $%s from current function params", a("name"), a("name"))))
    return reduce(DataFrame.unionByName, out)


# Scalar type names, with the long names that doc comments use
SCALARS = {"int": "int", "integer": "int", "float": "float", "double": "float", "string": "string", "bool": "bool", "boolean": "bool"}


def params(nodes: DataFrame) -> DataFrame:
    """(callee, pos, p_name, p_type, p_default) of functions; positions count from 0."""
    p = nodes.where(kind("Param") & (F.col("parent_kind") == "Function"))
    w = Window.partitionBy("path", "parent_id").orderBy("ord")
    p = p.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
    own = F.lower(F.regexp_replace("fn", r"^\\", ""))
    # of several functions of one name the first by path
    best = F.min_by(F.struct(a("name").alias("p_name"), c("type.text").alias("p_type"), F.lower(c("default.text")).alias("p_default")), F.struct("path", "parent_id"))
    return p.groupBy(own.alias("callee"), "pos").agg(best.alias("b")).select("callee", "pos", "b.*")


def arguments(nodes: DataFrame) -> DataFrame:
    """notNullSafetyFunctionArgumentConstFetch, argsReverse: arguments against the parameters at their places."""
    calls = nodes.where(kind("Call") & (a("name") != "")).select("path", F.col("node_id").alias("parent_id"), F.lower(F.regexp_replace(a("name"), r"^\\", "")).alias("called"), c("arg.name").alias("first_arg"), c("arg1.name").alias("second_arg"), n("arg").alias("n_args"))
    p = params(nodes)
    nulls = nodes.where(kind("Arg") & (F.col("parent_kind") == "Call") & (c("expr.kind") == "Const") & (F.lower(c("expr.name")) == "null")).withColumn("at", F.col("ord") - 1)
    j = nulls.join(calls, ["path", "parent_id"]).join(p, (F.col("called") == F.col("callee")) & (F.col("at") == F.col("pos")))
    strict = F.col("p_type").isNotNull() & ~F.lower("p_type").rlike(r"^\?|\bnull\b|^mixed$") & ~F.coalesce(F.col("p_default") == "null", F.lit(False))
    first = p.where("pos = 0").select(F.col("callee").alias("f0"), F.col("p_name").alias("n0"))
    second = p.where("pos = 1").select(F.col("callee").alias("f1"), F.col("p_name").alias("n1"))
    swapped = calls.where("n_args >= 2").join(first, F.col("called") == F.col("f0")).join(second, F.col("called") == F.col("f1")).where("first_arg = n1 AND second_arg = n0")
    swapped = swapped.select("path", F.col("parent_id").alias("node_id"), "n0", "n1")
    return finding(j.where(strict), "notNullSafetyFunctionArgumentConstFetch", WARNING, text_of("null passed to non-nullable parameter %s in function %s", F.col("p_name"), F.col("called"))).unionByName(
        finding(nodes.where(kind("Call")).join(swapped, ["path", "node_id"]), "argsReverse", WARNING, text_of("Perhaps the arguments are swapped: $%s is the second parameter", F.col("n1")))
    )


def docs(nodes: DataFrame, symbols: Symbols) -> DataFrame:
    """funcParamTypeMissMatch, invalidDocblockRef, invalidDocblock: doc comments against what they describe."""
    d = nodes.where(kind("Function", "Method") & (F.col("doc") != ""))
    tags = d.select("*", F.explode(F.regexp_extract_all("doc", F.lit(r"@param\s+[^\s$*]+\s+\$\w+"), F.lit(0))).alias("tag")).withColumns({"d_type": F.regexp_extract("tag", r"@param\s+(\S+)", 1), "d_name": F.regexp_extract("tag", r"\$(\w+)", 1)})
    p = nodes.where(kind("Param")).select(F.col("path").alias("q_path"), F.col("parent_id").alias("q_id"), a("name").alias("q_name"), c("type.text").alias("q_type"))
    on = (F.col("path") == F.col("q_path")) & (F.col("node_id") == F.col("q_id"))
    scalar = F.create_map(*[F.lit(x) for kv in SCALARS.items() for x in kv])
    said, hinted = scalar[F.lower("d_type")], scalar[F.lower("q_type")]
    wrong = tags.join(p, on & (F.col("d_name") == F.col("q_name"))).where(said.isNotNull() & hinted.isNotNull() & (said != hinted))
    unknown = tags.join(p, on & (F.col("d_name") == F.col("q_name")), "left_anti")
    refs = nodes.where(F.col("doc") != "").select("*", F.explode(F.regexp_extract_all("doc", F.lit(r"@see\s+\\?([A-Za-z_][\w\\]*)(?:::|\(|\s)"), F.lit(1))).alias("ref"))
    names = symbols.classes.select("key").unionByName(symbols.functions.where("kind = 'Function'").select("key"))
    names = names.select(F.substring_index("key", "\\", -1).alias("known")).distinct()
    lost = refs.where(~F.col("ref").isin("http", "https")).join(names, F.lower(short(F.col("ref"))) == F.col("known"), "left_anti")
    return reduce(
        DataFrame.unionByName,
        [
            finding(wrong, "funcParamTypeMissMatch", WARNING, text_of("Param $%s miss matched with phpdoc type <<%s>>", F.col("q_name"), F.col("d_type"))),
            finding(unknown, "invalidDocblock", WARNING, text_of("@param for non-existing argument $%s", F.col("d_name"))),
            finding(lost, "invalidDocblockRef", WARNING, text_of("@see tag refers to unknown symbol %s", F.col("ref"))),
        ],
    )
