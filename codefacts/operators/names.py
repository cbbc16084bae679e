"""Properties and constants along the class hierarchy, and constants of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.operators import hierarchy
from codefacts.operators.checks import ERROR, WARNING, a, c, const_of, kind, text_of
from codefacts.operators.relational import SPECIAL, Symbols, finding, resolved, short

#: Constants and prefixes of constants that PHP declares
BUILTIN = ["true", "false", "null", "nan", "inf", "stdin", "stdout", "stderr", "directory_separator", "path_separator"]
PREFIXES = r"^(?i)(php|e|m|lc|json|preg|count|sort|lock|file|seek|ent|filter|mb|curlopt|curlinfo|curl|openssl|password|pathinfo|str|array|extr|log|sig|so|af|sock|date|debug|dns|glob|ini|info|credits|libxml|xml|zlib|gzip|scandir|stream|token|t)_"


def properties(nodes: DataFrame) -> DataFrame:
    """(cls, member, modifiers) of declared properties, promoted parameters and those of @property tags."""
    own = nodes.where(kind("Property")).select("path", F.col("node_id").alias("parent_id"), F.coalesce(a("modifiers"), F.lit("")).alias("modifiers"))
    items = nodes.where(kind("PropertyItem")).select("path", "parent_id", F.lower("cls").alias("cls"), a("name").alias("member")).join(own, ["path", "parent_id"]).select("cls", "member", "modifiers")
    promoted = nodes.where(kind("Param") & a("promoted").isNotNull()).select(F.lower("cls").alias("cls"), a("name").alias("member"), a("promoted").alias("modifiers"))
    tags = nodes.where(kind("Class") & F.contains("doc", F.lit("@property"))).select(F.lower("cls").alias("cls"), F.explode(F.regexp_extract_all("doc", F.lit(r"@property(?:-read|-write)?\s+\S+\s+\$(\w+)"), F.lit(1))).alias("member"), F.lit("public").alias("modifiers"))
    return items.unionByName(promoted).unionByName(tags).groupBy("cls", "member").agg(F.min("modifiers").alias("modifiers"))


def class_constants(nodes: DataFrame) -> DataFrame:
    """(cls, member, modifiers) of the constants and cases of classes."""
    items = nodes.where(kind("ConstItem") & (F.col("parent_kind") == "ClassConst")).select(F.lower("cls").alias("cls"), a("name").alias("member"))
    cases = nodes.where(kind("EnumCase")).select(F.lower("cls").alias("cls"), a("name").alias("member"))
    return items.unionByName(cases).distinct().withColumn("modifiers", F.lit(""))


def ancestry(symbols: Symbols) -> DataFrame:
    """(child, ancestor, depth, kind) with each class its own ancestor, for hierarchy.resolve."""
    own = symbols.classes.select(F.col("key").alias("child"), F.col("key").alias("ancestor"), F.lit(0).cast("long").alias("depth"), F.lit("own").alias("kind"))
    edge = symbols.edges.groupBy("parent").agg(F.min("edge").alias("kind"))
    return own.unionByName(symbols.closure.join(edge, F.col("ancestor") == F.col("parent")).select("child", "ancestor", "depth", "kind"))


def lookup(uses: DataFrame, members: DataFrame, symbols: Symbols) -> DataFrame:
    """Uses of (on, member_name) with what the member is found to be (``owner`` null: nothing); uses on classes that may inherit from outside, or that aren't known, are left out."""
    outside = symbols.closure.join(symbols.classes, F.col("ancestor") == F.col("key"), "left_anti").select(F.col("child").alias("on")).distinct()
    judged = uses.join(symbols.classes.select(F.col("key").alias("on"), "what"), "on").join(outside, "on", "left_anti")
    wanted = judged.select(F.col("on").alias("cls"), F.col("member_name").alias("name")).distinct()
    found = hierarchy.resolve(wanted, members.withColumn("is_abstract", F.lit(False)), ancestry(symbols), ["own", "trait", "extends", "implements"])
    found = found.where(F.col("name") == F.col("member")).select(F.col("cls").alias("on"), F.col("name").alias("member_name"), "owner", F.col("modifiers").alias("m_mods"))
    return judged.join(found, ["on", "member_name"], "left")


def findings(nodes: DataFrame, symbols: Symbols) -> DataFrame:
    """undefinedProperty, undefinedConstant, accessLevel of properties, propNullDefault."""
    magic = symbols.functions.where("kind = 'Method'").where(F.lower("name").isin("__get", "__set")).select(F.lower("cls").alias("m_cls"))
    reach = ancestry(symbols).join(magic, F.col("ancestor") == F.col("m_cls")).select(F.col("child").alias("on")).distinct()
    this = nodes.where(kind("Prop") & (a("name") != "") & (c("base.kind") == "Var") & (c("base.name") == "this")).withColumns({"on": F.lower("cls"), "member_name": a("name")})
    static = resolved(nodes.where(kind("StaticProp") & (a("name") != "") & (c("class.kind") == "Name") & (F.lower(c("class.name")) != "parent")).withColumn("name", c("class.name")), nodes, "name")
    static = static.withColumns({"on": F.lower("full"), "member_name": a("name")}).select(this.columns)
    used = lookup(this.unionByName(static), properties(nodes), symbols).where("what <> 'Trait'")
    lost = used.where("owner IS NULL").join(reach, "on", "left_anti")
    hidden = used.where(F.col("owner").isNotNull() & F.contains("m_mods", F.lit("private")) & (F.lower("cls") != F.col("owner")))
    consts = resolved(nodes.where(kind("ClassConstFetch") & (a("name") != "") & (F.lower(a("name")) != "class") & (c("class.kind") == "Const")).withColumn("name", c("class.name")).unionByName(nodes.where(kind("ClassConstFetch") & (a("name") != "") & (F.lower(a("name")) != "class") & (c("class.kind") == "Name")).withColumn("name", c("class.name"))), nodes, "name")
    consts = consts.where(F.lower("name") != "parent").withColumns({"on": F.lower("full"), "member_name": a("name")})
    unknown = lookup(consts, class_constants(nodes), symbols).where("owner IS NULL")
    declared = nodes.where(kind("ConstItem") & (F.col("parent_kind") == "Const")).select(a("name").alias("known"))
    defined = nodes.where(kind("Call") & (F.lower(a("name")) == "define") & (c("arg.inner") == "String")).select(c("arg.value").alias("known"))
    names = declared.unionByName(defined).distinct()
    refs = nodes.where(kind("Const") & ~F.lower(a("name")).isin(*BUILTIN, *SPECIAL) & ~a("name").rlike(PREFIXES)).withColumn("known", short(a("name")))
    prop = nodes.where(kind("PropertyItem") & const_of("default", "null"))
    hints = nodes.where(kind("Type") & (F.col("role") == "type") & (F.col("parent_kind") == "Property") & ~F.lower(a("text")).rlike(r"^\?|\bnull\b|^mixed$")).select("path", "parent_id", a("text").alias("hint"))
    return reduce(
        DataFrame.unionByName,
        [
            finding(lost, "undefinedProperty", ERROR, text_of("%s has no property $%s", F.col("on"), F.col("member_name"))),
            finding(hidden, "accessLevel", ERROR, text_of("Property $%s is private to %s", F.col("member_name"), F.col("owner"))),
            finding(unknown, "undefinedConstant", ERROR, text_of("%s has no constant %s", F.col("on"), F.col("member_name"))),
            finding(refs.join(names, "known", "left_anti"), "undefinedConstant", ERROR, text_of("No constant %s is declared", a("name"))),
            finding(prop.join(hints, ["path", "parent_id"]), "propNullDefault", WARNING, text_of("$%s is null at first, though %s isn't nullable", a("name"), F.col("hint"))),
        ],
    )
