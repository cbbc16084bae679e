"""Diagnostics on single nodes: one scan of the node rows evaluates all of them.

A check is a predicate and a message over a row of ``nodes``. The scan makes an array of the findings
of a row, by the checks of its kind, and explodes it; nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import text

ERROR, WARNING, NOTICE = 1, 2, 3
FINDINGS = ["check_name", "level", "context", "message", "filename", "line", "start_char", "end_char"]


@dataclass(frozen=True)
class Check:
    name: str
    level: int
    when: Column
    message: Column | str
    default: bool = True
    fix: Column | None = None  # the node's new text
    comment: str = ""
    kinds: tuple[str, ...] = ()  # no node of another kind meets ``when``; empty: any may


def kind(*names: str) -> Column:
    return F.col("kind").isin(*names) if len(names) > 1 else F.col("kind") == names[0]


def a(name: str) -> Column:
    """An attribute of the node."""
    return F.col("attrs")[name]


def c(name: str) -> Column:
    """Something about the first child of a role, such as ``left.hash``."""
    return F.col("kids")[name]


def has(name: str) -> Column:
    return c(f"{name}.n").isNotNull()


def n(role: str) -> Column:
    return F.coalesce(c(f"{role}.n").cast("int"), F.lit(0))


def call(*names: str) -> Column:
    return (F.col("kind") == "Call") & F.lower(F.regexp_replace(a("name"), r"^\\", "")).isin(*names)


def const_of(role: str, *values: str) -> Column:
    return (F.coalesce(c(f"{role}.inner"), c(f"{role}.kind")) == "Const") & F.lower(c(f"{role}.name")).isin(*values)


def text_of(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *values)


# Names that PHP gives a meaning
SUPERGLOBALS = ["_GET", "_POST", "_COOKIE", "_REQUEST", "_SERVER", "_SESSION", "_FILES", "_ENV", "GLOBALS"]
ALIASES = {"doubleval": "floatval", "is_integer": "is_int", "is_long": "is_int", "is_double": "is_float", "is_real": "is_float", "join": "implode", "sizeof": "count", "chop": "rtrim", "strchr": "strstr", "pos": "current", "key_exists": "array_key_exists", "ini_alter": "ini_set", "is_writeable": "is_writable", "fputs": "fwrite", "set_file_buffer": "stream_set_write_buffer", "show_source": "highlight_file", "close": "closedir", "dir": "getdir", "diskfreespace": "disk_free_space", "getrandmax": "mt_getrandmax", "rand": "mt_rand", "srand": "mt_srand"}
MAGIC_METHODS = {"__construct": -1, "__destruct": 0, "__call": 2, "__callstatic": 2, "__get": 1, "__set": 2, "__isset": 1, "__unset": 1, "__sleep": 0, "__wakeup": 0, "__serialize": 0, "__unserialize": 1, "__tostring": 0, "__invoke": -1, "__set_state": 1, "__clone": 0, "__debuginfo": 0}
TYPE_TESTS = {"array": "is_array", "boolean": "is_bool", "double": "is_float", "integer": "is_int", "NULL": "is_null", "object": "is_object", "resource": "is_resource", "string": "is_string"}
COMPARISONS = ["==", "!=", "===", "!==", "<", "<=", ">", ">="]
FLIPPED = {"+": "-", "-": "+"}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def structural() -> list[Check]:
    """The checks that look at a node and its direct children."""
    pure = F.col("pure")
    op, lower_name = a("op"), F.lower(F.coalesce(a("name"), F.lit("")))
    same = c("left.hash") == c("right.hash")
    mods = F.concat(F.lit(" "), F.coalesce(a("modifiers"), F.lit("")), F.lit(" "))
    public = ~F.contains(mods, F.lit(" private ")) & ~F.contains(mods, F.lit(" protected "))
    access = mods.rlike(" (public|protected|private|var) ")
    keyword = a("keyword")
    args = n("arg")
    binary_in = lambda role, ops: (c(f"{role}.kind") == "Binary") & c(f"{role}.op").isin(ops)
    lit = F.lit
    tests = _map(TYPE_TESTS)
    wanted = F.size(F.filter(text.directives(c("arg.value")), lambda d: d != "%%"))
    formats = call("sprintf", "printf") & (c("arg.inner") == "String") & c("arg.any_spread").isNull() & ~c("arg.value").rlike(r"%\d+\$")
    out = [
        Check("syntax", ERROR, kind("SyntaxError"), a("message"), comment="Report syntax errors.", kinds=("SyntaxError",)),
        Check("emptyStmt", WARNING, kind("Nop") & F.col("parent_kind").isin("Block", "Case", "File", "Namespace") & ~(F.col("text") == "?>") & (F.col("role") == "stmt") & (F.col("parent_bare") == ""), "Semicolon (;) is not needed here, it can be safely removed", kinds=("Nop",)),
        Check("intOverflow", WARNING, kind("Float") & F.col("text").rlike(r"^[0-9]+$"), text_of("%s will be interpreted as float due to the overflow", F.col("text")), kinds=("Float",)),
        Check("phpAliases", NOTICE, F.when(kind("Call"), _map(ALIASES)[lower_name].isNotNull()).otherwise(False), text_of("Use %s instead of '%s'", _map(ALIASES)[lower_name], a("name")), fix=F.concat(_map(ALIASES)[lower_name], F.substring(F.col("text"), F.length(a("name")) + 1, lit(1 << 20))), kinds=("Call",)),
        Check("keywordCase", NOTICE, keyword.isNotNull() & (keyword != F.lower(keyword)), text_of("Use %s instead of %s", F.lower(keyword), keyword)),
        Check("keywordCase", NOTICE, F.coalesce(a("raw_modifiers") != a("modifiers"), lit(False)), text_of("Use %s instead of %s", a("modifiers"), a("raw_modifiers"))),
        Check("constCase", NOTICE, kind("Const") & lower_name.isin("true", "false", "null") & (a("name") != lower_name), text_of("Constant '%s' should be used in lower case as '%s'", a("name"), lower_name), fix=lower_name, kinds=("Const",)),
        Check("redundantGlobal", WARNING, (F.col("parent_kind") == "Global") & a("name").isin(SUPERGLOBALS), text_of("%s is superglobal", a("name"))),
        Check("dupSubExpr", WARNING, kind("Binary") & same & pure & op.isin(*COMPARISONS, "&&", "||", "and", "or", "xor", "-", "/", "%", "&", "|", "^", "<=>"), text_of("Duplicated operands in '%s' expression", op), kinds=("Binary",)),
        Check("dupBranchBody", WARNING, kind("If") & (n("elseif") == 0) & (c("then.hash") == c("else.hash")), "Both branches do the same thing", kinds=("If",)),
        Check("dupBranchBody", WARNING, kind("Ternary") & has("then") & (c("then.hash") == c("else.hash")), "Then/else operands are identical", kinds=("Ternary",)),
        Check("arraySyntax", NOTICE, kind("Array") & (a("long") == "1"), "Use the short form '[]' instead of the old 'array()'", fix=F.concat(lit("["), F.regexp_extract(F.col("text"), r"(?is)^array\s*\((.*)\)$", 1), lit("]")), kinds=("Array",)),
        Check("bareTry", ERROR, kind("Try") & (n("catch") == 0) & (n("finally") == 0), "At least one catch or finally block must be present", kinds=("Try",)),
        Check("complexity", WARNING, kind("Function", "Method") & (F.col("end_line") - F.col("start_line") > 150), "Too big function: more than 150 lines", default=False, kinds=("Function", "Method")),
        Check("missingPhpdoc", NOTICE, kind("Method") & public & (F.col("doc") == "") & (F.col("parent_kind") != "Interface") & ~F.startswith(a("name"), lit("_")), text_of("Missing PHPDoc for %s public method", a("name")), default=False, kinds=("Method",)),
        Check("oldStyleConstructor", WARNING, kind("Method") & (F.col("parent_kind") == "Class") & (lower_name == F.lower(F.substring_index("cls", "\\", -1))), "Old-style constructor usage, use __construct instead", kinds=("Method",)),
        Check("stringInterpolationDeprecated", WARNING, kind("DeprecatedPart"), "'${variable}' string interpolation is deprecated since PHP 8.2, use '{$variable}'", kinds=("DeprecatedPart",)),
        Check("nonPublicInterfaceMember", ERROR, kind("Method", "ClassConst") & (F.col("parent_kind") == "Interface") & ~public, text_of("'%s' can't be %s", F.coalesce(a("name"), c("item.name")), F.trim(mods)), kinds=("Method", "ClassConst")),
        Check("implicitModifiers", NOTICE, kind("Method", "Property") & (F.col("parent_kind") != "Interface") & ~access, text_of("Specify the access modifier for %s explicitly", F.coalesce(a("name"), c("item.name"))), kinds=("Method", "Property")),
        Check("magicMethodDecl", WARNING, kind("Method") & lower_name.isin("__call", "__get", "__set", "__isset", "__unset", "__tostring", "__invoke", "__callstatic") & ~public, text_of("The magic method %s() must have public visibility", a("name")), kinds=("Method",)),
        Check("magicMethodDecl", WARNING, kind("Method") & lower_name.isin("__call", "__get", "__set", "__isset", "__unset", "__tostring", "__construct", "__destruct") & F.contains(mods, lit(" static ")), text_of("The magic method %s() cannot be static", a("name")), kinds=("Method",)),
        Check("magicMethodDecl", WARNING, kind("Method") & lower_name.isin("__callstatic", "__set_state") & ~F.contains(mods, lit(" static ")), text_of("The magic method %s() must be static", a("name")), kinds=("Method",)),
        Check("magicMethodDecl", ERROR, kind("Method") & _map({k: str(v) for k, v in MAGIC_METHODS.items() if v >= 0})[lower_name].isNotNull() & (_map({k: str(v) for k, v in MAGIC_METHODS.items() if v >= 0})[lower_name] != n("param").cast("string")), text_of("The magic method %s() must take exactly %s argument", a("name"), _map({k: str(v) for k, v in MAGIC_METHODS.items()})[lower_name]), kinds=("Method",)),
        Check("nestedTernary", WARNING, kind("Ternary") & (c("cond.kind") == "Ternary"), "Explicitly specify the order of operations for the ternary operator using parentheses", kinds=("Ternary",)),
        Check("langDeprecated", NOTICE, kind("Cast") & (a("raw") == "real"), "Use float cast instead of real", default=False, kinds=("Cast",)),
        Check("langDeprecated", NOTICE, call("is_real"), "Use is_float function instead of is_real", default=False, kinds=("Call",)),
        Check("langDeprecated", NOTICE, call("define") & (args == 3), "Defining a constant with case-insensitive flag is deprecated", kinds=("Call",)),
        Check("notExplicitNullableParam", NOTICE, kind("Param") & const_of("default", "null") & c("type.text").isNotNull() & ~c("type.text").rlike(r"(?i)^\?|\||^mixed$|^null$"), "parameter with null default value should be explicitly nullable", fix=F.concat(lit("?"), F.col("text")), kinds=("Param",)),
        Check("switchDefault", WARNING, kind("Switch") & c("case.any_default").isNull(), "Add 'default' branch to avoid unexpected unhandled condition values", default=False, kinds=("Switch",)),
        Check("switchEmpty", WARNING, kind("Switch") & (n("case") == 0), "Switch has empty body", kinds=("Switch",)),
        Check("switchSimplify", NOTICE, kind("Switch") & ((n("case") == 1) | (n("case") == 2) & ((F.coalesce(c("case.default"), lit("")) == "1") | (F.coalesce(c("case1.default"), lit("")) == "1"))), "Switch can be rewritten into an 'if' statement to increase readability", kinds=("Switch",)),
        Check("dangerousBoolCondition", WARNING, kind("If", "Elseif", "While", "Do") & (const_of("cond", "true", "false") | (c("cond.kind") == "Int") & c("cond.value").isin("0", "1")), "Potential dangerous bool value: you have constant bool value in condition", kinds=("If", "Elseif", "While", "Do")),
        Check("reverseAssign", WARNING, kind("Assign") & a("reversed").isNotNull(), text_of("Possible there should be '%s='", a("reversed")), kinds=("Assign",)),
        Check("getTypeMisUse", NOTICE, kind("Binary") & op.isin("==", "===", "!=", "!==") & (F.lower(c("left.name")) == "gettype") & tests[c("right.value")].isNotNull(), text_of("use %s instead of '%s'", tests[c("right.value")], F.col("text")), default=False, kinds=("Binary",)),
        Check("strangeCast", NOTICE, kind("Unary") & (op == "+") & ~c("expr.kind").isin("Int", "Float"), "Unary plus with non-constant expression, possible type cast, use an explicit cast to int or float instead of using the unary plus", kinds=("Unary",)),
        Check("strangeCast", NOTICE, kind("Binary") & (op == ".") & (((c("left.kind") == "String") & (F.coalesce(c("left.value"), lit("")) == "")) | ((c("right.kind") == "String") & (F.coalesce(c("right.value"), lit("")) == ""))), "Concatenation with empty string, possible type cast, use explicit cast to string instead of concatenate with empty string", kinds=("Binary",)),
        Check("strangeCast", NOTICE, kind("Binary") & (op == "+") & (((c("left.kind") == "Int") & (c("left.value") == "0")) | ((c("right.kind") == "Int") & (c("right.value") == "0"))), "Addition with zero, possible type cast, use an explicit cast to int or float instead of zero addition", kinds=("Binary",)),
        Check("unaryRepeat", WARNING, kind("Unary") & op.isin("!", "~") & (c("expr.kind") == "Unary") & (c("expr.op") == op) & (F.col("parent_kind") != "Unary"), "Several negations in a row do not make sense", kinds=("Unary",)),
        Check("useEval", WARNING, kind("Eval"), "Don't use the 'eval' function", kinds=("Eval",)),
        Check("useExitOrDie", WARNING, kind("Exit"), text_of("Don't use the '%s' function", F.lower(keyword)), kinds=("Exit",)),
        Check("useSleep", WARNING, call("sleep"), "Don't use the 'sleep' function", kinds=("Call",)),
        Check("errorSilence", NOTICE, kind("Silence"), "Don't use @, silencing errors is bad practice", default=False, kinds=("Silence",)),
        Check("selfAssign", WARNING, kind("Assign") & (op == "=") & same & pure_sides(), "Useless assignment of a variable to itself", kinds=("Assign",)),
        Check("returnAssign", WARNING, kind("Return") & ((c("expr.kind") == "Assign")), "Don't use assignment in the return statement", default=False, kinds=("Return",)),
        Check("assignOp", NOTICE, kind("Assign") & (op == "=") & (c("right.kind") == "Binary") & c("right.op").isin("+", "-", "*", "/", ".", "%", "**", "&", "|", "^", "<<", ">>", "??") & F.startswith(F.col("text"), F.concat(c("left.text"), lit(" = "), c("left.text"), lit(" "))), text_of("Could rewrite as '%s %s= …'", c("left.text"), c("right.op")), kinds=("Assign",)),
        Check("offBy1", WARNING, kind("Index") & F.lower(c("dim.name")).isin("count", "sizeof") & (c("dim.kind") == "Call") & (F.regexp_extract(c("dim.text"), r"\(\s*(.*?)\s*\)$", 1) == c("base.text")), "Probably intended to use count-1 as an index", kinds=("Index",)),
        Check("indexingSyntax", WARNING, kind("Index") & (a("curly") == "1"), "a[i] indexing instead of a{i}", fix=F.concat(c("base.text"), lit("["), c("dim.text"), lit("]")), kinds=("Index",)),
        Check("strictCmp", WARNING, kind("Binary") & op.isin("==", "!=") & (const_of("left", "true", "false", "null") | const_of("right", "true", "false", "null")), "Non-strict comparison (use === or !==)", kinds=("Binary",)),
        Check("strictCmp", WARNING, call("in_array", "array_search") & (args == 2) & (c("arg.inner") == "String"), "3rd argument of the call must be true when comparing strings", kinds=("Call",)),
        Check("precedence", WARNING, kind("Binary") & op.isin("&", "|") & (binary_in("left", COMPARISONS) | binary_in("right", COMPARISONS)), "Bitwise operators have lower precedence than comparison: put parentheses", kinds=("Binary",)),
        Check("precedence", WARNING, kind("Binary") & (op == "??") & binary_in("right", COMPARISONS), "'??' has lower precedence than comparison: put parentheses", kinds=("Binary",)),
        Check("concatenationPrecedence", WARNING, kind("Binary") & ((op == ".") & (binary_in("left", ["+", "-", "<<", ">>"]) | binary_in("right", ["+", "-", "<<", ">>"])) | op.isin("+", "-", "<<", ">>") & (binary_in("left", ["."]) | binary_in("right", ["."]))), "The precedence of '.' and of arithmetic differs between versions: put parentheses", kinds=("Binary",)),
        Check("bitwiseOps", WARNING, kind("Binary") & op.isin("&", "|") & binary_in_bool(), text_of("Used %s bitwise operator over bool operands, perhaps %s is intended?", op, F.concat(op, op)), kinds=("Binary",)),
        Check("callSimplify", NOTICE, call("in_array") & (F.lower(c("arg1.name")) == "array_keys"), "Could simplify to array_key_exists", kinds=("Call",)),
        Check("callSimplify", NOTICE, call("substr") & (args == 3) & (c("arg2.value") == "1") & (c("arg2.inner") == "Int"), text_of("Could simplify to %s[%s]", c("arg.text"), c("arg1.text")), fix=F.concat(c("arg.text"), lit("["), c("arg1.text"), lit("]")), kinds=("Call",)),
        Check("callSimplify", NOTICE, call("array_push") & (args == 2), text_of("Could simplify to %s[] = %s", c("arg.text"), c("arg1.text")), fix=F.concat(c("arg.text"), lit("[] = "), c("arg1.text")), kinds=("Call",)),
        Check("countUse", WARNING, kind("Binary") & F.lower(c("left.name")).isin("count", "sizeof") & (c("left.kind") == "Call") & (c("right.value") == "0") & op.isin(">=", "<"), "Count of elements is always greater than or equal to 0", kinds=("Binary",)),
        Check("ternarySimplify", NOTICE, kind("Ternary") & has("then") & (c("cond.hash") == c("then.hash")) & pure, text_of("Could rewrite as '%s ?: %s'", c("cond.text"), c("else.text")), fix=F.concat(c("cond.text"), lit(" ?: "), c("else.text")), kinds=("Ternary",)),
        Check("ternarySimplify", NOTICE, kind("Ternary") & (c("cond.kind") == "Isset") & (F.regexp_extract(c("cond.text"), r"(?i)^isset\s*\((.*)\)$", 1) == c("then.text")), text_of("Could rewrite as '%s ?? %s'", c("then.text"), c("else.text")), fix=F.concat(c("then.text"), lit(" ?? "), c("else.text")), kinds=("Ternary",)),
        Check("ternarySimplify", NOTICE, kind("Ternary") & const_of("then", "true") & const_of("else", "false"), text_of("Could rewrite as '(bool)%s'", c("cond.text")), kinds=("Ternary",)),
        Check("intNeedle", WARNING, call("strpos", "stripos", "strrpos", "strstr", "stristr", "strrchr") & (c("arg1.inner") == "Int"), "Since PHP 8.0 an int needle is read as a string, not as a character code", kinds=("Call",)),
        Check("argsOrder", WARNING, call("strpos", "stripos", "explode", "implode") & (args >= 2) & F.when(call("strpos", "stripos"), (c("arg.inner") == "String") & (c("arg1.inner") != "String")).otherwise((c("arg1.inner") == "String") & (c("arg.inner") != "String")), text_of("Potentially incorrect arguments order of %s", a("name")), kinds=("Call",)),
        Check("argsOrder", WARNING, call("random_int") & (c("arg.inner") == "Int") & (c("arg1.inner") == "Int") & (c("arg.value").try_cast("long") > c("arg1.value").try_cast("long")), "possibly wrong order of arguments, min must be less than max", kinds=("Call",)),
        Check("emptyStringCheck", WARNING, kind("If", "Elseif") & (c("cond.kind") == "Call") & F.lower(c("cond.name")).isin("strlen", "mb_strlen"), "Use an explicit comparison with the empty string", kinds=("If", "Elseif")),
        Check("forLoop", WARNING, kind("For") & (((c("cond.op").isin("<", "<=")) & (c("step.op") == "--")) | ((c("cond.op").isin(">", ">=")) & (c("step.op") == "++"))), "Potentially infinite 'for' loop, because the step moves away from the bound", kinds=("For",)),
        Check("discardExpr", WARNING, kind("Expr") & (c("expr.kind").isin("Array", "New") | pure & ~c("expr.kind").isin("Assign", "Include", "Exit", "Yield")), "Expression evaluated but not used", kinds=("Expr",)),
        Check("caseContinue", ERROR, kind("Continue") & (n("expr") == 0) & (F.col("parent_kind") == "Case"), "'continue' inside switch is 'break'", kinds=("Continue",)),
        Check("mixedArrayKeys", WARNING, kind("Array") & mixed_keys(), "Mixing implicit and explicit array keys", kinds=("Array",)),
        Check("stripTags", ERROR, call("strip_tags") & (args >= 2) & (c("arg1.inner") == "String") & c("arg1.value").rlike(r"/>"), "$allowed_tags argument: '/>' is not allowed, use '<tag>'", kinds=("Call",)),
        Check("invalidDocblock", WARNING, (F.col("doc") != "") & F.col("doc").rlike(r"@param\s+\$\w+\s+[A-Za-z\\|]+\s*(\n|\*)"), "Malformed @param tag: the type comes before the variable"),
        Check("invalidDocblockType", NOTICE, (F.col("doc") != "") & F.col("doc").rlike(r"(?i)@(param|return|var)\s+(boolean|integer|real|double)\b"), "Use the short name of the type in the comment"),
        Check("printf", ERROR, formats & (args - 1 < wanted), text_of("Format string has %d directives, but %d arguments are given", wanted, args - 1), kinds=("Call",)),
        Check("printf", WARNING, formats & (args - 1 > wanted), text_of("Format string has %d directives, %d arguments aren't used", wanted, args - 1 - wanted), kinds=("Call",)),
        Check("regexpVet", WARNING, call("preg_match", "preg_match_all", "preg_replace", "preg_split") & (c("arg.inner") == "String") & c("arg.value").rlike(r"\[[^\]]*([a-zA-Z0-9_])[^\]\-]*\1[^\]]*\]"), "A character occurs twice in a class of the regular expression", kinds=("Call",)),
        Check("regexpVet", WARNING, call("preg_match", "preg_match_all", "preg_replace", "preg_split") & (c("arg.inner") == "String") & c("arg.value").rlike(r"[+*][+*]|\((?:[^()\\]|\\.)*[+*]\)[+*]"), "A quantifier inside a repeated group of the regular expression", kinds=("Call",)),
        Check("regexpSyntax", ERROR, call("preg_match", "preg_match_all", "preg_replace", "preg_split") & (c("arg.inner") == "String") & broken_pattern(c("arg.value")), "The regular expression has no delimiter, an unclosed part or a quantifier with nothing before it", kinds=("Call",)),
        Check("regexpSimplify", NOTICE, call("preg_match", "preg_match_all", "preg_replace", "preg_split") & (c("arg.inner") == "String") & c("arg.value").rlike(r"\[0-9\]|\[a-zA-Z0-9_\]|\[A-Za-z0-9_\]|\{1\}|\{0,1\}|\{1,\}|\{0,\}"), text_of("May re-write %s with shorter classes and quantifiers", c("arg.text")), kinds=("Call",)),
        Check("typeHint", NOTICE, kind("Param") & (F.lower(c("type.text")) == "array"), text_of("Specify the type for the parameter $%s in PHPDoc, 'array' type hint too generic", a("name")), default=False, kinds=("Param",)),
        Check("trailingComma", NOTICE, kind("Array") & (F.col("start_line") < F.col("end_line")) & F.col("text").rlike(r"[^,\s]\s*\n\s*[\])]$"), "Last element in a multi-line array should have a trailing comma", default=False, kinds=("Array",)),
    ]
    return out


def misspelt(nodes: DataFrame, typos: dict[str, str]) -> DataFrame:
    """misspellName, misspellComment: words of declared names and of comments against a dictionary."""
    named = nodes.where(kind("Function", "Method", "Class", "Interface", "Trait", "Param", "PropertyItem") & a("name").isNotNull())
    parts = F.regexp_extract_all(a("name"), F.lit(r"[A-Z]?[a-z]+"), F.lit(0))
    rows = named.select("*", F.explode(parts).alias("word"), F.lit("misspellName").alias("check_name"))
    spoken = nodes.where(kind("Comment")).select("*", F.explode(F.regexp_extract_all("text", F.lit(r"\b[a-z]+\b"), F.lit(0))).alias("word"), F.lit("misspellComment").alias("check_name"))
    fixed = _map({k.lower(): v for k, v in typos.items()})[F.lower("word")]
    hit = rows.unionByName(spoken).where(fixed.isNotNull()).dropDuplicates(["path", "node_id", "check_name", "word"])
    return located(hit.withColumns({"level": F.lit(NOTICE), "message": text_of('"%s" is a misspelling of "%s"', F.col("word"), fixed)}))


def broken_pattern(value: Column) -> Column:
    """A pattern without delimiters, with brackets that don't match, or with a quantifier at the start of a part."""
    opened = F.substring(value, 1, 1)
    closed = F.translate(opened, "([{<", ")]}>")
    last = F.length(F.call_function("substring_index", value, closed, F.lit(-1)))
    inner = F.substring(value, F.lit(2), F.length(value) - last - 2)
    plain = F.regexp_replace(F.regexp_replace(inner, r"\\.", "x"), r"\[\^?\]?[^\]]*\]", "x")
    count = lambda ch: F.length(plain) - F.length(F.replace(plain, F.lit(ch), F.lit("")))
    return ~value.rlike(r"^[^\w\s\\]") | (F.length(value) < 2) | (last >= F.length(value) - 1) | (count("(") != count(")")) | F.contains(plain, F.lit("[")) | plain.rlike(r"^[*+?]|[(|][*+]|\(\?[^:=!<>a-zA-Z#|&'(RP\d+-]")


def pure_sides() -> Column:
    return ~F.col("text").rlike(r"\(|\+\+|--")


def binary_in_bool() -> Column:
    bools = [">", "<", ">=", "<=", "==", "!=", "===", "!==", "&&", "||"]

    def side(r: str) -> Column:
        return (F.coalesce(c(f"{r}.inner"), F.lit("")).isin("Binary", "Instanceof")) & F.coalesce(c(f"{r}.op"), F.lit("==")).isin(*bools) | c(f"{r}.kind").isin("Isset", "Empty")

    return side("left") & side("right")


def mixed_keys() -> Column:
    """Some item has a key and some item has none, of all items."""
    return c("item.keyed").isNotNull() & c("item.unkeyed").isNotNull()


def located(df: DataFrame) -> DataFrame:
    """Rows with check_name, level and message as findings."""
    return df.select("check_name", "level", "context", "message", F.col("path").alias("filename"), F.col("start_line").alias("line"), "start_char", "end_char")


def _by_kind(every: list[Check], value: Callable[[Check], Column]) -> Column:
    """An array of the values of the checks that can be about a row: a row meets the predicates of its kind only."""
    general = [value(x) for x in every if not x.kinds]
    kinds = sorted({k for x in every for k in x.kinds})
    if not kinds:
        return F.array(*general)
    own = F
    for k in kinds:
        own = own.when(F.col("kind") == k, F.array(*[value(x) for x in every if k in x.kinds]))
    return F.when(F.col("kind").isin(kinds), F.concat(F.array(*general), own)).otherwise(F.array(*general)) if general else own


def run(nodes: DataFrame, checks: list[Check] | None = None) -> DataFrame:
    """All findings of checks on single nodes."""
    every = structural() if checks is None else checks
    if checks is None:  # most nodes are of kinds that have nothing to say, but for comments, keywords and modifiers that any node can have: they go first
        nodes = nodes.where(F.col("kind").isin(sorted({k for x in every for k in x.kinds})) | (F.col("doc") != "") | (F.col("parent_kind") == "Global") | a("keyword").isNotNull() | a("raw_modifiers").isNotNull())
    found = _by_kind(every, lambda x: F.when(x.when, F.struct(F.lit(x.name).alias("check_name"), F.lit(x.level).alias("level"), (F.lit(x.message) if isinstance(x.message, str) else x.message).alias("message"))))
    # (explode and filter, and no filter() inside the row: a higher-order function would evaluate every predicate uncompiled)
    hit = nodes.select("path", "context", "start_line", "start_char", "end_char", F.explode(found).alias("_f")).where(F.col("_f").isNotNull())
    return located(hit.select("*", "_f.check_name", "_f.level", "_f.message"))


def edits(nodes: DataFrame, checks: list[Check] | None = None) -> DataFrame:
    """(path, start_pos, end_pos, replacement, check_name) of all quick fixes."""
    found = [F.when(x.when, F.struct(F.lit(x.name).alias("check_name"), x.fix.alias("replacement"))) for x in (structural() if checks is None else checks) if x.fix is not None]
    hit = nodes.withColumn("_f", F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())))
    return hit.select("path", "start_pos", "end_pos", "_f.replacement", "_f.check_name")


def apply_edits(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """(path, content) after the edits: outer ones win, edits inside them are dropped. The edits of one file are folded in place."""
    per = fixes.groupBy("path").agg(F.array_sort(F.collect_set(F.struct("start_pos", (-F.col("end_pos")).alias("neg_end"), "replacement"))).alias("e"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    fold = F.aggregate(
        "e",
        start,
        lambda acc, e: F.when(e["start_pos"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], F.substring(F.col("content"), acc["at"] + 1, e["start_pos"] - acc["at"]), e["replacement"]).alias("out"), (-e["neg_end"]).cast("int").alias("at"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col("content"), acc["at"] + 1, F.length("content"))),
    )
    return files.join(per, "path", "left").select("path", F.when(F.col("e").isNull(), F.col("content")).otherwise(fold).alias("content"))
