"""PHP made from the table ``part``: each row is a file about one check, with the finding or without it.

A row's case is its key modulo the number of cases, and p_size says whether the file has the fault,
so SQL over the same table knows which findings the engine must report, and on which lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.operators import checks, facts, flow, names, nulls, relational, rules, types
from codefacts.plans import lint
from codefacts.plans.rulefile import EMBEDDED
from codefacts.session import cut, kept, spread

#: (check, code with the fault, code without it[, line of the finding]); KEY is the row's key, the code begins on line 2
Case = tuple[str, str, str] | tuple[str, str, str, int]

NODE: list[Case] = [
    ("syntax", "$a = ;", "$a = 1;"),
    ("emptyStmt", "foo();;", "foo();"),
    ("intOverflow", "$a = 99999999999999999999;", "$a = 9999;"),
    ("phpAliases", "echo join(',', $x);", "echo implode(',', $x);"),
    ("keywordCase", "FOREACH ($a as $b) { echo $b; }", "foreach ($a as $b) { echo $b; }"),
    ("constCase", "$a = TRUE;", "$a = true;"),
    ("redundantGlobal", "function f() { global $_GET; }", "function f() { global $g; }"),
    ("dupSubExpr", "if ($a == $a) { echo 1; }", "if ($a == $b) { echo 1; }"),
    ("dupBranchBody", "if ($a) { echo 1; } else { echo 1; }", "if ($a) { echo 1; } else { echo 2; }"),
    ("arraySyntax", "$a = array(1, 2);", "$a = [1, 2];"),
    ("bareTry", "try { foo(); }", "try { foo(); } finally { bar(); }"),
    ("complexity", "function f() {\n" + "foo();\n" * 151 + "}", "function f() {\n" + "foo();\n" * 149 + "}"),
    ("missingPhpdoc", "class A { public function b() {} }", "class A { /** B. */ public function b() {} }"),
    ("oldStyleConstructor", "class A { public function a() {} }", "class A { public function __construct() {} }"),
    ("stringInterpolationDeprecated", '$s = "x ${name}";', '$s = "x {$name}";'),
    ("nonPublicInterfaceMember", "interface I { private function f(); }", "interface I { public function f(); }"),
    ("implicitModifiers", "class A { function f() {} }", "class A { public function f() {} }"),
    ("magicMethodDecl", "class A { private function __get($n) {} }", "class A { public function __get($n) {} }"),
    ("nestedTernary", "$x = $a ? 1 : 2 ? 3 : 4;", "$x = ($a ? 1 : 2) ? 3 : 4;"),
    ("langDeprecated", "$x = is_real($y);", "$x = is_float($y);"),
    ("notExplicitNullableParam", "function f(int $p = null) {}", "function f(?int $p = null) {}"),
    ("switchDefault", "switch ($a) { case 1: echo 1; break; case 2: break; }", "switch ($a) { case 1: echo 1; break; case 2: break; default: break; }"),
    ("switchEmpty", "switch ($a) { }", "switch ($a) { case 1: break; }"),
    ("switchSimplify", "switch ($a) { case 1: echo 1; break; default: echo 2; }", "switch ($a) { case 1: echo 1; break; case 2: break; default: echo 2; }"),
    ("dangerousBoolCondition", "if (true) { echo 1; }", "if ($a) { echo 1; }"),
    ("reverseAssign", "$a =+ 1;", "$a += 1;"),
    ("getTypeMisUse", "if (gettype($a) === 'string') { echo 1; }", "if (is_string($a)) { echo 1; }"),
    ("strangeCast", "$a = +$b;", "$a = (int)$b;"),
    ("unaryRepeat", "$a = !!$b;", "$a = !$b;"),
    ("useEval", "eval('1;');", "evaluate('1;');"),
    ("useExitOrDie", "die;", "dying();"),
    ("useSleep", "sleep(1);", "usleep(1);"),
    ("errorSilence", "$a = @foo();", "$a = foo();"),
    ("selfAssign", "$a = $a;", "$a = $b;"),
    ("returnAssign", "function f() { return $a = 1; }", "function f() { return 1; }"),
    ("assignOp", "$a = $a + 1;", "$a = $b + 1;"),
    ("offBy1", "$x = $arr[count($arr)];", "$x = $arr[count($arr) - 1];"),
    ("indexingSyntax", "$x = $s{0};", "$x = $s[0];"),
    ("strictCmp", "if ($a == null) { echo 1; }", "if ($a === null) { echo 1; }"),
    ("precedence", "if ($a & $b == 2) { echo 1; }", "if (($a & $b) == 2) { echo 1; }"),
    ("concatenationPrecedence", "$x = $a . $b + 1;", "$x = $a . ($b + 1);"),
    ("bitwiseOps", "$x = ($a > 1) & ($b > 2);", "$x = ($a > 1) && ($b > 2);"),
    ("callSimplify", "$x = in_array($k, array_keys($a));", "$x = array_key_exists($k, $a);"),
    ("countUse", "if (count($a) >= 0) { echo 1; }", "if (count($a) > 0) { echo 1; }"),
    ("ternarySimplify", "$x = $a ? $a : $b;", "$x = $a ? $c : $b;"),
    ("intNeedle", "$x = strpos($s, 10);", "$x = strpos($s, 'a');"),
    ("argsOrder", "$x = strpos('a', $s);", "$x = strpos($s, 'a');"),
    ("emptyStringCheck", "if (strlen($s)) { echo 1; }", "if ($s !== '') { echo 1; }"),
    ("forLoop", "for ($i = 0; $i < 5; $i--) { echo $i; }", "for ($i = 0; $i < 5; $i++) { echo $i; }"),
    ("discardExpr", "$a + 1;", "$b = $a + 1;"),
    ("caseContinue", "while ($a) { switch ($b) { case 1: continue; } }", "while ($a) { switch ($b) { case 1: break; } }"),
    ("mixedArrayKeys", "$x = ['a' => 1, 'b' => 2, 'c' => 3, 'd' => 4, 5];", "$x = ['a' => 1, 'b' => 2, 'c' => 3, 'd' => 4];"),
    ("stripTags", "$x = strip_tags($s, '<br/>');", "$x = strip_tags($s, '<br>');"),
    ("invalidDocblock", "/** @param $a int */\nfunction f($a) {}", "/** @param int $a */\nfunction f($a) {}", 3),
    ("invalidDocblockType", "/** @return boolean */\nfunction f() {}", "/** @return bool */\nfunction f() {}", 3),
    ("printf", "$x = sprintf('%s %s', $a);", "$x = sprintf('%s %s', $a, $b);"),
    ("regexpVet", "preg_match('/[aba]/', $s);", "preg_match('/[abc]/', $s);"),
    ("regexpSyntax", "preg_match('/(a/', $s);", "preg_match('/(a)[(]\\(/', $s);"),
    ("regexpSyntax", "preg_match('abc', $s);", "preg_match('~abc~i', $s);"),
    ("regexpSyntax", "preg_match('/+a/', $s);", "preg_match('/a+/', $s);"),
    ("regexpSimplify", "preg_match('/[0-9]x/', $s);", "preg_match('/\\dx/', $s);"),
    ("typeHint", "function f(array $a) {}", "function f(Foo $a) {}"),
    ("trailingComma", "$x = [\n1,\n2\n];", "$x = [\n1,\n2,\n];"),
]
SYMBOL: list[Case] = [
    ("undefinedFunction", "missing_KEY();", "function have_KEY() {} have_KEY();"),
    ("argCount", "function few_KEY($a, $b) {} few_KEY(1);", "function few_KEY($a, $b = 1) {} few_KEY(1);"),
    ("deprecated", "/** @deprecated */ function old_KEY() {} old_KEY();", "/** Fine. */ function old_KEY() {} old_KEY();"),
    ("nameMismatch", "function some_KEY() {} Some_KEY();", "function some_KEY() {} some_KEY();"),
    ("undefinedClass", "$x = new Missing_KEY();", "class Have_KEY {} $x = new Have_KEY();"),
    ("undefinedTrait", "class T_KEY { use NoTrait_KEY; }", "trait Yes_KEY {} class T_KEY { use Yes_KEY; }"),
    ("newAbstract", "abstract class Abs_KEY {} $x = new Abs_KEY();", "class Abs_KEY {} $x = new Abs_KEY();"),
    ("invalidNew", "interface Int_KEY {} $x = new Int_KEY();", "class Int_KEY {} $x = new Int_KEY();"),
    ("invalidExtendClass", "final class Fin_KEY {} class Sub_KEY extends Fin_KEY {}", "class Fin_KEY {} class Sub_KEY extends Fin_KEY {}"),
    ("parentNotFound", "class Orphan_KEY { public function f() { parent::f(); } }", "class Up_KEY { public function f() {} } class Orphan_KEY extends Up_KEY { public function f() { parent::f(); } }"),
    ("badTraitUse", "trait Tr_KEY {} function hint_KEY(Tr_KEY $t) {}", "class Tr_KEY {} function hint_KEY(Tr_KEY $t) {}"),
]
MEMBER: list[Case] = [
    ("undefinedMethod", "class A_KEY { public function f() { $this->nope(); } }", "class A_KEY { public function f() { $this->f(); } }"),
    ("accessLevel", "class B_KEY { private static function s() {} } class C_KEY { public function f() { B_KEY::s(); } }", "class B_KEY { public static function s() {} } class C_KEY { public function f() { B_KEY::s(); } }"),
    ("callStatic", "class D_KEY { public static function s() {} public function f() { $this->s(); } }", "class D_KEY { public static function s() {} public function f() { self::s(); } }"),
    ("unimplemented", "interface I_KEY { function need(); } class E_KEY implements I_KEY {}", "interface I_KEY { function need(); } class E_KEY implements I_KEY { public function need() {} }"),
    ("methodSignatureMismatch", "class F_KEY { final public function f() {} } class G_KEY extends F_KEY { public function f() {} }", "class F_KEY { public function f() {} } class G_KEY extends F_KEY { public function f() {} }"),
    ("parentConstructor", "class H_KEY { public function __construct() {} } class J_KEY extends H_KEY { public function __construct() {} }", "class H_KEY { public function __construct() {} } class J_KEY extends H_KEY { public function __construct() { parent::__construct(); } }"),
    ("nameMismatch", "class K_KEY { public function some() { $this->SOME(); } }", "class K_KEY { public function some() { $this->some(); } }"),
]
SIBLING: list[Case] = [
    ("dupArrayKeys", "$x = ['a' => 1, 'b' => 2, 'a' => 3];", "$x = ['a' => 1, 'b' => 2, 'c' => 3];"),
    ("dupCond", "if ($a) { echo 1; } elseif ($b) { echo 2; } elseif ($b) { echo 3; }", "if (f()) { echo 1; } elseif (f()) { echo 2; }"),
    ("dupCond", "switch ($a) { case 1: break; case 2: break; case 1: break; }", "switch ($a) { case 1: break; case 2: break; }"),
    ("dupCatch", "try { f(); } catch (A $e) { } catch (A $e) { }", "try { f(); } catch (A $e) { } catch (A | B $e) { }"),
    ("catchOrder", "class X_KEY extends Exception {} class Y_KEY extends X_KEY {} try { f(); } catch (X_KEY $e) { } catch (Y_KEY $e) { }", "class X_KEY extends Exception {} class Y_KEY extends X_KEY {} try { f(); } catch (Y_KEY $e) { } catch (X_KEY $e) { }"),
    ("dupGlobal", "function f() { global $a, $b, $a; }", "function f() { global $a, $b; }"),
    ("classMembersOrder", "class A { public function f() {} public $p; }", "class A { public $p; public function f() {} }"),
    ("varShadow", "function f($p) { foreach ([1] as $p) { echo $p; } }", "function f($p) { foreach ([1] as $q) { echo $q; } }"),
]
ARGUMENT: list[Case] = [
    ("notNullSafetyFunctionArgumentConstFetch", "function nn_KEY(int $p) {} nn_KEY(null);", "function nn_KEY(?int $p) {} nn_KEY(null);"),
    ("argsReverse", "function ar_KEY($left, $right) {} ar_KEY($right, $left);", "function ar_KEY($left, $right) {} ar_KEY($left, $right);"),
]
DOC: list[Case] = [
    ("funcParamTypeMissMatch", "/** @param int $a */\nfunction dm_KEY(string $a) {}", "/** @param string $a */\nfunction dm_KEY(string $a) {}", 3),
    ("invalidDocblock", "/** @param int $b */\nfunction db_KEY(int $a) {}", "/** @param int $a */\nfunction db_KEY(int $a) {}", 3),
    ("invalidDocblockRef", "/** @see Nowhere_KEY::x */\nfunction dr_KEY() {}", "/** @see dr_KEY() */\nfunction dr_KEY() {}", 3),
]
FLOW: list[Case] = [
    ("unused", "function f() { $a = 1; }", "function f() { $a = 1; return $a; }"),
    ("deadCode", "function f() { return 1; echo 2; }", "function f() { echo 2; return 1; }"),
    ("caseBreak", "function f($v) { switch ($v) { case 1: $v++; case 2: return $v; } return 0; }", "function f($v) { switch ($v) { case 1: $v++; break; case 2: return $v; } return 0; }"),
    ("maybeUndefined", "function f($q) { if ($q) { $x = 1; } echo $x; }", "function f($q) { if ($q) { $x = 1; } else { $x = 2; } echo $x; }"),
    ("undefinedVariable", "function f() { echo $und; }", "function f($und) { echo $und; }"),
    ("paramClobber", "function f($p) { $p = 1; return $p; }", "function f($p) { $p = $p + 1; return $p; }"),
    ("discardVar", "function f() { $_x = 1; echo $_x; }", "function f() { $x = 1; echo $x; }"),
    ("deadCode", "function f($a) { if ($a) { return 1; } else { throw new E(); } echo 3; }", "function f($a) { if ($a) { return 1; } echo 3; }"),
]
TYPE: list[Case] = [
    ("redundantCast", "$x = (int)5;", "$x = (int)'5';"),
    ("redundantCast", "function rc_KEY(string $s) { return (string)$s; }", "function rc_KEY(string $s) { return (bool)$s; }"),
    ("redundantCast", "$y = (array)[1, 'a'];", "$y = (array)$z;"),
]
NULL: list[Case] = [
    ("notNullSafetyFunctionArgumentVariable", "function nv_KEY(int $p) {} function g_KEY(?int $q) { nv_KEY($q); }", "function nv_KEY(int $p) {} function g_KEY(?int $q) { if ($q === null) { return; } nv_KEY($q); }"),
    ("notNullSafetyFunctionArgumentFunctionCall", "function nf_KEY(int $p) {} function r_KEY(): ?int { return 1; } nf_KEY(r_KEY());", "function nf_KEY(int $p) {} function r_KEY(): int { return 1; } nf_KEY(r_KEY());"),
    ("notNullSafetyFunctionArgumentStaticFunctionCall", "function ns_KEY(int $p) {} class S_KEY { public static function m(): ?int { return 1; } } ns_KEY(S_KEY::m());", "function ns_KEY(int $p) {} class S_KEY { public static function m(): int { return 1; } } ns_KEY(S_KEY::m());"),
    ("notNullSafetyFunctionArgumentPropertyFetch", "function np_KEY(int $p) {} class P_KEY { public ?int $x; public function f() { np_KEY($this->x); } }", "function np_KEY(int $p) {} class P_KEY { public int $x; public function f() { np_KEY($this->x); } }"),
    ("notNullSafetyFunctionArgumentArrayDimFetch", "function na_KEY(int $p) {} function g_KEY(?array $q) { na_KEY($q[0]); }", "function na_KEY(int $p) {} function g_KEY(array $q) { na_KEY($q[0]); }"),
    ("notNullSafetyFunctionArgumentList", "function nl_KEY(array $p) {} function g_KEY(?int $q) { nl_KEY([$q]); }", "function nl_KEY(array $p) {} function g_KEY(int $q) { nl_KEY([$q]); }"),
    ("notSafeCall", "function sc_KEY(int $p) {} sc_KEY('a');", "function sc_KEY(float $p) {} sc_KEY(1);"),
    ("notNullSafetyPropertyFetch", "function g_KEY(?Foo $q) { return $q->x; }", "function g_KEY(?Foo $q) { return $q?->x; }"),
    ("notNullSafetyVariable", "function g_KEY(?Foo $q) { $q->run(); }", "function g_KEY(?Foo $q) { if ($q !== null) { $q->run(); } }"),
    ("notNullSafetyFunctionCall", "function r_KEY(): ?Foo { return new Foo(); } r_KEY()->run();", "function r_KEY(): Foo { return new Foo(); } r_KEY()->run();"),
    ("notNullSafetyStaticFunctionCall", "function g_KEY(?Foo $q) { $q::run(); }", "function g_KEY(Foo $q) { $q::run(); }"),
    ("voidResultUsed", "function v_KEY() { echo 1; } $x = v_KEY();", "function v_KEY() { return 1; } $x = v_KEY();"),
    ("arrayAccess", "class N_KEY {} function g_KEY(N_KEY $q) { return $q[0]; }", "class N_KEY implements ArrayAccess {} function g_KEY(N_KEY $q) { return $q[0]; }"),
]
NAME: list[Case] = [
    ("undefinedProperty", "class U_KEY { public $a; public function f() { return $this->b; } }", "class U_KEY { public $a; public function f() { return $this->a; } }"),
    ("undefinedProperty", "class Up_KEY { public $a; } class Low_KEY extends Up_KEY { public function f() { return $this->b; } }", "class Up_KEY { public $b; } class Low_KEY extends Up_KEY { public function f() { return $this->b; } }"),
    ("accessLevel", "class Q_KEY { private static $s; } class R_KEY { public function f() { return Q_KEY::$s; } }", "class Q_KEY { public static $s; } class R_KEY { public function f() { return Q_KEY::$s; } }"),
    ("undefinedConstant", "class C_KEY { const A = 1; public function f() { return self::B; } }", "class C_KEY { const A = 1; public function f() { return self::A; } }"),
    ("undefinedConstant", "echo MISSING_KEY;", "const HAVE_KEY = 1; echo HAVE_KEY;"),
    ("propNullDefault", "class D_KEY { public Foo $p = null; }", "class D_KEY { public ?Foo $p = null; }"),
]
TYPO: list[Case] = [
    ("misspellName", "function retreive_KEY() {}", "function retrieve_KEY() {}"),
    ("misspellComment", "// how to recieve it", "// how to receive it"),
]

#: What the rules that come with the engine report, and what they leave alone
RULES = "ternarySimplify precedence assignOp offBy1 argsOrder callSimplify strictCmp indexingSyntax intNeedle langDeprecated strangeCast emptyStringCheck returnAssign countUse unaryRepeat forLoop selfAssign errorSilence concatenationPrecedence useExitOrDie useEval useSleep".split()
RULE: list[Case] = [c for c in NODE if c[0] in RULES and c[0] != "strangeCast"] + [
    ("strangeCast", "$a = 0 + $b;", "$a = 1 + $b;"),
    ("bitwiseOps", "function f(bool $a, bool $b) { return $a & $b; }", "function f(int $a, int $b) { return $a & $b; }"),
    ("alwaysNull", "if ($a === null && $a->name) { echo 1; }", "if ($a !== null && $a->name) { echo 1; }"),
    ("alwaysNull", "if ($a == null && $a->run(1, 2)) { echo 1; }", "if ($a == null && $b->run(1, 2)) { echo 1; }"),
]

Plan = Callable[[DataFrame, DataFrame], DataFrame]


def single_nodes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """One scan reads the nodes once, so they needn't be stored before it."""
    return checks.run(nodes)


FAMILIES: dict[str, tuple[list[Case], Plan]] = {
    "checks_of_nodes": (NODE, single_nodes),
    "checks_of_symbols": (SYMBOL, lambda files, nodes: relational.undefined(nodes, relational.Symbols(nodes))),
    "checks_of_members": (MEMBER, lambda files, nodes: relational.members(nodes, relational.Symbols(nodes))),
    "checks_of_siblings": (SIBLING, lambda files, nodes: relational.siblings(nodes, relational.Symbols(nodes))),
    "checks_of_arguments": (ARGUMENT, lambda files, nodes: relational.arguments(nodes)),
    "checks_of_docs": (DOC, lambda files, nodes: relational.docs(nodes, relational.Symbols(nodes))),
    "checks_of_flow": (FLOW, lambda files, nodes: flow.findings(files)),
    "checks_of_types": (TYPE, lambda files, nodes: types.redundant_casts(nodes, types.expressions(files))),
    "checks_of_nulls": (NULL, lambda files, nodes: nulls.findings(nodes, cut(types.expressions(files)), relational.Symbols(nodes))),
    "checks_of_names": (NAME, lambda files, nodes: names.findings(nodes, relational.Symbols(nodes))),
    "rule_groups": (RULE, lambda files, nodes: rules.apply(files, rules.parse_rules(EMBEDDED))),
    "checks_of_words": (TYPO, lambda files, nodes: checks.misspelt(nodes, TYPOS)),
}


def files_of(part: DataFrame, cases: list[Case]) -> DataFrame:
    """(path, content, p_partkey, no): a file for each row of ``part``."""
    spark = part.sparkSession
    code = spark.createDataFrame([(i, fault, "<?php\n" + c[1 if fault else 2] + "\n") for i, c in enumerate(cases) for fault in (True, False)], "no int, fault boolean, code string")
    rows = part.select("p_partkey", F.pmod("p_partkey", F.lit(len(cases))).cast("int").alias("no"), (F.col("p_size") % 2 == 0).alias("fault"))
    key = F.col("p_partkey").cast("string")
    return rows.join(F.broadcast(code), ["no", "fault"]).select(F.concat(key, F.lit(".php")).alias("path"), F.replace("code", F.lit("KEY"), key).alias("content"), "p_partkey", "no")


def found_in(spark: SparkSession, sf_dir: str, cases: list[Case], plan: Plan) -> DataFrame:
    """(p_partkey, check_name, line): the findings of each file's own check."""
    files = files_of(spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), "p_partkey"), cases)
    nodes = facts.nodes(files)
    found = plan(files, nodes if plan is single_nodes else kept(nodes, "kind"))
    own = F.element_at(F.array(*[F.lit(c[0]) for c in cases]), F.pmod("p_partkey", F.lit(len(cases))).cast("int") + 1)
    rows = found.select(F.regexp_extract("filename", r"^(\d+)", 1).cast("long").alias("p_partkey"), "check_name", "line")
    return rows.where(F.col("check_name") == own).distinct()


def expected(cases: list[Case]) -> str:
    """The SQL that knows which findings the files have."""
    values = ", ".join(f"({i}, '{c[0]}', {c[3] if len(c) > 3 else 2})" for i, c in enumerate(cases))
    return f"""
WITH c(no, check_name, line) AS (VALUES {values})
SELECT p_partkey, check_name, line::INT AS line FROM part JOIN c ON p_partkey % {len(cases)} = no WHERE p_size % 2 = 0"""


TYPOS = {"retreive": "retrieve", "recieve": "receive"}


def whole_report(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Everything: all checks, the gate, files and nodes that are exempt."""
    return lint.report(files, nodes, disabled=[], typos=TYPOS, typed=True)


FAMILIES["lint_report"] = ([case for name, (cases, _) in FAMILIES.items() if name != "rule_groups" for case in cases], whole_report)


def _query(cases: list[Case], plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: found_in(spark, sf_dir, cases, plan)


QUERIES = {name: _query(cases, plan) for name, (cases, plan) in FAMILIES.items()}
ORACLE_SQL = {name: expected(cases) for name, (cases, _) in FAMILIES.items()}
