"""PHP in, findings out."""

import subprocess

import pytest

from codefacts.functions.hashing import fnv1a
from codefacts.operators import checks, facts, relational, reports
from codefacts.plans import lint
from codefacts.plans.sample import FILES
from codefacts.session import cut
from codefacts.sources import files as sources
from codefacts.sources.php import ParseError, parse


@pytest.fixture(scope="module")
def nodes(spark):
    return cut(facts.nodes(sources.buffers(spark, FILES)))


@pytest.fixture(scope="module")
def found(spark, nodes):
    return cut(lint.report(sources.buffers(spark, FILES), nodes, known_functions=["sleep", "is_integer", "count", "substr", "a"]))


def test_positions_are_exact():
    text = FILES["relations.php"]
    tree, _ = parse(text)
    for n in tree.walk():
        assert 0 <= n.start <= n.end <= len(text)
        for _, x in n.parts:
            assert n.start <= x.start and x.end <= n.end, (n.kind, x.kind)
    names = [text[n.start : n.end] for n in tree.walk() if n.kind == "Var"]
    assert all(v.startswith("$") for v in names)


@pytest.mark.parametrize("code", ["$a = ;", "function (", "if ($a { }", "class { }", "foo(1", "$x = [1, 2;"])
def test_syntax_errors(code):
    with pytest.raises(ParseError):
        parse("<?php " + code)


@pytest.mark.parametrize("code,kinds", [("1 + 2 * 3", ["Binary", "Int", "Binary", "Int", "Int"]), ("!$a instanceof B", ["Unary", "Instanceof", "Var", "Name"]), ("$a ?? $b ?? 1", ["Binary", "Var", "Binary", "Var", "Int"]), ("-$a ** 2", ["Unary", "Binary", "Var", "Int"]), ('"a $b {$c[1]}"', ["Template", "Var", "Index", "Var", "Int"]), ("fn($x) => $x", ["ArrowFunction", "Param", "Var"])])
def test_expressions(code, kinds):
    tree, _ = parse(f"<?php {code};")
    assert [n.kind for n in tree.parts[0][1].parts[0][1].walk()] == kinds


def test_findings(found):
    got = {(r.filename, r.check_name) for r in found.collect()}
    want = {
        "simple.php": "dupSubExpr useSleep arraySyntax constCase useEval notExplicitNullableParam oldStyleConstructor implicitModifiers magicMethodDecl callSimplify precedence switchEmpty bareTry ternarySimplify indexingSyntax unaryRepeat strangeCast useExitOrDie offBy1 intOverflow phpAliases forLoop discardExpr",
        "relations.php": "unimplemented methodSignatureMismatch parentConstructor accessLevel undefinedMethod badTraitUse nameMismatch newAbstract invalidNew undefinedClass undefinedFunction argCount deprecated callStatic invalidExtendClass undefinedTrait paramClobber maybeUndefined undefinedVariable unused deadCode caseBreak dupCond varShadow dupArrayKeys dupCatch",
        "broken.php": "syntax",
    }
    for f, names in want.items():
        assert set(names.split()) <= {c for g, c in got if g == f}, f
    # clean, generated, switched off, suppressed
    assert not [g for g in got if g[0] in ("clean.php", "generated.php", "disabled.php")]
    assert [(r.line, r.check_name) for r in found.where("filename = 'suppressed.php'").collect()] == [(4, "useSleep")]


def test_namespaces(nodes):
    assert {r.cls for r in nodes.where("kind = 'Class'").collect()} >= {"N\\Base", "Foo"}
    k = {r.key: r.name for r in relational.classes(nodes).collect()}
    assert k["n\\base"] == "N\\Base"


def test_checks_are_one_scan(nodes):
    import io
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        checks.run(nodes).explain()
    assert "Join" not in out.getvalue() and "Exchange" not in out.getvalue()


def test_quick_fixes(spark, nodes):
    text = lint.fixed(sources.buffers(spark, {"simple.php": FILES["simple.php"]}), nodes).first().content
    for part in ("$x = [1, 2]", "$y = true", "?int $p = null", "$s = $s[$i]", "$a ?: $b", "$x[0]", "is_int($x)"):
        assert part in text
    parse(text.replace("exit;", ""))


def test_edits_overlap(spark):
    f = spark.createDataFrame([("a", "0123456789"), ("b", "untouched")], "path string, content string")
    e = spark.createDataFrame([("a", 1, 8, "X"), ("a", 2, 4, "inner"), ("a", 8, 9, "Y"), ("a", 8, 9, "Y")], "path string, start_pos int, end_pos int, replacement string")
    assert dict(map(tuple, checks.apply_edits(f, e).collect())) == {"a": "0XY9", "b": "untouched"}


def test_baseline_round_trip(found):
    h = cut(lint.hashed(found))
    items = lint.baseline_items(reports.baseline_build(h))
    again = lint.read_baseline(items)
    assert reports.baseline_suppress(h, again, ["line", "start_char"]).count() == 0
    assert reports.baseline_suppress(h, again.where("hash <> 0").limit(0), ["line"]).count() == h.count()
    r = h.first()
    assert int(r.hash) == fnv1a("#".join([r.file, r.check_name, r.context.strip(), r.message]).encode())


def test_report_text(found):
    t = lint.rendered(found.where("check_name = 'useSleep' AND filename = 'suppressed.php'")).first().text
    assert t == "WARNING useSleep: Don't use the 'sleep' function at suppressed.php:4\nsleep(2);\n^^^^^^^^"
    assert '"check_name":"useSleep"' in "".join(r.value for r in lint.as_json(found).collect())


def test_duplicates(spark):
    body = "{ $a = 1; $b = $a + 2; foreach ([1, 2] as $c) { echo $c, $a, $b; } return $a . $b . 'x'; }"
    n = facts.nodes(sources.buffers(spark, {"a.php": f"<?php function f() {body} function g() {body}", "b.php": f"<?php class A {{ public function h() {body.replace(' ', '  ')} }}"}))
    rows = lint.duplicates(n).collect()
    assert len(rows) == 1 and {p.fn for p in rows[0].places} == {"f", "g", "A::h"}


def test_edges(spark):
    f = spark.createDataFrame([("empty.php", ""), ("null.php", None), ("html.php", "<b>no code</b>"), ("deep.php", "<?php $a = " + "(" * 300 + "1" + ")" * 300 + ";")], "path string, content string")
    n = facts.nodes(f)
    assert {r.path for r in n.where("kind = 'File'").collect()} == {"empty.php", "null.php", "html.php", "deep.php"}
    assert lint.all_findings(f.limit(0), cut(n.limit(0))).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name, content in (("a.php", "<?php echo 1;"), ("x/b.inc", "<?php echo 2;"), ("c.txt", "no"), ("x/skip.php", "<?php")):
        (tmp_path / name).write_text(content)
    got = sources.directory(spark, str(tmp_path), exclude="skip").collect()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in got) == ["a.php", "b.inc"]
    git = ["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com"]
    subprocess.run([*git[:3], "init", "-q"], check=True)
    subprocess.run([*git, "add", "."], check=True)
    subprocess.run([*git, "commit", "-qm", "one/two"], check=True)
    tree = sources.git_tree(spark, str(tmp_path)).collect()
    assert {(r.path, r.content) for r in tree} == {("a.php", "<?php echo 1;"), ("x/skip.php", "<?php")}
    (tmp_path / "a.php").write_text("<?php echo 1;\necho 3;\n")
    h = sources.hunks(sources.git_lines(spark, str(tmp_path), "diff", "-U0")).collect()
    assert [(r.old_name, r.new_name, r.new_from, r.new_to) for r in h] == [("a.php", "a.php", 1, 2)]
    assert sources.log(sources.git_lines(spark, str(tmp_path), "log", "--format=%h/%an/%s")).first().subject == "one/two"


def test_arguments_and_docs(spark):
    code = """<?php
/**
 * @param string $a
 * @param int $gone
 * @see nowhere()
 * @see g()
 */
function f(int $a, ?int $b, $c = null, string $d = null) { return $a; }
/** @see Other::x */
function g($from, $to) { f(null, null, null, null); g($to, $from); g($from, $to); }
"""
    n = cut(facts.nodes(sources.buffers(spark, {"a.php": code})))
    s = relational.Symbols(n)
    got = sorted((r.line, r.check_name) for r in relational.arguments(n).collect())
    assert got == [(10, "argsReverse"), (10, "notNullSafetyFunctionArgumentConstFetch")]
    got = sorted((r.check_name, r.message.split()[-1]) for r in relational.docs(n, s).collect())
    assert got == [("funcParamTypeMissMatch", "<<string>>"), ("invalidDocblock", "$gone"), ("invalidDocblockRef", "Other"), ("invalidDocblockRef", "nowhere")]


def names(spark, code):
    return [r.check_name for r in checks.run(facts.nodes(sources.buffers(spark, {"a.php": "<?php\n" + code}))).collect()]


def test_mixed_keys_of_all_items(spark):
    keyed = ", ".join(f"'k{i}' => {i}" for i in range(100))
    assert "mixedArrayKeys" in names(spark, f"$a = [{keyed}, 1];")
    assert "mixedArrayKeys" in names(spark, "$a = [1, 2, 3, 4, 'k' => 5];")
    assert "mixedArrayKeys" not in names(spark, f"$a = [{keyed}];")
    assert "mixedArrayKeys" not in names(spark, "$a = [['a' => 1], ['b' => 2], fn($x) => $x];")


def test_long_nodes_are_read_whole(spark):
    long = ", ".join(f"'a long enough value {i}'" for i in range(60))
    many = " ".join(["plain"] * 200)
    code = f"<?php\n/** {many} recieve */\n$a = array({long});\nprintf('%d', {long}, ...$a);\nfunction f($x) {{ return $x; }}\n$s = 1;\nswitch ($s) {{ case 1: f('{many}'); break; case 2: f(2); break; default: f(3); }}\n$b = [\n{long.replace(', ', ',' + chr(10))}\n];\n"
    buffers = {"a.php": code, "off.php": f"<?php\n/* {many} @linter disable */\nsleep(1);\n"}
    files = sources.buffers(spark, buffers)
    n = cut(facts.nodes(files))
    found = {r.check_name for r in checks.run(n).where("filename = 'a.php'").collect()}
    assert {"arraySyntax", "trailingComma"} <= found and not {"printf", "switchDefault"} & found
    assert checks.misspelt(n, {"recieve": "receive"}).count() == 1
    assert lint.report(files, n).where("filename = 'off.php'").count() == 0
    assert f"$a = [{long}];" in {r.path: r.content for r in lint.fixed(files, n).collect()}["a.php"]


def test_spread_after_long_arguments(spark):
    long = ", ".join(f"'a long enough value {i}'" for i in range(60))
    code = f"<?php\nfunction f($a, $b, $c) {{ return [$a, $b, $c]; }}\nf(['x', {long}], ...$r);\nf('...');\n"
    n = cut(facts.nodes(sources.buffers(spark, {"a.php": code})))
    found = relational.undefined(n, relational.Symbols(n)).where("check_name = 'argCount'").collect()
    assert [r.line for r in found] == [4]
