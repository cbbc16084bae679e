"""Pattern rules and checks with tables of their own."""

import pytest

from codefacts.operators import checks, facts, rules
from codefacts.operators.rules import Rule, compile_pattern, match
from codefacts.sources.files import buffers


def fits(pattern, code):
    bound = {}
    return match(compile_pattern(pattern), compile_pattern(code), bound) and {k: v.kind for k, v in bound.items()}


@pytest.mark.parametrize(
    "pattern,code,want",
    [
        ("$x == $x", "f(1) == F(1)", {"x": "Call"}),
        ("$x == $x", "$a == $b", False),
        ("$_ == $_", "$a == $b", {}),
        ('f(${"*"}, 1)', "f($a, $b, 1)", {}),
        ('f(${"*"}, 1)', "f(1)", {}),
        ('f(${"*"})', "f()", {}),
        ('f(${"*"}, $x, ${"*"})', "f(1)", {"x": "Int"}),
        ('f(${"*"}, 1)', "f(1, 2)", False),
        ('${"x:int"} + ${"y:var"}', "1 + $q", {"x": "Int", "y": "Var"}),
        ('${"x:int"} + 1', "1.5 + 1", False),
        ("strpos($s, ${'n:char'})", "strpos($t, 'a')", {"s": "Var", "n": "String"}),
        ("strpos($s, ${'n:char'})", "strpos($t, 'ab')", False),
        ("array($x)", "[$y]", {"x": "Var"}),
        ("$o->m($x)", "$p->M(1)", {"o": "Var", "x": "Int"}),
        ("[$k => $v]", "[1 => 2]", {"k": "Int", "v": "Int"}),
    ],
)
def test_match(pattern, code, want):
    assert fits(pattern, code) == want


def test_bad_patterns():
    for bad in ("$x = ", '${"x:nothing"}', "a(); b();"):
        with pytest.raises(ValueError):
            compile_pattern(bad)


def test_apply(spark):
    files = buffers(spark, {"a.php": "<?php\n$a = $a + 1;\nif (f($x) ? f($x) : 2) {}\nfoo(bar(1), 'a long text');", "lib/b.php": "<?php $b = $b + 2;", "bad.php": "<?php ("})
    given = [
        Rule("own", ("$v = $v + $n", "$v = $v - $n"), "write $v += $n", fix="$v += $n", excluded=("lib/",)),
        Rule("short", ("$c ? $c : $e",), "$c twice: $$", pure=("c",)),
        Rule("named", ("foo($x, $y)",), "arg $y of $$", where={"y": "^'a"}),
        Rule("late", ("foo($x, $y)",), "never: the first rule wins"),
    ]
    got = rules.apply(files, given).orderBy("filename", "line").collect()
    assert [(r.filename, r.line, r.check_name, r.message, r.replacement) for r in got] == [("a.php", 2, "own", "write $a += 1", "$a += 1"), ("a.php", 4, "named", "arg 'a long text' of foo(bar(1), 'a long text')", None)]
    with pytest.raises(ValueError, match="one name"):
        rules.apply(files, [given[0], given[0]])
    assert rules.apply(files, []).count() == 0


def test_formats_and_words(spark):
    code = "<?php\nprintf('%d %s %%', 1);\nsprintf('%5.2f', 1, 2);\nsprintf('%s', $a);\npreg_match('/[0-9]{1,}/', $s);\npreg_match('/[aba]/', $s);\n// the adress of it\nfunction recieveAll($lenght) {}\n"
    n = facts.nodes(buffers(spark, {"a.php": code}))
    got = {(r.line, r.check_name) for r in checks.run(n).collect()}
    assert {(2, "printf"), (3, "printf"), (5, "regexpSimplify"), (6, "regexpVet")} <= got and (4, "printf") not in got
    words = checks.misspelt(n, {"adress": "address", "recieve": "receive", "lenght": "length"}).collect()
    assert {(r.line, r.check_name) for r in words} == {(7, "misspellComment"), (8, "misspellName")} and len(words) == 3


def test_lines_before_a_change(spark):
    from codefacts.operators import reports

    f = spark.createDataFrame([("a", n, "c") for n in (1, 4, 5, 8, 9)] + [("b", 3, "c")], "filename string, line int, check_name string")
    # lines 4-5 are new, and old lines after 7 lost two
    h = spark.createDataFrame([("a", 3, 2, 4, 5), ("a", 6, 7, 7, 6)], "new_name string, old_from int, old_to int, new_from int, new_to int")
    got = {(r.filename, r.line): r.old_line for r in reports.aligned(f, h).collect()}
    assert got == {("a", 1): 1, ("a", 4): None, ("a", 5): None, ("a", 8): 8, ("a", 9): 9, ("b", 3): 3}
    old = spark.createDataFrame([("a", 8, "other"), ("b", 3, "c")], "filename string, line int, check_name string")
    assert {(r.filename, r.line) for r in reports.new_by_line(f, old, h).collect()} == {("a", 1), ("a", 4), ("a", 5), ("a", 9)}
    assert ("a", 8) in {(r.filename, r.line) for r in reports.new_by_line(f, old, h, by_check=True).collect()}
    assert {r.line for r in reports.in_changed_lines(f, h).collect()} == {4, 5}
    assert reports.by_allowed_authors(spark.createDataFrame([("x",)], "author string"), ["x"])


def test_cache(spark, tmp_path):
    at = str(tmp_path / "cache")
    one = buffers(spark, {"a.php": "<?php $a = 1;", "b.php": "<?php $b = 2;"})
    want = sorted(map(str, facts.nodes(one).collect()))
    for _ in range(2):
        assert sorted(map(str, facts.cached(one, at).collect())) == want
    n = spark.read.parquet(at).count()
    two = buffers(spark, {"a.php": "<?php $a = 3;", "b.php": "<?php $b = 2;"})
    assert sorted(map(str, facts.cached(two, at).collect())) == sorted(map(str, facts.nodes(two).collect()))
    assert n < spark.read.parquet(at).count() < 2 * n


def test_stream(spark, tmp_path):
    from codefacts.streaming.watch import watch

    src = tmp_path / "src"
    src.mkdir()
    args = (spark, str(src), str(tmp_path / "out"), str(tmp_path / "check"))
    for k in range(2):
        (src / f"{k}.php").write_text("<?php sleep(1);")
        watch(*args, once=True).awaitTermination(60)
    assert sorted(r.filename.rsplit("/", 1)[-1] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["0.php", "1.php"]
